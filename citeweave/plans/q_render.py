"""Prompt and report text, answer consistency, id repair, claim-index queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeweave.functions import render as R
from citeweave.operators import dense
from citeweave.plans import ansi as A
from citeweave.plans.q_retrieval import DENSE_ALL
from citeweave.plans.registry import query
from citeweave.sources.tables import table

CLAIM_RESULTS, CLAIM_DISTANCE = 50, 1.5
KEEP_CONSISTENCY = 0.25


@query("plain_keys", r"""
SELECT doc_id, regexp_replace(text, '[^\x00-\x7f]|\?', '', 'g') AS clean FROM documents
""")
def plain_keys(spark, base):
    return table(spark, base, "documents").select("doc_id", R.plain_key(F.col("text")).alias("clean"))


NODE_IDS = """CASE p_partkey % 4 WHEN 0 THEN p_name || '.pdf::' || p_type || ':' || p_partkey WHEN 1 THEN p_type || ':' || p_name
  WHEN 2 THEN p_name ELSE p_type || ':x' || p_partkey || ': ab' END"""


@query("node_labels", f"""
WITH n AS (SELECT p_partkey, {NODE_IDS} AS id FROM part),
b AS (SELECT p_partkey, CASE WHEN contains(id, '::') THEN substr(id, strpos(id, '::') + 2) ELSE id END AS id FROM n),
s AS (SELECT p_partkey, id, string_split(id, ':') AS l FROM b)
SELECT p_partkey, CASE WHEN len(l) = 1 THEN id WHEN length(trim(l[-1])) < 4 THEN l[-2] || ':' || l[-1] ELSE trim(l[-1]) END AS label FROM s
""")
def node_labels(spark, base):
    """Names of typed, paper-prefixed and bare node ids."""
    ids = table(spark, base, "part").select("p_partkey", F.expr(NODE_IDS).alias("id"))
    return ids.select("p_partkey", R.node_label(F.col("id")).alias("label"))


def _prints(answer: str) -> str:
    low = "lower(x)"
    return (
        f"list_distinct(list_transform({A.claims(answer)}, lambda x: CASE WHEN len({A.words(low)}) >= 5 "
        f"THEN array_to_string({A.words(low)}[1:8], ' ') ELSE {low} END))")


@query("answer_consistency", f"""
WITH a AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id, turn, {_prints('text')} AS a, {_prints('other')} AS b FROM a WHERE other IS NOT NULL),
r AS (SELECT conv_id, turn, round(len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1), 4) AS consistency FROM p)
SELECT conv_id, turn, consistency, consistency >= {KEEP_CONSISTENCY} AS keep FROM r
""")
def answer_consistency(spark, base):
    """How many claims each answer shares with the next one of its conversation."""
    said = table(spark, base, "conversations").filter("role = 'assistant'")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    both = said.withColumn("other", following).filter("other is not null")
    return both.select("conv_id", "turn", R.consistency(F.col("text"), F.col("other")).alias("consistency")).withColumn(
        "keep", F.col("consistency") >= KEEP_CONSISTENCY)


@query("category_prompt", """
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2)
SELECT source, string_agg('CATEGORY: ' || lang || chr(10) || 'DESCRIPTION: ' || n || ' examples' || chr(10), chr(10) ORDER BY n DESC, first) AS prompt
FROM c GROUP BY source
""")
def category_prompt(spark, base):
    """Categories of each source as tagged lines, those with most examples first."""
    per = table(spark, base, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    line = F.concat(F.lit("CATEGORY: "), "lang", F.lit("\nDESCRIPTION: "), F.col("n").cast("string"), F.lit(" examples\n"))
    return per.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("o"), "first", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))


@query("entity_prompt", """
WITH e AS (SELECT o_orderkey, p_type AS category, l_linenumber AS pos, '  ENTITY: ' || p_name || chr(10) ||
    '  BRAND: ' || p_brand || chr(10) AS item
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
g AS (SELECT o_orderkey, category, '## ' || category || chr(10) || string_agg(item, chr(10) ORDER BY pos, item) || chr(10) AS block FROM e GROUP BY 1, 2)
SELECT o_orderkey, string_agg(block, '' ORDER BY category) AS prompt FROM g GROUP BY 1
""")
def entity_prompt(spark, base):
    """Entities of each order as tagged lines under their categories in order."""
    li = table(spark, base, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, base, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name", "p_brand")
    orders = table(spark, base, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    item = F.concat(F.lit("  ENTITY: "), "p_name", F.lit("\n  BRAND: "), "p_brand", F.lit("\n"))
    rows = li.join(orders, "l_orderkey").join(parts, "l_partkey")
    blocks = rows.groupBy("l_orderkey", "p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("l_linenumber", item.alias("item")))), lambda x: x["item"]), "\n").alias("items"))
    block = F.concat(F.lit("## "), "p_type", F.lit("\n"), "items", F.lit("\n"))
    return blocks.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("p_type", block.alias("block")))), lambda x: x["block"]), "").alias("prompt"))


@query("index_repair", """
WITH s AS (SELECT source, (row_number() OVER (ORDER BY source) - 1)::VARCHAR AS idx FROM (SELECT DISTINCT source FROM documents)),
r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 25)::VARCHAR WHEN 1 THEN 'src' || (event_id % 25) ELSE 'paper' || event_id END AS ref FROM events)
SELECT event_id, coalesce(a.source, b.source) AS paper FROM r LEFT JOIN s a ON a.idx = ref LEFT JOIN s b ON b.source = ref
WHERE coalesce(a.source, b.source) IS NOT NULL
""")
def index_repair(spark, base):
    """References by position or by id to the papers they mean; unknown ones are dropped."""
    # The list of papers that was numbered for a model: one short list per answer.
    papers = table(spark, base, "documents").select("source").distinct().withColumn(
        "idx", (F.row_number().over(Window.orderBy("source")) - 1).cast("string"))
    n = (F.col("event_id") % 25).cast("string")
    ref = F.when(F.col("event_id") % 3 == 0, n).when(F.col("event_id") % 3 == 1, F.concat(F.lit("src"), n)).otherwise(
        F.concat(F.lit("paper"), F.col("event_id").cast("string")))
    asked = table(spark, base, "events").select("event_id", ref.alias("ref"))
    return (
        asked.join(papers.select(F.col("idx").alias("ref"), F.col("source").alias("a")), "ref", "left")
        .join(papers.select(F.col("source").alias("ref"), F.col("source").alias("b")), "ref", "left")
        .select("event_id", F.coalesce("a", "b").alias("paper")).filter("paper is not null"))


@query("claim_index_query", f"""
WITH {DENSE_ALL} SELECT item_id, vec_id, round(dist, 6) AS dist, rank FROM den WHERE rank <= {CLAIM_RESULTS} AND dist <= {CLAIM_DISTANCE}
""")
def claim_index_query(spark, base):
    """The nearest stored claims of each question within the distance."""
    vec = table(spark, base, "embeddings")
    asked = table(spark, base, "benchmark").join(vec.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qvec")), "item_id")
    near = dense.nearest(vec, "vec_id", "embedding", asked, "item_id", "qvec", CLAIM_RESULTS, "l2", CLAIM_DISTANCE)
    return near.select("item_id", "vec_id", F.round("value", 6).alias("dist"), F.col("rank").cast("long"))


@query("vectors_filled", """
SELECT d.doc_id, CASE WHEN c.vec_id IS NOT NULL THEN 'cached' WHEN f.vec_id IS NOT NULL THEN 'fetched' ELSE 'missing' END AS origin,
  coalesce(len(coalesce(c.embedding, f.embedding)), 0) AS width
FROM documents d LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) c ON c.vec_id = d.doc_id
LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 3 = 0) f ON f.vec_id = d.doc_id
""")
def vectors_filled(spark, base):
    """Documents with their cached vector, else the fetched one."""
    vec = table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, base, "documents").select("doc_id")
    both = docs.join(vec.filter("doc_id % 2 = 0").withColumnRenamed("embedding", "c"), "doc_id", "left").join(
        vec.filter("doc_id % 3 = 0").withColumnRenamed("embedding", "f"), "doc_id", "left")
    origin = F.when(F.col("c").isNotNull(), "cached").when(F.col("f").isNotNull(), "fetched").otherwise("missing")
    width = F.when(F.coalesce("c", "f").isNotNull(), F.size(F.coalesce("c", "f")).cast("long")).otherwise(F.lit(0).cast("long"))
    return both.select("doc_id", origin.alias("origin"), width.alias("width"))
