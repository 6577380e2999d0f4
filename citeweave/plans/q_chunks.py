"""Chunking, titles, fingerprints, summaries, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import blocked, chunks
from citeweave.plans import ansi as A
from citeweave.plans.registry import query
from citeweave.sources.tables import table

LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda p: {A.strip('p')}), lambda p: p <> '')"
# Chunks whose summaries make up a paper's.
PAPER_CHUNKS = 10
REF = r"'^\s*(-\s*)?\[\d+\]'"


@query("chunk_paragraphs", f"""
SELECT doc_id, source, pos AS chunk_index,
       CASE WHEN regexp_matches(item, {REF}) THEN 'reference' ELSE 'text' END AS chunk_type,
       {A.fold('item')} AS text
FROM {A.exploded('documents', 'doc_id, source', LINES)}
""")
def chunk_paragraphs(spark, base):
    docs = table(spark, base, "documents", spread="doc_id")
    return chunks.paragraphs(docs, "doc_id", "text", ["source"]).withColumn(
        "chunk_index", F.col("chunk_index").cast("long"))


@query("ascii_scrub", f"SELECT doc_id, {A.fold(A.strip('text'))} AS clean FROM documents")
def ascii_scrub(spark, base):
    docs = table(spark, base, "documents", spread="doc_id")
    return docs.select("doc_id", T.final_scrub(F.col("text")).alias("clean"))


@query("decompose_claims", f"""
SELECT doc_id, pos, item AS claim FROM {A.exploded('documents', 'doc_id', A.claims(A.fold('text')))}
""")
def decompose_claims(spark, base):
    docs = table(spark, base, "documents", spread="doc_id")
    return docs.select("doc_id", F.posexplode(T.claims(T.ascii_fold(F.col("text")))).alias("pos", "claim")) \
        .withColumn("pos", F.col("pos").cast("long"))


@query("paper_titles", f"""
WITH l AS (SELECT doc_id, list_transform(list_filter({LINES}, lambda p: NOT regexp_matches(p, {REF})),
                                         lambda p: {A.fold('p')}) AS t FROM documents),
g AS (SELECT doc_id,
  list_filter(t, lambda p: length(p) >= 30 AND NOT regexp_matches(p,
   '^HHS Public Access|^Author manuscript|^available in PMC|^Published in final edited form|^Contents lists available at|^Acta Biomater\\.|^NIH Public Access|^\\d+\\.\\s+Introduction$|^journal homepage|^www\\.')) AS good,
  list_filter(t, lambda p: length(p) > 10) AS spare FROM l)
SELECT doc_id, coalesce(good[1], spare[1], '') AS title FROM g
""".replace("\\\\", "\\"))
def paper_titles(spark, base):
    docs = table(spark, base, "documents", spread="doc_id")
    return docs.select("doc_id", chunks.title(F.col("text")).alias("title"))


@query("content_hash_dups", f"""
WITH h AS (SELECT doc_id, substr(sha256(array_to_string(
    list_transform(list_filter({LINES}, lambda p: NOT regexp_matches(p, {REF})), lambda p: {A.fold('p')}),
    chr(10))), 1, 16) AS content_hash FROM documents),
f AS (SELECT content_hash, min(doc_id) AS kept, count(*) AS copies FROM h GROUP BY 1)
SELECT h.doc_id, h.content_hash, f.kept AS first_doc, f.copies FROM h JOIN f USING (content_hash)
WHERE h.doc_id > f.kept
""")
def content_hash_dups(spark, base):
    docs = table(spark, base, "documents", spread="doc_id")
    hashed = docs.select("doc_id", chunks.fingerprint(F.col("text")).alias("content_hash"))
    # Narrow rows, spread evenly: both uses below read this one exchange.
    hashed = hashed.repartition("doc_id")
    firsts = hashed.groupBy("content_hash").agg(
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    return (
        hashed.join(firsts.filter("copies > 1"), "content_hash")
        .filter("doc_id > first_doc").select("doc_id", "content_hash", "first_doc", "copies")
    )


def _summaries(src: str) -> str:
    """CTEs that end in ``summed(doc_id, summary)`` for the texts of a table."""
    return f"""b AS (SELECT doc_id, {A.fold('text')} AS t FROM {src}),
s AS (SELECT doc_id, t, CASE WHEN length(t) >= 100 THEN
        list_filter({A.sentences('t')}, lambda x: length(x) > 20) END AS s FROM b),
k AS (SELECT doc_id, len(s) AS n, pos AS i, term FROM
      (SELECT doc_id, s, pos, unnest({A.lexemes('item')}) AS term FROM
        (SELECT doc_id, s, i AS pos, s[i + 1] AS item FROM
          (SELECT doc_id, s, unnest(range(len(s))) AS i FROM s WHERE len(s) > 2)))),
tok AS (SELECT doc_id, n, i, term, count(*) AS tf FROM k GROUP BY ALL),
v AS (SELECT doc_id, term, count(*) AS df FROM tok GROUP BY doc_id, term),
w AS (SELECT doc_id, i, sum(x) / sqrt(sum(x * x)) AS score FROM
      (SELECT doc_id, i, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tok JOIN v USING (doc_id, term)) GROUP BY 1, 2),
p AS (SELECT doc_id, list(i ORDER BY i) AS pick FROM (SELECT *, row_number() OVER
      (PARTITION BY doc_id ORDER BY round(score, 9) DESC, i) AS r FROM w) WHERE r <= 2 GROUP BY 1),
summed AS (SELECT doc_id, CASE WHEN s IS NULL THEN t WHEN len(s) = 0 THEN substr(t, 1, 200)
  WHEN len(s) <= 2 THEN array_to_string(s, ' ')
  WHEN pick IS NULL THEN array_to_string(s[1:2], ' ')
  ELSE array_to_string(list_transform(pick, lambda j: s[j + 1]), ' ') END AS summary
FROM s LEFT JOIN p USING (doc_id))
"""


@query("extractive_summary", f"WITH {_summaries('documents')} SELECT doc_id, summary FROM summed")
def extractive_summary(spark, base):
    return chunks.summarise(table(spark, base, "documents"), "doc_id", "text")


@query("paper_summaries", f"""
WITH paras AS (SELECT doc_id || ':' || pos AS doc_id, {A.fold('item')} AS text
  FROM {A.exploded('documents', 'doc_id', LINES)} WHERE NOT regexp_matches(item, {REF})),
{_summaries('paras')},
said AS (SELECT string_split(doc_id, ':')[1]::BIGINT AS doc_id, string_split(doc_id, ':')[2]::BIGINT AS pos, summary FROM summed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM said WHERE summary <> '')
SELECT doc_id, string_agg(summary, ' ' ORDER BY pos) AS summary FROM ranked WHERE nth <= {PAPER_CHUNKS} GROUP BY doc_id
""")
def paper_summaries(spark, base):
    """A paper's summary: the summaries of its first ten chunks that have one."""
    docs = table(spark, base, "documents", spread="doc_id")
    parts = chunks.paragraphs(docs, "doc_id", "text", []).filter("chunk_type <> 'reference'")
    parts = parts.withColumn("key", F.concat_ws(":", "doc_id", "chunk_index"))
    said = chunks.summarise(parts, "key", "text").filter("summary <> ''")
    at = F.split("key", ":")
    rows = said.select(at[0].cast("long").alias("doc_id"), at[1].cast("int").alias("pos"), "summary")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(
        F.slice(F.array_sort(F.collect_list(F.struct("pos", "summary"))), 1, PAPER_CHUNKS), lambda x: x["summary"]), " ").alias("summary"))


@query("systematic_sample", """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, pos FROM r WHERE n <= 20
   OR pos IN (SELECT CAST(floor(i * n / 20) AS BIGINT) FROM range(20) t(i))
""")
def systematic_sample(spark, base):
    """Every paper keeps at most 20 chunks, evenly spread over its positions."""
    keep = 20
    docs = table(spark, base, "documents").select("doc_id", "source")
    ranked = blocked.position(docs, ["source"], "doc_id", "pos", size="n")
    # pos = floor(i*n/keep) for some i  <=>  ceil(pos*keep/n) maps back onto pos.
    step = F.ceil(F.col("pos") * keep / F.col("n"))
    hit = (step < keep) & (F.floor(step * F.col("n") / keep) == F.col("pos"))
    return ranked.filter((F.col("n") <= keep) | hit).select("doc_id", "source", "pos")


@query("discussion_tail", """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
                  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, pos, n FROM r WHERE pos >= n - greatest(2, n // 10)
""")
def discussion_tail(spark, base):
    """Closing chunks of each paper stand in for its discussion section."""
    docs = table(spark, base, "documents").select("doc_id", "source")
    ranked = blocked.position(docs, ["source"], "doc_id", "pos", size="n")
    tail = F.greatest(F.lit(2), F.floor(F.col("n") / 10))
    return ranked.filter(F.col("pos") >= F.col("n") - tail).select("doc_id", "source", "pos", "n")


@query("html_sections", """
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
  len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs,
  len(regexp_extract_all(html, '<h[1-6][ >]')) AS n_headings,
  len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS n_links,
  coalesce(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)[1], '') AS first_link
FROM pages
""")
def html_sections(spark, base):
    pages = table(spark, base, "pages", spread="page_id")
    links = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(
        "page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"),
        F.regexp_count("html", F.lit("<h[1-6][ >]")).cast("long").alias("n_headings"),
        F.size(links).cast("long").alias("n_links"),
        F.coalesce(F.try_element_at(links, F.lit(1)), F.lit("")).alias("first_link"),
    )


@query("chunk_stats", f"""
WITH c AS (SELECT source, lang, {A.words('text')} AS w, text FROM documents)
SELECT source, count(*) AS n_chunks, CAST(sum(len(w)) AS BIGINT) AS n_words,
       CAST(sum(CASE WHEN len(w) >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS long_chunks,
       count(DISTINCT lang) AS n_langs, max(length(text)) AS longest
FROM c GROUP BY source
""")
def chunk_stats(spark, base):
    docs = table(spark, base, "documents", spread="doc_id")
    n = F.size(T.words(F.col("text")))
    return docs.select("source", "lang", n.alias("w"), F.length("text").alias("len")).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("w").alias("n_words"),
        F.count_if(F.col("w") >= 20).alias("long_chunks"),
        F.countDistinct("lang").alias("n_langs"), F.max("len").cast("long").alias("longest"))
