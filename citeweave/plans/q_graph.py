"""Knowledge-graph queries: an order is a chunk, a part an entity, a supplier a paper."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeweave.operators import graph
from citeweave.plans.registry import query
from citeweave.session import durable
from citeweave.sources.tables import table

# Search seeds of the background loop and how many the graph adds.
DEFAULT_SEEDS = [
    "biomaterial surface modification immune response",
    "titanium implant osseointegration",
    "macrophage polarization biomaterials",
]
GRAPH_SEEDS, MAX_SEEDS = 4, 8

INC = """
inc AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS node FROM lineitem),
und AS (SELECT a.node AS u, b.node AS v, count(*) AS n_chunks, max(a.chunk) AS last_chunk
        FROM inc a JOIN inc b ON a.chunk = b.chunk AND a.node < b.node GROUP BY 1, 2),
dir AS (SELECT u AS src, v AS dst FROM und UNION ALL SELECT v, u FROM und),
deg AS (SELECT src AS node, count(*) AS degree FROM dir GROUP BY 1)
"""
PLACES = """
e AS (SELECT 's' || s_suppkey AS u, 'n' || s_nationkey AS v FROM supplier
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
"""


def _mentions(spark, base):
    return table(spark, base, "lineitem").select("l_orderkey", "l_partkey")


def _inc(spark, base):
    return graph.incidence(_mentions(spark, base), "l_orderkey", "l_partkey")


def _parts(spark, base):
    return table(spark, base, "part").select(F.col("p_partkey").alias("node"), "p_name", "p_type", "p_brand")


def _node_id():
    return F.concat("p_type", F.lit(":"), F.col("node").cast("string"))


@query("kg_nodes", """
SELECT p_type || ':' || p_partkey AS node_id, p_type AS node_type, s_name AS source_paper, p_name AS evidence
FROM (SELECT l_partkey, l_suppkey, row_number() OVER
      (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS r FROM lineitem) l
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE r = 1
""")
def kg_nodes(spark, base):
    li = table(spark, base, "lineitem").select(F.col("l_partkey").alias("node"), "l_suppkey", "l_orderkey", "l_linenumber")
    last = graph.upsert_nodes(li, "node", F.struct("l_orderkey", "l_linenumber", "l_suppkey"), ["l_suppkey"])
    sup = table(spark, base, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return last.join(_parts(spark, base), "node").join(sup, "l_suppkey").select(
        _node_id().alias("node_id"), F.col("p_type").alias("node_type"),
        F.col("s_name").alias("source_paper"), F.col("p_name").alias("evidence"))


@query("kg_cooccurrence", f"""
WITH {INC} SELECT u AS src, v AS dst, 'co_occurs_with' AS relation, n_chunks, last_chunk FROM und
UNION ALL SELECT v, u, 'co_occurs_with', n_chunks, last_chunk FROM und
""")
def kg_cooccurrence(spark, base):
    edges = graph.both_ways(graph.undirected(_inc(spark, base)), "n_chunks", "last_chunk")
    return edges.select("src", "dst", F.lit(graph.CO_OCCURS).alias("relation"), "n_chunks", "last_chunk")


@query("kg_counts", f"""
WITH {INC} SELECT (SELECT count(DISTINCT node) FROM inc) AS n_nodes, (SELECT count(*) FROM dir) AS n_edges
""")
def kg_counts(spark, base):
    inc = _inc(spark, base)
    n_edges = graph.pairs(inc).select("u", "v").distinct().count() * 2
    return inc.agg(F.countDistinct("node").alias("n_nodes")).withColumn("n_edges", F.lit(n_edges).cast("long"))


@query("kg_degree_topk", f"""
WITH {INC} SELECT p_type || ':' || node AS node_id, p_type AS node_type, degree FROM deg JOIN part ON p_partkey = node
ORDER BY degree DESC, node LIMIT 8
""")
def kg_degree_topk(spark, base):
    top = graph.degrees(_inc(spark, base)).orderBy(F.desc("degree"), "node").limit(8)
    return top.join(_parts(spark, base), "node").select(_node_id().alias("node_id"), F.col("p_type").alias("node_type"), "degree")


@query("kg_seed_terms", f"""
WITH {INC}, n AS (SELECT p_name, max(degree) AS degree FROM deg JOIN part ON p_partkey = node GROUP BY 1),
k AS (SELECT p_name AS term, row_number() OVER (ORDER BY degree DESC, p_name) AS r FROM n),
a AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(DEFAULT_SEEDS))}) t(pos, term)
      UNION ALL SELECT 100 + r, term FROM k WHERE r <= 4),
d AS (SELECT term, min(pos) AS pos FROM a GROUP BY 1)
SELECT term, row_number() OVER (ORDER BY pos) AS pos FROM d ORDER BY pos LIMIT 8
""")
def kg_seed_terms(spark, base):
    """Default search seeds, then the names of the best connected entities."""
    names = graph.degrees(_inc(spark, base)).join(_parts(spark, base), "node") \
        .groupBy("p_name").agg(F.max("degree").alias("degree"))
    top = names.orderBy(F.desc("degree"), "p_name").limit(GRAPH_SEEDS)
    order = Window.orderBy(F.desc("degree"), "p_name")
    graph_seeds = top.select(F.col("p_name").alias("term"), (F.row_number().over(order) + 100).alias("p"))
    default = spark.createDataFrame(list(enumerate(DEFAULT_SEEDS)), "p int, term string")
    seeds = default.unionByName(graph_seeds).groupBy("term").agg(F.min("p").alias("p"))
    return seeds.orderBy("p").limit(MAX_SEEDS).select("term", F.row_number().over(Window.orderBy("p")).cast("long").alias("pos"))


@query("kg_neighbors", f"""
WITH {INC}, m AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1)
SELECT p_type || ':' || dst AS node_id, p_type AS node_type, p_name AS evidence
FROM dir JOIN m ON src = node JOIN part ON p_partkey = dst
""")
def kg_neighbors(spark, base):
    """Out-neighbours of the best connected entity with their properties."""
    inc = _inc(spark, base)
    hub = graph.degrees(inc).orderBy(F.desc("degree"), "node").limit(1).select("node")
    around = graph.step(inc, hub).join(hub, "node", "left_anti")
    return around.join(_parts(spark, base), "node").select(
        _node_id().alias("node_id"), F.col("p_type").alias("node_type"), F.col("p_name").alias("evidence"))


@query("kg_triples", f"""
WITH {INC} SELECT src, dst, s.p_name AS src_name, t.p_name AS dst_name FROM dir
JOIN part s ON s.p_partkey = src JOIN part t ON t.p_partkey = dst WHERE s.p_type = 'ECONOMY' AND t.p_type = 'SMALL'
""")
def kg_triples(spark, base):
    """(ECONOMY) -co_occurs_with-> (SMALL): both types are filtered before pairs are made."""
    parts = _parts(spark, base).filter(F.col("p_type").isin("ECONOMY", "SMALL"))
    inc = _inc(spark, base).join(parts.select("node"), "node", "left_semi")
    ends = graph.both_ways(graph.pairs(inc).select("u", "v").distinct())
    s = parts.filter("p_type = 'ECONOMY'").select(F.col("node").alias("src"), F.col("p_name").alias("src_name"))
    t = parts.filter("p_type = 'SMALL'").select(F.col("node").alias("dst"), F.col("p_name").alias("dst_name"))
    return ends.join(s, "src").join(t, "dst").select("src", "dst", "src_name", "dst_name")


SEEDS_SQL = "s AS (SELECT p_partkey AS node FROM part WHERE p_name = 'red widget' AND p_brand = 'Brand#17')"


def _seeds(spark, base):
    return _parts(spark, base).filter("p_name = 'red widget' AND p_brand = 'Brand#17'").select("node")


@query("kg_khop", f"""
WITH {INC}, {SEEDS_SQL},
h1 AS (SELECT DISTINCT dst AS node FROM dir WHERE src IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM s)),
h2 AS (SELECT DISTINCT dst AS node FROM dir WHERE src IN (SELECT node FROM h1)
       AND dst NOT IN (SELECT node FROM h1) AND dst NOT IN (SELECT node FROM s))
SELECT node, 0 AS hop FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2
""")
def kg_khop(spark, base):
    return graph.hops(_inc(spark, base), _seeds(spark, base), 2)


@query("kg_related", f"""
WITH {INC}, {SEEDS_SQL},
h AS (SELECT DISTINCT b.dst AS node FROM dir a JOIN dir b ON b.src = a.dst WHERE a.src IN (SELECT node FROM s)
      UNION SELECT dst FROM dir WHERE src IN (SELECT node FROM s))
SELECT p_type || ':' || node AS node_id, p_type AS node_type FROM h JOIN part ON p_partkey = node
WHERE node NOT IN (SELECT node FROM s) ORDER BY node_id LIMIT 15
""")
def kg_related(spark, base):
    """First 15 entities within two hops of those matching the question."""
    near = graph.hops(_inc(spark, base), _seeds(spark, base), 2).filter("hop > 0")
    return near.join(_parts(spark, base), "node").select(
        _node_id().alias("node_id"), F.col("p_type").alias("node_type")).orderBy("node_id").limit(15)


@query("kg_subgraph", f"""
WITH inc AS MATERIALIZED (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS node FROM lineitem), {SEEDS_SQL},
near AS MATERIALIZED (SELECT DISTINCT chunk FROM inc JOIN s USING (node)),
k AS MATERIALIZED (SELECT node FROM s UNION SELECT node FROM inc JOIN near USING (chunk)),
kin AS MATERIALIZED (SELECT chunk, node FROM inc JOIN k USING (node))
SELECT DISTINCT a.node AS u, b.node AS v FROM kin a JOIN kin b ON a.chunk = b.chunk AND a.node < b.node
""")
def kg_subgraph(spark, base):
    """Edges induced by the seeds and their direct neighbours."""
    inc = _inc(spark, base)
    keep = graph.hops(inc, _seeds(spark, base), 1).select("node")
    return graph.pairs(inc.join(keep, "node", "left_semi")).select("u", "v").distinct()


@query("kg_modularity", f"""
WITH {INC}, m AS (SELECT count(*)::DOUBLE AS m FROM und),
t AS (SELECT s.p_type AS cu, t.p_type AS cv FROM und JOIN part s ON s.p_partkey = u JOIN part t ON t.p_partkey = v),
h AS (SELECT cu AS c, CASE WHEN cu = cv THEN 1 ELSE 0 END AS i FROM t UNION ALL SELECT cv, 0 FROM t),
p AS (SELECT c, count(*) AS d, sum(i) AS i FROM h GROUP BY 1)
SELECT round(sum(i / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM p, m
""")
def kg_modularity(spark, base):
    """Modularity of the partition by entity type."""
    edges = durable(graph.pairs(_inc(spark, base)).select("u", "v").distinct())
    member = _parts(spark, base).select("node", F.col("p_type").alias("cid"))
    return graph.modularity(edges, member).withColumn("modularity", F.round("modularity", 6))


@query("kg_communities")
def kg_communities(spark, base):
    """Modularity communities of the co-occurrence graph with their sizes."""
    edges = durable(graph.pairs(_inc(spark, base)).select("u", "v").distinct())
    return graph.communities(edges).groupBy("cid").agg(F.count(F.lit(1)).alias("size"))


@query("kg_label_propagation")
def kg_label_propagation(spark, base):
    """Majority-label communities of suppliers, nations and regions."""
    return graph.label_propagation(_places(spark, base)).groupBy("cid").agg(F.count(F.lit(1)).alias("size"))


def _places(spark, base):
    sup = table(spark, base, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("u"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("v"))
    nat = table(spark, base, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("u"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("v"))
    return sup.unionByName(nat)


@query("kg_betweenness", f"""
WITH RECURSIVE {PLACES}, d AS (SELECT u AS a, v AS b FROM e UNION ALL SELECT v, u FROM e),
w AS (SELECT a AS s, a AS t, 0 AS k, '' AS prev FROM (SELECT DISTINCT a FROM d)
      UNION ALL SELECT w.s, d.b, w.k + 1, w.t FROM w JOIN d ON d.a = w.t AND d.b <> w.prev),
n AS (SELECT count(DISTINCT a) AS n FROM d),
x AS (SELECT v.t AS node, count(*) AS c FROM w st JOIN w v ON v.s = st.s JOIN w vt ON vt.s = v.t AND vt.t = st.t
      WHERE v.t <> st.s AND v.t <> st.t AND v.k + vt.k = st.k GROUP BY 1)
SELECT a AS node, round(coalesce(c, 0) / ((n - 1) * (n - 2))::DOUBLE, 6) AS betweenness
FROM (SELECT DISTINCT a FROM d) LEFT JOIN x ON node = a, n
""")
def kg_betweenness(spark, base):
    """Bridges of the supplier-nation-region graph."""
    return graph.betweenness(_places(spark, base)).select("node", F.round("betweenness", 6).alias("betweenness"))


MEMBER = """
nod AS (SELECT p_brand AS cid, p_partkey AS node, p_type AS node_type, p_name AS evidence, s_name AS source_paper
 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
"""


def _members(spark, base):
    """Brands as communities; every (entity, supplier) occurrence as a node row."""
    occ = table(spark, base, "lineitem").select(F.col("l_partkey").alias("node"), "l_suppkey").distinct()
    sup = table(spark, base, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("source_paper"))
    return occ.join(_parts(spark, base), "node").join(sup, "l_suppkey").select(
        F.col("p_brand").alias("cid"), "node", F.col("p_type").alias("node_type"),
        F.col("p_name").alias("evidence"), "source_paper")


@query("community_papers", f"""
WITH {MEMBER}, p AS (SELECT DISTINCT cid, source_paper FROM nod),
t AS (SELECT cid, string_agg(source_paper, ', ' ORDER BY source_paper) AS top_papers FROM
      (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY source_paper) AS r FROM p) WHERE r <= 10 GROUP BY 1)
SELECT cid, count(*) AS n_entities, (SELECT count(*) FROM p WHERE p.cid = nod.cid) AS n_papers,
 string_agg(DISTINCT node_type, ', ' ORDER BY node_type) AS entity_types, any_value(top_papers) AS top_papers
FROM nod JOIN t USING (cid) GROUP BY cid
""")
def community_papers(spark, base):
    rows = _members(spark, base)
    return graph.community_digest(
        rows.select("cid", F.concat_ws("/", F.col("node").cast("string"), "source_paper").alias("node")),
        rows.select(F.concat_ws("/", F.col("node").cast("string"), "source_paper").alias("node"), "node_type", "source_paper"))


@query("disclosure_map", f"WITH {MEMBER} SELECT DISTINCT source_paper AS paper, cid FROM nod")
def disclosure_map(spark, base):
    """Paper to community links (third tier)."""
    return _members(spark, base).select(F.col("source_paper").alias("paper"), "cid").distinct()


@query("community_detail", f"""
WITH {MEMBER}, d AS (SELECT DISTINCT cid, node, node_type, evidence FROM nod)
SELECT cid, node, node_type, evidence, r AS rank FROM (SELECT *, row_number() OVER
 (PARTITION BY cid ORDER BY length(evidence) DESC, node) AS r FROM d) WHERE r <= 15
""")
def community_detail(spark, base):
    """Fifteen entities with the longest evidence per community (second tier)."""
    ent = _members(spark, base).select("cid", "node", "node_type", "evidence").distinct()
    order = Window.partitionBy("cid").orderBy(F.desc(F.length("evidence")), F.asc("node"))
    return ent.withColumn("rank", F.row_number().over(order)).filter("rank <= 15").withColumn("rank", F.col("rank").cast("long"))


@query("paper_entities", f"""
WITH {MEMBER} SELECT cid, node, node_type FROM nod WHERE source_paper LIKE '%00001%'
""")
def paper_entities(spark, base):
    """All entities of the papers whose name contains a given id."""
    return _members(spark, base).filter(F.contains("source_paper", F.lit("00001"))).select("cid", "node", "node_type")


@query("entity_pivot", """
SELECT s_name AS paper, count(*) FILTER (p_type = 'ECONOMY') AS economy, count(*) FILTER (p_type = 'LARGE') AS large,
 count(*) FILTER (p_type = 'MEDIUM') AS medium, count(*) FILTER (p_type = 'PROMO') AS promo,
 count(*) FILTER (p_type = 'SMALL') AS small, count(*) FILTER (p_type = 'STANDARD') AS standard
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1
""")
def entity_pivot(spark, base):
    """Entity counts per paper and category as a wide table."""
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    # Fold to (paper, entity) before the joins: the fact table meets the dimensions pre-aggregated.
    li = table(spark, base, "lineitem").groupBy("l_suppkey", F.col("l_partkey").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    sup = table(spark, base, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("paper"))
    rows = li.join(_parts(spark, base), "node").join(sup, "l_suppkey")
    return rows.groupBy("paper").agg(*[
        F.coalesce(F.sum(F.when(F.col("p_type") == k, F.col("n"))), F.lit(0)).alias(k.lower()) for k in kinds])


@query("community_terms", f"""
WITH {MEMBER}, d AS (SELECT DISTINCT cid, node, node_type, evidence FROM nod),
t AS (SELECT cid, node_type, count(*) AS n FROM d GROUP BY 1, 2),
dom AS (SELECT cid, node_type FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY n DESC, node_type) AS r FROM t) WHERE r = 1),
w AS (SELECT cid, term, count(*) AS n FROM (SELECT cid, unnest(string_split(evidence, ' ')) AS term FROM d)
      WHERE length(term) > 3 GROUP BY 1, 2),
k AS (SELECT cid, string_agg(term, ', ' ORDER BY n DESC, term) AS terms FROM
      (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY n DESC, term) AS r FROM w) WHERE r <= 3 GROUP BY 1)
SELECT cid, dom.node_type AS dominant_type, terms FROM dom JOIN k USING (cid)
""")
def community_terms(spark, base):
    """Dominant type and three commonest words of each community."""
    ent = _members(spark, base).select("cid", "node", "node_type", "evidence").distinct()
    types = ent.groupBy("cid", "node_type").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("cid").agg(F.min_by("node_type", F.struct(-F.col("n"), "node_type")).alias("dominant_type"))
    words = ent.select("cid", F.explode(F.split("evidence", " ")).alias("term")).filter(F.length("term") > 3) \
        .groupBy("cid", "term").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("cid").orderBy(F.desc("n"), "term")
    top = words.withColumn("r", F.row_number().over(order)).filter("r <= 3").groupBy("cid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda s: s["term"]), ", ").alias("terms"))
    return types.join(top, "cid")
