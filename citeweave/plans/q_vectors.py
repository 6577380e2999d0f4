"""Similarity joins on the supplied vectors (label centroids are the themes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.operators import dense, themes
from citeweave.operators.vector_index import VectorIndex, similar_pairs
from citeweave.plans.q_retrieval import DENSE_ALL
from citeweave.plans.q_streams import folder
from citeweave.plans.registry import query
from citeweave.sources.tables import table

CENTROIDS = """
x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM
      (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2),
cen AS (SELECT label, list(v ORDER BY i) AS centroid FROM x GROUP BY 1)
"""
LINKS = f"""{CENTROIDS},
sim AS (SELECT c.label AS theme, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centroid) AS value
        FROM embeddings e CROSS JOIN cen c)
"""


def _vectors(spark, base):
    return table(spark, base, "embeddings")


def _themes(spark, base):
    return dense.centroids(_vectors(spark, base), "label", "embedding").withColumnRenamed("label", "theme")


def _links(spark, base, minimum=themes.THEME_MIN):
    return themes.assign(_vectors(spark, base), "vec_id", "embedding", _themes(spark, base), "theme", "centroid", minimum)


@query("theme_assign", f"WITH {LINKS} SELECT theme, vec_id, round(value, 6) AS value FROM sim WHERE value >= 0.35")
def theme_assign(spark, base):
    return _links(spark, base).withColumn("value", F.round("value", 6))


@query("theme_unassigned", f"""
WITH {LINKS} SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM sim WHERE value >= 0.35)
""")
def theme_unassigned(spark, base):
    return themes.unassigned(_vectors(spark, base), "vec_id", _links(spark, base)).select("vec_id", "label")


@query("theme_sizes", f"""
WITH {LINKS} SELECT theme, count(*) AS n_papers, round(avg(value), 6) AS mean_value FROM sim WHERE value >= 0.35 GROUP BY 1
""")
def theme_sizes(spark, base):
    return _links(spark, base).groupBy("theme").agg(
        F.count(F.lit(1)).alias("n_papers"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("route_communities", f"""
WITH {LINKS}, m AS (SELECT vec_id, max(value) AS top FROM sim GROUP BY 1),
f AS (SELECT vec_id, theme, value, CASE WHEN top < 0.2 THEN 'fallback' ELSE 'embedding' END AS method FROM sim JOIN m USING (vec_id))
SELECT vec_id, theme, round(value, 4) AS value, method,
 row_number() OVER (PARTITION BY vec_id ORDER BY round(value, 9) DESC, theme) AS rank
FROM f WHERE value >= 0.35 OR method = 'fallback'
""")
def route_communities(spark, base):
    out = themes.route(_vectors(spark, base), "vec_id", "embedding", _themes(spark, base), "theme", "centroid")
    return out.select("vec_id", "theme", F.round("value", 4).alias("value"), "method", F.col("rank").cast("long"))


@query("find_similar", """
WITH p AS (SELECT b.item_id, e.vec_id AS self, CAST(e.embedding AS DOUBLE[]) AS q FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
s AS (SELECT item_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS value FROM p JOIN embeddings ON vec_id <> self)
SELECT item_id, vec_id, round(value, 6) AS value FROM s WHERE value >= 0.3
""")
def find_similar(spark, base):
    """Papers similar to each question's paper, itself left out; the vectors are random, hence the low bound."""
    vecs = _vectors(spark, base)
    seeds = table(spark, base, "benchmark").select("item_id").join(
        vecs.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q")), "item_id")
    hits = dense.within(vecs, "vec_id", "embedding", seeds, "item_id", "q", 0.3)
    return hits.filter("vec_id <> item_id").withColumn("value", F.round("value", 6))


@query("theme_matrix", f"""
WITH {CENTROIDS} SELECT a.label AS theme, b.label AS other, round(list_cosine_similarity(a.centroid, b.centroid), 6) AS value
FROM cen a CROSS JOIN cen b
""")
def theme_matrix(spark, base):
    """Cosine of every theme with every theme."""
    th = _themes(spark, base)
    probes = th.select(F.col("theme").alias("other"), F.col("centroid").alias("c2"))
    return dense.within(th, "theme", "centroid", probes, "other", "c2", -2.0).withColumn("value", F.round("value", 6))


def _probes(spark, base):
    return table(spark, base, "benchmark").select("item_id").join(
        _vectors(spark, base).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q")), "item_id")


@query("index_nearest", f"WITH {DENSE_ALL} SELECT item_id, vec_id, round(dist, 6) AS dist, rank FROM den WHERE rank <= 10")
def index_nearest(spark, base):
    """Nearest vectors of each question's vector, from the stored index."""
    index = VectorIndex.build(_vectors(spark, base), "vec_id", "embedding", folder(spark))
    return index.nearest(_probes(spark, base), "item_id", "q", 10).select(
        F.col("probe").alias("item_id"), F.col("item").alias("vec_id"), F.round("distance", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


UNITS = """
n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
k AS (SELECT v, min(vec_id) AS class FROM n WHERE list_inner_product(v, v) > 0 GROUP BY v)
"""


@query("index_pairs", f"""
WITH {UNITS} SELECT a.class AS a, b.class AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine
FROM k a JOIN k b ON a.class < b.class AND list_cosine_similarity(a.v, b.v) >= 0.35
""")
def index_pairs(spark, base):
    """All pairs of different vectors with a cosine of at least 0.35."""
    pairs, _ = similar_pairs(_vectors(spark, base), "vec_id", "embedding", 0.35, folder(spark))
    return pairs.withColumn("cosine", F.round("cosine", 6))


@query("index_classes", f"WITH {UNITS} SELECT vec_id AS item, class FROM n JOIN k USING (v)")
def index_classes(spark, base):
    """The class of equal vectors that each vector belongs to."""
    return similar_pairs(_vectors(spark, base), "vec_id", "embedding", 0.35, folder(spark))[1]
