"""Lexical, dense and hybrid retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeweave.operators import dense, fusion, hybrid, sparse
from citeweave.operators.lexical_index import LexicalIndex
from citeweave.plans import ansi as A
from citeweave.plans.registry import query
from citeweave.session import shared_dir
from citeweave.sources.tables import table

# BM25 over all documents and all questions, zero-score padding included.
BM25 = f"""
toks AS (SELECT doc_id, {A.words('text')} AS w FROM documents),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avglen FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, tot GROUP BY term, n),
fl AS (SELECT 0.25 * avg(idf) AS floor FROM raw),
idf AS (SELECT term, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM raw, fl),
q AS (SELECT item_id, term, count(*) AS qtf FROM
      (SELECT item_id, unnest({A.words('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avglen))) AS score
       FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN toks USING (doc_id), tot GROUP BY 1, 2),
allsc AS (SELECT b.item_id, d.doc_id, coalesce(sc.score, 0) AS score FROM benchmark b CROSS JOIN documents d
          LEFT JOIN sc ON sc.item_id = b.item_id AND sc.doc_id = d.doc_id),
lex AS (SELECT item_id, doc_id, score, row_number() OVER
        (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM allsc)
"""
# Question vectors: the stored vector with the question's id.
DENSE_ALL = """
dist AS (SELECT b.item_id, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS dist
         FROM benchmark b JOIN embeddings p ON p.vec_id = b.item_id CROSS JOIN embeddings e),
den AS (SELECT item_id, vec_id, dist, row_number() OVER
        (PARTITION BY item_id ORDER BY round(dist, 9), vec_id) AS rank FROM dist)
"""
# Vectors of documents alone, ranked after the rest is left out.
DENSE = DENSE_ALL.replace("CROSS JOIN embeddings e)", "CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) e)")
RRF = """
fused0 AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000000 + rank) AS seen FROM
   (SELECT item_id, vec_id AS doc_id, rank, 0 AS l FROM den WHERE rank <= {n} {cut}
    UNION ALL SELECT item_id, doc_id, rank, 1 AS l FROM lex WHERE rank <= {n}) GROUP BY 1, 2),
fused AS (SELECT item_id, doc_id, score, row_number() OVER
          (PARTITION BY item_id ORDER BY round(score, 12) DESC, seen) AS rank FROM fused0)
"""
KIND = "CASE WHEN source IN ('src1', 'src2') THEN 'reference' WHEN source IN ('src3', 'src4') THEN 'figure' ELSE 'text' END"


def _kind():
    """Document sources stand in for chunk types."""
    return (
        F.when(F.col("source").isin("src1", "src2"), "reference")
        .when(F.col("source").isin("src3", "src4"), "figure").otherwise("text")
    )


def _docs(spark, base):
    return table(spark, base, "documents", spread="doc_id").select("doc_id", "text", "source")


def _questions(spark, base):
    """All questions, with the stored vector of the same id where there is one."""
    vec = table(spark, base, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qvec"))
    return table(spark, base, "benchmark").join(vec, "item_id", "left")


def _asked(spark, base):
    """Questions that have a vector."""
    return _questions(spark, base).filter("qvec is not null")


def _vectors(spark, base):
    """Vectors of documents."""
    return table(spark, base, "embeddings").join(
        table(spark, base, "documents").select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi")


@query("bm25_topk", f"WITH {BM25} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM lex WHERE rank <= 20")
def bm25_topk(spark, base):
    best = sparse.topk(_docs(spark, base), "doc_id", "text", table(spark, base, "benchmark"), "item_id", "text", 20)
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("bm25_stored_index", f"WITH {BM25} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM lex WHERE rank <= 20")
def bm25_stored_index(spark, base):
    """The same search on a stored index that was built from one half of the corpus and extended by the other."""
    docs = _docs(spark, base)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    half = F.col("doc_id") % 2 == 0
    index = LexicalIndex.empty(spark, path).append(docs.filter(half), "doc_id", "text").append(docs.filter(~half), "doc_id", "text")
    best = index.topk(table(spark, base, "benchmark"), "item_id", "text", 20)
    return best.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("bm25_terms", f"""
WITH own AS (SELECT list_distinct({A.words('text')}) AS w FROM documents),
tot AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM own) GROUP BY term),
wt AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM raw, tot),
fl AS (SELECT 0.25 * avg(idf) AS floor FROM wt)
SELECT term, df, round(CASE WHEN idf < 0 THEN floor ELSE idf END, 6) AS idf FROM wt, fl
""")
def bm25_terms(spark, base):
    terms, corpus = sparse.corpus_stats(_docs(spark, base), "doc_id", "text")
    return terms.select("term", "df", F.round(corpus.idf(F.col("df")), 6).alias("idf"))


@query("dense_topk", f"WITH {DENSE_ALL} SELECT item_id, vec_id, round(dist, 6) AS dist, rank FROM den WHERE rank <= 10")
def dense_topk(spark, base):
    near = dense.nearest(
        table(spark, base, "embeddings"), "vec_id", "embedding", _asked(spark, base), "item_id", "qvec", 10)
    return near.select("item_id", "vec_id", F.round("value", 6).alias("dist"), F.col("rank").cast("long"))


@query("rrf_fusion", f"""
WITH {BM25}, {DENSE}, {RRF.format(n=50, cut='')}
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM fused
""")
def rrf_fusion(spark, base):
    qs = _questions(spark, base)
    near = dense.nearest(_vectors(spark, base), "vec_id", "embedding", _asked(spark, base), "item_id", "qvec", 50)
    lex = sparse.topk(_docs(spark, base), "doc_id", "text", qs, "item_id", "text", 50)
    fused = fusion.reciprocal_rank(
        [near.withColumnRenamed("vec_id", "doc_id"), lex], "item_id", "doc_id")
    return fused.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def _shaped(figures: bool) -> str:
    cap, fetch, room = (40, 80, 20) if figures else (20, 50, 20)
    quota = room // 3
    typed = f"""
typed AS (SELECT f.item_id, f.doc_id, f.score, f.rank, CASE WHEN n.vec_id IS NULL THEN '' ELSE {KIND} END AS kind
  FROM fused f JOIN documents USING (doc_id) LEFT JOIN (SELECT * FROM den WHERE rank <= {fetch} AND dist <= 1.3) n
  ON n.item_id = f.item_id AND n.vec_id = f.doc_id WHERE f.rank <= {cap})
"""
    head = f"WITH {BM25}, {DENSE}, {RRF.format(n=fetch, cut='AND dist <= 1.3')}, {typed}"
    if not figures:
        return head + f""" SELECT * FROM (SELECT item_id, doc_id, round(score, 6) AS score, rank,
  row_number() OVER (PARTITION BY item_id ORDER BY rank) AS out_rank FROM typed
  WHERE kind NOT IN ('figure', 'reference')) WHERE out_rank <= {room}"""
    return head + f""", c AS (SELECT *, row_number() OVER (PARTITION BY item_id, kind = 'figure' ORDER BY rank) AS nth,
  least({quota}, count(*) FILTER (kind = 'figure') OVER (PARTITION BY item_id)) AS figs,
  count(*) FILTER (kind <> 'figure') OVER (PARTITION BY item_id) AS texts FROM typed WHERE kind <> 'reference')
 SELECT item_id, doc_id, round(score, 6) AS score, rank,
   CASE WHEN kind = 'figure' THEN least(texts, {room} - figs) + nth ELSE nth END AS out_rank
 FROM c WHERE (kind = 'figure' AND nth <= {quota}) OR (kind <> 'figure' AND nth <= {room} - figs)"""


def _hybrid(spark, base, figures: bool):
    out = hybrid.retrieve(
        _docs(spark, base).withColumn("kind", _kind()), "doc_id", "text", "kind",
        table(spark, base, "embeddings"), "vec_id", "embedding",
        _questions(spark, base), "item_id", "text", "qvec",
        n_results=8 if figures else 5, max_chunks=20, max_distance=1.3, include_figures=figures)
    return out.select("item_id", "doc_id", F.round("score", 6).alias("score"),
                      F.col("rank").cast("long"), F.col("out_rank").cast("long"))


@query("hybrid_retrieve", _shaped(False))
def hybrid_retrieve(spark, base):
    return _hybrid(spark, base, False)


@query("figure_interleave", _shaped(True))
def figure_interleave(spark, base):
    return _hybrid(spark, base, True)
