"""Hybrid retrieval: dense list + lexical list -> fused, shaped context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators import dense, fusion, sparse


def retrieve(
    docs: DataFrame, doc_id: str, body: str, kind: str,
    vectors: DataFrame, vec_id: str, vec: str,
    questions: DataFrame, question_id: str, question_body: str, question_vec: str,
    n_results: int = 5, max_chunks: int = 20, max_distance: float | None = None,
    include_figures: bool = False, drop_references: bool = True,
) -> DataFrame:
    """Fused context per question: ``(question_id, doc_id, score, rank, out_rank)``.

    Only vectors of the given documents take part, so documents out of scope hold no
    rank. A question without a vector has its lexical list alone.
    ``n_results`` only sets the fetch size; the result is bounded by ``max_chunks``.
    The distance threshold applies to the dense list alone, and type filters run
    after fusion so that they never change the ranks. Hits known only from the
    lexical list carry no chunk type, hence no type filter applies to them.
    """
    fetch = fusion.fetch_size(n_results, max_chunks, include_figures)
    own = vectors.join(docs.select(F.col(doc_id).alias(vec_id)).distinct(), vec_id, "left_semi")
    near = dense.nearest(
        own, vec_id, vec, questions.filter(F.col(question_vec).isNotNull()), question_id, question_vec, fetch, "l2", max_distance)
    known = docs.select(doc_id, F.col(kind).alias("_kind_in"))
    near = near.withColumnRenamed(vec_id, doc_id) if vec_id != doc_id else near
    lexical = sparse.topk(docs, doc_id, body, questions, question_id, question_body, fetch)
    near = near.select(question_id, doc_id, "rank")
    fused = fusion.reciprocal_rank([near, lexical], question_id, doc_id)
    typed = (
        fused.join(near.select(question_id, doc_id, F.lit(True).alias("_dense")),
                   [question_id, doc_id], "left")
        .join(known, doc_id, "left")
        .withColumn("_kind_out", F.when(F.col("_dense"), F.col("_kind_in")))
    )
    return fusion.shape(typed, question_id, "_kind_out", max_chunks, include_figures, drop_references).select(
        question_id, doc_id, "score", "rank", "out_rank")
