"""Assignment of papers to themes and of queries to communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.operators import dense

THEME_MIN = 0.35
ROUTE_MIN, ROUTE_WEAK = 0.35, 0.2


def assign(papers: DataFrame, paper: str, vec: str, themes: DataFrame, theme: str, theme_vec: str,
           minimum: float = THEME_MIN) -> DataFrame:
    """Many-to-many links ``(theme, paper, value)`` by cosine."""
    return dense.within(papers, paper, vec, themes, theme, theme_vec, minimum)


def unassigned(papers: DataFrame, paper: str, links: DataFrame) -> DataFrame:
    """Papers that no theme claimed."""
    return papers.join(links.select(paper), paper, "left_anti")


def route(queries: DataFrame, query_id: str, vec: str, communities: DataFrame, cid: str, cvec: str,
          minimum: float = ROUTE_MIN) -> DataFrame:
    """Relevant communities per query with score, rank and method.

    A query whose best score is weak is flagged for the model-based fallback.
    """
    pairs = dense.routed(queries, query_id, vec, communities, cid, cvec, minimum, ROUTE_WEAK)
    best = pairs.groupBy(query_id).agg(F.max("value").alias("top"))
    flagged = pairs.join(best, query_id).withColumn(
        "method", F.when(F.col("top") < ROUTE_WEAK, "fallback").otherwise("embedding"))
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("value", 9)), F.asc(cid))
    return (
        flagged.filter((F.col("value") >= minimum) | (F.col("method") == "fallback"))
        .withColumn("rank", F.row_number().over(order))
    )
