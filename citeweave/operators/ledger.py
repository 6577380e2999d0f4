"""Claim ledger: identifiers, duplicates, coverage and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import blocked


def entries(texts: DataFrame, keys: list[str], section: str, body: str, carry: list[str] | None = None) -> DataFrame:
    """One row per claim: ``keys, pos, section, claim_text, claim_id, citations``."""
    rows = texts.select(
        *keys, F.col(section).alias("section"), *(carry or []),
        F.posexplode(T.claims(T.ascii_fold(F.col(body)))).alias("pos", "claim_text"))
    return (
        rows.withColumn("pos", F.col("pos").cast("long"))
        .withColumn("claim_id", T.claim_id(F.col("claim_text")))
        .withColumn("citations", T.citations(F.col("claim_text")))
    )


def coverage(ledger: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Totals and per-section counts (grouping sets) with citation coverage.

    ``ledger`` needs ``section, claim_id, citations, grounded``. Copies of a claim
    are folded before the distinct counts, so one frequent claim is one row.
    """
    ids = ledger.groupBy("section", "claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("grounded")).alias("bad"))
    claims = ids.rollup("section").agg(
        F.sum("n").alias("total_claims"), F.countDistinct("claim_id").alias("unique_claims"),
        F.sum("bad").alias("ungrounded"))
    used = ledger.select("section", F.explode("citations").alias("cite")).distinct()
    have = available.select(F.col(key).alias("cite")).distinct().withColumn("_known", F.lit(1))
    total = have.count()
    cited = used.join(have, "cite", "left").rollup("section").agg(
        F.countDistinct("cite").alias("unique_citations"),
        F.countDistinct(F.when(F.col("_known") == 1, F.col("cite"))).alias("_met"))
    joined = claims.join(cited, claims["section"].eqNullSafe(cited["section"]), "left")
    n_cited = F.coalesce("unique_citations", F.lit(0))
    return joined.select(
        F.coalesce(claims["section"], F.lit("ALL")).alias("section"),
        "total_claims", "unique_claims",
        (F.col("total_claims") - F.col("unique_claims")).alias("duplicate_count"),
        n_cited.alias("unique_citations"), "ungrounded",
        (F.lit(total) - F.coalesce("_met", F.lit(0))).alias("unused_citations"),
        F.round(n_cited / F.greatest(F.lit(total), F.lit(1)), 3).alias("coverage_rate"))


def warnings(ledger: DataFrame, keys: list[str], min_citations: int = 1) -> DataFrame:
    """Too few citations, ungrounded claims, and repeats within a section."""
    order = F.struct(*keys, "pos")
    base = ledger.withColumn("_o", order)
    few = base.filter(F.size("citations") < min_citations).withColumn("kind", F.lit("few_citations"))
    bad = base.filter(~F.col("grounded")).withColumn("kind", F.lit("ungrounded"))
    dup = blocked.later_occurrences(base, ["section", "claim_id"], "_o").withColumn("kind", F.lit("duplicate"))
    cols = [*keys, "pos", "section", "kind", "claim_id"]
    return few.select(*cols).unionByName(bad.select(*cols)).unionByName(dup.select(*cols))


def unseen(candidates: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """Candidates whose claim id the ledger does not hold yet, the first occurrence of each by ``order``."""
    rest = [c for c in candidates.columns if c != "claim_id"]
    first = candidates.groupBy("claim_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_c")).select("claim_id", "_c.*")
    return first.join(ledger.select("claim_id").distinct(), "claim_id", "left_anti").select(candidates.columns)
