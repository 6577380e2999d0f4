"""Whole-question flows over the supplied tables (checked by rows; their parts have SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.plans import flows
from citeweave.plans.registry import query


@query("scoped_context", f"""
WITH scopes AS (SELECT unnest(['public', 'secure', 'both']) AS scope),
have AS (SELECT scope, count(*) AS n FROM scopes JOIN documents ON scope = 'both' OR (scope = 'public') = (lang = 'en')
         WHERE coalesce(source, '') NOT IN ('', 'unknown') GROUP BY scope)
SELECT scope, item_id, least(n, {flows.SURVEY_CHUNKS}) AS n_rows FROM have CROSS JOIN benchmark
""")
def scoped_context(spark, base):
    """Rows of context per scope and question: always as many as asked for, or all there are."""
    corpus, questions, _ = flows.from_tables(spark, base)
    parts = [
        flows.context(corpus, questions, scope, flows.SURVEY_DISTANCE, flows.SURVEY_CHUNKS)
        .groupBy("item_id").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(scope).alias("scope"), "item_id", "n_rows")
        for scope in ("public", "secure", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("deep_answers")
def deep_answers(spark, base):
    corpus, questions, _ = flows.from_tables(spark, base)
    out = flows.deep(corpus, questions, "both")
    return out.scores.join(out.text, "item_id", "left").select(
        "item_id", "n_claims", "n_grounded", F.round("score", 6).alias("score"),
        F.coalesce("text", F.lit("")).alias("text"))


@query("survey_themes")
def survey_themes(spark, base):
    corpus, questions, themes = flows.from_tables(spark, base)
    out = flows.survey(corpus, questions, themes, "both")
    return out.scores.join(out.text, "theme", "left").select(
        "theme", "n_claims", "n_grounded", F.round("score", 6).alias("score"), F.coalesce("text", F.lit("")).alias("text"))


@query("sectioned_answers")
def sectioned_answers(spark, base):
    """Scores and ledger warnings of a sectioned draft: one section for each question."""
    corpus, questions, _ = flows.from_tables(spark, base)
    names = F.array(*map(F.lit, flows.SECTIONS))
    asked = questions.withColumn("section", F.element_at(names, (F.pmod("item_id", F.lit(len(flows.SECTIONS))) + 1).cast("int")))
    out, warnings = flows.sectioned(corpus, asked, "section", "public")
    counts = warnings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_warnings"))
    return out.scores.join(asked.select("item_id", "section"), "item_id").join(counts, "item_id", "left").select(
        "section", "item_id", "n_claims", "n_grounded", F.round("score", 6).alias("score"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))
