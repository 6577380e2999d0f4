"""Redaction at the secure-to-public boundary, audit trail, detector quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import redact as R
from citeweave.functions import text as T
from citeweave.plans import ansi as A
from citeweave.plans.registry import query
from citeweave.sources.tables import table


def _chain(rules, key="doc_id") -> str:
    """One SQL step per rule: replaced text and number of matches."""
    sql = f"r0 AS (SELECT doc_id, source, {A.fold('text')} AS t, 0 AS n FROM documents)"
    for i, r in enumerate(rules):
        p = A.quote(r.pattern)
        sql += (
            f",\nr{i + 1} AS (SELECT doc_id, source, regexp_replace(t, {p}, {A.quote(r.replacement)}, 'g') AS t, "
            f"n + len(regexp_extract_all(t, {p})) AS n FROM r{i})")
    return sql


def _folded(spark, base):
    docs = table(spark, base, "documents", spread="doc_id")
    return docs.select("doc_id", "source", T.ascii_fold(F.col("text")).alias("t"))


@query("boundary_scrub", f"""
WITH {_chain(R.BOUNDARY)} SELECT doc_id, t AS clean, CAST(n AS BIGINT) AS n_redactions FROM r{len(R.BOUNDARY)}
""")
def boundary_scrub(spark, base):
    out = R.redact(_folded(spark, base), "t", R.BOUNDARY, "clean", "n")
    return out.select("doc_id", "clean", F.col("n").cast("long").alias("n_redactions"))


@query("site_pattern_scrub", f"""
WITH {_chain(R.BOUNDARY + R.SITE)} SELECT doc_id, t AS clean, CAST(n AS BIGINT) AS n_redactions
FROM r{len(R.BOUNDARY + R.SITE)}
""")
def site_pattern_scrub(spark, base):
    out = R.redact(_folded(spark, base), "t", R.BOUNDARY + R.SITE, "clean", "n")
    return out.select("doc_id", "clean", F.col("n").cast("long").alias("n_redactions"))


# Lines of a pattern file: a comment, a blank line, and patterns without and with digits.
CUSTOM_LINES = ["# names that stay inside", "", "  ", r"\bLicensed\b", r"\bpassword=\S+", r"[Rr]eleased under", r"\bversion \d\b"]
CUSTOM = R.BOUNDARY + R.custom_rules(CUSTOM_LINES)


@query("custom_pattern_scrub", f"""
WITH {_chain(CUSTOM)} SELECT doc_id, t AS clean, CAST(n AS BIGINT) AS n_redactions FROM r{len(CUSTOM)}
""")
def custom_pattern_scrub(spark, base):
    out = R.redact(_folded(spark, base), "t", CUSTOM, "clean", "n")
    return out.select("doc_id", "clean", F.col("n").cast("long").alias("n_redactions"))


def _per_rule_sql() -> str:
    parts = []
    for i, r in enumerate(R.BOUNDARY):
        parts.append(
            f"SELECT '{r.label}' AS label, CAST(count(*) FILTER (b.n > a.n) AS BIGINT) AS n_docs, "
            f"CAST(sum(b.n - a.n) AS BIGINT) AS n_spans FROM r{i} a JOIN r{i + 1} b USING (doc_id)")
    return " UNION ALL ".join(parts)


@query("redaction_counts", f"WITH {_chain(R.BOUNDARY)} {_per_rule_sql()}")
def redaction_counts(spark, base):
    out = R.redact(_folded(spark, base), "t", R.BOUNDARY, "clean", "n", per_rule=True)
    cols = [f"n_{r.label.lower()}" for r in R.BOUNDARY]
    wide = out.agg(*[F.struct(
        F.lit(r.label).alias("label"), F.count_if(F.col(c) > 0).alias("n_docs"),
        F.sum(c).alias("n_spans")).alias(c) for r, c in zip(R.BOUNDARY, cols)])
    return wide.select(F.inline(F.array(*cols)))


@query("redaction_overlap", f"""
WITH {_chain(R.BOUNDARY)},
s AS (SELECT r0.doc_id, r0.source, r{len(R.BOUNDARY)}.n > 0 AS rx,
      regexp_matches(r0.t, '[A-Z]{{2,}}\\d+|\\d{{4,}}') AS model
      FROM r0 JOIN r{len(R.BOUNDARY)} USING (doc_id))
SELECT source, count(*) FILTER (rx AND model) AS both_layers, count(*) FILTER (rx AND NOT model) AS regex_only,
  count(*) FILTER (model AND NOT rx) AS model_only, count(*) FILTER (NOT rx AND NOT model) AS neither
FROM s GROUP BY source
""")
def redaction_overlap(spark, base):
    """Agreement of the regex layer with a second detector, per category."""
    out = R.redact(_folded(spark, base), "t", R.BOUNDARY, "clean", "n").select(
        "source", (F.col("n") > 0).alias("rx"), F.col("t").rlike(r"[A-Z]{2,}\d+|\d{4,}").alias("model"))
    rx, model = F.col("rx"), F.col("model")
    return out.groupBy("source").agg(
        F.count_if(rx & model).alias("both_layers"), F.count_if(rx & ~model).alias("regex_only"),
        F.count_if(model & ~rx).alias("model_only"), F.count_if(~rx & ~model).alias("neither"))


@query("confusion_matrix", """
SELECT coalesce(d.lang, 'ALL') AS category, count(*) FILTER (toxic = 1 AND quality = 0) AS tp,
  count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 0) AS fp,
  count(*) FILTER (toxic = 0 AND quality = 1) AS tn,
  round(count(*) FILTER (toxic = 1 AND quality = 0)::DOUBLE / greatest(count(*) FILTER (toxic = 1), 1), 6) AS detection_rate,
  round(count(*) FILTER (toxic = 0 AND quality = 0)::DOUBLE / greatest(count(*) FILTER (toxic = 0), 1), 6) AS false_positive_rate
FROM labels JOIN documents d USING (doc_id) GROUP BY GROUPING SETS ((), (d.lang))
""")
def confusion_matrix(spark, base):
    """Low quality as the prediction, toxicity as the truth; per category and in total."""
    joined = table(spark, base, "labels").join(
        table(spark, base, "documents").select("doc_id", "lang"), "doc_id")
    yes, no = F.col("toxic") == 1, F.col("toxic") == 0
    low, good = F.col("quality") == 0, F.col("quality") == 1
    counts = joined.rollup("lang").agg(
        F.count_if(yes & low).alias("tp"), F.count_if(yes & good).alias("fn"),
        F.count_if(no & low).alias("fp"), F.count_if(no & good).alias("tn"),
        F.count_if(yes).alias("pos"), F.count_if(no).alias("neg"))
    return counts.select(
        F.coalesce("lang", F.lit("ALL")).alias("category"), "tp", "fn", "fp", "tn",
        F.round(F.col("tp") / F.greatest("pos", F.lit(1)), 6).alias("detection_rate"),
        F.round(F.col("fp") / F.greatest("neg", F.lit(1)), 6).alias("false_positive_rate"))


@query("audit_recent", """
SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events WHERE json_extract(props, '$.k') IS NOT NULL ORDER BY event_id DESC LIMIT 50
""")
def audit_recent(spark, base):
    """Latest audit events; malformed payloads are skipped."""
    ev = table(spark, base, "events").select(
        "event_id", "event_type", "user_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return ev.filter("k IS NOT NULL").orderBy(F.desc("event_id")).limit(50)


@query("audit_summary", """
SELECT event_type, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS actors,
       substr(sha256(event_type), 1, 16) AS type_digest FROM events GROUP BY 1, 2, 5
""")
def audit_summary(spark, base):
    ev = table(spark, base, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), "user_id")
    return ev.groupBy("event_type", "day").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("actors")
    ).withColumn("type_digest", T.short_digest(F.col("event_type")))
