"""Budgets, folds, cache state and daemon bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import blocked, budget, keyed
from citeweave.plans import ansi as A
from citeweave.plans.q_chunks import LINES
from citeweave.plans.registry import query
from citeweave.sources.tables import table

TOKENS = r"len(regexp_extract_all({t}, '\w+|[^\w\s]+'))"


def _span(df, order: str) -> int:
    """Largest ordering key, read from parquet footers where possible."""
    return df.agg(F.max(order)).first()[0] or 0


@query("fit_context", f"""
WITH t AS (SELECT source, doc_id, {TOKENS.format(t=A.fold('text'))} AS tokens FROM documents),
r AS (SELECT *, row_number() OVER w - 1 AS pos, CAST(sum(tokens) OVER w AS BIGINT) AS used_tokens FROM t
      WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, tokens, pos, used_tokens FROM r WHERE used_tokens <= 2734 OR pos = 0
""")
def fit_context(spark, base):
    docs = table(spark, base, "documents", spread="doc_id")
    sized = docs.select("source", "doc_id", T.token_estimate(T.ascii_fold(F.col("text"))).alias("n"))
    # Both passes of the running sum read this narrow exchange.
    sized = sized.repartition("doc_id")
    return budget.fit(sized, ["source"], "doc_id", F.col("n"), 8192).drop("n")


@query("pack_batches", f"""
WITH RECURSIVE l AS (SELECT doc_id, source, list_transform({LINES}, lambda p: {A.fold('p')}) AS t FROM documents),
s AS (SELECT doc_id, i AS chunk_index, {TOKENS.format(t="('[Chunk ' || i || ' | ' || source || '] ' || " + A.squash('t[i + 1]') + ")")} AS tokens
      FROM (SELECT doc_id, source, t, unnest(range(len(t))) AS i FROM l)),
p AS (SELECT doc_id, chunk_index, tokens, 0 AS batch, tokens AS used FROM s WHERE chunk_index = 0
  UNION ALL SELECT s.doc_id, s.chunk_index, s.tokens,
    p.batch + CASE WHEN p.used > 0 AND p.used + s.tokens > 200 THEN 1 ELSE 0 END,
    CASE WHEN p.used > 0 AND p.used + s.tokens > 200 THEN s.tokens ELSE p.used + s.tokens END
  FROM p JOIN s ON s.doc_id = p.doc_id AND s.chunk_index = p.chunk_index + 1)
SELECT doc_id, chunk_index, tokens, CAST(batch AS BIGINT) AS batch FROM p
""")
def pack_batches(spark, base):
    docs = table(spark, base, "documents", spread="doc_id")
    out = budget.pack_papers(docs, "doc_id", "text", "source", 200)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_index", "tokens", "batch")])


WAVES = """
w AS (SELECT event_type, user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS chunk_tokens,
      CAST(floor(value) AS BIGINT) AS output_tokens, CAST(floor(value * 1000) AS BIGINT) AS total,
      event_type <> 'error' AS passed FROM events)
"""


def _waves(spark, base):
    """Events stand in for extraction waves."""
    return table(spark, base, "events").select(
        "event_type", "user_id", "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("chunk_tokens"),
        F.floor("value").cast("long").alias("output_tokens"),
        F.floor(F.col("value") * 1000).cast("long").alias("total"),
        (F.col("event_type") != "error").alias("passed"))


@query("ema_ratio", f"""
WITH {WAVES}, v AS (SELECT event_type, event_id, output_tokens / greatest(chunk_tokens, 1)::DOUBLE AS x,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS later
  FROM w WHERE chunk_tokens > 0 AND output_tokens > 0)
SELECT event_type, round(0.5 * pow(0.8, count(*)) + sum(0.2 * x * pow(0.8, later)), 6) AS output_ratio FROM v GROUP BY 1
""")
def ema_ratio(spark, base):
    waves = _waves(spark, base)
    out = budget.output_ratio(waves, ["event_type"], "event_id", "chunk_tokens", "output_tokens", _span(waves, "event_id"))
    return out.withColumn("output_ratio", F.round("output_ratio", 6))


@query("boundary_fold", f"""
WITH RECURSIVE {WAVES}, o AS (SELECT user_id, total, passed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM w),
f AS (SELECT user_id, 0::BIGINT AS n, 8000::BIGINT AS lo, 16384::BIGINT AS hi FROM (SELECT DISTINCT user_id FROM o)
  UNION ALL SELECT f.user_id, o.n,
   CASE WHEN passed THEN greatest(lo, total) WHEN lo > least(hi, total) THEN least(hi, total) ELSE lo END,
   CASE WHEN NOT passed THEN least(hi, total) WHEN greatest(lo, total) > hi THEN greatest(lo, total) ELSE hi END
  FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, max_by(lo, n) AS boundary_lower, max_by(hi, n) AS boundary_upper FROM f GROUP BY user_id
""")
def boundary_fold(spark, base):
    waves = _waves(spark, base)
    return budget.boundary(waves, ["user_id"], "event_id", "total", "passed", _span(waves, "event_id"))


@query("chunk_budgets", f"""
WITH {WAVES}, m AS (SELECT user_id, avg(output_tokens / greatest(chunk_tokens, 1)::DOUBLE) AS ratio, max(total) AS lower,
  count(*) * 10 AS sys FROM w GROUP BY 1),
a AS (SELECT user_id, ratio, lower * 0.95::DOUBLE - sys - 350 AS room FROM m)
SELECT user_id, greatest(100, least(6000, CAST(floor(CASE WHEN room <= 0 THEN 500 ELSE room END / (1 + round(ratio, 6))) AS BIGINT))) AS budget FROM a
""")
def chunk_budgets(spark, base):
    stats = _waves(spark, base).groupBy("user_id").agg(
        F.avg(F.col("output_tokens") / F.greatest("chunk_tokens", F.lit(1))).alias("ratio"),
        F.max("total").alias("lower"), (F.count(F.lit(1)) * 10).alias("sys"))
    return stats.select("user_id", budget.chunk_budget(
        F.round("ratio", 6), F.col("lower"), F.col("sys"), 6000).alias("budget"))


@query("repeat_runs", """
WITH f AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS chg
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY event_id) AS run_no FROM f)
SELECT user_id, event_type, min(event_id) AS run_start, max(event_id) AS run_end, count(*) AS run_length
FROM g GROUP BY user_id, run_no, event_type HAVING count(*) >= 3
""")
def repeat_runs(spark, base):
    """Three or more equal outputs in a row are the sign of a looping model."""
    out = blocked.runs(table(spark, base, "events"), ["user_id"], "event_id", "event_type")
    return out.filter("run_length >= 3").drop("run_no")


@query("bad_chunks", """
SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS chunk, count(*) AS failures
FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 3
""")
def bad_chunks(spark, base):
    """Chunks that failed three times are set apart."""
    ev = table(spark, base, "events").filter("event_type = 'error'")
    return ev.groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("chunk")) \
        .agg(F.count(F.lit(1)).alias("failures")).filter("failures >= 3")


@query("latest_per_key", """
SELECT user_id, event_id, event_type, value FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def latest_per_key(spark, base):
    ev = table(spark, base, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return keyed.latest(ev, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("recent_queries", """
WITH l AS (SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)
SELECT user_id, event_id FROM l ORDER BY ts DESC, event_id DESC LIMIT 5
""")
def recent_queries(spark, base):
    """Five most recent distinct cached queries."""
    ev = table(spark, base, "events").select("user_id", "event_id", "ts")
    return keyed.latest(ev, ["user_id"], ["ts", "event_id"]).orderBy(F.desc("ts"), F.desc("event_id")) \
        .limit(5).select("user_id", "event_id")


@query("ttl_cache_lookup", """
WITH n AS (SELECT max(ts) AS now FROM events),
e AS (SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value, max(ts) AS created FROM events GROUP BY 1, 2)
SELECT user_id, event_type, value, created + INTERVAL 7 DAY >= now AS is_live FROM e, n
""")
def ttl_cache_lookup(spark, base):
    """Upserted cache entries and whether they are still valid (7 days)."""
    ev = table(spark, base, "events").select("user_id", "event_type", "value", "ts", "event_id")
    now = ev.agg(F.max("ts")).first()[0]
    entries = keyed.latest(ev, ["user_id", "event_type"], ["ts", "event_id"])
    return keyed.live(entries, F.col("ts"), "7 DAYS", F.lit(now)).select("user_id", "event_type", "value", "is_live")


@query("cycle_summary", """
SELECT CAST(ts AS DATE)::VARCHAR AS cycle, count(*) FILTER (event_type = 'view') AS papers_fetched,
  count(*) FILTER (event_type = 'purchase') AS papers_ingested, count(*) FILTER (event_type = 'error') AS failures,
  round(sum(value), 4) AS cost FROM events GROUP BY 1
""")
def cycle_summary(spark, base):
    kind = F.col("event_type")
    return table(spark, base, "events").groupBy(F.to_date("ts").cast("string").alias("cycle")).agg(
        F.count_if(kind == "view").alias("papers_fetched"), F.count_if(kind == "purchase").alias("papers_ingested"),
        F.count_if(kind == "error").alias("failures"), F.round(F.sum("value"), 4).alias("cost"))


@query("provider_dedup", """
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, source,
  substr(sha256(lower(text)), 1, 16) AS doi, lower(string_split(text, chr(10))[1]) AS title FROM documents),
s AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS dois, []::VARCHAR[] AS titles, false AS kept
  UNION ALL SELECT d.i,
    CASE WHEN list_contains(dois, d.doi) OR list_contains(titles, d.title) THEN dois ELSE list_append(dois, d.doi) END,
    CASE WHEN list_contains(dois, d.doi) OR list_contains(titles, d.title) OR d.title = '' THEN titles ELSE list_append(titles, d.title) END,
    NOT (list_contains(dois, d.doi) OR list_contains(titles, d.title)) FROM s JOIN d ON d.i = s.i + 1)
SELECT doc_id, source, title FROM s JOIN d USING (i) WHERE kept
""")
def provider_dedup(spark, base):
    """Documents as a merged provider feed: drop on a seen text or a seen title."""
    docs = table(spark, base, "documents", spread="doc_id").select(
        "doc_id", "source", T.short_digest(F.lower("text")).alias("doi"),
        F.lower(F.substring_index("text", "\n", 1)).alias("title"))
    return keyed.first_seen_by_either(docs, "doc_id", "doi", "title").select("doc_id", "source", "title")
