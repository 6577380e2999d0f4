"""Event-time windows, joins by time, and keyed stream state, over events that arrive in four batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeweave.operators import temporal
from citeweave.plans import q_state
from citeweave.plans.registry import query, sql_of
from citeweave.session import shared_dir
from citeweave.sources.tables import table
from citeweave.streaming import supervision, windows

#: Events arrive by slices of eight days; some of a slice's last 36 hours and of its first four days come a slice late.
DELAY = "2 DAYS"
LAST = 3
ARRIVALS = f"""
a AS (SELECT *, least({LAST}, floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 691200000000))::INT AS slice FROM events),
b AS (SELECT *, slice + CASE WHEN slice < {LAST} AND ((event_id % 5 = 0 AND ts >= TIMESTAMP '2024-01-01' + (slice + 1) * INTERVAL 8 DAY - INTERVAL 36 HOUR)
  OR (event_id % 11 = 0 AND ts < TIMESTAMP '2024-01-01' + slice * INTERVAL 8 DAY + INTERVAL 4 DAY)) THEN 1 ELSE 0 END AS arrival,
  floor(value * 1000)::BIGINT AS units FROM a),
m AS (SELECT x.arrival, max(b.ts) - INTERVAL 2 DAY AS mark FROM (SELECT DISTINCT arrival FROM b) x LEFT JOIN b ON b.arrival < x.arrival GROUP BY 1),
f AS (SELECT max(ts) - INTERVAL 2 DAY AS sealed FROM b)
"""


def folder(spark) -> str:
    """A new folder in the shared place."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _arrivals(spark, base):
    ev = table(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    day = 86_400_000_000
    since = F.unix_micros("ts") - first
    ev = ev.withColumn("slice", F.least(F.lit(LAST), F.floor(since / (8 * day))).cast("int"))
    late = ((F.col("event_id") % 5 == 0) & (since >= (F.col("slice") + 1) * (8 * day) - 36 * 3_600_000_000)) | (
        (F.col("event_id") % 11 == 0) & (since < F.col("slice") * (8 * day) + 4 * day))
    return ev.withColumn("arrival", F.col("slice") + F.when((F.col("slice") < LAST) & late, 1).otherwise(0)).withColumn(
        "units", F.floor(F.col("value") * 1000).cast("long"))


def _stream(spark, base, key, window):
    """What the stream gives out over four runs, all windows of all rows, and the final watermark."""
    rows = _arrivals(spark, base)
    at = folder(spark)
    make = lambda df: windows.windowed(df, "ts", window, key, [F.sum("units").alias("units")], DELAY)
    batches = [rows.filter(F.col("arrival") == k).select(*key, "ts", "units") for k in range(LAST + 1)]
    on_time = windows.replay(spark, batches, f"{at}/inbox", make, f"{at}/out", f"{at}/state")
    return rows, on_time, make(rows), windows.watermark(rows, "ts", DELAY)


def _fixed_sql(size: str, step: str) -> str:
    return f"""
WITH {ARRIVALS}, w AS (SELECT event_type, ts, units, mark, unnest(range(0, epoch_us({size}), epoch_us({step}))) AS back FROM b JOIN m USING (arrival)),
x AS (SELECT event_type, units, mark, make_timestamp(epoch_us(ts) - epoch_us(ts) % epoch_us({step}) - back) AS s FROM w),
y AS (SELECT *, s + {size} AS e, mark IS NOT NULL AND s + {size} <= mark AS late FROM x)
SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS window_end,
  count(*) FILTER (NOT late) AS n, CAST(coalesce(sum(units) FILTER (NOT late), 0) AS BIGINT) AS units, count(*) FILTER (late) AS late
FROM y, f WHERE e <= sealed GROUP BY event_type, s, e
"""


def _shown(df):
    df = df.withColumn("units", F.coalesce("units", F.lit(0)))
    for c in ("window_start", "window_end"):
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


@query("events_tumbling", _fixed_sql("INTERVAL 1 DAY", "INTERVAL 1 DAY"))
def events_tumbling(spark, base):
    """Events of a type by day, as a stream closes the days; rows behind the watermark are counted apart."""
    _, on_time, every, sealed = _stream(spark, base, ["event_type"], windows.tumbling("ts", "1 day"))
    return _shown(windows.with_late(every, on_time, ["event_type"], sealed))


@query("events_sliding", _fixed_sql("INTERVAL 12 HOUR", "INTERVAL 3 HOUR"))
def events_sliding(spark, base):
    """Windows of twelve hours that begin every three."""
    _, on_time, every, sealed = _stream(spark, base, ["event_type"], windows.sliding("ts", "12 hours", "3 hours"))
    return _shown(windows.with_late(every, on_time, ["event_type"], sealed))


@query("events_sessions", f"""
WITH {ARRIVALS}, t AS (SELECT user_id, ts, units FROM b JOIN m USING (arrival) WHERE mark IS NULL OR ts + INTERVAL 6 HOUR > mark),
g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM t),
h AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
s AS (SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOUR AS end_ts, count(*) AS n, CAST(sum(units) AS BIGINT) AS units FROM h GROUP BY user_id, no)
SELECT user_id, epoch_us(first_ts) AS window_start, epoch_us(end_ts) AS window_end, n, units,
  (SELECT count(*) FROM b WHERE b.user_id = s.user_id AND b.ts >= first_ts AND b.ts <= end_ts) - n AS late
FROM s, f WHERE end_ts <= sealed
""")
def events_sessions(spark, base):
    """A user's sessions, with the rows that fall into them but came when they were closed."""
    rows, closed, _, _ = _stream(spark, base, ["user_id"], windows.session("ts", "6 hours"))
    day = 86_400_000_000
    starts = closed.withColumn("length", F.unix_micros("window_end") - F.unix_micros("window_start"))
    # Sessions of one length class share an interval; a session of k days is looked up day by day.
    days = starts.withColumn("from_ts", F.explode(F.sequence("window_start", "window_end", F.expr("INTERVAL 1 DAY"))))
    inside = temporal.within(
        days.select("user_id", "window_start", "window_end", "from_ts"), rows.select("user_id", "ts"), ["user_id"], "from_ts", "ts", 0, day - 1)
    counts = inside.filter("ts <= window_end").groupBy("user_id", "window_start").agg(F.count(F.lit(1)).alias("rows"))
    return closed.join(counts, ["user_id", "window_start"]).select(
        "user_id", F.unix_micros("window_start").alias("window_start"), F.unix_micros("window_end").alias("window_end"), "n", "units",
        (F.col("rows") - F.col("n")).alias("late"))


@query("events_asof", """
WITH c AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'click'),
p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, coalesce(max_by(c.event_id, (c.ts, c.event_id)), -1) AS click_id,
  coalesce(max_by(c.value, (c.ts, c.event_id)), -1) AS click_value
FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.ts <= p.ts GROUP BY p.event_id, p.user_id
""")
def events_asof(spark, base):
    """Each purchase with the user's latest click up to then; -1 where there is none."""
    ev = table(spark, base, "events").select("user_id", "event_id", "ts", "value", "event_type")
    bought = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = ev.filter("event_type = 'click'").select("user_id", "ts", "event_id", "value", F.col("event_id").alias("id"))
    return temporal.asof(bought, clicks, ["user_id"], "ts", "ts", "event_id", ["id", "value"]).select(
        "event_id", "user_id", F.coalesce("id", F.lit(-1)).alias("click_id"), F.coalesce("value", F.lit(-1.0)).alias("click_value"))


@query("events_interval", """
SELECT e.event_id AS error_id, v.event_id AS view_id, epoch_us(v.ts) - epoch_us(e.ts) AS gap
FROM events e JOIN events v ON e.user_id = v.user_id AND v.ts BETWEEN e.ts - INTERVAL 1 DAY AND e.ts + INTERVAL 12 HOUR
WHERE e.event_type = 'error' AND v.event_type = 'view'
""")
def events_interval(spark, base):
    """The views of a user from a day before to half a day after each error."""
    ev = table(spark, base, "events").select("user_id", "event_id", "ts", "event_type")
    errors = ev.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    views = ev.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts"))
    pairs = temporal.within(errors, views, ["user_id"], "error_ts", "view_ts", 86_400_000_000, 43_200_000_000)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return pairs.select("error_id", "view_id", (micros("view_ts") - micros("error_ts")).alias("gap"))


def _calibrated(spark, base, key):
    """The latest calibration of each model, after its waves came in four batches."""
    waves = q_state._waves(spark, base).select(
        F.col(key).cast("string").alias("model"), F.col("event_id").alias("wave"), F.coalesce("chunk_tokens", F.lit(0)).alias("chunk_tokens"),
        "output_tokens", "total", "passed")
    last = (waves.agg(F.max("wave")).first()[0] or 0) + 1
    supervision.state_store(spark)
    at = folder(spark)
    batches = [waves.filter(F.floor(F.col("wave") * 4 / last) == k) for k in range(4)]
    out = windows.replay(spark, batches, f"{at}/inbox", supervision.calibrate, f"{at}/out", f"{at}/state")
    return out.groupBy("model").agg(F.max_by(F.struct("output_ratio", "boundary_lower", "boundary_upper"), "waves").alias("v"))


@query("stream_ema_ratio", sql_of("ema_ratio"))
def stream_ema_ratio(spark, base):
    """``ema_ratio`` from keyed stream state."""
    return _calibrated(spark, base, "event_type").select(
        F.col("model").alias("event_type"), F.round("v.output_ratio", 6).alias("output_ratio"))


@query("stream_boundary", sql_of("boundary_fold"))
def stream_boundary(spark, base):
    """``boundary_fold`` from keyed stream state."""
    return _calibrated(spark, base, "user_id").select(
        F.col("model").cast("long").alias("user_id"), F.col("v.boundary_lower").alias("boundary_lower"),
        F.col("v.boundary_upper").alias("boundary_upper"))


@query("stream_supervision")
def stream_supervision(spark, base):
    """Every document as the output of a model, token by token; every third token comes a batch late."""
    docs = table(spark, base, "documents", spread="doc_id").filter("text IS NOT NULL")
    tokens = docs.select(
        F.col("doc_id").cast("string").alias("stream_id"),
        F.posexplode(F.regexp_extract_all("text", F.lit(r"\s+|[^\s]+"), F.lit(0))).alias("seq", "token")).withColumn("seq", F.col("seq").cast("long"))
    supervision.state_store(spark)
    at = folder(spark)
    batches = [tokens.filter((F.col("seq") % 3 == 1) == late) for late in (False, True)]
    out = windows.replay(spark, batches, f"{at}/inbox", supervision.supervise, f"{at}/out", f"{at}/state")
    last = out.groupBy("stream_id").agg(F.max_by(F.struct("seen", "degraded", "stopped_at", "waiting"), F.struct("seen", -F.col("waiting"))).alias("v"))
    return last.select(F.col("stream_id").cast("long").alias("doc_id"), "v.seen", "v.degraded", "v.stopped_at", "v.waiting")
