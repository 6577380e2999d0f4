"""The registered queries of the training-data operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import (
    credentials, factorisation, fim, forest, langid, licenses, lines, logbilinear, mixing, order_minhash, runs, spaced_seeds, tokens)
from citeweave.llm.common import WORD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def documents(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{base}/documents.parquet").select(*columns)


def fold(column: str, parts: int):
    """The remainder of the CRC-32 of an id as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, base: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(
        documents(spark, base, "doc_id", "text"), str(public_tokenizers.path("piece_bpe_32k.model")), limit=4096)


@query("op2_language_id")
def op2_language_id(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base, "doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 3) == 1)
    model = langid.train(docs.filter("not held_out"))
    return langid.identify(docs, model, keep=["held_out"])


@query("op3_mixing", f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(source, '~')), 1, 12))::BIGINT::DOUBLE + 0.5)
        / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, avg(size) AS mean FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at,
    (1.5::DOUBLE * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER o, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(2.0::DOUBLE * source_size, weight * coalesce(max(CASE WHEN level <= full_at THEN level END) OVER (), full_at))::DOUBLE
    AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS base FROM t),
r AS (SELECT *, target - base * source_size AS rest FROM p),
j AS (SELECT d.*, r.* EXCLUDE (source), d.size > r.mean AS long, length(bin(d.size)) AS strength FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
ls AS (SELECT source, coalesce(sum(size) FILTER (long), 0)::BIGINT AS long_size, coalesce(sum(strength * size) FILTER (long), 0)::BIGINT AS long_total,
  coalesce(sum(strength * size) FILTER (NOT long AND size > 0), 0)::BIGINT AS short_total FROM j GROUP BY source),
l AS (SELECT j.*, ls.long_size, ls.long_total, ls.short_total FROM j JOIN ls ON j.source IS NOT DISTINCT FROM ls.source),
pl AS (SELECT *, rest / source_size AS p FROM l WHERE long),
ol AS (SELECT *, CASE WHEN p > 0 THEN least(1.0::DOUBLE, p * (strength * long_size) / long_total) END AS own FROM pl),
dl AS (SELECT *, p > 0 AND sum(size) OVER (PARTITION BY source ORDER BY u / (1 - u) * (1 - own) / own, doc_id, size) - size / 2.0
    <= p * long_size AS drawn FROM ol),
g AS (SELECT source, coalesce(sum(size) FILTER (drawn), 0) AS got FROM dl GROUP BY source),
ps AS (SELECT l.*, greatest(0.0::DOUBLE, least(rest - coalesce(got, 0), (source_size - long_size)::DOUBLE)) AS words
  FROM l LEFT JOIN g ON l.source IS NOT DISTINCT FROM g.source WHERE NOT long AND size > 0),
os AS (SELECT *, CASE WHEN words > 0 THEN least(1.0::DOUBLE, words / (source_size - long_size) * (strength * (source_size - long_size)) / short_total) END AS own FROM ps),
ds AS (SELECT *, words > 0 AND sum(size) OVER (PARTITION BY source ORDER BY u / (1 - u) * (1 - own) / own, doc_id, size) - size / 2.0 <= words AS drawn FROM os),
a AS (SELECT doc_id, size, source_size, target, base + drawn::BIGINT AS copies FROM dl
  UNION ALL SELECT doc_id, size, source_size, target, base + drawn::BIGINT FROM ds
  UNION ALL SELECT doc_id, size, source_size, target, 0 FROM l WHERE size = 0)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM a
""")
def op3_mixing(spark: SparkSession, base: str) -> DataFrame:
    return mixing.take(documents(spark, base, "doc_id", "text", "source"))


@query("op4_order_minhash")
def op4_order_minhash(spark: SparkSession, base: str) -> DataFrame:
    return order_minhash.fingerprints(documents(spark, base, "doc_id", "text"))


@query("op6_lsh_forest")
def op6_lsh_forest(spark: SparkSession, base: str) -> DataFrame:
    return forest.near_duplicates(documents(spark, base, "doc_id", "text"), width=3, percent=85)


@query("op9_fuzzy_lines")
def op9_fuzzy_lines(spark: SparkSession, base: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, base, "doc_id", "text"))


@query("op8_spaced_seeds")
def op8_spaced_seeds(spark: SparkSession, base: str) -> DataFrame:
    return spaced_seeds.contaminated(documents(spark, base, "doc_id", "text"), spark.read.parquet(f"{base}/benchmark.parquet"))


def _found_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, (upto - length(m))::BIGINT AS start, upto::BIGINT AS "end", v FROM (
      SELECT *, sum(length(m) + length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
        SELECT doc_id, source, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM (
          SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{quoted}', 0) AS m,
            regexp_extract_all(coalesce(text, ''), '{quoted}', {group}) AS v,
            string_split_regex(coalesce(text, ''), '{quoted}') AS g FROM documents)))
    WHERE length(v) >= {least}"""


_MIXED_SQL = " AND ".join(f"regexp_matches(v, '{p}')" for p in credentials.MIXED)


@query("op7_secret_scan", f"""
WITH base AS ({" UNION ALL ".join(_found_sql(r, *k) for r, k in enumerate(credentials.BASE))}),
loose AS (SELECT * FROM ({_found_sql(3, *credentials.LOOSE)}) WHERE {_MIXED_SQL}),
al AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
owned AS (SELECT v, count(DISTINCT coalesce(source, '~')) AS n_owners, count(DISTINCT coalesce(doc_id::VARCHAR, '~')) AS n_repos FROM al GROUP BY v),
told AS (SELECT v, n_owners >= {credentials.WIDE} OR n_repos >= {credentials.MANY} AS shared, n_owners = 1 AND n_repos < {credentials.MANY} AS live FROM owned),
shown AS (SELECT al.*, shared, live FROM al JOIN told USING (v) WHERE kind <> 'loose' OR (live AND NOT EXISTS (
  SELECT 1 FROM base b WHERE b.doc_id = al.doc_id AND b.start < al."end" AND al.start < b."end"))),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (kind <> 'loose') AS base_spans,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans,
  count(*) FILTER (kind = 'loose') AS n_loose, count(*) FILTER (shared) AS n_shared,
  count(*) FILTER (live) AS n_live FROM shown GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_loose, 0) AS n_loose,
  coalesce(n_shared, 0) AS n_shared, coalesce(n_live, 0) AS n_live
FROM documents LEFT JOIN agg USING (doc_id)
""")
def op7_secret_scan(spark: SparkSession, base: str) -> DataFrame:
    return credentials.scan(documents(spark, base, "doc_id", "text", "source"))


@query("op5_log_bilinear")
def op5_log_bilinear(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base, "doc_id", "text").withColumn("held_out", fold("doc_id", 7) == 2)
    return logbilinear.scores(docs, "held_out")


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, base: str) -> DataFrame:
    return licenses.scan(documents(spark, base, "doc_id", "text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, base: str) -> DataFrame:
    """The texts of one id in ten are first made periodic from a drawn word on, as the contract has it."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    a, p, n = F.col("a").cast("int"), F.col("p").cast("int"), F.size("words")
    drawn = documents(spark, base, "doc_id", "text").withColumn("h", h).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    drawn = drawn.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(n > 0, F.col("g") % n))
    drawn = drawn.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.concat_ws(" ", F.slice("words", F.lit(1), a), F.slice(again, F.lit(1), n - a))
    found = runs.periodic_runs(drawn.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(periodic).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_quality")
def op12_quality(spark: SparkSession, base: str) -> DataFrame:
    docs = documents(spark, base, "doc_id", "text", "n_chars").withColumn("held_out", fold("doc_id", 5) == 0)
    labels = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "quality").filter(fold("doc_id", 5) != 0)
    machine = factorisation.fit(docs.filter("not held_out"), labels, metadata=("n_chars",))
    return factorisation.score(docs, machine, metadata=("n_chars",), keep=["held_out"]).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@query("op13_fill_in_middle")
def op13_fill_in_middle(spark: SparkSession, base: str) -> DataFrame:
    return fim.digests(fim.restore(fim.arrange(documents(spark, base, "doc_id", "text"))))
