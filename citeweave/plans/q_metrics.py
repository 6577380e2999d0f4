"""Quality metrics, figure scoring, bibliographic coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import bibliography as bib
from citeweave.operators import blocked
from citeweave.operators import figures as fig
from citeweave.operators import metrics as M
from citeweave.plans import ansi as A
from citeweave.plans.registry import query
from citeweave.session import durable
from citeweave.sources.tables import table


def _grade(x: str, ok: float, warn: float) -> str:
    return f"CASE WHEN {x} >= {ok} THEN 'PASS' WHEN {x} >= {warn} THEN 'WARN' ELSE 'FAIL' END"


SCORES = "sc AS (SELECT d.source AS theme, d.lang AS run, avg(quality) AS score, count(*) AS n FROM labels JOIN documents d USING (doc_id) GROUP BY 1, 2)"
THEMES = "th AS (SELECT d.source AS theme, avg(quality) AS score FROM labels JOIN documents d USING (doc_id) GROUP BY 1)"


def _rated(spark, base):
    docs = table(spark, base, "documents").select("doc_id", "source", "lang")
    return table(spark, base, "labels").join(docs, "doc_id")


def _theme_scores(spark, base):
    """Share of good documents per source stands in for a theme's anchoring score."""
    return _rated(spark, base).groupBy(F.col("source").alias("theme")).agg(F.avg("quality").alias("score"))


@query("metric_anchoring_dist", f"""
WITH {THEMES} SELECT round(avg(score), 4) AS mean, round(min(score), 4) AS lowest, round(max(score), 4) AS highest,
 round(coalesce(stddev_samp(score), 0), 4) AS std, count(score) AS n, count(*) FILTER (score < 0.5) AS below,
 round(100.0::DOUBLE * count(*) FILTER (score < 0.5) / count(*), 1) AS below_pct, {_grade('avg(score)', 0.7, 0.5)} AS grade FROM th
""")
def metric_anchoring_dist(spark, base):
    return M.distribution(_theme_scores(spark, base), "score")


@query("debate_rate", f"""
WITH {THEMES} SELECT count(*) AS total_themes, count(*) FILTER (score < 0.5) AS debated_themes,
 round(count(*) FILTER (score < 0.5)::DOUBLE / count(*), 4) AS invocation_rate,
 {_grade('1 - count(*) FILTER (score < 0.5)::DOUBLE / count(*)', 0.7, 0.4)} AS grade FROM th
""")
def debate_rate(spark, base):
    t = _theme_scores(spark, base).agg(
        F.count(F.lit(1)).alias("total_themes"), F.count_if(F.col("score") < 0.5).alias("debated_themes"))
    rate = F.col("debated_themes") / F.col("total_themes")
    return t.withColumn("invocation_rate", F.round(rate, 4)).withColumn("grade", M.grade(1 - rate, 0.7, 0.4))


@query("variance_scorecard", f"""
WITH {SCORES}, r AS (SELECT run, avg(score) AS m, count(*) AS n_themes, sum(n) AS n_claims FROM sc GROUP BY 1),
a AS (SELECT avg(m) AS mm, coalesce(stddev_samp(m), 0) AS sd, min(m) AS lo, max(m) AS hi, count(*) AS n_runs,
 min(n_themes) AS themes_min, max(n_themes) AS themes_max FROM r)
SELECT round(mm, 4) AS mean_of_means, round(sd, 4) AS std_of_means, round(sd / mm, 4) AS cv, round(hi - lo, 4) AS spread,
 n_runs, themes_min, themes_max, CASE WHEN sd / mm < 0.05 THEN 'STABLE' WHEN sd / mm < 0.10 THEN 'MICRO-VARIANCE'
 WHEN sd / mm < 0.20 THEN 'MODERATE-VARIANCE' ELSE 'HIGH-VARIANCE' END AS stability FROM a
""")
def variance_scorecard(spark, base):
    per = _rated(spark, base).groupBy("lang", "source").agg(F.avg("quality").alias("score"))
    runs = per.groupBy("lang").agg(F.avg("score").alias("m"), F.count(F.lit(1)).alias("n"))
    a = runs.agg(
        F.avg("m").alias("mm"), F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("sd"), F.min("m").alias("lo"),
        F.max("m").alias("hi"), F.count(F.lit(1)).alias("n_runs"), F.min("n").alias("themes_min"), F.max("n").alias("themes_max"))
    cv = F.when(F.col("mm") > 0, F.col("sd") / F.col("mm")).otherwise(0.0)
    return a.select(
        F.round("mm", 4).alias("mean_of_means"), F.round("sd", 4).alias("std_of_means"), F.round(cv, 4).alias("cv"),
        F.round(F.col("hi") - F.col("lo"), 4).alias("spread"), "n_runs", "themes_min", "themes_max",
        F.when(cv < 0.05, "STABLE").when(cv < 0.10, "MICRO-VARIANCE").when(cv < 0.20, "MODERATE-VARIANCE")
        .otherwise("HIGH-VARIANCE").alias("stability"))


CLAIMS = f"c AS (SELECT source AS theme, doc_id, pos, item AS claim FROM {A.exploded('documents', 'doc_id, source', A.claims(A.fold('text')))})"


def _claims(spark, base, name="documents", key="doc_id"):
    t = table(spark, base, name, spread=key)
    if "source" not in t.columns:
        t = t.withColumn("source", F.lit("question"))
    return t.select(F.col("source").alias("theme"), key, F.posexplode(T.claims(T.ascii_fold(F.col("text")))).alias("pos", "claim"))


@query("claim_density", f"""
WITH {CLAIMS}, n AS (SELECT theme, count(*) AS claims FROM c GROUP BY 1),
d AS (SELECT source AS theme, CAST(sum(length({A.fold('text')})) AS BIGINT) AS chars FROM documents GROUP BY 1)
SELECT theme, claims, chars, round(chars::DOUBLE / greatest(claims, 1), 2) AS chars_per_claim,
 {_grade('500 / (chars::DOUBLE / greatest(claims, 1))', 0.6, 0.4)} AS grade FROM d JOIN n USING (theme)
""")
def claim_density(spark, base):
    docs = table(spark, base, "documents", spread="doc_id").select("source", T.ascii_fold(F.col("text")).alias("t"))
    agg = docs.groupBy(F.col("source").alias("theme")).agg(
        F.sum(F.size(T.claims(F.col("t")))).alias("claims"), F.sum(F.length("t")).alias("chars"))
    per = F.col("chars") / F.greatest("claims", F.lit(1))
    return agg.select("theme", "claims", "chars", F.round(per, 2).alias("chars_per_claim"), M.grade(500 / per, 0.6, 0.4).alias("grade"))


@query("redundancy", f"""
WITH {CLAIMS}, k AS (SELECT theme, array_to_string(({A.words('lower(claim)')})[1:5], ' ') AS fp FROM c),
g AS (SELECT fp, count(*) AS n, count(DISTINCT theme) - 1 AS again FROM k GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_claims, CAST(sum(again) AS BIGINT) AS redundant_claims, round(sum(again) / sum(n)::DOUBLE, 4) AS redundancy_score,
 {_grade('1 - sum(again) / sum(n)::DOUBLE', 0.8, 0.6)} AS grade FROM g
""")
def redundancy(spark, base):
    return M.redundancy(_claims(spark, base), "theme", "claim")


@query("cross_theme_coverage", f"""
WITH {CLAIMS}, q AS (SELECT string_agg(lower(item), ' ' ORDER BY item_id, pos) AS txt FROM {A.exploded('benchmark', 'item_id', A.claims(A.fold('text')))}),
t AS (SELECT doc_id, pos, {A.words('lower(claim)')} AS w FROM c),
sp AS (SELECT doc_id, pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS span FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
u AS (SELECT DISTINCT span FROM sp WHERE length(span) >= 10),
n AS (SELECT array_to_string({A.words('txt')}, ' ') AS txt FROM q),
h AS (SELECT span FROM u, n WHERE contains(txt, span)),
m AS (SELECT DISTINCT doc_id, pos FROM sp WHERE span IN (SELECT span FROM h))
SELECT (SELECT count(*) FROM c) AS theme_claims, (SELECT count(*) FROM m) AS covered,
 round((SELECT count(*) FROM m)::DOUBLE / (SELECT count(*) FROM c), 4) AS coverage_ratio,
 {_grade('(SELECT count(*) FROM m)::DOUBLE / (SELECT count(*) FROM c)', 0.5, 0.3)} AS grade
""")
def cross_theme_coverage(spark, base):
    """Document claims that reappear in the questions' joint text."""
    mine = durable(_claims(spark, base))
    joint = _joined(spark, base)
    hit = M.span_coverage(mine, ["doc_id", "pos"], "claim", joint, "q").count()
    return mine.agg(F.count(F.lit(1)).alias("theme_claims")).select(
        "theme_claims", F.lit(hit).cast("long").alias("covered"),
        F.round(F.lit(hit) / F.col("theme_claims"), 4).alias("coverage_ratio"),
        M.grade(F.lit(hit) / F.col("theme_claims"), 0.5, 0.3).alias("grade"))


def _joined(spark, base):
    """Windows of the joined question claims: each claim plus the opening words of the next two.

    Three-word spans reach at most two words into what follows, so the joint text
    never has to exist as one value.
    """
    from pyspark.sql import Window

    rows = table(spark, base, "benchmark").select(
        "item_id", F.posexplode(T.claims(T.ascii_fold(F.col("text")))).alias("pos", "c"))
    w = Window.partitionBy("item_id").orderBy("pos")
    firsts = rows.filter("pos = 0").select("item_id", "c")
    # Reading backwards, the next question is the last one before; blocks keep this off a single task.
    back = firsts.withColumn("back", -F.col("item_id"))
    follow = blocked.last_before(back, [], "back", F.col("c"), "after").select("item_id", "after")
    out = rows.join(follow, "item_id").withColumn("nxt", F.coalesce(F.lead("c").over(w), F.col("after"), F.lit("")))
    return out.select(F.concat_ws(" ", "c", F.array_join(F.slice(T.words(F.col("nxt")), 1, 2), " ")).alias("q"))


@query("entity_appearance", f"""
WITH e AS (SELECT DISTINCT unnest({A.lexemes(A.fold('text'))}) AS name FROM benchmark),
w AS (SELECT DISTINCT unnest({A.words('lower(' + A.fold('text') + ')')}) AS w FROM documents)
SELECT (SELECT count(*) FROM e WHERE length(name) > 2) AS total_entities,
 count(DISTINCT name) AS appeared, round(count(DISTINCT name)::DOUBLE / (SELECT count(*) FROM e WHERE length(name) > 2), 4) AS rate,
 {_grade("count(DISTINCT name)::DOUBLE / (SELECT count(*) FROM e WHERE length(name) > 2)", 0.4, 0.2)} AS grade
FROM e JOIN w ON contains(w, name) WHERE length(name) > 2
""")
def entity_appearance(spark, base):
    """Words of the questions that occur inside some document."""
    names = table(spark, base, "benchmark").select(F.explode(T.lexemes(T.ascii_fold(F.col("text")))).alias("name")) \
        .filter(F.length("name") > 2).distinct()
    docs = table(spark, base, "documents", spread="doc_id").select(T.ascii_fold(F.col("text")).alias("t"))
    hit = M.appearing(names, "name", docs, "t").agg(F.count(F.lit(1)).alias("appeared"))
    n = names.count()
    rate = F.col("appeared") / F.lit(n)
    return hit.select(F.lit(n).cast("long").alias("total_entities"), "appeared", F.round(rate, 4).alias("rate"),
                      M.grade(rate, 0.4, 0.2).alias("grade"))


@query("gap_specificity", f"""
WITH q AS (SELECT len({A.words(A.fold('text'))}) AS n FROM benchmark)
SELECT count(*) AS question_count, round(avg(n), 1) AS avg_words, {_grade('30 / greatest(avg(n), 1)', 0.7, 0.5)} AS grade FROM q
""")
def gap_specificity(spark, base):
    q = table(spark, base, "benchmark").select(F.size(T.words(T.ascii_fold(F.col("text")))).alias("n"))
    a = q.agg(F.count(F.lit(1)).alias("question_count"), F.avg("n").alias("m"))
    return a.select("question_count", F.round("m", 1).alias("avg_words"),
                    M.grade(30 / F.greatest("m", F.lit(1)), 0.7, 0.5).alias("grade"))


@query("judge_scores", """
WITH s AS (SELECT event_type, CAST(least(5, floor(value / 8)) AS BIGINT) AS score FROM events)
SELECT score, count(*) AS n, count(DISTINCT event_type) AS kinds FROM s GROUP BY 1
""")
def judge_scores(spark, base):
    """Histogram of judge scores; 0 means the judge gave none."""
    s = table(spark, base, "events").select("event_type", F.least(F.lit(5), F.floor(F.col("value") / 8)).cast("long").alias("score"))
    return s.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"))


@query("judge_calibration", """
WITH s AS (SELECT event_type AS kind, CAST(least(5, floor(value / 8)) AS BIGINT) AS score FROM events)
SELECT kind, bool_and(score BETWEEN 4 AND 5) AS all_true, bool_and(score BETWEEN 1 AND 2) AS all_false,
 bool_and(score BETWEEN 0 AND 5) AS in_range, round(avg(nullif(score, 0)), 4) AS mean_score FROM s GROUP BY 1
""")
def judge_calibration(spark, base):
    s = table(spark, base, "events").select(
        F.col("event_type").alias("kind"), F.least(F.lit(5), F.floor(F.col("value") / 8)).cast("long").alias("score"))
    sc = F.col("score")
    return s.groupBy("kind").agg(
        F.bool_and(sc.between(4, 5)).alias("all_true"), F.bool_and(sc.between(1, 2)).alias("all_false"),
        F.bool_and(sc.between(0, 5)).alias("in_range"), F.round(F.avg(F.nullif(sc, F.lit(0))), 4).alias("mean_score"))


@query("provider_comparison", """
WITH d AS (SELECT CAST(ts AS DATE)::VARCHAR AS day, avg(value) FILTER (event_type = 'view') AS cloud,
 avg(value) FILTER (event_type = 'click') AS local FROM events GROUP BY 1)
SELECT day, round(cloud, 4) AS cloud, round(local, 4) AS local, round(cloud - local, 4) AS delta,
 CASE WHEN abs(cloud - local) <= 0.01 THEN 'tie' WHEN cloud > local THEN 'cloud' ELSE 'local' END AS winner FROM d
""")
def provider_comparison(spark, base):
    d = table(spark, base, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("cloud"),
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("local"))
    delta = F.col("cloud") - F.col("local")
    return d.select("day", F.round("cloud", 4).alias("cloud"), F.round("local", 4).alias("local"), F.round(delta, 4).alias("delta"),
                    F.when(F.abs(delta) <= 0.01, "tie").when(delta > 0, "cloud").otherwise("local").alias("winner"))


FIG_CLASS = {"STANDARD": "bar_chart", "ECONOMY": "line_chart", "MEDIUM": "logo", "PROMO": "photograph", "LARGE": "table", "SMALL": "icon"}
FIG_SQL = f"""
f AS (SELECT p_partkey, p_size * 12 AS w, p_size * 9 AS h, p_size % 5 AS page, p_name, p_type,
 CASE WHEN p_size % 3 = 0 THEN 'Figure ' || p_size || '. ' || p_name WHEN p_size % 3 = 1 THEN p_name ELSE '' END AS caption,
 (p_retailprice % 100) / 100 AS conf,
 CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FIG_CLASS.items())} END AS cls FROM part),
s AS (SELECT *, greatest(0, least(1, conf * (CASE cls {' '.join(f"WHEN '{v}' THEN {fig.WEIGHTS[v]}::DOUBLE" for v in FIG_CLASS.values())} END) + (1 - conf) * 0.3::DOUBLE)) AS c1,
 CASE WHEN w * h < 6400 THEN 0.0::DOUBLE WHEN w * h < 22500 THEN 0.3 WHEN w * h < 40000 THEN 0.6 ELSE 1 END AS c2,
 CASE WHEN caption = '' THEN 0.0::DOUBLE WHEN starts_with(lower(caption), 'figure') THEN 1 WHEN length(caption) > 20 THEN 0.3 ELSE 0.1 END AS c3,
 CASE WHEN page <= 0 THEN 0.5::DOUBLE WHEN page <= 1 THEN 0.6 WHEN page <= 2 THEN 0.8 ELSE 1 END AS c4 FROM f),
g AS (SELECT p_partkey, cls, round(0.65::DOUBLE * c1 + 0.10::DOUBLE * c2 + 0.20::DOUBLE * c3 + 0.05::DOUBLE * c4, 3) AS relevance FROM s)
"""


def _figures(spark, base):
    """Parts as extracted figures: size, page, caption and two class predictions."""
    p = table(spark, base, "part")
    cls = F.create_map(*[F.lit(x) for kv in FIG_CLASS.items() for x in kv])[F.col("p_type")]
    conf = (F.col("p_retailprice") % 100) / 100
    caption = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Figure "), F.col("p_size").cast("string"), F.lit(". "), "p_name")) \
        .when(F.col("p_size") % 3 == 1, F.col("p_name")).otherwise("")
    preds = F.array(
        F.struct(cls.alias("class_name"), conf.alias("confidence")),
        F.struct(F.lit("other").alias("class_name"), (1 - conf).alias("confidence")))
    score = fig.relevance(preds, F.col("p_size") * 12, F.col("p_size") * 9, caption, F.col("p_size") % 5)
    return p.select("p_partkey", fig.top_class(preds).alias("cls"), score.alias("relevance"))


@query("figure_relevance", f"WITH {FIG_SQL.replace(', 3) AS relevance', ', 4) AS relevance')} SELECT p_partkey, cls, relevance FROM g WHERE relevance >= 0.35")
def figure_relevance(spark, base):
    return _figures(spark, base).filter(F.col("relevance") >= fig.THRESHOLD)


@query("figure_stats", f"""
WITH {FIG_SQL.replace(', 3) AS relevance', ', 4) AS relevance')} SELECT cls, count(*) AS n_all, count(*) FILTER (relevance >= 0.35) AS n_kept,
 count(*) FILTER (relevance < 0.35) AS n_discarded, min(relevance) AS lowest, round(avg(relevance), 4) AS mean, max(relevance) AS highest FROM g GROUP BY 1
""")
def figure_stats(spark, base):
    keep = F.col("relevance") >= fig.THRESHOLD
    return _figures(spark, base).groupBy("cls").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_discarded"),
        F.min("relevance").alias("lowest"), F.round(F.avg("relevance"), 4).alias("mean"), F.max("relevance").alias("highest"))


TITLE = "string_split(text, chr(10))[1]"


def _title():
    return F.substring_index("text", "\n", 1)


@query("title_jaccard_match", f"""
WITH l AS (SELECT doc_id, list_distinct({A.words(A.match_key(TITLE))}) AS w FROM documents),
r AS (SELECT item_id, list_distinct({A.words(A.match_key(TITLE))}) AS w FROM benchmark)
SELECT doc_id, item_id, round(len(list_intersect(l.w, r.w))::DOUBLE / len(list_distinct(list_concat(l.w, r.w))), 6) AS jaccard
FROM l, r WHERE len(l.w) > 0 AND len(r.w) > 0
 AND len(list_intersect(l.w, r.w))::DOUBLE / len(list_distinct(list_concat(l.w, r.w))) >= 0.6
""")
def title_jaccard_match(spark, base):
    left = table(spark, base, "documents", spread="doc_id").select("doc_id", _title().alias("title"))
    right = table(spark, base, "benchmark").select("item_id", _title().alias("title"))
    return bib.title_jaccard(left, right, "doc_id", "item_id").withColumn("jaccard", F.round("jaccard", 6))


@query("bibliographic_coverage")
def bibliographic_coverage(spark, base):
    """Documents matched to questions by DOI, cleaned DOI or fuzzy title."""
    doi = F.concat(F.lit("10.5555/"), T.short_digest(F.col("text")))
    left = durable(table(spark, base, "documents", spread="doc_id").select(
        "doc_id", _title().alias("title"),
        F.when(F.col("lang") == "en", F.concat(F.lit("https://doi.org/"), doi)).otherwise(doi).alias("doi")))
    right = table(spark, base, "benchmark").select("item_id", _title().alias("title"), doi.alias("doi"))
    return bib.coverage(bib.match(left, right, "doc_id", "item_id"), left, "doc_id")
