"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates; what tells a live credential from an example is who else
has it. Candidate values are hashed and counted by distinct repositories and
owners over the whole corpus: a value that many owners have is a copied example, one
that a single owner has looks live. Beside the strict patterns there is a loose one
for random-looking words, which is only believed for values that one owner has.

All steps are DataFrame operations: positions come from the lengths of what a
pattern matches and of what lies between, so no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.session import durable

#: Kinds in the order in which spans with equal starts are listed, with pattern, the
#: group that holds the value, and the least length of that group. Fixed values.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The loose pattern: words of 20 or more of these characters that mix upper case, lower case and digits.
LOOSE = ("loose", r"[A-Za-z0-9_-]{20,}", 0, 20)
MIXED = (r"[a-z]", r"[A-Z]", r"[0-9]")
#: A value of so many owners, or in so many repositories, is a copied example.
WIDE = 3
MANY = 10

#: What the counts say of a value.
SHARED, LIVE = "shared", "live"


def found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of ``start, end, value`` of the leftmost matches of a pattern, in code points, end exclusive.

    Matches whose value is shorter than ``least`` are dropped after matching, as they
    take up their stretch of the text all the same. A match begins after all matches
    before it and all the pieces that they leave.
    """
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(match, F.length).alias("m"), F.transform(F.slice(between, 1, F.size(match)), F.length).alias("g"), value.alias("v"))
    walked = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["m"]).alias("at"),
            F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end"), x["v"].alias("value")))))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(pattern_at_least(pattern, least)), walked).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def pattern_at_least(pattern: str, least: int) -> str:
    """A cheap test that no text with a match of the least length fails: the last repeat must be that long."""
    if pattern.startswith("AKIA"):
        return f"AKIA[A-Z0-9]{{{least - 4},}}"
    return pattern[:-1] + f"{{{least},}}" if pattern.endswith("+") else pattern


def tagged(got: Column, rank: int, kind: str) -> Column:
    return F.transform(got, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"),
        F.md5(x["value"].cast("binary")).alias("hash")))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, repo, owner, row, spans``: all candidates of each document with kind, position and value.

    ``spans`` is sorted by start, then by kind as listed.
    """
    kinds = [*BASE, LOOSE]
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        got = found(F.col("text"), pattern, group, least)
        if kind == "loose":
            got = F.filter(got, lambda x: x["value"].rlike(MIXED[0]) & x["value"].rlike(MIXED[1]) & x["value"].rlike(MIXED[2]))
        parts.append(tagged(got, rank, kind))
    return docs.select("doc_id", "repo", "owner", "row", F.array_sort(F.concat(*parts)).alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners``: distinct repositories and owners of each candidate value of the corpus.

    Each distinct (value, repository, owner) comes once out of the first, partial
    aggregation, so a value on a third of all rows is counted in parts. Null counts as
    one repository or owner of its own.
    """
    one = spans.select(F.explode("spans.hash").alias("hash"), "repo", "owner").distinct()
    repos = one.groupBy("hash", "repo").agg(F.lit(1).alias("x")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_repos"))
    owners = one.groupBy("hash", "owner").agg(F.lit(1).alias("x")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return repos.join(owners, "hash")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repo: str = "doc_id", owner: str = "source",
    wide: int = WIDE, many: int = MANY,
) -> DataFrame:
    """Per document: base counts and digest, all spans, and how many spans are copied examples or look live.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_loose, n_shared,
    n_live``. A span is shared if ``wide`` or more owners have its value or if it stands in
    ``many`` or more repositories, be they of one owner; it is live if one owner has it in
    fewer repositories. Between the two it is neither. Loose spans are only listed if live
    and not inside a base span.

    A null text is empty. Repeated rows get equal results and count once as a
    repository; a null id passes through; an empty table gives no rows; other columns
    are ignored.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"),
        F.xxhash64(doc_id, text).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    spans = durable(candidates(rows))
    some = spans.filter(F.size("spans") > 0)
    counts = durable(ownership(some))
    # Copies of a document ask alike: one question per row key. Both sides are tables, so
    # that the adaptive planner can split the questions after a value that very many have.
    asked = durable(some.select("row", F.explode("spans.hash").alias("hash")).distinct())
    shared = (F.col("n_owners") >= wide) | (F.col("n_repos") >= many)
    told = counts.select("hash", F.when(shared, SHARED).when(F.col("n_owners") == 1, LIVE).otherwise(F.lit("")).alias("told"))
    verdict = durable(
        asked.join(told, "hash").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("hash", "told"))).alias("told")))
    joined = spans.join(verdict, "row", "left")
    base = F.filter("spans", lambda x: x["kind"] != "loose")
    is_ = lambda x, what: F.element_at("told", x["hash"]) == what
    inside = lambda x: F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    shown = F.filter("spans", lambda x: (x["kind"] != "loose") | (is_(x, LIVE) & ~inside(x)))
    count = lambda part: F.size(part).cast("long")
    return joined.withColumn("base", base).withColumn("shown", shown).select(
        "doc_id", *[count(of_kind("base", k)).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("shown")).alias("spans"),
        count(of_kind("shown", "loose")).alias("n_loose"), count(F.filter("shown", lambda x: is_(x, SHARED))).alias("n_shared"),
        count(F.filter("shown", lambda x: is_(x, LIVE))).alias("n_live"))
