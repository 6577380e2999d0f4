"""Entity rows: recognition, line-tagged model output, merging.

The line-tagged grammar is evaluated with windows over the lines of one output, so
a window partition is never larger than one model answer.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from citeweave.functions import text as T
from citeweave.operators import blocked
from citeweave.session import durable

# Limits of the degradation checks.
SPAM_MIN_CHARS, SPAM_RUN, SPAM_TOKEN_CHARS = 15, 3, 20
JUNK_LIMIT = 20
PARSE_RATIO, PARSE_MIN_CHARS = 12.0, 500
TAIL, TAIL_WORDS, TAIL_HYPHENS, TAIL_RATIO = 2000, 10, 10, 8.0
CAP_PER_CATEGORY, CAP_FIELDS = 12, ("entity", "claim", "evidence", "source", "context", "conditions", "direction")
NAME_PATTERN = r"\b[A-Z][a-z]{3,}\b"


def found_names(text: Column, pattern: str = NAME_PATTERN) -> Column:
    """Offline recogniser: capitalised words in order of appearance."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def first_spellings(mentions: DataFrame, keys: list[str], pos: str, name: str) -> DataFrame:
    """First mention of each name per key, upper and lower case taken as equal."""
    low = mentions.withColumn("_low", F.lower(name))
    return blocked.first_occurrence(low, [*keys, "_low"], pos).drop("_low")


def _longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours, in one pass over the array."""
    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["prev"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(items, start, step, lambda acc: acc["best"])


def _run_of_equal(items: Column, length: int) -> Column:
    """True when ``length`` neighbouring items are equal."""
    return _longest_run(items) >= length


def spam(value: Column, words_run: int = SPAM_RUN, hyphen_run: int = SPAM_RUN) -> Column:
    """Token-level repetition: equal neighbouring words, or equal parts of a long hyphenated one.

    Words are cut out only where one pattern over the whole value sees a repetition, or a word
    that is long enough, at all; a value with other than ASCII characters is always cut.
    """
    again = r"(?:^|\s)(\S*?)[:,;.]*" + r"\s+\1[:,;.]*" * (words_run - 1) + r"(?=\s|$)"
    suspect = (
        (F.length(value) != F.octet_length(value)) | F.lower(F.trim(value)).rlike(again)
        | (F.contains(value, F.lit("-")) & value.rlike(rf"\S{{{SPAM_TOKEN_CHARS + 1}}}")))
    words = F.split(F.trim(value), r"\s+")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[:,;.]+$", ""))
    chains = F.filter(words, lambda w: F.contains(w, F.lit("-")) & (F.length(w) > SPAM_TOKEN_CHARS))

    def looping(token: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.lower(token), "-"), F.trim), lambda p: p != "")
        return _run_of_equal(parts, hyphen_run)

    found = F.when(suspect, _run_of_equal(plain, words_run) | F.exists(chains, looping)).otherwise(False)
    return (F.length(value) >= SPAM_MIN_CHARS) & found


@F.pandas_udf(DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """Characters per compressed byte (zlib has no JVM-side Spark function)."""
    return text.map(lambda t: None if t is None else len(t) / max(len(zlib.compress(t.encode())), 1))


def stream_degraded(outputs: DataFrame, text: str) -> DataFrame:
    """Flag finished outputs whose tail shows a looping model; adds ``degraded``."""
    tail = F.right(text, F.lit(TAIL))
    words = F.split(F.trim(tail), r"\s+")
    recent = F.transform(F.slice(words, -TAIL_WORDS, TAIL_WORDS),
                         lambda w: F.regexp_replace(F.lower(w), "[:,;.]+$", ""))
    same_words = F.when(F.size(words) >= TAIL_WORDS, F.size(F.array_distinct(recent)) == 1).otherwise(False)
    chains = F.filter(words, lambda w: F.contains(w, F.lit("-")) & (F.length(w) > SPAM_TOKEN_CHARS))
    hyphens = F.exists(chains, lambda w: _run_of_equal(
        F.filter(F.transform(F.split(F.lower(w), "-"), F.trim), lambda p: p != ""), TAIL_HYPHENS))
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda ln: ln != "")
    streak = F.aggregate(lines, F.lit(0), lambda n, ln: F.when(F.contains(ln, F.lit(":")), 0).otherwise(n + 1))
    dense = F.when(F.length(tail) >= 400, compression_ratio(tail) >= TAIL_RATIO).otherwise(False)
    long_enough = F.length(text) >= 200
    return outputs.withColumn("degraded", (streak >= JUNK_LIMIT) | (long_enough & (same_words | hyphens | dense)))


def render(entities: DataFrame, key: list[str]) -> DataFrame:
    """Entity rows ``(key, ord, category, entity, claim, evidence, source)`` to line-tagged text.

    Grouped form: shared fields once per evidence, then one line per entity.
    """
    line = F.concat(
        F.lit("ENTITY: "), F.col("entity"),
        F.when(F.col("claim") != "", F.concat(F.lit(" | CLAIM: "), F.col("claim"))).otherwise(""))
    block = (
        entities.groupBy(*key, "category", "evidence", "source")
        .agg(F.min("ord").alias("o"), F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
        .withColumn("text", F.concat(
            F.lit("EVIDENCE: "), F.col("evidence"), F.lit("\nSOURCE: "), F.col("source"),
            F.lit("\nTYPE: "), F.col("category"), F.lit("\n"),
            F.array_join(F.transform("l", lambda s: s["line"]), "\n")))
    )
    return block.groupBy(*key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("o", "text"))), lambda s: s["text"]), "\n\n").alias("output"))


def parse(outputs: DataFrame, key: str, text: str) -> DataFrame:
    """Line-tagged text to entity rows ``(key, ord, category, entity, attrs)``.

    Shared fields persist until overwritten. A block opened by a plain entity line
    collects attributes until the next blank or entity line and takes the shared
    fields as they stand there; a piped entity line is complete in itself. Parsing
    stops at token spam, at a block equal to the one before, or at twenty junk lines
    in a row; what was filed before that point is kept.
    """
    clean = T.drop_thinking(T.ascii_fold(F.col(text)))
    ln = outputs.select(key, F.posexplode(F.split(clean, "\n")).alias("n", "raw")).withColumn("s", T.strip(F.col("raw")))
    has_colon = F.contains("s", F.lit(":"))
    field = F.lower(T.strip(F.substring_index("s", ":", 1)))
    value = T.strip(F.expr("substring(s, instr(s, ':') + 1)"))
    ln = ln.select(
        key, "n", F.when(~has_colon & (F.col("s") != ""), F.col("s")).alias("s"),
        F.when(has_colon, field).alias("k"), F.when(has_colon, value).alias("v"),
        F.when(F.col("s") == "", "blank").when(~has_colon, "junk")
        .when(field.isin("evidence", "source", "type"), "shared")
        .when((field == "entity") & F.contains(value, F.lit("|")), "piped")
        .when(field == "entity", "open").when(value != "", "attr").otherwise("none").alias("kind"))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    border = F.col("kind").isin("blank", "piped", "open")
    for name in ("evidence", "source", "type"):
        ln = ln.withColumn(f"g_{name}", F.last(F.when(F.col("k") == name, F.col("v")), ignorenulls=True).over(upto))
    ln = ln.withColumn("seg", F.sum(border.cast("int")).over(upto)) \
        .withColumn("opener", F.last(F.when(border, F.col("kind")), ignorenulls=True).over(upto)) \
        .withColumn("formed", F.sum(has_colon.cast("int")).over(upto))
    streak = Window.partitionBy(key, "formed").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    junk = F.col("kind") == "junk"
    # Lines and filed blocks are both read more than once below; a line keeps what its kind is asked for.
    ln = durable(
        ln.withColumn("streak", F.sum(junk.cast("int")).over(streak)).filter(junk | (F.col("opener") == "open") | (F.col("kind") == "piped"))
        .drop("formed"))

    shared = [F.col(f"g_{x}") for x in ("evidence", "source", "type")]
    # Blocks opened by a plain entity line: attributes up to the border, filed at the next one.
    seg = ln.filter("opener = 'open'").groupBy(key, "seg").agg(
        F.max("n").alias("last"),
        F.max(F.when(F.col("kind") == "open", F.col("v"))).alias("entity"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "attr", F.struct("n", "k", "v")))).alias("a"),
        *[F.max_by(c, "n").alias(x) for c, x in zip(shared, ("evidence", "source", "type"))])
    opened = seg.filter(F.coalesce("entity", F.lit("")) != "").select(
        key, (F.col("last") + 1).alias("at"), F.lit(0).alias("sub"), "entity",
        F.transform("a", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))).alias("pairs"),
        "evidence", "source", "type")
    parts = F.transform(F.split("v", r"\|"), T.strip)
    tagged = F.filter(F.slice(parts, 2, F.size(parts)), lambda p: F.contains(p, F.lit(":")))
    pairs = F.filter(F.transform(tagged, lambda p: F.struct(
        F.lower(T.strip(F.substring_index(p, ":", 1))).alias("k"),
        T.strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("v"))), lambda s: s["v"] != "")
    pairs = F.transform(pairs, lambda s: F.struct(
        F.when(s["k"] == "direction", "claim").otherwise(s["k"]).alias("k"), s["v"].alias("v")))
    piped = ln.filter(F.col("kind") == "piped").select(
        key, F.col("n").alias("at"), F.lit(1).alias("sub"), F.element_at(parts, 1).alias("entity"), pairs.alias("pairs"),
        *[c.alias(x) for c, x in zip(shared, ("evidence", "source", "type"))])
    filed = opened.unionByName(piped).filter(F.col("entity") != "")
    # Later values of one attribute win; sorted entries make blocks comparable.
    last_of = lambda p: F.filter(p, lambda x, i: ~F.exists(
        F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"]))
    filed = filed.withColumn("pairs", F.array_sort(last_of(F.col("pairs"))))
    same = F.to_json(F.struct("entity", "pairs", "evidence", "source", "type"))
    order = Window.partitionBy(key).orderBy("at", "sub")
    fields = F.concat(
        F.array("entity", "evidence", "source", "type"), F.transform("pairs", lambda p: p["v"]))
    filed = filed.withColumn("whole", same).withColumn("again", F.lag("whole").over(order).eqNullSafe(F.col("whole"))) \
        .withColumn("bad", F.exists(fields, lambda f: F.coalesce(spam(f), F.lit(False))) | F.col("again")) \
        .drop("whole", "again")
    filed = durable(filed)
    stops = filed.filter("bad").select(key, F.struct("at", "sub").alias("stop")).unionByName(
        ln.filter(junk & (spam(F.col("s")) | (F.col("streak") >= JUNK_LIMIT)))
        .select(key, F.struct(F.col("n").alias("at"), F.lit(0).alias("sub")).alias("stop")))
    first_stop = stops.groupBy(key).agg(F.min("stop").alias("stop"))
    kept = filed.join(first_stop, key, "left").filter(
        F.col("stop").isNull() | (F.struct("at", "sub") < F.col("stop")))
    return (
        kept.withColumn("category", F.coalesce("type", F.lit("unknown"))).filter(F.col("category") != "")
        .withColumn("ord", F.row_number().over(order))
        .select(
            key, "ord", "category", "entity", F.map_from_entries("pairs").alias("attrs"),
            F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("source", F.lit("")).alias("source"))
    )


def parse_status(outputs: DataFrame, key: str, text: str, parsed: DataFrame) -> DataFrame:
    """``ok``, ``empty`` or ``degraded`` per output; emptiness with high redundancy is degradation."""
    n = parsed.groupBy(key).agg(F.count(F.lit(1)).alias("n_entities"))
    out = outputs.join(n, key, "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    suspect = F.when((F.col("n_entities") == 0) & (F.length(text) > PARSE_MIN_CHARS), F.col(text))
    ratio = compression_ratio(suspect)
    return out.select(key, "n_entities", F.when(F.col("n_entities") > 0, "ok")
                      .when(ratio >= PARSE_RATIO, "degraded").otherwise("empty").alias("status"))


def merge(rows: DataFrame, order: str) -> DataFrame:
    """Merge entity rows by (category, lower-cased name, claim).

    ``rows`` has ``order, category, entity, claim, evidence, source``. Rows without a
    claim lend their evidence to the claim in force (the latest earlier one, or the
    first one when none came before; of those early rows only the longest counts).
    A name that never has a claim keeps its longest evidence. Returns one row per
    merged entity with counts of distinct evidence pieces and sources; the pieces
    themselves stay rows, so no merged entity becomes one giant value.
    """
    base = rows.withColumn("name", F.lower(T.strip(F.col("entity")))).filter(F.col("name") != "") \
        .withColumn("claim", F.coalesce("claim", F.lit("")))
    name = ["category", "name"]
    said = F.col("claim") != ""
    marked = blocked.last_before(base, name, order, F.when(said, F.col("claim")), "_prev")
    facts = base.groupBy(*name).agg(
        F.min_by(F.when(said, F.col("claim")), F.when(said, F.col(order))).alias("_first"),
        F.min(F.when(said, F.col(order))).alias("_at"))
    joined = marked.join(facts, name)
    early = ~said & F.col("_prev").isNull()
    # The row that stands for all early unclaimed rows: longest evidence, first of equals.
    lead = joined.filter(early).groupBy(*name).agg(
        F.min_by(order, F.struct(-F.length("evidence"), F.col(order))).alias("_lead"))
    live = joined.join(lead, name, "left").filter(~early | (F.col(order) == F.col("_lead")))
    return live.select(
        "category", "name", order, "entity",
        F.when(said, F.col("claim")).otherwise(F.coalesce("_prev", "_first", F.lit(""))).alias("claim"),
        said.alias("_own"), "evidence", "source")


def merged_summary(merged: DataFrame, order: str) -> DataFrame:
    """One row per merged entity."""
    key = ["category", "name", "claim"]
    pieces = merged.select(*key, F.explode(F.split("evidence", r" \| ")).alias("p")) \
        .select(*key, T.strip(F.col("p")).alias("p")).filter(F.col("p") != "").distinct() \
        .groupBy(*key).agg(F.count(F.lit(1)).alias("n_evidence"), F.max(F.length("p")).alias("longest"))
    srcs = merged.select(*key, "source").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_sources"))
    head = merged.groupBy(*key).agg(
        F.min(order).alias("first_ord"), F.count(F.lit(1)).alias("n_rows"))
    return head.join(pieces, key, "left").join(srcs, key).withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0))) \
        .withColumn("longest", F.coalesce("longest", F.lit(0)).cast("long"))


def compress(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """First twelve entities per category, in order: what a drafting prompt gets."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= CAP_PER_CATEGORY)


def markdown_lists(outputs: DataFrame, key: str, text: str) -> DataFrame:
    """Fallback for markdown keyword lists: ``(key, n, i, category, entity, evidence)``."""
    ln = outputs.select(key, F.posexplode(F.split(T.drop_thinking(T.ascii_fold(F.col(text))), "\n")).alias("n", "raw")) \
        .withColumn("s", T.strip(F.col("raw"))).filter(F.col("s") != "")
    trim_colon = lambda c: F.regexp_replace(T.strip(c), ":+$", "")
    header = r"^\*\*(.+?)\*\*\s*$"
    is_head = F.col("s").rlike(header)
    head = trim_colon(F.regexp_extract("s", header, 1))
    plain = ~F.lower(head).isin("keywords", "key variables", "experimental methods")
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ln = ln.withColumn("cat", F.coalesce(F.last(F.when(is_head & plain, head), ignorenulls=True).over(upto), F.lit("")))
    lst = r"^\*\s*(?:\*\*(.+?)\*\*:?|(.+?):)\s*(.+)"
    label = trim_colon(F.concat(F.regexp_extract("s", lst, 1), F.regexp_extract("s", lst, 2)))
    body = T.strip(F.regexp_extract("s", lst, 3))
    items = F.transform(F.filter(F.split(body, ","), lambda x: F.length(T.strip(x)) > 2),
                        lambda x: F.regexp_replace(T.strip(x), r"\*+$", ""))
    as_list = ~is_head & F.contains(body, F.lit(",")) & (F.size(items) > 0) & (label != "")
    single = r"^\*\s*\*\*(.+?)\*\*:?\s*(.*)"
    name = trim_colon(F.regexp_extract("s", single, 1))
    lists = ln.filter(as_list).select(key, "n", label.alias("category"), F.posexplode(items).alias("i", "entity")) \
        .withColumn("evidence", F.lit(""))
    singles = ln.filter(~is_head & ~as_list & F.col("s").rlike(single) & (name != "")).select(
        key, "n", F.when(F.col("cat") != "", F.col("cat")).otherwise(name).alias("category"),
        F.lit(0).alias("i"), name.alias("entity"), T.strip(F.regexp_extract("s", single, 2)).alias("evidence"))
    return lists.unionByName(singles, allowMissingColumns=False)
