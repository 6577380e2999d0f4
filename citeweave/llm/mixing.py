"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. A source whose target is ``r`` times its size
gives ``floor(r)`` whole copies of every document for certain and a sample of its
documents for the rest. The sample is drawn by order: with ``u`` uniform and ``p``
the document's own inclusion probability, documents are ranked by
``(u / (1-u)) / (p / (1-p))`` and taken from the front until the words wanted are
reached, so its size in words is fixed and not random. Probabilities grow with the
number of binary digits of a document's size, such that the words expected are those
wanted; a document whose probability comes to one or more is certain and stands in front.

Long documents are drawn first and short ones after them with what the long ones
left open, so that each source misses its target by half a short document at most
(unless the short ones cannot make up for a long one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import WORD
from citeweave.session import durable

#: Cells of one level of the search for the cut in a ranking.
CELLS = 4096
WEIGHTS = (5, 2, 1)


def uniform(*keys: str) -> Column:
    """A number strictly between 0 and 1 that depends on the keys alone (48 bits of an MD5)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def strength(size: str) -> Column:
    """How strongly a document of so many words is drawn: the binary digits of the number."""
    return F.length(F.bin(size))


def targets(sizes: DataFrame, *, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` per source.

    Sources in code-point order, null last, get the weights in turn. ``share`` of
    all words is dealt by weight; a target stops at ``cap`` times its source's size
    and what is over is dealt again among the others until none is above. That is
    the level ``x`` at which ``sum(min(cap * size, weight * x))`` is the total: with
    sources in order of the level at which each is full, it is what is left per
    weight at the first source that this does not fill (and the largest such).

    The table has a row for each source: parameters of the mix, so its windows have
    no partition key.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    full = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("weight", w).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    level = (
        share * F.sum("source_size").over(everything)
        - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_ = ranked.withColumn("level", level).withColumn(
        "x", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
    return open_.select(
        "source", "source_size",
        F.least(cap * F.col("source_size"), F.col("weight") * F.coalesce("x", "full_at")).cast("double").alias("target"))


def _cut(rows: DataFrame, want: DataFrame) -> DataFrame:
    """``rows`` with a boolean ``drawn``: the front of each source's ranking, up to the words wanted.

    ``rows``: doc_id, source_key, size, u; ``want``: source_key, words, p, one row
    per source; ``p`` is the share of the source's words that is wanted, ``odds_size`` and
    ``odds_total`` make it each document's own. A row is drawn if at least half of it still fits. The cut is
    searched for in two levels of cells of the rank, so that no source is ordered as
    a whole: only the one small cell that holds the cut is.
    """
    # Sources that want nothing drop out here; their rows get no words and are not drawn.
    ranked = rows.join(want.filter("p > 0"), "source_key", "left").withColumn(
        "p", F.least(F.lit(1.0), F.col("p") * (strength("size") * F.col("odds_size")) / F.col("odds_total"))).withColumn(
        "rank", F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p"))
    # Rank 1, where the cut is expected, falls in the middle of 0 to 1.
    spot = F.col("rank") / (1 + F.col("rank")) * CELLS
    celled = ranked.withColumn("c1", F.floor(spot)).withColumn("c2", F.floor((spot - F.floor(spot)) * CELLS)).drop("p", "odds_size", "odds_total")

    def boundary(level: DataFrame, cell: str, left: Column) -> DataFrame:
        """The first cell in which a source's sum passes what is left, with the sum before it."""
        sums = level.groupBy("source_key", cell).agg(F.sum("size").alias("s"), F.first(left).alias("left"))
        upto = F.sum("s").over(Window.partitionBy("source_key").orderBy(cell))
        return durable(
            sums.withColumn("upto", upto).filter("upto > left").groupBy("source_key")
            .agg(F.min_by(F.struct(F.col(cell), (F.col("upto") - F.col("s")).alias("prior")), cell).alias("b"))
            .select("source_key", F.col(f"b.{cell}").alias(f"cut_{cell}"), F.col("b.prior").alias(f"prior_{cell}")))

    outer = celled.join(boundary(celled.filter("words is not null"), "c1", F.col("words")), "source_key", "left")
    inner = outer.filter("c1 = cut_c1")
    placed = outer.join(boundary(inner, "c2", F.col("words") - F.col("prior_c1")), "source_key", "left")
    in_cell = (F.col("c1") == F.col("cut_c1")) & (F.col("c2") == F.col("cut_c2"))
    ahead = F.col("cut_c1").isNull() | (F.col("c1") < F.col("cut_c1")) | (
        (F.col("c1") == F.col("cut_c1")) & (F.col("c2") < F.col("cut_c2")))
    upto = F.sum("size").over(Window.partitionBy("source_key").orderBy("rank", "doc_id", "size"))
    kept = ["doc_id", "source_key", "size", "drawn"]
    rest = placed.filter(~F.coalesce(in_cell, F.lit(False))).withColumn("drawn", ahead & F.col("words").isNotNull()).select(kept)
    cell = placed.filter(in_cell).withColumn(
        "drawn", upto - F.col("size") / 2 <= F.col("words") - F.col("prior_c1") - F.col("prior_c2")).select(kept)
    return rest.unionByName(cell)


def take(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS,
) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, copies, taken``.

    ``size`` counts the words of the text (null: 0), ``copies`` is how often the
    document is in the mix, ``taken = copies * size``. Documents without words are
    never taken. Random numbers hang on id and source alone, so a rerun agrees.
    Repeated rows rank side by side; fully equal ones are interchangeable. A null
    source is a source of its own, a null id passes through, an empty table gives
    no rows, other columns are ignored.
    """
    rows = durable(docs.select(
        F.col(doc_id).alias("doc_id"),
        # A key that is never null: null sources meet under the empty key, others have a mark in front.
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        uniform(doc_id, source).alias("u")))
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean"))
    named = sizes.withColumn("source", F.when(F.col("source_key") != "", F.substring("source_key", 2, 1 << 30)))
    goal = targets(named.select("source", "source_size"), share=share, cap=cap, weights=weights).withColumn(
        "source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    plan = durable(goal.join(sizes.select("source_key", "mean"), "source_key").withColumn(
        "base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")).drop("source"))

    # Long documents first, short ones with what is left open.
    split = rows.filter("size > 0").join(plan.select("source_key", "mean"), "source_key").withColumn("long", F.expr("size > mean"))
    long_size = split.groupBy("source_key").agg(
        F.sum(F.when(F.col("long"), F.col("size"))).alias("long_size"),
        F.sum(F.when(F.col("long"), strength("size") * F.col("size"))).alias("long_total"),
        F.sum(F.when(~F.col("long"), strength("size") * F.col("size"))).alias("short_total"))
    share_of = durable(
        plan.join(long_size, "source_key", "left").fillna(0, ["long_size", "long_total", "short_total"]).filter("source_size > 0")
        .withColumn("p", F.col("rest") / F.col("source_size")))
    drawn_long = durable(_cut(
        split.filter("long").drop("mean", "long"),
        share_of.select(
            "source_key", (F.col("p") * F.col("long_size")).alias("words"), "p", F.col("long_size").alias("odds_size"),
            F.col("long_total").alias("odds_total"))))
    got = drawn_long.filter("drawn").groupBy("source_key").agg(F.sum("size").alias("got"))
    short_size = F.col("source_size") - F.col("long_size")
    left = F.greatest(F.lit(0.0), F.least(F.col("rest") - F.coalesce("got", F.lit(0)), short_size.cast("double")))
    want_short = durable(
        share_of.join(got, "source_key", "left").filter(short_size > 0)
        .select(
            "source_key", left.alias("words"), (left / short_size).alias("p"), short_size.alias("odds_size"),
            F.col("short_total").alias("odds_total")))
    drawn_short = _cut(split.filter("not long").drop("mean", "long"), want_short)
    none = rows.filter("size = 0").select("doc_id", "source_key", "size", F.lit(False).alias("drawn"))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("drawn").cast("long")).otherwise(F.lit(0)).cast("long")
    return (
        drawn_long.unionByName(drawn_short).unionByName(none).join(plan, "source_key")
        .withColumn("copies", copies)
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
