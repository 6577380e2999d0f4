"""Context budgets, packing and self-calibration of batch sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import blocked

# Calibration defaults and prompt overheads.
RATIO, LOWER, UPPER = 0.50, 8000, 16384
KEEP, LATEST = 0.80, 0.20
MARGIN, OVERHEAD, STARVED, SMALLEST = 0.95, 350, 500, 100
CONTEXT_SHARE, CONTEXT_OVERHEAD = 0.7, 3000


def context_budget(num_ctx: int) -> int:
    """Tokens that summaries may fill in one context window."""
    return max(1, int(num_ctx * CONTEXT_SHARE) - CONTEXT_OVERHEAD)


def fit(items: DataFrame, group: list[str], order: str, tokens: Column, num_ctx: int) -> DataFrame:
    """Leading items of each group that fit the context; the first always stays."""
    placed = blocked.position(items.withColumn("tokens", tokens.cast("long")), group, order, "pos")
    total = blocked.running_sum(placed, group, order, F.col("tokens"), "used_tokens")
    return total.filter((F.col("used_tokens") <= context_budget(num_ctx)) | (F.col("pos") == 0))


def chunk_budget(ratio: Column, lower: Column, system_tokens: Column, ceiling: int | None = None) -> Column:
    """Tokens per batch from the calibrated bound and output ratio."""
    room = lower * MARGIN - system_tokens - OVERHEAD
    room = F.when(room <= 0, F.lit(float(STARVED))).otherwise(room)
    budget = F.floor(room / (1.0 + ratio)).cast("long")
    if ceiling is not None:
        budget = F.least(budget, F.lit(ceiling))
    return F.greatest(F.lit(SMALLEST), budget)


def pack(sizes: Column, budget: Column | int) -> Column:
    """Batch number of every chunk of one paper, filled greedily in order.

    ``sizes`` is the paper's array of token counts; the fold stays inside the row.
    """
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    start = F.struct(
        F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"),
        F.array().cast("array<int>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + size > limit)
        batch = acc["batch"] + full.cast("int")
        used = F.when(full, size).otherwise(acc["used"] + size).cast("long")
        return F.struct(
            batch.alias("batch"), used.alias("used"),
            F.concat(acc["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def pack_papers(papers: DataFrame, key: str, body: str, source: str, budget: int) -> DataFrame:
    """Chunks of each paper with their batch: ``key, chunk_index, tokens, batch``."""
    lines = F.transform(T.lines(F.col(body)), lambda p: p["text"])
    sized = papers.select(key, F.transform(
        lines, lambda p, i: T.token_estimate(T.prompt_line(i, F.col(source), p))).alias("sizes"))
    both = F.arrays_zip(F.col("sizes").alias("tokens"), pack(F.col("sizes"), budget).alias("batch"))
    return sized.select(key, F.posexplode(both).alias("chunk_index", "c")).select(
        key, "chunk_index", F.col("c.tokens").alias("tokens"), F.col("c.batch").alias("batch"))


def output_ratio(waves: DataFrame, model: list[str], order: str, chunk: str, output: str, span: int) -> DataFrame:
    """Exponential average of output per chunk token for every model.

    One wave is the affine map r -> a*r + b; maps compose associatively, so the
    ordered history is folded as a tree. Waves without both counts change nothing.
    """
    seen = (F.col(chunk) > 0) & (F.col(output) > 0)
    latest = F.col(output) / F.greatest(F.col(chunk), F.lit(1))
    one, zero = F.lit(1.0), F.lit(0.0)
    element = F.struct(
        F.when(seen, F.lit(KEEP)).otherwise(one).alias("a"),
        F.when(seen, latest * LATEST).otherwise(zero).alias("b"))
    unit = F.struct(one.alias("a"), zero.alias("b"))

    def after(p: Column, q: Column) -> Column:
        return F.struct((p["a"] * q["a"]).alias("a"), (q["a"] * p["b"] + q["b"]).alias("b"))

    folded = blocked.ordered_fold(waves, model, order, element, unit, after, span)
    return folded.select(*model, (F.col("state.a") * RATIO + F.col("state.b")).alias("output_ratio"))


def boundary(waves: DataFrame, model: list[str], order: str, total: str, passed: str, span: int) -> DataFrame:
    """Proven-safe lower and unsafe upper bound after all waves of a model.

    A pass lifts both bounds to at least the total, a failure presses both to at
    most the total, so every wave is a clamp; clamps compose into clamps.
    """
    lo, hi = F.lit(float("-inf")), F.lit(float("inf"))
    x = F.col(total).cast("double")
    element = F.struct(
        F.when(F.col(passed), x).otherwise(lo).alias("lo"),
        F.when(F.col(passed), hi).otherwise(x).alias("hi"))
    unit = F.struct(lo.alias("lo"), hi.alias("hi"))

    def after(p: Column, q: Column) -> Column:
        clamp = lambda v: F.least(F.greatest(v, q["lo"]), q["hi"])
        return F.struct(clamp(p["lo"]).alias("lo"), clamp(p["hi"]).alias("hi"))

    folded = blocked.ordered_fold(waves, model, order, element, unit, after, span)
    clamp = lambda v: F.least(F.greatest(F.lit(float(v)), F.col("state.lo")), F.col("state.hi"))
    return folded.select(
        *model, clamp(LOWER).cast("long").alias("boundary_lower"), clamp(UPPER).cast("long").alias("boundary_upper"))
