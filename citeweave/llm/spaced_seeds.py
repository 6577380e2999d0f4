"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over ``SPAN`` successive tokens that looks at some positions
and ignores the others, so a seed still matches where ignored tokens were
substituted. Seeds of the benchmark and of the training texts are joined by hash;
around each hit the two texts are compared token by token along its diagonal, and a
stretch counts if enough of its tokens agree.

Only seeds that a fixed-size filter lets pass leave the scan. The filter is built
from the benchmark and has one size however long that is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import id_filter, may_hold, mix64, slices, texts
from citeweave.session import durable

#: Masks: positions that a seed looks at, among ``SPAN`` tokens. Wherever two of ten
#: successive tokens are substituted, one of these seeds still matches.
MASKS = (
    (0, 1, 4, 6, 7, 8), (0, 2, 3, 4, 5, 8), (0, 1, 2, 3, 6, 8), (0, 2, 4, 5, 6, 7), (1, 2, 4, 5, 6, 8), (2, 3, 4, 6, 7, 8),
)
SPAN = 9
#: A stretch counts from so many tokens on, if so many percent of them agree.
STRETCH = 13
AGREE = 80
#: A shorter item must agree as a whole and have this many tokens at least.
SHORTEST = 5


_TOKEN = re.compile(r"\w+")


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the tokens: runs of letters, digits and underscores in lower case, so that neither case nor marks count."""
    words = _TOKEN.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def seeds(words: np.ndarray) -> np.ndarray:
    """(masks, positions) seed hashes; none for fewer tokens than the span."""
    n = max(0, len(words) - SPAN + 1)
    out = np.zeros((len(MASKS), n), dtype=np.uint64)
    for m, mask in enumerate(MASKS):
        h = np.full(n, m + 1, dtype=np.uint64)
        for j in mask:
            h = (h ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[m] = h
    return out


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every run of ``length`` tokens, for items shorter than the span."""
    n = max(0, len(words) - length + 1)
    h = np.full(n, 1000 + length, dtype=np.uint64)
    for j in range(length):
        h = (h ^ words[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix64(h)


def item_table(items: DataFrame) -> DataFrame:
    """``item, packed`` : the least id of each distinct token sequence with its token hashes; too short ones drop out."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [word_hashes(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array([w.tobytes() if len(w) >= SHORTEST else None for w in made], pa.binary())],
                ["item", "packed"])

    schema = T.StructType([items.schema["item"], T.StructField("packed", T.BinaryType())])
    return durable(
        items.filter("item is not null").mapInArrow(pack, schema).filter("packed is not null")
        .groupBy("packed").agg(F.min("item").alias("item")))


def item_seeds(table: DataFrame) -> DataFrame:
    """``seed, item, at``: hashes of an item's seeds and where they begin in it."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, packed in zip(batch.column("item"), batch.column("packed").to_pylist(), strict=True):
                words = np.frombuffer(packed, dtype=np.uint64)
                made = seeds(words) if len(words) >= SPAN else runs(words, len(words))[None, :]
                flat = made.ravel().view(np.int64)
                at = np.tile(np.arange(made.shape[1], dtype=np.int32), made.shape[0])
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array([item.as_py()] * len(flat), item.type), pa.array(at)], ["seed", "item", "at"])

    schema = T.StructType([T.StructField("seed", T.LongType()), table.schema["item"], T.StructField("at", T.IntegerType())])
    return durable(table.select("item", "packed").mapInArrow(cut, schema))


def doc_hits(docs: DataFrame, table: DataFrame, marks: DataFrame) -> DataFrame:
    """``row, packed, hits``: for documents with a seed in the filter, their token hashes and (seed, position) of the hits."""
    short = sorted(r["n"] for r in table.select((F.length("packed") / 8).cast("int").alias("n")).filter(F.col("n") < SPAN).distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast((id_filter(marks, "seed"), short))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = shared.value
        for batch in slices(batches):
            at, packed, hits = [], [], []
            for i, t in enumerate(texts(batch)):
                words = word_hashes(t)
                found = []
                for made in [*seeds(words), *(runs(words, n) for n in lengths)]:
                    pos = np.flatnonzero(may_hold(bits, made))
                    if len(pos):
                        found += [{"seed": int(s), "pos": int(p)} for s, p in zip(made[pos].view(np.int64), pos, strict=True)]
                if found:
                    at.append(i), packed.append(words.tobytes()), hits.append(found)
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(at)), pa.array(packed, pa.binary()),
                     pa.array(hits, pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())])))],
                    ["row", "packed", "hits"])

    return durable(docs.mapInArrow(scan, "row long, packed binary, hits array<struct<seed: long, pos: int>>").dropDuplicates(["row"]))


def best_stretch(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int]:
    """Tokens that agree in, and length of, the longest counting stretch of a diagonal; (0, 0) if there is none.

    A stretch begins and ends with an agreeing token and has ``AGREE`` percent of
    agreeing tokens: with ``100 - AGREE`` for an agreeing token and ``-AGREE`` for
    another, its sum is not negative. For each end the farthest start is the first
    place whose running sum is not higher.
    """
    start = max(0, diagonal)
    stop = min(len(doc), diagonal + len(item))
    if stop <= start:
        return 0, 0
    same = doc[start:stop] == item[start - diagonal:stop - diagonal]
    if len(item) < STRETCH:
        whole = len(same) == len(item) and 100 * int(same.sum()) >= AGREE * len(item)
        return (int(same.sum()), len(item)) if whole else (0, 0)
    sums = np.concatenate(([0], np.cumsum(np.where(same, 100 - AGREE, -AGREE))))
    least = np.minimum.accumulate(np.where(same, sums[:-1], np.iinfo(np.int64).max))
    ends = np.flatnonzero(same)
    if not len(ends):
        return 0, 0
    first = np.searchsorted(-least, -sums[ends + 1], side="left")
    best = int((ends - first).argmax())
    a, b = int(first[best]), int(ends[best]) + 1
    return (int(same[a:b].sum()), b - a) if b - a >= STRETCH else (0, 0)


def overlaps(docs: DataFrame, items: DataFrame, salts: int = 16) -> DataFrame:
    """``row, item, agree, length``: the longest counting stretch of each document (row, text) and distinct item.

    A passage on very many documents makes its seeds hot; hits are salted by
    document and the benchmark's seeds are copied once per salt.
    """
    table = item_table(items)
    marks = item_seeds(table)
    hits = doc_hits(docs, table, marks)
    mine = hits.select("row", F.explode("hits").alias("h")).select(
        "row", "h.seed", "h.pos", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    theirs = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lanes = durable(mine.join(theirs, ["seed", "salt"]).select("row", "item", (F.col("pos") - F.col("at")).alias("diagonal")).distinct())
    both = (
        lanes.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
        .join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("packed", "theirs"), ["item", "salt"])
        .join(hits.select("row", F.col("packed").alias("mine")), "row"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            agree, length = [], []
            for mine, theirs, diagonal in zip(
                    batch.column("mine"), batch.column("theirs"), batch.column("diagonal").to_pylist(), strict=True):
                got = best_stretch(np.frombuffer(mine.as_buffer(), np.uint64), np.frombuffer(theirs.as_buffer(), np.uint64), diagonal)
                agree.append(got[0]), length.append(got[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("item"), pa.array(agree, pa.int32()), pa.array(length, pa.int32())],
                ["row", "item", "agree", "length"])

    schema = T.StructType([T.StructField("row", T.LongType()), table.schema["item"], T.StructField("agree", T.IntegerType()), T.StructField("length", T.IntegerType())])
    found = both.select("row", "item", "diagonal", "mine", "theirs").mapInArrow(verify, schema).filter("length > 0")
    return found.groupBy("row", "item").agg(F.max(F.struct("length", "agree")).alias("b")).select("row", "item", "b.length", "b.agree")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document: ``doc_id, contaminated, n_items, items, longest, agree``.

    Tokens are runs of letters, digits and underscores, lower-cased. An item counts if some stretch of
    ``STRETCH`` or more tokens of it lies in the document with ``AGREE`` percent of
    them equal, position by position; an item of fewer tokens counts if it lies
    there whole with ``AGREE`` percent equal (under ``SPAN`` tokens: all equal), and
    one of under ``SHORTEST`` tokens never. ``items`` lists the ids found, sorted
    and comma-joined, items with equal tokens under their least id; ``longest`` is
    the longest stretch in tokens and ``agree`` how many of them agree.

    Null texts and null item ids match nothing; repeated rows get the same result;
    empty tables give no rows or no matches; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    found = durable(
        overlaps(rows.select("row", "text"), items).groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.struct("length", "agree")).alias("b")))
    return rows.select("doc_id", "row").join(found, "row", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"),
        F.coalesce("b.length", F.lit(0)).cast("long").alias("longest"), F.coalesce("b.agree", F.lit(0)).cast("long").alias("agree"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item of the benchmark counts; all columns stay."""
    rows = docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    items = benchmark.select(F.col("item_id").alias("item"), "text")
    bad = durable(overlaps(rows, items).select(F.col("row").alias("__row")).distinct())
    return docs.withColumn("__row", F.xxhash64(doc_id, text)).join(bad, "__row", "left_anti").select(docs.columns)
