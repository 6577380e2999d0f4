"""An exact set-similarity join for crowds, where signatures cannot tell likely pairs apart.

Every set lists its elements rarest first. Two sets of the wanted similarity have their
first common element in both prefixes, so sets meet under the elements of their prefixes
alone, and no pair is left out. The counts that order the elements are kept in a table of
fixed size: elements that share a slot change how many pairs are looked at, never which
are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import id_filter, may_hold, mix64, slices
from citeweave.session import durable

#: Bits of a slot number of the count table.
SLOT_BITS = 18
#: Slots that travel together when counts are added up.
PART = 1 << 12
#: 64-bit words of a set's parity map.
WORDS = 8
#: Elements of the prefix before its own that a row carries.
BEFORE = 8


def slots(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def element_counts(sets: DataFrame) -> np.ndarray:
    """For each slot the number of elements, over all sets of (packed), that fall into it.

    Tasks send their tables in parts of ``PART`` slots; parts with one number are added up as they stream by, so the
    driver gets each part once, packed.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in slices(batches):
            for x in batch.column("packed"):
                np.add.at(table, slots(np.frombuffer(x.as_buffer(), dtype=np.uint64)), 1)
        parts = table.reshape(-1, PART)
        at = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([parts[k].tobytes() for k in at], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    kind = "part int, counts binary"
    found = sets.select("packed").mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).toArrow()
    table = np.zeros((1 << SLOT_BITS) // PART * PART, dtype=np.int64).reshape(-1, PART)
    for part, counts in zip(found.column("part").to_pylist(), found.column("counts"), strict=True):
        table[part] = np.frombuffer(counts.as_buffer(), dtype=np.int64)
    return table.ravel()


def parity(values: np.ndarray) -> np.ndarray:
    """A map of which bits an odd number of elements has: two maps differ in no more bits than their sets in elements."""
    at = (mix64(values ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(64 * WORDS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * WORDS) & 1).astype(np.uint8)).view(np.int64)


def before(keys: np.ndarray, times: list[int]) -> pa.ListArray:
    """For each key of prefixes side by side, ``times`` keys each, up to ``BEFORE`` keys that stand before it in its prefix."""
    starts = np.cumsum([0, *times[:-1]])
    own = np.arange(len(keys))
    size = np.minimum(own - np.repeat(starts, times), BEFORE)
    ends = np.cumsum(size)
    at = np.repeat(own - ends, size) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(keys[at]))


def prefix(values: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements of the prefix that other sets may have, and their places in the set's order."""
    often = counts[slots(values)]
    size = len(values) + (-percent * len(values) // 100) + 1
    order = np.lexsort((values, often))[:size]
    at = np.flatnonzero(often[order] > 1)
    return values[order[at]], at


def pairs(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: all pairs of different components that can have ``percent`` percent of their union in common.

    ``sets`` has (id, root, packed): an id, its component so far, and distinct 64-bit
    elements. Pairs are told by necessary conditions alone and may be given again: a pair is
    left to an earlier element of both prefixes where the rows show one, as all that is asked holds there too.
    """
    spark = sets.sparkSession
    counts = spark.sparkContext.broadcast(element_counts(sets))

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [prefix(np.frombuffer(x.as_buffer(), dtype=np.uint64), counts.value, percent)[0].view(np.int64) for x in batch.column("packed")]
            root = np.repeat(batch.column("root").to_numpy(zero_copy_only=False), list(map(len, keys)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(root)], ["key", "root"])

    # Elements that sets of one component alone have bring nothing.
    mixed = durable(
        sets.select("root", "packed").mapInArrow(roots, "key long, root long").groupBy("key")
        .agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key"))
    bits = spark.sparkContext.broadcast(id_filter(mixed, "key"))
    words = [f"w{k}" for k in range(WORDS)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, places, sizes, maps, of = [], [], [], [], []
            for i, x in enumerate(batch.column("packed")):
                own = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                key, at = prefix(own, counts.value, percent)
                hit = may_hold(bits.value, key.view(np.int64))
                if hit.any():
                    keys.append(key[hit].view(np.int64)), places.append(at[hit])
                    sizes.append(len(own)), maps.append(parity(own)), of.append(i)
            if not of:
                continue
            times = list(map(len, keys))
            at = pa.array(np.repeat(of, times))
            flat = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), batch.column("id").take(at), batch.column("root").take(at),
                 pa.array(np.repeat(sizes, times).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32)),
                 *[pa.array(np.repeat(w, times)) for w in np.stack(maps).T], before(flat, times)],
                ["key", "id", "root", "size", "place", *words, "before"])

    rows = durable(
        sets.select("id", "root", "packed")
        .mapInArrow(meet, "key long, id long, root long, size int, place int, " + ", ".join(f"{w} long" for w in words) + ", before array<long>"))
    counts.destroy(), bits.destroy()  # all that needs them is written
    x, y = rows.alias("x"), rows.alias("y")
    col = lambda side, name: F.col(f"{side}.{name}")
    both = col("x", "size") + col("y", "size")
    common = F.ceil(both * percent / (100 + percent) - F.lit(1e-6))
    rest = F.least(col("x", "size") - col("x", "place"), col("y", "size") - col("y", "place"))
    apart = sum((F.bit_count(col("x", w).bitwiseXOR(col("y", w))) for w in words), F.lit(0))
    return x.join(
        y, (col("x", "key") == col("y", "key")) & (col("x", "id") < col("y", "id")) & (col("x", "root") != col("y", "root"))
        & (rest >= common) & (apart <= both - 2 * common) & ~F.arrays_overlap(col("x", "before"), col("y", "before"))).select(col("x", "id").alias("a"), col("y", "id").alias("b"))
