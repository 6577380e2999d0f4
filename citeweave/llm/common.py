"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.session import durable

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, whatever task asks for it.

    Task functions travel by value, so their own module globals are new in each
    task; a module registered in ``sys.modules`` is shared by all tasks of a worker.
    """
    home = sys.modules.setdefault("_task_state", types.ModuleType("_task_state"))
    return home.__dict__.setdefault(name, {})


def out_schema(df: DataFrame, keep: list[str], **new: T.DataType) -> T.StructType:
    """Schema of the kept columns of ``df`` followed by new ones."""
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(c, t) for c, t in new.items()])


def record(batch: pa.RecordBatch, keep: list[str], **new) -> pa.RecordBatch:
    """A batch of kept columns and new ones."""
    arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    arrays += [v if isinstance(v, pa.Array) else pa.array(v) for v in new.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *new])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def folded_words(text: str) -> list[bytes]:
    """Words between white space, with A-Z lower-cased and all else as it is.

    ``bytes.lower`` changes only ASCII letters and ``bytes.split`` only knows the
    six ASCII white-space characters, which is what the contracts ask for.
    """
    return text.encode("utf-8").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int, dtype=np.uint32) -> np.ndarray:
    """``n`` fixed odd multipliers for hash functions."""
    top = np.iinfo(dtype).max
    return np.random.default_rng(seed).integers(1, top, size=n, dtype=dtype, endpoint=True) | dtype(1)


#: Bits of an id filter; it marks two of them for each value.
FILTER_BITS = 1 << 24


def id_filter(values: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size (2 MB) over the 64-bit hashes in a column.

    Bits are gathered by Spark as 64-bit words, so at most 2^18 words reach the
    driver whatever the number of values. When it fills up it lets more rows pass and
    the joins behind it do the rest; no result depends on it.
    """
    bit = F.explode(F.array(*[
        F.pmod(F.shiftrightunsigned(F.col(column), k), F.lit(FILTER_BITS)) for k in (0, 32)])).alias("bit")
    words = (
        values.select(bit).groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas())
    table = np.zeros(FILTER_BITS >> 6, dtype=np.int64)
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return table.view(np.uint8)


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each 64-bit hash whether the filter may hold it."""
    h = hashes.view(np.uint64)
    size = np.uint64(FILTER_BITS - 1)

    def marked(at: np.ndarray) -> np.ndarray:
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1

    return (marked(h & size) & marked((h >> np.uint64(32)) & size)).astype(bool)


def _settled(links: DataFrame) -> bool:
    """Whether the links (u to v) are stars: every u has one v, and no v is a u."""
    ends = links.select("u", F.lit(1).alias("out"), F.lit(0).alias("center")).unionByName(
        links.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("center")))
    open_ = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("center").alias("center"))
    return open_.filter("out > 1 or (out = 1 and center = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node, root) for every node with an edge; root is the least node reachable.

    Rounds of large-star and small-star link every node to the least neighbour
    known until each component is one star. Rounds grow with the logarithm of the
    longest path. Every round is cut by a table in the shared folder, and the
    joins stand on two plain exchanges, so that a star with very many leaves is
    split by the adaptive planner. Nulls and loops are ignored; no edges, no rows.
    """
    links = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u is not null and v is not null and u <> v").distinct())
    while not _settled(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")))
        links = durable(
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        least = durable(links.groupBy("u").agg(F.min("v").alias("m")))
        links = durable(
            links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
