"""Document fingerprints by Order MinHash.

The k-mers of a text are numbered by occurrence, so that the second "abcd" differs
from the first. Each of ``FUNCTIONS`` hash functions picks its two least numbered
k-mers, and these are hashed together in the order in which they stand in the text.
Texts agree in an entry if they share k-mers and keep their order, so the share of
equal entries falls with the edit distance and not only with the overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import mix64, odd_numbers, slices

#: Code points in a k-mer, entries of a fingerprint, k-mers hashed at once.
K = 8
FUNCTIONS = 32
SPAN = 8192

_TIMES = odd_numbers(FUNCTIONS, 7)[:, None]
_PLUS = odd_numbers(FUNCTIONS, 8)[:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROWS = np.arange(FUNCTIONS)


def kmers(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of the k-mers at each position; a shorter text is one k-mer."""
    k = min(K, len(points))
    n = len(points) - k + 1
    wide = points.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h *= _STEP
        h += wide[j:j + n]
    return mix64(h)


def occurrences(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in some order, and how often the k-mer at each has occurred before in the text."""
    n = len(h)
    low = np.uint64((1 << n.bit_length()) - 1)
    keys = (h & ~low) | np.arange(n, dtype=np.uint64)
    keys.sort()  # equal k-mers side by side, in text order
    at = (keys & low).astype(np.int64)
    first = np.ones(n, dtype=bool)
    first[1:] = (keys[1:] ^ keys[:-1]) > low
    index = np.arange(n)
    return at, index - np.maximum.accumulate(np.where(first, index, 0))


def signature(text: str) -> np.ndarray:
    """``FUNCTIONS`` 16-bit entries; all 0 for an empty text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.zeros(FUNCTIONS, dtype=np.uint16)
    h = kmers(points)
    at, nth = occurrences(h)
    items = (mix64(h[at] + nth.astype(np.uint64) * _STEP) >> np.uint64(32)).astype(np.uint32)
    values, places = [], []
    for start in range(0, len(items), SPAN):
        v = items[None, start:start + SPAN] * _TIMES
        v += _PLUS
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        for _ in range(min(2, v.shape[1])):
            best = v.argmin(axis=1)
            values.append(v[_ROWS, best])
            places.append(best + start)
            v[_ROWS, best] = np.uint32(0xFFFFFFFF)
    if len(values) > 2:
        order = np.argsort(np.stack(values, axis=1), axis=1, kind="stable")[:, :2]
        two = np.take_along_axis(np.stack(places, axis=1), order, axis=1)
    else:
        two = np.stack([places[0], places[-1]], axis=1)
    two = np.sort(at[two], axis=1)  # in text order
    return (mix64(h[two[:, 0]] * np.uint64(3) + mix64(h[two[:, 1]])) >> np.uint64(48)).astype(np.uint16)


def as_text(entries: np.ndarray) -> str:
    return entries.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the start of the following text."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows by descending id in ``blocks`` runs: ``block, guest, id, spot, doc_id, packed``.

    The runs begin at real ids, found as quantiles of the id column alone. The row
    with which a run begins is also sent to the run before it as a guest, and the
    first of all to the last run, so that each row finds its successor in its own
    run. Texts travel compressed.
    """
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("spot"), "doc_id", "text")
    edges = keyed.agg(
        F.percentile_approx("id", [i / blocks for i in range(1, blocks + 1)], 20 * blocks).alias("q"), F.max("id").alias("top")).first()
    ends = np.unique(np.asarray([*(edges["q"] or []), edges["top"] or 0], dtype=np.int64))
    n = len(ends)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            packed = pa.array([squeeze((t or "").encode("utf-8")) for t in batch.column("text").to_pylist()], pa.binary())
            at = np.searchsorted(ends, ids)  # the run's greatest id is ends[at]
            guests = np.flatnonzero(ends[at] == ids)
            run = np.concatenate([n - 1 - at, (n - 2 - at[guests]) % n]).astype(np.int32)
            take = pa.array(np.concatenate([np.arange(len(ids)), guests]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(run), pa.array(np.arange(len(run)) >= len(ids)), batch.column("id").take(take), batch.column("spot").take(take),
                 batch.column("doc_id").take(take), packed.take(take)],
                ["block", "guest", "id", "spot", "doc_id", "packed"])

    return keyed.mapInArrow(pack, T.StructType([
        T.StructField("block", T.IntegerType()), T.StructField("guest", T.BooleanType()), T.StructField("id", T.LongType()),
        T.StructField("spot", T.LongType()), docs.schema["doc_id"], T.StructField("packed", T.BinaryType())]))


OUT = {
    "n_chars": (T.LongType(), pa.int64()), "edited_sha256": (T.StringType(), pa.string()),
    "fingerprint": (T.StringType(), pa.string()), "edited_fingerprint": (T.StringType(), pa.string()),
    "near_edited": (T.DoubleType(), pa.float64()), "near_next": (T.DoubleType(), pa.float64()),
}


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like they and the next document's are.

    The next document is the one with the next lower id; the last one's is the
    first. Null ids come last. Rows with equal ids follow one another by a hash of
    their text. A null text is empty; empty texts have the fingerprint of zeros. A
    single row is its own next document; an empty table gives no rows; other
    columns are ignored. Ids are integers.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = in_blocks(narrow, 8 * parts).repartition("block").sortWithinPartitions(
        "block", "guest", F.desc("id"), F.asc_nulls_first("spot"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        last = None  # id, text, signature of the row whose successor comes next
        closed = None  # the run whose guest has come
        for batch in slices(batches):
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("block", "guest", "doc_id", "packed")]
            for block, guest, own, packed in zip(*columns, strict=True):
                if guest and closed == block:
                    continue
                t = unpack(packed).decode("utf-8") if packed else ""
                sig = signature(t)
                if last is not None:
                    before, old, old_sig = last
                    new = edited(old, t)
                    new_sig = signature(new) if new != old else old_sig
                    rows.append((
                        before, len(old), hashlib.sha256(new.encode("utf-8")).hexdigest(), as_text(old_sig), as_text(new_sig),
                        likeness(old_sig, new_sig), likeness(old_sig, sig)))
                last = None if guest else (own, t, sig)
                closed = block if guest else closed
            if rows:
                got = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[0], batch.schema.field("doc_id").type), *[pa.array(v, k) for v, (_, k) in zip(got[1:], OUT.values(), strict=True)]],
                    ["doc_id", *OUT])

    schema = T.StructType([narrow.schema["doc_id"], *[T.StructField(c, k) for c, (k, _) in OUT.items()]])
    return runs.select("block", "guest", "doc_id", "packed").mapInArrow(walk, schema)
