"""Near-duplicates by an LSH forest over MinHash signatures.

One signature per distinct shingle set; several trees, each a different order of
the signature's entries. In a tree, sets are sorted by their reordered signature,
so that neighbours share the longest prefixes. Around each set the search goes as
deep as its region needs: in a thin region all sets with the least common prefix
are candidates of each other, in a crowded one the neighbours in order are those
with the longest prefixes there, and the sets of crowded regions are also joined
exactly. Candidates are confirmed on the full shingle sets, and links are joined to
components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm import crowds
from citeweave.llm.common import components, folded_words, id_filter, may_hold, mix64, odd_numbers, slices, texts
from citeweave.session import durable

#: Trees, entries that neighbours share at least, entries of a tree's order.
TREES = 24
LEAST = 4
DEPTH = 28
#: Signature entries: every tree starts with entries of its own.
ENTRIES = TREES * LEAST
#: Neighbours on each side that a set is compared with.
NEAR = 3
#: Shingles hashed at once.
SPAN = 4096

_TIMES = odd_numbers(ENTRIES, 21)[:, None]
_PLUS = odd_numbers(ENTRIES, 22)[:, None]


def tree_orders() -> np.ndarray:
    """The entries of each tree in order: its own first, then others in a fixed random order."""
    rng = np.random.default_rng(23)
    rows = []
    for t in range(TREES):
        own = np.arange(t * LEAST, (t + 1) * LEAST)
        rest = rng.permutation(np.setdiff1d(np.arange(ENTRIES), own))
        rows.append(np.concatenate([own, rest])[:DEPTH])
    return np.asarray(rows)


ORDERS = tree_orders()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle; no words, none."""
    words = folded_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def signature(sets: np.ndarray) -> np.ndarray:
    """16-bit MinHash entries of a non-empty set."""
    short = (sets >> np.uint64(32)).astype(np.uint32)
    least = np.full(ENTRIES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(short), SPAN):
        v = short[None, start:start + SPAN] * _TIMES
        v += _PLUS
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(least, v.min(axis=1), out=least)
    return (mix64(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def label_bytes(rows: np.ndarray) -> list[bytes]:
    """A label per tree: 16 bits of each of the first ``LEAST`` entries, 8 bits of the deeper ones.

    Two bytes first, so that strangers do not meet by chance; below, a chance match in
    one entry only changes the order among sets that are near anyway.
    """
    head = rows[:, :LEAST].astype(">u2").view(np.uint8)
    return [r.tobytes() for r in np.concatenate([head, (rows[:, LEAST:] & 0xFF).astype(np.uint8)], axis=1)]


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``id, n_shingles, set_key, sig``: a 128-bit key of the set and its signature; null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, keys, sigs = [], [], []
            for t in texts(batch):
                got = shingles(t, width)
                sizes.append(len(got))
                keys.append(xxhash.xxh3_128_digest(got.tobytes()) if len(got) else None)
                sigs.append(signature(got).tobytes() if len(got) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["id", "n_shingles", "set_key", "sig"])

    return docs.mapInArrow(run, T.StructType([
        docs.schema["id"], T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
        T.StructField("sig", T.BinaryType())]))


def in_trees(heads: DataFrame) -> DataFrame:
    """Each row of (id, sig, ...) once per tree with ``tree, label``, in the order of the forest.

    Rows are range-partitioned and sorted by tree, label and id: a region with very
    many sets is split over as many partitions as it fills, and no partition or
    region is held as a whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = pa.array(np.repeat(np.arange(batch.num_rows), TREES))
            made = [x for sig in batch.column("sig").to_pylist() for x in label_bytes(np.frombuffer(sig, dtype=np.uint16)[ORDERS])]
            trees = pa.array(np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows))
            rest = [batch.column(c).take(at) for c in kept]
            yield pa.RecordBatch.from_arrays([trees, pa.array(made, pa.binary()), *rest], ["tree", "label", *kept])

    kept = heads.columns if "root" in heads.columns else ["id"]
    schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("label", T.BinaryType()), *[heads.schema[c] for c in kept]])
    return heads.mapInArrow(run, schema).repartitionByRange("tree", "label", "id").sortWithinPartitions("tree", "label", "id")


def common_entries(labels: list[bytes]) -> np.ndarray:
    """Number of leading entries that each label shares with the one after it."""
    rows = np.frombuffer(b"".join(labels), dtype=np.uint8).reshape(len(labels), LEAST + DEPTH)
    same = rows[1:] == rows[:-1]
    same = np.concatenate([same[:, 0:2 * LEAST:2] & same[:, 1:2 * LEAST:2], same[:, 2 * LEAST:]], axis=1)
    return np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))


def neighbours(heads: DataFrame) -> DataFrame:
    """``a, b, depth``: candidates among (id, sig), with the depth of their common prefix; ``a`` equals ``b`` for a row of a crowd.

    A row is compared with the ``NEAR`` rows after it in its tree while they share ``LEAST`` entries.
    Where the row behind these still shares them, both ends stand in a crowd, as do the rows at the
    ends of a partition, whose neighbours are elsewhere: two rows that share ``LEAST`` entries in a
    tree are compared or are both rows of a crowd.
    """
    def rows(a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(depth.astype(np.int32))], ["a", "b", "depth"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        begun = 0
        for batch in batches:
            new = [batch.column(c).to_pylist() for c in ("tree", "label", "id")]
            tree, label, own = (h + n for h, n in zip(held, new, strict=True))
            fresh = len(held[0])
            held = tuple(x[-NEAR - 1:] for x in (tree, label, own))
            crowd = [np.asarray(new[2][:max(0, NEAR - begun)], dtype=np.int64)]
            begun += len(new[2])
            a, b, depth = [], [], []
            if len(own) > 1:
                trees, ids = np.asarray(tree), np.asarray(own)
                step = np.where(trees[1:] == trees[:-1], common_entries(label), 0)
                shared = step
                for gap in range(1, min(NEAR + 1, len(ids) - 1) + 1):
                    if gap > 1:  # entries shared over a gap: the least of the steps in it
                        shared = np.minimum(shared[:-1], step[gap - 1:])
                    # Pairs that end among the rows held back were given with the last batch.
                    at = np.flatnonzero((shared >= LEAST) & (np.arange(len(shared)) + gap >= fresh))
                    if gap > NEAR:
                        crowd += [ids[at], ids[at + gap]]
                        continue
                    at = at[ids[at] != ids[at + gap]]
                    a.append(ids[at]), b.append(ids[at + gap]), depth.append(shared[at])
            crowd = np.unique(np.concatenate(crowd))
            yield rows(np.concatenate([*a, crowd]), np.concatenate([*b, crowd]), np.concatenate([*depth, np.zeros(len(crowd), dtype=np.int64)]))
        ends = np.asarray(held[2][-NEAR:], dtype=np.int64)
        yield rows(ends, ends, np.zeros(len(ends), dtype=np.int64))

    return in_trees(heads.select("id", "sig")).mapInArrow(run, "a long, b long, depth int")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``id, packed``: full shingle sets of the documents whose id is wanted (and of a few others)."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select(F.xxhash64("id").alias("h")), "h"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hit = may_hold(bits.value, batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64))
            batch = batch.filter(pa.array(hit))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([shingles(t, width).tobytes() for t in texts(batch)], pa.binary())],
                    ["id", "packed"])

    rows = docs.filter("id is not null").select("id", F.xxhash64("id").alias("h"), "text")
    made = durable(rows.mapInArrow(build, T.StructType([docs.schema["id"], T.StructField("packed", T.BinaryType())])))
    bits.destroy()
    return made


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with ``100 * intersection >= percent * union`` on full shingle sets."""
    both = (
        pairs.select("a", "b").join(sets.withColumnsRenamed({"id": "a", "packed": "pa"}), "a")
        .join(sets.withColumnsRenamed({"id": "b", "packed": "pb"}), "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column("pa"), batch.column("pb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large:
                    good.append(False)
                    continue
                joint = np.concatenate([x, y])
                joint.sort()
                common = int((joint[1:] == joint[:-1]).sum())
                good.append(100 * common >= percent * (len(joint) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "pa", "pb").mapInArrow(check, "a long, b long")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component of (node, root)."""
    return durable(
        pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        .filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85,
) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``.

    Words are lower-cased (A-Z only); a document's set holds its distinct shingles
    of ``width`` words. Documents with ``100 * intersection >= percent * union`` are
    linked; ``component_id`` is the least id reachable over links, and the document
    with that id is kept.

    A null text, and one without words, has an empty set and is linked with
    nothing. Equal sets are always linked. A null id stands by itself and is kept;
    rows with one id are one document, which all of their sets tie together. An empty
    table gives no rows; other columns are ignored. Ids are integers.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    drawn = durable(sketches(rows, width))

    # Exact copies first: one member stands for all of an equal set.
    full = drawn.filter("set_key is not null and id is not null")
    heads = durable(full.groupBy("set_key").agg(F.min_by(F.struct("id", "sig"), "id").alias("h")).select("set_key", "h.id", "h.sig"))
    member = durable(full.select("id", "set_key").join(heads.select("set_key", F.col("id").alias("head")), "set_key").select("id", "head"))

    # Each set with the neighbour that it meets in most trees first, then all pairs that this leaves apart.
    told = durable(neighbours(heads).groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees"), F.max("depth").alias("depth")))
    found, crowd = told.filter("a <> b"), told.filter("a = b").select(F.col("a").alias("id"))
    rank = F.struct("trees", "depth", F.struct("a", "b").alias("pair"))
    sides = found.select(F.explode(F.array("a", "b")).alias("id"), rank.alias("r"))
    best = durable(
        sides.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.pair.a", "r.pair.b"))
    sets = full_sets(rows, best.select("id").unionByName(crowd), width)
    first = best.select("a", "b").distinct()
    links = durable(confirmed(first, sets, percent))
    joined = durable(components(links))
    more = apart(found.select("a", "b").join(first, ["a", "b"], "left_anti"), joined)
    links = durable(links.unionByName(confirmed(more, sets, percent)))

    # Crowded regions, where neighbours in order are but a part of the candidates, are joined exactly, as far as
    # the links of all neighbours have left them apart.
    if not crowd.isEmpty():
        joined = durable(components(links))
        placed = durable(
            crowd.join(joined.withColumnRenamed("node", "id"), "id", "left").join(sets, "id")
            .select("id", F.coalesce("root", "id").alias("root"), "packed"))
        links = links.unionByName(confirmed(crowds.pairs(placed, percent).distinct(), sets, percent))

    # Rows with one id but different sets tie these sets together.
    twice = member.groupBy("id").agg(F.min("head").alias("b"), F.max("head").alias("c")).filter("b <> c").select("id", "b")
    ties = member.join(twice, "id").select(F.col("head").alias("a"), "b")
    roots = durable(components(links.unionByName(ties)))
    final = durable(
        member.join(roots.withColumnRenamed("node", "head"), "head", "left")
        .groupBy("id").agg(F.min(F.coalesce("root", "head")).alias("root")))
    return (
        drawn.select("id", "n_shingles").join(final, "id", "left")
        .select(
            F.col("id").alias("doc_id"), "n_shingles", F.coalesce("root", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.col("root"), F.lit(True)).alias("kept"))
    )


def without_near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
) -> DataFrame:
    """The documents that stand for their component (see ``near_duplicates``); all columns stay.

    Rows that repeat a kept id all stay.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, width=width, percent=percent)
    gone = durable(found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs[doc_id].cast("long") == F.col("__gone"), "left_anti").select(docs.columns)
