"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse row x: one entry for each distinct hashed word (their squares sum to
one), one for each statistic of its structure, and one for each metadata column. Beside a
weight, every feature has ``FACTORS`` numbers; the weight of a pair of features is the product
of theirs. The sum over all pairs takes linear time, as it is half of the square of the sum
less the sum of the squares, factor by factor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import out_schema, record, slices, texts, worker_state

#: Buckets of hashed words, and factors of a feature.
BUCKETS = 1 << 15
FACTORS = 8
#: Standardised statistics beyond this many deviations count as this many.
CLIP = 4.0
#: Words whose buckets a worker remembers.
REMEMBERED = 1 << 19

STATISTICS = (
    "words", "bytes a word", "words a line", "distinct words", "distinct lines", "lower case", "capitals", "digits", "blanks", "signs",
    "words without letters", "signs inside words", "longest word", "most frequent word", "lines that end in a stop",
)


def _word_table() -> tuple[dict[bytes, int], np.ndarray]:
    """A worker's memory of word buckets, and the class of each byte: 1 lower case or non-ASCII, 2 upper, 3 digit, 4 blank, 5 sign."""
    state = worker_state("factorisation")
    if "kinds" not in state:
        kinds = np.full(256, 1, dtype=np.uint8)
        kinds[:128] = 5
        kinds[97:123], kinds[65:91], kinds[48:58] = 1, 2, 3
        kinds[[9, 10, 11, 12, 13, 32]] = 4
        state["kinds"], state["buckets"] = kinds, {}
    if len(state["buckets"]) > REMEMBERED:
        state["buckets"].clear()
    return state["buckets"], state["kinds"]


def statistics(raw: bytes, counts: list[int], kinds: np.ndarray) -> list[float]:
    """One number for each of ``STATISTICS``; a text without words has zeros. ``counts`` are those of its distinct words."""
    if not counts:
        return [0.0] * len(STATISTICS)
    kind = kinds[np.frombuffer(raw, dtype=np.uint8)]
    by = np.bincount(kind, minlength=6) / len(raw)
    solid = np.concatenate(([False], kind != 4, [False]))
    starts, ends = np.flatnonzero(solid[1:-1] & ~solid[:-2]), np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
    m = len(starts)
    unlettered = np.add.reduceat((kind <= 2).astype(np.int64), starts) == 0
    inside = (kind[1:-1] == 5) & (kind[:-2] != 4) & (kind[2:] != 4)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return [
        np.log1p(m), np.log1p(len(raw) / m), np.log1p(m / len(lines)), len(counts) / m, len(set(lines)) / len(lines),
        by[1], by[2], by[3], by[4], by[5], float(unlettered.mean()), float(inside.sum()) / m, np.log1p(float((ends - starts).max())),
        max(counts) / m, sum(line.rstrip()[-1:] in (b".", b"!", b"?", b":") for line in lines) / len(lines),
    ]


def describe(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets of all texts, how many each text has, and the statistics (texts x STATISTICS)."""
    known, kinds = _word_table()
    flat: list[int] = []
    sizes, stats = [], []
    for t in batch_texts:
        raw = t.encode("utf-8")
        words = raw.lower().split()
        tally: dict[bytes, int] = {}
        for w in words:
            tally[w] = tally.get(w, 0) + 1
        own = set()
        for w in tally:
            at = known.get(w)
            if at is None:
                at = known[w] = zlib.crc32(w) % BUCKETS
            own.add(at)
        flat.extend(sorted(own))
        sizes.append(len(own))
        stats.append(statistics(raw, list(tally.values()), kinds))
    return np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64), np.array(stats).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class Machine:
    """Weights by feature: word buckets, then statistics, then metadata columns.

    ``bias`` is a number, ``weights`` has one number and ``factors`` has ``FACTORS`` for each
    feature. ``mean`` and ``deviation`` standardise statistics and metadata numbers.
    """

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def scores(self, flat: np.ndarray, sizes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of word buckets and raw dense numbers."""
        return 1.0 / (1.0 + np.exp(-self._margins(flat, sizes, self.scaled(dense))[0]))

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        """Standardised numbers, clipped, so many that their squares sum to about one."""
        z = np.clip((dense - self.mean) / self.deviation, -CLIP, CLIP)
        return z / np.sqrt(max(1, dense.shape[1]))

    def _margins(self, flat: np.ndarray, sizes: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the rows, and their sums of factors times values."""
        words = len(self.weights) - z.shape[1]
        value = 1.0 / np.sqrt(np.maximum(sizes, 1))
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        linear = z @ self.weights[words:]
        sums = z @ self.factors[words:]
        squares = (z * z) @ (self.factors[words:] ** 2).sum(axis=1)
        if len(some):
            linear[some] += np.add.reduceat(self.weights[flat], starts) * value[some]
            own = self.factors[flat]
            sums[some] += np.add.reduceat(own, starts, axis=0) * value[some, None]
            squares[some] += np.add.reduceat((own * own).sum(axis=1), starts) * value[some] ** 2
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def learn(
    flat: np.ndarray, sizes: np.ndarray, dense: np.ndarray, label: np.ndarray, *, steps: int = 400, batch: int = 64, rate: float = 0.1,
    decay: float = 1e-4, seed: int = 1,
) -> Machine:
    """Fit to rows in the given order by logistic loss: adaptive gradient steps over small batches.

    The rows are gone through as often as at least ``steps`` steps take, and once at least.
    Without rows, or with only one label among them, the machine gives the share of
    label 1 (one half without rows) to every text.
    """
    rng = np.random.default_rng(seed)
    width = dense.shape[1]
    share = (label.sum() + 0.5) / (len(label) + 1.0)
    machine = Machine(
        float(np.log(share / (1.0 - share))), np.zeros(BUCKETS + width), rng.normal(0.0, 0.05, (BUCKETS + width, FACTORS)),
        dense.mean(axis=0) if len(dense) else np.zeros(width), np.maximum(dense.std(axis=0), 1e-6) if len(dense) else np.ones(width))
    if len(np.unique(label)) < 2:
        return Machine(machine.bias, machine.weights, np.zeros_like(machine.factors), machine.mean, machine.deviation)
    z = machine.scaled(dense)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    bias, bias_seen = machine.bias, 1e-8
    w_seen, f_seen = np.full(BUCKETS + width, 1e-8), np.full((BUCKETS + width, FACTORS), 1e-8)
    for _ in range(max(1, -(-steps * batch // len(label)))):
        for first in range(0, len(label), batch):
            rows = slice(first, min(first + batch, len(label)))
            ids, counts, part = flat[begins[rows.start]:begins[rows.stop]], sizes[rows], z[rows]
            machine = Machine(bias, machine.weights, machine.factors, machine.mean, machine.deviation)
            margin, sums = machine._margins(ids, counts, part)
            slope = (1.0 / (1.0 + np.exp(-margin)) - label[rows]) / len(counts)
            # d margin / d w = x and d margin / d v = x * (sums - v x), feature by feature.
            feature, place = np.unique(ids, return_inverse=True)
            row = np.repeat(np.arange(len(counts)), counts)
            x = (1.0 / np.sqrt(np.maximum(counts, 1)))[row]
            pull = slope[row] * x
            gw = np.bincount(place, pull, minlength=len(feature))
            gx = np.bincount(place, pull * x, minlength=len(feature))
            gf = np.stack([np.bincount(place, pull * sums[row, k], minlength=len(feature)) for k in range(FACTORS)], axis=1)
            dense_at = np.arange(BUCKETS, BUCKETS + width)
            at = np.concatenate([feature, dense_at])
            gw = np.concatenate([gw, slope @ part]) + decay * machine.weights[at]
            gx = np.concatenate([gx, slope @ (part * part)])
            gf = np.concatenate([gf, (part * slope[:, None]).T @ sums]) - gx[:, None] * machine.factors[at] + decay * machine.factors[at]
            w_seen[at] += gw * gw
            f_seen[at] += gf * gf
            machine.weights[at] -= rate * gw / np.sqrt(w_seen[at])
            machine.factors[at] -= rate * gf / np.sqrt(f_seen[at])
            gb = float(slope.sum())
            bias_seen += gb * gb
            bias -= rate * gb / np.sqrt(bias_seen)
    return Machine(
        bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32), machine.mean, machine.deviation)


def _metadata(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Numeric metadata on a logarithmic scale with its sign; null and non-finite values count as 0."""
    out = np.zeros((batch.num_rows, len(columns)))
    for j, c in enumerate(columns):
        v = np.array([0.0 if x is None else float(x) for x in batch.column(batch.schema.get_field_index(c)).to_pylist()])
        v[~np.isfinite(v)] = 0.0
        out[:, j] = np.sign(v) * np.log1p(np.abs(v))
    return out


def fit(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = (),
    rows: int = 12_000,
) -> Machine:
    """A machine that tells label 1 from 0, from at most ``rows`` labelled documents chosen by a hash.

    ``labels`` holds ids and 0/1 labels; null ids and labels are left out, an id with
    several labels counts once with the more frequent one (ties: 1). About ``rows`` of the
    labelled ids are chosen by a hash of the id, and of the documents with these ids the
    first ``rows`` by a hash of id and text; so neither the ids that are sent to the
    documents nor what the driver fits grow with the corpus, whatever an id's share.
    """
    known = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label")))
    parts = 1 << 30
    share = min(parts, rows * parts // max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(parts)) < share)
    rows_of = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("spot"),
        *[F.col(c).cast("double").alias(f"meta_{j}") for j, c in enumerate(metadata)]).join(F.broadcast(chosen), "doc_id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, sizes, stats = describe(texts(batch))
            dense = np.hstack([stats, _metadata(batch, [f"meta_{j}" for j in range(len(metadata))])])
            words = np.split(flat.astype(np.uint16), np.cumsum(sizes)[:-1])
            yield record(
                batch, ["spot", "label"], words=pa.array([w.tobytes() for w in words], pa.binary()),
                dense=pa.array([d.tobytes() for d in dense], pa.binary()))

    table = (
        rows_of.mapInArrow(featurise, "spot long, label int, words binary, dense binary")
        .orderBy("spot", "label", "words").limit(rows).toArrow())
    width = len(STATISTICS) + len(metadata)
    words = [np.frombuffer(w, dtype=np.uint16) for w in table.column("words").to_pylist()]
    flat = np.concatenate(words).astype(np.int64) if words else np.zeros(0, dtype=np.int64)
    dense = np.frombuffer(b"".join(table.column("dense").to_pylist()), dtype=np.float64).reshape(-1, width)
    return learn(flat, np.array([len(w) for w in words], dtype=np.int64), dense, table.column("label").to_numpy().astype(np.float64))


def score(
    docs: DataFrame, machine: Machine, *, doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (),
    keep: list[str] | None = None,
) -> DataFrame:
    """``doc_id, <keep>, score``: the probability of label 1 for every whole text.

    ``metadata`` are the numeric columns the machine was fitted with. A null text is
    empty; texts without words are scored by their statistics, all zero, and metadata.
    Rows are scored one by one: null ids and repeated rows pass through, equal texts with
    equal metadata score alike, an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), *(keep or []), F.col(text).alias("_text"),
        *[F.col(c).cast("double").alias(f"_meta_{j}") for j, c in enumerate(metadata)])
    passed = ["doc_id", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, sizes, stats = describe(texts(batch, "_text"))
            dense = np.hstack([stats, _metadata(batch, [f"_meta_{j}" for j in range(len(metadata))])])
            yield record(batch, passed, score=shared.value.scores(flat, sizes, dense))

    return narrow.mapInArrow(run, out_schema(narrow, passed, score=T.DoubleType()))
