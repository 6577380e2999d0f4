"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts come from a bounded, hash-chosen sample of labelled rows per
language. The matrix of log-probabilities (buckets x languages) has a fixed size
per language and is broadcast; a batch of texts is scored as one sparse product:
every n-gram of every text picks its row of the matrix, and the rows are summed by
text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import out_schema, record, slices, texts, worker_state

#: n-gram lengths in characters, and hash buckets.
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
#: Characters worked on at once.
SPAN = 1 << 18
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """True at each code point that is a letter."""
    state = worker_state("letters")
    if "table" not in state:
        state["table"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return state["table"]


def letters_of(text: str) -> np.ndarray:
    """Lower-cased code points; each run of other characters becomes one 0, also at both ends."""
    points = np.frombuffer(("\n" + text.lower() + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kept = np.where(letter_table()[points], points, 0).astype(np.uint32)
    gap = kept == 0
    return kept[~(gap & np.concatenate(([False], gap[:-1])))]


def buckets_of(points: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram of each order that ends at each position: (positions, orders); -1 where there is none.

    N-grams may begin with a word border but hold none inside, so that word
    beginnings and endings count and word pairs do not.
    """
    n = len(points)
    out = np.full((n, len(ORDERS)), -1, dtype=np.int32)
    h = np.zeros(n, dtype=np.uint32)
    inside = np.ones(n, dtype=bool)
    for k in range(1, max(ORDERS) + 1):
        back = np.zeros(n, dtype=np.uint32)
        back[k - 1:] = points[: n - k + 1] if k > 1 else points
        ok = np.arange(n) >= k - 1
        if 2 < k:  # what stood at the far end so far is now inside
            mid = np.zeros(n, dtype=bool)
            mid[k - 2:] = points[: n - k + 2] == 0
            inside &= ~mid
        h = (h ^ back) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        if k in ORDERS:
            good = ok & inside if k > 1 else points != 0
            slot = ((h * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int32)
            out[:, ORDERS.index(k)] = np.where(good, slot, -1)
    return out


def pieces(points: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of a text of any length, ``SPAN`` characters at a time."""
    overlap = max(ORDERS) - 1
    for start in range(0, len(points), SPAN):
        before = min(start, overlap)
        yield buckets_of(points[start - before: start + SPAN])[before:]


def train(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 4000,
    smooth: float = 0.5,
) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order, and log-probabilities as a (buckets + 1) x languages matrix.

    The last row holds the log-priors' place for missing n-grams and is 0. At most
    about ``per_lang`` labelled rows of each language are used, chosen by a hash of
    the id; languages with fewer rows use all of theirs. Rows without label or
    text are not used. All languages weigh alike, whatever their share.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("spot")).filter(
        "lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes, key=lambda s: s.encode("utf-8"))
    if not names:
        return [], np.zeros((BUCKETS + 1, 0), dtype=np.float32)
    # A row stays if its hash is under its language's share of 2^20.
    share = reduce(
        lambda other, n: F.when(F.col("lang") == n, F.lit(min(1 << 20, -(-per_lang * (1 << 20) // sizes[n])))).otherwise(other),
        names, F.lit(0))
    chosen = rows.filter(F.pmod("spot", F.lit(1 << 20)) < share).select("lang", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for name, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                own = counts.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                for got in pieces(letters_of(t)):
                    own += np.bincount(got[got >= 0], minlength=BUCKETS)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    summed = chosen.mapInArrow(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((BUCKETS, len(names)))
    place = {n: i for i, n in enumerate(names)}
    table = summed.toPandas()  # at most BUCKETS rows per language
    counts[table["bucket"].to_numpy(), table["lang"].map(place).to_numpy()] = table["n"].to_numpy()
    prob = (counts + smooth) / (counts.sum(axis=0) + smooth * BUCKETS)
    return names, np.vstack([np.log(prob), np.zeros((1, len(names)))]).astype(np.float32)


def score(batch_texts: list[str], names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    sums = np.zeros((len(batch_texts), max(1, len(names))))
    has = np.zeros(len(batch_texts), dtype=bool)
    rows: list[np.ndarray] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if rows:
            flat = np.concatenate(rows)
            starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
            sums_of = np.add.reduceat(matrix[flat].astype(np.float64), starts, axis=0)
            np.add.at(sums, owner, sums_of)
            rows.clear(), owner.clear()
            held = 0

    for i, t in enumerate(batch_texts):
        points = letters_of(t)
        has[i] = bool((points != 0).any())
        if has[i] and names:
            for got in pieces(points):
                got = got[got >= 0]
                if len(got):
                    rows.append(got)
                    owner.append(i)
                    held += len(got)
                if held >= SPAN:
                    flush()
    flush()
    if not names:
        return [UNKNOWN] * len(batch_texts), np.zeros(len(batch_texts))
    best = sums.argmax(axis=1)
    post = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, post, 0.0)


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], *, doc_id: str = "doc_id", text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``doc_id, <keep>, lang_pred, score``: the language of every whole text.

    ``und`` with score 0 is given to a null text, a text without a letter, and to
    every text if no language was learned. Ties go to the first language by code
    point. Rows are judged one by one, so repeated rows and null ids pass through;
    other columns are ignored unless named in ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(keep or []))
    passed = ["doc_id", *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pred, post = score(texts(batch), *shared.value)
            yield record(batch, passed, lang_pred=pa.array(pred, pa.string()), score=post)

    return narrow.mapInArrow(run, out_schema(narrow, passed, lang_pred=T.StringType(), score=T.DoubleType()))


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.5) -> DataFrame:
    """Documents with a language: those not ``und`` whose posterior is at least ``least``; all columns stay.

    Half of the posterior is the point below which the other languages together are
    likelier than the one predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pred, post = score(texts(batch), *shared.value)
            good = np.asarray([p != UNKNOWN for p in pred], dtype=bool) & (post >= least)
            yield batch.filter(pa.array(good)).select(columns)

    return docs.mapInArrow(run, docs.schema)
