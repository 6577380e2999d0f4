"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The probability of a token is that of its class given the two classes before it,
times its share of the class. The most frequent tokens are classes of their own; all
others fall into classes by their last two bytes, where a token's share is its
smoothed count. The class model is log-bilinear: the context vector is a weighted sum
of the vectors of the two classes before, and a class scores by its product with the
context plus a bias. Scores are normalised over all classes, so a text's tokens have
true probabilities.

Counts and vectors are of the whole training corpus: the rounds of the fit pass over every
training document, in shards whose parameters are averaged after each round. The number
of shards grows with the corpus, and a task streams its shard through blocks of positions.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import folded_words, slices, texts, worker_state
from citeweave.session import durable

#: Tokens that are classes of their own, classes of all others, and length of a vector.
TOP = 768
RARE = 256
CLASSES = TOP + RARE
WIDTH = 32
#: Frequent tokens whose counts are broadcast.
FREQUENT = 1 << 17
#: Shards at least, documents of a shard, rounds of averaging; positions of a block, in a step, noise samples of a step.
SHARDS = 8
SHARD_DOCS = 4096
ROUNDS = 4
BLOCK = 1 << 18
STEP = 256
NOISE = 64
#: Steps whose rows are put in order together.
AHEAD = 64
RATE = 0.15
#: Parts in which the parameters of a shard are added up.
PARTS = 16
#: Distinct tokens a task gathers before it hands them on; positions scored at once.
HELD = 1 << 19
SPAN = 1 << 15
END = b""


def rare_class(word: bytes) -> int:
    return TOP + zlib.crc32(word[-2:]) % RARE


def token_counts(train: DataFrame) -> DataFrame:
    """``word, cls, c``: how often each token, the end among them, occurs in the training texts."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([rare_class(w) for w in words], pa.int32()),
                 pa.array(list(held.values()), pa.int64())], ["word", "cls", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for t in texts(batch):
                held.update(folded_words(t))
            held[END] += batch.num_rows
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    return durable(
        train.select("text").mapInArrow(tally, "word binary, cls int, n long").filter("n > 0").groupBy("word", "cls").agg(F.sum("n").alias("c")))


def frequent(counts: DataFrame) -> DataFrame:
    """At most ``FREQUENT`` of the most frequent tokens (and the end): all above a count that a histogram gives.

    The histogram has eight bins to the doubling, so a token left out has less than
    1.1 in ``FREQUENT`` of all training tokens.
    """
    bins = counts.groupBy(F.floor(8 * F.log2("c")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect()
    low, held = None, 0
    for b in sorted(bins, key=lambda b: -b["bin"]):
        held += b["n"]
        if held > FREQUENT - 1:
            break
        low = b["low"]
    return counts.filter((F.col("c") >= F.lit(low)) | (F.col("word") == F.lit(END)) if low else F.col("word") == F.lit(END))


class Vocabulary:
    """What every task needs of the counts: frequent tokens, and totals of the corpus and its classes."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens, self.types = int(total["n"] or 0), int(total["v"])
        rows = frequent(counts).toPandas()
        # The end is a class of its own wherever it ranks.
        rows["late"] = [w != END for w in map(bytes, rows["word"])]
        rows = rows.sort_values(["late", "c", "word"], ascending=[True, False, True], ignore_index=True)
        words, c = list(map(bytes, rows["word"])), rows["c"].to_numpy(dtype=np.int64)
        self.index = {w: i for i, w in enumerate(words)}
        self.log_c = np.log10(c + 1.0)
        own = np.arange(len(words))
        self.cls = np.where(own < TOP, own, rows["cls"].to_numpy(dtype=np.int64)).astype(np.int32)
        sums = counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()  # one row per class
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        n[sums["cls"]], v[sums["cls"]] = sums["n"], sums["v"]
        np.subtract.at(n, rows["cls"][:TOP], c[:TOP])
        np.subtract.at(v, rows["cls"][:TOP], 1)
        # Of a rare class every token, and one more for all unknown, has its count and one.
        self.class_total = np.concatenate([np.zeros(TOP), np.log10(n[TOP:] + v[TOP:] + 1)])
        mass = n + 1.0
        mass[:TOP] = 0.0
        mass[:min(TOP, len(c))] = c[:TOP] + 1.0
        self.noise = (mass / mass.sum()).astype(np.float64)
        self.end_log_c = float(self.log_c[self.index[END]]) if END in self.index else 0.0
        self.end_known = END in self.index

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each token among the frequent ones (-1: none) and its class."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        cls = self.cls[at] if len(self.cls) else np.zeros(len(at), dtype=np.int32)
        missed = np.flatnonzero(at < 0)
        cls[missed] = [rare_class(words[i]) for i in missed]
        return at, cls


def grouped(rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each line of ``rows``: its distinct values and what ``added`` needs to add up what belongs to each of them."""
    wide = rows.shape[1]
    by = np.argsort(rows.astype(np.uint16), axis=1, kind="stable")
    value = np.take_along_axis(rows, by, axis=1).ravel()
    new = np.concatenate(([True], value[1:] != value[:-1]))
    new[::wide] = True
    first = np.flatnonzero(new)
    size = np.diff(first, append=rows.size)
    by, value = by.ravel(), value[first]
    several = size > 1
    # Most values come once: only the others are added up. Offsets count from the line's own.
    again, many = np.flatnonzero(several), size[several]
    within = by[np.repeat(several, size)]
    lines = np.arange(len(rows) + 1)
    cut = np.searchsorted(first, lines * wide)
    cut_again, cut_within = np.searchsorted(again, cut), np.searchsorted(np.flatnonzero(np.repeat(several, size)), lines * wide)
    starts = np.cumsum(many) - many
    once = by[first]
    for i in range(len(rows)):
        own, more, inner = slice(cut[i], cut[i + 1]), slice(cut_again[i], cut_again[i + 1]), slice(cut_within[i], cut_within[i + 1])
        yield value[own], once[own], again[more] - cut[i], within[inner], starts[more] - cut_within[i]


def added(grad: np.ndarray, once: np.ndarray, again: np.ndarray, within: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rows of ``grad`` added up by the values that ``grouped`` found."""
    g = grad.take(once, axis=0)
    if len(again):
        g[again] = np.add.reduceat(grad.take(within, axis=0), starts, axis=0)
    return g


class Model:
    """Parameters of the class model."""

    def __init__(self, noise: np.ndarray):
        rng = np.random.default_rng(5)
        self.context = (0.1 * rng.standard_normal((CLASSES, WIDTH))).astype(np.float32)
        self.target = (0.1 * rng.standard_normal((CLASSES, WIDTH))).astype(np.float32)
        self.mix = np.ones((2, WIDTH), dtype=np.float32)
        self.bias = np.log(np.maximum(noise, 1e-12)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.mix, self.bias]

    def hidden(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.context[last] * self.mix[0] + self.context[before] * self.mix[1]

    def fresh_past(self) -> list[np.ndarray]:
        """Adagrad's sums of squares at the start of a shard."""
        return [np.full_like(p, 1e-2) for p in self.parameters()]

    def fit(
        self, last: np.ndarray, before: np.ndarray, word: np.ndarray, noise: np.ndarray, seed: int | np.random.Generator, rate: float,
        past: list[np.ndarray] | None = None,
    ) -> None:
        """One pass of noise-contrastive estimation over the positions, in random order, with Adagrad.

        Data are told from ``NOISE`` samples of the unigram distribution that a step shares. ``past`` goes on from block to block.
        """
        rng = np.random.default_rng(seed)
        past = self.fresh_past() if past is None else past
        edges = np.cumsum(noise)
        log_noise = np.log(NOISE * np.maximum(noise, 1e-12)).astype(np.float32)
        order = rng.permutation(len(word))
        parameters = self.parameters()

        def move(i: int, rows: np.ndarray, g: np.ndarray) -> None:
            """An Adagrad step on the rows, each there once, of one parameter."""
            sums = past[i].take(rows, axis=0)
            sums += g * g
            past[i][rows] = sums
            g *= rate
            g /= np.sqrt(sums, out=sums)
            g += parameters[i].take(rows, axis=0)
            parameters[i][rows] = g

        whole = len(order) // STEP * STEP
        for start in [*range(0, whole, STEP * AHEAD), *([whole] if whole < len(order) else [])]:
            wide = STEP if start < whole else len(order) - whole
            at = order[start:min(start + STEP * AHEAD, whole) if start < whole else None].reshape(-1, wide)
            k_all = np.minimum(np.searchsorted(edges, rng.random((len(at), NOISE))), CLASSES - 1).astype(word.dtype)
            c1_all, c2_all, w_all = last[at], before[at], word[at]
            seen, told = grouped(np.concatenate([c1_all, c2_all], axis=1)), grouped(np.concatenate([w_all, k_all], axis=1))
            for c1, c2, w, k, context_rows, target_rows in zip(c1_all, c2_all, w_all, k_all, seen, told, strict=True):
                x1, x2 = self.context.take(c1, axis=0), self.context.take(c2, axis=0)
                h = x1 * self.mix[0] + x2 * self.mix[1]
                qw, qk = self.target.take(w, axis=0), self.target.take(k, axis=0)
                up = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, qw) + self.bias.take(w) - log_noise.take(w)))  # 1 - P(data)
                down = log_noise.take(k) - h @ qk.T
                down -= self.bias.take(k)
                np.exp(down, out=down)
                down += 1
                np.divide(-1, down, out=down)  # -P(data) of noise
                dh = up[:, None] * qw + down @ qk
                mixed = np.stack([np.einsum("ij,ij->j", dh, x1), np.einsum("ij,ij->j", dh, x2)])
                move(0, context_rows[0], added(np.concatenate([dh * self.mix[0], dh * self.mix[1]]), *context_rows[1:]))
                move(1, target_rows[0], added(np.concatenate([up[:, None] * h, down.T @ h]), *target_rows[1:]))
                move(2, np.arange(2), mixed)
                move(3, target_rows[0], added(np.concatenate([up, down.sum(axis=0)]), *target_rows[1:]))

    def log10_norm(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The natural logarithm of the sum over all classes for each context, by one matrix product."""
        z = self.hidden(last, before) @ self.target.T + self.bias
        top = z.max(axis=1, keepdims=True)
        return (top[:, 0] + np.log(np.exp(z - top).sum(axis=1))).astype(np.float32)

    def log_probs(self, last: np.ndarray, before: np.ndarray, word: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities; ``norms`` keeps the sums of contexts met before."""
        code = before.astype(np.int64) * CLASSES + last
        new = np.unique(code[np.isnan(norms[code])])
        for start in range(0, len(new), 4096):
            part = new[start:start + 4096]
            norms[part] = self.log10_norm(part % CLASSES, part // CLASSES)
        out = np.empty(len(word))
        for start in range(0, len(word), SPAN):
            s = slice(start, start + SPAN)
            out[s] = np.einsum("ij,ij->i", self.hidden(last[s], before[s]), self.target[word[s]]) + self.bias[word[s]] - norms[code[s]]
        return out


def contexts(sequence: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last class, the one before, and the class to tell, for each position of a text that is closed by the end."""
    padded = np.concatenate([[end, end], sequence, [end]]).astype(np.int64)
    return padded[1:-1], padded[:-2], padded[2:]


def train(docs: DataFrame, vocabulary: Vocabulary) -> Model:
    """Fit the class model on all texts of (row, text).

    Every round passes over every document, whatever their number. The hash of a row deals the documents to
    shards, about ``SHARD_DOCS`` each. In a round every shard starts from the shared parameters and
    passes over its documents; the new ones are the mean over the shards, weighted by
    positions. They are added up by tasks, so that the driver gets one set of them
    whatever the number of shards.
    """
    spark = docs.sparkSession
    model = Model(vocabulary.noise)
    n = docs.count()
    if not n:
        return model
    end = vocabulary.index.get(END, 0)
    shared = spark.sparkContext.broadcast(vocabulary)
    noise = spark.sparkContext.broadcast(vocabulary.noise)
    shards = max(SHARDS, -(-n // SHARD_DOCS))
    rate_of = [RATE / (1 + turn) for turn in range(ROUNDS)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [shared.value.look_up(folded_words(t))[1].astype(np.int16).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.binary())], ["row", "classes"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed"), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(packed.as_buffer(), dtype=np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "packed"])

    encoded = durable(
        docs.select("row", "text").mapInArrow(encode, "row long, classes binary")
        .withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    kind = "part int, packed binary"
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(pickle.dumps(model))
        spread = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "row").select("shard", "classes")

        def fit(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            def learned(own: Model, size: int) -> pa.RecordBatch:
                flat = np.concatenate([[1.0], *(p.ravel() for p in own.parameters())]).astype(np.float64) * size
                parts = [x.tobytes() for x in np.array_split(flat, PARTS)]
                return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "packed"])

            def block() -> None:
                own.fit(*(np.concatenate(x) for x in zip(*held, strict=True)), noise.value, rng, rate_of[turn], past)
                held.clear()

            held: list[tuple] = []
            shard = own = None
            size = pending = 0
            for batch in slices(batches):
                for mine, packed in zip(batch.column("shard").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                    if mine != shard:
                        if held:
                            block()
                        if own is not None:
                            yield learned(own, size)
                        shard, own, size, pending = mine, pickle.loads(sent.value), 0, 0
                        past, rng = own.fresh_past(), np.random.default_rng([turn, mine])
                    held.append(contexts(np.frombuffer(packed, dtype=np.int16), end))
                    size += len(held[-1][2])
                    pending += len(held[-1][2])
                    if pending >= BLOCK:
                        block()
                        pending = 0
            if held:
                block()
            if own is not None:
                yield learned(own, size)

        # One row per part.
        got = spread.mapInArrow(fit, kind).repartition("part").mapInArrow(add, kind).toArrow().sort_by("part")
        flat = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.float64) for x in got.column("packed")])
        flat, at = flat[1:] / flat[0], 0
        for p in model.parameters():
            p[...] = flat[at:at + p.size].reshape(p.shape)
            at += p.size
    return model


def mapped_scores(docs: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """``row, doc_id, held_out, n_tokens, known, base, lm``: all but what the counts of infrequent tokens add."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    out = T.StructType([
        T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()),
        T.StructField("lm", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        state = worker_state("context_norms")
        mark = (id(shared.value), shared.value[1].bias.tobytes())
        if state.get("mark") != mark:
            state.clear()
            state.update(mark=mark, norms=np.full(CLASSES * CLASSES, np.nan, dtype=np.float32))
        end = vocabulary.index.get(END, 0)
        for batch in slices(batches):
            sizes, known, base, lm = [], [], [], []
            held: list[tuple] = []
            waiting: list[int] = []

            def flush() -> None:
                if held:
                    last, before, word = (np.concatenate(x) for x in zip(*held, strict=True))
                    got = model.log_probs(last, before, word, state["norms"]) / math.log(10)
                    starts = np.cumsum([0] + [len(h[2]) for h in held[:-1]])
                    for i, x in zip(waiting, np.add.reduceat(got, starts), strict=True):
                        lm[i] += float(x)
                held.clear(), waiting.clear()

            pending = 0
            for t in texts(batch):
                words = folded_words(t)
                at, cls = vocabulary.look_up(words)
                inside = at >= 0
                logs = np.where(inside, vocabulary.log_c[at], 0.0) if len(vocabulary.log_c) else np.zeros(len(at))
                sizes.append(len(words) + 1)
                known.append(int(inside.sum()) + vocabulary.end_known)
                base.append(float(logs.sum()) + vocabulary.end_log_c)
                lm.append(float((logs - vocabulary.class_total[cls])[cls >= TOP].sum()))
                held.append(contexts(cls, end)), waiting.append(len(lm) - 1)
                pending += len(words)
                if pending >= 1 << 19:
                    flush()
                    pending = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "held_out")), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(lm, pa.float64())], out.fieldNames())

    return durable(docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, out))


def infrequent(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``row, rare_log, rare_known``: what tokens outside the broadcast table add, by a join with their counts.

    A token outside the table has less than 1.1 in ``FREQUENT`` of all training tokens
    (see ``frequent``), so no key of the join is hot among them.
    """
    names = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary.index))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, words, n = [], [], []
            for i, t in enumerate(texts(batch)):
                own = Counter(w for w in folded_words(t) if w not in names.value)
                at += [i] * len(own)
                words += own.keys()
                n += own.values()
            if at:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(at)), pa.array(words, pa.binary()), pa.array(n, pa.int32())], ["row", "word", "n"])

    mine = docs.select("row", "text").mapInArrow(pick, "row long, word binary, n int")
    return mine.join(counts.select("word", "c"), "word").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("n").alias("rare_known"))


def scores(docs: DataFrame, held_out: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from rows whose boolean column ``held_out`` is false. Tokens are the words
    of the text, A-Z lower-cased, and one end. ``base_score`` is the smoothed unigram
    log10-probability, ``score`` the model's. A token is known if the training texts
    have it.

    A null or empty text is the end alone. Repeated rows score alike; a null id passes
    through; without training rows every token is unknown; an empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"),
        F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    learn = rows.filter("not held_out")
    counts = token_counts(learn)
    vocabulary = Vocabulary(counts)
    model = train(learn.select("row", "text"), vocabulary)
    mapped = mapped_scores(rows, vocabulary, model)
    # Rows with equal id and text share a key; what the join adds is summed over all of them.
    copies = mapped.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    rare = durable(infrequent(rows, counts, vocabulary))
    each = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    unit = math.log10(vocabulary.tokens + vocabulary.types + 1)
    return mapped.join(copies, "row").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + each("rare_known").cast("long")).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + each("rare_log") - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("lm") + each("rare_log")).alias("score"))
