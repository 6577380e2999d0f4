"""Token counts: a two-tier lookup on the map side.

A subword tokenizer that never merges across a blank gives a text as many tokens
as its pre-tokens have in sum, so a count needs no encoding of the whole text, only
the length of each pre-token. Tier one is a compact table of the lengths of
frequent pre-tokens, broadcast to all tasks; tier two is a bounded cache of each
Python worker, which encodes what it has not met. No pre-token is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeweave.llm.common import out_schema, record, slices, texts, worker_state

#: A pre-token: its leading blanks and what follows up to the next blank.
_UNIT = re.compile(" +[^ ]*")


def pretokens(text: str) -> list[str]:
    """Pre-tokens without their first blank, which the tokenizer itself puts in front.

    The tokenizer writes a blank as a block mark and starts each text with one; a
    mark that stands in the text means the same, so both are read as blanks.
    """
    if not text:
        return []
    text = text.replace("▁", " ")
    spaced = " " + text
    if "  " in spaced or spaced[-1] == " ":
        return [u[1:] for u in _UNIT.findall(spaced)]
    return text.split(" ")


class Lengths:
    """Lengths of pre-tokens: the broadcast table, then the worker's own two generations of cache."""

    def __init__(self, model: bytes, frequent: dict[str, int], cache: int, longest: int):
        from sentencepiece import SentencePieceProcessor

        state = worker_state("piece_lengths")
        if state.get("model") != model:
            state.clear()
            state.update(model=model, sp=SentencePieceProcessor(model_proto=model), new={}, old={})
        self.state, self.frequent, self.cache, self.longest = state, frequent, cache, longest

    def encode(self, units: list[str]) -> list[int]:
        # The empty unit is a single blank at the end of a text: one mark, one token.
        return [len(ids) if u else 1 for u, ids in zip(units, self.state["sp"].encode(units, num_threads=1), strict=True)]

    def count(self, text: str) -> int:
        units = pretokens(text)
        known = list(map(self.frequent.get, units))
        total = sum(n for n in known if n is not None)
        missed = [u for u, n in zip(units, known, strict=True) if n is None]
        if not missed:
            return total
        new, old = self.state["new"], self.state["old"]
        lengths = list(map(new.get, missed))
        fresh: dict[str, None] = {}
        for i, n in enumerate(lengths):
            if n is None:
                n = old.get(missed[i])
                if n is None:
                    fresh[missed[i]] = None
                else:
                    new[missed[i]] = lengths[i] = n
        if fresh:
            units = list(fresh)
            got = dict(zip(units, self.encode(units), strict=True))
            new.update((u, n) for u, n in got.items() if len(u) <= self.longest)
            lengths = [got[u] if n is None else n for u, n in zip(missed, lengths, strict=True)]
            if len(new) > self.cache:
                self.state["old"], self.state["new"] = new, {}
        return total + sum(lengths)


def frequent_pretokens(docs: DataFrame, text: str, sample_docs: int, per_task: int, size: int) -> list[str]:
    """Frequent pre-tokens of a random sample of about ``sample_docs`` documents.

    Each task hands over the ``per_task`` most frequent pre-tokens of its part of
    the sample, so what reaches the driver is bounded by the two parameters. The
    list only decides what is looked up where; counts never depend on it.
    """
    n = docs.select(text).count()
    if not n:
        return []
    sample = docs.select(F.col(text).alias("text")).sample(min(1.0, sample_docs / n), seed=11)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for t in texts(batch):
                counts.update(u for u in pretokens(t) if len(u) <= 32)
        best = [(u, c) for u, c in counts.most_common(per_task) if c > 1]
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in best], pa.string()), pa.array([c for _, c in best], pa.int64())], ["u", "c"])

    total: Counter = Counter()
    for row in sample.mapInArrow(tally, "u string, c long").toLocalIterator():
        total[row["u"]] += row["c"]
    return [u for u, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


def token_counts(
    docs: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 4096,
    frequent: int = 1 << 15, sample_docs: int = 4096, per_task: int = 2048, cache: int = 1 << 18, longest: int = 64,
) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit`` for a piece model file.

    ``n_tokens`` equals what the tokenizer library gives for the whole text without
    begin, end or other special tokens. ``over_limit`` is ``n_tokens > limit``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each
    by itself, a null id is passed on, other columns are ignored, an empty table
    gives no rows. Pre-tokens longer than ``longest`` characters are encoded but not
    cached; a worker keeps at most twice ``cache`` others.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    units = frequent_pretokens(docs, text, sample_docs, per_task, frequent)
    table = dict(zip(units, Lengths(model, {}, 0, 0).encode(units), strict=True)) if units else {}
    shared = docs.sparkSession.sparkContext.broadcast((model, table))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = None
        for batch in slices(batches):
            lengths = lengths or Lengths(*shared.value, cache, longest)
            got = texts(batch)
            yield record(
                batch, ["doc_id"],
                n_bytes=np.asarray([len(t.encode("utf-8")) for t in got], dtype=np.int64),
                n_tokens=np.asarray([lengths.count(t) for t in got], dtype=np.int64))

    counted = narrow.mapInArrow(run, out_schema(narrow, ["doc_id"], n_bytes=T.LongType(), n_tokens=T.LongType()))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
