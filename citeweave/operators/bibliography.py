"""Matching of bibliographic records and library titles."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from citeweave.functions import text as T
from citeweave.session import durable

TITLE_MIN = 0.6
BATCH_BYTES = 32 << 20


def by_doi(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    """Exact DOI matches, then matches after removing URL prefixes: ``(matched, rest)``.

    Each step only sees what the step before left over. Several right records with
    one DOI are folded to the last one.
    """
    known = right.withColumn("k", T.doi_key(F.col("doi"))).filter("k <> ''").groupBy("k").agg(F.max(right_id).alias(right_id))
    exact = left.withColumn("k", T.doi_key(F.col("doi"))).join(known, "k") \
        .select(left_id, right_id, F.lit("doi_exact").alias("method"))
    rest = left.join(exact.select(left_id), left_id, "left_anti")
    clean = rest.withColumn("k", T.bare_doi(F.col("doi"))).filter(F.col("k") != T.doi_key(F.col("doi"))).join(known, "k") \
        .select(left_id, right_id, F.lit("doi_clean").alias("method"))
    return exact.unionByName(clean), rest.join(clean.select(left_id), left_id, "left_anti")


def title_jaccard(left: DataFrame, right: DataFrame, left_id: str, right_id: str, minimum: float = TITLE_MIN) -> DataFrame:
    """Title pairs with word Jaccard of at least ``minimum``: ``(left_id, right_id, jaccard)``.

    Exact set-similarity join. Words are ordered from rare to frequent; two titles
    that are similar enough share one of their first n - ceil(t*n) + 1 words, so only
    those prefixes are joined, frequent words hardly ever take part, and the size
    ratio is checked before any set is compared. Equal titles are folded beforehand.
    """
    def sets(df: DataFrame, key: str) -> DataFrame:
        w = F.array_distinct(T.words(T.match_key(F.col("title"))))
        return df.select(key, F.array_sort(w).alias("w")).filter(F.size("w") > 0)

    a, b = durable(sets(left, left_id)), durable(sets(right, right_id))
    # Each distinct set is written down with a number, which stands for it wherever words meet.
    number = F.monotonically_increasing_id()
    da = durable(a.select("w").distinct().select(number.alias("ka"), F.col("w").alias("wa")))
    db = durable(b.select("w").distinct().select(number.alias("kb"), F.col("w").alias("wb")))
    freq = da.select(F.explode("wa").alias("t")).unionByName(db.select(F.explode("wb").alias("t"))) \
        .groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(d: DataFrame, key: str, words: str, size: str) -> DataFrame:
        ranked = d.select(key, F.explode(words).alias("t")).join(freq, "t").groupBy(key).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda s: s["t"]).alias("o"))
        n = F.size("o")
        head = n - F.ceil(F.lit(minimum) * n - 1e-9).cast("int") + 1
        return ranked.select(key, n.alias(size), F.explode(F.slice("o", F.lit(1), head)).alias("t"))

    pa, pb = prefixes(da, "ka", "wa", "na"), prefixes(db, "kb", "wb", "nb")
    ratio = F.least("na", "nb") / F.greatest("na", "nb")
    hits = (
        pa.join(pb, "t").filter(ratio >= minimum - 1e-9).select("ka", "kb").distinct()
        .join(da, "ka").join(db, "kb").select("wa", "wb")
        .withColumn("jaccard", T.jaccard(F.col("wa"), F.col("wb"))).filter(F.col("jaccard") >= minimum)
    )
    return (
        hits.join(a.withColumnRenamed("w", "wa"), "wa").join(b.withColumnRenamed("w", "wb"), "wb")
        .select(left_id, right_id, "jaccard")
    )


class _Pool:
    """Titles side by side, so that one title meets all of them at once; the best is confirmed in full.

    A title's common characters in order are counted bit by bit for all titles together: each
    holds as many bits of one long integer as it has characters, and a spare one that takes
    its carry. No full comparison can find more of them than there are.
    """

    def __init__(self, ids: list, titles: list[str]) -> None:
        self.ids, self.titles = ids, titles
        self.lengths = np.asarray([len(t) for t in titles], dtype=np.int64)
        self.owners: dict[str, list[int]] = {}
        sets = [set(t.split()) for t in titles]
        for i, own in enumerate(sets):
            for w in own:
                self.owners.setdefault(w, []).append(i)
        self.sizes = np.asarray([len(own) for own in sets], dtype=np.int64)
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        row = np.frombuffer("\0".join([*titles, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        bits = lambda flags: int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        self.full = bits(row != 0)
        self.places = {chr(c): bits(row == c) for c in np.unique(row[row != 0])}

    def in_order(self, title: str) -> np.ndarray:
        """Length of the longest common subsequence with each title."""
        free = self.full
        for c in title:
            met = free & self.places.get(c, 0)
            if met:
                free = ((free + met) | (free - met)) & self.full
        size = int(self.lengths.sum()) + len(self.lengths)
        left = np.unpackbits(np.frombuffer(free.to_bytes(-(-size // 8), "little"), dtype=np.uint8), bitorder="little")
        return self.lengths - np.add.reduceat(left.astype(np.int64), self.starts)

    def best(self, title: str, minimum: float) -> tuple | None:
        """Id and similarity of the first title with the largest similarity, if that is large enough."""
        words = set(title.split())
        common = np.zeros(len(self.ids), dtype=np.int64)
        for w in words:
            common[self.owners.get(w, [])] += 1
        word = common / (len(words) + self.sizes - common)
        both = len(title) + self.lengths
        least = minimum - 1e-12
        most = np.maximum(word, 2.0 * np.minimum(len(title), self.lengths) / both)
        if not (most > least).any():
            return None
        if (most > word).any():
            most = np.maximum(word, 2.0 * self.in_order(title) / both)
        best, who = least, len(self.ids)
        at = np.flatnonzero(most > least)
        for i in at[np.argsort(-most[at], kind="stable")].tolist():
            if most[i] < best:
                break
            score = max(float(word[i]), SequenceMatcher(None, title, self.titles[i]).ratio())
            if score > best or (score == best and i < who and who < len(self.ids)):
                best, who = score, i
        return None if who == len(self.ids) else (self.ids[who], best)


def best_title(left: DataFrame, results: DataFrame, left_id: str, right_id: str, minimum: float = TITLE_MIN) -> DataFrame:
    """Best result per left title by the full similarity: ``(left_id, right_id, similarity)``.

    ``results`` is one provider's answer list. Its size is checked; a longer list is
    worked off in bounded slices whose winners are compared afterwards. Within a task,
    upper bounds for all results at once spare nearly all character-level comparisons.
    """
    right = results.select(right_id, T.match_key(F.col("title")).alias("t")).filter("t <> ''")
    size = right.agg(F.sum(F.length("t") + 64).alias("b")).first()["b"] or 0
    slices = max(1, -(-int(size) // BATCH_BYTES))
    schema = ST.StructType([left.schema[left_id], results.schema[right_id], ST.StructField("similarity", ST.DoubleType())])
    out = None
    for i in range(slices):
        rows = right.filter(F.pmod(F.xxhash64(right_id), F.lit(slices)) == i).orderBy(right_id).collect()
        if not rows:
            continue
        sent = left.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            pool = _Pool(*sent.value)
            for pdf in batches:
                known = {title: pool.best(title, minimum) for title in pdf["t"].unique()}
                found = [(key, *known[title]) for key, title in zip(pdf[left_id], pdf["t"]) if known[title]]
                yield pd.DataFrame(found, columns=[left_id, right_id, "similarity"])

        part = left.select(left_id, T.match_key(F.col("title")).alias("t")).filter("t <> ''").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return left.sparkSession.createDataFrame([], schema)
    return out.groupBy(left_id).agg(F.max_by(F.struct(right_id, "similarity"), F.col("similarity")).alias("b")) \
        .select(left_id, f"b.{right_id}", "b.similarity")


def match(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Cascade: exact DOI, cleaned DOI, best fuzzy title; ``(left_id, right_id, method)``."""
    sure, rest = by_doi(left, right, left_id, right_id)
    fuzzy = best_title(rest, right, left_id, right_id).select(
        left_id, right_id, F.concat(F.lit("title_fuzzy_"), F.format_string("%.2f", "similarity")).alias("method"))
    return sure.unionByName(fuzzy)


def coverage(matched: DataFrame, left: DataFrame, left_id: str) -> DataFrame:
    """Share of records found in the other index, in percent."""
    flags = left.select(left_id).join(matched.select(left_id, "method"), left_id, "left")
    return flags.agg(
        F.count(F.lit(1)).alias("total"), F.count("method").alias("matched"),
        F.count_if(F.startswith("method", F.lit("doi"))).alias("by_doi"),
        F.round(100 * F.count("method") / F.count(F.lit(1)), 1).alias("coverage_pct"))
