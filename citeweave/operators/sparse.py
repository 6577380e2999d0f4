"""Lexical index: BM25 (Okapi) statistics, scores and exact top-k by blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from citeweave.functions import text as T
from citeweave.session import durable

K1 = 1.5
B = 0.75
EPSILON = 0.25
#: Postings, and words of queries, that one task holds; and the fewest postings for which a block of its own pays.
BLOCK, LEAST = 1 << 21, 1 << 16


@dataclass(frozen=True)
class Corpus:
    """Corpus-wide numbers: two scalars and the idf of a word from its frequency."""

    n_docs: int
    avg_len: float
    floor: float

    def raw_idf(self, df: Column) -> Column:
        return F.log(F.lit(self.n_docs) - df + 0.5) - F.log(df + 0.5)

    def idf(self, df: Column) -> Column:
        raw = self.raw_idf(df)
        return F.when(raw < 0, F.lit(self.floor)).otherwise(raw)


def corpus_stats(docs: DataFrame, doc_id: str, body: str) -> tuple[DataFrame, Corpus]:
    """Return ``(terms(term, df), corpus)``.

    Negative idf is floored at ``EPSILON`` times the mean idf. Only three scalars
    reach the driver; document frequencies come from partial aggregates, so a
    frequent word costs one row per map task.
    """
    toks = docs.select(T.words(F.col(body)).alias("toks"))
    terms = durable(
        toks.select(F.explode(F.array_distinct("toks")).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    )
    size = toks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("toks")).alias("len")).first()
    corpus = Corpus(size["n"], size["len"] or 0.0, 0.0)
    mean = terms.agg(F.avg(corpus.raw_idf(F.col("df"))).alias("m")).first()["m"]
    return terms, Corpus(corpus.n_docs, corpus.avg_len, EPSILON * (mean or 0.0))


def query_terms(queries: DataFrame, query_id: str, body: str) -> DataFrame:
    """``(query_id, term, qtf)``: repeated query words count repeatedly."""
    return (
        queries.select(query_id, F.explode(T.words(F.col(body))).alias("term"))
        .groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


def postings(docs: DataFrame, doc_id: str, body: str, vocab: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, len)`` restricted to the words some query uses.

    Texts are dealt out by document before their words are counted: a text is far shorter
    than its postings, and a document's words then meet without another shuffle.
    """
    toks = docs.select(doc_id, F.col(body).alias("_body")).repartition(doc_id).select(doc_id, T.words(F.col("_body")).alias("toks"))
    return (
        toks.select(doc_id, F.size("toks").alias("len"), F.explode("toks").alias("term"))
        .join(vocab, "term", "left_semi")
        .groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    )


def weight(avg_len: float) -> Column:
    tf, length = F.col("tf"), F.col("len")
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(avg_len)))


def topk(
    docs: DataFrame, doc_id: str, body: str,
    queries: DataFrame, query_id: str, query_body: str, k: int, fill: bool = True,
) -> DataFrame:
    """Best ``k`` documents per query by BM25: ``(query_id, doc_id, score, rank)``.

    Ties go to the smaller id, and documents without any query word fill up short
    lists with score 0.
    """
    terms, corpus = corpus_stats(docs, doc_id, body)
    qt = durable(
        query_terms(queries, query_id, query_body).join(terms, "term")
        .withColumn("idf", corpus.idf(F.col("df")))
    )
    vocab = qt.select("term", "idf").distinct()
    weighted = postings(docs, doc_id, body, vocab.select("term")).join(vocab, "term") \
        .select(doc_id, "term", weight(corpus.avg_len).alias("w"))
    best = block_topk(qt.select(query_id, "term", F.col("qtf").alias("qw"), "df"), weighted, query_id, doc_id, k)
    return pad(durable(best), docs, doc_id, queries, query_id, k) if fill else best


def _best_of_block(query_id: str, doc_id: str, k: int, schema: pa.Schema):
    """The ``k`` best documents of one block of postings for each query of one block of queries."""
    def codes(column: pa.ChunkedArray) -> np.ndarray:
        return pc.rank(column, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64) - 1

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        if not asks.num_rows or not rows.num_rows:
            return schema.empty_table()
        vocab = pc.unique(asks["term"].combine_chunks())
        rows = rows.filter(pc.is_in(rows["term"], vocab))
        if not rows.num_rows:
            return schema.empty_table()
        term = pc.index_in(rows["term"], vocab).to_numpy()
        order = np.argsort(term, kind="stable")
        doc = codes(rows[doc_id])
        at = np.empty(doc.max() + 1, dtype=np.int64)
        at[doc] = np.arange(len(doc))
        start = np.searchsorted(term[order], np.arange(len(vocab) + 1))
        doc, w = doc[order], rows["w"].to_numpy()[order]

        query = codes(asks[query_id])
        by_query = np.argsort(query, kind="stable")
        of, qw = pc.index_in(asks["term"], vocab).to_numpy()[by_query], asks["qw"].to_numpy()[by_query]
        ends = np.searchsorted(query[by_query], np.arange(query.max() + 2))
        score, met = np.zeros(len(at)), np.zeros(len(at), dtype=bool)
        asked, found, value = [], [], []
        for q in range(len(ends) - 1):
            for i in range(ends[q], ends[q + 1]):
                part = slice(start[of[i]], start[of[i] + 1])
                score[doc[part]] += qw[i] * w[part]
                met[doc[part]] = True
            hit = np.flatnonzero(met)
            full = score[hit]
            score[hit], met[hit] = 0.0, False
            if len(hit) > k:
                # Documents stand in the order of their ids, so the first of equal ones win.
                key = np.round(full, 9)
                least = np.partition(key, len(key) - k)[len(key) - k]
                above = np.flatnonzero(key > least)
                best = np.concatenate([above, np.flatnonzero(key == least)[:k - len(above)]])
                hit, full = hit[best], full[best]
            asked.append(np.full(len(hit), by_query[ends[q]]))
            found.append(hit)
            value.append(full)
        return pa.Table.from_arrays(
            [asks[query_id].take(pa.array(np.concatenate(asked))), rows[doc_id].take(pa.array(at[np.concatenate(found)])),
             pa.array(np.concatenate(value))], schema=schema)

    return run


def block_topk(qt: DataFrame, weighted: DataFrame, query_id: str, doc_id: str, k: int) -> DataFrame:
    """Exact top-k of ``sum(qw * w)`` over shared words: ``(query_id, doc_id, score, rank)``.

    ``qt(query_id, term, qw, df)`` holds a word of a query once and is read several times,
    so callers materialise it; ``weighted(doc_id, term, w)`` holds a word of a document once and is
    read once. Postings are dealt into blocks of documents and queries into blocks of queries, so
    that a task meets about ``BLOCK`` rows of each; it adds up the scores of one
    query at a time and passes on its own k best, which is lossless because a global winner
    wins inside its block too. So no (query, document) pair is shuffled but the winners.
    """
    spark = qt.sparkSession
    qt = qt.filter(F.col(query_id).isNotNull())
    asked = qt.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # Every posting of a word counts one document, so the frequencies give the number of postings.
    held = qt.groupBy("term").agg(F.max("df").alias("df")).agg(F.sum("df").alias("n")).first()["n"] or 0
    sides = max(1, -(-asked // BLOCK))
    blocks = max(1, -(-held // BLOCK), min(spark.sparkContext.defaultParallelism, held // LEAST))

    def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    asks = dealt(qt.select(query_id, "term", F.col("qw").cast("double").alias("qw")), query_id, "_side", sides, "_block", blocks)
    rows = dealt(weighted.select(doc_id, "term", "w"), doc_id, "_block", blocks, "_side", sides)
    rows, asks = (d.withColumns({c: F.col(c).cast("long") for c in ("_block", "_side")}) for d in (rows, asks))
    fields = ST.StructType([
        ST.StructField(query_id, qt.schema[query_id].dataType), ST.StructField(doc_id, weighted.schema[doc_id].dataType),
        ST.StructField("score", ST.DoubleType())])
    best = asks.groupBy("_block", "_side").cogroup(rows.groupBy("_block", "_side")).applyInArrow(
        _best_of_block(query_id, doc_id, k, to_arrow_schema(fields)), fields)
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), F.asc(doc_id))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pad(best: DataFrame, docs: DataFrame, doc_id: str, queries: DataFrame, query_id: str, k: int) -> DataFrame:
    """Fill lists shorter than ``k`` with zero-score documents in corpus order."""
    have = best.groupBy(query_id).agg(F.count(F.lit(1)).alias("have"))
    short = (
        queries.select(query_id).join(have, query_id, "left")
        .withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < k)
    )
    # A short list misses fewer than k of the first 2k documents, so those suffice.
    front = [r[0] for r in docs.select(doc_id).orderBy(doc_id).limit(2 * k).collect()]
    fill = (
        short.withColumn(doc_id, F.explode(F.lit(front)))
        .join(best.select(query_id, doc_id), [query_id, doc_id], "left_anti")
        .withColumn("rank", F.col("have") + F.row_number().over(
            Window.partitionBy(query_id).orderBy(doc_id)))
        .filter(F.col("rank") <= k)
        .select(query_id, doc_id, F.lit(0.0).alias("score"), F.col("rank").cast("int"))
    )
    return best.unionByName(fill)
