"""Bibliographic search APIs as a Spark data source, and their normal forms.

There is no network here, so the transport is named by the caller as
``module:function``; it receives ``(query, cursor, page_size)`` and returns
``(list of JSON strings, next cursor)``.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIES = 3


class _QueryPartition(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.limit = int(options.get("limit", "25"))
        self.page = int(options.get("pagesize", "25"))
        self.pause = float(options.get("mininterval", "0.15"))
        self.transport = options["transport"]

    def partitions(self):
        return [_QueryPartition(q) for q in self.queries]

    def _call(self, fetch, query: str, cursor: str, size: int):
        for attempt in range(RETRIES):
            try:
                time.sleep(self.pause)
                return fetch(query, cursor, size)
            except (ConnectionError, TimeoutError):
                if attempt == RETRIES - 1:
                    return [], cursor
                time.sleep(2 ** attempt * self.pause)
        return [], cursor

    def read(self, partition) -> Iterator[tuple]:
        """Follow the cursor until it repeats, a page is empty, or the limit is met."""
        module, name = self.transport.split(":")
        fetch = getattr(importlib.import_module(module), name)
        cursor, got = "*", 0
        while got < self.limit:
            rows, nxt = self._call(fetch, partition.query, cursor, min(self.page, self.limit - got))
            for body in rows:
                yield (partition.query, got, body)
                got += 1
                if got >= self.limit:
                    return
            if not rows or nxt == cursor:
                return
            cursor = nxt


class PaperSearch(DataSource):
    """``spark.read.format("paper_search").option("queries", "a\\nb").option("transport", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return "search_term string, rank int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


def search(spark: SparkSession, queries: list[str], transport: str, limit: int = 25, **options: str) -> DataFrame:
    """Raw answers of one provider, one partition per query."""
    spark.dataSource.register(PaperSearch)
    reader = spark.read.format("paper_search").option("queries", "\n".join(queries)) \
        .option("transport", transport).option("limit", str(limit))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def open_access(query: str) -> str:
    """Restrict a query to open-access papers on the provider's side."""
    return f"({query}) AND OPEN_ACCESS:Y"


def _json(path: str) -> Column:
    return F.coalesce(F.get_json_object("body", path), F.lit(""))


def archive_papers(raw: DataFrame) -> DataFrame:
    """Normal form of the literature archive's records."""
    flag = lambda p: _json(p) == "Y"
    whole = lambda p: F.coalesce(_json(p).try_cast("int"), F.lit(0))
    return raw.select(
        "search_term", "rank", _json("$.doi").alias("doi"), _json("$.pmid").alias("pmid"),
        _json("$.pmcid").alias("pmcid"), F.trim(_json("$.title")).alias("title"),
        _json("$.authorString").alias("authors"), _json("$.journalTitle").alias("journal"),
        whole("$.pubYear").alias("year"), F.trim(_json("$.abstractText")).alias("abstract"),
        whole("$.citedByCount").alias("cited_by"), flag("$.isOpenAccess").alias("is_oa"),
        _json("$.source").alias("source"), (flag("$.inPMC") | flag("$.hasPDF")).alias("has_full_text"),
        F.trim(F.substring_index(_json("$.authorString"), ",", 1)).alias("first_author"))


def graph_papers(raw: DataFrame) -> DataFrame:
    """Normal form of the citation graph's records, at most ten authors."""
    arr = lambda p, t: F.from_json(F.get_json_object("body", p), t)
    names = F.transform(arr("$.authors", "array<struct<name:string>>"), lambda a: F.coalesce(a["name"], F.lit("")))
    return raw.select(
        "search_term", "rank", _json("$.paperId").alias("paper_id"), _json("$.title").alias("title"),
        _json("$.abstract").alias("abstract"), _json("$.tldr.text").alias("tldr"),
        _json("$.year").try_cast("int").alias("year"), _json("$.url").alias("url"),
        _json("$.externalIds.DOI").alias("doi"), _json("$.externalIds.PubMed").alias("pmid"),
        F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, 10).alias("authors"),
        _json("$.journal.name").alias("journal"), _json("$.citationCount").try_cast("int").alias("citation_count"),
        _json("$.openAccessPdf.url").alias("open_access_pdf"),
        F.coalesce(arr("$.publicationTypes", "array<string>"), F.array().cast("array<string>")).alias("pub_types"),
        arr("$.embedding.vector", "array<float>").alias("embedding"))


def discovery(raw: DataFrame) -> DataFrame:
    """Web hits: only ever a pointer to topics, never evidence."""
    return raw.select(
        "search_term", "rank", _json("$.title").alias("title"), _json("$.url").alias("url"),
        _json("$.snippet").alias("snippet"), F.lit("discovery").alias("source_type"))


def discovery_queries(hits: DataFrame, seeds: list[str], most: int = 6) -> list[str]:
    """Search queries from web hits: long titles, else snippets; padded by seeds."""
    title, snippet = F.trim("title"), F.trim("snippet")
    text = F.substring(F.when(F.length(title) >= 20, title).otherwise(snippet), 1, 200)
    cand = hits.select("search_term", "rank", text.alias("q")).filter(F.length("q") >= 20)
    first = cand.groupBy(F.lower("q").alias("k")).agg(F.min(F.struct("search_term", "rank", "q")).alias("r"))
    out = [r["q"] for r in first.select("r.*").orderBy("search_term", "rank").limit(most).collect()]
    if len(out) < 2:
        known = {q.lower() for q in out}
        for s in seeds:
            if s.lower() not in known:
                out.append(s)
            if len(out) >= 3:
                break
    return out[:most]


def resolve(by_doi: DataFrame, by_title: DataFrame, key: str) -> DataFrame:
    """Prefer the record found by DOI, then the first title hit."""
    both = by_doi.withColumn("_p", F.lit(0)).unionByName(by_title.withColumn("_p", F.lit(1)))
    rest = [c for c in both.columns if c not in (key, "_p", "rank")]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_p", "rank")).alias("r")).select(key, "r.*")


def pdf_location(candidates: list[tuple[str, Column]]) -> Column:
    """First available location with its origin, in order of preference."""
    out = None
    for origin, url in candidates:
        item = F.when(F.coalesce(url, F.lit("")) != "", F.struct(F.lit(origin).alias("origin"), url.alias("url")))
        out = item if out is None else F.coalesce(out, item)
    return out


def acceptable_pdf(content: Column) -> Column:
    """Real PDF bytes: magic number and more than a stub."""
    return (F.length(content) >= 1000) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))


def safe_filename(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"\s+", " "), 1, 150)
