"""Tables that keep state between runs: chunks, graph, cache, ledger, audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators import keyed


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """An existing parquet table, or no rows of the same shape."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return like.limit(0)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Identifier from source and position, stable across re-ingestion."""
    return chunks.withColumn("chunk_id", F.concat_ws("_", "source", F.col("chunk_index").cast("string")))


def insert_new(rows: DataFrame, path: str, key: str, partition_by: list[str] | None = None) -> DataFrame:
    """Append only rows whose key the table does not hold; returns what was added."""
    have = read_or_empty(rows.sparkSession, path, rows)
    fresh = rows.dropDuplicates([key]).join(have.select(key), key, "left_anti")
    writer = fresh.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return fresh


def upsert(rows: DataFrame, path: str, new_path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Merge rows into a table, newest wins, as a new version beside the old one."""
    old = read_or_empty(rows.sparkSession, path, rows)
    keyed.latest(old.unionByName(rows), keys, order).write.mode("overwrite").parquet(new_path)
    return rows.sparkSession.read.parquet(new_path)


def cache_key(*parts: Column, version: str = "v4") -> Column:
    """Digest of versioned parts, so that a new version never meets old entries."""
    return F.sha2(F.concat_ws("|", F.lit(version), *parts), 256)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link form as JSON lines, one folder for nodes and one for edges."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def import_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read a node-link document; ``links`` and ``node_id`` are accepted spellings."""
    doc = spark.read.option("multiLine", True).json(path)
    edges = "edges" if "edges" in doc.columns else "links"
    nodes = doc.select(F.inline("nodes"))
    nodes = nodes.withColumnRenamed("id", "node_id") if "id" in nodes.columns else nodes
    return nodes, doc.select(F.inline(edges))


def audit_events(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """Latest audit events of a JSON-lines folder; malformed lines are skipped."""
    schema = "type string, timestamp string, payload string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path) \
        .filter("type IS NOT NULL").orderBy(F.desc("timestamp")).limit(limit)


def audit(rows: DataFrame, kind: str, payload: Column, path: str) -> None:
    """Append one audit event per row."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    rows.select(F.lit(kind).alias("type"), stamp.alias("timestamp"), payload.alias("payload")) \
        .write.mode("append").json(path)


def keep_vectors(rows: DataFrame, vec: str, width: int = 768) -> DataFrame:
    """Only complete paper vectors enter the embedding table."""
    return rows.filter(F.size(vec) == width)


def local_papers(spark: SparkSession, folder: str, done: DataFrame, key: str = "path") -> DataFrame:
    """PDF files of a folder that were not ingested yet, as binary rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.join(done.select(key), key, "left_anti")
