import pytest
from pyspark.sql import functions as F

BASE = "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """Rows as (doc_id, text, source, lang), with extra columns whose names the operators use themselves."""
    def make(rows, parts: int = 3):
        rows = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(parts)
        for name in ("row", "size", "hash", "spans", "id", "n_tokens", "label", "keep", "item", "score"):
            df = df.withColumn(name, F.lit("clash"))
        return df
    return make


@pytest.fixture(scope="session")
def sample(spark):
    rows = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text", "source", "lang").collect()
    return [tuple(r) for r in rows]


#: Null id, null text, empty, blank, no letters, very long, ties, repeated rows.
ODD = [
    (None, None, None, None), (None, "some text here", "a", "en"), (1, None, "a", "en"), (2, "", None, "en"), (3, "  \n\t ", "b", None),
    (4, "12 34 !!", "b", "en"), (5, "the cat sat on the mat " * 30_000, "c", "en"), (6, "x" * 200_000, "c", "en"),
    (7, "the cat sat on the mat", "a", "en"), (8, "the cat sat on the mat", "b", "en"), (8, "the cat sat on the mat", "b", "en"),
    (9, "ein Hund läuft über die Straße", "a", "de"), (9, "und noch ein Hund", "a", "de"),
]
