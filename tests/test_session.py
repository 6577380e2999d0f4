import time

from pyspark.sql import functions as F

from citeweave import session


def _shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    counted = spark.range(10000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = session.durable(counted.join(spark.range(100).withColumnRenamed("id", "k").hint("merge"), "k"))
    until = time.time() + 30
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.5)
    assert not left
    assert kept.count() == 100 and kept.agg(F.sum("n")).first()[0] == 10000
    assert spark.conf.get(session.CLEANUP) == "false"


def test_a_failed_write_leaves_the_session_as_it_was(spark):
    failing = spark.range(10).select(F.raise_error(F.lit("no")).alias("x"))
    try:
        session.durable(failing)
    except Exception as e:
        assert "no" in str(e)
    else:
        raise AssertionError("the write should fail")
    assert spark.conf.get(session.CLEANUP) == "false"
