"""Event-time windows, joins by time and keyed stream state against plain versions, with late rows, restarts and a hot key."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from citeweave.operators import temporal
from citeweave.streaming import supervision, windows

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def frame(spark, rows, key="u"):
    return spark.createDataFrame([(k, at(m), v) for k, m, v in rows], f"{key} string, ts timestamp, v long").coalesce(1)


def test_late_rows_are_counted_apart_and_restart_adds_nothing(spark, tmp_path):
    batches = [
        frame(spark, [("a", 1, 1), ("a", 2, 1), ("b", 70, 1)]),
        frame(spark, [("a", 3, 10), ("a", 65, 1), ("b", 150, 1)]),  # minute 3 is behind the watermark of minute 70 less ten
        frame(spark, [("a", 66, 5), ("c", 30, 7), ("b", 400, 1)]),  # minute 66 and 30 are behind that of minute 150
    ]
    make = lambda df: windows.windowed(df, "ts", windows.tumbling("ts", "1 hour"), ["u"], [F.sum("v").alias("v")], "10 minutes")
    paths = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    out = windows.replay(spark, batches, paths[0], make, paths[1], paths[2])
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    got = windows.with_late(make(every), out, ["u"], windows.watermark(every, "ts", "10 MINUTES"))
    rows = {(r["u"], r["window_start"].hour): (r["n"], r["v"], r["late"]) for r in got.collect()}
    assert rows == {("a", 0): (2, 2, 1), ("a", 1): (1, 1, 1), ("b", 1): (1, 1, 0), ("b", 2): (1, 1, 0), ("c", 0): (0, None, 1)}
    n = out.count()
    windows.drain(make(spark.readStream.schema(every.schema).parquet(paths[0])), paths[1], paths[2]).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == n


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    batches = [frame(spark, [("a", 0, 1), ("a", 8, 1), ("a", 30, 1)]), frame(spark, [("a", 300, 1)]), frame(spark, [("a", 9, 1), ("a", 301, 1)])]
    make = lambda df: windows.windowed(df, "ts", windows.session("ts", "10 minutes"), ["u"], [], "0 seconds")
    out = windows.replay(spark, batches, str(tmp_path / "in"), make, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r["window_start"], r["window_end"], r["n"]) for r in out.collect()) == [(at(0), at(18), 2), (at(30), at(40), 1)]


def hot_rows(n, seed):
    """One user holds nine tenths of the rows; times tie."""
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 9 + ["x", "y", None]), rng.randrange(0, 2000), i) for i in range(n)]


def test_asof_with_a_hot_key(spark):
    left, right = hot_rows(400, 1), hot_rows(120, 2)
    left.append(("alone", 5, 9_999))
    a = spark.createDataFrame([(k, at(m), i) for k, m, i in left] + [("hot", None, 10_000)], "u string, ts timestamp, i long")
    b = spark.createDataFrame([(k, at(m), i, i * 10) for k, m, i in right], "u string, ts timestamp, i long, w long")
    b = b.withColumn("j", F.col("i"))
    for blocks in (1, 7, 64):
        got = {r["i"]: (r["r_j"], r["r_w"]) for r in temporal.asof(a, b, ["u"], "ts", "ts", "i", ["j", "w"], "r_", blocks).collect()}
        assert len(got) == len(left) + 1 and got[10_000] == (None, None)
        for k, m, i in left:
            best = max(((t, j) for u, t, j in right if u == k and k is not None and t <= m), default=None)
            assert got[i] == ((best[1], best[1] * 10) if best else (None, None))


def test_asof_splits_a_hot_key_into_blocks(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("u"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), F.col("id").alias("i"))
    placed = rows.repartitionByRange(8, "u", "ts", "i").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) == 8 and max(r["count"] for r in placed) < 1000


def test_within_meets_each_pair_once(spark):
    left, right = hot_rows(200, 3), hot_rows(200, 4)
    a = spark.createDataFrame([(k, at(m), i) for k, m, i in left], "u string, lt timestamp, li long")
    b = spark.createDataFrame([(k, at(m), i) for k, m, i in right], "u string, rt timestamp, ri long")
    for before, after in ((0, 0), (30, 5), (0, 90), (700, 900)):
        minute = 60_000_000
        got = sorted((r["li"], r["ri"]) for r in temporal.within(a, b, ["u"], "lt", "rt", before * minute, after * minute).collect())
        assert got == sorted((i, j) for k, m, i in left for u, t, j in right if k is not None and k == u and m - before <= t <= m + after)


def test_output_checks():
    def judged(text, step=7):
        out = supervision.Output()
        for i in range(0, len(text), step):
            out.add(text[i:i + step])
        return out.looping()

    varied = " ".join(f"w{i * 7919 % 9973}" for i in range(100))
    assert not judged(varied)
    assert judged("\n".join(f"line {i * 7919 % 9973} of it" for i in range(20)))
    assert not judged("\n".join(f"field {i}: {i * 7919 % 9973}" for i in range(40)))
    assert judged(varied + " Energy energy, energy" + " energy" * 8)
    assert judged(varied + " " + "-".join(["ab"] * 10))
    assert not judged(varied + " " + "-".join(["ab"] * 9 + ["cd"]))
    assert judged("".join(f"{i % 10}: abcdefghij klmnop " for i in range(400)))
    assert not judged("energy " * 10)


def test_supervisor_waits_for_its_turn(spark, tmp_path):
    supervision.state_store(spark)
    good = [f"tok{i * 7919 % 9973} " for i in range(60)]
    bad = good + ["energy "] * 40
    rows = [("good", i, t) for i, t in enumerate(good)] + [("bad", i, t) for i, t in enumerate(bad)] + [("gap", 1, "b"), ("gap", 0, "a"), ("gap", 3, "d")]
    df = spark.createDataFrame(rows, "stream_id string, seq long, token string")
    batches = [df.filter("seq % 2 = 1"), df.filter("seq % 2 = 0"), df.filter("seq < 5")]
    out = windows.replay(spark, batches, str(tmp_path / "in"), supervision.supervise, str(tmp_path / "out"), str(tmp_path / "ck"))
    last = {}
    for r in sorted(out.collect(), key=lambda r: (r["seen"], -r["waiting"])):
        last[r["stream_id"]] = (r["seen"], r["degraded"], r["stopped_at"] is not None, r["waiting"])
    assert last == {
        "good": (sum(map(len, good)), False, False, 0), "bad": (sum(map(len, bad)), True, True, 0), "gap": (2, False, False, 1)}
    whole = supervision.Output()
    looked, stopped = 0, None
    for token in bad:
        whole.add(token)
        if stopped is None and whole.seen - looked >= supervision.STEP:
            looked = whole.seen
            stopped = whole.seen if whole.looping() else None
    assert {r["stopped_at"] for r in out.collect() if r["stream_id"] == "bad"} - {None} == {stopped}


def test_output_keeps_a_sign_of_its_line():
    for text, sign in (("a word " * 500, "x"), ("  \n   ", ""), ("\nname: " + "value " * 500, ":"), ("a: b\nword", "x")):
        out = supervision.Output()
        for i in range(0, len(text), 7):
            out.add(text[i:i + 7])
        assert out.line == sign


def test_tokens_travel_packed():
    ids, seqs = ["a", "a", "b", None, "a"], [0, 4, 1, 2, None]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(seqs, pa.int64()), pa.array(["x", "", "\u00fc y", "z", None])], ["stream_id", "seq", "token"])
    rows = [r for b in supervision._pack(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    assert [(r["stream_id"], list(supervision._unpacked(r["seqs"], r["sizes"], r["tokens"]))) for r in rows] == [
        ("a", [(0, "x"), (4, "")]), ("b", [(1, "\u00fc y")]), (None, [(2, "z")]), ("a", [(-1, "")])]


def test_calibration_state_survives_restarts(spark, tmp_path):
    supervision.state_store(spark)
    rng = random.Random(9)
    waves = [(rng.choice("ab"), i, rng.randrange(0, 3), rng.randrange(0, 5), rng.randrange(5000, 20000), rng.random() < 0.6) for i in range(80)]
    df = spark.createDataFrame(waves, "model string, wave long, chunk_tokens long, output_tokens long, total long, passed boolean")
    batches = [df.filter(F.col("wave").between(20 * k, 20 * k + 19)) for k in range(4)]
    out = windows.replay(spark, batches, str(tmp_path / "in"), supervision.calibrate, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["model"]: r for r in sorted(out.collect(), key=lambda r: r["waves"])}
    for model in "ab":
        ratio, lower, upper = 0.5, 8000, 16384
        for m, _, chunk, output, total, passed in waves:
            if m == model:
                ratio = 0.8 * ratio + 0.2 * output / chunk if chunk and output else ratio
                pick = max if passed else min
                lower, upper = pick(lower, total), pick(upper, total)
        r = got[model]
        assert abs(r["output_ratio"] - ratio) < 1e-9 and (r["boundary_lower"], r["boundary_upper"]) == (lower, upper)
