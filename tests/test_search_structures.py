"""Pattern automata, the exact vector index and JSON repair against plain versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.functions.json_repair import repair
from citeweave.operators import metrics, patterns
from citeweave.operators.vector_index import VectorIndex, similar_pairs


def words(rng, n):
    return " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_occurring_in_shards(spark, most):
    rng = random.Random(1)
    names = list({words(rng, rng.randint(1, 2)) for _ in range(60)}) + [None, "", "zzz"]
    texts = [words(rng, 12) for _ in range(10)] + [None, ""] + ["aa " * 5000]
    p = spark.createDataFrame([(n,) for n in names], "name string")
    t = spark.createDataFrame([(x,) for x in texts], "t string").repartition(3)
    got = sorted(r["name"] for r in patterns.occurring(p, "name", t, "t", most).collect())
    assert got == sorted(n for n in names if n and any(x and n in x for x in texts))


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_covered_in_shards(spark, most):
    rng = random.Random(2)
    items = [(i, [words(rng, 3) for _ in range(rng.randint(0, 4))]) for i in range(80)] + [(99, None), (1, ["ab"])]
    texts = [words(rng, 10) for _ in range(12)] + [None]
    a = spark.createDataFrame(items, "i long, spans array<string>").repartition(4)
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    got = sorted(r["i"] for r in patterns.covered(a, ["i"], "spans", t, "t", most).collect())
    assert got == sorted({i for i, own in items if any(s in x for s in own or () for x in texts if x)})


def test_common_words_do_not_gather(spark):
    """Every claim has the same common words; no shuffle is keyed on them."""
    claims = spark.range(300).select("id", F.concat(F.lit("of the many things "), F.col("id").cast("string")).alias("c"))
    cross = spark.createDataFrame([("some of the many", ), ("things 17",)], "t string")
    got = metrics.span_coverage(claims, ["id"], "c", cross, "t")
    assert got.count() == 300
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8)) * 4
    x = np.round(centers[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) * 0.3, 3)
    x[250:280] = x[0]  # copies
    x[299] = 0.0
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "id long, v array<double>")


def test_nearest_equals_brute_force(spark, cloud, tmp_path):
    x, df = cloud
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "i"))
    probes = df.filter("id % 10 = 0").select(F.col("id").alias("p"), F.col("v").alias("q"))
    for k, radius in ((1, None), (7, None), (40, None), (5, 0.9), (400, None)):
        got = {}
        for r in index.nearest(probes, "p", "q", k, radius).collect():
            got.setdefault(r["probe"], {})[r["rank"]] = r["item"]
        for p in range(0, 300, 10):
            d = np.sqrt(((x - x[p]) ** 2).sum(1))
            order = [i for i in sorted(range(300), key=lambda i: (round(d[i], 9), i)) if radius is None or d[i] <= radius][:k]
            assert [got[p][n] for n in sorted(got[p])] == order
    read = index.parts_read(probes, "p", "q", k=3).agg(F.avg("parts_read")).first()[0]
    assert read < 0.6 * index.parts.count()


def test_within_and_pairs_equal_brute_force(spark, cloud, tmp_path):
    x, df = cloud
    index = VectorIndex.build(df, "id", "v", str(tmp_path / "i"), pivots=9)
    got = sorted((r["probe"], r["item"]) for r in index.within(df.filter("id < 20"), "id", "v", 1.2).collect())
    assert got == sorted((p, i) for p in range(20) for i in range(300) if np.sqrt(((x[p] - x[i]) ** 2).sum()) <= 1.2)
    pairs, member = similar_pairs(df, "id", "v", 0.995, str(tmp_path / "j"))
    of = {r["item"]: r["class"] for r in member.collect()}
    assert set(of) == set(range(299)) and {of[i] for i in range(250, 280)} == {0}
    reps = sorted(set(of.values()))
    unit = x[:299] / np.linalg.norm(x[:299], axis=1, keepdims=True)
    want = sorted((a, b) for n, a in enumerate(reps) for b in reps[n + 1:] if unit[a] @ unit[b] >= 0.995)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == want


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert VectorIndex.build(none, "id", "v", str(tmp_path / "e")).nearest(none, "id", "v", 3).collect() == []


def test_repair():
    assert repair('x {"a": [1, {"b": "te') == '{"a": [1, {"b": "te"}]}'
    assert json.loads(repair('{"a": 1, "b')) == {"a": 1, "b": None}
    assert json.loads(repair('{"a": 1, ')) == {"a": 1}
    assert json.loads(repair("{'it''s': 'x'}".replace("''", "\\'"))) == {"it's": "x"}
    assert json.loads(repair('{"a": fal')) == {"a": False} and json.loads(repair('{"a": 12.')) == {"a": 12}
    assert json.loads(repair('{"a": {"b": [1, [2,], ], }, }')) == {"a": {"b": [1, [2]]}}
    assert json.loads(repair('{"a": "say \\"hi')) == {"a": 'say "hi'}
    assert json.loads(repair('{"a": "cut\\')) == {"a": "cut"}
    assert json.loads(repair("{'q': 'a \"b\" c'}")) == {"q": 'a "b" c'}
    assert [repair(t) for t in (None, "", "none", "{object}", "[1", '{"a": 1]')] == [None] * 6


def test_repair_of_every_cut():
    """Whatever is cut off a valid object, what comes out is valid and begins alike."""
    whole = json.dumps({"name": "a \"b\" {c}", "list": [1, -2.5, True, None, {"x": []}], "in": {"k": "v, w: [y]", "n": 10}})
    for n in range(1, len(whole) + 1):
        got = repair(whole[:n])
        assert got is not None, whole[:n]
        made = json.loads(got)
        assert n < len(whole) or made == json.loads(whole)
        if n > 40:
            assert made["name"] == 'a "b" {c}'


def test_vectors_meet_by_shelves(spark, tmp_path, monkeypatch):
    """Shelves of few vectors, parts larger than a shelf and several sides of probes lose nothing."""
    from citeweave.operators import vector_index as V

    monkeypatch.setattr(V, "SHELF", 16)
    monkeypatch.setattr(V, "SIDE", 20)
    monkeypatch.setattr(V, "SLICE", 7)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 4)), np.repeat(rng.normal(size=(1, 4)), 40, axis=0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    index = V.VectorIndex.build(rows, "i", "v", f"{tmp_path}/shelves", pivots=3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = {(r["probe"], r["item"]): r["rank"] for r in index.nearest(rows, "i", "v", 5).collect()}
    assert near == {(p, i): n + 1 for p in range(100) for n, i in enumerate(sorted(range(100), key=lambda i: (round(d[p, i], 9), i))[:5])}
    assert {(r["probe"], r["item"]) for r in index.within(rows, "i", "v", 1.2).collect()} == {(p, i) for p, i in zip(*np.nonzero(d <= 1.2))}
