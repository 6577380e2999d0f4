"""Periodic runs, the factorisation machine and fill-in-middle against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.llm import factorisation, fim, runs
from citeweave.llm.queries import QUERIES

from .conftest import BASE, ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=12):
    """All maximal stretches of each period, least period first; a stretch found again has a smaller period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((i, n, p) for (i, n), p in found.items() if n >= least), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, found):
    gone = {k for start, length, period in found for k in range(start + period, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def pruned_runs(w, least):
    out = []
    for start, stop in runs.stretches(np.array(w, dtype=np.int64), np.array([0]), least):
        out += [(s + start, n, p) for s, n, p in runs.runs_of(w[start:stop], least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_search():
    rng = random.Random(5)
    for _ in range(1500):
        n, kinds, least = rng.randint(1, 60), rng.choice([1, 2, 3, 6]), rng.choice([1, 2, 3, 7, 12])
        w = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5:
            q = rng.randint(1, 9)
            w = [w[i % q] if rng.random() < 0.97 else rng.randrange(kinds) for i in range(n)]
        assert runs.runs_of(w, least) == plain_runs(w, least)
        assert pruned_runs(w, least) == plain_runs(w, least)


def test_nested_and_touching_runs():
    inner = [1, 2] * 8 + [3]
    assert pruned_runs(inner * 3, 12) == plain_runs(inner * 3, 12)
    fibonacci = [0], [0, 1]
    for _ in range(9):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert pruned_runs(fibonacci[1], 12) == plain_runs(fibonacci[1], 12)
    assert plain_runs([7] * 11, 12) == [] == pruned_runs([7] * 11, 12)
    assert pruned_runs([7] * 12, 12) == [(0, 12, 1)]


def test_stretches_stay_within_texts():
    # The second text goes on where the first ends; neither holds a run alone.
    words = np.array([1, 2, 3, 4, 5, 6] * 2, dtype=np.int64)
    assert runs.stretches(words, np.array([0, 6]), 12) == []
    assert runs.stretches(words, np.array([0]), 12) == [(0, 12)]


def test_periodic_runs_on_odd_rows(frame):
    rows = [*ODD, (20, "a b c d e f " * 5 + "g", "a", "en"), (20, "a b c d e f " * 5 + "g", "a", "en"), (21, "ß\x85b " * 9, None, None)]
    got = runs.periodic_runs(frame(rows)).collect()
    assert len(got) == len(rows)

    def shape(i, text):
        w = WORDS.findall(text or "")
        if len(w) > 10_000:
            return i, len(w), ((0, len(w), 5),), "the cat sat on the mat" if len(set(w)) == 5 and w[:6] == "the cat sat on the mat".split() else ""
        found = plain_runs(w)
        return i, len(w), tuple(found), plain_collapsed(w, found)

    expect = Counter()
    for i, text, *_ in rows:
        w = WORDS.findall(text or "")
        if len(w) > 10_000:
            expect[(i, len(w), ((0, len(w), 6),), "the cat sat on the mat")] += 1
        else:
            expect[shape(i, text)] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got) == expect


def test_periodic_runs_empty_table(frame):
    assert runs.periodic_runs(frame([(1, "x", "a", "en")]).limit(0)).collect() == []


def test_op11_against_plain_version(spark, sample):
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, BASE).collect()}
    assert len(got) == len(sample)
    periodic = 0
    for i, text, *_ in sample:
        w = WORDS.findall(text or "")
        n = len(w)
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 3000:
            continue
        found = plain_runs(w)
        periodic += bool(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert r["n_runs"] == len(found)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(w, found).encode()).hexdigest()
    assert periodic > 10


def test_machine_equals_sum_over_pairs():
    rng = np.random.default_rng(3)
    width = 4
    size = factorisation.BUCKETS + width
    machine = factorisation.Machine(
        0.3, rng.normal(size=size), rng.normal(size=(size, factorisation.FACTORS)), rng.normal(size=width), np.array([1.0, 2.0, 0.5, 1.5]))
    sizes = np.array([3, 0, 5])
    flat = np.concatenate([np.sort(rng.choice(factorisation.BUCKETS, k, replace=False)) for k in sizes])
    dense = rng.normal(size=(3, width))
    got = machine.scores(flat, sizes, dense)
    at = 0
    for row, k in enumerate(sizes):
        x = np.zeros(size)
        x[flat[at:at + k]] = 1 / np.sqrt(max(k, 1))
        x[factorisation.BUCKETS:] = machine.scaled(dense)[row]
        at += k
        used = np.flatnonzero(x)
        total = machine.bias + x @ machine.weights
        for i, u in enumerate(used):
            for v in used[i + 1:]:
                total += machine.factors[u] @ machine.factors[v] * x[u] * x[v]
        assert got[row] == pytest.approx(1 / (1 + np.exp(-total)))


def test_machine_learns_a_pair_of_words():
    """Label 1 if both or neither of two words are there: no weight of single words tells that."""
    rng = np.random.default_rng(4)
    n = 4000
    two = rng.integers(0, 2, size=(n, 2))
    rows = [[k for k, there in zip((11, 22), pair, strict=True) if there] + [100 + int(rng.integers(0, 50))] for pair in two]
    label = (two[:, 0] == two[:, 1]).astype(float)
    flat, sizes = np.array([x for r in rows for x in r]), np.array([len(r) for r in rows])
    dense = np.zeros((n, 0))
    cut, edge = 3000, sizes[:3000].sum()
    machine = factorisation.learn(flat[:edge], sizes[:cut], dense[:cut], label[:cut], steps=1400)
    right = (machine.scores(flat[edge:], sizes[cut:], dense[cut:]) > 0.5) == (label[cut:] > 0.5)
    assert right.mean() > 0.95


def test_machine_without_labels_or_with_one():
    none = np.zeros(0, dtype=np.int64)
    empty = factorisation.learn(none, none, np.zeros((0, 2)), np.zeros(0))
    assert empty.scores(none, np.array([0]), np.zeros((1, 2)))[0] == pytest.approx(0.5)
    ones = factorisation.learn(np.array([1, 2]), np.array([1, 1]), np.zeros((2, 2)), np.ones(2))
    assert (ones.scores(np.array([1]), np.array([1]), np.zeros((1, 2))) > 0.5).all()


def test_statistics_of_a_small_text():
    _, sizes, stats = factorisation.describe(["", "Ab 12 a-b.\nAb 12\n\nAb 12"])
    assert sizes.tolist() == [0, 3]
    assert not stats[0].any()
    row = dict(zip(factorisation.STATISTICS, stats[1], strict=True))
    assert row["words"] == pytest.approx(np.log1p(7))
    assert row["distinct words"] == pytest.approx(3 / 7) and row["distinct lines"] == pytest.approx(2 / 3)
    assert row["words without letters"] == pytest.approx(3 / 7) and row["signs inside words"] == pytest.approx(1 / 7)
    assert row["lines that end in a stop"] == pytest.approx(1 / 3) and row["most frequent word"] == pytest.approx(3 / 7)


def test_quality_on_odd_rows(spark, frame):
    docs = frame(ODD).withColumn("n_chars", F.when(F.col("doc_id") != 7, F.length("text")))
    labels = spark.createDataFrame(
        [(7, 1), (7, 1), (7, 0), (8, 0), (9, 1), (None, 1), (5, None), (77, 1)], "doc_id long, quality int")
    machine = factorisation.fit(docs, labels, metadata=("n_chars",))
    got = factorisation.score(docs, machine, metadata=("n_chars",)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ODD)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert factorisation.score(docs.limit(0), machine, metadata=("n_chars",)).collect() == []
    bare = factorisation.fit(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in factorisation.score(docs, bare).collect()} == {0.5}


def test_fit_is_bounded_and_repeatable(spark):
    docs = spark.range(400).select(F.lit(1).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).unionByName(
        spark.range(2, 40).select(F.col("id").cast("int").alias("doc_id"), F.lit("other words").alias("text")))
    labels = spark.range(1, 40).select(F.col("id").cast("int").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    a = factorisation.fit(docs.repartition(3), labels, rows=50)
    b = factorisation.fit(docs.repartition(7), labels.repartition(2), rows=50)
    assert np.array_equal(a.factors, b.factors) and a.bias == b.bias


def test_op12_held_out_accuracy(spark):
    """Documents of the fold that is not learned from, on the 1,000 documents of the next larger table."""
    base = BASE.replace("0.001", "0.01")
    got = QUERIES["op12_quality"](spark, base)
    assert got.count() == spark.read.parquet(f"{base}/documents.parquet").count()
    judged = got.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").filter("held_out").select("quality", "predicted").collect()
    good = [r["predicted"] for r in judged if r["quality"] == 1]
    bad = [1 - r["predicted"] for r in judged if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) > 0.85


def plain_fim(i, text):
    text = text or ""
    n = len(text)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fim_on_odd_rows(frame):
    rows = [*ODD, *[(100 + k, f"text {k} < S> <S <P ending in <{'M' * (k % 2)}" + "é😀" * k, "a", "en") for k in range(60)],
            (200, "holds <M> itself", "a", "en"), (201, "😀" * 40_000, "a", "en"), (202, "a\x00b", "a", "en")]
    docs = frame(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expect = Counter((i, *(p := plain_fim(i, t))[:4], sha(p[4]), sha(t or "")) for i, t, *_ in rows)
    pieces = fim.arrange(docs)
    assert Counter(map(tuple, fim.digests(fim.restore(pieces)).collect())) == expect
    whole = Counter((r["doc_id"], r["form"], r["output"]) for r in fim.joined(pieces).collect())
    assert whole == Counter((i, (p := plain_fim(i, t))[1], p[4]) for i, t, *_ in rows)
    assert fim.digests(fim.restore(fim.arrange(docs.limit(0)))).collect() == []


def test_fim_pieces_and_one_shuffle(frame):
    docs = frame([(i, "abc " * 20_000, "a", "en") for i in range(12)])
    pieces = fim.arrange(docs)
    assert pieces.agg(F.max(F.length("piece"))).first()[0] <= fim.UNIT + 3
    plan = fim.digests(fim.restore(pieces))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(task") == 1


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_marks_split_over_pieces(form):
    rng = random.Random(6)
    for _ in range(300):
        parts = ["".join(rng.choice("<PSM>ab") for _ in range(rng.randint(0, 6))) for _ in range(3)]
        text = "".join(parts)
        if any(m in text for m in fim.MARKS):
            continue
        named = dict(zip((fim.PREFIX, fim.MIDDLE, fim.SUFFIX), parts, strict=True))
        out = "".join(m + named[m] for m in fim.ORDERS[form])
        reader, got, at = fim.Marks(form), {0: "", 1: "", 2: ""}, 0
        while at < len(out):
            step = rng.randint(1, 4)
            for place, stretch in reader.feed(out[at:at + step]):
                got[place] += stretch
            at += step
        for place, stretch in reader.close():
            got[place] += stretch
        assert "".join(got.values()) == text


def test_marks_demand_a_beginning():
    with pytest.raises(ValueError):
        list(fim.Marks("psm").feed("no mark <P>"))


def test_op13_round_trip(spark, sample):
    got = {r["doc_id"]: r for r in QUERIES["op13_fill_in_middle"](spark, BASE).collect()}
    assert len(got) == len(sample)
    for i, text, *_ in sample:
        n, form, prefix, middle, out = plain_fim(i, text)
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
