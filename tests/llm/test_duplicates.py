"""Near-duplicates, lines, benchmark passages, secrets and licences against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from citeweave.llm import credentials, crowds, forest, licenses, lines, spaced_seeds
from citeweave.llm.common import components
from tests.llm.conftest import BASE, ODD


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 200), rnd.randint(0, 200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 420)] + [(500, k) for k in range(501, 700)]
    edges += [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    u = Union({x for e in edges if None not in e and e[0] != e[1] for x in e})
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    assert got == {n: u.find(n) for n in u.up}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def word_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if w else set()


def brute_components(rows, width, percent):
    sets = [(d, word_set(t, width)) for d, t in rows]
    u = Union({d for d, _ in sets})
    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            common = len(s & t)
            if s and t and 100 * common >= percent * (len(s) + len(t) - common):
                u.join(d, e)
    return {d: u.find(d) for d, _ in sets}, sets


def edit(rnd, words, share):
    return [rnd.choice(words) + str(rnd.randint(0, 9)) if rnd.random() < share else w for w in words]


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(frame, sample, width, percent):
    rnd = random.Random(width)
    rows = [(r[0], r[1]) for r in sample[:150]]
    for k in range(150):
        rows.append((1000 + k, " ".join(edit(rnd, rnd.choice(rows[:40])[1].split(), rnd.choice([0, 0.01, 0.03, 0.06])))))
    base = sample[3][1].split()[:150]
    rows += [(3000 + k, " ".join(edit(rnd, base, 0.02))) for k in range(250)]  # a crowded region
    rows += [(4000 + k, "all the same few words here") for k in range(60)] + [(5000, "A b"), (5001, "a B"), (5002, None), (5003, " \n")]
    want, sets = brute_components(rows, width, percent)
    got = forest.near_duplicates(frame(rows), width=width, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(s) for d, s in sets}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = forest.without_near_duplicates(frame(rows), width=width, percent=percent)
    assert left.columns == frame(rows).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_pairs_in_a_crowd_below_the_threshold(frame):
    rnd = random.Random(11)
    word = lambda: "w%d" % rnd.randrange(10**9)
    fixed = [word() for _ in range(200)]
    made = [fixed + [word() for _ in range(20)] for _ in range(1000)]
    for _ in range(300):
        own = [word() for _ in range(3)]
        made += [fixed + own + [word() for _ in range(17)] for _ in range(2)]
    rnd.shuffle(made)
    rows = [(k, " ".join(w)) for k, w in enumerate(made)]
    want, _ = brute_components(rows, 3, 85)
    assert sum(d != c for d, c in want.items()) >= 300
    assert {r.doc_id: r.component_id for r in forest.near_duplicates(frame(rows)).collect()} == want


def test_near_duplicates_of_odd_rows(frame):
    got = forest.near_duplicates(frame(ODD)).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (7, 8)} == {(7, 7), (8, 7)}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert forest.near_duplicates(frame(ODD).limit(0)).collect() == []


def brute_lines(rows):
    first, occurrences = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\n\r\v\f")
            if line:
                first.setdefault(line, (d, i))
                occurrences.append((d, i, line))
    names = sorted(first, key=first.get)
    sets = {x: {x} if len(x) < lines.K else {x[i:i + lines.K] for i in range(len(x) - lines.K + 1)} for x in names}
    u = Union(range(len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i]):
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= lines.PERCENT * large:
                common = len(sets[a] & sets[b])
                if 100 * common >= lines.PERCENT * (small + large - common):
                    u.join(i, j)
    at = {x: i for i, x in enumerate(names)}
    gone = defaultdict(list)
    for d, i, line in occurrences:
        if first[names[u.find(at[line])]] != (d, i):
            gone[d].append(i)
    return {d: ",".join(map(str, gone[d])) for d, _ in rows}


def test_lines_against_brute_force(frame, sample):
    rnd = random.Random(8)
    rows = [(r[0], r[1]) for r in sample[:60]]
    hot = "This line stands in very many documents of the corpus, as footers do."
    for k in range(200):
        near = list(hot)
        for _ in range(rnd.choice([0, 0, 1, 2])):
            near[rnd.randrange(len(near))] = rnd.choice("abc")
        rows.append((1000 + k, "\n".join(["own line of %d %s" % (k, rnd.random()), "".join(near), " ", "short", rnd.choice(rows)[1].split("\n")[0]])))
    want = brute_lines(rows)
    got = lines.dedup_lines(frame(rows)).collect()
    assert {r.doc_id: r.dropped for r in got} == want
    assert all(r.n_dropped == len([x for x in r.dropped.split(",") if x]) for r in got)
    kept = {r.doc_id: r.text for r in lines.without_duplicate_lines(frame(rows)).collect()}
    for d, t in rows:
        gone = {int(x) for x in want[d].split(",") if x}
        parts = t.split("\n")
        if gone and not any(x.strip() for i, x in enumerate(parts) if i not in gone):
            assert d not in kept
        else:
            assert kept[d] == "\n".join(x for i, x in enumerate(parts) if i not in gone)


def crowd_lines(seed, pairs, strangers):
    """Lines of one template a little less than 0.8 alike, and pairs among them that are a little more."""
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    fixed = word(120)
    made = [fixed + word(15) for _ in range(strangers)]
    for _ in range(pairs):
        own = word(3)
        made += [fixed + own + word(12), fixed + own + word(12)]
    rnd.shuffle(made)
    return [(k, "\n".join(made[10 * k:10 * k + 10])) for k in range(-(-len(made) // 10))]


def test_pairs_in_a_crowd_of_lines(frame):
    rows = crowd_lines(5, 300, 1400)
    want = brute_lines(rows)
    assert sum(len(x.split(",")) for x in want.values() if x) >= 300
    assert {r.doc_id: r.dropped for r in lines.dedup_lines(frame(rows)).collect()} == want


def test_lines_of_a_key_meet_or_stand_in_its_crowd():
    rnd = np.random.default_rng(3)
    for size in (2, 12, 13, 40, 300):
        own = rnd.permutation(size).astype(np.int64)
        met, sent = set(), []
        for part in np.array_split(own, 3):
            pairs, stand = lines.tie(np.full(len(part), 7, dtype=np.uint64), part, np.ones(len(part), dtype=np.int64))
            met |= set(map(tuple, pairs.tolist()))
            sent.append(stand)
        met |= set(map(tuple, lines.tie(*(np.concatenate(x) for x in zip(*sent, strict=True)))[0].tolist()))
        assert all((a, b) in met or {(a, a), (b, b)} <= met for b in range(size) for a in range(b))


def test_crowd_pairs_meet_seldom(spark):
    """Two likely sets share most of their prefixes; they do not meet once under each shared element."""
    rnd = np.random.default_rng(3)
    words = rnd.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2)
    rare = rnd.integers(0, 1 << 63, (40, 4)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    sets = [np.unique(np.concatenate([words, own])) for own in rare]
    df = spark.createDataFrame([(k, k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "id long, root long, packed binary")
    got = [(r.a, r.b) for r in crowds.pairs(df, 80).collect()]
    assert set(got) == {(a, b) for b in range(40) for a in range(b)}
    assert len(got) <= 2 * len(set(got))


@pytest.mark.parametrize("percent", [80, 85])
def test_crowd_join_is_exact(spark, percent):
    rnd = np.random.default_rng(percent)
    words = rnd.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    sets = []
    for k in range(300):
        own = words[:60 + k % 7] if k % 2 else sets[rnd.integers(len(sets))] if sets else words[:5]
        own = np.unique(np.where(rnd.random(len(own)) < 0.08, rnd.choice(words, len(own)), own))
        sets.append(own)
    roots = [k // 3 if k % 5 else 0 for k in range(300)]
    df = spark.createDataFrame([(k, r, bytearray(x.tobytes())) for k, (r, x) in enumerate(zip(roots, sets, strict=True))], "id long, root long, packed binary")
    got = {(r.a, r.b) for r in crowds.pairs(df, percent).collect()}
    want = set()
    for b in range(300):
        for a in range(b):
            common = len(np.intersect1d(sets[a], sets[b]))
            if roots[a] != roots[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                want.add((a, b))
    assert want and want <= got and all(roots[a] != roots[b] for a, b in got)


def test_lines_of_odd_rows(frame):
    got = lines.dedup_lines(frame(ODD)).collect()
    assert len(got) == len(ODD)
    assert {(r.n_lines, r.dropped) for r in got if r.doc_id == 1} == {(1, "")}
    # 7 comes before 8; both rows of 8 are one document and lose the line.
    assert [r.dropped for r in got if r.doc_id == 8] == ["0", "0"]
    assert lines.dedup_lines(frame(ODD).limit(0)).collect() == []
    assert lines.without_duplicate_lines(frame(ODD).limit(0)).collect() == []


def plain_stretch(doc, item, diagonal):
    start, stop = max(0, diagonal), min(len(doc), diagonal + len(item))
    same = [doc[x] == item[x - diagonal] for x in range(start, stop)]
    best = 0
    for a in range(len(same)):
        for b in range(a, len(same)):
            if same[a] and same[b] and 100 * sum(same[a:b + 1]) >= spaced_seeds.AGREE * (b - a + 1):
                best = max(best, b - a + 1)
    return best if best >= spaced_seeds.STRETCH else 0


def test_stretch_follows_its_definition():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        item = rnd.integers(0, 1000, rnd.integers(13, 40)).astype(np.uint64)
        doc = np.where(rnd.random(len(item)) < 0.25, 0, item).astype(np.uint64)
        shift = int(rnd.integers(-5, 5))
        doc = np.concatenate([np.full(max(0, shift), 7, dtype=np.uint64), doc[max(0, -shift):]])
        assert spaced_seeds.best_stretch(doc, item, shift)[1] == plain_stretch(doc, item, shift)


def test_any_two_of_ten_substitutions_leave_a_seed():
    words = np.arange(1, 11, dtype=np.uint64)
    want = spaced_seeds.seeds(words)
    for a in range(10):
        for b in range(a):
            other = words.copy()
            other[[a, b]] = 99
            assert (spaced_seeds.seeds(other) == want).any()


def test_decontamination_catches_passages_and_leaves_the_rest(spark, frame, sample):
    bench = spark.read.parquet(f"{BASE}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    rnd = random.Random(6)
    clean = [r for r in sample if not any(t in r[1] for t in items.values())]
    planted, part = [], []
    for k, (i, t) in enumerate(sorted(items.items())):
        w, around = t.split(), rnd.choice(clean)[1].split()[:200]
        cut = rnd.randint(0, len(around))
        planted.append((10_000 + k, " ".join(around[:cut] + w + around[cut:]).upper(), i))
        w[len(w) // 2] = "substituted"
        part.append((20_000 + k, " ".join(around[:cut] + w + around[cut:]), i))
    rows = [r[:2] for r in clean] + [p[:2] for p in planted + part] + [r for r in ODD if r[0] is None or r[0] < 10]
    got = spaced_seeds.contaminated(frame(rows), bench).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: set(r["items"].split(",")) for r in got if r.contaminated}
    small = {i for i, t in items.items() if len(t.split()) < 14}
    for d, _, i in planted + [p for p in part if p[2] not in small]:
        assert str(i) in found[d]
    assert not set(found) & {r[0] for r in clean}
    left = spaced_seeds.without_contaminated(frame(rows), bench)
    assert left.columns == frame(rows).columns
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - set(found)
    assert spaced_seeds.contaminated(frame(rows).limit(0), bench).collect() == []
    assert not any(r.contaminated for r in spaced_seeds.contaminated(frame(rows), bench.limit(0)).collect())


PIECES = ["password", "Token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP",
          "deadbeefdeadbeef", "é", "\n", "x.y=z", "ghp_aB3dE5gH7jK9mN1pQ3sT", "😀", "0a", "secret"]


def brute_secrets(rows):
    kinds = [(k, re.compile(p, re.ASCII), g, n) for k, p, g, n in credentials.BASE]
    loose = re.compile(credentials.LOOSE[1])
    spans, owners, repos = {}, defaultdict(set), defaultdict(set)
    for d, t, s in rows:
        t, own = t or "", []
        for rank, (k, p, g, n) in enumerate(kinds):
            own += [(m.start(), rank, k, m.end(), m.group(g)) for m in p.finditer(t) if len(m.group(g)) >= n]
        own += [(m.start(), 3, "loose", m.end(), m.group()) for m in loose.finditer(t) if all(re.search(x, m.group()) for x in credentials.MIXED)]
        spans[d] = sorted(own)
        for x in own:
            owners[x[4]].add(s)
            repos[x[4]].add(d)
    shared = {v for v in owners if len(owners[v]) >= credentials.WIDE or len(repos[v]) >= credentials.MANY}
    live = {v for v in owners if len(owners[v]) == 1 and v not in shared}
    out = []
    text = lambda part: ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in part)
    for d, _, _ in rows:
        base = [x for x in spans[d] if x[2] != "loose"]
        shown = [x for x in spans[d] if x[2] != "loose" or (
            x[4] in live and not any(y[0] < x[3] and x[0] < y[3] for y in base))]
        n = [sum(x[2] == k for x in base) for k in ("assign", "access", "hex")]
        out.append((d, *n, hashlib.sha256(text(base).encode()).hexdigest(), text(shown), sum(x[2] == "loose" for x in shown),
                    sum(x[4] in shared for x in shown), sum(x[4] in live for x in shown)))
    return out


def test_secrets_against_brute_force(frame):
    rnd = random.Random(4)
    rows = [(k, "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))), f"s{k % 3}") for k in range(600)]
    rows += [(1000, None, None), (1001, "", None), (1002, "token: token: abcdefghijklmnop", "s1"), (1003, "x" * 100_000 + " AKIA" + "Z" * 30, "s2")]
    rows += [(2000 + k, "password=hunter2hunter2", f"o{k}") for k in range(50)]
    got = credentials.scan(frame(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_secrets(rows))
    assert credentials.scan(frame(rows).limit(0)).collect() == []
    again = credentials.scan(frame([(5, "AKIA" + "A" * 20, "s"), (5, "AKIA" + "A" * 20, "s"), (None, "AKIA" + "A" * 20, None)])).collect()
    assert [r.n_access for r in again] == [1, 1, 1] and all(r.spans == "access:0:24" for r in again)


def test_a_value_copied_within_one_owner_is_no_live_secret(frame):
    """Many repositories of one owner tell a copied example, a few a live secret; loose spans follow."""
    key, loose = "AKIA" + "Q7" * 10, "ghp_aB3dE5gH7jK9mN1pQ3sT"
    copied = [(k, f"{key} and {loose}", "one") for k in range(credentials.MANY)]
    few = [(100 + k, f"{key[::-1]} AKIA{'B8' * 9} x{loose}", "one") for k in range(credentials.MANY - 1)]
    got = {r["doc_id"]: r for r in credentials.scan(frame(copied + few)).collect()}
    assert {(got[k]["n_shared"], got[k]["n_live"], got[k]["n_loose"]) for k in range(credentials.MANY)} == {(1, 0, 0)}
    assert {(r["n_shared"], r["n_loose"] > 0, r["n_live"] >= 2) for k, r in got.items() if k >= 100} == {(0, True, True)}


def test_licences(frame, sample):
    stated = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "reserved",
    }
    rows = [r[:2] for r in sample]
    rows += [(5000 + k, f"Some text before.\n{x.upper() if k % 2 else x}\nand after") for k, x in enumerate(stated)]
    rows += [(6000, "You keep all rights under the special licence terms that our vendor has written."), (6001, "He has a driving licence."),
             (6002, ("Some ordinary words stand here. " * 100) + "Released under the MIT License. " + "And more words. " * 50)] + [r[:2] for r in ODD]
    got = licenses.scan(frame(rows)).collect()
    assert len(got) == len(rows)
    want = {d: ",".join(sorted({v for k, v in stated.items() if k.lower() in (t or "").lower()})) for d, t in rows if d is not None}
    assert {r.doc_id: r.licenses for r in got if r.doc_id is not None} == want
    unknown = {r.doc_id: r.n_unknown for r in got}
    assert unknown[6000] == 1 and unknown[5000] == 0
    assert licenses.scan(frame(rows).limit(0)).collect() == []


def test_licences_in_paragraphs_of_any_length(frame, sample):
    """A licence sentence amid ordinary ones is found whatever the length of the paragraph; so are terms without a licence word."""
    plain = " ".join("\n".join(t for _, t, *_ in sample if t).split())
    rows = [(k, plain[:n].rsplit(" ", 1)[0] + ". Released under the MIT License. " + plain[n:2 * n]) for k, n in enumerate((100, 200, 400, 700, 900))]
    lacking = "To any person obtaining a copy of this software and associated documentation files, to deal in the Software without " \
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, and/or sell copies of the Software"
    assert not re.search(licenses.CUE, lacking)
    got = {r.doc_id: r for r in licenses.scan(frame([r[:2] for r in sample] + [(7000 + k, t) for k, t in rows] + [(7100, lacking)])).collect()}
    assert {got[7000 + k].licenses for k, _ in rows} == {"MIT"} and {got[7000 + k].n_licensed for k, _ in rows} == {1}
    assert got[7100].licenses == "MIT"


def test_native_plans_have_no_python(spark, frame):
    from tests.llm.test_counts_and_models import QUERIES

    for name in ("op7_secret_scan", "op10_license_scan"):
        plan = QUERIES[name](spark, BASE)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, BASE).persist()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    want = {r.doc_id: r.text for r in docs.collect()}
    # What is left: no equal lines, no near copies, no benchmark passage.
    assert all(v == "" for v in brute_lines([(d, t) for d, t in want.items()]).values())
    assert all(d == c for d, c in brute_components(list(want.items()), 5, 80)[0].items())
    items = [r.text for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    assert not any(i in t for t in want.values() for i in items)
    mix = corpus_pipeline.run(spark, BASE).collect()
    assert {r.doc_id for r in mix} <= set(want) and all(r["size"] == len(want[r.doc_id].split()) for r in mix)
