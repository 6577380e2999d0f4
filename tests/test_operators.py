import itertools
import math
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from citeweave.operators import anchoring, bibliography, blocked, budget, chunks, dense, entities, figures
from citeweave.operators import fusion, gaps, graph, keyed, sparse


def test_blocked_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, rnd.choice("aab")) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v string")
    by = defaultdict(list)
    for g, i, v in rows:
        by[g].append((i, v))
    pos = {r.i: (r.pos, r.n) for r in blocked.position(df, ["g"], "i", "pos", block=16, size="n").collect()}
    assert all(pos[i] == (k, len(x)) for x in by.values() for k, (i, _) in enumerate(x))
    tot = {r.i: r.s for r in blocked.running_sum(df, ["g"], "i", F.col("i"), "s", block=16).collect()}
    assert all(tot[i] == sum(j for j, _ in x[: k + 1]) for x in by.values() for k, (i, _) in enumerate(x))
    got = sorted((r.g, r.run_start, r.run_end, r.v, r.run_length) for r in blocked.runs(df, ["g"], "i", "v", block=16).collect())
    want = []
    for g, x in by.items():
        for v, run in itertools.groupby(x, key=lambda t: t[1]):
            run = list(run)
            want.append((g, run[0][0], run[-1][0], v, len(run)))
    assert got == sorted(want)


def test_ordered_folds(spark):
    rnd = random.Random(2)
    rows = [("m", i, rnd.randint(0, 9), rnd.randint(1, 9), rnd.randint(4000, 20000), rnd.random() < 0.6) for i in range(200)]
    df = spark.createDataFrame(rows, "m string, i long, c long, o long, t long, ok boolean")
    ratio, lo, hi = 0.5, 8000, 16384
    for _, _, c, o, t, ok in rows:
        if c > 0 and o > 0:
            ratio = 0.8 * ratio + 0.2 * o / c
        lo, hi = (max(lo, t), max(hi, max(lo, t))) if ok else (min(lo, min(hi, t)), min(hi, t))
    assert abs(budget.output_ratio(df, ["m"], "i", "c", "o", 199).first().output_ratio - ratio) < 1e-9
    b = budget.boundary(df, ["m"], "i", "t", "ok", 199).first()
    assert (b.boundary_lower, b.boundary_upper) == (lo, hi)


def test_pack_never_loses_chunks(spark):
    df = spark.createDataFrame([([3, 4, 9, 1, 1, 8],), ([],), ([50],)], "s array<int>")
    assert [r.o for r in df.select(budget.pack(F.col("s"), 8).alias("o")).collect()] == [[0, 0, 1, 2, 2, 3], [], [0]]
    lit = lambda x: F.lit(x)
    assert df.select(budget.chunk_budget(lit(0.5), lit(8000), lit(500)).alias("b")).first().b == int((8000 * .95 - 850) / 1.5)


def _bm25(docs, query, k):
    toks = {d: t.split() for d, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + .5) - math.log(c + .5) for w, c in df.items()}
    eps = .25 * sum(idf.values()) / len(idf)
    idf = {w: (eps if v < 0 else v) for w, v in idf.items()}
    score = {d: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (.25 + .75 * len(t) / avg)) for w in query.split())
             for d, t in toks.items()}
    return [d for d, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]


def test_pruned_bm25_equals_full_scan(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rnd.choices(vocab, weights, k=rnd.randint(3, 30)))) for i in range(250)]
    qs = [(i, " ".join(rnd.choices(vocab, k=6))) for i in range(12)] + [(99, "nothing matches here")]
    out = sparse.topk(spark.createDataFrame(docs, "d long, t string"), "d", "t",
                      spark.createDataFrame(qs, "q long, t string"), "q", "t", 5)
    got = defaultdict(list)
    for r in out.orderBy("q", "rank").collect():
        got[r.q].append(r.d)
    assert all(got[q] == _bm25(docs, t, 5) for q, t in qs)


def test_fusion_and_figures(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q long, d string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "q long, d string, rank int")
    assert [r.d for r in fusion.reciprocal_rank([a, b], "q", "d").orderBy("rank").collect()] == ["y", "x", "z"]
    mixed = spark.createDataFrame([(1, i, i, "figure" if i % 2 else "text") for i in range(1, 25)], "q long, d long, rank int, k string")
    top = fusion.shape(mixed, "q", "k", 9, include_figures=True).orderBy("out_rank").collect()
    assert [r.k for r in top] == ["text"] * 6 + ["figure"] * 3
    assert fusion.shape(mixed, "q", "k", 9).filter("k = 'figure'").isEmpty()


def test_dense_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    items, probes = [(i, vec()) for i in range(60)], [(i, vec()) for i in range(5)]
    monkeypatch.setattr(dense, "PROBE_BYTES", 128)  # several slices
    out = dense.nearest(spark.createDataFrame(items, "i long, v array<double>"), "i", "v",
                        spark.createDataFrame(probes, "p long, w array<double>"), "p", "w", 4)
    got = {(r.p, r["rank"]): r.i for r in out.collect()}
    for p, w in probes:
        order = sorted(items, key=lambda x: math.dist(x[1], w))[:4]
        assert [got[p, k + 1] for k in range(4)] == [i for i, _ in order]


def _graph(spark, rows):
    return graph.incidence(spark.createDataFrame(rows, "c long, n long"), "c", "n")


def test_hot_chunk_pairs_and_degrees(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(0, i) for i in range(40)] + [(c, rnd.randint(0, 59)) for c in range(1, 30) for _ in range(4)]
    inc = _graph(spark, rows)
    members = defaultdict(set)
    for c, n in rows:
        members[c].add(n)
    want = {(c, u, v) for c, m in members.items() for u in m for v in m if u < v}
    near = defaultdict(set)
    for _, u, v in want:
        near[u].add(v)
        near[v].add(u)
    for limit in (8, 256):
        monkeypatch.setattr(graph, "HOT_CHUNK", limit)
        got = [tuple(r) for r in graph.pairs(inc).select("chunk", "u", "v").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {r.node: r.degree for r in graph.degrees(inc).collect()} == {n: len(s) for n, s in near.items()}
    hops = {r.node: r.hop for r in graph.hops(inc, spark.createDataFrame([(0,)], "node long"), 2).collect()}
    first = near[0]
    second = set().union(*[near[n] for n in first]) - first - {0}
    assert hops == {0: 0, **{n: 1 for n in first}, **{n: 2 for n in second}}


def test_communities_and_betweenness(spark):
    cliques = [(a, b) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10)]
    edges = spark.createDataFrame(cliques, "u long, v long")
    for member in (graph.communities(edges),):
        groups = defaultdict(set)
        for r in member.collect():
            groups[r.cid].add(r.node)
        assert sorted(map(sorted, groups.values())) == [list(range(5)), list(range(10, 15))]
        assert graph.modularity(edges, member).first().modularity > 0.4
    assert graph.communities(spark.createDataFrame([(1, 2)], "u long, v long")).isEmpty()
    # Two equal shortest paths 1-2-4 and 1-3-4: each middle node carries half.
    bc = {r.node: round(r.betweenness, 6) for r in graph.betweenness(
        spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "u long, v long"), normalised=False).collect()}
    assert bc == {1: 0.5, 2: 1.0, 3: 1.0, 4: 3.5, 5: 0.0}


def test_sequential_dedup(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["", "a", "b", "c", "d", "e"]), rnd.choice(["", "p", "q", "r", "s"])) for i in range(60)]
    doi, title, want = set(), set(), []
    for i, d, t in rows:
        if (d and d in doi) or (t and t in title):
            continue
        doi.add(d)
        title.add(t)
        want.append(i)
    out = keyed.first_seen_by_either(spark.createDataFrame(rows, "i long, d string, t string"), "i", "d", "t")
    assert sorted(r.i for r in out.collect()) == want


def test_line_tagged_output(spark):
    grouped = "EVIDENCE: seen in mice\nSOURCE: Chunk 1 | a.pdf\nTYPE: material\nENTITY: PEI | DIRECTION: up\nENTITY: dendrimer | DIRECTION: none"
    legacy = "TYPE: material\nENTITY: Ti-6Al-4V\nconditions: dry\nEVIDENCE: alloy was used\nSOURCE: Chunk 5 | a.pdf\n\nENTITY: Mg\n"
    looped = "TYPE: x\nENTITY: a | CLAIM: b\nENTITY: a | CLAIM: b\nENTITY: c | CLAIM: d"
    junk = "TYPE: x\nENTITY: a | CLAIM: b\n" + "noise\n" * 20 + "ENTITY: z | CLAIM: y"
    df = spark.createDataFrame([(1, grouped), (2, legacy), (3, looped), (4, junk), (5, "nothing")], "id long, t string")
    out = defaultdict(list)
    for r in entities.parse(df, "id", "t").orderBy("id", "ord").collect():
        out[r.id].append((r.category, r.entity, dict(r.attrs), r.evidence, r.source))
    assert out[1] == [("material", "PEI", {"claim": "up"}, "seen in mice", "Chunk 1 | a.pdf"),
                      ("material", "dendrimer", {"claim": "none"}, "seen in mice", "Chunk 1 | a.pdf")]
    assert out[2][0] == ("material", "Ti-6Al-4V", {"conditions": "dry"}, "alloy was used", "Chunk 5 | a.pdf")
    assert out[2][1][1] == "Mg" and [e[1] for e in out[3]] == ["a"] and [e[1] for e in out[4]] == ["a"] and 5 not in out


def test_token_spam_by_words(spark):
    rnd = random.Random(3)
    parts = ["ab", "AB", "ab,", "ab.", "x", ",", ".", " ", "\n", "\t", "na-na-na-na-na-na-na-na", "ab-cd-ef-gh-ij-kl-mn-op", "\u00c9a", "\u00e9a", "word"]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " ", "  ", "\n"]) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]

    def run(items, n):
        return any(items[i:i + n] == [items[i]] * n for i in range(len(items) - n + 1))

    def want(t):
        words = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" "))
        chains = [[p.strip(" ") for p in w.lower().split("-") if p.strip(" ")] for w in words if "-" in w and len(w) > 20]
        return len(t) >= 15 and (run([re.sub("[:,;.]+$", "", w.lower()) for w in words], 3) or any(run(c, 3) for c in chains))

    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", entities.spam(F.col("t")).alias("s"))
    assert {r.id: r.s for r in df.collect()} == {i: want(t) for i, t in enumerate(texts)}


def test_parse_cuts_lines_once(spark):
    df = spark.createDataFrame([(1, "EVIDENCE: e\nSOURCE: s\nTYPE: t\nENTITY: One\nENTITY: Two | CLAIM: up")], "id long, t string")
    out = entities.parse(df, "id", "t")
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.ord, r.entity, r.attrs) for r in out.orderBy("ord").collect()] == [(1, "One", {}), (2, "Two", {"claim": "up"})]


def test_degraded_outputs(spark):
    df = spark.createDataFrame([(1, "line: x\n" + "same line again\n" * 80), (2, "ENTITY: fine | CLAIM: also fine")], "id long, t string")
    assert [r.id for r in entities.stream_degraded(df, "t").filter("degraded").collect()] == [1]
    spam = spark.createDataFrame([("Energy: Energy: Energy: more",), ("e-coli-coli-coli-coli-coli x",), ("a normal long sentence here",)], "t string")
    assert [r.s for r in spam.select(entities.spam(F.col("t")).alias("s")).collect()] == [True, True, False]


def test_markdown_lists(spark):
    md = "**Materials**\n* **Bioactive Glass:** a glass\n* **Methods:** ELISA, flow cytometry, CT"
    got = {(r.category, r.entity, r.evidence) for r in entities.markdown_lists(
        spark.createDataFrame([(1, md)], "id long, t string"), "id", "t").collect()}
    assert got == {("Materials", "Bioactive Glass", "a glass"), ("Methods", "ELISA", ""), ("Methods", "flow cytometry", "")}


def test_gap_rules(spark):
    text = ("1. There is no data on the IL-17A axis. More here.\n2. No significant difference was observed in X today.\n"
            "3. Further study is needed on Ti-6Al-4V wear.\n4. No data.\n5. The role of Y is unknown so far.\n6. Z is unexplored in bone tissue.")
    rows = gaps.to_queries(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", most=3).orderBy("rank").collect()
    assert [r["query"] for r in rows] == ["data on the IL-17A axis", "Ti-6Al-4V wear", "The role of Y is unknown so far"]
    assert rows[0].context == "More here."
    assert gaps.to_queries(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").count() == 4


def test_anchoring_rules(spark):
    ev = spark.createDataFrame([(1, "Titanium implants improve bone growth strongly."), (2, "Mice were fed daily.")], "sid long, s string")
    cl = spark.createDataFrame([(1, "Titanium implants improve bone growth strongly."), (2, "Quantum llamas orbit distant moons.")], "cid long, c string")
    sims = {r.cid: r.similarity for r in anchoring.best_evidence(cl, "cid", "c", ev, "sid", "s").collect()}
    assert abs(sims[1] - 1) < 1e-9 and sims[2] == 0
    scored = cl.withColumn("o", F.lit("a")).join(spark.createDataFrame(list(sims.items()), "cid long, similarity double"), "cid")
    owners = spark.createDataFrame([("a",), ("empty",)], "o string")
    assert {r.o: r.score for r in anchoring.score(scored, owners, "o").collect()} == {"a": 0.5, "empty": 1.0}


def test_best_title_equals_full_comparison(spark, monkeypatch):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(4))
    right = [(i, " ".join(word() for _ in range(5))) for i in range(30)]
    left = [(i, t[:-3] + "zz") for i, t in right[:10]] + [(100 + i, " ".join(word() for _ in range(5))) for i in range(10)]

    def sim(a, b):
        wa, wb = set(a.split()), set(b.split())
        return max(SequenceMatcher(None, a, b).ratio(), len(wa & wb) / len(wa | wb))

    monkeypatch.setattr(bibliography, "BATCH_BYTES", 600)
    out = {r.l: r.similarity for r in bibliography.best_title(
        spark.createDataFrame(left, "l long, title string"), spark.createDataFrame(right, "r long, title string"), "l", "r").collect()}
    want = {i: max(sim(t, o) for _, o in right) for i, t in left}
    assert {k: round(v, 9) for k, v in out.items()} == {k: round(v, 9) for k, v in want.items() if v >= 0.6}


def test_best_title_compares_few_pairs_in_full(monkeypatch):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcde ") for _ in range(n)).strip() or "a"
    pool = [text(rnd.randrange(1, 90)) for _ in range(60)]
    pool[7] = pool[3]
    titles = [pool[3], pool[9][:-2] + "zz", pool[20][:25], "qqq zzz", "x" * 500, *[text(rnd.randrange(1, 90)) for _ in range(40)]]
    full, made = SequenceMatcher(None, "", "").__class__, []
    monkeypatch.setattr(bibliography, "SequenceMatcher", lambda *a: made.append(a) or full(*a))
    own = bibliography._Pool(list(range(60)), pool)

    def want(t, least):
        wt = set(t.split())
        scores = [max(full(None, t, o).ratio(), len(wt & set(o.split())) / len(wt | set(o.split()))) for o in pool]
        return (scores.index(max(scores)), max(scores)) if max(scores) >= least else None

    for least in (0.4, 0.6, 0.9):
        assert [own.best(t, least) for t in titles] == [want(t, least) for t in titles]
    made.clear()
    for t in titles:
        own.best(t, 0.9)
    assert len(made) < len(titles)


def test_title_sets_are_not_carried_by_their_words(spark):
    """Equal titles, one-word titles and titles without words; no word brings a whole set along."""
    left = [(1, "Red bone heals"), (2, "heals bone red red"), (3, "!!"), (4, "solo"), (5, None), (6, "red bone heals slowly now")]
    right = [(1, "bone heals red"), (2, "solo"), (2, "Solo!"), (3, "other words here")]
    out = bibliography.title_jaccard(
        spark.createDataFrame(left, "l long, title string"), spark.createDataFrame(right, "r long, title string"), "l", "r")
    assert sorted((r.l, r.r, r.jaccard) for r in out.collect()) == [
        (1, 1, 1.0), (2, 1, 1.0), (4, 2, 1.0), (4, 2, 1.0), (6, 1, 0.6)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(ka#" in plan and "(kb#" in plan


def test_doi_cascade(spark):
    left = spark.createDataFrame([(1, "10.1/A", "t"), (2, "https://doi.org/10.1/b", "u"), (3, "", "Growth of bone on titanium"), (4, "", "zzz")], "l long, doi string, title string")
    right = spark.createDataFrame([(7, "10.1/a", "x"), (8, "10.1/b", "y"), (9, "", "growth of bone on Titanium!")], "r long, doi string, title string")
    out = {r.l: (r.r, r.method) for r in bibliography.match(left, right, "l", "r").collect()}
    assert out == {1: (7, "doi_exact"), 2: (8, "doi_clean"), 3: (9, "title_fuzzy_1.00")}


def test_figure_scores(spark):
    P = "array<struct<class_name string, confidence double>>"
    rows = [([("bar_chart", .995)], 400, 300, "Figure 1. x", 3), ([("logo", .95)], 50, 50, "", 1), ([], 400, 300, "", 0)]
    df = spark.createDataFrame(rows, f"p {P}, w int, h int, c string, n int")
    s = [r.s for r in df.select(figures.relevance(F.col("p"), F.col("w"), F.col("h"), F.col("c"), F.col("n")).alias("s")).collect()]
    assert s[0] > .9 and s[1] < .3 and abs(s[2] - (.65 * .3 + .1 + .05 * .5)) < 1e-9


def test_titles_and_summaries(spark):
    df = spark.createDataFrame([(1, "HHS Public Access\nShort\nA long enough title for this fine paper\nbody"), (2, "tiny text"), (3, "  \n")], "id long, t string")
    out = {r.id: r.x for r in df.select("id", chunks.title(F.col("t")).alias("x")).collect()}
    assert out == {1: "A long enough title for this fine paper", 2: "", 3: ""}
    assert {r.id: r.summary for r in chunks.summarise(df, "id", "t").collect()}[2] == "tiny text"


def test_topk_by_blocks_is_that_of_all_pairs(spark, monkeypatch):
    from citeweave.operators import sparse

    monkeypatch.setattr(sparse, "BLOCK", 40)
    words = ["ant", "bee", "cat", "dog", "elk", "fox", "gnu"]
    docs = [(i, " ".join(words[j] for j in range(7) if (i * 37 + j * 11) % 5 < 2)) for i in range(60)]
    asks = [(i, " ".join(words[j] for j in range(7) if (i * 13 + j * 7) % 3 == 0)) for i in range(30)]
    qt = spark.createDataFrame([(q, w, 1.0 + w.count("e")) for q, t in asks for w in t.split()], "q long, term string, qw double")
    held = spark.createDataFrame([(d, w, 0.5 + d % 3) for d, t in docs for w in t.split()], "d long, term string, w double")
    qt = qt.join(held.groupBy("term").count().withColumnRenamed("count", "df"), "term")
    want = {}
    for q, t in asks:
        sums = {d: sum((1.0 + w.count("e")) * (0.5 + d % 3) for w in t.split() if w in text.split()) for d, text in docs}
        hit = sorted(((-s, d) for d, s in sums.items() if s), key=lambda x: (round(x[0], 9), x[1]))[:4]
        want[q] = [(d, round(-s, 9)) for s, d in hit]
    got = {}
    for r in sparse.block_topk(qt, held, "q", "d", 4).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["d"], round(r["score"], 9)))
    assert got == {q: rows for q, rows in want.items() if rows}


def test_equal_claims_are_looked_up_once(spark, monkeypatch):
    from citeweave.operators import anchoring, sparse

    asked = []
    plain = sparse.topk

    def counted(docs, doc_id, body, queries, *rest, **more):
        asked.append(queries.count())
        return plain(docs, doc_id, body, queries, *rest, **more)

    monkeypatch.setattr(sparse, "topk", counted)
    claims = spark.createDataFrame([("a", "red cells grow"), ("b", "red cells grow"), ("c", "blue rain falls"), ("d", None)], "cid string, c string")
    proof = spark.createDataFrame([(1, "red cells grow fast"), (2, "green rain falls"), (3, "nothing here")], "sid long, s string")
    got = {r["cid"]: (round(r["similarity"], 6), r["best_sentence"]) for r in anchoring.best_evidence(claims, "cid", "c", proof, "sid", "s").collect()}
    assert asked == [2]
    assert got["a"] == got["b"] and got["a"][1] == "red cells grow fast" and got["c"][1] == "green rain falls" and got["d"] == (0.0, "")
