"""Token counts, language ID, mixing, fingerprints and language-model scores against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from citeweave.llm import langid, logbilinear, mixing, order_minhash, tokens
from citeweave.llm.queries import QUERIES, SQL
from tests.compare import canonical, connect
from tests.llm.conftest import BASE, ODD

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, name):
    got, want = QUERIES[name](spark, BASE).toPandas(), connect(BASE).sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_token_counts_equal_the_library(frame, sample):
    sp = SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(3)
    odd = [(1000 + i, "".join(rnd.choice(" \n\t▁aàb<>s/0x.,;'　é漢😀") for _ in range(rnd.randint(0, 20)))) for i in range(300)]
    rows = sample + odd + ODD
    got = tokens.token_counts(frame(rows), MODEL, limit=100, cache=50, per_task=20).collect()
    want = [(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 100) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_token_counts_of_nothing(frame):
    assert tokens.token_counts(frame([(0, "x")]).limit(0), MODEL).collect() == []


def test_language_id_held_out_accuracy(frame, sample):
    rows = sample + ODD
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    model = langid.train(frame(learn))
    assert model[0] == ["de", "en", "es", "fr"]
    got = langid.identify(frame(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[3] for r in sample if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    held = [r for r in got if r.doc_id in truth and r.doc_id > 9]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    blank = {(r.doc_id, r.lang_pred, r.score) for r in got if r.lang_pred == "und"}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)} <= blank
    kept = langid.keep_identified(frame(rows), model)
    assert kept.columns == frame(rows).columns
    assert {r.doc_id for r in kept.collect()} >= {r[0] for r in sample if r[0] > 9}


def test_language_scores_equal_a_plain_sum(frame, sample):
    names, matrix = langid.train(frame(sample))
    for t in [r[1] for r in sample[:20]]:
        flat = [b for part in langid.pieces(langid.letters_of(t)) for b in part.ravel() if b >= 0]
        sums = matrix[flat].astype(float).sum(axis=0)
        pred, post = langid.score([t], names, matrix)
        assert pred == [names[int(sums.argmax())]]
        assert math.isclose(post[0], 1 / np.exp(sums - sums.max()).sum(), rel_tol=1e-6)


def test_language_id_without_labels(frame):
    model = langid.train(frame([(1, "abc")]))
    assert [tuple(r) for r in langid.identify(frame([(1, "abc")]), model).collect()] == [(1, "und", 0.0)]
    assert langid.identify(frame([(1, "abc")]).limit(0), model).collect() == []


def brute_targets(sizes, share=1.5, cap=2.0):
    """Deal by weight, cut at the cap, deal what is over again until nobody is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(frame, seed):
    rnd = random.Random(seed)
    rows = [(i, "w " * int(rnd.paretovariate(0.8) * 5), rnd.choice(["a", "b", "c", "d", None])) for i in range(600)]
    rows += [(1000 + i, "word " * 40, "hot") for i in range(600)] + ODD
    got = mixing.take(frame(rows)).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += len((r[1] or "").split())
    want = brute_targets(size)
    by_source = defaultdict(list)
    for r in got:
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        by_source[r.source_size, round(r.target, 6)].append(r)
    assert {(n, round(want[s], 6)) for s, n in size.items()} == set(by_source)
    for (_, target), own in by_source.items():
        sizes = sorted(r["size"] for r in own)
        mean = sum(sizes) / len(sizes)
        biggest_short = max((x for x in sizes if x <= mean), default=0)
        if sum(x for x in sizes if x <= mean) > max(sizes):
            assert abs(sum(r.taken for r in own) - target) <= biggest_short / 2 + 1e-6
    again = mixing.take(frame(rows, parts=5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def brute_drawn(rows, by_odds=True):
    """(doc_id, size) drawn beyond the whole copies from one source whose target is its rest."""
    u = {i: (int(hashlib.md5(f"{i}|s".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48) for i, _ in rows}
    total = sum(n for _, n in rows)
    rest, mean = 1.5 * total - total, total / len(rows)
    drawn = set()
    want = rest / total
    for part in ([r for r in rows if r[1] > mean], [r for r in rows if r[1] <= mean]):
        size = sum(n for _, n in part)
        weight = sum(n.bit_length() * n for _, n in part)
        words = want * size if part and part[0][1] > mean else max(0.0, min(rest - sum(n for i, n in rows if i in drawn), size))
        p = {i: min(1.0, words / size * (n.bit_length() * size) / weight) if by_odds else words / size for i, n in part}
        upto = 0
        for i, n in sorted(part, key=lambda r: (u[r[0]] / (1 - u[r[0]]) * (1 - p[r[0]]) / p[r[0]], r[0])):
            upto += n
            if upto - n / 2 <= words:
                drawn.add(i)
    return drawn


def test_mix_ranks_by_each_documents_own_odds(frame):
    """One source with a target of 1.5 times its size: the drawn half follows the odds, and not the random numbers alone."""
    rnd = random.Random(8)
    rows = [(i, int(rnd.paretovariate(0.7) * 3) + 1) for i in range(300)]
    got = mixing.take(frame([(i, "w " * n, "s") for i, n in rows])).collect()
    drawn = {r.doc_id for r in got if r.copies == 2}
    assert {r.copies for r in got} == {1, 2} and drawn == brute_drawn(rows) != brute_drawn(rows, by_odds=False)


def test_mix_of_nothing(frame):
    assert mixing.take(frame([(1, "a")]).limit(0)).collect() == []
    assert [r.taken for r in mixing.take(frame([(1, None), (2, "")])).collect()] == [0, 0]


def plain_signature(text):
    """Order MinHash straight from its definition, item by item."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        return [0] * order_minhash.FUNCTIONS
    h = order_minhash.kmers(points)
    seen, nth = Counter(), []
    for x in h:
        nth.append(seen[x])
        seen[x] += 1
    items = [int(order_minhash.mix64(np.uint64([(int(x) + k * int(order_minhash._STEP)) % (1 << 64)]))[0]) >> 32 for x, k in zip(h, nth)]
    out = []
    for f in range(order_minhash.FUNCTIONS):
        def weight(x, f=f):
            v = (x * int(order_minhash._TIMES[f, 0]) + int(order_minhash._PLUS[f, 0])) % (1 << 32)
            v ^= v >> 15
            return v * 0x2C1B3C6D % (1 << 32)
        two = sorted(sorted(range(len(items)), key=lambda i: weight(items[i]))[:2])
        a, b = two[0], two[-1]
        tail = int(order_minhash.mix64(np.uint64([h[b]]))[0])
        out.append(int(order_minhash.mix64(np.uint64([(int(h[a]) * 3 + tail) % (1 << 64)]))[0]) >> 48)
    return out


def test_signature_follows_its_definition(sample):
    for t in ["", "a", "abcdefgh", "abcdefghi", "abab" * 40, sample[0][1][:700], sample[5][1][:300]]:
        assert order_minhash.signature(t).tolist() == plain_signature(t)


def test_signature_is_sensitive_to_order():
    a = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(400))
    half = len(a) // 2
    swapped = a[half:] + a[:half]
    near = order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(a[:-5] + "zzzzz"))
    assert near > 0.8 > order_minhash.likeness(order_minhash.signature(a), order_minhash.signature(swapped))


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(1 << 63)))
    out = []
    for i, (d, t) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        e = order_minhash.edited(t, follow)
        s, es, ns = map(order_minhash.signature, (t, e, follow))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), order_minhash.as_text(s), order_minhash.as_text(es),
                    order_minhash.likeness(s, es), order_minhash.likeness(s, ns)))
    return out


@pytest.mark.parametrize("count", [1, 2, 150])
def test_fingerprints_against_brute_force(frame, sample, count):
    rows = [(r[0] * 37 % 1009, r[1]) for r in sample[:count]]
    got = order_minhash.fingerprints(frame(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_fingerprints(rows))


def test_fingerprints_of_odd_rows(frame):
    got = order_minhash.fingerprints(frame(ODD)).collect()
    assert len(got) == len(ODD)
    assert all(r.fingerprint == "0" * 128 for r in got if r.n_chars == 0)
    same = {r.fingerprint for r in got if r.doc_id in (7, 8)}
    assert len(same) == 1
    assert order_minhash.fingerprints(frame(ODD).limit(0)).collect() == []


def held_out(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


def test_language_model_scores(frame, sample):
    rows = [r for r in sample + ODD if r[0] is not None]
    df = frame(rows).selectExpr("*", "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2 as fold")
    got = logbilinear.scores(df, "fold").collect()
    tok = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter()
    for r in rows:
        if not held_out(r[0]):
            c.update(tok(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((r[0], held_out(r[0]), len(tok(r[1])), sum(w in c for w in tok(r[1])), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(r[1])), 3)) for r in rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    far = [r for r in got if r.held_out and r.doc_id > 9]
    assert sum(r.score for r in far) > sum(r.base_score for r in far)
    assert logbilinear.scores(df.limit(0), "fold").collect() == []


def test_language_model_is_normalised():
    rng = np.random.default_rng(0)
    noise = rng.random(logbilinear.CLASSES)
    model = logbilinear.Model(noise / noise.sum())
    seq = rng.integers(0, logbilinear.CLASSES, 4000)
    model.fit(*logbilinear.contexts(seq, 0), noise / noise.sum(), 1, 0.1)
    norms = np.full(logbilinear.CLASSES ** 2, np.nan, dtype=np.float32)
    every = np.arange(logbilinear.CLASSES)
    for last, before in ((3, 9), (700, 1000)):
        p = model.log_probs(np.full_like(every, last), np.full_like(every, before), every, norms)
        assert math.isclose(np.exp(p).sum(), 1, rel_tol=1e-4)


def test_language_model_without_training_rows(frame):
    df = frame([(1, "a b"), (2, None)]).selectExpr("*", "true as fold")
    got = {r.doc_id: r for r in logbilinear.scores(df, "fold").collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0


def test_language_model_learns_from_every_document(frame, monkeypatch):
    """One pass over many documents, each with a pattern of its own; no sample of them is enough."""
    monkeypatch.setattr(logbilinear, "VISITS", 1, raising=False)
    monkeypatch.setattr(logbilinear, "SAMPLE_DOCS", 2, raising=False)
    rows = [(k, " ".join([f"w{k % 40}a w{k % 40}b w{k % 40}c"] * 30)) for k in range(2000)]
    df = frame(rows).selectExpr("*", "doc_id < 40 as fold")
    told = [r for r in logbilinear.scores(df, "fold").collect() if r.held_out]
    assert len(told) == 40 and all(r.score > 0.6 * r.base_score for r in told)


def test_every_round_passes_over_every_document(frame):
    """A corpus of 7,000 documents: four rounds over all of them, done again without Spark."""
    rows = [(k, f"a{k % 7} b{k % 11} a{k % 7}") for k in range(7000)]
    learn = frame(rows).selectExpr("xxhash64(doc_id, text) as row", "text")
    vocabulary = logbilinear.Vocabulary(logbilinear.token_counts(learn))
    got = logbilinear.train(learn, vocabulary)
    end, noise, want = vocabulary.index[b""], vocabulary.noise, logbilinear.Model(vocabulary.noise)
    shards = defaultdict(list)
    for r in sorted(learn.selectExpr("row", "text", f"pmod(xxhash64(row), {logbilinear.SHARDS}) as shard").collect()):
        classes = vocabulary.look_up(logbilinear.folded_words(r.text))[1].astype(np.int16)
        shards[r.shard].append(logbilinear.contexts(classes, end))
    for turn in range(logbilinear.ROUNDS):
        sums, size = [0.0] * 4, 0
        for shard, held in shards.items():
            own = logbilinear.Model(noise)
            for mine, shared in zip(own.parameters(), want.parameters()):
                mine[...] = shared
            parts = [np.concatenate(x) for x in zip(*held)]
            own.fit(*parts, noise, np.random.default_rng([turn, shard]), logbilinear.RATE / (1 + turn))
            sums = [s + len(parts[2]) * p.astype(np.float64) for s, p in zip(sums, own.parameters())]
            size += len(parts[2])
        for p, s in zip(want.parameters(), sums):
            p[...] = s / size
    for mine, other in zip(got.parameters(), want.parameters()):
        assert np.allclose(mine, other, atol=1e-4)
