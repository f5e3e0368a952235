"""Repeated strings and near-duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import clashing, corpus, empty, frame

from tabulon.llm import minhash, suffix
from tabulon.llm.common import ship


def cover(texts, length=100):
    seen, out = set(), []
    for t in texts:
        c = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if (w := t[p : p + length]) in seen:
                c[p : p + length] = True
            else:
                seen.add(w)
        out.append(c)
    return out


def expected(rows):
    texts = [(r[1] or "").encode() for r in rows]
    out = {}
    for r, t, c in zip(rows, texts, cover(texts), strict=True):
        kept = np.frombuffer(t, np.uint8)[~c].tobytes()
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out[r[0]] = (len(t), int(c.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("p", [suffix.Repeats(), suffix.Repeats(hot=2, chunk=900, flush=100), suffix.Repeats(hot=40, hot_here=1, chunk=900, flush=1500), suffix.Repeats(symbol=50)])
def test_repeats_exact(spark, p):
    ship(spark)
    rows = corpus()
    got = {r[0]: tuple(r)[1:] for r in suffix.repeat_digests(clashing(spark, rows).repartition(3), p).collect()}
    want = expected(rows)
    assert sum(v[1] for v in want.values()) > 3000
    assert got == want


def test_a_line_of_a_third_of_all_texts(spark):
    ship(spark)
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(180))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 160))) + (line if i % 3 == 0 else "") + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 130))), "l", "s", 1) for i in range(300)]
    want = expected(rows)
    for p in (suffix.Repeats(), suffix.Repeats(hot=1, hot_here=3, flush=400), suffix.Repeats(hot=1000, hot_here=3, flush=400)):
        assert {r[0]: tuple(r)[1:] for r in suffix.repeat_digests(frame(spark, rows).repartition(3), p).collect()} == want


def test_repeats_edges(spark):
    ship(spark)
    assert suffix.repeat_digests(empty(spark)).collect() == []
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(150))
    twice = frame(spark, [(1, a, None, None, None), (1, a, None, None, None), (None, a, None, None, None)])
    assert sorted(r.n_removed for r in suffix.repeat_digests(twice).collect()) == [0, 150, 150]
    short = frame(spark, [(1, a[:99], None, None, None), (2, a[:99], None, None, None)])
    assert {r.n_removed for r in suffix.repeat_digests(short).collect()} == {0}
    same = frame(spark, [(1, "c" * 150, None, None, None), (2, None, None, None, None)])
    assert {r.doc_id: r.n_removed for r in suffix.repeat_digests(same).collect()} == {1: 149, 2: 0}
    cut = suffix.without_repeats(clashing(spark, [(1, a, "l", "s", 1), (2, "é" + a, "l", "s", 2)]))
    assert {r.doc_id: r.text for r in cut.collect()} == {1: a, 2: "é"} and "lo" in cut.columns and "__cuts" in cut.columns
    again = suffix.without_repeats(clashing(spark, [(1, a, "l", "s", 1), (1, a, "l", "s", 1)]))
    assert sorted(r.text for r in again.collect()) == ["", a] and {r.key for r in again.collect()} == {"x"}


def test_merge_is_interleave_of_shards():
    rng = np.random.default_rng(5)
    for _ in range(50):
        codes, follows = [], []
        for _ in range(rng.integers(1, 4)):
            lengths = rng.integers(1, 9, rng.integers(1, 6))
            c = rng.integers(0, 3, lengths.sum())
            f = np.arange(1, len(c) + 1)
            f[np.cumsum(lengths) - 1] = -1
            codes.append(c)
            follows.append(f)
        depth = 4
        bwts = [suffix.ShardBwt(c, f, depth) for c, f in zip(codes, follows, strict=True)]
        z, place, common = suffix.merge_bwts(bwts, [c[f < 0] for c, f in zip(codes, follows, strict=True)], depth)

        def start(s, i, codes=codes, follows=follows):
            out = []
            while i >= 0 and len(out) < depth:
                out.append(codes[s][i])
                i = follows[s][i]
            return tuple(out)

        seen = [start(s, bwts[s].order[k]) for s, k in zip(z, place, strict=True)]
        assert seen == sorted(seen)
        for i in range(1, len(seen)):
            assert (common[i] == depth) == (seen[i] == seen[i - 1])


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows):
    sets, up = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links, by = 0, defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for a, b in {(x, y) for v in by.values() for x in v for y in v if x < y}:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * len(sets[a] | sets[b]):
            links += 1
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}, links


def test_near_duplicates_exact(spark):
    ship(spark)
    rows = corpus(8, 120)
    # a chain of copies, each further from the first, and a star of copies round a base
    rng = random.Random(2)
    words = [f"w{rng.randrange(900)}" for _ in range(120)]
    for i in range(200, 240):
        rows.append((i, " ".join(words), "en", "s", 0))
        words = words.copy()
        words[rng.randrange(len(words))] = f"v{i}"
    base = words.copy()
    for i in range(300, 360):
        w = base.copy()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = f"u{i}-{rng.random()}"
        rows.append((i, " ".join(w), "en", "s", 0))
    want, links = components(rows)
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(clashing(spark, rows)).collect()}
    assert links > 100 and got == want


@pytest.mark.parametrize("p", [minhash.NearDup(), minhash.NearDup(rounds=0, block=7)])
def test_near_duplicates_of_a_third_of_all_texts(spark, p):
    ship(spark)
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = [(i, " ".join(words(rng.randint(5, 60))), "en", "s", 0) for i in range(400)]
    base, far = words(60), None
    for i in range(400, 600):  # copies of one text, some too far from it to be linked with it alone
        w = base.copy()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"u{rng.random()}"
        rows.append((i, " ".join(w), "en", "s", 0))
    far = base.copy()
    for i in range(600, 640):  # a chain away from the group
        far[i - 590] = f"c{i}"
        rows.append((i, " ".join(far), "en", "s", 0))
    want, links = components(rows)
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame(spark, rows).repartition(5), p).collect()}
    assert links > 2000 and got == want


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_near_duplicates_whose_best_partner_is_refused(spark, rounds):
    """u is linked with w alone (0.7598), while w's near copies are all but linked with u (0.7487) and may look likelier."""
    ship(spark)
    rng, rows = random.Random(31), []
    for g in range(40):
        w = [f"g{g}w{i}-{rng.randrange(10**9)}" for i in range(700)]
        at = list(range(10, 690, 10))
        rng.shuffle(at)
        u = w.copy()
        for i in at[:19]:
            u[i] += "u"
        rows += [(10 * g, " ".join(u), "en", "s", 0), (10 * g + 1, " ".join(w), "en", "s", 0)]
        for k in range(4):
            x = w.copy()
            x[at[30 + k]] += "x"
            rows.append((10 * g + 2 + k, " ".join(x), "en", "s", 0))
    want, _ = components(rows)
    got = {r[0]: tuple(r)[1:] for r in minhash.near_duplicates(frame(spark, rows).repartition(4), minhash.NearDup(rounds=rounds)).collect()}
    assert got == want and len({c for _, c, _ in got.values()}) == 40


def test_near_duplicates_edges(spark):
    ship(spark)
    assert minhash.near_duplicates(empty(spark)).collect() == []
    rows = [(1, "A b", None, None, None), (2, "a  B\n", None, None, None), (3, None, None, None, None), (4, " ", None, None, None), (5, "a b", None, None, None), (5, "a b", None, None, None), (None, "a b", None, None, None)]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert (by[2].component_id, by[5].component_id, by[3].component_id, by[4].component_id) == (1, 1, 3, 4)
    assert by[3].kept and not by[2].kept and by[None].n_shingles == 1


def test_estimate_is_corrected(spark):
    ship(spark)
    k = 1024
    a, b = minhash._families(k)
    rng = np.random.default_rng(1)
    for share in (0.2, 0.75):
        both = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * share)
        x, y = both[:2000], np.concatenate([both[:n], rng.integers(0, 2**63, 2000 - n).astype(np.uint64)])
        sig = [minhash._packed(minhash.minima(s, a, b)[None])[0].view(np.int64).tolist() for s in (x, y)]
        est = spark.createDataFrame([tuple(sig)], "x array<long>, y array<long>").select(minhash.corrected(k, "x", "y")).first()[0]
        assert abs(est - n / (4000 - n)) < 0.1
