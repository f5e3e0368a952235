"""Source mixing and packing."""

import heapq
import math
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from helpers import clashing, corpus, empty, frame

from tabulon.llm import mixing, packing
from tabulon.llm.common import ship
from tabulon.llm.queries import tokenizer_path


def simulated(n, w):
    """Earliest deadline first from the first slot to the last, in exact fractions; and each source's curve by slot."""
    n, w = list(n), [Fraction(x).limit_denominator(10**7) for x in w]
    left, curve, t, turns = [Fraction(x) for x in n], [Fraction(0)] * len(n), Fraction(0), [[Fraction(0)] for _ in n]
    times = [[] for _ in n]  # when each curve passes 1, 2, ...
    total = sum(n)
    while any(left):
        rate = [x if m else 0 for x, m in zip(w, left, strict=True)]
        rate = [x / sum(rate) for x in rate]
        step = min(m / r for m, r in zip(left, rate, strict=True) if r)
        for s, r in enumerate(rate):
            while r and len(times[s]) < n[s] and (len(times[s]) + 1 - curve[s]) / r <= step:
                times[s].append(t + (len(times[s]) + 1 - curve[s]) / r)
            turns[s].append(r)
            curve[s] += r * step
            left[s] -= r * step
        t += step
    release = [[Fraction(0), *x][:-1] for x in times]
    jobs = sorted((math.floor(r), math.ceil(d), s, i + 1) for s in range(len(n)) for i, (r, d) in enumerate(zip(release[s], times[s], strict=True)))
    ready, at, out = [], 0, []
    for slot in range(total):
        while at < len(jobs) and jobs[at][0] <= slot:
            heapq.heappush(ready, jobs[at][1:])
            at += 1
        d, s, i = heapq.heappop(ready)
        assert slot < d
        out.append((s, i))
    return out, times


def merged(n, w, length):
    """All segments, one after another."""
    c = mixing.Curves(np.arange(len(n)), np.array(n), np.array(w, float))
    length = c.length(length)
    parts = [x for k in range(-(-c.slots // length)) for x in c.segment(k, length)]
    return c, *(np.concatenate(x) for x in zip(*parts, strict=True))


@pytest.mark.parametrize("w", [[0.5, 0.3, 0.2], [1], [1, 3**0.5, 7**0.5], [1 + i * i for i in range(20)], [1000, 1, 1], [1, 1, 1, 1]])
def test_first_segment_is_earliest_deadline_first(w):
    n = [37 * (i + 1) for i in range(len(w))]
    want, times = simulated(n, w)
    _, source, block, slot, release, deadline = merged(n, w, sum(n))
    assert slot.tolist() == list(range(sum(n)))
    assert [(s, b) for s, b in zip(source.tolist(), block.tolist(), strict=True)] == want
    for s, b, d in zip(source.tolist(), block.tolist(), deadline.tolist(), strict=True):
        assert d == math.ceil(times[s][b - 1])


@pytest.mark.parametrize("seed", range(12))
def test_segments_meet_all_deadlines(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 30))
    n, w = rng.integers(1, 2000, k), rng.random(k) ** rng.integers(1, 4) + 0.05
    monkeypatch.setattr(mixing, "_STRETCH", 50)
    c, source, block, slot, release, deadline = merged(n, w, int(rng.integers(5, 60)))
    assert (release <= slot).all() and (slot < deadline).all()
    assert sorted(zip(source.tolist(), block.tolist(), strict=True)) == [(s, i + 1) for s in range(k) for i in range(n[s])]
    got = np.zeros(k)
    for t, s in enumerate(source, 1):
        got[s] += 1
        assert (np.abs(got - c.due(t)) < 1 + 1e-6).all()


def test_irrational_weights_stay_below_a_block():
    n, w = [22_000, 33_000, 55_000], np.array([1, 3**0.5, 7**0.5])
    _, source, _, slot, _, _ = merged(n, w, 4096)
    assert (np.diff(slot) == 1).all()
    rows, share = 100_000, w / w.sum()
    taken = np.cumsum(source[:rows, None] == np.arange(3), axis=0)
    until = int((np.array(n) / share).min())  # as long as all three last
    assert (np.abs(taken - np.arange(1, rows + 1)[:, None] * share)[:until] < 1 + 1e-6).all()


def test_many_sources():
    n = np.arange(5000) % 37 + 1
    _, source, block, slot, release, deadline = merged(n, np.sqrt(n), 20_000)
    assert (release <= slot).all() and (slot < deadline).all() and len(set(zip(source.tolist(), block.tolist(), strict=True))) == n.sum()


def test_mix(spark):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(3000)] + [(9000, "t", "en", None, 1), (9001, "t", "en", "", 1), (None, "t", "en", "hot", 1)]
    p = mixing.Mix(block_rows=4, blocks_a_bucket=8, segment=64)
    got = mixing.mix(clashing(spark, rows), p=p).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    assert len({r.block for r in got if r.source == "hot"}) >= 2000 // 4
    by = defaultdict(set)
    for r in got:
        by[r.slot].add((r.source, r.block))
        assert r.release <= r.slot < r.deadline
    assert all(len(v) == 1 for v in by.values()) and sorted(by) == list(range(len(by)))
    assert mixing.mix(empty(spark)).count() == 0
    only = mixing.mix(frame(spark, rows), {"s0": 1.0}, p).collect()
    first = max(r.slot for r in only if r.source == "s0")
    assert all(r.slot > first for r in only if r.source != "s0")


def bins_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    return by


@pytest.mark.parametrize("n", [0, 1, 7, 400, 20000])
def test_plan(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(6.5, 1.2, n), 1, 4096).astype(int)
    counts = np.bincount(lengths, minlength=4097)
    segments, total = packing.plan(counts, packing.Packing())
    fill, seen = np.zeros(total, int), np.zeros(4097, int)
    for length, rank, k, first, offset in sorted(segments.tolist(), key=lambda s: s[4]):
        assert (fill[first : first + k] == offset).all()
        fill[first : first + k] += length
        seen[length] += k
    assert (seen == counts).all() and (not total or fill.max() <= 4096)
    least = -(-int((np.arange(4097) * counts).sum()) // 4096)
    assert total <= least + max(2, least // 100)


def test_configurations_beat_rounding_one_size():
    found = packing.configurations([6, 5, 3, 2], [100, 100, 100, 100], 10)
    assert sum(v for _, v in found) <= (600 + 500 + 300 + 200) / 10 + 1e-6 + 10
    for i, n in enumerate((100, 100, 100, 100)):
        assert sum(c[i] * v for c, v in found) >= n - 1e-6


def test_pack(spark):
    ship(spark)
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path()).encode
    rows = corpus(4, 40) + [(500, "Straße ÉTÉ don't o'clock  a.b,c x,, 12.5\t y z Σας ΣΑΣ İstanbul <|endoftext|> é", "x", "s", 1), (501, "w " * 9000, "x", "s", 1), (502, "w " * 9000, "x", "s", 1)]
    got = packing.pack(clashing(spark, rows), tokenizer_path()).collect()
    bins_of(got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert set(by) == {r[0] for r in rows}
    for r in rows:
        ids = np.array([*encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(by[r[0]], key=lambda x: x.piece)
        assert [(x.piece, x.start, x.length) for x in parts] == [(k, a, min(4096, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 4096))]
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in parts)
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0
    same = packing.pack(frame(spark, [(1, "a b", None, None, None)] * 3 + [(None, None, None, None, None)]), tokenizer_path()).collect()
    assert len(same) == 4 and len(bins_of(same)) == 1


def test_ids_are_those_of_the_whole_encoder():
    from tokenizers import Tokenizer

    encode, cache = Tokenizer.from_file(tokenizer_path()).encode, packing.IdCache(tokenizer_path(), most=20)
    odd = "Straße, ÉCOLE! Ἀχιλλεύς ΣΊΣΥΦΟΣ İstanbul ﬁx éa K Å ñandú日本語 한국어 가 don't it's X's 'll a'm ab12cd x_y (foo) foo) bar''  x y\tz\rq\x0bw\x85v <|endoftext|> a<|endoftext|> ªº ʼn ß ẞ ŉ ǰ ΐ Dž ᾳ abc'd''s wörd... é ́a ǅ ſt"
    for text in [odd, *odd.split(" "), "", " ", "\n\n", odd.upper(), odd.lower()]:
        want = np.array(encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert cache.ids(text) == want, text
    assert len(cache) <= 21


def test_ids_of_random_texts_of_all_scripts():
    import random

    from tokenizers import Tokenizer

    tokenizer, cache = Tokenizer.from_file(tokenizer_path()), packing.IdCache(tokenizer_path())
    rng = random.Random(5)
    likely = "abcXYZ .,'!?-\"\n\t0127ÉéßẞİıŞşǅΣσςά\u0308ñйЙжԱ中文カ\uff9f한국नमस्तेกำا\u0958𝔸𐐀ﬁ’“…«₂½Ⅳ\u0338\u0301\u200b\u3000😀"
    every = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    letters = [c for c in every if c.isalpha()]
    texts = [t for c in letters for t in (c + ".", "A" + c + "),")]
    texts += ["".join(rng.choice(every if rng.random() < 0.2 else likely) for _ in range(rng.randint(1, 12))) for _ in range(40_000)]
    wrong = [t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(cache.ids(t), "<u4").tolist() != e.ids]
    assert wrong == [] and len(cache.ids("İSTANBUL BELEDİYESİ, 2020")) == 4 * 16


def test_workers_drop_what_other_stages_held():
    from tabulon.llm import common

    common.held("a")["x"], common.held("b")["y"] = 1, 2
    assert list(common.lean(iter, "a")([1, 2])) == [1, 2]
    assert common.HELD == {"a": {"x": 1}}
