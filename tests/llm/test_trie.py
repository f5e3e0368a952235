"""Prefix tries against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import prefixtrie
from tabulon.llm.common import ship

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """{(depth, conv_id): rest of the node}, by all prefixes of all rebuilt conversations. Turns of a conversation differ in number."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(base(c), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = {}
    for t, cs in members.items():
        below = [u for u in members if u[: len(t)] == t]
        kids = lambda u: sum(len(v) == len(u) + 1 and v[: len(u)] == u for v in below)
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(t))))
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u)
        parent = min(members[t[:-1]]) if t else None
        out[len(t), min(cs)] = (parent, len(cs), kids(t), sum(kids(u) == 0 for u in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes(df, p=prefixtrie.Trie()):
    got = prefixtrie.prefix_trie(df, p).select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len({tuple(r)[:2] for r in got}) == len(got)
    return {tuple(r)[:2]: tuple(r)[2:] for r in got}


def corpus(seed, n=70, long=12):
    rng = random.Random(seed)
    ids = rng.sample(range(-150, 420), n) + [100, 200, 0]
    script = [("user", "déjà vu"), ("assistant", "😀 ok"), ("user", ""), (None, "x"), ("user", None), ("assistant", "ok")]
    rows = []
    for c in dict.fromkeys(ids):
        same = rng.random() < 0.5
        turns = [script[k % 6] if same and rng.random() < 0.9 else rng.choice(script) for k in range(rng.randint(1, long))]
        rows += [(c, None if k == 0 and rng.random() < 0.3 else k, role, text) for k, (role, text) in enumerate(turns)]
    return rows


PARAMS = [prefixtrie.Trie(), prefixtrie.Trie(local_rows=3, id_block=2), prefixtrie.Trie(segment=3, local_rows=2, id_block=2, few=0), prefixtrie.Trie(segment=2, local_rows=1)]


@pytest.mark.parametrize(("seed", "p"), list(enumerate(PARAMS)))
def test_trie(spark, seed, p):
    ship(spark)
    rows = corpus(seed)
    rng = random.Random(seed)
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 0, "user", "nobody's")], SCHEMA).withColumn("key", F.lit("clash")).withColumn("code", F.lit(1)).repartition(3)
    assert nodes(df, p) == brute(rows)


def test_hot_conversation_and_copies(spark):
    """One conversation holds a third of all turns; a third of the conversations are equal."""
    ship(spark)
    rows = [(700, t, "user", f"t{t % 7}") for t in range(120)] + [(700 + 5, t, "user", f"t{t % 7}") for t in range(90)]
    rows += [(c * 100, t, "user", f"same {t}") for c in range(20, 60) for t in range(3)] + [(10_001 + c * 100, 9, "user", f"only {c}") for c in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(df, prefixtrie.Trie(segment=16, local_rows=8, id_block=700)) == brute(rows)


def test_odd_tables(spark):
    ship(spark)
    assert nodes(spark.createDataFrame([], SCHEMA)) == {}
    turnless = [(c, 0, "user", "x") for c in range(1000, 1100) if c != 1000]  # their base is absent, so many have no turn left
    got = nodes(spark.createDataFrame(turnless, SCHEMA))
    assert got == brute(turnless) and got[0, 1001][0] is None and got[0, 1001][1] == 99
    twice = [(7, 1, "user", "a"), (7, 1, "user", "a"), (7, 2, "user", "b")]
    assert sum(d > 0 for d, _ in nodes(spark.createDataFrame([(100 * c + i, *r[1:]) for c in range(4) for i in (0,) for r in twice], SCHEMA))) == 3
    texts = spark.createDataFrame([(1, 1, "user", "x" * 3_000_000), (1, 2, "user", "y")], SCHEMA)
    assert nodes(texts) == brute([tuple(r) for r in texts.collect()])


def test_ids_that_two_turns_share_are_given_anew(spark):
    ship(spark)
    rows = corpus(9)
    df = spark.createDataFrame(rows, SCHEMA)
    ids = prefixtrie.coded(df, hashing=lambda *c: F.pmod(F.xxhash64(*c), F.lit(2)))
    assert ids.select("code").distinct().count() == len({(r[2] or "", r[3] or "") for r in rows}) == prefixtrie.dictionary(df).count()


def test_multikey_quicksort(spark):
    rng = np.random.default_rng(3)
    seqs = sorted({tuple(rng.integers(-2, 2, rng.integers(0, 6)).tolist()) for _ in range(200)})
    length = np.array([len(s) for s in seqs])
    start = np.append(0, np.cumsum(length))[:-1]
    flat = np.array([x for s in seqs for x in s], np.int64)
    parent, depth, end, members = prefixtrie.sorted_nodes(flat, start, length, 0)
    want = {s[:d] for s in seqs for d in range(len(s) + 1)}
    name = lambda i: seqs[int(np.atleast_1d(members[i])[0])][: depth[i]]
    assert {name(i) for i in range(len(parent))} == want and len(parent) == len(want)
    assert all(name(i)[:-1] == name(parent[i]) and parent[i] < i for i in range(1, len(parent)))
    assert {seqs[e] for e in end if e >= 0} == set(seqs) and all(e < 0 or seqs[e] == name(i) for i, e in enumerate(end))
