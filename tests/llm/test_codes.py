"""Vector codes against plain Python integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import veccodes
from tabulon.llm.common import ship


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{vec_id: (code, error, label_error)} and the codebooks' digest, over rows of one length."""
    kept = [(i, [math.floor(Fraction(float(x)) * scale) for x in v], label) for i, v, label in rows]
    w = len(kept[0][1]) // parts
    cut = lambda v, j: v[j * w : (j + 1) * w]
    books = [[cut(v, j) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]] for j in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, j: min((dist(cut(v, j), c), k) for k, c in enumerate(books[j]))
    for _ in range(rounds):
        own = [[best(v, j)[1] for j in range(parts)] for _, v, _ in kept]
        for j in range(parts):
            for k in range(len(books[j])):
                group = [cut(v, j) for (_, v, _), o in zip(kept, own, strict=True) if o[j] == k]
                if group:
                    books[j][k] = [sum(c) // len(group) for c in zip(*group, strict=True)]
    sums, found = {}, []
    for i, v, label in kept:
        b = [best(v, j) for j in range(parts)]
        found.append([i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), label])
        sums[label] = sums.get(label, 0) + found[-1][2]
    return sorted((str(i), c, e, sums[label]) for i, c, e, label in found), hashlib.sha256(",".join(str(x) for part in books for e in part for x in e).encode()).hexdigest()


def coded(df, p=veccodes.Coding()):
    return [tuple(r) for r in veccodes.vector_codes(df, p=p).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]


@pytest.mark.parametrize(("width", "scale", "seed"), [(16, 1.0, 1), (64, 0.1, 2), (24, 3000.0, 3), (40, 5e3, 4), (8, 1.0, 5)])
def test_codes(spark, width, scale, seed):
    ship(spark)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(90, width)) * scale
    x[30:60] = np.round(x[30:60] / scale) * scale  # many ties
    x[60:75] = x[60]  # copies
    rows = [(i * 3, [float(np.float32(v)) for v in r], [None, 1, 2, 1][i % 4]) for i, r in enumerate(x)]
    extra = [(1, None, 1), (2, [None] * width, 1), (4, [float("nan")] * width, 1), (5, [float("inf")] + [0.0] * (width - 1), 2), (7, [1e13] * width, 1)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("of", F.lit(1)).repartition(5)
    want, sha = brute(rows)
    got = coded(df, veccodes.Coding(block_rows=17, few_labels=1 if seed == 1 else 100))
    assert sorted((str(i), c, e, s) for i, c, e, s, _ in got) == want and {g[4] for g in got} == {sha}


def test_odd_rows(spark):
    ship(spark)
    schema = "vec_id long, embedding array<double>, label string"
    assert coded(spark.createDataFrame([], schema)) == []
    rows = [(5, [0.5] * 8, None), (None, [1.0] * 8, None), (5, [0.5] * 8, "a"), (6, [1.0] * 7, "a"), (7, [], "a"), (8, [1.0] * 16, "a")]
    got = {(i, e, s) for i, _, e, s, _ in coded(spark.createDataFrame(rows, schema))}
    assert got == {(5, 0, 0), (None, 0, 0), (6, None, None), (7, None, None), (8, None, None)}
    assert [r[1:] for r in coded(spark.createDataFrame(rows[3:5], schema))] == [(None, None, None, None)] * 2
    same = coded(spark.createDataFrame([(i, [2.0**39, -(2.0**39)] * 4 if i < 17 else [0.0] * 8, "x") for i in range(18)], schema))
    assert all(e is None or e == 0 for _, _, e, _, _ in same) and {s[0] for s in same} == set(range(18))  # errors beyond a long are null
    with pytest.raises(ValueError):
        coded(spark.createDataFrame(rows, schema), veccodes.Coding(entries=300))


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_below_and_lose_no_tie(seed):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-5000, 5000, (400, 11)), rng.integers(-5000, 5000, (16, 11))
    book[7] = book[3]
    x[:50] = book[rng.integers(0, 16, 50)]
    x[50:100] = (book[1] + book[2]) // 2
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    for blocks in (1, 2, 4, 50):
        low = veccodes.Bounds(x, blocks).below(np.arange(400)[:, None], veccodes.Bounds(book, blocks), np.arange(16)[None, :])
        assert (low <= d).all()
    index, least, n = veccodes.nearest_entries(x, book, (1, 2, 4))
    assert (index == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all() and n <= d.size + len(x)


def test_bounds_spare_distances(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in np.cumsum(rng.normal(size=64))], 1) for i in range(500)], "vec_id long, embedding array<double>, label int")
    books = veccodes.codebooks(veccodes.usable(df, "vec_id", "embedding", "label"), 64)
    rows, entries, exact = veccodes.exact_distances(df, books).first()
    assert rows == 4000 and entries == 64_000 and exact < 0.3 * entries
