"""The byte network against plain loops, numerical gradients and held-out texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import bytecnn
from tabulon.llm.common import ship

SCHEMA = "doc_id long, text string, lang string"
SMALL = bytecnn.Net(window=64, per_label=60, epochs=5)


def said(rng, lang, n):
    parts = {"aa": ["ka", "mo", "ti", "lu"], "bb": ["sch", "ein", "ün", "ge"], "cc": ["ção", "de", "ro", "que"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_forward_and_gradients():
    p = bytecnn.Net(window=20, widths=(2, 3), filters=3, vector=4)
    rng = np.random.default_rng(1)
    model = bytecnn.Model(["a", "b", "c"], p)
    model.v = {k: v.astype(np.float64) for k, v in model.v.items()}
    x, y = rng.integers(0, 256, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    x[4, 7:] = 0
    best, _ = model.pooled(x)
    for n in range(5):
        for i, k in enumerate(p.widths):
            for f in range(3):
                plain = max(sum(model.v["e"][x[n, t + j]] @ model.v[f"w{k}"].reshape(k, 4, 3)[j, :, f] for j in range(k)) for t in range(20 - k + 1))
                assert best[n, 3 * i + f] == pytest.approx(plain + model.v[f"b{k}"][f])
    assert np.allclose(np.exp(model.log_probabilities(x)).sum(axis=1), 1)
    _, g = model.gradients(x, y)
    for name, v in model.v.items():
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in v.shape) if name != "e" else (x[rng.integers(5), rng.integers(7)], rng.integers(4))
            if name == "e" and at[0] == 0:
                continue
            old = v[at]
            up, down = [], []
            for d, out in ((1e-6, up), (-1e-6, down)):
                v[at] = old + d
                out.append(model.gradients(x, y)[0])
            v[at] = old
            assert g[name][at] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-6)


def test_windows_cover_whole_texts():
    rng = np.random.default_rng(2)
    size = [0, 1, 63, 64, 65, 125, 126, 300, 0]
    offs = np.append(0, np.cumsum(size))
    data = rng.integers(1, 256, offs[-1]).astype(np.uint8)
    text, start = bytecnn.window_starts(offs, 64, 3)
    w = bytecnn.windows(data, start, np.minimum(start + 64, offs[1:][text]), 64)
    for i, n in enumerate(size):
        own, first = w[text == i], start[text == i] - offs[i]
        whole = data[offs[i] : offs[i + 1]]
        assert len(own) >= 1 and first[0] == 0
        runs = {(int(a) + j, *row[j : j + 4]) for a, row in zip(first, own, strict=True) for j in range(61)}
        assert {(j, *whole[j : j + 4]) for j in range(n - 3)} <= runs  # every run of four bytes lies in a window
        assert all((row[: n - a] == whole[a : a + 64]).all() and not row[max(0, n - a) :].any() for a, row in zip(first, own, strict=True))


def test_languages(spark):
    ship(spark)
    rng = random.Random(4)
    rows = [(i, said(rng, lang := rng.choice(["aa", "bb", "bb", "bb", "cc"]), rng.choice([3, 20, 200])), lang) for i in range(900)]
    rows += [(5000, None, "aa"), (5001, "", "aa"), (5002, "12 !? 34", None), (5003, said(rng, "cc", 30_000), None), (5004, said(rng, "aa", 400) + " " + said(rng, "bb", 4000), None), (None, said(rng, "aa", 50), "bb"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("h", F.lit(1)).repartition(4)
    got = bytecnn.languages(df, SMALL)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (5000, 5001, 5002, 5003, 5004, None)] == ["und", "und", "und", "cc", "bb", "aa"] and by[5000].score == 0 and not by[None].held_out
    scores = {r["lang"]: (r.n, r.correct) for r in bytecnn.accuracy(got, df).collect()}
    assert set(scores) == {"aa", "bb", "cc"} and all(ok >= 0.95 * n for n, ok in scores.values())
    again = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in bytecnn.languages(df.repartition(7), SMALL).collect()}
    assert again == {k: (r.lang_pred, round(r.score, 6)) for k, r in by.items()}


def test_nothing_to_learn(spark):
    ship(spark)
    assert bytecnn.languages(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "text", None), (2, None, "aa"), (3, "", "aa")]
    assert {tuple(r)[2:] for r in bytecnn.languages(spark.createDataFrame(rows, SCHEMA)).collect()} == {("und", 0.0)}
    one = bytecnn.languages(spark.createDataFrame([(i, "ein Text", "bb") for i in range(8)], SCHEMA), SMALL).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("bb", 1.0)} and {r.held_out for r in one} == {True, False}


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    ship(spark)
    rng = random.Random(6)
    rows = [(i, said(rng, lang := rng.choice(["aa", "bb"]), 20), lang) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    other = df.withColumn("lang", F.when(bytecnn.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: tuple(r) for r in bytecnn.languages(x, SMALL).collect()} for x in (df, other))
    assert a == b
