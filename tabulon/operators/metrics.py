"""Scores of predictions, their aggregates and standard errors, and roll-ups over tasks and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..work import small, written

# --- one prediction ---


def exact_match(p: Column, t: Column) -> Column:
    return F.coalesce(p == t, F.lit(False))


def float_match(p: Column, t: Column, tolerance: float = 1e-7) -> Column:
    """Numbers within the tolerance; what doesn't parse doesn't match."""
    return F.coalesce(F.abs(p.try_cast("double") - t.try_cast("double")) <= tolerance, F.lit(False))


def distance(p: Column, t: Column, cap: float = 10.0, eps: float = 1e-7) -> Column:
    """Distance relative to the target, capped; a prediction or target that doesn't parse costs the cap."""
    a, b = p.try_cast("double"), t.try_cast("double")
    return F.when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b), F.lit(cap)).otherwise(F.least(F.lit(cap), F.abs(a - b) / (F.abs(b) + eps)))


def absolute_distance(p: Column, t: Column, penalty: float) -> Column:
    a, b = p.try_cast("double"), t.try_cast("double")
    return F.coalesce(F.abs(a - b), F.lit(penalty))


def with_metrics(df: DataFrame, prediction: str = "prediction", target: str = "answer") -> DataFrame:
    p, t = F.trim(prediction), F.col(target)
    return df.withColumns({"exact_match": exact_match(p, t).cast("int"), "float_match": float_match(p, t).cast("int"), "absolute_distance": distance(p, t)})


# --- aggregates ---


def upper_median(c: Column) -> Column:
    """The middle value, of two the greater."""
    v = F.array_sort(F.collect_list(c))
    return F.element_at(v, F.floor(F.size(v) / 2).cast("int") + 1)


def exact_upper_median(df: DataFrame, keys: list[str], value: str, most_rows: int = 100_000, splits: int = 200) -> DataFrame:
    """The same for groups of any size; nulls don't count.

    Groups of more than `most_rows` rows are narrowed first: of `splits` approximate percentiles the ones round the wanted
    rank are taken, rows below are counted, and only rows between go on, until few are left or one value is. Sketches and
    counts add up before their shuffle, so no task holds a group. Of few rows, counts by value have a running sum.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sizes = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.floor(F.col("_n") / 2) + 1), "median")
    kind = rows.schema["_v"].dataType
    state = sizes.select(*keys, "_n", "_k", F.lit(None).cast(kind).alias("_lo"), F.lit(None).cast(kind).alias("_hi"), F.lit(None).cast(kind).alias("_found"))
    settled = [state.where(F.col("_n") <= most_rows)]
    state = state.where(F.col("_n") > most_rows)

    def inside(of: DataFrame) -> DataFrame:
        """Rows of the groups between their bounds, with the group's state."""
        named = of.select(*(F.col(c).alias(f"_of_{c}") for c in keys), "_n", "_k", "_lo", "_hi")
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys), F.lit(True))
        above, below = F.col("_v") > F.col("_lo"), F.col("_v") < F.col("_hi")
        return rows.join(small(named, 100_000), same & F.coalesce(above, F.lit(True)) & F.coalesce(below, F.lit(True))).select(*keys, "_v", "_n", "_k")

    while not state.isEmpty():
        at = [i / splits for i in range(splits + 1)]
        points = inside(state).groupBy(*keys).agg(F.percentile_approx("_v", at, 20 * splits).alias("_q"), F.first("_n").alias("_n"), F.first("_k").alias("_k"))
        place = F.floor(F.col("_k") * splits / F.col("_n")).cast("int")
        edge = points.select(*keys, "_n", "_k", F.get("_q", F.greatest(place - 1, F.lit(0))).alias("_lo"), F.get("_q", F.least(place + 2, F.lit(splits))).alias("_hi"))
        edge = written(edge, "median")
        of = edge.select(*(F.col(c).alias(f"_of_{c}") for c in keys), F.col("_lo").alias("_a"), F.col("_hi").alias("_z"))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys), F.lit(True))
        v = F.col("_v")
        counted = inside(state).join(small(of, 100_000), same).groupBy(*keys).agg(F.first("_k").alias("_k"), F.first("_a").alias("_lo"), F.first("_z").alias("_hi"), F.count_if(v < F.col("_a")).alias("_below"), F.count_if(v == F.col("_a")).alias("_low"), F.count_if((v > F.col("_a")) & (v < F.col("_z"))).alias("_n"))
        k = F.col("_k") - F.col("_below")
        found = F.when(k <= F.col("_low"), F.col("_lo")).when(k > F.col("_low") + F.col("_n"), F.col("_hi"))
        state = written(counted.select(*keys, "_n", (k - F.col("_low")).alias("_k"), "_lo", "_hi", found.alias("_found")), "median")
        done = F.col("_found").isNotNull() | (F.col("_n") <= most_rows)
        settled.append(state.where(done))
        state = state.where(~done)
    end = reduce(DataFrame.unionByName, settled)
    by = inside(end.where("_found IS NULL")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("n"), F.first("_k").alias("_k"))
    w = Window.partitionBy(*keys).orderBy("_v")
    run = by.withColumn("upto", F.sum("n").over(w))
    few = run.where((F.col("upto") >= F.col("_k")) & (F.col("upto") - F.col("n") < F.col("_k"))).select(*keys, F.col("_v").alias("upper_median"))
    return few.unionByName(end.where("_found IS NOT NULL").select(*keys, F.col("_found").alias("upper_median")))


def perplexity(logprob: Column) -> Column:
    return F.exp(-F.avg(logprob))


def weighted_perplexity(logprob: Column, weight: Column) -> Column:
    return F.exp(-F.sum(logprob) / F.sum(weight))


def bits_per_byte(logprob: Column, n_bytes: Column) -> Column:
    return -(F.sum(logprob) / F.sum(n_bytes)) / F.log(F.lit(2.0))


def _confusion(p: Column, t: Column) -> tuple[Column, Column, Column, Column]:
    n = lambda a, b: F.sum(((p == a) & (t == b)).cast("double"))
    return n(1, 1), n(1, 0), n(0, 1), n(0, 0)


def f1(p: Column, t: Column) -> Column:
    tp, fp, fn, _ = _confusion(p, t)
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def matthews(p: Column, t: Column) -> Column:
    tp, fp, fn, tn = _confusion(p, t)
    return F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


def brier(probabilities: Column, gold: Column) -> Column:
    """Mean squared distance between the probabilities and the gold class (from 0)."""
    return F.avg(F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - (i == gold).cast("double"), F.lit(2))), F.lit(0.0), lambda a, b: a + b))


def all_correct(df: DataFrame, question: list[str], correct: str) -> DataFrame:
    """Share of questions whose answers are all right."""
    return df.groupBy(*question).agg(F.bool_and(F.col(correct) == 1).alias("ok")).agg(F.avg(F.col("ok").cast("double")).alias("acc_all"))


def best_over_truths(score: Callable[[Column, Column], Column], p: Column, truths: Column) -> Column:
    return F.array_max(F.transform(truths, lambda t: score(p, t).cast("double")))


def mean_stderr(c: Column) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


# --- corpus-level text scores: counts of n-grams add up over rows, so partial sums do ---


def _clipped(a: Column, b: Column) -> Column:
    """Matches of two arrays, each element as often as it occurs in both: of equal runs in sorted order the shorter counts.

    Elements are numbered within their value, so the matches are the common (element, number) pairs.
    """
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def _numbered(a: Column) -> Column:
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.array().cast("array<struct<x:string,n:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(s["last"] == x, s["n"] + 1).otherwise(1)
        return F.struct(x.alias("last"), n.alias("n"), F.concat(s["out"], F.array(F.struct(x.alias("x"), n.alias("n")))).alias("out"))

    return F.aggregate(F.array_sort(a), start, step, lambda s: s["out"])


def bleu_counts(df: DataFrame, prediction: str, reference: str, most: int = 4) -> DataFrame:
    """The rows with what BLEU adds up: hyp and ref words, matches m1.. and n-grams t1.. of each order."""
    from ..functions.text import ngrams, words

    df = df.withColumns({"_p": words(F.col(prediction)), "_r": words(F.col(reference))})  # split once
    p, r = F.col("_p"), F.col("_r")
    out = {"hyp": F.size(p), "ref": F.size(r)}
    for n in range(1, most + 1):
        a, b = ngrams(p, n), ngrams(r, n)
        out |= {f"m{n}": _clipped(a, b), f"t{n}": F.size(a)}
    return df.select(*(c for c in df.columns if c not in ("_p", "_r")), *(c.alias(k) for k, c in out.items()))


def bleu_of_counts(most: int = 4) -> Column:
    """BLEU of added-up counts: exponential smoothing of zero counts, brevity penalty."""
    logs, zeros = [], F.lit(0)
    for n in range(1, most + 1):
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        zeros = zeros + (m == 0).cast("int")
        logs.append(F.log(F.when(m == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * F.greatest(t, F.lit(1)))).otherwise(F.lit(100.0) * m / t)))
    brevity = F.when(F.col("hyp") < F.col("ref"), F.exp(1 - F.col("ref") / F.col("hyp"))).otherwise(1.0)
    return brevity * F.exp(reduce(lambda x, y: x + y, logs) / most)


def _added(df: DataFrame, names: list[str]) -> DataFrame:
    return df.agg(*(F.sum(c).alias(c) for c in names))


def bleu(df: DataFrame, prediction: str, reference: str, most: int = 4) -> DataFrame:
    """Corpus BLEU over white-space tokens: clipped n-gram matches, exponential smoothing of zero counts, brevity penalty."""
    counts = bleu_counts(df.select(prediction, reference), prediction, reference, most)
    return _added(counts, bleu_names(most)).select(bleu_of_counts(most).alias("bleu"))


def bleu_names(most: int = 4) -> list[str]:
    return ["hyp", "ref", *(f"{x}{n}" for n in range(1, most + 1) for x in "mt")]


def chrf_counts(df: DataFrame, prediction: str, reference: str, most: int = 6) -> DataFrame:
    """The rows with what chrF adds up: matches m1.., and character n-grams of both texts a1.., b1.. of each order."""
    text = lambda c: F.regexp_replace(c, r"\s+", "")

    def grams(c: Column, n: int) -> Column:
        k = F.length(c) - n + 1
        return F.when(k >= 1, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    df = df.withColumns({"_p": text(F.col(prediction)), "_r": text(F.col(reference))})
    p, r, out = F.col("_p"), F.col("_r"), {}
    for n in range(1, most + 1):
        a, b = grams(p, n), grams(r, n)
        out |= {f"m{n}": _clipped(a, b), f"a{n}": F.size(a), f"b{n}": F.size(b)}
    return df.select(*(c for c in df.columns if c not in ("_p", "_r")), *(c.alias(k) for k, c in out.items()))


def chrf_of_counts(most: int = 6, beta: float = 2.0) -> Column:
    """chrF of added-up counts, averaged over orders that occur in both texts."""
    precision = [F.try_divide(F.col(f"m{n}"), F.col(f"a{n}")) for n in range(1, most + 1)]
    recall = [F.try_divide(F.col(f"m{n}"), F.col(f"b{n}")) for n in range(1, most + 1)]
    both = F.filter(F.array(*(F.struct(p.alias("p"), r.alias("r")) for p, r in zip(precision, recall, strict=True))), lambda x: x["p"].isNotNull() & x["r"].isNotNull())
    mean = lambda k: F.aggregate(both, F.lit(0.0), lambda s, x: s + x[k]) / F.greatest(F.size(both), F.lit(1))
    p, r = mean("p"), mean("r")
    return 100 * F.coalesce(F.try_divide((1 + beta**2) * p * r, beta**2 * p + r), F.lit(0.0))


def chrf_names(most: int = 6) -> list[str]:
    return [f"{x}{n}" for n in range(1, most + 1) for x in "mab"]


def chrf(df: DataFrame, prediction: str, reference: str, most: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF: character n-gram F-score, white space left out, averaged over orders that occur."""
    counts = chrf_counts(df.select(prediction, reference), prediction, reference, most)
    return _added(counts, chrf_names(most)).select(chrf_of_counts(most, beta).alias("chrf"))


def _numbered_words(p: str | None, r: str | None, case: bool) -> list[np.ndarray]:
    numbers: dict[str, int] = {}
    fold = (lambda t: t) if case else str.lower
    return [np.array([numbers.setdefault(w, len(numbers)) for w in fold(t or "").split()], dtype=np.int64) for t in (p, r)]


def _edit_rows(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Rows of the edit table of x against y; words inserted along a row by a running minimum."""
    steps = np.arange(len(y) + 1)
    rows = [steps.copy()]
    for word in x:
        new = rows[-1] + 1
        np.minimum(new[1:], rows[-1][:-1] + (y != word), out=new[1:])
        rows.append(np.minimum.accumulate(new - steps) + steps)
    return rows


def _aligned(x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Edits, which words of x and of y are part of one, and the place in x where each word of y stands."""
    rows = _edit_rows(x, y)
    i, j = len(x), len(y)
    wrong_x, wrong_y, place = np.ones(i, bool), np.ones(j, bool), np.zeros(j, np.int64)
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            wrong_x[i] = wrong_y[j] = x[i] != y[j]
            place[j] = i
        elif j and rows[i][j] == rows[i][j - 1] + 1:
            j -= 1
            place[j] = i
        else:
            i -= 1
    return int(rows[-1][-1]), wrong_x, wrong_y, place


def shifted_edits(p: str | None, r: str | None, most_words: int = 10, most_distance: int = 50, most_tries: int = 1000, most_cells: int = 4_000_000, case: bool = False) -> int:
    """Edits between word sequences where moving a block of words counts one.

    As long as a move leaves fewer edits, the one that leaves fewest is made (of equal ones the longest block, then the
    first). A block has up to `most_words` words, equals a block of the reference up to `most_distance` places away, holds a
    word in error on both sides, and goes to where that block stands. Sequences whose table has more than
    `most_cells` cells count no moves.
    """
    x, y = _numbered_words(p, r, case)
    if len(x) * len(y) > most_cells:
        return word_error_edits(p, r, case)
    moves = 0
    while True:
        edits, wrong_x, wrong_y, place = _aligned(x, y)
        if not edits:
            return moves
        best, tries = None, 0
        for i in range(len(x)):
            for j in np.flatnonzero(y == x[i]):
                if abs(i - j) > most_distance:
                    continue
                n = 0
                while n < most_words and i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                    at = int(place[j])
                    if i <= at <= i + n or not wrong_x[i : i + n].any() or not wrong_y[j : j + n].any() or tries >= most_tries:
                        continue
                    tries += 1
                    rest = np.delete(x, slice(i, i + n))
                    moved = np.insert(rest, at if at < i else at - n, x[i : i + n])
                    key = (edits - int(_edit_rows(moved, y)[-1][-1]), n, -i, -at)
                    if best is None or key > best[0]:
                        best = key, moved
        if best is None or best[0][0] <= 0:
            return moves + edits
        x, moves = best[1], moves + 1


def word_error_edits(p: str | None, r: str | None, case: bool = True) -> int:
    """Edits between word sequences (no moves), a row of the table at a time."""
    x, y = _numbered_words(p, r, case)
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for word in x:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (y != word), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def translation_edit_rate(df: DataFrame, prediction: str, reference: str, shifts: bool = True, case: bool = False) -> DataFrame:
    """Corpus edit rate in percent of reference words; a moved block of words is one edit, unless `shifts` is off."""

    @F.pandas_udf(LongType())
    def edits(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([shifted_edits(x, y, case=case) if shifts else word_error_edits(x, y, case) for x, y in zip(p, r, strict=True)])

    from ..functions.text import words

    return df.agg((100.0 * F.sum(edits(prediction, reference)) / F.sum(F.size(words(F.col(reference))))).alias("ter"))


# --- standard errors ---


def bootstrap_stderr(df: DataFrame, value: str, statistic: Callable[[np.ndarray], float] = np.mean, iterations: int = 1000, chunk: int = 100, seed: int = 1234, most_rows: int = 1_000_000) -> float:
    """Standard deviation of any statistic of few values over resamples; what is worked out from sums goes to `bootstrap`.

    Resampling needs all values at once, so more than `most_rows` rows are refused.
    """
    rows = df.select(F.col(value).cast("double")).limit(most_rows + 1).toPandas().iloc[:, 0].to_numpy()
    if len(rows) > most_rows:
        raise ValueError("too many rows for resampling here; use bootstrap")
    out = []
    for c in range(-(-iterations // chunk)):
        rng = np.random.default_rng(seed + c)
        out += [statistic(rows[rng.integers(0, len(rows), len(rows))]) for _ in range(min(chunk, iterations - c * chunk))]
    return float(np.std(out, ddof=1))


def _resampled(batches: Iterator[pa.RecordBatch], names: list[str], iterations: int) -> Iterator[pa.RecordBatch]:
    """A task's sums in every resample: one row for each."""
    edges = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(12)])
    steps = np.arange(1, iterations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums, any_rows = np.zeros((iterations, len(names))), False
    for batch in batches:
        values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1) if batch.num_rows else np.zeros((0, len(names)))
        h = batch.column("_h").to_numpy().view(np.uint64)
        for a in range(0, len(h), 1024):
            z = h[a : a + 1024, None] + steps
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            times = np.searchsorted(edges, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")
            sums += times.T @ np.nan_to_num(values[a : a + 1024])
            any_rows = True
    if any_rows:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations), pa.int64()), *(pa.array(sums[:, k]) for k in range(len(names)))], names=["i", *names])


def resamples(df: DataFrame, statistics: list[str], identity: str, iterations: int = 200, seed: int = 1234) -> DataFrame:
    """(i, sums of the statistics): in each resample a row counts a Poisson(1) number of times, by a hash of its identity.

    A task adds up all resamples of its rows and sends one row for each, so nothing grows with the rows; a null adds nothing.
    """
    kinds = ", ".join(f"{c} double" for c in statistics)
    rows = df.select(F.xxhash64(F.lit(seed), F.col(identity)).alias("_h"), *(F.col(c).cast("double").alias(c) for c in statistics))
    parts = rows.mapInArrow(lambda it: _resampled(it, statistics, iterations), f"i long, {kinds}")
    return parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in statistics))


def bootstrap(df: DataFrame, statistics: list[str], value: Column, identity: str, iterations: int = 200, seed: int = 1234) -> DataFrame:
    """(value, stderr) of a number that is worked out from sums of `statistics`: of all rows, and its deviation over resamples. No rows go to the driver."""
    whole = _added(df.select(*(F.col(c).cast("double").alias(c) for c in statistics)), statistics).select(value.alias("value"))
    spread = resamples(df, statistics, identity, iterations, seed).select(value.alias("m")).agg(F.stddev_samp("m").alias("stderr"))
    return whole.crossJoin(spread)  # one row each


def poisson_bootstrap(df: DataFrame, value: str, identity: str, iterations: int = 200, seed: int = 1234) -> DataFrame:
    """stderr of the mean over resamples."""
    counted = df.select(identity, F.col(value).cast("double").alias("v"), F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0).alias("n"))
    return bootstrap(counted, ["v", "n"], F.col("v") / F.col("n"), identity, iterations, seed).select("stderr")


def confusion_counts(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """The rows with tp, fp, fn, tn: what f1 and mcc add up."""
    p, t = F.col(prediction), F.col(target)
    return df.withColumns({k: ((p == a) & (t == b)).cast("double") for k, (a, b) in {"tp": (1, 1), "fp": (1, 0), "fn": (0, 1), "tn": (0, 0)}.items()})


def f1_of_counts() -> Column:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def matthews_of_counts() -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))


#: Numbers that are worked out from sums over rows: columns that are added up for a prediction and a target, their names, and the number.
OF_SUMS: dict[str, tuple[Callable[[DataFrame, str, str], DataFrame], list[str], Callable[[], Column]]] = {
    "f1": (confusion_counts, ["tp", "fp", "fn", "tn"], f1_of_counts),
    "mcc": (confusion_counts, ["tp", "fp", "fn", "tn"], matthews_of_counts),
    "bleu": (bleu_counts, bleu_names(), bleu_of_counts),
    "chrf": (chrf_counts, chrf_names(), chrf_of_counts),
}


def metric_stderr(df: DataFrame, metric: str, prediction: str, target: str, identity: str, iterations: int = 200, seed: int = 1234) -> DataFrame:
    """(value, stderr) of a metric: by the formula where `STDERR` has one, by resampling where `OF_SUMS` has its sums."""
    if metric in STDERR:
        right = exact_match(F.col(prediction), F.col(target)).cast("double")
        return df.agg(F.avg(right).alias("value"), STDERR[metric](right).alias("stderr"))
    if metric not in OF_SUMS:
        raise ValueError(f"no standard error is known for {metric}")
    counts, names, value = OF_SUMS[metric]
    return bootstrap(counts(df.select(identity, prediction, target), prediction, target), names, value(), identity, iterations, seed)


def pooled_stderr(stderr: Column, n: Column) -> Column:
    """Of groups: variances stderr**2 * n pooled with weights n - 1, over the total size."""
    return F.sqrt(F.sum((n - 1) * stderr * stderr * n) / (F.sum(n) - F.count(n)) / F.sum(n))


def combined_stderr(groups: list[tuple[float, float, int]]) -> float:
    """Of (metric, stderr, n) groups in order, between-group spread included."""
    mean, var, size = groups[0][0], groups[0][1] ** 2, groups[0][2]
    for m, s, n in groups[1:]:
        v = s**2
        var = ((size - 1) * var + (n - 1) * v) / (size + n - 1) + size * n / ((size + n) * (size + n - 1)) * (mean - m) ** 2
        mean, size = (mean * size + m * n) / (size + n), size + n
    return float(var**0.5)


def weighted_mean(metric: Column, n: Column) -> Column:
    return F.sum(metric * n) / F.sum(n)


STDERR: dict[str, Callable[[Column], Column]] = {"mean": mean_stderr, "acc_all": mean_stderr}
AGGREGATIONS: dict[str, Callable[..., Column]] = {"mean": F.avg, "median": upper_median, "perplexity": perplexity, "weighted_perplexity": weighted_perplexity, "bits_per_byte": bits_per_byte, "f1": f1, "mcc": matthews, "brier": brier}


def register_aggregation(name: str, f: Callable[..., Column]) -> None:
    AGGREGATIONS[name] = f


def by_task(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """metric, stderr and n of each task, metric and filter."""
    return samples.groupBy(*keys).agg(F.avg(value).alias("metric"), mean_stderr(F.col(value)).alias("stderr"), F.count(value).alias("n"))


def roll_up(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Task rows (metric, stderr, n) to groups: size-weighted metric, pooled stderr, total n."""
    return tasks.groupBy(*keys).agg(weighted_mean(F.col("metric"), F.col("n")).alias("metric"), pooled_stderr(F.col("stderr"), F.col("n")).alias("stderr"), F.sum("n").alias("n"))


def multiple_choice(df: DataFrame, scores: str = "lls", lengths: str = "lengths", gold: str = "gold", unconditional: str | None = None) -> DataFrame:
    """acc, acc_norm (by length) and, with unconditional scores, acc_mutual_info of each row."""
    from ..functions.text import argmax

    out = {"acc": (argmax(F.col(scores)) == F.col(gold)).cast("int"), "acc_norm": (argmax(F.transform(F.arrays_zip(F.col(scores).alias("s"), F.col(lengths).alias("n")), lambda x: x["s"] / x["n"])) == F.col(gold)).cast("int")}
    if unconditional:
        out["acc_mutual_info"] = (argmax(F.transform(F.arrays_zip(F.col(scores).alias("s"), F.col(unconditional).alias("u")), lambda x: x["s"] - x["u"])) == F.col(gold)).cast("int")
    return df.withColumns(out)


def requests(docs: DataFrame, context: str, choices: str, mutual_info: bool = False) -> DataFrame:
    """One row per document and choice to be scored, and the unconditional ones if asked for."""
    rows = docs.select("doc_id", F.col(context).alias("context"), F.posexplode(choices).alias("choice_id", "continuation"))
    rows = rows.withColumn("unconditional", F.lit(False))
    return rows.unionByName(rows.withColumns({"context": F.lit(""), "unconditional": F.lit(True)})) if mutual_info else rows


def rolling_scores(df: DataFrame, text: str, logprob: str) -> DataFrame:
    """word_perplexity, byte_perplexity, bits_per_byte over documents."""
    from ..functions.text import word_count

    lp, w, b = F.col(logprob), word_count(F.col(text)), F.octet_length(text)
    return df.agg(weighted_perplexity(lp, w).alias("word_perplexity"), weighted_perplexity(lp, b).alias("byte_perplexity"), bits_per_byte(lp, b).alias("bits_per_byte"))
