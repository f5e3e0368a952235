"""Grouped and binned reports over results and question datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: list[str], metrics: list[str], where: dict[str, Column] | None = None) -> DataFrame:
    """Mean and count of each metric by keys; rows with a null key are left out, NaN counts as missing."""
    df = filtered(df, where or {})
    df = df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True)))
    clean = {m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m)) for m in metrics}
    return df.groupBy(*keys).agg(*(a for m in metrics for a in (F.avg(clean[m]).alias(f"{m}_mean"), F.count(clean[m]).alias(f"{m}_count"))))


def filtered(df: DataFrame, where: dict[str, Column | object]) -> DataFrame:
    for c, test in where.items():
        df = df.where(test if isinstance(test, Column) else F.col(c).isin(*test) if isinstance(test, (list, tuple, set)) else F.col(c) == test)
    return df


def bin_of(value: Column, edges: list[float]) -> Column:
    """The greatest edge not above the value; null below the first."""
    return F.array_max(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value))


def nearest_bin(value: Column, bins: list[float]) -> Column:
    """The bin at least distance, of two the smaller."""
    return F.array_min(F.transform(F.array(*map(F.lit, bins)), lambda b: F.struct(F.abs(value - b).alias("d"), b.alias("b"))))["b"]


def equal_step_edges(df: DataFrame, value: str, n: int) -> list[float]:
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    return [] if lo is None else sorted({lo + (hi - lo) * i / n for i in range(n)})


def equal_count_edges(df: DataFrame, value: str, n: int) -> list[float]:
    """Distinct lower edges of n bins of equal count (exact percentiles)."""
    at = [i / n for i in range(n)]
    return sorted(set(df.agg(F.percentile(value, F.array(*map(F.lit, at)))).first()[0] or []))


def binned(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    return df.withColumn("bin", bin_of(F.col(value), edges))


def histogram(df: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    """bucket 1..n of equal width (0 below, n + 1 at or above the end) and its rows."""
    return df.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(n)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def aggregator_statistics(questions: DataFrame, aggregators: list[str], table: str = "table_id", op: str = "operator") -> DataFrame:
    """Of each aggregator: questions in all, mean and population deviation per table."""
    per = questions.groupBy(table).agg(*(F.sum((F.col(op) == a).cast("long")).alias(f"n{i}") for i, a in enumerate(aggregators)))
    rows = F.array(*(F.struct(F.lit(a).alias("aggregator"), F.col(f"n{i}").alias("n")) for i, a in enumerate(aggregators)))
    return per.select(F.explode(rows).alias("r")).groupBy("r.aggregator").agg(F.sum("r.n").alias("total"), F.avg("r.n").alias("mean_per_table"), F.stddev_pop("r.n").alias("std_per_table"))


def table_statistics(df: DataFrame, table: str, value: str) -> DataFrame:
    """mean, sample deviation (from three values on), median and n per table."""
    return df.groupBy(table).agg(F.avg(value).alias("mean"), F.when(F.count(value) > 2, F.stddev_samp(value)).alias("std"), F.median(value).alias("median"), F.count(value).alias("n"))


def statistics_of_statistics(stats: DataFrame, fields: list[str]) -> DataFrame:
    return stats.agg(*(f(c).alias(f"{n}_{c}") for c in fields for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", F.median))))


def table_histograms(df: DataFrame, table: str, field: str) -> DataFrame:
    """Map of value counts of a field, named by that field."""
    per = df.groupBy(table, field).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(table).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "n")))).alias(f"{field}_histogram"))


def dataset_statistics(questions: DataFrame, table: str = "table_id", rows: str = "n_rows") -> DataFrame:
    """Size of a dataset in one row: questions, tables, distribution of questions per table and of aggregated rows."""
    per = questions.groupBy(table).agg(F.count(F.lit(1)).alias("q"), F.sum(rows).alias("s"), F.sum(F.col(rows) * F.col(rows)).alias("ss"), F.min(rows).alias("lo"), F.max(rows).alias("hi"))
    return per.agg(
        F.sum("q").alias("n_questions"), F.count(F.lit(1)).alias("n_tables"), F.avg("q").alias("mean_questions"), F.min("q").alias("min_questions"), F.max("q").alias("max_questions"),
        (F.sum("s") / F.sum("q")).alias("mean_rows"), F.min("lo").alias("min_rows"), F.max("hi").alias("max_rows"),
    )


def correct_by(df: DataFrame, keys: list[str], correct: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(correct).cast("long")).alias("correct"), F.count(F.lit(1)).alias("n"))


def markdown(df: DataFrame, most_rows: int = 1000, digits: int = 4) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most_rows).collect()
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|")
    lines = ["|".join(df.columns), "|".join("---" for _ in df.columns), *("|".join(map(show, r)) for r in rows)]
    return "\n".join(f"|{x}|" for x in lines)


def relabelled(c: Column, names: dict[str, str]) -> Column:
    """Display names: the first key that a text contains decides."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in names.items():
        out = out.when(c.contains(k), v)
    return out.otherwise(c)


def joined_predictions(predictions: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Predictions with their question's columns; `matched` tells whether there is one."""
    q = questions.withColumn("matched", F.lit(True))
    return predictions.join(q, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def with_counts(questions: DataFrame, counts: DataFrame, keys: tuple[str, ...] = ("table_id", "template_hash", "count_hash")) -> DataFrame:
    """Row counts of count questions joined to the questions that share their conditions."""
    return questions.join(counts.select(*keys, F.col("answer").cast("long").alias("n_rows")), list(keys), "left")
