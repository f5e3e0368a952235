"""Normalisation and profiling of corpora of tables.

A corpus is two frames: `tables(table_id?, name, header array<string>, ...)` with nested `rows
array<array<string>>`, or the flat `cells(table, row_id, col_id, name, value)` form for profiles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import clean_cell, has_number, is_number, to_number


def fill_header(header: Column) -> Column:
    """Empty names become column_<index>."""
    return F.transform(header, lambda x, i: F.when(x == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(x))


def unique_names(names: list[str], most_rounds: int = 4) -> list[str]:
    """Case-insensitively unique names: later ones get _<occurrence>, again until nothing clashes."""
    for _ in range(most_rounds + 1):
        if len({n.lower() for n in names}) == len(names):
            return names
        seen: dict[str, int] = {}
        out = []
        for n in names:
            k = seen[n.lower()] = seen.get(n.lower(), 0) + 1
            out.append(n if k == 1 else f"{n}_{k}")
        names = out
    raise ValueError(f"names clash after {most_rounds} rounds: {names}")


@F.pandas_udf(ArrayType(StringType()))
def dedup_header(headers: pd.Series) -> pd.Series:
    """`unique_names` of each row; iterative, so outside Column expressions."""
    return headers.map(lambda h: None if h is None else unique_names(list(h)))


def clean_rows(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, clean_cell))


def unpivot(df: DataFrame, table: str, order: str) -> DataFrame:
    """A native table as string cells: table, row_id, col_id, name, value. `order` numbers rows; it must be an integer key."""
    cells = F.array(*(F.struct(F.lit(i).alias("col_id"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(df.columns)))
    return df.select(F.lit(table).alias("table"), F.col(order).cast("long").alias("row_id"), F.explode(cells).alias("c")).select("table", "row_id", "c.*")


def column_types(cells: DataFrame, sample: int | None = None) -> DataFrame:
    """table, name, type: numeric if all cells are numbers, alphanumeric if all hold one, else text.

    `sample` takes that many rows per table by a hash of the row.
    """
    if sample is not None:
        w = Window.partitionBy("table", "name").orderBy(F.xxhash64("row_id"), "row_id")
        cells = cells.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample)
    v = F.coalesce("value", F.lit(""))
    seen = cells.groupBy("table", "name").agg(F.bool_and(is_number(v)).alias("n"), F.bool_and(has_number(v)).alias("a"))
    return seen.select("table", "name", F.when(F.col("n"), "numeric").when(F.col("a"), "alphanumeric").otherwise("text").alias("type"))


def strip_commas(value: Column, kind: Column) -> Column:
    return F.when(kind == "numeric", F.regexp_replace(value, ",", "")).otherwise(value)


def column_profile(cells: DataFrame) -> DataFrame:
    """table, name, n_rows, n_distinct, density (distinct over rows), nulls counted as values."""
    out = cells.groupBy("table", "name").agg(F.count(F.lit(1)).alias("n_rows"), (F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("n_distinct"))
    return out.withColumn("density", F.col("n_distinct") / F.col("n_rows"))


def column_values(cells: DataFrame, distinct: bool = False) -> DataFrame:
    """Values of columns; distinct ones with the row that shows them first."""
    return cells.groupBy("table", "name", "value").agg(F.min("row_id").alias("first_row")) if distinct else cells.select("table", "name", "row_id", "value")


def columns_of_type(types: DataFrame, kind: str) -> DataFrame:
    return types.where(F.col("type") == kind).groupBy("table").agg(F.array_sort(F.collect_list("name")).alias("names"))


def schema_id(names: Column, types: Column) -> Column:
    """SHA-256 of the sorted names and their types in the same order."""
    pairs = F.array_sort(F.arrays_zip(names.alias("n"), types.alias("t")))
    return F.sha2(F.concat(F.array_join(F.transform(pairs, lambda x: x["n"]), ""), F.array_join(F.transform(pairs, lambda x: x["t"]), "")), 256)


def column_checksums(cells: DataFrame, types: DataFrame) -> DataFrame:
    """table, checksum: texts of the numeric columns, by name, each joined in row order.

    The joined text is what identity needs, so a table's numeric cells meet in one row.
    """
    numeric = cells.join(types.where("type = 'numeric'").select("table", "name"), ["table", "name"])
    per = numeric.groupBy("table", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "value"))), lambda x: x["value"]), "").alias("t"))
    return per.groupBy("table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "t"))), lambda x: x["t"]), "").alias("checksum"))


def table_ids(cells: DataFrame, types: DataFrame) -> DataFrame:
    """table, table_id of schema id, checksum and size."""
    schema = types.groupBy("table").agg(F.collect_list(F.struct("name", "type")).alias("c")).select("table", F.size("c").alias("n_cols"), schema_id(F.transform("c", lambda x: x["name"]), F.transform("c", lambda x: x["type"])).alias("schema_id"))
    rows = cells.groupBy("table").agg(F.count_distinct("row_id").alias("n_rows"))
    out = schema.join(rows, "table").join(column_checksums(cells, types), "table", "left")
    size = F.format_string("(%d, %d)", F.col("n_cols"), F.col("n_rows"))
    return out.select("table", "schema_id", F.sha2(F.concat("schema_id", F.coalesce("checksum", F.lit("")), size), 256).alias("table_id"))


def row_sample_hash(header: Column, rows: Column, at: tuple[int, ...] = (0, 5, 100)) -> Column:
    """Hash of the header and the rows at some positions, taken modulo the table's length."""
    n = F.greatest(F.size(rows), F.lit(1))
    picks = [F.try_element_at(rows, (F.lit(i) % n) + 1) for i in at]
    return F.sha2(F.to_json(F.struct(header.alias("h"), F.array(*picks).alias("r"))), 256)


def header_hash(header: Column, rows: Column) -> Column:
    return F.sha2(F.concat(F.array_join(header, ""), F.size(rows).cast("string")), 256)


def full_hash(header: Column, rows: Column) -> Column:
    return F.sha2(F.to_json(F.struct(header.alias("h"), rows.alias("r"))), 256)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key: the first in order. Aggregates before the shuffle, so copies cost a row a task."""
    first = F.min_by(F.struct(*df.columns), F.struct(order))
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(first.alias("_r")).select("_r.*")


def long_names(tables: DataFrame, least: int, header: str = "header") -> DataFrame:
    """Tables with a column name of at least so many characters."""
    return tables.where(F.array_max(F.transform(header, F.length)) >= least)


def require(df: DataFrame, fields: list[str]) -> DataFrame:
    """Only the named fields; raises if one is missing."""
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return df.select(*fields)


def nest(df: DataFrame, name: str) -> DataFrame:
    """All columns in one struct."""
    return df.select(F.struct(*df.columns).alias(name))


def argsort(values: Column) -> Column:
    """Positions (from 0) in sorted order, stable."""
    return F.transform(F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def take_order(values: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.element_at(values, i + 1))


def names_to_ids(header: Column) -> Column:
    return F.map_from_entries(F.transform(header, lambda n, i: F.struct(n, i)))


def header_is_data(header: Column, rows: Column) -> Column:
    """Header cells look like the data below: the kinds of most sampled rows, and in all-text tables no column whose header is more than a tenth longer or shorter than its cells on average."""
    from ..functions.text import cell_kind

    kinds = F.transform(header, cell_kind)
    sample = F.slice(rows, 1, 5)
    mode = lambda i: F.array_max(F.transform(F.array(*map(F.lit, ("int", "float", "num_text", "text"))), lambda k: F.struct(F.size(F.filter(sample, lambda r: cell_kind(F.try_element_at(r, i + 1)) == k)).alias("n"), k.alias("k"))))["k"]
    majority = F.transform(header, lambda _, i: mode(i))
    of = lambda i: F.transform(sample, lambda r: F.coalesce(F.length(F.try_element_at(r, i + 1)), F.lit(0)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))
    lengths = F.transform(header, lambda h, i: F.struct(F.length(h).cast("double").alias("own"), mean(of(i)).alias("below")))
    apart = F.exists(lengths, lambda x: F.abs(x["own"] - x["below"]) > 0.1 * F.greatest(x["own"], x["below"]))
    return (kinds == majority) & (F.exists(kinds, lambda k: k != "text") | ~apart)


def repair_header(header: Column, rows: Column) -> tuple[Column, Column]:
    """Where the header is data: names col_<i>, and the header back on top of the rows."""
    data = header_is_data(header, rows)
    return F.when(data, F.transform(header, lambda _, i: F.concat(F.lit("col_"), i.cast("string")))).otherwise(header), F.when(data, F.concat(F.array(header), rows)).otherwise(rows)


def normalise_tables(tables: DataFrame) -> DataFrame:
    """(name, header, rows): names filled and unique, cells trimmed."""
    return tables.withColumn("header", dedup_header(fill_header(F.col("header")))).withColumn("rows", clean_rows(F.col("rows")))


def number_cells(cells: DataFrame, types: DataFrame) -> DataFrame:
    """Cells with their column's type and, for numeric columns, the number."""
    typed = cells.join(types, ["table", "name"])
    return typed.withColumn("number", F.when(F.col("type") == "numeric", to_number(F.col("value"))))
