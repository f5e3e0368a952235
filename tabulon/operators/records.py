"""Records of questions, examples and evaluations: few-shot choice, cells of answers, masks, consolidation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..work import written
from .sampling import hashed

# --- few-shot examples ---


def few_shot_choice(docs: DataFrame, pool: DataFrame, k: int, key: str = "doc_id", first: bool = False, seed: int = 0) -> DataFrame:
    """docs with `shots`: array of `k` rows of `pool` (as structs), never the row of its own key.

    One draw of k + 1 rows serves all docs: the first ones by key, or by a seeded hash. A doc that is among
    them gets the others, another doc the first k. The draw has k + 1 rows, so it is broadcast.
    """
    order = [F.col(key)] if first else [hashed(seed, key), F.col(key)]
    drawn = pool.orderBy(*order).limit(k + 1)
    if drawn.count() < k:
        raise ValueError(f"the pool has fewer than {k} examples")
    ranked = drawn.select(F.struct(F.row_number().over(Window.orderBy(*order)).alias("_rank"), F.struct(*pool.columns).alias("row")).alias("x"))  # k + 1 rows
    shots = ranked.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]).alias("_drawn"))
    other = F.slice(F.filter("_drawn", lambda r: ~r[key].eqNullSafe(F.col(key))), 1, k)
    return docs.crossJoin(F.broadcast(shots)).withColumn("shots", other).drop("_drawn")


# --- cells that a model answers with ---

#: What a table model may do with the cells that it picks. Fixed values.
CELL_AGGREGATORS = ("NONE", "SUM", "AVERAGE", "COUNT")


def cell_aggregator(index: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, CELL_AGGREGATORS)), index.cast("int") + 1)


def picked_cells(rows: Column, coordinates: Column, start: int = 0) -> Column:
    """Texts of the cells at (row, col) pairs; pairs outside the table are left out. `start`: the first row's and column's number."""
    inside = lambda i: F.when(i >= start, i - start + 1)
    cells = F.transform(coordinates, lambda c: F.try_element_at(F.try_element_at(rows, inside(c["row"])), inside(c["col"])))
    return F.filter(cells, lambda x: x.isNotNull())


def answer_of_cells(rows: Column, coordinates: Column, start: int = 0) -> Column:
    """The picked cells' texts, joined by commas; '' if there is none."""
    return F.array_join(picked_cells(rows, coordinates, start), ", ")


def aggregated_cells(rows: Column, coordinates: Column, aggregator: Column, start: int = 0) -> Column:
    """A model's answer: its cells as they are, or their sum, mean or number; '' where a sum needs a number and has none."""
    from ..functions.text import to_number

    cells = picked_cells(rows, coordinates, start)
    numbers = F.filter(F.transform(cells, to_number), lambda x: x.isNotNull())
    total, n = F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b), F.size(numbers)
    value = F.when(aggregator == "COUNT", F.size(cells).cast("double")).when((aggregator == "SUM") & (n > 0), total).when((aggregator == "AVERAGE") & (n > 0), total / n)
    return F.when(aggregator == "NONE", F.array_join(cells, ", ")).otherwise(F.coalesce(value.cast("string"), F.lit("")))


# --- parallel arrays ---


def _arrays(df: DataFrame, but: tuple[str, ...]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, ArrayType) and f.name not in but]


def masked(df: DataFrame, mask: str = "filter_condition") -> DataFrame:
    """Every array column cut down to the places where `mask` (an array of booleans) holds; the mask goes."""
    return df.withColumns({c: F.filter(F.col(c), lambda _, i: F.coalesce(F.get(F.col(mask), i), F.lit(False))) for c in _arrays(df, (mask,))}).drop(mask)


def without_places(df: DataFrame, places: str) -> DataFrame:
    """Every array column without the places (from 0) that `places` lists; `places` goes."""
    return df.withColumns({c: F.filter(F.col(c), lambda _, i: ~F.array_contains(places, i)) for c in _arrays(df, (places,))}).drop(places)


def first_item(df: DataFrame, column: str, most_depth: int = 5) -> Column:
    """The first element of a nested array, down to what is no array; deeper nesting than `most_depth` is refused."""
    kind, out = df.schema[column].dataType, F.col(column)
    for _ in range(most_depth):
        if not isinstance(kind, ArrayType):
            return out
        kind, out = kind.elementType, F.get(out, F.lit(0))
    if isinstance(kind, ArrayType):
        raise ValueError(f"arrays nested deeper than {most_depth}")
    return out


def as_texts(df: DataFrame, column: str) -> Column:
    """A nested array with every innermost element as text."""

    def texts(kind, c: Column) -> Column:
        return F.transform(c, lambda x: texts(kind.elementType, x)) if isinstance(kind, ArrayType) else c.cast(StringType())

    return texts(df.schema[column].dataType, F.col(column))


# --- columns and order ---


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def beside(df: DataFrame, other: DataFrame, order: list, other_order: list) -> DataFrame:
    """`other`'s columns beside `df`'s, row by row in the given orders; the shorter one is filled with nulls."""
    at = unused("place", df, other)
    return placed(df, order, at).join(placed(other, other_order, at), at, "full").drop(at)


def unused(name: str, *dfs: DataFrame) -> str:
    """`name`, with underscores put before it until no column has it (in any case)."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def placed(df: DataFrame, order: list, name: str = "_place", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the row's place (from 0) in the whole table's order, or among the rows of its group `by`.

    The sorted ranges are written once to the shared folder, a file each, so the bounds between them are
    frozen: a row's place is its number in its file and the rows of the files before. No task sorts all
    rows, and stages that run again find the same files. Rows that tie in `order` are told apart by a hash
    of their columns, which also deals a frequent key to many ranges; rows equal in all columns stay
    together. Nulls come first, as Spark sorts. An empty table stays empty; columns that Parquet can't
    hold are refused by the writer.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    hashed_types = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keys.append(F.xxhash64(*hashed_types))
    frozen = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys), "places")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-", 1).cast("long")
    part, row, before = (unused(c, df) for c in ("part", "row", "before"))
    rows = frozen.select("*", number.alias(part), F.col("_metadata.row_index").alias(row))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    starts = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    out = rows.join(F.broadcast(starts), part).withColumn(name, F.col(before) + F.col(row)).drop(part, row, before)
    if not by:
        return out
    firsts = out.groupBy(*by).agg(F.min(name).alias(before)).select(*(F.col(c).alias(unused(f"of_{c}", df)) for c in by), before)
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(unused(f"of_{c}", df))) for c in by))
    return out.join(firsts, same).withColumn(name, F.col(name) - F.col(before)).select(*df.columns, name)


def reordered(df: DataFrame, *order, place: str = "original_place", original: list) -> DataFrame:
    """Rows by `order`, each with its place in the `original` order, so that `restored` can go back."""
    return placed(df, original, place).orderBy(*order)


def restored(df: DataFrame, place: str = "original_place") -> DataFrame:
    return df.orderBy(place).drop(place)


def discarded(df: DataFrame, most: int, factor: float, *identity: str, seed: int = 0) -> DataFrame:
    """About `factor` times `most` rows, chosen by hash before anything costly runs; all rows if there are no more.

    The share is worked out from a count, so no rows are sorted.
    """
    n = df.count()
    keep = int(most * factor)
    if n <= keep:
        return df
    return df.where(F.pmod(hashed(seed, *identity), F.lit(1 << 30)) < F.lit(int((1 << 30) * keep / n)))


def rewritten_paths(df: DataFrame, column: str, by: dict[str, str]) -> DataFrame:
    """Paths that begin with a key of `by` begin with its value instead; the longest key wins."""
    out = F.col(column)
    for k in sorted(by, key=len):
        out = F.when(F.col(column).startswith(k), F.concat(F.lit(by[k]), F.substr(F.col(column), F.lit(len(k) + 1)))).otherwise(out)
    return df.withColumn(column, out)


def table_names(tables: DataFrame, table: str = "table_id", header: str = "header") -> DataFrame:
    """(table_id, names) of each table once."""
    return tables.groupBy(table).agg(F.min_by(header, F.size(header)).alias("names"))


def joined_texts(values: list[Column], operator: str = "+") -> Column:
    """What `+` means for text columns: values one after another. Other operators have no meaning there."""
    if operator != "+":
        raise ValueError(f"texts can't be combined by {operator}")
    return F.concat(*(v.cast("string") for v in values))


def grouped_samples(df: DataFrame, key: Column, name: str = "group") -> DataFrame:
    """(group, samples): rows by a function of them. Groups are gathered in a row, so they must fit one."""
    return df.groupBy(key.alias(name)).agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("samples"))


def encoded(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON text; fields that are null are written too."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


_FIELD = re.compile(r"\{\{\s*(\w+)\s*((?:\|\s*regex_replace\(\s*'[^']*'\s*,\s*'[^']*'\s*\)\s*)*)\}\}")
_STEP = re.compile(r"regex_replace\(\s*'([^']*)'\s*,\s*'([^']*)'\s*\)")


def templated(text: str) -> Column:
    """A text with `{{ column }}` fields, each with `| regex_replace('pattern', 'text')` steps, as a Column."""
    parts, at = [], 0
    for m in _FIELD.finditer(text):
        parts.append(F.lit(text[at : m.start()]))
        parts.append(reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), _STEP.findall(m[2]), F.col(m[1]).cast("string")))
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


# --- evaluations ---


def consolidated(metrics: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row a task: alias, version, n_shot, samples, and `results`, a map of '<metric>,<filter>' to values, standard errors as '<metric>_stderr,<filter>'.

    metrics(task, metric, filter, value, stderr, samples), tasks(task, alias, version, n_shot).
    """
    key = lambda middle: F.concat("metric", F.lit(middle), "filter")
    both = F.array(F.struct(key(",").alias("k"), F.col("value").cast("double").alias("v")), F.struct(key("_stderr,").alias("k"), F.col("stderr").cast("double").alias("v")))
    by = metrics.groupBy("task").agg(F.max("samples").alias("samples"), F.map_from_entries(F.array_sort(F.flatten(F.collect_list(both)))).alias("results"))
    return tasks.join(by, "task", "left").withColumn("alias", F.coalesce("alias", "task"))


def pass_through(df: DataFrame) -> DataFrame:
    """The decontamination filter of responses: it keeps every row, as it's defined to."""
    return df
