"""Deterministic sampling, limits, splits and set operations. Where order matters it comes from a seeded hash."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType, StructType


def hashed(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def top_per_group(df: DataFrame, keys: list[str], k: int | Column, *order) -> DataFrame:
    """First k rows of each group. Only a rank runs over the group, so Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def sample_per_group(df: DataFrame, keys: list[str], k: int | Column, *identity: str, seed: int = 0) -> DataFrame:
    """k rows of each group without replacement."""
    return top_per_group(df, keys, k, hashed(seed, *identity), *identity)


def place_by_hash(df: DataFrame, h: Column, ties: list[str], most: int, parts: int = 4096) -> DataFrame:
    """Adds `_place`: the first `most` rows' places (from 0) in the order of a 64-bit hash; null beyond them.

    The hash's range is cut into `parts` equal ones, whose counts (so many numbers) the driver adds up; rows are
    ranked within a part. So a task ranks about one part of the rows (rows of one hash stay together), and parts beyond `most` none.
    """
    part = F.shiftrightunsigned(F.shiftright(h, 1) + F.lit(1 << 62), 63 - (parts.bit_length() - 1)).cast("int")
    marked = df.withColumn("_h", h).withColumn("_part", part)
    counts = dict(marked.groupBy("_part").count().collect())
    starts, upto = [], 0
    for i in range(parts):
        starts.append(upto)
        upto += counts.get(i, 0)
    last = max((i for i in range(parts) if starts[i] < most), default=-1)
    start = F.element_at(F.lit(starts[: last + 1] or [0]).cast("array<bigint>"), F.col("_part") + 1)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_h", *ties))
    inner, rest = marked.where(F.col("_part") <= last), marked.where(F.col("_part") > last)
    place = inner.withColumn("_place", start + rank - 1).withColumn("_place", F.when(F.col("_place") < most, F.col("_place")))
    return place.unionByName(rest.withColumn("_place", F.lit(None).cast("long"))).drop("_h", "_part")


def equal_cutoff(questions: DataFrame, cutoff: int | None = None, table: str = "table_id", order: list | None = None) -> DataFrame:
    """The same number of questions from each table, at least one, up to `cutoff` in all; default: the smallest table's count."""
    per = questions.groupBy(table).agg(F.count(F.lit(1)).alias("n"))
    n_tables, least = per.agg(F.count(F.lit(1)), F.min("n")).first()
    each = max(1, cutoff // n_tables) if cutoff is not None and n_tables else least or 1
    return top_per_group(questions, [table], each, *(order or [hashed(0, *questions.columns)]))


def tolerance_per_group(df: DataFrame, below: Column, tolerance: float, table: str = "table_id", order: list | None = None) -> DataFrame:
    """All rows that aren't `below`, and of the others floor(n * tolerance) per table, n being the table's rows."""
    marked = df.withColumn("_below", F.coalesce(below, F.lit(False)))
    n = F.count(F.lit(1)).over(Window.partitionBy(table))
    rank = F.row_number().over(Window.partitionBy(table, "_below").orderBy(*(order or [hashed(0, *df.columns)])))
    return marked.withColumn("_n", n).withColumn("_rank", rank).where(~F.col("_below") | (F.col("_rank") <= F.floor(F.col("_n") * tolerance))).drop("_below", "_n", "_rank")


def tolerance_by_chance(df: DataFrame, below: Column, tolerance: float, *identity: str, seed: int = 0) -> DataFrame:
    """All rows that aren't `below`, and each of the others with a probability."""
    chance = F.pmod(hashed(seed, *identity), F.lit(1_000_000)) / 1_000_000
    return df.where(~F.coalesce(below, F.lit(False)) | (chance < tolerance))


def interpolated(low: Column, high: Column, n: int) -> Column:
    """n evenly spaced values from low to high."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * (i / F.lit(float(max(1, n - 1)))))


def percentiles(df: DataFrame, keys: list[str], value: str, n: int = 11) -> DataFrame:
    """n evenly spaced percentiles of a value by group."""
    at = [i / (n - 1) for i in range(n)]
    return df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("values"))


def sampled_values(values: DataFrame, n: int, strategy: str = "random", pool: str = "distinct", seed: int = 0) -> DataFrame:
    """(table, name, values): n sample values of each column of (table, name, row_id, value, number).

    random: by a hash, wrapped round if a column has fewer; interpolation: evenly between bounds; mix: half of each;
    percentiles: evenly by rank.
    """
    keys = ["table", "name"]
    if strategy == "interpolation":
        return values.groupBy(*keys).agg(F.min("number").alias("lo"), F.max("number").alias("hi")).select(*keys, F.transform(interpolated(F.col("lo"), F.col("hi"), n), lambda x: x.cast("string")).alias("values"))
    if strategy == "percentiles":
        return percentiles(values, keys, "number", n).select(*keys, F.transform("values", lambda x: x.cast("string")).alias("values"))
    if strategy == "mix":
        a, b = sampled_values(values, n // 2, "interpolation", pool, seed), sampled_values(values, n - n // 2, "random", pool, seed)
        return a.withColumnRenamed("values", "_a").join(b, keys).select(*keys, F.concat("_a", "values").alias("values"))
    rows = values.groupBy(*keys, "value").agg(F.min("row_id").alias("row_id")) if pool == "distinct" else values
    few = sample_per_group(rows, keys, n, "table", "name", "value", "row_id", seed=seed)
    have = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(hashed(seed, "table", "name", "value", "row_id").alias("h"), "value"))).alias("v"))
    wrapped = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at("v", (i % F.size("v")) + 1)["value"])
    return have.select(*keys, wrapped.alias("values"))


def scaled_budget(n: Column, most: int, estimate: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * most / estimate))


def split_by_rank(df: DataFrame, parts: dict[str, int], *order) -> DataFrame:
    """Adds `split`: consecutive ranges of the given sizes in an order; rows beyond them are left out.

    Only rows up to the sum of sizes are ranked: the order's first rows come from each task.
    """
    total = sum(parts.values())
    first = df.orderBy(*order).limit(total)
    ranked = first.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    edge, split = 0, F.lit(None).cast("string")
    for name, size in parts.items():
        split = F.when((F.col("_rank") > edge) & (F.col("_rank") <= edge + size), name).otherwise(split)
        edge += size
    return ranked.withColumn("split", split).drop("_rank")


def split_by_hash(df: DataFrame, weights: dict[str, float], *identity: str, seed: int = 0) -> DataFrame:
    """Adds `split` by hash ranges: no order, no shuffle, any size."""
    total, edge, split = sum(weights.values()), 0.0, F.lit(None).cast("string")
    u = F.pmod(hashed(seed, *identity), F.lit(1_000_000)) / 1_000_000
    for name, w in weights.items():
        split = F.when((u >= edge) & (u < edge + w / total), name).otherwise(split)
        edge += w / total
    return df.withColumn("split", F.coalesce(split, F.lit(name)))


def file_splits(files: DataFrame, weights: dict[str, float], topic: str = "topic", path: str = "path", most: int | None = None) -> DataFrame:
    """Adds `split` to files: per topic, contiguous runs by name in proportion to the weights.

    Sizes are floors; the remainder goes to splits in turn from a hash of the topic. Tiny topics serve
    the first split, then the last, then others.
    """
    w = Window.partitionBy(topic)
    ranked = files.withColumn("_i", F.row_number().over(w.orderBy(path)) - 1)
    if most is not None:
        ranked = ranked.where(F.col("_i") < most)
    ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(w))
    total, names = sum(weights.values()), list(weights)
    floors = [F.floor(F.col("_n") * weights[n] / total) for n in names]
    rest = F.col("_n") - reduce(lambda a, b: a + b, floors)
    start = F.pmod(F.xxhash64(topic), F.lit(len(names)))
    sizes = [f + (F.pmod(F.lit(i) - start, F.lit(len(names))) < rest).cast("int") for i, f in enumerate(floors)]
    split, edge = F.lit(names[-1]), F.lit(0)
    edges = []
    for s in sizes:
        edge = edge + s
        edges.append(edge)
    for n, e in reversed(list(zip(names, edges, strict=True))):
        split = F.when(F.col("_i") < e, n).otherwise(split)
    tiny = F.when(F.col("_i") == 0, names[0]).when(F.col("_i") == 1, names[-1]).otherwise(F.element_at(F.array(*map(F.lit, names)), (F.col("_i") % len(names) + 1).cast("int")))
    return ranked.withColumn("split", F.when(F.col("_n") < len(names), tiny).otherwise(split)).drop("_i", "_n")


def similar_names(files: DataFrame, topic: str = "topic", name: str = "name", keep: int = 1) -> DataFrame:
    """Keep `keep` files of each run of alphabetical neighbours that share a token at some place with the run's first.

    Tokens are what stands between characters that are neither letter nor digit; the last (the extension) counts for nothing.
    Each name is compared with its run's first one, so runs follow one after another: pandas, a topic at a time.
    """
    schema = files.schema

    def pick(pdf):
        rows = pdf.sort_values(name)
        first, n, take = None, 0, []
        for value in rows[name]:
            tokens = re.split(r"[^a-zA-Z0-9]", value)[:-1]
            if first is None or not any(a == b for a, b in zip(tokens, first, strict=False)):
                first, n = tokens, 0
            n += 1
            take.append(n <= keep)
        return rows[take]

    return files.groupBy(topic).applyInPandas(pick, schema)


def structure_code(name: Column) -> Column:
    """A name's tokens as kinds, with what separates them: d<length> digits, t, T or tT letters, alpha_num<length> others. The extension is left out."""
    token, size = F.split(name, "[^a-zA-Z0-9]"), lambda x: F.length(x).cast("string")
    kind = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("d"), size(x))).when(x.rlike("^[a-z]+$"), "t").when(x.rlike("^[A-Z]+$"), "T").when(x.rlike("^[a-zA-Z]+$"), "tT").otherwise(F.concat(F.lit("alpha_num"), size(x)))
    marks = F.regexp_extract_all(name, F.lit("[^a-zA-Z0-9]"), F.lit(0))
    n = F.size(token) - 1
    return F.array_join(F.transform(F.slice(token, 1, n), lambda x, i: F.concat(kind(x), F.when(i < n - 1, F.get(marks, i)).otherwise(""))), "")


def per_structure(files: DataFrame, name: str = "name", keep: int = 2) -> DataFrame:
    return top_per_group(files.withColumn("_code", structure_code(F.col(name))), ["_code"], keep, name).drop("_code")


def limit_share(n: int, limit: float | int | None) -> int | None:
    """A limit as a count, or as a share rounded up."""
    return None if limit is None else math.ceil(n * limit) if limit < 1 else int(limit)


def strided(df: DataFrame, ordinal: str, rank: int, world: int, limit: int | None = None) -> DataFrame:
    """Every world-th row from rank on, by an explicit ordinal from 0."""
    out = df.where(F.pmod(ordinal, F.lit(world)) == rank)
    return out.where(F.col(ordinal) < limit) if limit is not None else out


def chunked(ordinal: Column, size: int) -> Column:
    return F.floor(ordinal / size)


def tolerant_union(*frames: DataFrame) -> DataFrame:
    """Union by name; missing columns get the empty value of their type: '', -1, NaN, [], {}."""
    kinds = {f.name: f.dataType for df in frames for f in df.schema}

    def empty(kind):
        if isinstance(kind, StringType):
            return F.lit("")
        if isinstance(kind, NumericType):
            return F.lit(float("nan") if kind.typeName() in ("double", "float") else -1).cast(kind)
        if isinstance(kind, ArrayType):
            return F.array().cast(kind)
        if isinstance(kind, MapType):
            return F.create_map().cast(kind)
        return F.lit(None).cast(kind) if not isinstance(kind, StructType) else F.lit(None).cast(kind)

    filled = [df.withColumns({n: empty(k) for n, k in kinds.items() if n not in df.columns}) if set(kinds) - set(df.columns) else df for df in frames]
    return reduce(DataFrame.unionByName, filled)


def distinct_questions(questions: DataFrame, identity: tuple[str, ...] = ("nl_question", "sql_query", "table_id")) -> DataFrame:
    return questions.dropDuplicates(list(identity))


def distinct_pairs(a: Column, b: Column) -> Column:
    return F.array_distinct(F.arrays_zip(a, b))
