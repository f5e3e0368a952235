"""Template variables bound to columns and values: sets of bindings, rendering, whole datasets.

catalog(table_id, col_id, name, type): one row a column. `bindings` lists all permutations of a table's columns;
`drawn` and `assignments` take a sample of them without listing any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import sampled_values
from ..work import written
from .ast import Template, variables
from .templates import phrasings, template_hash


def bindings(catalog: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """table_id and, for each variable, its column id and name: all permutations of allowed columns."""
    out = None
    for v, types in wanted.items():
        one = catalog.where(F.col("type").isin(*types)).select("table_id", F.col("col_id").alias(f"{v}_id"), F.col("name").alias(v))
        if out is None:
            out = one
        else:
            apart = reduce(lambda a, b: a & b, (F.col(f"{v}_id") != F.col(f"{w}_id") for w in wanted if f"{w}_id" in out.columns))
            out = out.join(one, "table_id").where(apart)
    return out


def columns_of(t: Template) -> dict[str, tuple[str, ...]]:
    return {v: x.types for v, x in t.types.items() if x.kind == "column"}


#: Spaces of more assignments than this are drawn from with independent digits.
_LARGEST = 1 << 62


def _shift(way: str, c: Column, bits: Column) -> Column:
    return F.call_function(f"shift{way}", c, bits)


def _permuted(j: Column, bits: Column, *salt: Column) -> Column:
    """A permutation of the numbers below 4 ** bits: four rounds that swap halves and mix one with a hash of the other."""
    mask = _shift("left", F.lit(1).cast("long"), bits) - 1
    start = F.struct(_shift("right", j, bits).alias("l"), j.bitwiseAND(mask).alias("r"))
    step = lambda s, i: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(F.xxhash64(*salt, i, s["r"]).bitwiseAND(mask)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step, lambda s: _shift("left", s["l"], bits).bitwiseOR(s["r"]))


def drawn(catalog: DataFrame, wanted: dict[str, tuple[str, ...]], most: int, pools: DataFrame | None = None, values: tuple[str, ...] = (), on: str | None = None, seed: int = 0, first: int = 4) -> DataFrame:
    """At most `most` different assignments of each table, drawn without listing them all.

    An assignment is a number: its digits are a column of each variable's allowed ones and a value of the pool of the
    column that `on` has. pools(table_id, name, values). A table's numbers come in the order of a pseudo-random
    permutation, so all are equally likely and none comes twice; those that give one column to two variables, or a value
    beyond its pool, are passed over. Tables that then have too few get four times as many draws, until all
    of their numbers have been tried: a small table gets all its assignments. A table's columns and its draws are arrays in its row.
    """
    of = reduce(lambda x, y: x.join(y, "table_id"), (catalog.where(F.col("type").isin(*types)).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "name"))).alias(f"_{v}")) for v, types in wanted.items()))
    radix = [F.size(f"_{v}").cast("long") for v in wanted] + [F.lit(most).cast("long")] * len(values)
    total = reduce(lambda x, n: x * n.cast("double"), radix, F.lit(1.0))
    bits = F.ceil(F.log2(F.least(total, F.lit(float(_LARGEST)))) / 2).cast("int")
    spaces = written(of.withColumns({"_total": total, "_bits": F.greatest(bits, F.lit(1))}), "assign-spaces")
    names, narrow = list(wanted), F.col("_total") < float(_LARGEST)

    def digit(k: int, index: Column) -> Column:
        """Of the number's digits in the mixed base `radix` the k-th; of a space that is too large a hash."""
        stride = reduce(lambda x, n: x * n, radix[:k], F.lit(1).cast("long"))
        v = [*wanted, *values][k]
        return F.when(narrow, F.call_function("div", index, stride) % radix[k]).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.lit(v), "table_id", index), radix[k])).cast("int")

    def one(x: Column) -> Column:
        """The columns that a number stands for, and its digits for values."""
        at = [F.get(f"_{v}", digit(k, x["i"])) for k, v in enumerate(names)]
        return F.struct(x["j"].alias("_j"), *(c for v, y in zip(names, at, strict=True) for c in (y["col_id"].alias(f"{v}_id"), y["name"].alias(v))), *(digit(len(names) + k, x["i"]).alias(f"_d{v}") for k, v in enumerate(values)))

    def apart(x: Column) -> Column:
        return reduce(lambda p, q: p & q, (x[f"{v}_id"] != x[f"{w}_id"] for i, v in enumerate(names) for w in names[:i]), F.lit(True))

    found, start, size = [], 0, first * most
    short = spaces.select("table_id", F.lit(most).alias("_need"))
    keep = ["table_id", *(x for v in names for x in (f"{v}_id", v)), *values]
    while True:
        span = F.least(F.lit(start + size).cast("long"), F.when(narrow, _shift("left", F.lit(1).cast("long"), 2 * F.col("_bits"))).otherwise(F.lit(_LARGEST)))
        index = lambda j: F.when(narrow, _permuted(j, F.col("_bits"), F.lit(seed), F.col("table_id"))).otherwise(j)
        numbers = F.filter(F.transform(F.sequence(F.lit(start).cast("long"), span - 1), lambda j: F.struct(j.alias("j"), index(j).alias("i"))), lambda x: ~narrow | (x["i"] < F.col("_total")))
        row = spaces.join(short, "table_id").where(span > start).select("table_id", "_need", F.explode(F.filter(F.transform(numbers, one), apart)).alias("_a")).select("table_id", "_need", "_a.*")
        if values:
            row = row.join(pools.select("table_id", F.col("name").alias(on), F.slice("values", 1, most).alias("_pool")), ["table_id", on])
            row = row.select("*", *(F.get("_pool", F.col(f"_d{v}")).alias(v) for v in values)).where(reduce(lambda x, y: x & y, (F.col(f"_d{v}") < F.size("_pool") for v in values)))
            if {"low_val", "high_val"} <= set(values):  # bounds in order; their exchange is another number
                low, high = F.col("low_val").try_cast("double"), F.col("high_val").try_cast("double")
                row = row.where(~F.coalesce(low > high, F.lit(False)))
        ranked = row.withColumn("_r", F.row_number().over(Window.partitionBy("table_id").orderBy("_j"))).where(F.col("_r") <= F.col("_need"))
        got = written(ranked.select(*keep, "_need"), "assign-drawn")
        found.append(got.select(*keep))
        have = got.groupBy("table_id").agg(F.count(F.lit(1)).alias("_have"))
        left = short.join(have, "table_id", "left").select("table_id", (F.col("_need") - F.coalesce("_have", F.lit(0))).cast("int").alias("_need")).where("_need > 0")
        more = spaces.where(span == start + size).select("table_id")  # tables with numbers that weren't tried
        short = written(left.join(more, "table_id", "left_semi"), "assign-short")
        start, size = start + size, 3 * (start + size)
        if short.isEmpty():
            return reduce(DataFrame.unionByName, found)


def assignments(catalog: DataFrame, values: DataFrame, t: Template, most: int = 10, most_length: int = 256, strategy: str = "random", seed: int = 0) -> DataFrame:
    """Bindings of a template with sampled condition values: at most `most` of each table, all distinct.

    values(table, name, row_id, value, number) holds the cells that values are drawn from. Nothing is enumerated (see `drawn`).
    """
    names = list(columns_of(t))
    vals = tuple(v for v, x in t.types.items() if x.kind == "value")
    if not vals:
        return drawn(catalog, columns_of(t), most, seed=seed)
    short = F.filter(F.array_distinct("values"), lambda x: F.length(x) <= most_length)
    pools = sampled_values(values, most, strategy, seed=seed).select(F.col("table").alias("table_id"), "name", short.alias("values"))
    on = "condition_col" if "condition_col" in names else names[-1]
    return drawn(catalog, columns_of(t), most, pools, vals, on, seed)


def rendered(text: str, row: dict[str, Column]) -> Column:
    """A text with `{variables}` as a Column: literal parts and values in turn."""
    parts, rest = [], text
    for v in [x for x in _tokens(text)]:
        before, _, rest = rest.partition("{" + v + "}")
        parts += [F.lit(before), row[v]]
    return F.concat(*parts, F.lit(rest))


def _tokens(text: str) -> list[str]:
    import re

    return re.findall(r"\{(\w+)\}", text)


def questions(bound: DataFrame, t: Template, alternatives: bool = True, carry: dict[str, Column] | None = None) -> DataFrame:
    """Question records of a template's assignments: one row for each binding and operator; `carry`: further columns.

    The count operator comes once for each set of conditions (its column doesn't matter).
    """
    names = {v: F.col(v) for v in variables(t.sql_text() + t.pattern) if v != "op"}
    escaped = {v: F.replace(c, F.lit("'"), F.lit("''")) if t.types[v].kind == "value" else F.replace(c, F.lit('"'), F.lit('""')) for v, c in names.items()}
    first = next(iter(columns_of(t)))
    conditions = [v for v in names if v not in variables(t.expr.sql())]
    shown = F.concat_ws(",", *(names[v] for v in conditions)) if conditions else F.lit("")
    parts = []
    for op, query in t.queries().items():
        say = lambda word: rendered(t.pattern, names | {"op": F.lit(word)})
        other = F.array(*(say(w) for w in phrasings(op)[1:])) if alternatives and phrasings(op)[1:] else F.array().cast("array<string>")
        df = bound
        if op == "count":
            df = bound.dropDuplicates(["table_id", *conditions]) if conditions else bound.dropDuplicates(["table_id"])
        parts.append(
            df.select(
                "table_id", F.lit(op).alias("operator"), say(phrasings(op)[0]).alias("nl_question"), other.alias("alternative_phrasings"), rendered(query.sql(), escaped).alias("sql_query"),
                (F.lit("expression") if len(variables(t.expr.sql())) > 1 else names[first]).alias("aggregation_column"), F.lit(template_hash(t)).alias("template_hash"), F.sha2(shown, 256).alias("count_hash"),
                *(c.alias(k) for k, c in (carry or {}).items()),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def dataset(catalog: DataFrame, values: DataFrame, templates: list[Template], most: int = 10, seed: int = 0) -> DataFrame:
    """Questions of all templates over a corpus, each (question, SQL, table) once."""
    every = [questions(assignments(catalog, values, t, most, seed=seed), t) for t in templates]
    return reduce(DataFrame.unionByName, every).dropDuplicates(["nl_question", "sql_query", "table_id"])


def hierarchical(flat: DataFrame, table: str = "table_id", order: str = "nl_question") -> DataFrame:
    """One row a table with parallel arrays."""
    fields = [c for c in flat.columns if c not in (table, order)]
    packed = flat.groupBy(table).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("q"))
    return packed.select(table, *(F.col(f"q.{f}").alias(f) for f in (order, *fields)))  # a field of an array of structs is an array


def flattened(batches: DataFrame, table: str = "table_id") -> DataFrame:
    """Back to one row a question."""
    fields = [c for c in batches.columns if c != table]
    return batches.select(table, F.explode(F.arrays_zip(*fields)).alias("q")).select(table, *(F.col(f"q.{f}") for f in fields))


def question_index(batches: DataFrame, field: str = "nl_question", table: str = "table_id") -> DataFrame:
    """Question number inside its table for each question of hierarchical rows."""
    return batches.select(table, F.posexplode(field).alias("question_number", field))
