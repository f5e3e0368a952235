"""Answers to many questions over a corpus of tables, in one plan; provenance and quality filters.

rows(table_id, row_id, cells array<string>), questions(qid, table_id, op, shape, agg_idx, agg_idx2, cond_idx, cmp, val).
Columns count from 0; cond_idx null: no condition. A question's shape names the expression over its columns.
Questions may have further conditions, all of which a row has to meet: also array<struct<shape, idx, idx2, cmp, val>>
compares an expression over two columns with a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_number, to_number

SHAPES = {
    "single": lambda a, b: a,
    "difference": lambda a, b: a - b,
    "ratio": lambda a, b: F.try_divide(a, b),
    "complex": lambda a, b: a * ((a - b) * F.try_divide(2 * (a * b), (a * a) + (b * b))),
    "expression2": lambda a, b: F.try_divide((a + b) - 0.1, 0.5 + (b * a)),
    "product_over_squares": lambda a, b: F.try_divide(a * b, (a * a) + (b * b)),
    "add_one": lambda a, b: a + 1,
}


def _cell(i: str) -> Column:
    return F.try_element_at(F.col("cells"), F.col(i) + 1)


def _prefix_number(c: Column) -> Column:
    """Numeric value of a text's longest numeric beginning, 0 if none (arithmetic on text cells)."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def hits(semantics: str = "typed") -> Column:
    """Whether a row meets its question's condition. typed: numbers by value; text: cells as texts."""
    cell, val = _cell("cond_idx"), F.col("val")
    a, b = (to_number(cell), to_number(val)) if semantics == "typed" else (cell, val)
    both = a.isNotNull() & b.isNotNull() if semantics == "typed" else F.lit(True)
    eq = F.when(both, a == b).otherwise(cell == val) if semantics == "typed" else cell == val
    test = F.when(F.col("cmp") == "=", eq).when(F.col("cmp") == "!=", ~eq)
    for op, f in (("<", lambda: a < b), ("<=", lambda: a <= b), (">", lambda: a > b), (">=", lambda: a >= b)):
        test = test.when(F.col("cmp") == op, f())
    return F.when(F.col("cond_idx").isNull(), True).otherwise(F.coalesce(test, F.lit(False)))


#: Type of `also`, the further conditions of a question.
ALSO = "array<struct<shape:string,idx:int,idx2:int,cmp:string,val:string>>"


def meets_all(semantics: str = "typed") -> Column:
    """Whether a row meets all further conditions of its question: expressions by value, single columns as `hits` compares them."""
    number = to_number if semantics == "typed" else _prefix_number

    def meets(c: Column) -> Column:
        text, other = F.try_element_at(F.col("cells"), c["idx"] + 1), F.try_element_at(F.col("cells"), c["idx2"] + 1)
        left = reduce(lambda rest, s: F.when(c["shape"] == s, SHAPES[s](number(text), number(other))).otherwise(rest), SHAPES, F.lit(None).cast("double"))
        right, plain = number(c["val"]), c["shape"] == "single"
        as_text = plain & (F.lit(semantics != "typed") | left.isNull() | right.isNull())
        order = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        same = F.when(as_text, text == c["val"]).otherwise(left == right)
        test = F.when(c["cmp"] == "=", same).when(c["cmp"] == "!=", ~same)
        for op, f in order.items():
            test = test.when(c["cmp"] == op, F.when(plain & F.lit(semantics != "typed"), f(text, c["val"])).otherwise(f(left, right)))
        return F.coalesce(test, F.lit(False))

    return F.forall(F.coalesce("also", F.array().cast(ALSO)), meets)


def values(semantics: str = "typed") -> Column:
    number = to_number if semantics == "typed" else _prefix_number
    a, b = number(_cell("agg_idx")), number(_cell("agg_idx2"))
    return reduce(lambda rest, s: F.when(F.col("shape") == s, SHAPES[s](a, b)).otherwise(rest), SHAPES, F.lit(None).cast("double"))


def _key(c: Column, semantics: str) -> Column:
    """Texts that `=` takes for equal have equal keys: numbers by value, other texts as they are."""
    return c if semantics != "typed" else F.coalesce((to_number(c) + 0.0).cast("string"), F.concat(F.lit("t"), c))


def matched(rows: DataFrame, questions: DataFrame, semantics: str = "typed", spread: int = 16) -> DataFrame:
    """Rows of each question's table that meet its condition, with the question's columns.

    Conditions of equality are an equi-join on table, column and value, so each row meets only the questions
    that ask for its values. The others meet all rows of their table, which are dealt to `spread` parts.
    """
    q, asked = [c for c in questions.columns if c != "table_id"], (F.col("cmp") == "=") & F.col("cond_idx").isNotNull()
    equal = questions.where(asked).withColumn("_key", _key(F.col("val"), semantics))
    columns = equal.select("table_id", "cond_idx").distinct()
    by_value = rows.join(columns, "table_id").withColumn("_key", _key(_cell("cond_idx"), semantics)).join(equal, ["table_id", "cond_idx", "_key"])
    others = questions.where(~F.coalesce(asked, F.lit(False))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    by_table = rows.withColumn("_part", F.pmod(F.xxhash64("row_id"), F.lit(spread)).cast("int")).join(others, ["table_id", "_part"]).where(hits(semantics))
    out = by_value.select(*rows.columns, *q).unionByName(by_table.select(*rows.columns, *q))
    return out.where(meets_all(semantics)) if "also" in q else out


def answer(rows: DataFrame, questions: DataFrame, semantics: str = "typed") -> DataFrame:
    """qid, answer, number, alternatives, multi_row, n_rows: two joins and one aggregate for all questions.

    Only `noop` questions gather values: their rows, in row order, are the answer and its alternatives.
    """
    x = matched(rows, questions, semantics).withColumn("x", values(semantics))
    noop = F.col("op") == "noop"
    by = x.groupBy("qid").agg(
        F.first("op").alias("op"), F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum"), F.avg("x").alias("avg"),
        F.array_sort(F.collect_list(F.when(noop, F.struct("row_id", F.coalesce(_cell("agg_idx"), F.lit("")).alias("t"), "x")))).alias("found"),
    )
    number = F.when(F.col("op") == "count", F.col("count").cast("double"))
    for op in ("min", "max", "sum", "avg"):
        number = number.when(F.col("op") == op, F.col(op))
    number = number.when(F.col("op") == "noop", F.try_element_at("found", F.lit(1))["x"])
    out = questions.select("qid", "op").join(by.drop("op"), "qid", "left")
    out = out.withColumn("number", F.when((F.col("op") == "count") & F.col("count").isNull(), 0.0).otherwise(number))
    texts = F.transform(F.coalesce("found", F.array().cast("array<struct<row_id:long,t:string,x:double>>")), lambda f: F.coalesce(f["x"].cast("string"), f["t"]))
    return out.select(
        "qid", F.when(F.col("op") == "noop", F.try_element_at(texts, F.lit(1))).otherwise(F.col("number").cast("string")).alias("answer"), "number",
        F.when(F.col("op") == "noop", F.slice(texts, 2, 1_000_000_000)).otherwise(F.array().cast("array<string>")).alias("alternatives"),
        ((F.col("op") == "noop") & (F.size(texts) > 1)).alias("multi_row"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def coordinates(rows: DataFrame, questions: DataFrame, semantics: str = "typed") -> DataFrame:
    """qid, cells array<struct<row, col>>: the cells that an answer comes from."""
    x = matched(rows, questions, semantics)
    cols = F.filter(F.array(F.col("agg_idx"), F.when(~F.col("shape").isin("single", "add_one"), F.col("agg_idx2"))), lambda c: c.isNotNull())
    cells = x.select("qid", "row_id", F.explode(cols).alias("col"))
    return cells.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("row_id").cast("int").alias("row"), "col"))).alias("cells"))


def complement(rows: Column, n_rows: Column) -> Column:
    """Row ids that aren't in the array."""
    return F.array_except(F.when(n_rows > 0, F.sequence(F.lit(0), F.greatest(n_rows.cast("int") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>")), rows)


def compact_rows(rows: Column, n_rows: Column) -> Column:
    """The shorter of the row ids and their complement, and which one it is."""
    other = complement(rows, n_rows)
    return F.when(F.size(rows) * 2 > n_rows, F.struct(F.lit(True).alias("inverted"), other.alias("rows"))).otherwise(F.struct(F.lit(False).alias("inverted"), rows.alias("rows")))


def permuted(cells: Column, row_map: Column, col_map: Column) -> Column:
    """Coordinates after rows and columns moved: maps from old to new ids; ids not in a map stay."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), k)
    return F.transform(cells, lambda c: F.struct(at(row_map, c["row"]).alias("row"), at(col_map, c["col"]).alias("col")))


# --- quality ---

INVALID = ("", "''", "none", "nan", "n/a")


def answered(df: DataFrame, answer: str = "answer") -> DataFrame:
    return df.where(F.col(answer).isNotNull() & (F.col(answer) != "") & (F.col(answer) != "None"))


def valid_answers(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Without empty answers and words for nothing."""
    return df.where(~F.coalesce(F.lower(answer), F.lit("")).isin(*INVALID))


def comparable_conditions(df: DataFrame, sql: str = "sql_query") -> DataFrame:
    """Without ordering comparisons against an empty value."""
    return df.where(~F.col(sql).rlike(r"(?:<=?|>=?)\s*''(?:\s|\z)"))


def single_answers(df: DataFrame, multi: str = "multi_row") -> DataFrame:
    return df.where(~F.coalesce(F.col(multi), F.lit(False)))


def inferred_multi(op: Column, n_rows: Column) -> Column:
    """No aggregate and more than one row."""
    return op.isin("noop", "") & (n_rows > 1)


def few_rows(op: Column, n_rows: Column, threshold: int = 2) -> Column:
    """Aggregates over fewer rows than the threshold; lookups are exempt."""
    return ~op.isin("noop", "") & (n_rows < threshold)


def short_values(df: DataFrame, value: str, most: int = 256) -> DataFrame:
    return df.where(F.coalesce(F.length(value), F.lit(0)) <= most)


def value_occurs(conditions: DataFrame, cells: DataFrame) -> DataFrame:
    """Conditions (table, name, value) whose value is in its column."""
    return conditions.join(cells.select("table", "name", "value").distinct(), ["table", "name", "value"], "left_semi")


def main_expression_is(df: DataFrame, kinds: list[str], question: str = "nl_question") -> DataFrame:
    from ..functions.text import main_expression_class

    return df.where(main_expression_class(F.col(question)).isin(*kinds))


def patched(old: DataFrame, new: DataFrame, table: str = "table_id", order: str = "qid", question: str = "nl_question") -> DataFrame:
    """`old` with its expression questions replaced by `new` ones; all other questions stay.

    A table gets as many new questions as it had expression questions, if `new` has so many for it. What
    is short is filled from tables with more than they need, those with most to spare first, the last of a
    table's questions first. Columns are those that both have.
    """
    from pyspark.sql import Window

    from ..functions.text import main_expression_class

    columns = [c for c in old.columns if c in new.columns]
    marked = main_expression_class(F.col(question)) == "expression"
    others, had = old.where(~F.coalesce(marked, F.lit(False))), old.where(marked).groupBy(table).agg(F.count(F.lit(1)).alias("had"))
    w = Window.partitionBy(table).orderBy(order)
    ranked = new.withColumn("_i", F.row_number().over(w)).join(had, table).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(table)))
    kept = ranked.where(F.col("_i") <= F.col("had"))
    missing = (had.agg(F.sum("had")).first()[0] or 0) - kept.count()
    spare = ranked.where(F.col("_i") > F.col("had"))
    fill = spare.orderBy(F.desc(F.col("_n") - F.col("had")), table, F.desc("_i")).limit(int(missing))
    return others.select(*columns).unionByName(kept.select(*columns)).unionByName(fill.select(*columns))


def number_like(c: Column) -> Column:
    return is_number(c)


#: What model-written SQL may hold: words of the language, and functions.
_SQL_WORDS = frozenset("select distinct from where group by having order asc desc limit offset and or not in is null like between case when then else end as cast on join inner left right full outer cross union all except intersect exists true false over partition rows unbounded preceding following current row nulls first last int integer bigint float double decimal string date".split())
_SQL_FUNCTIONS = frozenset("min max avg sum count abs round floor ceil ceiling coalesce nullif ifnull length lower upper trim ltrim rtrim substr substring replace concat cast mod power sqrt greatest least row_number rank dense_rank stddev variance median".split())
_SQL_TOKEN = r"""\s+|'(?:[^'\\$]|'')*'|"[^"$]*"|`[^`$]*`|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+|[A-Za-z_]\w*|<=|>=|<>|!=|\|\||[-+*/%=<>(),.]"""


def safe_select(text: str, table: str) -> list[str] | None:
    """Tokens of a SELECT over `table` alone that calls listed functions only; None for any other text.

    Every relation is `table` or a subquery: no paths, no other tables, no table functions, no variables.
    """
    import re

    tokens = [m.group() for m in re.finditer(_SQL_TOKEN, text)]
    if "".join(tokens) != text or "--" in re.sub(r"'[^']*'", "", text):
        return None
    tokens = [t for t in tokens if t.strip()]
    low = [t.lower() for t in tokens]
    name = lambda t: t.strip('"`').lower()
    if not low or low[0] != "select":
        return None
    inside: list[bool] = [False]  # for each open parenthesis: are we in a FROM clause
    for i, t in enumerate(low):
        after = low[i + 1] if i + 1 < len(low) else ""
        if t == "(":
            before = low[i - 1]
            if re.match(r"\w", before) and before not in _SQL_FUNCTIONS and before not in _SQL_WORDS or before[:1] in "\"`":
                return None
            inside.append(False)
        elif t == ")":
            if len(inside) == 1:
                return None
            inside.pop()
        elif t in ("from", "join"):
            inside[-1] = True
            if after != "(" and (name(after) != table.lower() or (low[i + 2] if i + 2 < len(low) else "") == "."):
                return None
            if after == "(" and (low[i + 2] if i + 2 < len(low) else "") != "select":
                return None
        elif t in ("select", "where", "group", "having", "order", "limit", "union", "except", "intersect"):
            inside[-1] = False
        elif t == "," and inside[-1]:
            return None
    return tokens


def sql_answer(df: DataFrame, text: str, table: str | None = None) -> str:
    """First cell of a model-written query over one table, '' if it isn't a SELECT that `safe_select` allows, doesn't run or gives no row.

    The text is cut at its first `;` or code fence; `table` (or `df`) is the frame's name in it.
    """
    import re
    import uuid

    from pyspark.errors import PySparkException

    own, view = table or "df", f"answer_{uuid.uuid4().hex}"
    tokens = safe_select(re.split(r";|```", text)[0].strip(), own)
    if tokens is None:
        return ""
    out = []
    for i, t in enumerate(tokens):
        if i and tokens[i - 1].lower() in ("from", "join") and t != "(":
            alias = i + 1 < len(tokens) and (tokens[i + 1].lower() == "as" or re.match(r"[\w\"`]", tokens[i + 1]) and tokens[i + 1].lower() not in _SQL_WORDS)
            out.append(view if alias else f"{view} AS `{own}`")
        else:
            out.append("`" + t[1:-1].replace("`", "``") + "`" if t[0] == '"' else t)
    df.createOrReplaceTempView(view)
    try:
        row = df.sparkSession.sql(" ".join(out)).first()
        return "" if row is None or row[0] is None else str(row[0])
    except PySparkException:
        return ""
    finally:
        df.sparkSession.catalog.dropTempView(view)
