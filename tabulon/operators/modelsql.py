"""Model-written SQL over many tables, answered together.

Texts that differ only in columns, values and tables have one shape: columns become places in the row's
cells, compared values become places in the question's values. Spark parses a shape's parts as
expressions; nothing here parses SQL beyond cutting a SELECT in its clauses. Each row meets the questions
that ask for it in one join for all shapes (by value where a condition is an equality, by table otherwise),
and each shape takes one aggregate over the rows that meet its conditions.

What a text may be: SELECT [DISTINCT] expressions FROM one table [alias] [WHERE condition] [ORDER BY
expressions] [LIMIT n], with the functions of `AGGREGATES` and `FUNCTIONS`; it is cut at its first `;` or code
fence. Any other text, and one with an unknown column or a type error, has the answer ''. So has a query
without rows, or whose first cell is null. Without ORDER BY the first row by row id counts. Division by
zero, and text that is no number where one is needed, are null.
"""

from __future__ import annotations

import contextlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import to_number
from ..work import new_path, small, written
from .answering import _SQL_TOKEN

AGGREGATES = frozenset("min max avg sum count stddev variance median".split())
FUNCTIONS = frozenset("abs round floor ceil coalesce nullif length lower upper trim ltrim rtrim substr substring replace concat mod power sqrt greatest least cast".split())
_WORDS = frozenset("and or not in is null like between case when then else end as distinct double integer int bigint string true false".split())
_COMPARE = frozenset("= < > <= >= <> !=".split())
#: A table of headers or asked columns with at most so many rows is broadcast.
_SMALL = 10_000
_END, _TOKEN, _PLAIN = re.compile(r";|```"), re.compile(_SQL_TOKEN), re.compile(r"[\d.]+")


def _split(tokens: list[str], at: str) -> list[list[str]]:
    """Parts between tokens `at` outside parentheses."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t.lower() == at and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _tokens(text: str) -> list[str] | None:
    """Tokens up to the first `;` or code fence, without spaces; None if there is anything else."""
    text = _END.split(text, 1)[0].strip()
    tokens = _TOKEN.findall(text)
    return [t for t in tokens if not t.isspace()] if "".join(tokens) == text else None


def clauses(tokens: list[str] | None) -> dict[str, list[str]] | None:
    """Tokens of the select, from, where, order and limit clauses of a single SELECT; None for any other text."""
    if tokens is None:
        return None
    out, now, depth = {}, None, 0
    for t in tokens:
        low = t.lower()
        depth += (t == "(") - (t == ")")
        if depth < 0 or (low == "select" and out):
            return None
        if depth == 0 and low in ("select", "from", "where", "order", "limit"):
            if low in out:
                return None
            out[low], now = [], low
        elif now is None:
            return None
        else:
            out[now].append(t)
    order = [c for c in ("select", "from", "where", "order", "limit") if c in out]
    return out if depth == 0 and list(out) == order and {"select", "from"} <= set(out) and all(out.values()) else None


class _Shape:
    """A text's shape with the places of its columns and its compared values."""

    def __init__(self, names: list[str], numeric: list[bool], qualifiers: set[str]):
        self.names, self.numeric, self.qualifiers = [n.lower() for n in names], numeric, qualifiers
        self.columns: list[int] = []
        self.values: list[str] = []

    def column(self, name: str) -> str | None:
        if name.lower() not in self.names:
            return None
        i = self.names.index(name.lower())
        if i not in self.columns:
            self.columns.append(i)
        return f"{'_n' if self.numeric[i] else '_t'}[{self.columns.index(i)}]"

    def value(self, text: str, number: bool) -> str:
        self.values.append(text)
        return f"CAST(_v[{len(self.values) - 1}] AS DOUBLE)" if number else f"_v[{len(self.values) - 1}]"

    def sql(self, tokens: list[str], lift: bool) -> str | None:
        """The tokens with columns as places, and compared values too if `lift`."""
        out, i = [], 0
        while i < len(tokens):
            t, low, after = tokens[i], tokens[i].lower(), tokens[i + 1] if i + 1 < len(tokens) else ""
            before = tokens[i - 1].lower() if i else ""
            compared = lift and (before in _COMPARE or after in _COMPARE)
            if after == "." and t.strip('"`').lower() in self.qualifiers:
                i += 2
                continue
            if t[0] == "'":
                text = t[1:-1].replace("''", "'")
                got = self.value(text, False) if compared else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
            elif t[0].isdigit() or t[0] == "." and len(t) > 1:
                got = self.value(t, True) if compared and re.fullmatch(r"[\d.]+", t) else t
            elif t[0] in '"`':
                got = self.column(t[1:-1]) or (self.sql(["'" + t[1:-1].replace("'", "''") + "'"], False) if t[0] == '"' else None)
            elif re.match(r"\w", t):
                called = after == "("
                got = low if called and low in AGGREGATES | FUNCTIONS else None
                got = got or (low if low in _WORDS and (not called or low in ("in", "and", "or", "not", "when", "then", "else")) else None if called else self.column(t))
            else:
                got = None if t in (".", "%") else t
            if got is None:
                return None
            out.append(got)
            i += 1
        return " ".join(out)

    def equality(self, where: list[str]) -> tuple[int, str] | None:
        """(column, value) of a condition that has to hold and is an equality of a column and a value of its kind."""
        if {"or", "between", "case"} & {t.lower() for t in where}:
            return None
        for part in _split(where, "and"):
            if part and self.qualifiers & {part[0].strip('"`').lower()} and part[1:2] == ["."]:
                part = part[2:]
            if len(part) == 3 and part[1] == "=" and part[0].strip('"`').lower() in self.names:
                i, v = self.names.index(part[0].strip('"`').lower()), part[2]
                if v[0] == "'" or (v[0] == '"' and v[1:-1].lower() not in self.names):
                    return i, v[1:-1].replace("''", "'")
                if self.numeric[i] and re.fullmatch(r"[\d.]+", v):
                    return i, v
        return None


def shape_of(text: str | None, names: list[str] | None, numeric: list[bool] | None) -> tuple[str, list[int], list[str], int | None, str | None] | None:
    """(shape, columns, values, equality's column, its value) of a text over a table; None if it can't be answered."""
    return _parsed(_tokens(text or ""), names, numeric)


def _parsed(tokens: list[str] | None, names: list[str] | None, numeric: list[bool] | None) -> tuple[str, list[int], list[str], int | None, str | None] | None:
    c = clauses(tokens)
    if c is None or not names:
        return None
    source = [t for t in c["from"] if t.lower() != "as"]
    if len(source) not in (1, 2) or len(c["from"]) > len(source) + 1 or not all(re.fullmatch(r'\w+|"[^"]+"|`[^`]+`', t) for t in source) or ("limit" in c and not (len(c["limit"]) == 1 and c["limit"][0].isdigit() and int(c["limit"][0]))):
        return None
    s = _Shape(names, list(numeric or []) or [False] * len(names), {t.strip('"`').lower() for t in source})
    items = c["select"][1:] if c["select"][0].lower() == "distinct" else c["select"]
    if items == ["*"]:
        items = ["`" + names[0] + "`"]
    select = []
    for item in _split(items, ","):
        lows = [t.lower() for t in item]
        if len(item) > 2 and lows[-2] == "as" and "cast" not in lows[-6:]:
            item = item[:-2]
        select.append(s.sql(item, False) if item else None)
    where = s.sql(c["where"], True) if "where" in c else ""
    order = []
    if "order" in c:
        if c["order"][0].lower() != "by":
            return None
        for item in _split(c["order"][1:], ","):
            down = bool(item) and item[-1].lower() == "desc"
            got = s.sql(item[:-1] if item and item[-1].lower() in ("asc", "desc") else item, False)
            order.append(None if not got else [got, down])
    if None in select or "" in select or where is None or None in order:
        return None
    calls = lambda tokens: any(t.lower() in AGGREGATES and a == "(" for t, a in zip(tokens, tokens[1:], strict=False))
    if calls(c.get("where", [])):
        return None
    aggregate = calls(items)
    equal = s.equality(c["where"]) if "where" in c else None
    return json.dumps([aggregate, select, where, [] if aggregate else order]), s.columns, s.values, *(equal or (None, None))


@lru_cache(4096)
def _header(head: str) -> tuple[list[str] | None, list[bool] | None]:
    found = json.loads(head)
    return found.get("names"), found.get("numeric")


def _value(token: str) -> str:
    return token[1:-1].replace("''", "'") if token[0] == "'" else token


@lru_cache(4096)
def _template(tokens: tuple[str, ...], at: tuple[int, ...], head: str) -> tuple | None:
    """(parse, which value each of its values is, which value its equality's is) of texts that differ only in the compared values `at`.

    They are read with marks in their places. Unless each mark comes out once among the values and nowhere else, this is
    None, and such texts are read one by one.
    """
    marked, marks = list(tokens), []
    for n, i in enumerate(at):
        marked[i] = f"'\x01{n}\x01'" if tokens[i] == "'" else f"{n}.70320901"
        marks.append(_value(marked[i]))
    got = _parsed(marked, *_header(head))
    if got is None:
        return (None, [], None)
    shape, columns, values, _, value = got
    if any(values.count(m) != 1 or m in shape or json.dumps(m)[1:-1] in shape for m in marks):
        return None
    return got, [marks.index(v) if v in marks else None for v in values], marks.index(value) if value in marks else None


def read(text: str | None, head: str | None) -> tuple:
    """`shape_of`, or all null, of a text over a table with a header (JSON of names and numeric); texts alike but for compared values are parsed once."""
    tokens = _tokens(text or "")
    if not tokens or head is None:
        return _NO_SHAPE
    whole, at, before = tokens.copy(), [], ""
    for i, t in enumerate(tokens):
        if before in _COMPARE and (t[0] == "'" or _PLAIN.fullmatch(t) and t != ".") and whole[i + 1 : i + 2] != ["."]:
            tokens[i] = "'" if t[0] == "'" else "0"
            at.append(i)
        before = t
    found = _template(tuple(tokens), tuple(at), head)
    if found is None:
        return _parsed(whole, *_header(head)) or _NO_SHAPE
    got, places, equal = found
    if got is None:
        return _NO_SHAPE
    mine = [_value(whole[i]) for i in at]
    return got[0], got[1], [v if n is None else mine[n] for v, n in zip(got[2], places, strict=True)], got[3], got[4] if equal is None else mine[equal]


_NO_SHAPE = (None, [], [], None, None)
_READ = "qid {qid}, table_id {table_id}, shape string, cols array<int>, vals array<string>, eq_col int, eq_val string"


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = list(map(read, b.column("text").to_pylist(), b.column("head").to_pylist()))
        kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("table_id"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=["qid", "table_id", "shape", "cols", "vals", "eq_col", "eq_val"])


@contextlib.contextmanager
def _lenient(spark: SparkSession):
    """Plans made inside keep null for what would be an error."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _answer(found: DataFrame, shape: list) -> DataFrame:
    """(qid, answer) from the rows that meet the condition."""
    aggregate, select, _, order = shape
    if aggregate:
        return found.groupBy("qid").agg(F.expr(select[0]).cast("string").alias("answer"), *(F.expr(x).alias(f"x{i}") for i, x in enumerate(select[1:]))).select("qid", "answer")
    first = F.expr(select[0]).cast("string").alias("a")
    rows = found.select("qid", "row_id", first, *(F.expr(e).alias(f"o{i}") for i, (e, _) in enumerate(order)), *(F.expr(x).alias(f"x{i}") for i, x in enumerate(select[1:])))
    if not order:
        return rows.groupBy("qid").agg(F.min_by("a", "row_id").alias("answer"))
    from pyspark.sql import Window

    keys = [F.col(f"o{i}").desc() if down else F.col(f"o{i}").asc_nulls_last() for i, (_, down) in enumerate(order)]
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*keys, "row_id"))).where("r = 1").select("qid", F.col("a").alias("answer"))


def _keyed(c: Column, number: Column, numeric: Column) -> Column:
    return F.when(numeric, F.concat(F.lit("n"), (number + 0.0).cast("string"))).otherwise(F.concat(F.lit("t"), c))


def sql_answers(rows: DataFrame, headers: DataFrame, texts: DataFrame, spread: int = 16, together: int = 50) -> DataFrame:
    """(qid, answer) of texts (qid, table_id, text) over rows (table_id, row_id, cells) with headers (table_id, names, numeric).

    Texts that differ only in compared values are parsed once a task. Rows without an equality to join by are dealt to
    `spread` parts of their table. The driver holds the different shapes; `together` of them go in one plan.
    """
    spark = rows.sparkSession
    kinds = {c: texts.schema[c].dataType.simpleString() for c in ("qid", "table_id")}
    heads = headers.select("table_id", F.to_json(F.struct("names", "numeric")).alias("head"))
    asked = texts.select("qid", "table_id", "text").join(small(heads, _SMALL), "table_id", "left").select("qid", "table_id", "text", "head")
    asked = written(asked.mapInArrow(_shapes, _READ.format(**kinds)), "sql-asked")
    shapes = [r["shape"] for r in asked.where("shape IS NOT NULL").groupBy("shape").count().orderBy(F.desc("count"), "shape").collect()]
    with _lenient(spark):
        probe = spark.createDataFrame([], f"qid {kinds['qid']}, row_id {rows.schema['row_id'].dataType.simpleString()}, _t array<string>, _n array<double>, _v array<string>")
        good, empty = {}, {}
        for s in shapes:
            shape = json.loads(s)
            with contextlib.suppress(PySparkException):  # a type error: its texts have no answer
                if shape[2]:
                    probe.where(F.expr(shape[2]))
                _answer(probe, shape)
                if shape[0]:
                    empty[s] = probe.agg(F.expr(shape[1][0]).cast("string").alias("a")).first()["a"]
                good[s] = (len(good), shape)
        if not good:
            return asked.select("qid", F.lit("").alias("answer"))
        number = spark.createDataFrame([(s, i, empty.get(s)) for s, (i, _) in good.items()], "shape string, _s int, none string")
        q = asked.join(F.broadcast(number), "shape")
        numeric = small(headers.select("table_id", "numeric"), _SMALL)
        # a row's numbers are read once, not by each question that it meets; shapes ask for them in numeric columns only
        numbers = F.transform("cells", lambda c, i: F.when(F.get("numeric", i), to_number(c)))
        flagged = rows.join(numeric, "table_id").select("table_id", "row_id", "cells", "numeric", numbers.alias("numbers"))
        kept = ["qid", "row_id", "cells", "numbers", "cols", "vals", "_s"]
        # questions compress well, so their files say little of their size: neither they nor the rows are ever broadcast
        by_value = q.where("eq_col IS NOT NULL").join(numeric, "table_id").withColumn("_k", _keyed(F.col("eq_val"), to_number(F.col("eq_val")), F.get("numeric", F.col("eq_col")))).drop("numeric")
        columns = small(q.where("eq_col IS NOT NULL").select("table_id", "eq_col").distinct(), _SMALL)
        keyed = flagged.join(columns, "table_id").withColumn("_k", _keyed(F.get("cells", F.col("eq_col")), F.get("numbers", F.col("eq_col")), F.get("numeric", F.col("eq_col")))).drop("numeric")
        met = keyed.join(by_value.hint("merge"), ["table_id", "eq_col", "_k"]).select(*kept)
        dealt = q.where("eq_col IS NULL")
        if not dealt.isEmpty():  # only then rows go to the parts of their tables
            dealt = dealt.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
            met = met.unionByName(flagged.withColumn("_p", F.pmod(F.xxhash64("row_id"), F.lit(spread)).cast("int")).join(dealt.hint("merge"), ["table_id", "_p"]).select(*kept))
        place = lambda cells: F.transform("cols", lambda i: F.get(cells, i))
        met = met.select("qid", "row_id", "_s", place("cells").alias("_t"), place("numbers").alias("_n"), F.col("vals").alias("_v"))
        conditions = " ".join(f"WHEN {i} THEN {shape[2]}" for i, shape in good.values() if shape[2])
        if conditions:
            met = met.where(F.expr(f"CASE _s {conditions} ELSE true END"))
        met = met.drop("_v")  # values are in conditions only
        path = new_path(spark, "sql-met")
        met.write.option("compression", "zstd").partitionBy("_s").parquet(path)
        found = spark.read.schema(met.schema).parquet(path)
        parts, every = [_answer(found.where(F.col("_s") == i), shape) for i, shape in good.values()], []
        for k in range(0, len(parts), together):
            part = reduce(DataFrame.unionByName, parts[k : k + together])
            every.append(part if len(parts) <= together else written(part, "sql-answers"))
        answers = reduce(DataFrame.unionByName, every)
        return asked.join(F.broadcast(number), "shape", "left").join(answers.withColumn("hit", F.lit(True)).hint("merge"), "qid", "left").select("qid", F.coalesce(F.when(F.col("hit"), F.col("answer")).otherwise(F.col("none")), F.lit("")).alias("answer"))
