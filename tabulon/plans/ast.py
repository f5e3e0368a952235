"""Single-table aggregate queries as a small immutable tree: compiled to Columns, or rendered as SQL text.

`Query.plan(df)` filters and aggregates; `fused(df, queries)` answers many queries over one table in a
single scan, each with the number of rows it aggregated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARITHMETIC = ("+", "-", "*", "/")
COMPARATORS = ("=", "!=", "<", "<=", ">", ">=")
AGGREGATES = ("min", "max", "avg", "sum", "count")
#: Operator, the column types it takes, its word in questions, and other words for it. Fixed values.
OPERATORS: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = {
    "min": (("numeric",), "minimum", ("smallest value", "lowest value", "least value")),
    "max": (("numeric",), "maximum", ("largest value", "highest value", "biggest value", "top value")),
    "avg": (("numeric",), "average", ("mean",)),
    "sum": (("numeric",), "sum", ("total",)),
    "count": (("numeric", "text", "alphanumeric"), "count", ("number of rows",)),
    "noop": (("numeric",), "value", ()),
}

_VARIABLE = re.compile(r"\{(\w+)\}")


def operator(name: str) -> str:
    """Canonical operator name; '' is the identity."""
    name = name.lower() or "noop"
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name!r}")
    return name


def variables(text: str) -> list[str]:
    """Names in braces, each once, in order."""
    return list(dict.fromkeys(_VARIABLE.findall(text)))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Expr:
    def column(self) -> Column:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def children(self) -> tuple[Expr, ...]:
        return ()

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()

    def columns(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in self.walk() if isinstance(x, Col)))

    def bind(self, values: dict[str, str]) -> Expr:
        """The expression with `{name}` columns replaced."""
        return self

    def __add__(self, o):
        return BinOp("+", self, expr(o))

    def __sub__(self, o):
        return BinOp("-", self, expr(o))

    def __mul__(self, o):
        return BinOp("*", self, expr(o))

    def __truediv__(self, o):
        return BinOp("/", self, expr(o))


@dataclass(frozen=True)
class Col(Expr):
    name: str

    def __post_init__(self):
        if self.name.count("{") > 1 or self.name.count("}") > 1:
            raise ValueError("one variable to an argument; nest expressions instead")

    def column(self) -> Column:
        return F.col("`" + self.name.replace("`", "``") + "`")

    def sql(self) -> str:
        return quoted(self.name)

    def bind(self, values):
        found = _VARIABLE.fullmatch(self.name)
        return Col(values[found[1]]) if found and found[1] in values else self


@dataclass(frozen=True)
class Lit(Expr):
    value: int | float | str

    def column(self) -> Column:
        return F.lit(self.value)

    def sql(self) -> str:
        return "'" + self.value.replace("'", "''") + "'" if isinstance(self.value, str) else repr(self.value)

    def bind(self, values):
        found = _VARIABLE.fullmatch(self.value) if isinstance(self.value, str) else None
        return Lit(values[found[1]]) if found and found[1] in values else self


@dataclass(frozen=True)
class BinOp(Expr):
    op: str
    left: Expr
    right: Expr

    def __post_init__(self):
        if self.op not in ARITHMETIC:
            raise ValueError(f"operand must be one of {ARITHMETIC}, not {self.op!r}")

    def column(self) -> Column:
        a, b = self.left.column(), self.right.column()
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a.cast("double"), b.cast("double"))}[self.op]()

    def sql(self) -> str:
        side = lambda e: f"({e.sql()})" if isinstance(e, BinOp) else e.sql()
        return f"{side(self.left)} {self.op} {side(self.right)}"

    def children(self):
        return self.left, self.right

    def bind(self, values):
        return BinOp(self.op, self.left.bind(values), self.right.bind(values))


def expr(x) -> Expr:
    """Names stay columns, numbers become literals."""
    return x if isinstance(x, Expr) else Col(x) if isinstance(x, str) else Lit(x)


@dataclass(frozen=True)
class Cmp:
    left: Expr
    op: str
    right: Expr

    def __post_init__(self):
        if self.op not in COMPARATORS:
            raise ValueError(f"comparator must be one of {COMPARATORS}, not {self.op!r}")

    def column(self) -> Column:
        a, b = self.left.column(), self.right.column()
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[self.op]

    def sql(self) -> str:
        value = self.right.sql() if self.right.sql() else "''"
        return f"{self.left.sql()} {self.op} {value}"

    def bind(self, values):
        return Cmp(self.left.bind(values), self.op, self.right.bind(values))


def between(left: Expr, low, high) -> tuple[Cmp, Cmp]:
    """Two conditions on one column; bounds are put in order."""
    low, high = sorted((low, high))
    return Cmp(left, ">=", Lit(low)), Cmp(left, "<=", Lit(high))


@dataclass(frozen=True)
class Over:
    """PARTITION BY, ORDER BY and a ROWS frame; None bounds are unbounded."""

    partition: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    preceding: int | None = None
    following: int | None = 0

    def window(self):
        w = Window.partitionBy(*self.partition)
        if self.order:
            w = w.orderBy(*self.order)
        return w.rowsBetween(Window.unboundedPreceding if self.preceding is None else -self.preceding, Window.unboundedFollowing if self.following is None else self.following)

    def sql(self) -> str:
        side = lambda n, word: f"UNBOUNDED {word}" if n is None else "CURRENT ROW" if n == 0 else f"{n} {word}"
        parts = ["PARTITION BY " + ", ".join(map(quoted, self.partition))] if self.partition else []
        parts += ["ORDER BY " + ", ".join(map(quoted, self.order))] if self.order else []
        return f"OVER ({' '.join([*parts, f'ROWS BETWEEN {side(self.preceding, 'PRECEDING')} AND {side(self.following, 'FOLLOWING')}'])})"


_FUNCTIONS: dict[str, Callable[[Column], Column]] = {"min": F.min, "max": F.max, "avg": F.avg, "sum": F.sum, "count": F.count, "noop": lambda c: c}


@dataclass(frozen=True)
class Query:
    expr: Expr
    op: str = "noop"
    where: tuple[Cmp, ...] = ()
    over: Over | None = None

    def __post_init__(self):
        object.__setattr__(self, "op", operator(self.op))
        if self.over is not None and self.op == "noop":
            raise ValueError("a window needs an aggregate")

    def condition(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.where), F.lit(True))

    def value(self) -> Column:
        v = _FUNCTIONS[self.op](self.expr.column())
        return v.over(self.over.window()) if self.over else v

    def plan(self, df: DataFrame, alias: str = "answer") -> DataFrame:
        rows = df.where(self.condition()) if self.where else df
        if self.over:
            return rows.withColumn(alias, self.value())
        return rows.select(self.value().alias(alias)) if self.op == "noop" else rows.agg(self.value().alias(alias))

    def sql(self, table: str = "df") -> str:
        inner = self.expr.sql()
        head = inner if self.op == "noop" else f"{self.op}({inner})" + (f" {self.over.sql()}" if self.over else "")
        return f"SELECT {head} FROM {table}" + (" WHERE true" + "".join(f" AND {c.sql()}" for c in self.where) if self.where else "")

    def bind(self, values: dict[str, str]) -> Query:
        return Query(self.expr.bind(values), self.op, tuple(c.bind(values) for c in self.where), self.over)


def fused(df: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(qid, answer, n_rows): aggregates of one table in one pass, with the rows each one took in."""
    aggs = []
    for i, q in enumerate(queries.values()):
        if q.op == "noop" or q.over:
            raise ValueError("only aggregates fuse")
        hit = q.condition()
        aggs += [_FUNCTIONS[q.op](F.when(hit, q.expr.column())).cast("double").alias(f"a{i}"), F.count(F.when(hit, F.lit(1))).alias(f"n{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(k).alias("qid"), F.col(f"a{i}").alias("answer"), F.col(f"n{i}").alias("n_rows")) for i, k in enumerate(queries)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


# --- records: nested dicts that survive JSON and Parquet ---


def to_state(e: Expr) -> dict:
    """Nested record of an expression."""
    if isinstance(e, BinOp):
        out = {"operand": e.op}
        for i, a in enumerate((e.left, e.right)):
            out |= {f"argument{i}": None if isinstance(a, BinOp) else _leaf(a), f"argument{i}_recursion": to_state(a) if isinstance(a, BinOp) else None}
        return out
    return {"argument0": _leaf(e), "argument0_recursion": None, "argument1": None, "argument1_recursion": None, "operand": None}


def _leaf(e: Expr):
    return e.name if isinstance(e, Col) else e.value


def from_state(s: dict) -> Expr:
    side = lambda i: from_state(s[f"argument{i}_recursion"]) if s.get(f"argument{i}_recursion") else expr(s[f"argument{i}"])
    return BinOp(s["operand"], side(0), side(1)) if s.get("operand") else side(0)


def parse_arithmetic(text: str) -> float | None:
    """Value of an arithmetic text (numbers, + - * /, brackets; commas and quotes dropped, empty is 0); None if it is none."""
    tokens = re.findall(r"\d+\.?\d*|\.\d+|[-+*/()]|\S", text.replace(",", "").replace('"', "").replace("'", "")) or ["0"]
    at = 0

    def term() -> float:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            v = total()
            if tokens[at] != ")":
                raise ValueError(t)
            at += 1
            return v
        return -term() if t == "-" else term() if t == "+" else float(t)

    def product() -> float:
        nonlocal at
        v = term()
        while at < len(tokens) and tokens[at] in "*/":
            op = tokens[at]
            at += 1
            w = term()
            v = v * w if op == "*" else v / w
        return v

    def total() -> float:
        nonlocal at
        v = product()
        while at < len(tokens) and tokens[at] in "+-":
            op = tokens[at]
            at += 1
            w = product()
            v = v + w if op == "+" else v - w
        return v

    try:
        v = total()
        return v if at == len(tokens) else None
    except (ValueError, IndexError, ZeroDivisionError):
        return None


@dataclass(frozen=True)
class Variable:
    """A template variable: a column of allowed types, or a value of a column."""

    kind: str
    types: tuple[str, ...] = ("numeric",)


@dataclass(frozen=True)
class Template:
    """A question pattern, its expression, its operators and conditions over `{variables}`."""

    pattern: str
    expr: Expr
    operators: tuple[str, ...]
    where: tuple[Cmp, ...] = ()
    types: dict[str, Variable] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not self.expr.sql():
            raise ValueError("empty expression")
        for op in self.operators:
            operator(op)
        missing = [v for v in variables(self.sql_text()) if v not in self.types]
        if missing:
            raise ValueError(f"variables without type: {missing}")

    def sql_text(self) -> str:
        return Query(self.expr, "noop", self.where).sql()

    def queries(self) -> dict[str, Query]:
        """Count first, as one count serves all operators."""
        ops = sorted(self.operators, key=lambda o: o != "count")
        return {o: Query(self.expr, o, self.where) for o in ops}

    def state(self) -> str:
        return json.dumps({"pattern": self.pattern, "expression": to_state(self.expr), "operators": self.operators, "conditions": [[to_state(c.left), c.op, to_state(c.right)] for c in self.where], "types": {k: [v.kind, v.types] for k, v in self.types.items()}}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Template:
        s = json.loads(text)
        value = lambda x: Lit(x["argument0"]) if not x["operand"] and "val" in str(x["argument0"]) else from_state(x)
        return cls(s["pattern"], from_state(s["expression"]), tuple(s["operators"]), tuple(Cmp(from_state(a), op, value(b)) for a, op, b in s["conditions"]), {k: Variable(v[0], tuple(v[1])) for k, v in s["types"].items()})
