"""Catalogue of question templates and the words they use.

`standard()` gives 28 templates: four expressions under seven condition set-ups.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from .ast import AGGREGATES, OPERATORS, BinOp, Cmp, Col, Expr, Lit, Template, Variable, variables

ALL = ("min", "max", "avg", "sum", "noop", "count")
ANY_TYPE = ("numeric", "text", "alphanumeric")
#: Words of comparators in questions. Fixed values. `inverted` keeps texts of older datasets comparable.
WORDS = {"=": "equal to", "!=": "different from", "<": "lesser than", "<=": "lesser or equal than", ">": "greater than", ">=": "greater or equal than"}
INVERTED = WORDS | {"<": WORDS[">"], "<=": WORDS[">="], ">": WORDS["<"], ">=": WORDS["<="]}


def _plain(e: Expr) -> str:
    return e.name if isinstance(e, Col) else str(e.value) if isinstance(e, Lit) else e.sql()


def condition_text(c: Cmp, inverted: bool = False) -> str:
    left = f"the expression {c.left.sql()}" if isinstance(c.left, BinOp) else f"column {_plain(c.left)}"
    right = f"the expression {c.right.sql()}" if isinstance(c.right, BinOp) else _plain(c.right)
    return f" given that {left} has a value {(INVERTED if inverted else WORDS)[c.op]} {right}"


def _columns(e: Expr, types: tuple[str, ...]) -> dict[str, Variable]:
    return {v: Variable("column", types) for v in variables(e.sql())}


def family(e: Expr, description: str | None = None, where: tuple[Cmp, ...] | None = None, operators: tuple[str, ...] = ALL, inverted: bool = False) -> list[Template]:
    """Templates of one expression: all seven condition set-ups, or one with the given conditions together."""
    own = variables(e.sql())
    if not own:
        raise ValueError("an expression needs a variable")
    about = description or (f" of column {{{own[0]}}}" if len(own) == 1 else f" of the expression {e.sql()}")
    main = _columns(e, ("numeric",))
    if where is not None:
        kinds: dict[str, Variable] = {}
        for c in where:
            numeric = isinstance(c.left, BinOp) or isinstance(c.right, BinOp) or c.op in ("<", "<=", ">", ">=")
            for v in variables(c.sql()):
                kinds[v] = Variable("value" if "val" in v else "column", ("numeric",) if numeric else ANY_TYPE)
        text = " and".join(condition_text(c, inverted) for c in where)
        return [Template("What is the {op}" + about + text + "?", e, operators, where, main | kinds)]
    out = []
    for op in ("=", "!=", "<", "<=", ">", ">=", None):
        types = ANY_TYPE if op in ("=", "!=") else ("numeric",)
        c = (Cmp(Col("{condition_col}"), op, Lit("{condition_val}")),) if op else ()
        kinds = {"condition_col": Variable("column", types), "condition_val": Variable("value", types)} if op else {}
        text = condition_text(c[0], inverted) if op else ""
        out.append(Template("What is the {op}" + about + text + "?", e, ALL if op else AGGREGATES, c, main | kinds))
    return out


_a, _b, _x, _y = Col("{col1}"), Col("{col2}"), Col("{x}"), Col("{y}")

EXPRESSIONS: dict[str, tuple[Expr, str | None]] = {
    "basic": (_a, " of column {col1}"),
    "difference": (_a - _b, " of the difference between column {col1} and column {col2}"),
    "ratio": (_a / _b, " of the ratio of column {col1} to column {col2}"),
    "complex": (_a * ((_a - _b) * ((Lit(2) * (_a * _b)) / ((_a * _a) + (_b * _b)))), None),
    "expression2": (((_a + _b) - 0.1) / (Lit(0.5) + (_b * _a)), None),
    "product_over_squares": ((_x * _y) / ((_x * _x) + (_y * _y)), None),
    "add_one": (_a + 1, " of column {col1} plus one"),
}


def catalogue(name: str) -> list[Template]:
    e, text = EXPRESSIONS[name]
    return family(e, text)


def standard() -> list[Template]:
    return [t for n in ("basic", "difference", "ratio", "complex") for t in catalogue(n)]


def range_template() -> Template:
    c = Col("{condition_col}")
    return family(_a, " of column {col1}", (Cmp(c, ">=", Lit("{low_val}")), Cmp(c, "<=", Lit("{high_val}"))))[0]


def difference_at_least() -> Template:
    return family(_a, " of column {col1}", (Cmp(Col("{col2}") - Col("{col3}"), ">=", Lit("{condition_val}")),))[0]


#: Named sets of templates, each a preset of a question dataset.
PRESETS = {
    "standard": standard,
    "basic": lambda: catalogue("basic"),
    "difference": lambda: catalogue("difference"),
    "ratio_no_filter": lambda: [t for t in catalogue("ratio") if not t.where],
    "expression": lambda: catalogue("complex"),
    "expression2": lambda: catalogue("expression2"),
    "product_over_squares": lambda: catalogue("product_over_squares"),
    "add_one": lambda: catalogue("add_one"),
    "range": lambda: [range_template()],
    "difference_at_least": lambda: [difference_at_least()],
}


def preset(names: str | list[str]) -> list[Template]:
    """Templates of one or several presets."""
    return [t for n in ([names] if isinstance(names, str) else names) for t in PRESETS[n]()]


def dataset_name(names: list[str]) -> str:
    return "_".join(n.rstrip("/").rsplit("/", 1)[-1] for n in names)


def template_hash(t: Template) -> str:
    return hashlib.sha256((t.pattern + t.expr.sql() + "".join(c.sql() for c in t.where)).encode()).hexdigest()


def phrasings(op: str) -> list[str]:
    """The operator's word and its synonyms."""
    return [OPERATORS[op][1], *OPERATORS[op][2]]


def to_frame(spark: SparkSession, templates: list[Template]) -> DataFrame:
    return spark.createDataFrame([(template_hash(t), t.pattern, t.expr.sql(), list(t.operators), t.state()) for t in templates], "template_hash string, pattern string, expression string, operators array<string>, state string")


def from_frame(df: DataFrame) -> list[Template]:
    return [Template.from_json(r[0]) for r in df.select("state").toLocalIterator()]
