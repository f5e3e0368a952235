"""From tables and templates to answered, filtered questions, as one plan.

questions -> each once -> answers (equal SQL over a table is worked out once) -> row counts of their
conditions -> quality filters -> consistent quoting -> an equal number a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_columns, to_number
from ..operators import answering as Q
from ..operators.normalize import column_types
from ..operators.report import with_counts
from ..operators.sampling import equal_cutoff
from .assign import assignments, columns_of, questions
from .ast import Cmp, Col, Expr, Lit, Template, variables
from .templates import EXPRESSIONS, template_hash

KEY = ("nl_question", "sql_query", "table_id")
_PLAN = "op, shape, agg_idx, agg_idx2, cond_idx, cmp, val, also".split(", ")


def _unnamed(e: Expr) -> str:
    """An expression's text with its variables numbered in order."""
    out = e.sql()
    for i, v in enumerate(variables(out)):
        out = out.replace("{" + v + "}", f"{{{i}}}")
    return out


def shape_of(e: Template | Expr) -> str | None:
    """The shape under which `answer` knows an expression (of a template), whatever its variables are called; None if it doesn't."""
    sql = _unnamed(e.expr if isinstance(e, Template) else e)
    shape = next((n for n, (known, _) in EXPRESSIONS.items() if _unnamed(known) == sql), None)
    return "single" if shape == "basic" else shape


def plan_columns(t: Template) -> dict[str, Column]:
    """Columns that `answer` reads, from a template's assignments: the first condition on a column, and all others as further ones."""
    null = F.lit(None)

    def side(e: Expr) -> tuple[Column, Column, Column]:
        shape = shape_of(e)
        if shape is None:
            raise ValueError(f"answers don't know the expression {e.sql()}")
        own = [F.col(f"{v}_id").cast("int") for v in variables(e.sql())]
        return F.lit(shape), own[0], own[1] if len(own) > 1 else null.cast("int")

    def value(c: Cmp) -> Column:
        names = variables(c.right.sql())
        if not isinstance(c.right, Lit) or len(names) > 1:
            raise ValueError("conditions compare with one value")
        return F.col(names[0]) if names else F.lit(str(c.right.value))

    shape, first, second = side(t.expr)
    out = {"shape": shape, "agg_idx": first, "agg_idx2": second}
    plain = next((c for c in t.where if isinstance(c.left, Col)), None)
    also = [c for c in t.where if c is not plain]
    terms = [F.struct(*(x.alias(n) for n, x in zip(("shape", "idx", "idx2"), side(c.left), strict=True)), F.lit(c.op).alias("cmp"), value(c).alias("val")) for c in also]
    out["also"] = (F.array(*terms) if terms else F.array()).cast(Q.ALSO)
    if plain is None:
        return out | {"cond_idx": null.cast("int"), "cmp": null.cast("string"), "val": null.cast("string")}
    return out | {"cond_idx": side(plain.left)[1], "cmp": F.lit(plain.op), "val": value(plain)}


def asked(cells: DataFrame, templates: list[Template], most: int = 10, strategy: str = "random", seed: int = 0) -> DataFrame:
    """Questions of all templates over all tables of `cells`, each once, with the columns that `answer` reads."""
    types = column_types(cells)
    catalog = types.join(cells.select("table", "name", "col_id").distinct(), ["table", "name"]).select(F.col("table").alias("table_id"), "col_id", "name", "type")
    values = cells.withColumn("number", to_number(F.col("value")))
    parts = [questions(assignments(catalog, values, t, most, strategy=strategy, seed=seed), t, carry=plan_columns(t)) for t in templates]
    return reduce(DataFrame.unionByName, parts).withColumn("op", F.col("operator")).dropDuplicates(list(KEY))


def rows_of(cells: DataFrame) -> DataFrame:
    """(table_id, row_id, cells) of `cells`."""
    by = cells.groupBy(F.col("table").alias("table_id"), "row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "value"))).alias("c"))
    return by.select("table_id", "row_id", F.transform("c", lambda x: x["value"]).alias("cells"))


def answered(found: DataFrame, rows: DataFrame, semantics: str = "typed") -> DataFrame:
    """Questions with answer, alternatives, multi_row and n_rows. Equal SQL over a table is answered once."""
    named = found.withColumn("qid", F.sha2(F.concat_ws("\x00", "table_id", "sql_query"), 256))
    once = named.groupBy("qid").agg(F.first("table_id").alias("table_id"), *(F.first(c).alias(c) for c in _PLAN))
    return named.join(Q.answer(rows, once, semantics).drop("op", "number"), "qid").drop("qid", *_PLAN)


def counted(questions: DataFrame) -> DataFrame:
    """Questions with `n_rows` from the count question that shares their table, template and condition."""
    counts = questions.where("operator = 'count'").groupBy("table_id", "template_hash", "count_hash").agg(F.first("answer").cast("double").cast("long").alias("answer"))
    return with_counts(questions.drop("n_rows"), counts)


def filtered(questions: DataFrame, threshold: int = 2, single: bool = True, most_length: int = 256) -> DataFrame:
    """Without unanswered or invalid answers, comparisons with nothing, several answers, aggregates over few rows, long answers."""
    out = Q.comparable_conditions(Q.valid_answers(Q.answered(questions)))
    out = Q.single_answers(out) if single else out
    out = out.where(~F.coalesce(Q.few_rows(F.col("operator"), F.col("n_rows"), threshold), F.lit(False)))
    return Q.short_values(out, "answer", most_length)


def quoted(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """Column names in double quotes in the questions' texts."""
    heads = cells.select(F.col("table").alias("table_id"), "name", "col_id").distinct().groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "name"))), lambda x: x["name"]).alias("_names"))
    return questions.join(heads, "table_id").withColumn("nl_question", quote_columns(F.col("nl_question"), F.col("_names"))).drop("_names")


def synthesised(cells: DataFrame, templates: list[Template], most: int = 10, seed: int = 0, threshold: int = 2, cutoff: int | None = None) -> DataFrame:
    """The whole way: questions over `cells` that have one good answer, as many of each table (`cutoff` in all)."""
    out = quoted(filtered(counted(answered(asked(cells, templates, most, seed=seed), rows_of(cells))), threshold), cells)
    return out if cutoff is None else equal_cutoff(out, cutoff)


def extended(old: DataFrame, new: DataFrame) -> DataFrame:
    """A dataset with questions of further tables, templates or by hand: those that it hasn't yet. Columns as in `old`."""
    fresh = new.dropDuplicates(list(KEY)).join(old.select(*KEY), list(KEY), "left_anti")
    return old.unionByName(fresh.select(*(F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns)))


__all__ = ["answered", "asked", "counted", "extended", "filtered", "plan_columns", "quoted", "rows_of", "shape_of", "synthesised", "template_hash"]
