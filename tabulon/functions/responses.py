"""Response filters: Column to Column, composed in order into named pipelines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, PUNCTUATION, UPPER

Filter = Callable[[Column], Column]
REGISTRY: dict[str, Callable[..., Filter]] = {}


def register(name: str):
    def keep(f):
        REGISTRY[name] = f
        return f

    return keep


def _each(f: Filter) -> Filter:
    """A filter of texts lifted to arrays of responses."""
    return lambda c: F.transform(c, f)


@register("regex")
def regex(pattern: str, group: int = 1, select: int = 0, fallback: str = "[invalid]") -> Filter:
    """The select-th match (negative: from the end) of a pattern, trimmed; else the fallback."""
    def one(c: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
        at = F.lit(select + 1 if select >= 0 else select)
        return F.coalesce(F.trim(F.try_element_at(found, at)), F.lit(fallback))

    return _each(one)


@register("lowercase")
def lowercase() -> Filter:
    return _each(F.lower)


@register("uppercase")
def uppercase() -> Filter:
    return _each(F.upper)


@register("remove_whitespace")
def remove_whitespace() -> Filter:
    return _each(lambda c: F.regexp_replace(c, r"^\s+", ""))


@register("map")
def mapped(values: dict[str, str], default: str | None = None) -> Filter:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return _each(lambda c: F.coalesce(F.try_element_at(table, c), F.lit(default)))


@register("take_first")
def take_first() -> Filter:
    return lambda c: F.slice(c, 1, 1)


@register("take_first_k")
def take_first_k(k: int) -> Filter:
    return lambda c: F.slice(c, 1, k)


@register("majority_vote")
def majority_vote() -> Filter:
    """The most frequent response; the one seen first wins ties."""
    def vote(c: Column) -> Column:
        scored = F.transform(F.array_distinct(c), lambda x: F.struct(F.size(F.filter(c, lambda y: y == x)).alias("n"), (-F.array_position(c, x)).alias("first"), x.alias("x")))
        return F.array(F.array_max(scored)["x"])

    return vote


def pipeline(*steps: Filter) -> Filter:
    return lambda c: reduce(lambda x, f: f(x), steps, c)


def build(steps: list[tuple[str, dict]]) -> Filter:
    """A pipeline by registered names."""
    return pipeline(*(REGISTRY[n](**kw) for n, kw in steps))


def apply_filters(df: DataFrame, filters: dict[str, Filter], column: str = "resps") -> DataFrame:
    """One row per row and pipeline: filter, filtered_resps."""
    out = [df.withColumns({"filter": F.lit(n), "filtered_resps": f(F.col(column))}) for n, f in filters.items()]
    return reduce(DataFrame.unionByName, out)


def exact_form(c: Column, remove: list[str] = (), ignore_case: bool = False, ignore_punctuation: bool = False, ignore_numbers: bool = False) -> Column:
    """A text as exact matching sees it."""
    for r in remove:
        c = F.regexp_replace(c, r, "")
    if ignore_case:
        c = F.translate(c, UPPER, LOWER)
    if ignore_punctuation:
        c = F.translate(c, PUNCTUATION, "")
    return F.translate(c, "0123456789", "") if ignore_numbers else c


def choice_filter(
    df: DataFrame, response: str = "response", choices: str = "choices", pattern: str = r"#### (\-?[0-9\.\,]+)", nth: int = 0, fallback: str = "[invalid]", ignore_case: bool = False, ignore_punctuation: bool = False, ignore: tuple[str, ...] = ()
) -> DataFrame:
    """Adds `choice`: what a response names, as text or as the letter '(A)' of a choice.

    First `pattern`; then any choice's wording (after the `ignore` patterns, case and punctuation are taken
    away, as asked); then a letter after a colon; else `fallback`. `nth` picks among several finds (negative:
    from the end). The regular expressions differ by row, so this runs in pandas batches.
    """
    import re
    import unicodedata

    def bare(text: str) -> str:
        for x in ignore:
            text = re.sub(x, "", text)
        text = text.lower() if ignore_case else text
        return "".join(c for c in text if unicodedata.category(c)[0] != "P") if ignore_punctuation else text

    def find(regex: str, text: str) -> str:
        found = [m.groups() or (m.group(),) for m in re.finditer(regex, text)]
        if not -len(found) <= nth < len(found):
            return ""
        return next((g for g in found[nth] if g), "").strip()

    @F.pandas_udf("string")
    def pick(r: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for text, options in zip(r, c, strict=True):
            text, options = text or "", [bare((o or "").strip()) for o in (() if options is None else options)]
            letters = [chr(ord("A") + i) for i in range(len(options))]
            named = dict(zip(options, letters, strict=True))
            got = find(pattern, text)
            if not got and options:
                got = find("|".join(map(re.escape, options)), bare(text))
                got = f"({named[got]})" if got in named else got
            if not got and options:
                got = find(rf":\s*({'|'.join(map(re.escape, letters))})", text)
                got = f"({got})" if got else ""
            out.append(got or fallback)
        return pd.Series(out)

    return df.withColumn("choice", pick(response, choices))
