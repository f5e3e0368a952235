"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as a whole: optional sign, fraction only, or digits (plain or grouped by commas) with optional fraction.
NUMBER = r"-?(?:\.\d+|(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words for aggregators. Fixed values.
AGGREGATOR_WORDS = {
    "max": ("maximum", "max", "highest", "greatest"),
    "min": ("minimum", "min", "lowest", "smallest"),
    "sum": ("sum",),
    "avg": ("average", "avg", "mean"),
    "noop": ("value",),
}

#: Spacing of tokenised text: what is replaced, in order. Fixed values.
SPACING = ((" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"'), (" '", "'"), (" .", "."), (" ,", ","))


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(rf"\A(?:{pattern})\z")


def is_number(c: Column) -> Column:
    return full_match(c, NUMBER)


def has_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def to_number(c: Column) -> Column:
    """Double of a cell, thousands separators dropped; null if it is no number."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def cell_kind(c: Column) -> Column:
    """int, float, num_text or text of one cell."""
    return F.when(full_match(c, r"[+-]?\d+"), "int").when(full_match(c, r"[+-]?(?:\d+\.\d*|\.\d+)"), "float").when(c.rlike(r"\d"), "num_text").otherwise("text")


def value_kind(c: Column) -> Column:
    """What a text parses as: int, float or str."""
    return F.when(c.try_cast("bigint").isNotNull() & full_match(c, r"\s*[+-]?\d+\s*"), "int").when(c.try_cast("double").isNotNull(), "float").otherwise("str")


def clean_cell(c: Column) -> Column:
    """Trimmed; a cell that was empty before trimming becomes two quote characters."""
    return F.when(c == "", F.lit("''")).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{C}", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def normalised(c: Column) -> Column:
    """ASCII lower case without punctuation."""
    return F.translate(c, UPPER + PUNCTUATION, LOWER)


def words(c: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks."""
    count = F.size(tokens) - n + 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.size(F.split(c, r"\s+"))


def byte_count(c: Column) -> Column:
    return F.octet_length(c)


def between_markers(c: Column, start: str, end: str) -> Column:
    """Longest text between two literal markers; empty if they don't occur in this order."""
    q = lambda s: "".join("\\" + x if not x.isalnum() and x != " " else x for x in s)
    return F.regexp_extract(c, rf"(?s){q(start)}(.*){q(end)}", 1)


def after_marker(c: Column, start: str, pattern: str) -> Column:
    q = "".join("\\" + x if not x.isalnum() and x != " " else x for x in start)
    return F.regexp_extract(c, rf"(?s){q}({pattern})", 1)


def aggregator_of(word: Column) -> Column:
    """Operator of an aggregator word; 'unknown' if none."""
    w = ascii_lower(F.trim(word))
    return reduce(lambda rest, k: F.when(w.isin(*AGGREGATOR_WORDS[k]), k).otherwise(rest), AGGREGATOR_WORDS, F.lit("unknown"))


#: Words of a question that tell its main expression. Fixed values.
EXPRESSION_WORDS = {"difference": " of the difference between column ", "ratio": " of the ratio of column ", "expression": " of the expression "}

#: Words of a question that tell its comparator; longer phrases come before what they begin with. Fixed values.
CONDITION_WORDS = {
    "=": "has a value equal to",
    "!=": "has a value different from",
    ">=": "has a value greater or equal than",
    ">": "has a value greater than",
    "<=": "has a value lesser or equal than",
    "<": "has a value lesser than",
}


def _first_phrase(c: Column, phrases: dict[str, str], default: str) -> Column:
    return reduce(lambda rest, k: F.when(c.contains(phrases[k]), k).otherwise(rest), reversed(phrases), F.lit(default))


def main_expression_class(question: Column) -> Column:
    return _first_phrase(question, EXPRESSION_WORDS, "single column")


def condition_class(question: Column) -> Column:
    """Comparator that the question's words state."""
    return _first_phrase(question, CONDITION_WORDS, "")


def quote_columns(text: Column, names: Column) -> Column:
    """Column names as words of a text, or before its question mark, in double quotes; single quotes round them go. All names are folded in."""

    def quoted(acc: Column, n: Column) -> Column:
        sides = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
        for old, new in (((" '", "' "), (" ", " ")), (("column '", "'?"), (" ", "?")), ((" ", " "), (' "', '" ')), ((" ", "?"), (' "', '"?'))):
            acc = F.replace(acc, sides(*old), sides(*new))
        return acc

    return F.aggregate(names, text, quoted)


def sql_cut(c: Column) -> Column:
    """Model-written SQL up to its first `;` or code fence."""
    return F.trim(F.split(F.split(c, ";")[0], "```")[0])


def detokenise(c: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), SPACING, c)


def glob_match(c: Column, patterns: list[str]) -> Column:
    """Any of the shell patterns (* and ?) matches the whole text."""
    regex = ["".join(".*" if x == "*" else "." if x == "?" else "\\" + x if not x.isalnum() else x for x in p) for p in patterns]
    return reduce(lambda a, b: a | b, (full_match(c, r) for r in regex), F.lit(False))


def key_values(c: Column) -> Column:
    """Map of a `k=v,k=v` text."""
    return F.str_to_map(c, F.lit(","), F.lit("="))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[\"<>:/|\\?*\[\]]+', "__")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """Position (from 0) of the first greatest element."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def rolling_windows(tokens: Column, size: int, prefix: str, context: int = 1) -> Column:
    """Windows of a model that reads `size` tokens, which predict every token once: structs of `read` and `predict`.

    The first predicts `size` tokens from `prefix` on; each other one predicts up to size - context + 1 more,
    and reads the `size` tokens before its last one. No tokens: no windows.
    """
    n, step = F.size(tokens), size - context + 1
    later = F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))

    def window(i: Column) -> Column:
        end = F.least(n, F.lit(size) + i * step)
        done = F.when(i == 0, 0).otherwise(F.lit(size) + (i - 1) * step)
        read = F.when(i == 0, F.concat(F.array(F.lit(prefix)), F.slice(tokens, 1, end - 1))).otherwise(F.slice(tokens, F.greatest(end - size, F.lit(1)), F.lit(size)))
        return F.struct(read.alias("read"), F.slice(tokens, done + 1, end - done).alias("predict"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), later), window)).otherwise(F.array().cast("array<struct<read:array<string>,predict:array<string>>>"))


def disjoint_windows(windows: Column) -> Column:
    """Windows whose `read` stops where `predict` begins."""
    return F.transform(windows, lambda w: F.struct(F.slice(w["read"], 1, F.size(w["read"]) - F.size(w["predict"]) + 1).alias("read"), w["predict"].alias("predict")))


def linearised(header: Column, rows: Column, cell: str = " | ", line: str = "\n") -> Column:
    """Header and rows as one text; line ends inside cells become blanks."""
    clean = lambda a: F.array_join(F.transform(a, lambda x: F.trim(F.regexp_replace(x, r"[\r\n]+", " "))), cell)
    return F.concat_ws(line, clean(header), F.array_join(F.transform(rows, clean), line))


def ddl(name: Column, header: Column, types: Column) -> Column:
    """CREATE TABLE text: numeric columns FLOAT, others TEXT."""
    parts = F.transform(F.arrays_zip(header.alias("h"), types.alias("t")), lambda x: F.concat(F.lit('"'), x["h"], F.lit('" '), F.when(x["t"] == "numeric", "FLOAT").otherwise("TEXT")))
    return F.concat(F.lit("CREATE TABLE "), name, F.lit(" (\n"), F.array_join(parts, ",\n"), F.lit("\n);"))


def prompt(table: Column, question: Column, table_first: bool = True, boxed: bool = False) -> Column:
    """Table and question as a prompt, optionally asking for an answer in a box."""
    parts = [table, question] if table_first else [question, table]
    tail = "\nThink step by step and put the final answer in \\boxed{}.\nAnswer:" if boxed else "\nAnswer:"
    return F.concat(parts[0], F.lit("\n"), parts[1], F.lit(tail))


def few_shot(examples: Column, query: Column, separator: str = "\n\n") -> Column:
    """Solved examples (structs text, target) before a query."""
    return F.concat(F.array_join(F.transform(examples, lambda e: F.concat(e["text"], F.lit(" "), e["target"])), separator), F.lit(separator), query)
