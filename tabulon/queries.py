"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import responses as R
from .functions import text as T
from .operators import answering as Q
from .operators import corpus as C
from .operators import metrics as M
from .operators import normalize as N
from .operators import report as P
from .operators import sampling as S
from .plans import assign, templates
from .plans.ast import COMPARATORS, Cmp, Col, Lit, Over, Query, between, fused
from .session import ship
from .sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


PRICE, QTY, DISC = Col("l_extendedprice"), Col("l_quantity"), Col("l_discount")
FLAG_A = (Cmp(Col("l_returnflag"), "=", Lit("A")),)


def _rounded(df: DataFrame, name: str = "answer", digits: int = 2) -> DataFrame:
    return df.withColumn(name, F.round(F.col(name).cast("double"), digits))


# --- aggregates and predicates on one table ---

for _op in ("min", "max", "avg", "sum", "count"):

    @query(f"agg_basic_{_op}", f"SELECT round(CAST({_op}(l_extendedprice) AS DOUBLE), 2) AS answer FROM lineitem WHERE l_returnflag = 'A'")
    def _(spark, d, op=_op):
        return _rounded(Query(PRICE, op, FLAG_A).plan(table(spark, d, "lineitem")))


@query("noop_lookup", "SELECT o_totalprice AS answer FROM orders WHERE o_orderkey = 7")
def noop_lookup(spark, d):
    return Query(Col("o_totalprice"), "noop", (Cmp(Col("o_orderkey"), "=", Lit(7)),)).plan(table(spark, d, "orders"))


for _name, _cmp in zip(("eq", "ne", "lt", "le", "gt", "ge"), COMPARATORS[:2] + COMPARATORS[2:], strict=True):

    @query(f"cmp_{_name}", f"SELECT count(l_quantity) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity {_cmp} 24")
    def _(spark, d, op=_cmp):
        rows = table(spark, d, "lineitem").where(Cmp(QTY, op, Lit(24)).column())
        return rows.agg(F.count("l_quantity").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("range_filter", "SELECT count(o_totalprice) AS answer FROM orders WHERE o_totalprice BETWEEN 20000 AND 90000")
def range_filter(spark, d):
    return Query(Col("o_totalprice"), "count", between(Col("o_totalprice"), 90000, 20000)).plan(table(spark, d, "orders"))


@query("multi_condition", "SELECT count(*) AS n_rows, round(avg(l_quantity), 6) AS answer FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 10 AND l_discount != 0.05")
def multi_condition(spark, d):
    where = (*FLAG_A, Cmp(QTY, ">", Lit(10)), Cmp(DISC, "!=", Lit(0.05)))
    return _rounded(fused(table(spark, d, "lineitem"), {"q": Query(QTY, "avg", where)}), digits=6).select("n_rows", "answer")


@query("expression_condition", "SELECT count(*) AS answer FROM lineitem WHERE l_extendedprice - l_quantity > l_quantity * 1000")
def expression_condition(spark, d):
    return Query(PRICE, "count", (Cmp(PRICE - QTY, ">", QTY * 1000),)).plan(table(spark, d, "lineitem"))


_EXPRESSIONS = {
    "difference": (PRICE - QTY, "l_extendedprice - l_quantity"),
    "ratio": (PRICE / QTY, "l_extendedprice / NULLIF(l_quantity, 0)"),
    "complex": (QTY * ((QTY - DISC) * ((Lit(2) * (QTY * DISC)) / ((QTY * QTY) + (DISC * DISC)))), "l_quantity * ((l_quantity - l_discount) * ((2 * (l_quantity * l_discount)) / NULLIF(l_quantity * l_quantity + l_discount * l_discount, 0)))"),
    "expression2": (((QTY + DISC) - 0.1) / (Lit(0.5) + (DISC * QTY)), "(l_quantity + l_discount - 0.1) / NULLIF(0.5 + l_discount * l_quantity, 0)"),
    "product_over_squares": ((QTY * DISC) / ((QTY * QTY) + (DISC * DISC)), "l_quantity * l_discount / NULLIF(l_quantity * l_quantity + l_discount * l_discount, 0)"),
    "add_one": (QTY + 1, "l_quantity + 1"),
}
for _name, (_expr, _sql) in _EXPRESSIONS.items():

    @query(f"expr_{_name}", f"SELECT round(CAST(min(e) AS DOUBLE), 4) AS lo, round(CAST(max(e) AS DOUBLE), 4) AS hi, round(CAST(avg(e) AS DOUBLE), 4) AS mean, count(e) AS n FROM (SELECT {_sql} AS e FROM lineitem WHERE l_linestatus = 'O')")
    def _(spark, d, e=_expr):
        rows = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(e.column().cast("double").alias("e"))
        return rows.agg(F.round(F.min("e"), 4).alias("lo"), F.round(F.max("e"), 4).alias("hi"), F.round(F.avg("e"), 4).alias("mean"), F.count("e").alias("n"))


def _question_list() -> dict[str, Query]:
    out = {}
    for op in ("min", "max", "avg", "sum", "count"):
        for flag in "ANR":
            out[f"{op}_{flag}"] = Query(PRICE, op, (Cmp(Col("l_returnflag"), "=", Lit(flag)),))
        out[f"{op}_q"] = Query(PRICE - QTY, op, (Cmp(QTY, ">=", Lit(45)),))
    return out


_FUSED = " UNION ALL ".join(
    f"SELECT '{k}' AS qid, round(CAST({q.op}({'l_extendedprice - l_quantity' if k.endswith('_q') else 'l_extendedprice'}) AS DOUBLE), 2) AS answer, count(*) AS n_rows FROM lineitem WHERE {'l_quantity >= 45' if k.endswith('_q') else f"l_returnflag = '{k[-1]}'"}"
    for k, q in _question_list().items()
)


@query("fused_questions", _FUSED)
def fused_questions(spark, d):
    return _rounded(fused(table(spark, d, "lineitem"), _question_list()))


@query("preagg_row_count", "SELECT l_shipyear AS year, round(max(l_extendedprice), 2) AS answer, count(*) AS n_rows FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS l_shipyear FROM lineitem WHERE l_discount > 0.05) GROUP BY 1")
def preagg_row_count(spark, d):
    rows = table(spark, d, "lineitem").where("l_discount > 0.05")
    return rows.groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.max("l_extendedprice"), 2).alias("answer"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "window_agg_rows",
    """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, count(o_totalprice) OVER w AS n, max(o_totalprice) OVER w AS hi FROM orders
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def window_agg_rows(spark, d):
    over, x = Over(("o_custkey",), ("o_orderkey",), 2, 0), Col("o_totalprice")
    out = table(spark, d, "orders")
    for op, name in (("sum", "total"), ("count", "n"), ("max", "hi")):
        out = Query(x, op, over=over).plan(out, name)
    return out.select("o_orderkey", F.round("total", 2).alias("total"), "n", "hi")


# --- corpus form: tables as string cells, answered together ---


def _cells(spark, d) -> DataFrame:
    """customer, part and supplier as cells."""
    parts = [N.unpivot(table(spark, d, t), t, k) for t, k in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CELLS = "WITH cells AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", CAST({k} AS BIGINT) AS row_id, {i} AS col_id, '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM {t}"
    for t, k, cols in (
        ("customer", "c_custkey", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
        ("part", "p_partkey", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
        ("supplier", "s_suppkey", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")),
    )
    for i, c in enumerate(cols)
) + ")"
_NUMBER = r"-?(\.\d+|(\d{1,3}(,\d{3})+|\d+)(\.\d+)?)"
_TYPES = rf"""types AS (SELECT "table", name, CASE WHEN bool_and(regexp_full_match(value, '{_NUMBER}')) THEN 'numeric' WHEN bool_and(regexp_matches(value, '{_NUMBER}')) THEN 'alphanumeric' ELSE 'text' END AS type FROM cells GROUP BY 1, 2)"""


@query("infer_types", f'{_CELLS}, {_TYPES} SELECT "table", name, type FROM types')
def infer_types(spark, d):
    return N.column_types(_cells(spark, d))


@query("column_profile", f'{_CELLS} SELECT "table", name, count(*) AS n_rows, count(DISTINCT value) AS n_distinct, count(DISTINCT value) / count(*) AS density FROM cells GROUP BY 1, 2')
def column_profile(spark, d):
    return N.column_profile(_cells(spark, d))


@query("column_distinct", f"{_CELLS} SELECT name, value, min(row_id) AS first_row FROM cells WHERE name IN ('c_mktsegment', 'p_brand', 'p_type') GROUP BY 1, 2")
def column_distinct(spark, d):
    return N.column_values(_cells(spark, d).where(F.col("name").isin("c_mktsegment", "p_brand", "p_type")), distinct=True).select("name", "value", "first_row")


@query("columns_by_type", f"""{_CELLS}, {_TYPES} SELECT "table", array_to_string(list_sort(list(name)), ',') AS names FROM types WHERE type = 'numeric' GROUP BY 1""")
def columns_by_type(spark, d):
    return N.columns_of_type(N.column_types(_cells(spark, d)), "numeric").select("table", F.array_join("names", ",").alias("names"))


@query("table_schema_hash", f"""{_CELLS}, {_TYPES} SELECT "table", sha256(string_agg(name, '' ORDER BY name) || string_agg(type, '' ORDER BY name)) AS schema_id FROM types GROUP BY 1""")
def table_schema_hash(spark, d):
    types = N.column_types(_cells(spark, d)).groupBy("table").agg(F.collect_list("name").alias("n"), F.collect_list("type").alias("t"))
    return types.select("table", N.schema_id(F.col("n"), F.col("t")).alias("schema_id"))


@query(
    "table_ids",
    """SELECT 'nation' AS "table", sha256(sha256('n_namen_nationkeyn_regionkey' || 'textnumericnumeric') || string_agg(CAST(n_nationkey AS VARCHAR), '' ORDER BY n_nationkey) || string_agg(CAST(n_regionkey AS VARCHAR), '' ORDER BY n_nationkey) || '(3, ' || count(*) || ')') AS table_id FROM nation""",
)
def table_ids(spark, d):
    cells = N.unpivot(table(spark, d, "nation"), "nation", "n_nationkey")
    return N.table_ids(cells, N.column_types(cells).withColumn("type", F.when(F.col("name") == "n_name", "text").otherwise(F.col("type")))).select("table", "table_id")


@query("clean_cells", r"SELECT p_partkey, CASE WHEN v = '' THEN '''''' ELSE regexp_replace(v, '^\s+|\s+$', '', 'g') END AS cell FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 1 THEN '  ' ELSE ' ' || p_name || ' ' END AS v FROM part)")
def clean_cells(spark, d):
    v = F.when(F.col("p_partkey") % 10 == 0, "").when(F.col("p_partkey") % 10 == 1, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", T.clean_cell(v).alias("cell"))


@query("strip_commas", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '000' AS plain FROM orders")
def strip_commas(spark, d):
    grouped = F.concat(F.col("o_orderkey").cast("string"), F.lit(",000"))
    return table(spark, d, "orders").select("o_orderkey", N.strip_commas(grouped, F.lit("numeric")).alias("plain"))


@query("cell_kinds", r"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(v, '[+-]?\d+') THEN 'int' WHEN regexp_full_match(v, '[+-]?(\d+\.\d*|\.\d+)') THEN 'float' WHEN regexp_matches(v, '\d') THEN 'num_text' ELSE 'text' END AS kind FROM (SELECT c_name AS v FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT c_mktsegment FROM customer)) GROUP BY 1")
def cell_kinds(spark, d):
    v = table(spark, d, "customer").select(F.explode(F.array("c_name", F.col("c_custkey").cast("string"), "c_mktsegment")).alias("v"))
    return P.value_counts(v.select(T.cell_kind(F.col("v")).alias("kind")), "kind")


@query("header_dedup", "SELECT p_partkey, p_name || '|' || upper(p_name) || '_2|column_2|' || p_brand || '|' || p_name || '_3' AS names FROM part")
def header_dedup(spark, d):
    heads = table(spark, d, "part").select("p_partkey", F.array("p_name", F.upper("p_name"), F.lit(""), "p_brand", "p_name").alias("header"))
    return heads.select("p_partkey", F.array_join(N.dedup_header(N.fill_header(F.col("header"))), "|").alias("names"))


@query("row_hash_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY 2")
def row_hash_dedup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return N.keep_first(rows, ["hash"], "doc_id")


@query("long_column_names", f"""{_CELLS} SELECT "table", CAST(max(length(name)) AS INTEGER) AS longest FROM (SELECT DISTINCT "table", name FROM cells) GROUP BY 1 HAVING max(length(name)) >= 12""")
def long_column_names(spark, d):
    heads = _cells(spark, d).select("table", "name").distinct().groupBy("table").agg(F.collect_list("name").alias("header"))
    return N.long_names(heads, 12).select("table", F.array_max(F.transform("header", F.length)).alias("longest"))


@query("argsort", "SELECT l_orderkey, array_to_string(list(l_linenumber ORDER BY l_extendedprice, l_linenumber), ',') AS by_price FROM lineitem GROUP BY 1")
def argsort(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("r"))
    price, line = F.transform("r", lambda x: x["l_extendedprice"]), F.transform("r", lambda x: x["l_linenumber"])
    return by.select("l_orderkey", F.array_join(F.transform(N.take_order(line, N.argsort(price)), lambda x: x.cast("string")), ",").alias("by_price"))


# --- templates, bindings, rendering ---


def _catalog(spark, d) -> DataFrame:
    cells = _cells(spark, d)
    ids = cells.select("table", "name", "col_id").distinct()
    return N.column_types(cells).join(ids, ["table", "name"]).select(F.col("table").alias("table_id"), "col_id", "name", "type")


@query("bindings_permutations", f"""{_CELLS}, {_TYPES} SELECT a."table" AS table_id, a.name AS col1, b.name AS col2, c.name AS condition_col FROM types a JOIN types b USING ("table") JOIN types c USING ("table") WHERE a.type = 'numeric' AND b.type = 'numeric' AND a.name <> b.name AND a.name <> c.name AND b.name <> c.name""")
def bindings_permutations(spark, d):
    t = templates.catalogue("difference")[0]
    return assign.bindings(_catalog(spark, d), assign.columns_of(t)).select("table_id", "col1", "col2", "condition_col")


@query(
    "assignments_sampled",
    f"""{_CELLS}, {_TYPES}, pool AS (SELECT "table", name, least(20, count(DISTINCT value)) AS k FROM cells GROUP BY 1, 2)
        SELECT a."table" AS table_id, CAST(least(20, sum(k)) AS BIGINT) AS n, CAST(least(20, sum(k)) AS BIGINT) AS n_distinct, CAST(0 AS BIGINT) AS strange
        FROM types a JOIN types b USING ("table") JOIN pool p ON p."table" = a."table" AND p.name = b.name WHERE a.type = 'numeric' AND a.name <> b.name GROUP BY 1""",
)
def assignments_sampled(spark, d):
    """Sampled by hashes, so held against what any sample must be: so many, all different, of numeric columns and with values of the condition's column."""
    cells = _cells(spark, d)
    t = templates.catalogue("basic")[0]
    got = assign.assignments(_catalog(spark, d), cells.withColumn("number", T.to_number(F.col("value"))), t, most=20)
    column, value = next(iter(assign.columns_of(t))), next(v for v, x in t.types.items() if x.kind == "value")
    known = cells.select(F.col("table").alias("table_id"), F.col("name").alias("condition_col"), F.col("value").alias(value)).distinct().withColumn("known", F.lit(True))
    numeric = N.column_types(cells).where("type = 'numeric'").select(F.col("table").alias("table_id"), F.col("name").alias(column), F.lit(True).alias("numeric"))
    marked = got.join(known, ["table_id", "condition_col", value], "left").join(numeric, ["table_id", column], "left")
    strange = F.col("known").isNull() | F.col("numeric").isNull() | (F.col(column) == F.col("condition_col"))
    return marked.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(column, "condition_col", value).alias("n_distinct"), F.count_if(strange).alias("strange"))


@query("render_questions", f"""{_CELLS}, {_TYPES} SELECT "table" AS table_id, 'What is the maximum of the difference between column ' || a.name || ' and column ' || b.name || '?' AS nl_question, 'SELECT max("' || a.name || '" - "' || b.name || '") FROM df' AS sql_query FROM types a JOIN types b USING ("table") WHERE a.type = 'numeric' AND b.type = 'numeric' AND a.name <> b.name""")
def render_questions(spark, d):
    t = templates.catalogue("difference")[-1]
    bound = assign.bindings(_catalog(spark, d), assign.columns_of(t))
    return assign.questions(bound, t).where("operator = 'max'").select("table_id", "nl_question", "sql_query")


@query(
    "question_dataset",
    f"""{_CELLS} SELECT table_id, operator, TRUE AS some, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS strange
        FROM (SELECT DISTINCT "table" AS table_id FROM cells), (VALUES ('min'), ('max'), ('avg'), ('sum'), ('count'), ('noop')) o(operator)""",
)
def question_dataset(spark, d):
    """Sampled by hashes, so held against what any dataset must be: all operators for all tables, no question twice, each naming its column in both texts."""
    cells = _cells(spark, d)
    got = assign.dataset(_catalog(spark, d), cells.withColumn("number", T.to_number(F.col("value"))), templates.standard()[:4], most=10)
    column = F.col("aggregation_column")
    named = (column == "expression") | (F.col("operator") == "count") | (F.contains("sql_query", column) & F.contains("nl_question", column))
    strange = ~named | F.col("sql_query").contains("{") | F.col("nl_question").contains("{")
    by = got.groupBy("table_id", "operator").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nl_question", "sql_query").alias("k"), F.count_if(strange).alias("strange"))
    return by.select("table_id", "operator", (F.col("n") > 0).alias("some"), (F.col("n") - F.col("k")).alias("repeated"), "strange")


@query("template_catalogue", "SELECT CAST(28 AS BIGINT) AS n, CAST(4 AS BIGINT) AS expressions, CAST(4 AS BIGINT) AS without_lookup")
def template_catalogue(spark, d):
    df = templates.to_frame(spark, templates.standard())
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("expression").alias("expressions"), F.sum((~F.array_contains("operators", "noop")).cast("long")).alias("without_lookup"))


@query("hierarchical_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def hierarchical_roundtrip(spark, d):
    return assign.flattened(assign.hierarchical(table(spark, d, "conversations"), "conv_id", "turn"), "conv_id")


@query("question_index", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS question_number, turn FROM conversations")
def question_index(spark, d):
    return assign.question_index(assign.hierarchical(table(spark, d, "conversations"), "conv_id", "turn"), "turn", "conv_id")


_CORPUS_Q = [
    # qid, table, op, shape, aggregate columns, condition column, comparator, value
    (1, "customer", "max", "single", 3, None, 4, "=", "BUILDING"),
    (2, "customer", "count", "single", 3, None, 2, "<", "10"),
    (3, "customer", "avg", "difference", 3, 0, None, None, None),
    (4, "part", "min", "ratio", 5, 4, 4, ">=", "25"),
    (5, "part", "sum", "single", 4, None, 2, "!=", "Brand#11"),
    (6, "supplier", "sum", "single", 3, None, 3, ">", "0"),
    (7, "supplier", "count", "single", 0, None, 1, "=", "nobody"),
]
_Q_SCHEMA = "qid int, table_id string, op string, shape string, agg_idx int, agg_idx2 int, cond_idx int, cmp string, val string"


def _rows(spark, d) -> DataFrame:
    cells = _cells(spark, d).groupBy(F.col("table").alias("table_id"), "row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "value"))).alias("c"))
    return cells.select("table_id", "row_id", F.transform("c", lambda x: x["value"]).alias("cells"))


@query(
    "answer_corpus",
    """SELECT 1 AS qid, round(max(c_acctbal), 4) AS number, count(*) AS n_rows FROM customer WHERE c_mktsegment = 'BUILDING'
       UNION ALL SELECT 2, CAST(count(c_acctbal) AS DOUBLE), count(*) FROM customer WHERE c_nationkey < 10
       UNION ALL SELECT 3, round(avg(c_acctbal - c_custkey), 4), count(*) FROM customer
       UNION ALL SELECT 4, round(min(p_retailprice / NULLIF(p_size, 0)), 4), count(*) FROM part WHERE p_size >= 25
       UNION ALL SELECT 5, CAST(sum(p_size) AS DOUBLE), count(*) FROM part WHERE p_brand <> 'Brand#11'
       UNION ALL SELECT 6, round(sum(s_acctbal), 4), count(*) FROM supplier WHERE s_acctbal > 0
       UNION ALL SELECT 7, 0.0, 0""",
)
def answer_corpus(spark, d):
    out = Q.answer(_rows(spark, d), spark.createDataFrame(_CORPUS_Q, _Q_SCHEMA))
    return out.select("qid", F.round("number", 4).alias("number"), "n_rows")


@query("answer_coordinates", "SELECT 1 AS qid, string_agg(CAST(p_partkey AS VARCHAR) || ':5', ',' ORDER BY p_partkey) AS cells FROM part WHERE p_size = 7")
def answer_coordinates(spark, d):
    q = spark.createDataFrame([(1, "part", "max", "single", 5, None, 4, "=", "7")], _Q_SCHEMA)
    out = Q.coordinates(_rows(spark, d), q)
    return out.select("qid", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["row"], c["col"])), ",").alias("cells"))


def _by_customer(spark, d) -> DataFrame:
    """A question for each customer of `orders`, answered over all its rows."""
    orders = table(spark, d, "orders")
    rows = orders.select(F.lit("orders").alias("table_id"), F.col("o_orderkey").alias("row_id"), F.array(F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string")).alias("cells"))
    asked = orders.select(F.col("o_custkey").cast("int").alias("qid")).distinct()
    text, number = (lambda v, k: F.lit(v).alias(k)), (lambda v, k: F.lit(v).cast("int").alias(k))
    q = asked.select("qid", text("orders", "table_id"), text("noop", "op"), text("single", "shape"), number(1, "agg_idx"), number(None, "agg_idx2"), number(0, "cond_idx"), text("=", "cmp"), F.col("qid").cast("string").alias("val"))
    return Q.answer(rows, q)


@query("multi_row_flag", "SELECT CAST(o_custkey AS INTEGER) AS qid, CAST(count(*) AS BIGINT) AS n_rows, count(*) > 1 AS multi_row FROM orders GROUP BY 1")
def multi_row_flag(spark, d):
    return _by_customer(spark, d).select("qid", "n_rows", "multi_row")


@query("alternative_answers", "SELECT CAST(o_custkey AS INTEGER) AS qid, CAST(count(*) - 1 AS INTEGER) AS n_alternatives, round(arg_min(o_totalprice, o_orderkey), 2) AS first_answer FROM orders GROUP BY 1")
def alternative_answers(spark, d):
    return _by_customer(spark, d).select("qid", F.size("alternatives").alias("n_alternatives"), F.round(F.col("answer").cast("double"), 2).alias("first_answer"))


# --- joins, set operations, sampling ---


@query("question_table_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def question_table_join(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("count_join", "SELECT l_orderkey AS table_id, l_linenumber, n AS n_rows FROM lineitem JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = l_orderkey")
def count_join(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), "l_linenumber", F.lit("t").alias("template_hash"), F.lit("c").alias("count_hash"))
    counts = li.groupBy("table_id", "template_hash", "count_hash").agg(F.count(F.lit(1)).cast("string").alias("answer"))
    return P.with_counts(li, counts).select("table_id", "l_linenumber", "n_rows")


@query("predictions_join", "SELECT c_custkey AS question_id, count(o_orderkey) > 0 AS matched FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def predictions_join(spark, d):
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("question_id")).distinct()
    return P.joined_predictions(table(spark, d, "customer").select(F.col("c_custkey").alias("question_id")), q)


@query("tolerant_union", "SELECT r_regionkey AS key, r_name AS name, CAST(-1 AS INTEGER) AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tolerant_union(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return S.tolerant_union(r, n)


@query("dedup_questions", "SELECT DISTINCT role, text FROM conversations")
def dedup_questions(spark, d):
    return S.distinct_questions(table(spark, d, "conversations").select("role", "text"), ("role", "text"))


@query("qa_pair_dedup", "SELECT conv_id, CAST(count(DISTINCT (role, text)) AS INTEGER) AS pairs FROM conversations GROUP BY 1")
def qa_pair_dedup(spark, d):
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("p"))
    return by.select("conv_id", F.size(S.distinct_pairs(F.transform("p", lambda x: x["role"]), F.transform("p", lambda x: x["text"]))).alias("pairs"))


@query("set_difference", "SELECT n_nationkey, s_suppkey AS row_id FROM nation JOIN supplier ON s_nationkey <> n_nationkey")
def set_difference(spark, d):
    """Rows of the supplier table that are not of a nation, from those that are."""
    suppliers = table(spark, d, "supplier")
    own = suppliers.groupBy("s_nationkey").agg(F.collect_list(F.col("s_suppkey").cast("int")).alias("rows"))
    by = table(spark, d, "nation").join(own, F.col("s_nationkey") == F.col("n_nationkey"), "left").crossJoin(suppliers.agg(F.count(F.lit(1)).alias("n")))  # one row
    rest = Q.complement(F.coalesce("rows", F.array().cast("array<int>")), F.col("n"))
    return by.select("n_nationkey", F.explode(F.transform(rest, lambda x: x.cast("long"))).alias("row_id"))


@query("cutoff_per_table", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 3")
def cutoff_per_table(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    return S.top_per_group(e, ["user_id"], 3, "event_id")


@query("equal_cutoff", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= (SELECT greatest(1000 // count(DISTINCT user_id), 1) FROM events)")
def equal_cutoff(spark, d):
    return S.equal_cutoff(table(spark, d, "events").select("event_id", "user_id"), 1000, "user_id", ["event_id"])


@query("tolerance_per_group", "SELECT event_id FROM (SELECT *, value < 20 AS b, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id, value < 20 ORDER BY event_id) AS r FROM events) WHERE NOT b OR r <= floor(n * 0.1)")
def tolerance_per_group(spark, d):
    return S.tolerance_per_group(table(spark, d, "events").select("event_id", "user_id", "value"), F.col("value") < 20, 0.1, "user_id", ["event_id"]).select("event_id")


@query("percentile_values", "SELECT event_type, round(quantile_cont(value, 0.0), 4) AS p0, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 1.0), 4) AS p100 FROM events GROUP BY 1")
def percentile_values(spark, d):
    v = S.percentiles(table(spark, d, "events"), ["event_type"], "value")
    return v.select("event_type", F.round(F.col("values")[0], 4).alias("p0"), F.round(F.col("values")[5], 4).alias("p50"), F.round(F.col("values")[10], 4).alias("p100"))


@query("interpolated_values", "SELECT event_type, round(lo + (hi - lo) * (i / 4.0), 4) AS v FROM (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), range(5) t(i)")
def interpolated_values(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.select("event_type", F.explode(S.interpolated(F.col("lo"), F.col("hi"), 5)).alias("v")).withColumn("v", F.round("v", 4))


@query(
    "sampled_values",
    f"""{_CELLS} SELECT "table", name, round(lo + (hi - lo) * 0.25, 4) AS quarter, round(lo, 4) AS lo, round(hi, 4) AS hi, CAST(10 AS INTEGER) AS n, CAST(5 AS INTEGER) AS known
        FROM (SELECT "table", name, min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi FROM cells WHERE name IN ('c_acctbal', 'p_size') GROUP BY 1, 2)""",
)
def sampled_values(spark, d):
    """Half evenly spaced, half drawn by hashes: these are held against the column's values."""
    cells = _cells(spark, d).where(F.col("name").isin("c_acctbal", "p_size")).withColumn("number", T.to_number(F.col("value")))
    got = S.sampled_values(cells, 10, "mix")
    at = lambda i: F.round(F.col("values")[i].cast("double"), 4)
    drawn = got.select("table", "name", F.explode(F.slice("values", 6, 5)).alias("value")).join(cells.select("table", "name", "value").distinct(), ["table", "name", "value"])
    known = drawn.groupBy("table", "name").agg(F.count(F.lit(1)).cast("int").alias("known"))
    return got.join(known, ["table", "name"]).select("table", "name", at(1).alias("quarter"), at(0).alias("lo"), at(4).alias("hi"), F.size("values").alias("n"), "known")


@query("split_ranges", "SELECT doc_id, CASE WHEN r <= 100 THEN 'dev' WHEN r <= 200 THEN 'test' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 600")
def split_ranges(spark, d):
    return S.split_by_rank(table(spark, d, "documents").select("doc_id"), {"dev": 100, "test": 100, "train": 400}, F.sha2(F.col("doc_id").cast("string"), 256)).select("doc_id", "split")


@query("strided_rows", "SELECT event_id FROM events WHERE event_id % 4 = 1")
def strided_rows(spark, d):
    return S.strided(table(spark, d, "events").select("event_id"), "event_id", 1, 4)


@query("file_splits", "SELECT n_regionkey AS topic, split, CAST(floor(count(*) * w + 1e-9) AS BIGINT) AS n FROM nation, (VALUES ('train', 0.6), ('validation', 0.2), ('test', 0.2)) s(split, w) GROUP BY 1, 2, w")
def file_splits(spark, d):
    """Five files a topic: shares are whole numbers."""
    files = table(spark, d, "nation").select(F.col("n_regionkey").alias("topic"), F.col("n_name").alias("path"))
    return S.file_splits(files, {"train": 0.6, "validation": 0.2, "test": 0.2}).groupBy("topic", "split").agg(F.count(F.lit(1)).alias("n"))


# --- quality ---


@query("invalid_answer_filter", "SELECT event_id FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'NaN' WHEN 2 THEN 'None' WHEN 3 THEN 'n/a' ELSE event_type END AS a FROM events) WHERE lower(a) NOT IN ('', '''''', 'none', 'nan', 'n/a')")
def invalid_answer_filter(spark, d):
    m = F.col("event_id") % 6
    a = F.when(m == 0, "").when(m == 1, "NaN").when(m == 2, "None").when(m == 3, "n/a").otherwise(F.col("event_type"))
    return Q.valid_answers(table(spark, d, "events").select("event_id", a.alias("answer"))).select("event_id")


@query("low_agg_filter", "SELECT user_id, event_type, count(*) AS n_rows FROM events WHERE value > 60 GROUP BY 1, 2 HAVING count(*) >= 3")
def low_agg_filter(spark, d):
    per = table(spark, d, "events").where("value > 60").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n_rows"))
    return per.where(~Q.few_rows(F.lit("sum"), F.col("n_rows"), 3))


@query("multi_answer_filter", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def multi_answer_filter(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return Q.single_answers(per.withColumn("multi_row", Q.inferred_multi(F.lit("noop"), F.col("n")))).select("o_custkey")


@query("empty_comparison_filter", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def empty_comparison_filter(spark, d):
    sql = F.when(F.col("event_id") % 3 == 0, "SELECT sum(\"a\") FROM df WHERE true AND \"b\" >= ''").otherwise("SELECT sum(\"a\") FROM df WHERE true AND \"b\" = ''")
    return Q.comparable_conditions(table(spark, d, "events").select("event_id", sql.alias("sql_query"))).select("event_id")


@query("value_in_column", "SELECT c_mktsegment AS value FROM (SELECT DISTINCT c_mktsegment FROM customer) WHERE c_mktsegment IN ('BUILDING', 'nothing')")
def value_in_column(spark, d):
    cells = N.unpivot(table(spark, d, "customer"), "customer", "c_custkey")
    wanted = spark.createDataFrame([("customer", "c_mktsegment", v) for v in ("BUILDING", "nothing")], "table string, name string, value string")
    return Q.value_occurs(wanted, cells).select("value")


# --- metrics ---

_PAIRS = "(SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 5 = 0 THEN 'x' WHEN event_id % 3 = 0 THEN CAST(event_id + 1 AS VARCHAR) ELSE CAST(event_id AS VARCHAR) END AS prediction, CAST(event_id AS VARCHAR) AS answer FROM events)"


def _pairs(spark, d) -> DataFrame:
    i = F.col("event_id")
    p = F.when(i % 5 == 0, "x").when(i % 3 == 0, (i + 1).cast("string")).otherwise(i.cast("string"))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", p.alias("prediction"), i.cast("string").alias("answer"))


@query("str_match", f"SELECT avg(CAST(prediction = answer AS INTEGER)) AS exact_match FROM {_PAIRS}")
def str_match(spark, d):
    return _pairs(spark, d).agg(F.avg(M.exact_match(F.col("prediction"), F.col("answer")).cast("int")).alias("exact_match"))


@query("float_match", f"SELECT avg(CAST(coalesce(abs(TRY_CAST(prediction AS DOUBLE) - TRY_CAST(answer AS DOUBLE)) <= 1e-7, false) AS INTEGER)) AS float_match FROM {_PAIRS}")
def float_match(spark, d):
    return _pairs(spark, d).agg(F.avg(M.float_match(F.col("prediction"), F.col("answer")).cast("int")).alias("float_match"))


@query("abs_distance", f"SELECT event_type, round(avg(coalesce(least(10.0, abs(TRY_CAST(prediction AS DOUBLE) - CAST(answer AS DOUBLE)) / (abs(CAST(answer AS DOUBLE)) + 1e-7)), 10.0)), 6) AS distance FROM {_PAIRS} GROUP BY 1")
def abs_distance(spark, d):
    return _pairs(spark, d).groupBy("event_type").agg(F.round(F.avg(M.distance(F.col("prediction"), F.col("answer"))), 6).alias("distance"))


@query("upper_median", "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY 1")
def upper_median(spark, d):
    return M.exact_upper_median(table(spark, d, "events"), ["event_type"], "value")


@query("upper_median_narrowed", "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY 1")
def upper_median_narrowed(spark, d):
    """The same by narrowing ranges, as groups of any size are."""
    return M.exact_upper_median(table(spark, d, "events"), ["event_type"], "value", most_rows=500)


@query("grouped_mean_count", "SELECT user_id, event_type, round(avg(value), 6) AS value_mean, count(value) AS value_count FROM events WHERE event_type <> 'click' GROUP BY 1, 2")
def grouped_mean_count(spark, d):
    return _rounded(P.grouped(table(spark, d, "events"), ["user_id", "event_type"], ["value"], {"event_type": F.col("event_type") != "click"}), "value_mean", 6)


_EDGES = [0.0, 10000.0, 30000.0, 60000.0]


@query("bins_explicit", "SELECT b AS bin, count(*) AS n FROM (SELECT list_max(list_filter([0.0::DOUBLE, 10000.0, 30000.0, 60000.0], lambda e: e <= l_extendedprice)) AS b FROM lineitem) GROUP BY 1")
def bins_explicit(spark, d):
    return P.value_counts(P.binned(table(spark, d, "lineitem"), "l_extendedprice", _EDGES), "bin")


@query("bins_equal_step", "SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 7)), 6) AS BIGINT) AS bin_no, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY 1")
def bins_equal_step(spark, d):
    li = table(spark, d, "lineitem")
    edges = P.equal_step_edges(li, "l_quantity", 7)
    return P.binned(li, "l_quantity", edges).select((F.array_position(F.array(*map(F.lit, edges)), F.col("bin")) - 1).alias("bin_no")).groupBy("bin_no").agg(F.count(F.lit(1)).alias("n"))


@query("bins_equal_count", "SELECT (SELECT max(e) FROM (SELECT unnest(quantile_cont(l_quantity, [0.0, 0.25, 0.5, 0.75])) AS e FROM lineitem) WHERE e <= q) AS bin, CAST(sum(c) AS BIGINT) AS n FROM (SELECT l_quantity AS q, count(*) AS c FROM lineitem GROUP BY 1) GROUP BY 1")
def bins_equal_count(spark, d):
    li = table(spark, d, "lineitem")
    return P.value_counts(P.binned(li, "l_quantity", P.equal_count_edges(li, "l_quantity", 4)), "bin")


@query("nearest_bin", "SELECT (SELECT arg_min(b, abs(value - b)) FROM (VALUES (0.0::DOUBLE), (25.0), (50.0), (75.0), (100.0)) t(b)) AS bin, count(*) AS n FROM events GROUP BY 1")
def nearest_bin(spark, d):
    return P.value_counts(table(spark, d, "events").select(P.nearest_bin(F.col("value"), [0.0, 25.0, 50.0, 75.0, 100.0]).alias("bin")), "bin")


@query("histogram", "SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE CAST(floor(value / 10) AS BIGINT) + 1 END AS bucket, count(*) AS n FROM events GROUP BY 1")
def histogram(spark, d):
    return P.histogram(table(spark, d, "events"), "value", 0, 100, 10)


@query("aggregator_hist_stats", "SELECT aggregator, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean_per_table, round(stddev_pop(n), 6) AS std_per_table FROM (SELECT user_id, a AS aggregator, count(*) FILTER (event_type = a) AS n FROM events, (VALUES ('click'), ('view'), ('purchase')) t(a) GROUP BY 1, 2) GROUP BY 1")
def aggregator_hist_stats(spark, d):
    out = P.aggregator_statistics(table(spark, d, "events"), ["click", "view", "purchase"], "user_id", "event_type")
    return _rounded(_rounded(out, "mean_per_table", 6), "std_per_table", 6)


@query("table_stats", "SELECT user_id, round(avg(value), 6) AS mean, CASE WHEN count(value) > 2 THEN round(stddev_samp(value), 6) END AS std, round(median(value), 6) AS median, count(value) AS n FROM events GROUP BY 1")
def table_stats(spark, d):
    out = P.table_statistics(table(spark, d, "events"), "user_id", "value")
    for c in ("mean", "std", "median"):
        out = _rounded(out, c, 6)
    return out


@query("statistics_of_statistics", "SELECT round(avg(m), 6) AS mean_mean, round(stddev_samp(m), 6) AS std_mean, round(median(m), 6) AS median_mean FROM (SELECT avg(value) AS m FROM events GROUP BY user_id)")
def statistics_of_statistics(spark, d):
    out = P.statistics_of_statistics(P.table_statistics(table(spark, d, "events"), "user_id", "value"), ["mean"])
    for c in ("mean_mean", "std_mean", "median_mean"):
        out = _rounded(out, c, 6)
    return out


@query("dataset_stats", "SELECT CAST(sum(q) AS BIGINT) AS n_questions, count(*) AS n_tables, round(avg(q), 6) AS mean_questions, min(q) AS min_questions, max(q) AS max_questions, round(sum(s) / sum(q), 6) AS mean_rows, min(lo) AS min_rows, max(hi) AS max_rows FROM (SELECT o_custkey, count(*) AS q, sum(o_orderkey % 97) AS s, min(o_orderkey % 97) AS lo, max(o_orderkey % 97) AS hi FROM orders GROUP BY 1)")
def dataset_stats(spark, d):
    out = P.dataset_statistics(table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), (F.col("o_orderkey") % 97).alias("n_rows")))
    return _rounded(_rounded(out, "mean_questions", 6), "mean_rows", 6)


@query("correct_by_property", f"SELECT event_type, CAST(sum(CAST(prediction = answer AS INTEGER)) AS BIGINT) AS correct, count(*) AS n FROM {_PAIRS} GROUP BY 1")
def correct_by_property(spark, d):
    return P.correct_by(M.with_metrics(_pairs(spark, d)), ["event_type"], "exact_match")


@query("stderr_mean", "SELECT event_type, round(stddev_samp(value) / sqrt(count(value)), 6) AS stderr FROM events GROUP BY 1")
def stderr_mean(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(M.mean_stderr(F.col("value")), 6).alias("stderr"))


_TASKS = "(SELECT user_id, event_type, avg(value) AS metric, stddev_samp(value) / sqrt(count(value)) AS stderr, count(value) AS n FROM events GROUP BY 1, 2 HAVING count(value) > 1)"


@query("group_rollup", f"SELECT event_type, round(sum(metric * n) / sum(n), 6) AS metric, round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) AS stderr, CAST(sum(n) AS BIGINT) AS n FROM {_TASKS} GROUP BY 1")
def group_rollup(spark, d):
    tasks = M.by_task(table(spark, d, "events"), ["user_id", "event_type"], "value").where("n > 1")
    return _rounded(_rounded(M.roll_up(tasks, ["event_type"]), "metric", 6), "stderr", 6)


_LABELS = "(SELECT toxic AS t, CAST(doc_id % 3 = 0 OR toxic = 1 AND doc_id % 2 = 0 AS INTEGER) AS p FROM labels)"


def _labels(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "labels").select(F.col("toxic").alias("t"), ((i % 3 == 0) | ((F.col("toxic") == 1) & (i % 2 == 0))).cast("int").alias("p"))


_CONF = f"(SELECT sum(p * t)::DOUBLE AS tp, sum(p * (1 - t))::DOUBLE AS fp, sum((1 - p) * t)::DOUBLE AS fn, sum((1 - p) * (1 - t))::DOUBLE AS tn FROM {_LABELS})"


@query("f1_mcc", f"SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM {_CONF}")
def f1_mcc(spark, d):
    p, t = F.col("p"), F.col("t")
    return _labels(spark, d).agg(F.round(M.f1(p, t), 6).alias("f1"), F.round(M.matthews(p, t), 6).alias("mcc"))


@query("brier", "SELECT round(avg(power(0.7 - (1 - toxic), 2) + power(0.3 - toxic, 2)), 6) AS brier FROM labels")
def brier(spark, d):
    return table(spark, d, "labels").agg(F.round(M.brier(F.array(F.lit(0.7), F.lit(0.3)), F.col("toxic")), 6).alias("brier"))


@query("perplexities", "SELECT round(exp(sum(n_chars) / 10.0 / sum(length(string_split_regex(text, '\\s+')) * 100)), 6) AS word_perplexity, round(exp(sum(n_chars) / 10.0 / sum(strlen(text))), 6) AS byte_perplexity, round(sum(n_chars) / 10.0 / sum(strlen(text)) / ln(2.0), 6) AS bits_per_byte FROM documents".replace(" * 100", ""))
def perplexities(spark, d):
    out = M.rolling_scores(table(spark, d, "documents").withColumn("lp", -F.col("n_chars") / 10), "text", "lp")
    for c in out.columns:
        out = _rounded(out, c, 6)
    return out


@query("all_correct", "SELECT avg(CAST(ok AS INTEGER)) AS acc_all FROM (SELECT user_id, bool_and(value > 1) AS ok FROM events GROUP BY 1)")
def all_correct(spark, d):
    return M.all_correct(table(spark, d, "events").withColumn("c", (F.col("value") > 1).cast("int")), ["user_id"], "c")


def _text_scores_sql() -> str:
    """BLEU of four orders and chrF of six, counted by value."""
    counted = lambda name, of, n, length, gram: f"""{name}{n} AS (SELECT coalesce(sum(least(p, r)), 0) AS m, coalesce(sum(p), 0) AS p, coalesce(sum(r), 0) AS r FROM (
        SELECT id, g, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM (
            SELECT id, side, {gram} AS g FROM (SELECT *, unnest(range(1, {length} - {n} + 2)) AS i FROM {of})) GROUP BY id, g))"""  # noqa: E731
    bleu = [counted("w", "words", n, "len(w)", f"array_to_string(list_slice(w, i, i + {n} - 1), ' ')") for n in range(1, 5)]
    chars = [counted("c", "chars", n, "length(t)", f"substr(t, i, {n})") for n in range(1, 7)]
    precision = " + ".join(f"(SELECT ln(100.0 * m / p) FROM w{n})" for n in range(1, 5))
    mean = lambda side: " + ".join(f"(SELECT m / {side} FROM c{n})" for n in range(1, 7))
    return f"""WITH texts AS (SELECT item_id AS id, 'p' AS side, replace(text, 'e', 'a ') AS t FROM benchmark UNION ALL SELECT item_id, 'r', text FROM benchmark),
        words AS (SELECT id, side, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w FROM texts), chars AS (SELECT id, side, regexp_replace(t, '\\s+', '', 'g') AS t FROM texts),
        {', '.join(bleu + chars)}, size AS (SELECT sum(len(w)) FILTER (side = 'p') AS p, sum(len(w)) FILTER (side = 'r') AS r FROM words), f AS (SELECT ({mean('p')}) / 6 AS p, ({mean('r')}) / 6 AS r)
        SELECT round((SELECT CASE WHEN p < r THEN exp(1 - r / p) ELSE 1 END FROM size) * exp(({precision}) / 4), 6) AS bleu, (SELECT round(100 * 5 * p * r / (4 * p + r), 6) FROM f) AS chrf"""


@query("text_scores", _text_scores_sql())
def text_scores(spark, d):
    """Texts with letters changed and words cut, against the texts."""
    b = table(spark, d, "benchmark").select(F.replace("text", F.lit("e"), F.lit("a ")).alias("said"), "text")
    return M.bleu(b, "said", "text").select(F.round("bleu", 6).alias("bleu")).crossJoin(M.chrf(b, "said", "text").select(F.round("chrf", 6).alias("chrf")))  # one row each


@query(
    "edit_rate",
    """SELECT round(100.0 * sum(CASE WHEN n < 2 OR len(list_distinct(w)) = 1 THEN 0 WHEN n <= 51 THEN 1 ELSE 2 END) / sum(n), 6) AS ter
       FROM (SELECT w, len(w) AS n FROM (SELECT list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations))""",
)
def edit_rate(spark, d):
    """Texts with their first word at the end: a move of 50 places at most is one edit, a longer one two."""
    w = T.words(F.col("text"))
    turned = F.concat_ws(" ", F.concat(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), F.slice(w, 1, 1)))
    return M.translation_edit_rate(table(spark, d, "conversations").select(turned.alias("said"), "text"), "said", "text").select(F.round("ter", 6).alias("ter"))


@query(
    "resampled_scores",
    """WITH c AS (SELECT sum((quality = 1 AND toxic = 1)::INT)::DOUBLE AS tp, sum((quality = 1 AND toxic = 0)::INT)::DOUBLE AS fp, sum((quality = 0 AND toxic = 1)::INT)::DOUBLE AS fn, sum((quality = 0 AND toxic = 0)::INT)::DOUBLE AS tn FROM labels)
       SELECT 'f1' AS metric, round(2 * tp / (2 * tp + fp + fn), 8) AS value, TRUE AS near FROM c
       UNION ALL SELECT 'mcc', round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 8), TRUE FROM c""",
)
def resampled_scores(spark, d):
    """f1 and mcc of a guess, with standard errors of 300 resamples within a quarter of those of linear propagation."""
    rows = table(spark, d, "labels")
    c = M.confusion_counts(rows, "quality", "toxic").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    whole = 2 * tp + fp + fn
    mcc = M.matthews_of_counts()
    # slopes of mcc: its logarithm's derivatives in each count
    num, parts = tp * tn - fp * fn, {"tp": tn, "tn": tp, "fp": -fn, "fn": -fp}
    sums = {"tp": (tp + fp, tp + fn), "fp": (tp + fp, tn + fp), "fn": (tp + fn, tn + fn), "tn": (tn + fp, tn + fn)}
    slope = {k: mcc * (parts[k] / num - 0.5 * (1 / sums[k][0] + 1 / sums[k][1])) for k in parts}
    plain = c.select(F.sqrt(tp * (2 * (fp + fn) / whole**2) ** 2 + (fp + fn) * (2 * tp / whole**2) ** 2).alias("f1"), F.sqrt(sum((F.col(k) * v * v for k, v in slope.items()), F.lit(0.0))).alias("mcc"))
    out = []
    for metric in ("f1", "mcc"):
        got = M.metric_stderr(rows, metric, "quality", "toxic", "doc_id", iterations=300).crossJoin(plain)  # one row each
        out.append(got.select(F.lit(metric).alias("metric"), F.round("value", 8).alias("value"), (F.abs(F.col("stderr") / F.col(metric) - 1) < 0.25).alias("near")))
    return out[0].unionByName(out[1])


@query("poisson_bootstrap", "SELECT count(*) AS n, round(stddev_samp(toxic) / sqrt(count(*)), 8) AS plain, TRUE AS near FROM labels")
def poisson_bootstrap(spark, d):
    """Resampled 200 times, the standard error of the mean is within a quarter of what the formula gives."""
    rows = table(spark, d, "labels")
    plain = rows.agg(F.count("toxic").alias("n"), F.round(M.mean_stderr(F.col("toxic")), 8).alias("plain"))
    both = plain.crossJoin(M.poisson_bootstrap(rows, "toxic", "doc_id", 200))  # one row each
    return both.select("n", "plain", (F.abs(F.col("stderr") / F.col("plain") - 1) < 0.25).alias("near"))


# --- responses ---


@query("majority_vote", "SELECT conv_id, arg_min(role, -1000000 * n + first) AS role FROM (SELECT conv_id, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def majority_vote(spark, d):
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return by.select("conv_id", R.majority_vote()(F.transform("t", lambda x: x["role"]))[0].alias("role"))


@query("take_first_k", "SELECT conv_id, array_to_string(list(role ORDER BY turn)[1:2], ',') AS roles FROM conversations GROUP BY 1")
def take_first_k(spark, d):
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return by.select("conv_id", F.array_join(R.take_first_k(2)(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


@query("regex_filter", r"SELECT event_id, CASE WHEN regexp_matches(props, '\d+') THEN regexp_extract(props, '(\d+)', 1) ELSE '[invalid]' END AS found FROM events")
def regex_filter(spark, d):
    return table(spark, d, "events").select("event_id", R.regex(r"(\d+)")(F.array("props"))[0].alias("found"))


@query("case_filters", "SELECT event_id, lower(event_type) AS low, upper(event_type) AS up FROM events")
def case_filters(spark, d):
    a = F.array("event_type")
    return table(spark, d, "events").select("event_id", R.lowercase()(a)[0].alias("low"), R.uppercase()(a)[0].alias("up"))


@query("map_filter", "SELECT event_id, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'none' END AS mapped FROM events")
def map_filter(spark, d):
    return table(spark, d, "events").select("event_id", R.mapped({"click": "A", "view": "B"}, "none")(F.array("event_type"))[0].alias("mapped"))


_PUNCTUATION = T.PUNCTUATION.replace("'", "''")


@query("exact_match_ignoring", rf"SELECT doc_id, sha256(translate(lower(regexp_replace(text, '[^\x00-\x7f]', '', 'g')), '{_PUNCTUATION}0123456789', '')) AS form FROM documents")
def exact_match_ignoring(spark, d):
    form = R.exact_form(F.col("text"), [r"[^\x00-\x7f]"], True, True, True)
    return table(spark, d, "documents").select("doc_id", F.sha2(form, 256).alias("form"))


@query(
    "choice_filter",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS VARCHAR) WHEN event_type = 'view' THEN '(A)' WHEN event_type = 'click' THEN '(B)' WHEN event_id % 2 = 0 THEN '(B)' ELSE '[invalid]' END AS choice FROM events""",
)
def choice_filter(spark, d):
    ship(spark)
    tail = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("\n#### "), F.col("event_id").cast("string"))).when(F.col("event_id") % 2 == 0, ": B").otherwise(" (Z)")
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("I think of "), "event_type", tail).alias("response"), F.array(F.lit("view"), F.lit("click")).alias("choices"))
    return R.choice_filter(e).select("event_id", "choice")


@query("aggregator_words", "SELECT o_orderkey, ['max', 'max', 'min', 'avg', 'sum', 'unknown', 'unknown', 'noop'][CAST(o_orderkey % 8 AS INTEGER) + 1] AS aggregator FROM orders")
def aggregator_words(spark, d):
    words = F.array(*map(F.lit, ("maximum", "greatest", "smallest", "mean", "sum", "total", "median", "value")))
    return table(spark, d, "orders").select("o_orderkey", T.aggregator_of(F.get(words, (F.col("o_orderkey") % 8).cast("int"))).alias("aggregator"))


@query("question_classes", "SELECT p_partkey, ['single column', 'difference', 'ratio', 'expression'][CAST(p_partkey % 28 // 7 AS INTEGER) + 1] AS main, ['=', '!=', '<', '<=', '>', '>=', ''][CAST(p_partkey % 7 AS INTEGER) + 1] AS condition FROM part")
def question_classes(spark, d):
    """A question of one of the standard templates about each part."""
    q = F.get(F.array(*(F.lit(t.pattern) for t in templates.standard())), (F.col("p_partkey") % 28).cast("int"))
    for variable, c in {"op": F.lit("maximum"), "col1": F.col("p_brand"), "col2": F.col("p_name"), "condition_col": F.lit("size"), "condition_val": F.col("p_size").cast("string")}.items():
        q = F.replace(q, F.lit("{" + variable + "}"), c)
    return table(spark, d, "part").select("p_partkey", T.main_expression_class(q).alias("main"), T.condition_class(q).alias("condition"))


# --- texts ---


@query("clean_text", r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark, d):
    return C.cleaned(table(spark, d, "documents")).select("doc_id", F.sha2("text", 256).alias("cleaned"))


@query("word_byte_counts", r"SELECT doc_id, CAST(length(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n_words, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents")
def word_byte_counts(spark, d):
    w, b = C.token_counts(F.col("text"))
    return table(spark, d, "documents").select("doc_id", w.alias("n_words"), b.alias("n_bytes"))


@query("group_lines_to_docs", "SELECT conv_id, CAST(doc AS BIGINT) AS doc, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, coalesce(sum(CAST(turn % 3 = 2 AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS doc FROM conversations) WHERE turn % 3 <> 2 GROUP BY 1, 2")
def group_lines_to_docs(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "\n").otherwise(F.col("text")).alias("text"))
    return C.line_groups(lines, "text", "turn", "conv_id")


@query("chunk_words", r"SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(length(w[i * 128 + 1 : i * 128 + 128]) AS INTEGER) AS n_words, sha256(array_to_string(w[i * 128 + 1 : i * 128 + 128], ' ')) AS hash FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), LATERAL (SELECT unnest(range(0, (length(w) + 127) // 128)) AS i) t")
def chunk_words(spark, d):
    return C.chunks(table(spark, d, "documents"), 128).select("doc_id", "chunk", "n_words", F.sha2("text", 256).alias("hash"))


_GRAMS = (
    rf"(SELECT <k>, list_filter(string_split_regex(translate(text, '{T.UPPER}{_PUNCTUATION}', '{T.LOWER}'), '\s+'), lambda x: x <> '') AS w FROM <t>)"
)
_HITS = f"""(SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(list_transform(range(1, length(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS g FROM {_GRAMS.replace("<k>", "doc_id").replace("<t>", "documents")})
  JOIN (SELECT item_id, unnest(list_transform(range(1, length(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS g FROM {_GRAMS.replace("<k>", "item_id").replace("<t>", "benchmark")}) USING (g))"""


@query("hash_split_sizes", "SELECT CASE WHEN i <= 100 THEN 'dev' WHEN i <= 300 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM (SELECT row_number() OVER () AS i FROM documents) GROUP BY 1")
def hash_split_sizes(spark, d):
    return C.hash_split(table(spark, d, "documents").select("doc_id"), 100, 200).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("ngram_overlap_docs", f"SELECT doc_id, count(*) AS items FROM {_HITS} GROUP BY 1")
def ngram_overlap_docs(spark, d):
    return C.overlap(table(spark, d, "documents"), table(spark, d, "benchmark")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"))


@query("contaminant_index", f"SELECT doc_id, item_id FROM {_HITS}")
def contaminant_index(spark, d):
    """Items added in two parts to an index that stays; documents' n-grams are looked up in its bit map before they are shuffled."""
    from .work import new_path

    items = table(spark, d, "benchmark")
    index = C.ContaminantIndex(spark, new_path(spark, "contaminants"))
    for part in (0, 1):
        index.add(items.where(F.pmod("item_id", F.lit(2)) == part))
    return index.overlap(table(spark, d, "documents"))


@query("ngram_overlap_items", f"SELECT item_id, count(*) AS docs FROM {_HITS} GROUP BY 1")
def ngram_overlap_items(spark, d):
    return C.overlap(table(spark, d, "documents"), table(spark, d, "benchmark")).groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


_BENCHMARK_GRAMS = f"""(SELECT DISTINCT unnest(list_transform(range(1, length(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS g FROM {_GRAMS.replace("<k>", "item_id").replace("<t>", "benchmark")})"""


@query(
    "decontam_hits",
    f"""SELECT doc_id, count(item) AS hits FROM documents LEFT JOIN (SELECT doc_id, g AS item FROM (SELECT doc_id, unnest(list_transform(range(1, length(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS g
        FROM {_GRAMS.replace("<k>", "doc_id").replace("<t>", "documents")}) JOIN {_BENCHMARK_GRAMS} USING (g)) USING (doc_id) GROUP BY 1""",
)
def decontam_hits(spark, d):
    return C.hit_counts(table(spark, d, "documents"), table(spark, d, "benchmark"))


_WORD_ENDS = r"""(SELECT doc_id, lead(stop, 12) OVER (PARTITION BY doc_id ORDER BY k) AS stop, stop - length(ltrim(piece, e' \t\n\r\f\v')) AS start, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM (
    SELECT doc_id, k, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\s*\S+')) AS piece, generate_subscripts(regexp_extract_all(text, '\s*\S+'), 1) AS k FROM documents))
    WHERE regexp_matches(piece, '[^\s!-/:-@\[-`{-~]'))"""


@query(
    "decontam_clean",
    f"""WITH ends AS MATERIALIZED {_WORD_ENDS}, hits AS MATERIALIZED (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(list_transform(range(1, length(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) AS g, unnest(range(1, length(w) - 11)) AS i
            FROM {_GRAMS.replace("<k>", "doc_id").replace("<t>", "documents")}) JOIN {_BENCHMARK_GRAMS} USING (g)),
        counted AS (SELECT d.doc_id, d.text, length(d.text) AS size, count(i) AS hits FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY ALL),
        spans AS (SELECT doc_id, text, size, counted.hits, start, stop, lag(stop) OVER (PARTITION BY doc_id ORDER BY start) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC) AS back
            FROM hits JOIN ends USING (doc_id, i) JOIN counted USING (doc_id)),
        ranges AS (SELECT doc_id, text, hits, CASE WHEN before IS NULL THEN 0 ELSE least(size, before + 200) END AS a, start - 200 AS z FROM spans WHERE start - 200 - CASE WHEN before IS NULL THEN 0 ELSE least(size, before + 200) END > 200
            UNION ALL SELECT doc_id, text, hits, least(size, stop + 200) + 1, size FROM spans WHERE back = 1 AND size - least(size, stop + 200) - 1 >= 200
            UNION ALL SELECT doc_id, text, hits, 0, size FROM counted WHERE hits = 0 AND size >= 200)
        SELECT doc_id, hits, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS part, substr(text, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT)) AS text FROM ranges WHERE hits <= 10""",
)
def decontam_clean(spark, d):
    return C.decontaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


_WORD_NUMBER = r"(SELECT doc_id, length(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents)"


@query("rolling_windows", f"SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(0, ceil((n - 512) / 385)) END AS INTEGER) AS windows, CAST(n AS INTEGER) AS predicted, CAST(least(n, 512) AS INTEGER) AS longest FROM {_WORD_NUMBER}")
def rolling_windows(spark, d):
    w = table(spark, d, "documents").select("doc_id", T.rolling_windows(T.words(F.col("text")), 512, "<s>", 128).alias("w"))
    sizes = lambda f: F.transform("w", lambda x: F.size(x[f]))
    return w.select("doc_id", F.size("w").alias("windows"), F.aggregate(sizes("predict"), F.lit(0), lambda a, b: a + b).alias("predicted"), F.coalesce(F.array_max(sizes("read")), F.lit(0)).alias("longest"))


@query("disjoint_windows", f"SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 512 THEN 1 ELSE 1 + floor((n - 512) / 385) * 128 + CASE WHEN (n - 512) % 385 > 0 THEN 513 - (n - 512) % 385 ELSE 0 END END AS INTEGER) AS kept FROM {_WORD_NUMBER}")
def disjoint_windows(spark, d):
    w = table(spark, d, "documents").select("doc_id", T.disjoint_windows(T.rolling_windows(T.words(F.col("text")), 512, "<s>", 128)).alias("w"))
    return w.select("doc_id", F.aggregate(F.transform("w", lambda x: F.size(x["read"])), F.lit(0), lambda a, b: a + b).alias("kept"))


@query("detokenised", """SELECT doc_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(text, ' n''t', 'n''t'), ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'), ' ''', ''''), ' .', '.'), ' ,', ',')) AS form FROM documents""")
def detokenised(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.detokenise(F.col("text")), 256).alias("form"))


@query("quoted_columns", """SELECT p_partkey, 'What is the maximum of column "' || p_brand || '" given that column "' || p_type || '" has a value equal to 3?' AS one, 'What is column "' || p_brand || '"?' AS two FROM part""")
def quoted_columns(spark, d):
    names, q = F.array("p_brand", "p_type"), lambda *x: F.concat(*(F.col(y) if y.startswith("p_") else F.lit(y) for y in x))
    one, two = q("What is the maximum of column '", "p_brand", "' given that column ", "p_type", " has a value equal to 3?"), q("What is column ", "p_brand", "?")
    return table(spark, d, "part").select("p_partkey", T.quote_columns(one, names).alias("one"), T.quote_columns(two, names).alias("two"))


@query("name_structures", "SELECT s_suppkey, 'tT#d' || length(split_part(s_name, '#', 2)) || CASE WHEN s_suppkey % 2 = 0 THEN '_t-T' ELSE '_alpha_num2' END AS code FROM supplier")
def name_structures(spark, d):
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, "_abc-XY.parquet").otherwise("_a1.parquet"))
    return table(spark, d, "supplier").select("s_suppkey", S.structure_code(name).alias("code"))


@query("header_rows", "SELECT s_suppkey, s_suppkey % 2 = 0 AS data FROM supplier")
def header_rows(spark, d):
    """Headers of even suppliers are numbers over numbers; those of odd ones are names."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    header = F.when(F.col("s_suppkey") % 2 == 0, F.array(key, F.lit("x"))).otherwise(F.array(F.lit("key"), F.lit("nation")))
    rows = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.array(nation, F.lit("y")), F.array(key, F.lit("z")))).otherwise(F.array(F.array(key, nation), F.array(nation, key)))
    return table(spark, d, "supplier").select("s_suppkey", N.header_is_data(header, rows).alias("data"))


@query("enclosed_texts", r"SELECT event_id, regexp_extract(props, '\{(.*)\}', 1) AS inner_text FROM events")
def enclosed_texts(spark, d):
    return table(spark, d, "events").select("event_id", T.between_markers(F.col("props"), "{", "}").alias("inner_text"))


@query("value_kinds", "SELECT o_orderkey, ['int', 'float', 'str', 'int', 'float', 'str'][CAST(o_orderkey % 6 AS INTEGER) + 1] AS kind FROM orders")
def value_kinds(spark, d):
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    text = F.get(F.array(key, price, F.col("o_orderpriority"), F.concat(F.lit(" -"), key, F.lit(" ")), F.concat(key, F.lit("e1")), F.concat(key, F.lit(" "), price)), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", T.value_kind(text).alias("kind"))


@query("control_characters", "SELECT doc_id, sha256(translate(text, chr(9) || chr(10) || chr(13), '')) AS form FROM documents")
def control_characters(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.strip_control(F.col("text")), 256).alias("form"))


@query("softmax_argmax", "SELECT l_orderkey, l_linenumber, round(exp(l_tax) / (exp(l_tax) + exp(l_discount)), 8) AS share, CAST(CASE WHEN l_tax >= l_discount THEN 0 ELSE 1 END AS INTEGER) AS best FROM lineitem")
def softmax_argmax(spark, d):
    x = F.array("l_tax", "l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.softmax(x)[0], 8).alias("share"), T.argmax(x).alias("best"))


@query("answered_questions", "SELECT event_id FROM events WHERE event_id % 4 = 3")
def answered_questions(spark, d):
    a = F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 == 2, "None").otherwise(F.col("event_type"))
    return Q.answered(table(spark, d, "events").select("event_id", a.alias("answer"))).select("event_id")


@query("short_values", "SELECT doc_id FROM documents WHERE length(text) <= 256 OR text IS NULL")
def short_values(spark, d):
    return Q.short_values(table(spark, d, "documents"), "text").select("doc_id")


@query("names_to_ids", f"""{_CELLS} SELECT DISTINCT "table", name, CAST(col_id AS INTEGER) AS col_id FROM cells""")
def names_to_ids(spark, d):
    heads = _cells(spark, d).select("table", "name", "col_id").distinct().groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "name"))), lambda x: x["name"]).alias("header"))
    return heads.select("table", F.explode(N.names_to_ids(F.col("header"))).alias("name", "col_id"))


@query("linearize_table", "SELECT 'n_nationkey | n_name' || chr(10) || string_agg(n_nationkey || ' | ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation")
def linearize_table(spark, d):
    rows = table(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("c")))).alias("r"))
    return rows.select(T.linearised(F.array(F.lit("n_nationkey"), F.lit("n_name")), F.transform("r", lambda x: x["c"])).alias("text"))


@query("ddl_render", f"""{_CELLS}, {_TYPES} SELECT "table", 'CREATE TABLE ' || "table" || ' (' || chr(10) || string_agg('"' || name || '" ' || CASE WHEN type = 'numeric' THEN 'FLOAT' ELSE 'TEXT' END, ',' || chr(10) ORDER BY name) || chr(10) || ');' AS ddl FROM types GROUP BY 1""")
def ddl_render(spark, d):
    by = N.column_types(_cells(spark, d)).groupBy("table").agg(F.array_sort(F.collect_list(F.struct("name", "type"))).alias("c"))
    return by.select("table", T.ddl(F.col("table"), F.transform("c", lambda x: x["name"]), F.transform("c", lambda x: x["type"])).alias("ddl"))


# --- records ---


@query(
    "synthesis_plan",
    f"""{_CELLS}, {_TYPES}, s AS (SELECT a."table" AS table_id, a.name, o.op, o.word FROM types a, (VALUES ('min', 'minimum'), ('max', 'maximum'), ('sum', 'sum'), ('avg', 'average'), ('count', 'count')) o(op, word) WHERE a.type = 'numeric')
        SELECT table_id, s.op AS operator, 'SELECT ' || s.op || '("' || s.name || '") FROM df' AS sql_query, round(CASE s.op WHEN 'min' THEN min(v) WHEN 'max' THEN max(v) WHEN 'sum' THEN sum(v) ELSE avg(v) END, 3) AS number, CAST(count(*) AS BIGINT) AS n_rows
        FROM s JOIN (SELECT "table" AS table_id, name, TRY_CAST(value AS DOUBLE) AS v FROM cells) USING (table_id, name) WHERE s.op <> 'count' GROUP BY 1, s.op, s.name
        UNION ALL SELECT "table", 'count', 'one column, whichever', count(DISTINCT row_id), count(DISTINCT row_id) FROM cells GROUP BY 1""",
)
def synthesis_plan(spark, d):
    """Whole way from tables to filtered answers, with the template that has no condition (so nothing is sampled). A table's rows are counted once, by any of its columns."""
    from .plans import synthesis

    t = templates.catalogue("basic")[-1]
    out = synthesis.synthesised(_cells(spark, d), [t], most=1_000)
    sql = F.when(F.col("operator") == "count", "one column, whichever").otherwise(F.col("sql_query"))
    return out.select("table_id", "operator", sql.alias("sql_query"), F.round(F.col("answer").cast("double"), 3).alias("number"), "n_rows")


@query("extended_dataset", "SELECT o_custkey AS table_id, CAST(o_orderkey AS VARCHAR) AS nl_question, o_orderpriority AS sql_query, CASE WHEN o_custkey % 3 = 0 THEN 'old' ELSE 'new' END AS origin FROM orders")
def extended_dataset(spark, d):
    """Questions that are there stay as they are; only the others are added."""
    from .plans import synthesis

    q = table(spark, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").cast("string").alias("nl_question"), F.col("o_orderpriority").alias("sql_query"))
    old = q.where("table_id % 3 = 0").withColumn("origin", F.lit("old"))
    return synthesis.extended(old, q.withColumn("origin", F.lit("new")))


@query("few_shot_first", "SELECT item_id, CASE WHEN item_id = (SELECT min(item_id) FROM benchmark) THEN 1 ELSE 0 END + (SELECT min(item_id) FROM benchmark) AS first_shot, CAST(2 AS INTEGER) AS n FROM benchmark")
def few_shot_first(spark, d):
    from .operators import records

    b = table(spark, d, "benchmark").select("item_id", "text")
    return records.few_shot_choice(b, b, 2, "item_id", first=True).select("item_id", F.col("shots")[0]["item_id"].alias("first_shot"), F.size("shots").alias("n"))


@query("model_cells", "SELECT p_partkey, p_brand || ', ' || CAST(p_size AS VARCHAR) AS texts, CAST(p_size * 2 AS DOUBLE) AS total, CAST(p_size AS DOUBLE) AS mean, CAST(3 AS DOUBLE) AS n, '' AS outside FROM part")
def model_cells(spark, d):
    from .operators import records

    rows = F.array(F.array("p_brand", F.col("p_size").cast("string")), F.array(F.col("p_size").cast("string"), "p_type"))
    at = lambda *x: F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r, c in x))
    number = lambda i, *x: records.aggregated_cells(rows, at(*x), records.cell_aggregator(F.lit(i))).cast("double")
    two = ((0, 1), (1, 0))
    return table(spark, d, "part").select("p_partkey", records.answer_of_cells(rows, at((0, 0), (0, 1), (0, 9))).alias("texts"), number(1, *two).alias("total"), number(2, *two).alias("mean"), number(3, (0, 0), *two).alias("n"), records.answer_of_cells(rows, at((2, 0), (-1, 0))).alias("outside"))


@query("masked_arrays", "SELECT conv_id, array_to_string(list(role ORDER BY turn) FILTER (WHERE turn % 2 = 0), ',') AS roles, CAST(count(*) FILTER (WHERE turn % 2 = 0) AS INTEGER) AS n FROM conversations GROUP BY 1")
def masked_arrays(spark, d):
    from .operators import records

    by = assign.hierarchical(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    out = records.masked(by.withColumn("filter_condition", F.transform("turn", lambda t: t % 2 == 0)))
    return out.select("conv_id", F.when(F.size("role") > 0, F.array_join("role", ",")).alias("roles"), F.size("turn").alias("n"))


@query("places_removed", "SELECT conv_id, CAST(greatest(count(*) - 2, 0) AS INTEGER) AS n FROM conversations GROUP BY 1")
def places_removed(spark, d):
    from .operators import records

    by = assign.hierarchical(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")
    return records.without_places(by.withColumn("gone", F.array(F.lit(0), F.lit(1))), "gone").select("conv_id", F.size("role").alias("n"))


@query("nested_first", "SELECT l_orderkey, l_linenumber, l_quantity AS head, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem")
def nested_first(spark, d):
    from .operators import records

    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.array(F.array("l_quantity", "l_discount"))).alias("x"), F.array(F.array("l_linenumber")).alias("y"))
    return df.select("l_orderkey", "l_linenumber", records.first_item(df, "x").alias("head"), records.as_texts(df, "y")[0][0].alias("line"))


@query("rows_beside", "SELECT a.* EXCLUDE (r), b.* EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS r FROM events) a FULL JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey DESC) AS r FROM orders) b USING (r)")
def rows_beside(spark, d):
    from .operators import records

    return records.beside(table(spark, d, "events"), table(spark, d, "orders"), ["event_id"], [F.desc("o_orderkey")])


@query("restored_order", "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents")
def restored_order(spark, d):
    from .operators import records

    back = records.reordered(table(spark, d, "documents"), F.desc("n_chars"), place="place", original=["doc_id"])
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars", "place")


@query("turn_places", "SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS place FROM conversations")
def turn_places(spark, d):
    from .operators import records

    return records.placed(table(spark, d, "conversations"), ["conv_id", "turn"], "place", by=("role",)).select("conv_id", "turn", "place")


@query("path_rewrite", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 's3:' || substr(url, 9) WHEN url LIKE 'http%' THEN 'x' || substr(url, 5) ELSE url END AS url FROM pages")
def path_rewrite(spark, d):
    from .operators import records

    return records.rewritten_paths(table(spark, d, "pages").select("page_id", "url"), "url", {"http": "x", "https://": "s3:"})


@query("rendered_templates", r"SELECT event_id, 'Type ' || regexp_replace(event_type, '[aeiou]', '_', 'g') || ' of ' || CAST(user_id AS VARCHAR) || '.' AS text FROM events")
def rendered_templates(spark, d):
    from .operators import records

    return table(spark, d, "events").select("event_id", records.templated("Type {{ event_type | regex_replace('[aeiou]', '_') }} of {{user_id}}.").alias("text"))


@query("text_concat", "SELECT p_partkey, p_brand || CAST(p_size AS VARCHAR) AS text FROM part")
def text_concat(spark, d):
    from .operators import records

    return table(spark, d, "part").select("p_partkey", records.joined_texts([F.col("p_brand"), F.col("p_size")]).alias("text"))


@query("grouped_samples", "SELECT CAST(length(p_type) AS INTEGER) AS size, CAST(count(*) AS INTEGER) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1")
def grouped_samples(spark, d):
    from .operators import records

    out = records.grouped_samples(table(spark, d, "part").select("p_partkey", "p_type"), F.length("p_type"), "size")
    return out.select("size", F.size("samples").alias("n"), F.col("samples")[0]["p_partkey"].alias("first_key"))


@query("json_records", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","nothing":null}' AS json FROM nation""")
def json_records(spark, d):
    from .operators import records

    return records.encoded(table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("nothing")))


@query("consolidated_results", "SELECT 't' || event_type AS task, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS stderr, count(*) AS samples FROM events GROUP BY 1")
def consolidated_results(spark, d):
    from .operators import records

    e = table(spark, d, "events").groupBy(F.concat(F.lit("t"), "event_type").alias("task")).agg(F.avg("value").alias("value"), M.mean_stderr(F.col("value")).alias("stderr"), F.count(F.lit(1)).alias("samples"))
    tasks = e.select("task", F.lit(None).cast("string").alias("alias"), F.lit("1").alias("version"), F.lit(0).alias("n_shot"))
    out = records.consolidated(e.withColumns({"metric": F.lit("score"), "filter": F.lit("none")}), tasks)
    return out.select(F.col("alias").alias("task"), F.round(F.col("results")["score,none"], 6).alias("mean"), F.round(F.col("results")["score_stderr,none"], 6).alias("stderr"), "samples")


@query("constant_columns", "SELECT n_nationkey, 'nations' AS name, 'train' AS split FROM nation")
def constant_columns(spark, d):
    from .operators import records

    return records.with_constants(table(spark, d, "nation").select("n_nationkey"), name="nations", split="train")


@query("table_names", f"""{_CELLS} SELECT "table" AS table_id, string_agg(name, ',' ORDER BY col_id) AS names FROM (SELECT DISTINCT "table", name, col_id FROM cells) GROUP BY 1""")
def table_names(spark, d):
    from .operators import records

    heads = _cells(spark, d).groupBy(F.col("table").alias("table_id"), "row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "name"))), lambda x: x["name"]).alias("header"))
    return records.table_names(heads).select("table_id", F.array_join("names", ",").alias("names"))


@query("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("windowed_events", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS avg FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    from .streaming.windows import windowed

    return windowed(table(spark, d, "events"), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("avg", 6).alias("avg"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many questions on one table, answered in one pass."""
    return fused_questions(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


@query(
    "model_sql_answers",
    """WITH o AS (SELECT *, o_orderkey % 7 AS k FROM orders), c AS (SELECT o_custkey, max(o_totalprice) AS top, avg(o_totalprice) AS mean, count(*) FILTER (o_totalprice > 100000) AS many,
            arg_max(o_orderkey, o_totalprice) AS dearest, min(o_orderkey) AS first FROM orders GROUP BY 1)
       SELECT o_orderkey, CASE k WHEN 1 THEN o_orderpriority ELSE '' END AS answer,
              round(CASE k WHEN 0 THEN top WHEN 2 THEN many WHEN 3 THEN mean WHEN 5 THEN dearest WHEN 6 THEN first END, 6) AS number FROM o JOIN c USING (o_custkey)""",
)
def model_sql_answers(spark, d):
    """A text for every order, of seven kinds; the fifth is none that may run."""
    from .operators.modelsql import sql_answers

    orders = table(spark, d, "orders")
    names = orders.columns
    rows = orders.select(F.lit("orders").alias("table_id"), F.col("o_orderkey").alias("row_id"), F.array(*(F.col(c).cast("string") for c in names)).alias("cells"))
    numeric = [f.dataType.simpleString() in ("bigint", "int", "double") or "decimal" in f.dataType.simpleString() for f in orders.schema]
    headers = spark.createDataFrame([("orders", names, numeric)], "table_id string, names array<string>, numeric array<boolean>")
    kinds = [
        "SELECT max(o_totalprice) FROM orders WHERE o_custkey = {c}",
        "select \"o_orderpriority\" from orders where O_ORDERKEY = '{k}' limit 1;",
        "SELECT COUNT(*) FROM orders WHERE o_custkey = {c} AND o_totalprice > 100000 ``` done",
        "SELECT avg(t.o_totalprice) AS mean, count(*) FROM orders AS t WHERE t.o_custkey = {c}",
        "DROP TABLE orders",
        "SELECT o_orderkey FROM orders WHERE o_custkey = {c} ORDER BY o_totalprice DESC LIMIT 1",
        "SELECT min(o_orderkey) FROM orders WHERE o_custkey = {c} AND NOT (o_orderstatus LIKE 'nothing%')",
    ]
    text = F.get(F.array(*map(F.lit, kinds)), (F.col("o_orderkey") % 7).cast("int"))
    text = F.replace(F.replace(text, F.lit("{c}"), F.col("o_custkey").cast("string")), F.lit("{k}"), F.col("o_orderkey").cast("string"))
    out = sql_answers(rows, headers, orders.select(F.col("o_orderkey").alias("qid"), F.lit("orders").alias("table_id"), text.alias("text")))
    word = F.col("qid") % 7 == 1
    return out.select(F.col("qid").alias("o_orderkey"), F.when(word, F.col("answer")).otherwise("").alias("answer"), F.round(F.when(~word, F.col("answer").try_cast("double")), 6).alias("number"))


@query(
    "conditions_together",
    """SELECT 'r' || lo AS qid, round(sum(p_retailprice), 2) AS number, count(*) AS n_rows FROM (SELECT DISTINCT p_size AS lo FROM part) JOIN part ON p_size >= lo AND p_size <= lo + 9 GROUP BY lo
       UNION ALL SELECT 'd' || t, count(c_acctbal), count(*) FROM (SELECT DISTINCT c_nationkey * 300 AS t FROM customer) JOIN customer ON c_acctbal - c_custkey >= t AND c_mktsegment <> 'BUILDING' GROUP BY t""",
)
def conditions_together(spark, d):
    """Ranges of part sizes, and a difference of two columns together with a text: every size and nation asks."""
    also = lambda shape, i, j, cmp, val: F.array(F.struct(F.lit(shape).alias("shape"), F.lit(i).alias("idx"), F.lit(j).cast("int").alias("idx2"), F.lit(cmp).alias("cmp"), val.cast("string").alias("val")))
    ask = lambda qid, t, op, agg, cond, cmp, val, more: [qid.alias("qid"), F.lit(t).alias("table_id"), F.lit(op).alias("op"), F.lit("single").alias("shape"), F.lit(agg).alias("agg_idx"), F.lit(None).cast("int").alias("agg_idx2"), F.lit(cond).cast("int").alias("cond_idx"), F.lit(cmp).alias("cmp"), val.cast("string").alias("val"), more.alias("also")]
    size, least = F.col("p_size"), F.col("c_nationkey") * 300
    ranges = table(spark, d, "part").select("p_size").distinct().select(*ask(F.concat(F.lit("r"), size), "part", "sum", 5, 4, ">=", size, also("single", 4, None, "<=", size + 9)))
    apart = table(spark, d, "customer").select("c_nationkey").distinct().select(*ask(F.concat(F.lit("d"), least), "customer", "count", 3, 4, "!=", F.lit("BUILDING"), also("difference", 3, 0, ">=", least)))
    out = Q.answer(_rows(spark, d), ranges.unionByName(apart))
    return out.where("n_rows > 0").select("qid", F.round("number", 2).alias("number"), "n_rows")


@query("response_cache", "SELECT conv_id, turn, upper(role) || length(text) AS response, CAST(1 AS BIGINT) AS times FROM conversations")
def response_cache(spark, d):
    """Two runs over overlapping halves of the turns: the second asks only what is new, and every request is answered once."""
    from .sources.responses import ResponseCache
    from .work import new_path

    cache = ResponseCache(spark, new_path(spark, "responses"))
    turns = table(spark, d, "conversations").withColumns({"method": F.col("role"), "args": F.to_json(F.struct("conv_id", "turn", "text"))})
    respond = lambda df: df.select("hash", F.concat(F.upper("method"), F.length(F.get_json_object("args", "$.text"))).alias("response"))
    cache.ask(turns.where("turn < 3"), respond, steps=2)
    out = cache.ask(turns, respond, steps=2)
    cache.compact()
    times = cache.read().groupBy("hash").agg(F.count(F.lit(1)).alias("times"))
    from .sources.responses import request_hash

    return out.withColumn("hash", request_hash()).join(times, "hash").select("conv_id", "turn", "response", "times")


from . import file_queries  # noqa: E402, F401  (registers its queries)
