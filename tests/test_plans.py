"""Expression trees, templates, bindings and answers against hand-worked values."""

import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import answering as Q
from tabulon.plans import assign, templates
from tabulon.plans.ast import BinOp, Cmp, Col, Lit, Over, Query, Template, between, from_state, fused, operator, parse_arithmetic, to_state

CELLS = [(0, ["10", "4", "a"]), (1, ["9", "2", "b"]), (2, ["1.50", "0", "''"]), (3, ["100", "7", "a"]), (4, ["0", "3", "c"])]
SCHEMA = "qid string, table_id string, op string, shape string, agg_idx int, agg_idx2 int, cond_idx int, cmp string, val string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("t", i, c) for i, c in CELLS], "table_id string, row_id long, cells array<string>").cache()


def answers(spark, rows, questions, semantics="typed"):
    q = spark.createDataFrame([(str(i), "t", *x) for i, x in enumerate(questions)], SCHEMA)
    return {int(r.qid): r for r in Q.answer(rows, q, semantics).collect()}


def test_typed_answers(spark, rows):
    got = answers(spark, rows, [
        ("min", "single", 0, None, None, None, None), ("max", "single", 0, None, None, None, None), ("sum", "single", 0, None, None, None, None), ("avg", "single", 0, None, None, None, None),
        ("count", "single", 0, None, None, None, None), ("sum", "ratio", 0, 1, None, None, None), ("min", "difference", 0, 1, None, None, None), ("max", "difference", 0, 1, None, None, None),
        ("noop", "single", 0, None, 0, "=", "1.5"), ("noop", "single", 0, None, 2, "=", "a"), ("sum", "single", 0, None, 2, "=", "zz"), ("count", "single", 0, None, 0, "<", "100"),
    ])
    assert [got[i].number for i in range(5)] == [0, 100, 120.5, 24.1, 5]
    assert got[5].number == pytest.approx(2.5 + 4.5 + 100 / 7 + 0)
    assert (got[6].number, got[7].number) == (-3, 93)
    assert got[8].answer == "1.5" and not got[8].multi_row
    assert got[9].answer == "10.0" and got[9].alternatives == ["100.0"] and got[9].multi_row and got[9].n_rows == 2
    assert got[10].number is None and got[10].n_rows == 0
    assert got[11].number == 4


def test_text_semantics(spark, rows):
    got = answers(spark, rows, [("count", "single", 0, None, 0, "=", "1.5"), ("count", "single", 0, None, 0, ">=", "2"), ("count", "single", 0, None, 0, "<", "100")], "text")
    assert [got[i].number for i in range(3)] == [0, 1, 3]


def test_coordinates_and_complement(spark, rows):
    q = spark.createDataFrame([("1", "t", "sum", "difference", 0, 1, 2, "=", "a")], SCHEMA)
    cells = Q.coordinates(rows, q).first().cells
    assert [(c.row, c.col) for c in cells] == [(0, 0), (0, 1), (3, 0), (3, 1)]
    one = spark.createDataFrame([([0, 1, 2], 4)], "r array<int>, n int")
    got = one.select(Q.compact_rows(F.col("r"), F.col("n")).alias("c"), Q.complement(F.col("r"), F.col("n")).alias("x")).first()
    assert got.c.inverted and got.c.rows == [3] and got.x == [3]


def test_fused_equals_single(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x"), (3.0, 0.0, "y"), (None, 4.0, "x")], "a double, b double, t string")
    qs = {op: Query(Col("a") / Col("b"), op, (Cmp(Col("t"), "!=", Lit("z")),)) for op in ("min", "max", "avg", "sum", "count")}
    got = {r.qid: r for r in fused(df, qs).collect()}
    for op, q in qs.items():
        want = q.plan(df).first()[0]
        assert got[op].answer == want or (want is None and got[op].answer is None)
        assert got[op].n_rows == 3
    assert got["count"].answer == 1
    assert fused(df.limit(0), qs).where("qid = 'count'").first().answer == 0


def test_sql_text_and_state():
    e = (Col("a") - Col("b")) * 2
    assert Query(e, "max", between(Col('c"d'), 5, 1)).sql() == 'SELECT max(("a" - "b") * 2) FROM df WHERE true AND "c""d" >= 1 AND "c""d" <= 5'
    assert Query(Col("a"), "noop", (Cmp(Col("t"), "=", Lit("o'x")),)).sql() == """SELECT "a" FROM df WHERE true AND "t" = 'o''x'"""
    assert Query(Col("a"), "sum", over=Over(("g",), ("o",), None, 1)).sql() == 'SELECT sum("a") OVER (PARTITION BY "g" ORDER BY "o" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) FROM df'
    assert from_state(to_state(e)) == e
    for bad in (lambda: BinOp("%", Col("a"), Col("b")), lambda: Cmp(Col("a"), "like", Lit(1)), lambda: operator("median"), lambda: Col("{a}{b}")):
        with pytest.raises(ValueError):
            bad()


def test_arithmetic():
    assert parse_arithmetic("1,000/ (2+3)*2") == 400
    assert parse_arithmetic("") == 0 and parse_arithmetic("-(2)--3") == 1
    assert parse_arithmetic("2+") is None and parse_arithmetic("__import__('os')") is None and parse_arithmetic("1/0") is None


def test_catalogue():
    every = templates.standard()
    assert len(every) == 28
    assert all("noop" in t.operators for t in every if t.where) and all("noop" not in t.operators for t in every if not t.where)
    for name in templates.PRESETS:
        for t in templates.preset(name):
            back = Template.from_json(t.state())
            assert back.sql_text() == t.sql_text() and back.types == t.types
    assert "greater than" in templates.condition_text(Cmp(Col("a"), ">", Lit(1)))
    assert "lesser than" in templates.condition_text(Cmp(Col("a"), ">", Lit(1)), inverted=True)


def test_bindings_and_questions(spark):
    catalog = spark.createDataFrame([("t", i, n, k) for i, (n, k) in enumerate([("a", "numeric"), ("b", "numeric"), ("c", "numeric"), ("d", "text")])], "table_id string, col_id int, name string, type string")
    assert assign.bindings(catalog, {"x": ("numeric",), "y": ("numeric",), "z": templates.ANY_TYPE}).count() == 12
    values = spark.createDataFrame([("t", n, i, v, None) for n in "abcd" for i, v in enumerate(["1", "2", "o'k"])], "table string, name string, row_id long, value string, number double")
    t = templates.catalogue("basic")[0]
    bound = assign.assignments(catalog, values, t, most=5)
    assert 0 < bound.count() <= 5 and bound.distinct().count() == bound.count()
    q = assign.questions(bound, t)
    assert q.where("operator = 'max' and not nl_question like 'What is the maximum of column %'").count() == 0
    assert q.where("sql_query like '%o''k%' and not sql_query like '%o''''k%'").count() == 0
    flat = assign.flattened(assign.hierarchical(q.select("table_id", "nl_question", "operator")))
    assert flat.count() == q.count()


def test_quality(spark):
    df = spark.createDataFrame([("x",), ("",), ("NaN",), (None,), ("''",), ("N/A",)], "answer string")
    assert [r[0] for r in Q.valid_answers(df).collect()] == ["x"]
    e, o = "What is the sum of the expression x?", "What is the sum of column x?"
    old = spark.createDataFrame([("a", 1, e), ("a", 2, e), ("b", 3, e), ("b", 4, o), ("c", 5, o)], "table_id string, qid int, nl_question string")
    new = spark.createDataFrame([("a", 10, e), ("b", 11, e), ("b", 12, e), ("b", 13, e), ("d", 14, e)], "table_id string, qid int, nl_question string")
    got = sorted(r.qid for r in Q.patched(old, new).collect())
    assert got == [4, 5, 10, 11, 13]  # one short in a: the last of b's spare ones


def test_answers_by_value_and_by_range(spark):
    rows = spark.createDataFrame([("t", i, [str(v), f"{i}"]) for i, v in enumerate(["1,000", "1000.0", "x", "-0", "0", "X", ""])], "table_id string, row_id long, cells array<string>")
    asked = [(1, "=", "1000"), (2, "=", "x"), (3, "=", "0"), (4, "!=", "1000"), (5, ">=", "0"), (6, None, None), (7, "=", "none such")]
    q = spark.createDataFrame([(i, "t", "count", "single", 1, None, None if c is None else 0, c, v) for i, c, v in asked], "qid int, table_id string, op string, shape string, agg_idx int, agg_idx2 int, cond_idx int, cmp string, val string")
    assert {r.qid: r.n_rows for r in Q.answer(rows, q).collect()} == {1: 2, 2: 1, 3: 2, 4: 5, 5: 4, 6: 7, 7: 0}
    assert {r.qid: r.n_rows for r in Q.answer(rows, q, "text").collect()}[1] == 0


def test_model_written_sql(spark):
    df = spark.createDataFrame([(1, "x"), (5, "y")], "`a b` int, t string")
    assert Q.sql_answer(df, 'SELECT max("a b") FROM df WHERE t = \'y\'; drop table x') == "5"
    assert Q.sql_answer(df, "select t from my_table where `a b` = 1 ```", "my_table") == "x"
    assert Q.sql_answer(df, "select nothing from df") == "" and Q.sql_answer(df, "drop table df") == "" and Q.sql_answer(df, "select t from df where 1 = 0") == ""
    assert Q.sql_answer(df, "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')") == Q.sql_answer(df, "SELECT * FROM text.`/etc/hostname`") == ""
    for bad in ("select java_method('a', 'b') from df", "select * from df, text.`/x`", "select * from other", "select * from df join parquet.`/x`", "select t from range(3)", "select '${env:HOME}' from df", "select t from df -- x", "select (select max(value) from text.`/x`) from df", "with x as (select 1) select * from x", "select t from `df`.x", "select t from df lateral view explode(array(1)) as y"):
        assert Q.safe_select(bad, "df") is None, bad
    assert Q.sql_answer(df, "select t from df where \"a b\" in (select max(\"a b\") from df)") == "y"
    assert Q.sql_answer(df, "select count(*) from df as d join df e on d.t = e.t where d.`a b` > 0.5") == "2"
    assert Q.sql_answer(df, "select round(avg(df.`a b`), 1) from df group by t order by t desc limit 1") == "5.0"


def test_whole_way_from_tables_to_answers(spark):
    from tabulon.plans import synthesis

    rows = [("t", i, j, n, v) for i, r in enumerate([("a", "1", "10"), ("a", "2", "20"), ("b", "3", "30"), ("b", "4", "")]) for j, (n, v) in enumerate(zip(("kind", "x", "y"), r, strict=True))]
    cells = spark.createDataFrame(rows, "table string, row_id long, col_id int, name string, value string")
    t = templates.catalogue("basic")[0]
    asked = synthesis.asked(cells, [t], most=50)
    got = synthesis.counted(synthesis.answered(asked, synthesis.rows_of(cells))).collect()
    by = {r.sql_query.replace("\n", " "): (r.answer, r.n_rows, r.multi_row) for r in got}
    # y has an empty cell, so it isn't numeric; kind = 'a' holds twice, so a lookup has two answers
    assert len(got) == len(by) and {r.aggregation_column for r in got} <= {"x"}
    one = {(r.operator, r.sql_query.rsplit("=", 1)[1].strip().strip("'")): (r.answer, r.n_rows, r.multi_row) for r in got}
    assert one["max", "a"][:2] == ("2.0", 2) and one["noop", "a"] == ("1.0", 2, True) and one["count", "b"][:2] == ("2.0", 2) and one["avg", "b"][0] == "3.5"
    kept = synthesis.filtered(synthesis.counted(synthesis.answered(asked, synthesis.rows_of(cells)))).collect()
    assert not any(r.multi_row or r.n_rows < 2 and r.operator != "noop" for r in kept) and len(kept) < len(got)
    final = synthesis.synthesised(cells, [t], most=50, cutoff=3).collect()
    assert len(final) == 3 and all('"x"' in r.nl_question for r in final)
    assert synthesis.extended(asked.limit(2), asked).count() == asked.count()
    with pytest.raises(ValueError):
        synthesis.plan_columns(templates.family(Col("{x}") * 3 + Col("{y}"))[0])


def test_records(spark, tmp_path):
    from tabulon.session import ship

    import zstandard

    from tabulon.operators import records
    from tabulon.sources import tables as I

    ship(spark)

    pool = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "doc_id int, text string")
    shots = records.few_shot_choice(pool, pool, 3, seed=4).collect()
    assert len(shots) == 9 and all(len(r.shots) == 3 and r.doc_id not in [s.doc_id for s in r.shots] for r in shots)
    with pytest.raises(ValueError):
        records.few_shot_choice(pool, pool.limit(1), 3)
    assert records.few_shot_choice(pool, pool.limit(3), 3).where("doc_id > 2").count() == 6
    deep = spark.createDataFrame([([[[[[[1]]]]]],)], "x array<array<array<array<array<array<int>>>>>>")
    with pytest.raises(ValueError):
        records.first_item(deep, "x")
    assert deep.select(records.first_item(deep, "x", 6)).first()[0] == 1
    with pytest.raises(ValueError):
        records.joined_texts([], "-")
    assert records.discarded(spark.range(10_000), 1000, 2.0, "id").count() in range(1800, 2200) and records.discarded(spark.range(10), 100, 2.0, "id").count() == 10
    assert records.pass_through(pool) is pool
    (tmp_path / "a.jsonl").write_text('{"text": "one", "meta": {"k": 1}}\n"two"\n')
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "b.jsonl.zst").write_bytes(zstandard.compress(b'{"text": "a"}\n"b"\n') + zstandard.compress(b'{"text": "c"}'))
    I.write_json(pool.select("text"), str(tmp_path / "z" / "more"))
    assert {(r.text, r.meta) for r in I.read_archive(spark, str(tmp_path / "a.jsonl")).collect()} == {("one", '{"k":1}'), ("two", None)}
    assert sorted(r.text for r in I.read_archive(spark, str(tmp_path / "z")).collect()) == ["a", "b", "c"]
    assert I.read_archive(spark, str(tmp_path / "z" / "more")).count() == 9


def test_places_over_whole_tables(spark):
    from tabulon.operators import records

    wide = spark.range(300_000).repartition(7).selectExpr("(id * 7919) % 300000 AS id", "repeat(md5(CAST(id AS STRING)), 3) AS text", "id % 3 AS g")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for n, adaptive in ((8, "true"), (60, "true"), (16, "false")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            out = records.placed(wide, ["id"])
            assert out.columns == ["id", "text", "g", "_place"]
            got = out.agg(F.count("*"), F.sum((F.col("id") != F.col("_place")).cast("int")), F.sum(F.length("text"))).first()
            assert tuple(got) == (300_000, 0, 300_000 * 96)
            assert out.select("_place").agg(F.sum((F.col("_place") >= 0).cast("int"))).first()[0] == 300_000  # pruned to one column
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    inside = records.placed(wide, [F.desc("id")], "at", by=("g",))
    assert inside.where("at <> (299999 - id) div 3 AND g = 2").count() < 300_000 and inside.groupBy("g").agg(F.min("at").alias("a"), F.max("at").alias("z"), F.count_distinct("at").alias("n")).where("a <> 0 OR z <> n - 1 OR n <> 100000").isEmpty()
    rows = [(1, None, "x"), (None, 2, "x"), (1, None, "x"), (1, 3, "_place")]
    tied = spark.createDataFrame(rows, "a int, b int, part string")
    assert sorted(r._place for r in records.placed(tied, ["a"]).collect()) == [0, 1, 2, 3]
    assert [r.part for r in records.placed(tied, ["a", "b"]).orderBy("_place").collect()] == ["x", "x", "x", "_place"]
    assert records.placed(tied.where("a > 5"), ["a"]).count() == 0
    longer = spark.range(1000).selectExpr("id AS k", "repeat('y', 50) AS place")
    side = records.beside(wide.where("id < 500"), longer, ["id"], ["k"])
    assert side.columns == ["id", "text", "g", "k", "place"] and side.count() == 1000 and side.where("id <> k").count() == 0 and side.where("id IS NULL").count() == 500
    assert records.restored(records.reordered(longer.limit(50), F.desc("k"), original=["k"])).columns == ["k", "place"]


def test_model_sql_together(spark):
    from tabulon.operators import modelsql as S

    rows = [("a", 0, ["x", "1", "u v"]), ("a", 1, ["y", "5", "it's"]), ("a", 2, ["y", "1,000", None]), ("a", 3, ["z", "none", "w"]), ("b", 0, ["7", "k"]), ("b", 1, ["3", "K"])]
    heads = [("a", ["Name", "a b", "t"], [False, True, False]), ("b", ["n", "Name"], [True, False]), ("none", ["q"], [False])]
    asked = {
        "SELECT max(\"a b\") FROM df WHERE Name = 'y'; drop table x": "1000.0", "select t from my_table where `a b` = 1 ```": "u v", "select nothing from df": "", "drop table df": "", "select t from df where 1 = 0": "",
        "SELECT count(*) FROM df WHERE Name = 'nobody'": "0", "SELECT sum(\"a b\") / 0 FROM df": "", "select Name from df where t = 'it''s'": "y", "SELECT df.Name FROM df WHERE df.\"a b\" > 1 ORDER BY \"a b\" DESC, t LIMIT 1": "y",
        "SELECT COUNT(DISTINCT Name) FROM x AS d WHERE d.Name <> \"x\"": "2", "SELECT * FROM df": "x", "SELECT max(\"a b\") - min(\"a b\") AS gap FROM df": "999.0", "select Name from df where \"a b\" between 2 and 10": "y",
        "select upper(Name) from df where Name in ('z', 'q') or t is null": "Y", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir')": "", "SELECT * FROM text.`/etc/hostname`": "",
        "SELECT Name FROM df WHERE max(\"a b\") = 1": "", "select Name, count(*) from df": "", "select Name from df group by Name": "", "select (select 1) from df": "", "": "", None: "", "select Name from df limit 0": "", "select sum(Name) from df": "",
    }
    texts = [(f"a{i}", "a", t) for i, t in enumerate(asked)] + [("b", "b", "select max(n) from b where Name = 'k'"), ("c", "b", "select n from b where Name = 'K'"), ("d", "none", "select q from x"), ("e", "gone", "select q from x"), ("f", "none", "select count(*) from x")]
    frames = spark.createDataFrame(rows, "table_id string, row_id int, cells array<string>"), spark.createDataFrame(heads, "table_id string, names array<string>, numeric array<boolean>"), spark.createDataFrame(texts, "qid string, table_id string, text string")
    got = {r.qid: r.answer for r in S.sql_answers(*frames, spread=2, together=4).collect()}
    want = {f"a{i}": a for i, a in enumerate(asked.values())} | {"b": "7.0", "c": "3.0", "d": "", "e": "", "f": "0"}
    assert got == want, {(k, list(asked)[int(k[1:])] if k[0] == "a" else k): (got.get(k), v) for k, v in want.items() if got.get(k) != v}
    assert S.sql_answers(*frames[:2], frames[2].where("qid = 'a3'")).collect()[0].answer == "" and spark.conf.get("spark.sql.ansi.enabled") == "true"
    shape = lambda t: S.shape_of(t, ["Name", "a b"], [False, True])
    assert shape("select max(`a b`) from t where Name = 'p'")[0] == shape("SELECT MAX(\"a b\") FROM other WHERE name = 'q'")[0]
    import random

    rng = random.Random(1)
    for _ in range(4000):  # whatever a model writes has a shape or none
        S.shape_of("select " * (rng.random() < 0.9) + " ".join(rng.choice(["select", "from", "t", "where", "and", "=", "(", ")", ",", "Name", "`a b`", "'x'", "5", ".", "order by", "limit", "max", "count(*)", "*", "as", '"a b"', "not", "''"]) for _ in range(rng.randint(0, 9))), ["Name", "a b"], [False, True])


def test_assignments_drawn_from_large_spaces(spark):
    wide = spark.range(2000).selectExpr("'wide' AS table_id", "CAST(id AS INT) AS col_id", "concat('c', id) AS name", "'numeric' AS type")
    some = spark.range(3).selectExpr("'small' AS table_id", "CAST(id AS INT) AS col_id", "concat('c', id) AS name", "if(id = 0, 'text', 'numeric') AS type")
    wanted = {"x": ("numeric",), "y": ("numeric",), "z": templates.ANY_TYPE}
    got = assign.drawn(wide.unionByName(some), wanted, 1500).collect()  # 8 * 10**9 assignments, and 2
    by = {t: {(r.x_id, r.y_id, r.z_id) for r in got if r.table_id == t} for t in ("wide", "small")}
    assert len(got) == 1502 and len(by["wide"]) == 1500 and by["small"] == {(1, 2, 0), (2, 1, 0)}
    assert all(len(set(t)) == 3 for t in by["wide"]) and all(r.x == f"c{r.x_id}" for r in got)
    counts = [sum(t[k] // 200 == b for t in by["wide"]) for k in range(3) for b in range(10)]
    assert sum((n - 150) ** 2 / 150 for n in counts) < 60  # 27 degrees of freedom
    assert {tuple(r) for r in assign.drawn(wide, wanted, 1500).collect()} == {tuple(r) for r in got if r.table_id == "wide"} != {tuple(r) for r in assign.drawn(wide, wanted, 1500, seed=1).collect()}
    pools = spark.createDataFrame([("wide", f"c{i}", ["1", "2", "3"][: i % 4]) for i in range(2000)], "table_id string, name string, values array<string>")
    picked = assign.drawn(wide, {"a": ("numeric",), "b": ("numeric",)}, 50, pools, ("low_val", "high_val"), "b").collect()
    assert len({tuple(r) for r in picked}) == 50 and all(r.low_val <= r.high_val and int(r.high_val) <= r.b_id % 4 for r in picked)
    many = assign.drawn(wide, {f"v{k}": ("numeric",) for k in range(8)}, 20)  # more than 2 ** 62
    assert many.distinct().count() == 20
    assert assign.drawn(some.where("col_id = 0"), {"x": ("text",), "y": ("text",)}, 5).count() == 0


@pytest.mark.parametrize("name", ["range", "difference_at_least", "basic", "ratio_no_filter"])
def test_presets_are_answered(spark, name):
    """Each question's own SQL on DuckDB gives its answer."""
    import duckdb

    from tabulon.plans import synthesis

    rng = random.Random(3)
    names, rows = ["a", "b c", "d", "t"], [(rng.randint(1, 40), rng.choice([-7, -3, 1, 2, 4, 8]), round(rng.uniform(0, 5), 2), rng.choice("xyz")) for _ in range(30)]
    cells = spark.createDataFrame([("tab", i, k, n, str(r[k])) for i, r in enumerate(rows) for k, n in enumerate(names)], "table string, row_id int, col_id int, name string, value string")
    found = synthesis.answered(synthesis.asked(cells, templates.preset(name), most=6), synthesis.rows_of(cells)).collect()
    con = duckdb.connect()
    con.execute('CREATE TABLE df (a DOUBLE, "b c" DOUBLE, d DOUBLE, t VARCHAR)')
    con.executemany("INSERT INTO df VALUES (?, ?, ?, ?)", rows)
    assert len(found) >= 20 and {r.operator for r in found} >= {"min", "max", "avg", "sum", "count"}
    for r in found:
        got = con.execute(r.sql_query).fetchall()
        if r.operator == "noop" or not got or got[0][0] is None:
            assert (r.answer is None) == (not got or got[0][0] is None), r
        else:
            assert float(r.answer) == pytest.approx(float(got[0][0])), r


def test_model_sql_is_parsed_once_for_texts_alike(monkeypatch):
    import json

    import pyarrow as pa
    from tabulon.operators import modelsql as S

    names, numeric = ["Name", "a b", "t", "5"], [False, True, False, True]
    head = json.dumps({"names": names, "numeric": numeric})
    values = ["7", "1.5", ".5", "1e3", "1.", "5.t", "'x'", "'it''s'", "'a = 5'", "'a;b'", "''", "'\x010\x01'", "0.70320901", '"x"', '"\x010\x01"', '"t"', "-3", "Name", "'or'", "'and'", "."]
    forms = [
        "select max(\"a b\") from t where Name = {0}", "select t from d where {0} = Name and \"a b\" > {1}", "select Name = {0} from t", "select Name from t where \"a b\" = {0} or t <> {1} limit 1", "select Name from 5 where t = {0} and \"a b\" = {1}",
        "select * from t where t in ({0}, {1})", "select Name from t where not (t like {0}) and \"a b\" = {1} order by t desc limit {0}", "select t from t where \"a b\" between {0} and {1} and Name = {1};x", "select x from t where a = {0}", "drop table {0}", "select \"5\" from t where \"5\" = {0} and 5 = {1}",
    ]
    for f in forms:
        for v in values:
            for w in values:
                text = f.format(v, w)
                assert S.read(text, head) == (S.shape_of(text, names, numeric) or (None, [], [], None, None)), text
    assert S.read("select t from t", None) == S.read(None, head) == S.read("", head) == (None, [], [], None, None)
    calls, clauses = [], S.clauses
    monkeypatch.setattr(S, "clauses", lambda tokens: calls.append(1) or clauses(tokens))
    texts = [f"SELECT avg(\"a b\") FROM q WHERE Name = 'n{i}' AND \"a b\" > {i}.5" for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"qid": list(range(1000)), "table_id": ["q"] * 1000, "text": texts, "head": [head] * 1000})
    (got,) = S._shapes(iter([batch]))
    assert len(calls) == 1 and got.column("vals").to_pylist() == [[f"n{i}", f"{i}.5"] for i in range(1000)] and set(got.column("eq_val").to_pylist()) == {f"n{i}" for i in range(1000)}


def test_model_sql_questions_stay_off_the_driver(spark, monkeypatch):
    import re

    from pyspark.sql import DataFrameWriter
    from tabulon.operators import modelsql as S

    rows = spark.range(400).selectExpr("'a' AS table_id", "id AS row_id", "array(CAST(id % 40 AS STRING), CAST(id AS STRING)) AS cells")
    heads = spark.createDataFrame([("a", ["k", "v"], [True, True])], "table_id string, names array<string>, numeric array<boolean>")
    texts = spark.range(80).selectExpr("id AS qid", "'a' AS table_id", "concat('select max(v) from a where ', if(id < 40, 'k = ', 'k >= '), CAST(id % 40 AS STRING)) AS text")
    plans, parquet = [], DataFrameWriter.parquet
    plan = lambda df: plans.append(df._jdf.queryExecution().toString())
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **more: plan(self._df) or parquet(self, path, **more))
    out = S.sql_answers(rows, heads, texts)
    plan(out)
    assert len(plans) >= 3
    sent = re.findall(r"BroadcastExchange[^\n]*\n[^\n]*", "\n".join(plans))
    assert not any("qid#" in x for x in sent), sent
    assert {r.qid: r.answer for r in out.collect()} == {i: f"{360 + i}.0" if i < 40 else "399.0" for i in range(80)}
