"""Normalisation, sampling, metrics, reports, texts, sources and streaming on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tabulon.functions import responses as R
from tabulon.functions import text as T
from tabulon.operators import corpus as C
from tabulon.operators import metrics as M
from tabulon.operators import normalize as N
from tabulon.operators import report as P
from tabulon.operators import sampling as S
from tabulon.session import ship
from tabulon.sources import tables as I


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_header(spark):
    ship(spark)
    assert N.unique_names(["a", "A", "a", "column_3"]) == ["a", "A_2", "a_3", "column_3"]
    rows = spark.createDataFrame([(["a", "A", "a", ""],), (None,), ([],)], "h array<string>")
    got = [r[0] for r in rows.select(N.dedup_header(N.fill_header(F.col("h")))).collect()]
    assert got == [["a", "A_2", "a_3", "column_3"], None, []]


def test_cells(spark):
    assert column(spark, ["", " ", " x ", None], T.clean_cell) == ["''", "", "x", None]
    assert column(spark, ["-3", "4.", "a1", "b"], T.cell_kind) == ["int", "float", "num_text", "text"]
    assert column(spark, ["1,000", "-2.5", ".5", "12,34", "x"], T.is_number) == [True, True, True, False, False]
    assert column(spark, ["1,000.5", "x"], T.to_number) == [1000.5, None]


def test_types(spark):
    cells = spark.createDataFrame([("t", "n", 0, "1,000"), ("t", "n", 1, "-2.5"), ("t", "n", 2, ".5"), ("t", "a", 0, "12 kg"), ("t", "a", 1, "a1"), ("t", "x", 0, "12"), ("t", "x", 1, "x")], "table string, name string, row_id long, value string")
    assert {r.name: r.type for r in N.column_types(cells).collect()} == {"n": "numeric", "a": "alphanumeric", "x": "text"}
    assert N.table_ids(cells, N.column_types(cells)).count() == 1


def test_header_repair(spark):
    df = spark.createDataFrame([(["1", "x"], [["2", "y"], ["3", "z"]]), (["n", "m"], [["2", "3"], ["4", "5"]])], "header array<string>, rows array<array<string>>")
    h, r = N.repair_header(F.col("header"), F.col("rows"))
    got = df.select(h.alias("h"), r.alias("r")).collect()
    assert got[0].h == ["col_0", "col_1"] and got[0].r[0] == ["1", "x"]
    assert got[1].h == ["n", "m"] and len(got[1].r) == 2
    texts = spark.createDataFrame([(["a", "abcdefghi"], [["abcdefghi", "a"]]), (["abc", "xyz"], [["uvw", "rst"]])], "header array<string>, rows array<array<string>>")
    assert [r[0] for r in texts.select(N.header_is_data(F.col("header"), F.col("rows"))).collect()] == [False, True]


def test_keep_first_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "k"), (2, "a", "l"), (3, None, "m")], "id int, r string, _x string")
    assert sorted(r.id for r in N.keep_first(df, ["r"], "id").collect()) == [1, 3]


def test_cutoff_and_tolerance(spark):
    q = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(3)] + [("c", 0)], "table_id string, qid int")
    got = {r.table_id: r.n for r in S.equal_cutoff(q, 6, order=["qid"]).groupBy("table_id").agg(F.count("qid").alias("n")).collect()}
    assert got == {"a": 2, "b": 2, "c": 1}
    t = spark.createDataFrame([("a", i) for i in range(10)], "table_id string, v int")
    assert S.tolerance_per_group(t, F.col("v") < 4, 0.2).count() == 8
    assert S.equal_cutoff(q.limit(0)).count() == 0


def test_splits(spark):
    files = spark.createDataFrame([("t", f"f{i:02}") for i in range(10)] + [("s", "one"), ("s", "two")], "topic string, path string")
    got = S.file_splits(files, {"train": 0.6, "validation": 0.2, "test": 0.2})
    by = {(r.topic, r.split): r.n for r in got.groupBy("topic", "split").agg(F.count("path").alias("n")).collect()}
    assert by[("t", "train")] == 6 and by[("t", "validation")] == 2 and by[("t", "test")] == 2
    assert by[("s", "train")] == 1 and by[("s", "test")] == 1
    assert S.limit_share(10, 0.25) == 3 and S.limit_share(10, 4) == 4


def test_hash_split_takes_the_first_rows_of_the_order(spark):
    docs = spark.range(3000).withColumnRenamed("id", "doc_id")
    order = [r.doc_id for r in docs.orderBy(S.hashed(42, "doc_id"), "doc_id").collect()]
    kind = {d: "dev" if i < 100 else "test" if i < 300 else "train" for i, d in enumerate(order)}
    assert {r.doc_id: r.split for r in C.hash_split(docs, 100, 200).collect()} == kind
    assert {r.doc_id: r.split for r in C.hash_split(docs, 100, 200, 50).collect()} == {d: kind[d] for d in order[:350]}
    assert C.hash_split(docs.limit(0), 1, 1, 1).count() == 0 and C.hash_split(docs.limit(3), 0, 0).count() == 3


def test_overlap_by_hashes(spark):
    docs = spark.createDataFrame([(1, "A b, c d"), (2, "b c"), (3, None), (4, "x c d e"), (4, "x c d e"), (5, "")], "doc_id int, text string")
    items = spark.createDataFrame([(7, "c D e"), (7, "c d e"), (8, "a b c"), (9, None)], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in C.overlap(docs, items, 3).collect()}
    assert got == {(1, 8), (4, 7)} and C.overlap(docs, items, 3).count() == 2
    assert sorted((r.doc_id, r.hits) for r in C.hit_counts(docs.distinct(), items, 3).collect()) == [(1, 1), (2, 0), (3, 0), (4, 1), (5, 0)]


def test_similar_names(spark):
    ship(spark)
    files = spark.createDataFrame([("t", n) for n in ("a_1.parquet", "a-2.parquet", "b_2.parquet", "c_9.parquet", "c 7.parquet")], "topic string, name string")
    assert sorted(r.name for r in S.similar_names(files).collect()) == ["a-2.parquet", "c 7.parquet"]  # b_2 shares its second token with a-2
    codes = column(spark, ["run_2021.csv", "Ab-XY_a1.b.parquet", "x.parquet"], S.structure_code)
    assert codes == ["t_d4", "tT-T_alpha_num2.t", "t"]


def test_values(spark):
    v = spark.createDataFrame([("t", "c", i, str(i), float(i)) for i in range(5)], "table string, name string, row_id long, value string, number double")
    for strategy, n in (("random", 3), ("random", 9), ("interpolation", 4), ("mix", 6), ("percentiles", 11)):
        got = S.sampled_values(v, n, strategy).first()["values"]
        assert len(got) == n and all(0 <= float(x) <= 4 for x in got)


def test_union_fills(spark):
    got = S.tolerant_union(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x", [1])], "b string, c array<int>")).collect()
    assert [(r.a, r.b, r.c) for r in got] == [(1, "", []), (-1, "x", [1])]


def test_metrics(spark):
    df = spark.createDataFrame([("1.0", "1"), ("x", "1"), ("2", "4")], "p string, t string")
    got = df.select(M.float_match(F.col("p"), F.col("t")).alias("f"), M.distance(F.col("p"), F.col("t")).alias("d")).collect()
    assert [r.f for r in got] == [True, False, False]
    assert [r.d for r in got] == [0, 10, pytest.approx(0.4999999875)]
    assert df.select(M.distance(F.col("p"), F.col("t")).alias("d")).agg(M.upper_median(F.col("d"))).first()[0] == pytest.approx(0.4999999875)
    v = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert M.exact_upper_median(v.withColumn("k", F.lit(0)), ["k"], "v").first().upper_median == 3
    assert M.combined_stderr([(0.5, 0.1, 10)]) == pytest.approx(0.1)
    assert M.word_error_edits("a b c", "a x c d") == 2
    assert 0.1 < M.bootstrap_stderr(v, "v", iterations=200) < 1.2


def test_bleu_differs(spark):
    df = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat"), ("a b c d e", "a b x d e")], "p string, r string")
    b = M.bleu(df, "p", "r").first()[0]
    assert 40 < b < 95
    assert M.bleu(df.limit(1), "p", "r").first()[0] == pytest.approx(100)
    assert M.translation_edit_rate(df, "p", "r").first()[0] == pytest.approx(100 / 11)


def test_word_edits():
    def plain(a, b):
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (x != y))
        return table[-1][-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randrange(12)) for _ in "ab")
        assert M.word_error_edits(" ".join(a), " ".join(b)) == plain(a, b)
    assert M.word_error_edits(None, "a b") == 2 and M.word_error_edits("a", None) == 1 and M.word_error_edits(None, None) == 0


def test_rollup(spark):
    s = spark.createDataFrame([("g", "a", 1.0), ("g", "a", 0.0), ("g", "b", 1.0), ("g", "b", 1.0), ("g", "b", 0.0)], "g string, t string, v double")
    got = M.roll_up(M.by_task(s, ["g", "t"], "v"), ["g"]).first()
    assert got.metric == pytest.approx(0.6) and got.n == 5 and got.stderr > 0


def test_bins(spark):
    edges = [0, 3, 10, 50, 100]
    assert column(spark, [0, 3, 250, -1], lambda c: P.bin_of(c, edges), "int") == [0, 3, 100, None]
    assert column(spark, [5.0, 6.0], lambda c: P.nearest_bin(c, [0.0, 10.0]), "double") == [0.0, 10.0]
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,)], "v double")
    assert P.equal_count_edges(df, "v", 4) == [1.0, 2.0] or P.equal_count_edges(df, "v", 4) == [1.0]


def test_report_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), (None, 3.0)], "k string, v double")
    got = P.grouped(df, ["k"], ["v"]).collect()
    assert [(r.k, r.v_mean, r.v_count) for r in got] == [("a", 1.0, 1)]
    assert P.markdown(P.grouped(df, ["k"], ["v"])).startswith("|k|v_mean|v_count|")


def test_responses(spark):
    assert column(spark, [["b", "a", "a", "b"], ["x"]], R.majority_vote(), "array<string>") == [["b"], ["x"]]
    assert column(spark, [["ans 1 and 22", "none"]], R.regex(r"(\d+)", select=-1), "array<string>") == [["22", "[invalid]"]]
    both = R.build([("lowercase", {}), ("map", {"values": {"a": "1"}, "default": "?"})])
    assert column(spark, [["A", "B"]], both, "array<string>") == [["1", "?"]]
    df = spark.createDataFrame([(["A"],)], "resps array<string>")
    assert {(r["filter"], r.filtered_resps[0]) for r in R.apply_filters(df, {"low": R.lowercase(), "raw": R.take_first()}).collect()} == {("low", "a"), ("raw", "A")}


def test_choice(spark):
    ship(spark)
    df = spark.createDataFrame([("It is (B).", ["x", "y"]), ("surely Paris, not Rome", ["Rome", "Paris"]), ("so #### 1,234", ["x", "y"]), ("so: B", ["x", "y"]), ("?", ["x", "y"]), (None, None)], "response string, choices array<string>")
    assert [r.choice for r in R.choice_filter(df).collect()] == ["[invalid]", "(B)", "1,234", "(B)", "[invalid]", "[invalid]"]
    assert R.choice_filter(df, nth=-1).collect()[1].choice == "(A)"
    assert [r.choice for r in R.choice_filter(df, pattern=r"\(([A-Z])\)").collect()][0] == "B"
    loose = spark.createDataFrame([("the PARIS! one", ["Rome", "the Paris"])], "response string, choices array<string>")
    assert R.choice_filter(loose).first().choice == "[invalid]"
    assert R.choice_filter(loose, ignore_case=True, ignore_punctuation=True, ignore=("the ",)).first().choice == "(B)"


def test_text_functions(spark):
    assert column(spark, ["SELECT 1; x", "a ```b"], T.sql_cut) == ["SELECT 1", "a"]
    assert column(spark, ["do n't !"], T.detokenise) == ["don't !"]
    assert column(spark, ['He said "hi" ( ok ) .'], T.detokenise) == ['He said"hi"(ok).']
    assert column(spark, ["median", " Highest "], T.aggregator_of) == ["unknown", "max"]
    assert column(spark, [["a", "b", "c"], []], lambda c: T.ngrams(c, 2), "array<string>") == [["a b", "b c"], []]
    got = column(spark, [list("abcdefghi"), [], ["a"]], lambda c: T.rolling_windows(c, 4, "<s>", 3), "array<string>")
    assert [("".join(w.read), "".join(w.predict)) for w in got[0]] == [("<s>abc", "abcd"), ("bcde", "ef"), ("defg", "gh"), ("efgh", "i")]
    assert got[1] == [] and [(list(w.read), list(w.predict)) for w in got[2]] == [(["<s>"], ["a"])]
    apart = column(spark, [list("abcdefghi")], lambda c: T.disjoint_windows(T.rolling_windows(c, 4, "<s>", 3)), "array<string>")[0]
    assert [("".join(w.read), "".join(w.predict)) for w in apart] == [("<s>", "abcd"), ("bcd", "ef"), ("def", "gh"), ("efgh", "i")]
    df = spark.createDataFrame([("What is the maximum of column a b?", ["a b", "c"])], "q string, n array<string>")
    assert df.select(T.quote_columns(F.col("q"), F.col("n"))).first()[0] == 'What is the maximum of column "a b"?'
    more = [("column 'c'?", ["c"]), ("is 'c' or c there", ["c"]), ("ab c", ["b"])]
    assert [r[0] for r in spark.createDataFrame(more, "q string, n array<string>").select(T.quote_columns(F.col("q"), F.col("n"))).collect()] == ["column 'c'?".replace("column 'c'", ' "c"'), 'is "c" or "c" there', "ab c"]


def test_lines_and_chunks(spark):
    ship(spark)
    lines = spark.createDataFrame([(0, "x"), (1, "y"), (2, "\n"), (3, "z")], "i int, text string")
    assert sorted(r.text for r in C.line_groups(lines, "text", "i").collect()) == ["xy", "z"]
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "doc_id int, text string")
    parts = C.chunks(docs, 2)
    assert [(r.chunk, r.text) for r in parts.orderBy("chunk").collect()] == [(0, "a b"), (1, "c d"), (2, "e")]
    assert C.packed_leftovers(parts.coalesce(1), 2).count() == 3


def test_decontamination(spark):
    ship(spark)
    grams = C.contaminant_ngrams(spark.createDataFrame([("the quick brown fox",)], "text string"), 3)
    assert sorted(r[0] for r in grams.collect()) == ["quick brown fox", "the quick brown"]
    assert [g for g, _, _ in C.word_spans("See, The quick BROWN fox!", 3)][1:] == ["the quick brown", "quick brown fox"]
    text = "clean " * 100 + "the quick brown fox " + "more " * 100
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the quick brown fox")], "item_id long, text string")
    got = C.decontaminated(docs, items, 3).collect()
    assert {r.doc_id for r in got} == {1} and all("quick" not in r.text for r in got)  # the others are shorter than a part may be
    assert {r.doc_id: r.hits for r in C.hit_counts(docs, items, 3).collect()} == {1: 2, 2: 0, 3: 0}
    long = "x" * 1000
    hits = [(i, i + 1) for i in range(400, 411)]
    assert C.clean_parts(long, hits[:10], 0, 200) == ["x" * 400, "x" * (1000 - 411)] and C.clean_parts(long, hits, 0, 200) is None
    assert C.clean_parts(long, [(400, 410)], 200, 200) == ["x" * 389] and C.clean_parts(long, [(401, 410)], 200, 200)[0] == "x" * 201
    assert C.clean_parts("x" * 199, []) == [] and C.clean_parts("x" * 200, []) == ["x" * 200]
    assert C.overlap(docs, items, 3).collect()[0].asDict() == {"doc_id": 1, "item_id": 7}


def test_sources(spark, tmp_path):
    ship(spark)
    spark.createDataFrame([(1, "x"), (2, None)], "n int, t string").coalesce(1).write.parquet(str(tmp_path / "topic1" / "a.parquet"))
    got = I.parquet_tables(spark, str(tmp_path / "topic1")).collect()
    assert len(got) == 1 and got[0].header == ["n", "t"] and got[0].rows == [["1", "x"], ["2", ""]]
    log = tmp_path / "logs" / "model_a"
    log.mkdir(parents=True)
    (log / "samples.jsonl").write_text(json.dumps({"doc_id": 1, "doc": {"table_idx": 3, "question": "q", "answer": "4"}, "resps": [["4"]], "filtered_resps": ["4"], "exact_match": 1.0}) + "\n")
    r = I.result_files(spark, str(tmp_path / "logs" / "*" / "*.jsonl")).first()
    assert (r.model_name, r.table_idx, r.answer) == ("model_a", 3, "4")
    v = I.Versions(spark, str(tmp_path / "cache"))
    v.write("x", spark.range(3), "1")
    v.write("x", spark.range(5), "2")
    assert v.read("x").count() == 5 and v.once("x", lambda: None).count() == 5
    v.delete("x")
    assert v.versions("x") == ["2"]
    (tmp_path / "t.json").write_text(json.dumps({"columns": ["a", "b"], "data": [["1", "2"], ["3", "4"]]}))
    assert [r["values"]["b"] for r in I.tracker_table(spark, str(tmp_path / "t.json")).orderBy("row").collect()] == ["2", "4"]


def test_stream(spark, tmp_path):
    from tabulon.streaming import windows as W

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,id) AS ts, 'a' AS event_type, CAST(id AS DOUBLE) AS value FROM range(96)")
    for day in range(4):  # a file a day, so a trigger a day; a day is closed once a later one was seen
        rows.where(F.dayofmonth("ts") == day + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = W.event_stream(spark, str(tmp_path / "in"), rows.schema)
    W.run_once(W.windowed(stream, "1 day", late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert got and all(r.n == 24 for r in got) and got[0].max == 23.0


def test_edits_with_moves():
    cases = [
        ("b c a", "a b c", 1), ("a b c d", "c d a b", 1), ("d c b a", "a b c d", 3), ("a b", "a b", 0), ("x a b c", "a b c y", 2), ("THE cat", "the Cat", 0),
        ("saudi arabia denied this week information published in the american new york times", "this week the saudis denied information published in the new york times", 4),
        (None, "a b", 2), ("a", "", 1), ("a a a b", "b a a a", 1),
    ]
    for p, r, edits in cases:
        assert M.shifted_edits(p, r) == edits, (p, r)
    assert M.shifted_edits("THE cat", "the Cat", case=True) == 2 and M.shifted_edits("b c a", "a b c", most_cells=1) == 2
    assert M.shifted_edits("a " + "w " * 40 + "x", "w " * 40 + "x a", most_distance=20) == 2

    def least(a, b):  # any moves of blocks that both have, then edits
        seen, todo, best, moves = {tuple(a)}, [tuple(a)], M.word_error_edits(" ".join(a), " ".join(b)), 0
        while todo and moves < best:
            moves, new = moves + 1, []
            for t in todo:
                for i in range(len(t)):
                    for k in range(i + 1, len(t) + 1):
                        rest = t[:i] + t[k:]
                        for j in range(len(rest) + 1):
                            u = rest[:j] + t[i:k] + rest[j:]
                            if u not in seen:
                                seen.add(u)
                                new.append(u)
                                best = min(best, moves + M.word_error_edits(" ".join(u), " ".join(b)))
            todo = new
        return best

    rng, same = random.Random(8), 0
    for _ in range(120):
        a, b = (rng.choices("abcd", k=rng.randrange(1, 6)) for _ in "ab")
        got, plain, want = M.shifted_edits(" ".join(a), " ".join(b)), M.word_error_edits(" ".join(a), " ".join(b)), least(a, b)
        assert want <= got <= plain
        same += got == want
    assert same >= 110


def test_resampled_statistics(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.4), int(rng.random() < 0.5), " ".join(rng.choices("abcdef", k=9))) for i in range(400)]
    rows = [(i, p, t, w, w.replace("a", "b") if i % 3 else w, None if i % 5 == 0 else float(t)) for i, p, t, w in rows]
    df = spark.createDataFrame(rows, "id int, p int, t int, w string, said string, v double").repartition(5)
    times = M.resamples(df.withColumn("one", F.lit(1.0)), ["one", "v"], "id", 300).agg(F.avg("one").alias("m"), F.var_samp("one").alias("s"), F.count("*").alias("n")).first()
    assert times.n == 300 and abs(times.m - 400) < 5 and 300 < times.s < 520  # Poisson: mean and variance are the number of rows
    value, err = M.metric_stderr(df, "f1", "p", "t", "id").first()
    again = M.metric_stderr(df.repartition(2), "f1", "p", "t", "id").first()
    assert value == pytest.approx(df.select(M.f1(F.col("p"), F.col("t")).alias("x")).first().x) and again == pytest.approx((value, err))
    import numpy as np

    r = np.array([(x[1], x[2]) for x in rows])
    gen, values = np.random.default_rng(1), []
    for _ in range(400):
        s = r[gen.integers(0, 400, 400)]
        values.append(2 * (s[:, 0] & s[:, 1]).sum() / s.sum())
    assert err == pytest.approx(np.std(values), rel=0.25)
    for metric in ("bleu", "chrf", "mcc"):
        value, err = M.metric_stderr(df, metric, "said" if metric != "mcc" else "p", "w" if metric != "mcc" else "t", "id", 60).first()
        assert err > 0
        if metric == "bleu":
            assert value == pytest.approx(M.bleu(df, "said", "w").first()[0])
    null = [x[5] for x in rows if x[5] is not None]
    assert M.poisson_bootstrap(df, "v", "id", 300).first()[0] == pytest.approx(np.std(null, ddof=1) / len(null) ** 0.5, rel=0.25)
    assert M.metric_stderr(df, "mean", "said", "w", "id").first().value < 1
    with pytest.raises(ValueError):
        M.metric_stderr(df, "nothing", "p", "t", "id")


def test_median_of_large_groups(spark):
    rng = random.Random(4)
    groups = {"all": [rng.random() for _ in range(5000)], "ties": [7.0] * 3000 + [rng.random() for _ in range(1000)] + [9.0] * 900, "even": [float(i) for i in range(4000)], "few": [3.0, 1.0], "same": [2.0] * 2500, None: [-1.0, 5.0, 1e300] * 700, "two": [1.0] * 1500 + [2.0] * 1500}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("few", None), ("null", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    want = {k: sorted(v)[len(v) // 2] for k, v in groups.items()}
    for most in (100, 10_000):
        assert {r.k: r.upper_median for r in M.exact_upper_median(df, ["k"], "v", most_rows=most).collect()} == want
    assert M.exact_upper_median(df.where("k = 'all'"), [], "v", most_rows=50).first()[0] == want["all"]


def test_contaminant_index(spark, tmp_path):
    rng = random.Random(1)
    say = lambda k: " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(k))
    items = [(i, say(30)) for i in range(12)]
    docs = [(i, say(60) + " " + rng.choice(items)[1] * (i % 4 == 0) + " " + say(20)) for i in range(80)] + [(100, None), (101, "")]
    d, it = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = C.ContaminantIndex(spark, str(tmp_path / "index"), n=5, buckets=4)
    assert index.overlap(d).count() == 0
    index.add(it.where("item_id < 6"))
    first = {tuple(r) for r in index.overlap(d).collect()}
    index.add(it)  # half of them again
    both = {tuple(r) for r in index.overlap(d).collect()}
    assert first < both == {tuple(r) for r in C.overlap(d, it, 5).collect()} and len(both) >= 15
    hits = C._hits(d, it, 5, "text", "doc_id").count()
    assert hits <= index.candidates(d).count() <= 2 * hits
    again = C.ContaminantIndex(spark, str(tmp_path / "index"), n=5, buckets=4)
    assert {tuple(r) for r in again.overlap(d).collect()} == both
    plan = index.overlap(d)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_decontaminated_is_what_the_plain_cutter_gives(spark):
    rng = random.Random(6)
    say = lambda k: "".join(rng.choice(["Wörd", "a", "b,", " - ", "x\n", "\t", "Y!z"]) + str(rng.randrange(60)) + " " for _ in range(k))
    items = [say(40) for _ in range(3)]
    docs = [(i, "".join(say(rng.randrange(80)) + rng.choice(items)[: rng.randrange(60)] for _ in range(rng.randrange(1, 6)))) for i in range(60)] + [(99, None), (98, "")]
    got = sorted(tuple(r) for r in C.decontaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id int, text string"), 4, 20, 15, 9).collect())
    bad = {g for t in items for g, _, _ in C.word_spans(t, 4)}
    want = []
    for i, t in docs:
        hits = [(a, z) for g, a, z in C.word_spans(t or "", 4) if g in bad]
        want += [(i, len(hits), k, p) for k, p in enumerate(C.clean_parts(t or "", hits, 20, 15, 9) or [])]
    assert got == sorted(want) and len({w[1] for w in want}) > 3


def test_response_cache(spark, tmp_path):
    from tabulon.sources.responses import ResponseCache, request_hash

    asked = []

    def respond(df):
        asked.extend(sorted(r.args for r in df.collect()))
        return df.withColumn("response", F.upper("args"))

    requests = spark.createDataFrame([(i, "m", f"q{i % 20}") for i in range(50)] + [(99, "m", None)], "id int, method string, args string")
    one, two = (ResponseCache(spark, str(tmp_path / "cache")) for _ in range(2))
    first = one.ask(requests.where("id < 10"), respond, steps=3)
    assert {(r.id, r.response) for r in first.collect()} == {(i, f"Q{i}") for i in range(10)} and sorted(asked) == sorted(f"q{i}" for i in range(10))
    asked.clear()
    got = two.ask(requests.where("id < 99"), respond)
    assert got.columns == ["id", "method", "args", "response"] and {(r.id, r.response) for r in got.collect()} == {(i, f"Q{i % 20}") for i in range(50)}
    assert sorted(asked) == sorted(f"q{i}" for i in range(10, 20))  # nothing twice
    asked.clear()
    # two writers at once, and one that stops in the middle: what was finished counts
    late = requests.where("id = 3").withColumn("hash", request_hash()).select("hash", F.lit("later").alias("response"))
    one.put(late)
    two.put(requests.where("id = 99").withColumn("hash", request_hash()).select("hash", F.lit("null").alias("response")))
    (tmp_path / "cache" / "parts" / "p-0").mkdir()
    assert one.read().count() == 21 and one.ask(requests, respond).count() == 51 and asked == []
    before = {tuple(r) for r in one.read().select("hash", "response").collect()}
    name = one.compact()
    assert one.parts() == [name] and {tuple(r) for r in two.read().select("hash", "response").collect()} == before
    assert two.vacuum() >= 3 and {tuple(r) for r in one.read().select("hash", "response").collect()} == before and one.compact() is None

    def broken(df):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        one.ask(requests.withColumn("args", F.concat("args", F.lit("!"))), broken)
    assert one.parts() == [name]


def test_documents_of_a_stream(spark, tmp_path):
    from tabulon.streaming.documents import documents_stream
    from tabulon.streaming.windows import event_stream, run_once

    rng = random.Random(5)
    schema = "file string, line long, text string, ts timestamp"
    rows = [(f"f{i}", k, rng.choice(["a", "b b", "é", "\n", "", None]), k) for i in range(6) for k in range(rng.randrange(1, 25))]
    frame = lambda r: spark.createDataFrame(r, "file string, line long, text string, s long").select("file", "line", "text", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    want = {tuple(r) for r in C.line_groups(frame(rows).withColumn("text", F.coalesce("text", F.lit(""))), "text", "line", "file", "+").select("file", "doc", "text").collect()}
    source, sink, state = (str(tmp_path / k) for k in ("in", "out", "state"))

    def arrive(part):
        frame(part).coalesce(1).write.mode("append").parquet(source)
        run_once(documents_stream(event_stream(spark, source, schema), "1 second", 60_000, "+"), sink, state)  # starts again from its state

    late = [r for r in rows if r[1] % 5 == 3]
    arrive([r for r in rows if r[1] < 10 and r not in late])
    first = spark.read.schema("file string, doc long, text string").parquet(sink).count()
    mixed = late + [r for r in rows if r[1] >= 10 and r not in late] + rows[:3]
    rng.shuffle(mixed)
    arrive([(f, k, t, 30) for f, k, t, _ in mixed])
    arrive([("end", 0, "x", 10_000)])
    arrive([("end", 1, "y", 20_000)])
    got = [tuple(r) for r in spark.read.parquet(sink).collect()]
    assert len(got) == len(set(got)) and set(got) - {("end", 0, "x+y")} == want and 0 < first < len(want)
