"""Queries that write the given tables as the files a source expects, and read them back through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import corpus as C
from .queries import query
from .session import ship
from .sources import tables as S
from .sources.tables import table
from .work import new_path


@query("tables_of_files", "SELECT 'c_mktsegment=' || c_mktsegment AS topic, c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, CAST(4 AS INTEGER) AS columns FROM customer")
def tables_of_files(spark, d):
    """Customers as one table a file in a folder a segment; schemas are read from the files."""
    ship(spark)
    path = new_path(spark, "topics")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment").repartition("c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    rows = S.parquet_tables(spark, path).select("topic", F.size("header").alias("columns"), F.explode("rows").alias("r"))
    return rows.select("topic", F.col("r")[0].cast("long").alias("c_custkey"), F.col("r")[1].alias("c_name"), F.round(F.col("r")[2].cast("double"), 2).alias("c_acctbal"), "columns")


@query("topic_cutoff", "SELECT 'p_size=' || p_size AS topic, CAST(1 AS BIGINT) AS files FROM (SELECT DISTINCT p_size FROM part)")
def topic_cutoff(spark, d):
    """Several files a topic, of which the first is taken."""
    ship(spark)
    path = new_path(spark, "topics")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").repartition(2).write.partitionBy("p_size").parquet(path)
    return S.parquet_tables(spark, path, per_topic=1).groupBy("topic").agg(F.count(F.lit(1)).alias("files"))


@query("tables_of_json", "SELECT 'region ' || n_regionkey AS name, n_nationkey, n_name, 'n_nationkey,n_name' AS header FROM nation")
def tables_of_json(spark, d):
    path = new_path(spark, "json-tables")
    cells = F.array(F.col("n_nationkey").cast("string"), "n_name")
    by = table(spark, d, "nation").groupBy(F.concat(F.lit("region "), "n_regionkey").alias("name")).agg(F.collect_list(cells).alias("rows"))
    S.write_json(by.select("name", F.array(F.lit("n_nationkey"), F.lit("n_name")).alias("header"), "rows"), path)
    rows = S.json_tables(spark, path).select("name", F.array_join("header", ",").alias("header"), F.explode("rows").alias("r"))
    return rows.select("name", F.col("r")[0].cast("long").alias("n_nationkey"), F.col("r")[1].alias("n_name"), "header")


@query(
    "results_of_models",
    """SELECT 'model=m' || (o_orderkey % 3) AS model, o_orderkey AS doc_id, o_custkey AS table_idx, o_orderpriority AS question, o_orderstatus AS answer, 'said ' || o_orderstatus AS first, (o_orderkey % 2)::DOUBLE AS em FROM orders""",
)
def results_of_models(spark, d):
    """Sample logs in a folder a model, read together, columns renamed."""
    path = new_path(spark, "logs")
    doc = F.struct(F.col("o_custkey").alias("table_idx"), F.col("o_orderkey").alias("question_number"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"), F.lit("max").alias("aggregator"), F.lit(2).alias("aggregation_num_rows"))
    said = F.concat(F.lit("said "), "o_orderstatus")
    rows = table(spark, d, "orders").select(F.concat(F.lit("m"), F.col("o_orderkey") % 3).alias("model"), F.col("o_orderkey").alias("doc_id"), doc.alias("doc"), F.array(F.array(said)).alias("resps"), F.array(said).alias("filtered_resps"), (F.col("o_orderkey") % 2).cast("double").alias("exact_match"))
    S.write_json(rows, path, codec="none", by="model")
    out = S.result_files(spark, f"{path}/*/*.json")
    return S.renamed(out.withColumn("first", F.col("filtered_resps")[0]), {"model_name": "model", "doc_id": "doc_id", "table_idx": "table_idx", "question": "question", "answer": "answer", "first": "first", "exact_match": "em"})


@query("run_settings", "SELECT 'model=' || replace(r_name, ' ', '_') AS model_name, t.task, CAST(r_regionkey + t.k AS BIGINT) AS num_fewshot, r_regionkey * 1.5::DOUBLE AS seconds FROM region, (VALUES ('a', 0), ('b', 1)) t(task, k)")
def run_settings(spark, d):
    path = new_path(spark, "runs")
    few = lambda k: F.struct((F.col("r_regionkey") + k).cast("long").alias("num_fewshot"))
    rows = table(spark, d, "region").select(F.replace("r_name", F.lit(" "), F.lit("_")).alias("model"), F.create_map(F.lit("a"), few(0), F.lit("b"), few(1)).alias("configs"), (F.col("r_regionkey") * 1.5).cast("string").alias("total_evaluation_time_seconds"), F.lit(2048).alias("max_length"))
    S.write_json(rows.repartition("model"), path, codec="none", by="model")
    return S.run_metadata(spark, f"{path}/*/*.json").select("model_name", "task", "num_fewshot", "seconds")


@query("tracked_tables", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def tracked_tables(spark, d):
    """A file of {columns, data} for each nation."""
    path = new_path(spark, "tracked")
    columns = ["s_suppkey", "s_name", "s_nationkey"]
    by = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("of")).agg(F.collect_list(F.array(*(F.col(c).cast("string") for c in columns))).alias("data"))
    S.write_json(by.withColumn("columns", F.array(*map(F.lit, columns))).repartition("of"), path, codec="none", by="of")
    rows = S.tracker_table(spark, f"{path}/*/*.json")
    return rows.select(*(F.col("values")[c].alias(c) for c in columns))


@query("text_of_splits", r"SELECT role AS split, regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM conversations")
def text_of_splits(spark, d):
    path = new_path(spark, "splits")
    S.write_splits(table(spark, d, "conversations"), path, "text", "role")
    lines = S.text_lines(spark, f"{path}/*/*.txt")
    return lines.select(F.regexp_extract("file", "role=([^/]+)/", 1).alias("split"), "text")


@query("results_by_field", "SELECT event_type, event_id, round(value, 6) AS value FROM events")
def results_by_field(spark, d):
    """Results as compressed JSON, a folder for each value of a field."""
    path = new_path(spark, "results")
    S.write_json(table(spark, d, "events").select("event_type", "event_id", "value"), path, by="event_type")
    return spark.read.schema("event_id long, value double, event_type string").json(path).select("event_type", "event_id", F.round("value", 6).alias("value"))


@query("archived_texts", "SELECT sha256(text) AS text_sha256, json_object('k', doc_id)->>'k' AS k FROM documents")
def archived_texts(spark, d):
    """Documents as compressed JSON lines with their metadata."""
    path = new_path(spark, "archive")
    S.write_json(table(spark, d, "documents").select("text", F.struct(F.col("doc_id").alias("k")).alias("meta")), path)
    return S.read_archive(spark, path).select(F.sha2("text", 256).alias("text_sha256"), F.get_json_object("meta", "$.k").alias("k"))


@query("newest_version", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, CAST(1 AS BIGINT) AS versions, CAST(1 AS BIGINT) AS made FROM orders")
def newest_version(spark, d):
    """Two versions are written, the newer is read, the older deleted; a part that is there isn't made again."""
    v = S.Versions(spark, new_path(spark, "versions"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    v.write("orders", orders, "1")
    v.write("orders", orders.withColumn("o_totalprice", F.col("o_totalprice") * 2), "2")
    v.delete("orders")
    made: list[int] = []
    for _ in range(2):
        v.once("part", lambda: made.append(1) or orders.limit(0))
    return v.read("orders").withColumns({"versions": F.lit(len(v.versions("orders"))).cast("long"), "made": F.lit(len(made)).cast("long")})


@query("lines_to_documents", r"SELECT conv_id, string_agg(regexp_replace(text, '[\r\n]+', ' ', 'g'), '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def lines_to_documents(spark, d):
    """Turns as line records with a blank one after each conversation, in a file a conversation."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[\r\n]+", " ").alias("text"))
    ends = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("\n").alias("text"))
    return C.line_groups(turns.unionByName(ends), "text", "turn", "conv_id").select("conv_id", "text")


@query("documents_of_a_stream", r"SELECT CAST(conv_id AS VARCHAR) AS file, string_agg(regexp_replace(text, '[\r\n]+', ' ', 'g'), '' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def documents_of_a_stream(spark, d):
    """The same as a stream of files of line records, two files a trigger."""
    from .streaming.documents import documents_stream
    from .streaming.windows import event_stream, run_once

    ship(spark)
    source, sink, state = (new_path(spark, f"stream-{k}") for k in ("in", "out", "state"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[\r\n]+", " ").alias("text"))
    ends = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("\n").alias("text"))
    lines = turns.unionByName(ends).select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line"), "text", F.timestamp_seconds(F.col("turn") + 1_700_000_000).alias("ts"))
    lines.repartition(4, "line").write.parquet(source)
    run_once(documents_stream(event_stream(spark, source, lines.schema, 2)), sink, state)
    return spark.read.parquet(sink).select("file", "text")
