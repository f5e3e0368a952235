"""Readers of table corpora, results and texts; versioned storage."""

from __future__ import annotations

import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations", "labels", "pages", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parquet_tables(spark: SparkSession, folder: str, per_topic: int | None = None, repair: bool = True) -> DataFrame:
    """One table per file: name, topic, path, header, rows (all cells text).

    Schemas differ by file, so files come whole (`binaryFile`) and are decoded in pandas batches; duplicate
    column names are kept. `per_topic` takes that many files of each folder, by name.
    """
    from ..operators.normalize import repair_header
    from ..operators.sampling import top_per_group

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    parts = F.split("path", "/")
    files = files.select("path", F.element_at(parts, -2).alias("topic"), F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)).alias("name"), "content")
    if per_topic is not None:
        names = top_per_group(files.select("topic", "path"), ["topic"], per_topic, "path")
        files = files.join(names, ["topic", "path"], "left_semi")
    out = files.mapInPandas(_decoded, "name string, topic string, path string, header array<string>, rows array<array<string>>")
    if repair:
        header, rows = repair_header(F.col("header"), F.col("rows"))
        out = out.withColumns({"header": header, "rows": rows})
    return out


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for b in batches:
        out = []
        for path, topic, name, content in zip(b["path"], b["topic"], b["name"], b["content"], strict=True):
            t = pq.ParquetFile(io.BytesIO(content)).read()
            columns = [["" if v is None else str(v) for v in c.to_pylist()] for c in t.columns]
            out.append((name, topic, path, list(t.schema.names), [list(r) for r in zip(*columns, strict=True)]))
        yield pd.DataFrame(out, columns=["name", "topic", "path", "header", "rows"])


def json_tables(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Tables as JSON lines {name, header, rows}."""
    df = spark.read.schema("name string, header array<string>, rows array<array<string>>").json(path)
    return df.limit(most) if most is not None else df


def result_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Sample logs of many models (JSON lines): nested document fields on top, model name from the folder."""
    schema = "doc_id long, doc struct<table_idx:long,question_number:long,question:string,answer:string,aggregator:string,aggregation_num_rows:long>, resps array<array<string>>, filtered_resps array<string>, exact_match double"
    df = spark.read.schema(schema).json(pattern).withColumn("model_name", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return df.select("doc_id", "doc.*", "resps", "filtered_resps", "exact_match", "model_name")


def run_metadata(spark: SparkSession, pattern: str) -> DataFrame:
    """Run settings (one JSON object a file): few-shot numbers of each task, length, time."""
    schema = "system_instruction string, chat_template string, configs map<string, struct<num_fewshot:long>>, fewshot_as_multiturn boolean, max_length long, total_evaluation_time_seconds string"
    df = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("model_name", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return df.select("model_name", "system_instruction", "chat_template", "fewshot_as_multiturn", "max_length", F.col("total_evaluation_time_seconds").cast("double").alias("seconds"), F.explode_outer("configs").alias("task", "config")).select("*", "config.num_fewshot").drop("config")


def tracker_table(spark: SparkSession, pattern: str) -> DataFrame:
    """Tables kept as {columns, data}: one row a data row, cells by position, as a map by column name."""
    df = spark.read.schema("columns array<string>, data array<array<string>>").json(pattern, multiLine=True)
    return df.select("columns", F.posexplode("data").alias("row", "cells")).select("row", F.map_from_arrays("columns", "cells").alias("values"))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Selected columns under new names; dots reach nested fields."""
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and number (order inside a file)."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def write_splits(df: DataFrame, path: str, text: str = "text", split: str = "split") -> None:
    """A folder of text files for each split."""
    df.select(F.regexp_replace(text, r"[\r\n]+", " ").alias("value"), split).write.partitionBy(split).mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, codec: str = "gzip", by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", codec)
    (w.partitionBy(by) if by else w).json(path)


def _zstd_lines(batches):
    """Lines of zstandard files; a file is decompressed piece by piece."""
    import io

    import pyarrow as pa
    import zstandard

    for batch in batches:
        for content in batch.column("content"):
            reader = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_buffer()), read_across_frames=True), "utf-8")
            held: list[str] = []
            for line in reader:
                held.append(line.rstrip("\n"))
                if len(held) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])


def read_archive(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """Texts of JSON-lines archives, a file or a folder: a record's `text`, or a bare JSON string; the rest of a record as `meta`.

    Files ending in .zst are decompressed in Python (whole files come as one value each, so below 2 GB);
    others (.jsonl, .json, .txt, .gz, .bz2) are read by Spark.
    """
    zstd = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(path).select("content").mapInArrow(_zstd_lines, "value string")
    lines = zstd.unionByName(spark.read.option("pathGlobFilter", "*.{jsonl,json,txt,gz,bz2}").text(path).select("value"))
    bare = F.from_json(F.concat(F.lit('{"t":'), "value", F.lit("}")), "t string")["t"]
    one = F.when(F.col("value").startswith('"'), bare).otherwise(F.get_json_object("value", f"$.{text}"))
    return lines.select(one.alias(text), F.get_json_object("value", "$.meta").alias("meta"))


class Versions:
    """Timestamped versions of frames below <root>/<name>; readers take the newest finished one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, name: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(v for v in done if self._fs(f"{self.root}/{name}/{v}/_SUCCESS")[0].exists(self._fs(f"{self.root}/{name}/{v}/_SUCCESS")[1]))

    def write(self, name: str, df: DataFrame, version: str | None = None) -> str:
        version = version or datetime.now(UTC).strftime("%y%m%d_%H%M_%S_%f")
        df.write.parquet(f"{self.root}/{name}/{version}")
        return version

    def read(self, name: str, version: str | None = None) -> DataFrame:
        version = version or (self.versions(name) or [None])[-1]
        if version is None:
            raise FileNotFoundError(f"no version of {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def delete(self, name: str, keep_latest: bool = True) -> None:
        for v in self.versions(name)[: -1 if keep_latest else None]:
            fs, p = self._fs(f"{self.root}/{name}/{v}")
            fs.delete(p, True)

    def once(self, name: str, make) -> DataFrame:
        """The newest version, or a first one made now: parts of a long job that a rerun skips."""
        if not self.versions(name):
            self.write(name, make())
        return self.read(name)


def cached_responses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (method, args) with the response of their hash, null if there is none."""
    key = F.sha2(F.to_json(F.struct("method", "args")), 256)
    return requests.withColumn("hash", key).join(cache.select("hash", "response"), "hash", "left")


