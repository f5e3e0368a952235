"""A cache of responses to requests, for several writers.

Responses are kept by the hash of (method, args) in immutable parts, one a commit, each partitioned by the hash's
first digit. A part counts once its _SUCCESS file is there, so readers see whole commits only and writers never
touch each other's: no response is lost. A request that two writers answered has the answer of the least part name.
`compact` writes one part that stands for the ones it lists; `vacuum` deletes those.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = "0123456789abcdef"


def request_hash() -> Column:
    return F.sha2(F.to_json(F.struct("method", "args"), {"ignoreNullFields": "false"}), 256)


class ResponseCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def parts(self) -> list[str]:
        """Finished parts that no finished part stands for."""
        done = [n for n in self._names("parts") if self._fs.exists(self._path(f"{self.root}/parts/{n}/_SUCCESS"))]
        gone = {r["value"] for n in done if n in self._names("lists") for r in self.spark.read.text(f"{self.root}/lists/{n}").collect()}
        return [n for n in done if n not in gone]

    def read(self) -> DataFrame:
        """(hash, digit, response), each hash once."""
        paths = [f"{self.root}/parts/{n}" for n in self.parts()]
        if not paths:
            return self.spark.createDataFrame([], "hash string, digit string, response string")
        rows = [self.spark.read.schema("hash string, response string, digit string").parquet(p).withColumn("part", F.lit(i)) for i, p in enumerate(paths)]
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        return every.groupBy("hash", "digit").agg(F.min_by("response", "part").alias("response"))

    def put(self, answered: DataFrame) -> str:
        """Commit (hash, response) rows as a part; its name."""
        rows = answered.groupBy("hash").agg(F.min("response").alias("response"))
        name = f"p-{uuid.uuid4().hex}"
        rows.withColumn("digit", F.substring("hash", 1, 1)).write.partitionBy("digit").parquet(f"{self.root}/parts/{name}")
        return name

    def ask(self, requests: DataFrame, respond: Callable[[DataFrame], DataFrame], steps: int = 4) -> DataFrame:
        """Requests (method, args, ...) with `response`. Those that aren't known are given to `respond`, each once, in
        `steps` commits by hash, so a run that ends early keeps what it has. `respond` takes (hash, method, args) and adds `response`."""
        hashed = requests.withColumn("hash", request_hash())
        for k in range(steps):
            digits = [d for i, d in enumerate(DIGITS) if i % steps == k]
            mine = F.substring("hash", 1, 1).isin(digits)
            known = self.read().where(F.col("digit").isin(digits)).select("hash")
            new = hashed.where(mine).select("hash", "method", "args").dropDuplicates(["hash"]).join(known, "hash", "left_anti")
            if not new.isEmpty():
                self.put(respond(new).select("hash", "response"))
        return hashed.join(self.read().select("hash", "response"), "hash", "left").drop("hash")

    def compact(self) -> str | None:
        """One part for all finished ones; None if there is nothing to join. Its list is written before it, and counts with it."""
        old = self.parts()
        if len(old) < 2:
            return None
        name = f"c-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(n,) for n in old], "value string").coalesce(1).write.text(f"{self.root}/lists/{name}")
        self.read().repartition("digit").write.partitionBy("digit").parquet(f"{self.root}/parts/{name}")
        return name

    def vacuum(self) -> int:
        """Delete parts that another one stands for; readers that began before may still need them."""
        keep, gone = set(self.parts()), 0
        for n in self._names("parts"):
            if n not in keep and self._fs.exists(self._path(f"{self.root}/parts/{n}/_SUCCESS")):
                self._fs.delete(self._path(f"{self.root}/parts/{n}"), True)
                gone += 1
        return gone
