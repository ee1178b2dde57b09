"""Caches of replies (a Parquet table met by joins) and of generated code (a small database on the driver)."""

from __future__ import annotations

import sqlite3
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cache_key

SCHEMA = "hash_key string, json_response string, last_access double"


class ResultCache:
    """Replies by SHA-256 of version, instruction and text; no limit on the size of a batch.

    A hit is a join, a miss an anti join. The first reply of a key stays, nulls are never stored, and a
    reply that isn't JSON counts as a miss.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception:
            return self.spark.createDataFrame([], SCHEMA)

    def split(self, values: DataFrame, instruction: str) -> tuple[DataFrame, DataFrame]:
        """(value, reply) of ``values(value)`` that are known, and the (value) that aren't."""
        keyed = values.withColumn("hash_key", cache_key(instruction, F.col("value")))
        known = self.table().filter(F.try_parse_json("json_response").isNotNull()).groupBy("hash_key").agg(F.min_by("json_response", "last_access").alias("reply"))
        return keyed.join(known, "hash_key").select("value", "reply"), keyed.join(known, "hash_key", "left_anti").select("value")

    def append(self, replies: DataFrame, instruction: str) -> None:
        """Store ``replies(value, reply)``."""
        rows = replies.filter(F.col("reply").isNotNull()).select(cache_key(instruction, F.col("value")).alias("hash_key"), F.col("reply").alias("json_response"), F.lit(time.time()).alias("last_access"))
        rows.write.mode("append").parquet(self.path)

    def get_batch(self, items: list[str], instruction: str) -> dict[str, str]:
        hits, _ = self.split(self.spark.createDataFrame([(x,) for x in dict.fromkeys(items)], "value string"), instruction)
        return {r.value: r.reply for r in hits.collect()}

    def set_batch(self, replies: dict[str, str | None], instruction: str) -> None:
        self.append(self.spark.createDataFrame(list(replies.items()), "value string, reply string"), instruction)

    def compact(self) -> DataFrame:
        """The table with one row per key, for rewriting a cache that has grown."""
        return self.table().groupBy("hash_key").agg(F.min_by("json_response", "last_access").alias("json_response"), F.max("last_access").alias("last_access"))


class CodeCache:
    """Generated source by key; the last one stored counts."""

    def __init__(self, path: str | Path) -> None:
        self.path = str(path)
        Path(self.path).parent.mkdir(parents=True, exist_ok=True)
        with self._open() as db:
            db.execute("create table if not exists code_cache (hash_key text primary key, source_code text not null, last_access real)")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path)

    def get_code(self, key: str) -> str | None:
        with self._open() as db:
            row = db.execute("select source_code from code_cache where hash_key = ?", (key,)).fetchone()
            if row:
                db.execute("update code_cache set last_access = ? where hash_key = ?", (time.time(), key))
        return row[0] if row else None

    def set_code(self, key: str, source: str) -> None:
        with self._open() as db:
            db.execute("insert or replace into code_cache values (?, ?, ?)", (key, source, time.time()))


def temporary_cache(spark: SparkSession, folder: str) -> ResultCache:
    return ResultCache(spark, f"{folder}/cache-{uuid.uuid4().hex[:8]}")
