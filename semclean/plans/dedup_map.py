"""Mapping each distinct value once and joining the answers back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import not_blank

#: A mapping of at most so many rows and bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary one only where it is unset on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="semclean-")
    return _LOCAL[spark.sparkContext.applicationId]


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back, so that a model isn't asked again when the plan is evaluated again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """(value): the column's distinct non-blank values as strings; only this column is read."""
    return df.select(F.col(column).cast("string").alias("value")).filter(not_blank(F.col("value"))).distinct()


def map_values(values: DataFrame, fn: Callable[[list[str]], list[dict | None]], fields: T.StructType, batch_size: int = 50, tasks: int | None = None) -> DataFrame:
    """(value, *fields): ``fn`` answers ``batch_size`` values at a time on the executors.

    A batch that fails answers null for all of its values and never fails the task.
    """
    schema = T.StructType([T.StructField("value", T.StringType()), *fields.fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            items = frame["value"].tolist()
            for i in range(0, len(items), batch_size):
                part = items[i : i + batch_size]
                try:
                    answers = fn(part)
                except Exception:
                    answers = [None] * len(part)
                rows += [{"value": v, **(a or {})} for v, a in zip(part, answers, strict=True)]
            yield pd.DataFrame(rows, columns=schema.names).astype({f.name: object for f in fields.fields})

    if tasks:
        values = values.repartition(tasks)
    return values.mapInPandas(run, schema)


def is_small(mapping: DataFrame) -> bool:
    """Whether the rows, and their values as JSON, are few enough to broadcast."""
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*mapping.columns)))), F.lit(0))
    row = mapping.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).first()
    return row["n"] <= BROADCAST_ROWS and row["bytes"] <= BROADCAST_BYTES


def join_back(df: DataFrame, column: str, mapping: DataFrame, prefix: str = "") -> DataFrame:
    """Left join of ``mapping(value, ...)`` on the column's text; a name that ``df`` has gets ``_right``.

    Null and blank texts have no answer: in a join by shuffle they stay spread, by the partition they come from.
    """
    named = {c: c + "_right" if c in df.columns else c for c in mapping.columns if c != "value"}
    side = mapping.select(F.col("value").alias("__value"), *[F.col(c).alias(prefix + n) for c, n in named.items()])
    text = F.col(column).cast("string")
    if is_small(mapping):
        return df.join(F.broadcast(side), text == F.col("__value"), "left").drop("__value")
    spread = df.withColumn("__salt", F.when(not_blank(text), F.lit(0)).otherwise(F.spark_partition_id() + 1))
    side = side.withColumn("__zero", F.lit(0))
    return spread.join(side, (text == F.col("__value")) & (F.col("__salt") == F.col("__zero")), "left").drop("__value", "__salt", "__zero")


def dedup_map(df: DataFrame, column: str, fn: Callable[[list[str]], list[dict | None]], fields: T.StructType, batch_size: int = 50, tasks: int | None = None) -> DataFrame:
    """``df`` with ``fields`` of each row's value; ``df`` itself if no value is there to map.

    The mapping is computed once per distinct value and kept; null and blank values get nulls. On a
    stream nothing can be probed or kept: use it in ``foreachBatch``.
    """
    values = distinct_values(df, column)
    if not values.head(1):
        return df
    return join_back(df, column, persisted(map_values(values, fn, fields, batch_size, tasks), "map"))
