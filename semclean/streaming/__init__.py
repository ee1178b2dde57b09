"""Operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pydantic import BaseModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import clean
from ..operators.extract import extract_compiled
from ..operators.quality import flag_rows
from ..operators.scrub import scrub


def scrub_stream(stream: DataFrame, target_col: str, strategies: list[str], mode: str = "mask") -> DataFrame:
    """Rule-based scrubbing; stateless."""
    return scrub(stream, strategies, mode, target_col=target_col)


def clean_stream(stream: DataFrame, target_col: str) -> DataFrame:
    return clean(stream, target_col)


def extract_stream(stream: DataFrame, target_col: str, schema: type[BaseModel], source: str | None = None) -> DataFrame:
    return extract_compiled(stream, target_col, schema, source=source)


def flag_stream(stream: DataFrame, rules: dict[str, str] | list[str]) -> DataFrame:
    return flag_rows(stream, rules)


def for_each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Run an operator that probes or asks a model on each micro-batch and append its result to Parquet at ``path``.

    A batch that is run again after a failure overwrites its own folder, so rows come once.
    """

    def one(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
