"""A cleaning job as JSON on standard input, its result as JSON on standard output."""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from pydantic import BaseModel, Field, ValidationError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config import load_config
from ..operators.clean import INSTRUCTION, clean
from ..providers import create_provider

OK, INVALID_PAYLOAD, PIPELINE_ERROR, SERIALIZATION_ERROR = 0, 1, 2, 3


class Payload(BaseModel):
    target_col: str
    data: list[dict[str, Any]]
    batch_size: int = Field(50, ge=1)
    engine_config: dict[str, Any] = Field({})
    instruction: str = INSTRUCTION


def _kind(values: list[Any]) -> T.DataType:
    there = [v for v in values if v is not None]
    if there and all(isinstance(v, bool) for v in there):
        return T.BooleanType()
    if there and all(isinstance(v, int) and not isinstance(v, bool) for v in there):
        return T.LongType()
    if there and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in there):
        return T.DoubleType()
    return T.StringType()


def frame_of(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    """Records as a frame; a column's type fits all of its values, what is nested becomes JSON text."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    schema = T.StructType([T.StructField(n, _kind([r.get(n) for r in rows])) for n in names])

    def fit(v: Any, kind: T.DataType) -> Any:
        if v is None:
            return None
        if isinstance(kind, T.DoubleType):
            return float(v)
        return v if not isinstance(kind, T.StringType) or isinstance(v, str) else json.dumps(v)

    return spark.createDataFrame([tuple(fit(r.get(f.name), f.dataType) for f in schema) for r in rows], schema)


def run_pipeline(spark: SparkSession, payload: Payload) -> dict[str, Any]:
    config = load_config(spark, **payload.engine_config)
    df = frame_of(spark, payload.data)
    out = clean(df, payload.target_col, payload.instruction, provider=create_provider(**config.model_dump()), batch_size=payload.batch_size)
    rows = [r.asDict(recursive=True) for r in out.collect()]
    return {"row_count": len(rows), "status": "ok", "data": rows}


def main(spark: SparkSession | None = None, source: TextIO | None = None, sink: TextIO | None = None) -> int:
    """The exit code: 0, or 1 for the payload, 2 for the pipeline, 3 for writing the result."""
    source, sink = source or sys.stdin, sink or sys.stdout

    def fail(code: int, why: str) -> int:
        sink.write(json.dumps({"message": why, "code": code, "status": "error"}))
        return code

    try:
        payload = Payload(**json.loads(source.read()))
    except (ValidationError, ValueError, TypeError) as why:
        return fail(INVALID_PAYLOAD, f"Invalid payload: {why}")
    try:
        result = run_pipeline(spark or SparkSession.builder.getOrCreate(), payload)
    except Exception as why:
        return fail(PIPELINE_ERROR, f"Pipeline error: {why}")
    try:
        sink.write(json.dumps(result))
    except (TypeError, ValueError) as why:
        return fail(SERIALIZATION_ERROR, f"Serialization error: {why}")
    return OK
