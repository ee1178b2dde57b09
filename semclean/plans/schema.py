"""Pydantic models and DDL strings as Spark types, and validated values on their way back."""

from __future__ import annotations

import datetime
import decimal
import types
import typing
from typing import Any

from pydantic import BaseModel, TypeAdapter, create_model
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_SCALARS = {str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), bytes: T.BinaryType(), decimal.Decimal: T.DecimalType(38, 18), datetime.datetime: T.TimestampType(), datetime.date: T.DateType()}
SHELL_TYPES = {"str": str, "int": int, "float": float, "bool": bool}


def require_model(schema: Any) -> None:
    if not (isinstance(schema, type) and issubclass(schema, BaseModel)):
        raise ValueError(f"Schema must be a Pydantic BaseModel subclass, got {schema!r}")


def spark_type(hint: Any) -> T.DataType:
    """The Spark type of a Python annotation; what has none is a string."""
    if hint in _SCALARS:
        return _SCALARS[hint]
    if isinstance(hint, type) and issubclass(hint, BaseModel):
        return struct_of(hint)
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        return spark_type(rest[0]) if len(rest) == 1 else T.StringType()
    if origin is typing.Annotated:
        return spark_type(args[0])
    if origin in (list, set, frozenset, tuple) or hint in (list, set, tuple):
        return T.ArrayType(spark_type(args[0]) if args else T.StringType())
    if origin is dict or hint is dict:
        return T.MapType(T.StringType(), spark_type(args[1]) if len(args) > 1 else T.StringType())
    if origin is typing.Literal:
        return spark_type(type(args[0]))
    return T.StringType()


def struct_of(model: type[BaseModel]) -> T.StructType:
    """A nullable field for each field of the model, in order."""
    return T.StructType([T.StructField(name, spark_type(f.annotation), True) for name, f in model.model_fields.items()])


def model_from_fields(tokens: list[str]) -> type[BaseModel]:
    """A model of required ``name:type`` fields with types str, int, float and bool."""
    fields: dict[str, Any] = {}
    for token in tokens:
        name, colon, kind = (x.strip() for x in token.partition(":"))
        if not colon:
            raise ValueError(f"Invalid schema field '{token}'. Expected name:type")
        if kind.lower() not in SHELL_TYPES:
            raise ValueError(f"Unknown type '{kind}' for field '{name}'. Supported: {', '.join(SHELL_TYPES)}")
        fields[name] = (SHELL_TYPES[kind.lower()], ...)
    if not fields:
        raise ValueError("Schema must have at least one field.")
    return create_model("Fields", **fields)


def ddl_of(model: type[BaseModel]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in struct_of(model))


def plain(value: Any, kind: T.DataType) -> Any:
    """A validated value in the shape that Arrow expects for ``kind``."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        data = value.model_dump() if isinstance(value, BaseModel) else dict(value)
        return {f.name: plain(data.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return [plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return [(str(k), plain(v, kind.valueType)) for k, v in value.items()]
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return str(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    return value


def to_models(df: DataFrame, struct_col: str, model: type[BaseModel]) -> list[BaseModel | None]:
    """The struct column as models on the driver, in the frame's order; for small results."""
    check = TypeAdapter(model)
    return [None if r[0] is None else check.validate_python(r[0].asDict(recursive=True)) for r in df.select(struct_col).collect()]
