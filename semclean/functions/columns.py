"""JVM-side column expressions shared by the operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHE_PREFIX = "v3"


def require_column(df: DataFrame, name: str, message: str = "Column '{}' not found in DataFrame") -> None:
    if name not in df.columns:
        raise ValueError(message.format(name))


def require_positive(**values: float) -> None:
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} must be >= 1")


def not_blank(col: Column) -> Column:
    """Not null and with a character that isn't Unicode white space."""
    return col.isNotNull() & col.rlike(r"(?U)\S")


def cache_key(instruction: str, text: Column) -> Column:
    """SHA-256 of version, instruction and text."""
    return F.sha2(F.concat(F.lit(f"{CACHE_PREFIX}::{instruction}::"), text), 256)


def row_key(columns: list[str]) -> Column:
    """A fingerprint of a row's values as text, whatever the columns' order; null reads ``None``."""
    parts = [F.struct(F.lit(c).alias("k"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("v")) for c in sorted(columns)]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def code_key(columns: list[str], dtypes: list[str], target_col: str, module_prefix: str) -> str:
    """A key of generated code from the shape of the table; the order of columns and types doesn't matter."""
    shape = [module_prefix, target_col] + [",".join(sorted(x)) for x in (columns, dtypes)]
    return hashlib.sha256("::".join(shape).encode()).hexdigest()


def populated(col: Column, kind: T.DataType) -> Column:
    """Whether a value carries content: not null, not a blank string, not an empty collection."""
    if isinstance(kind, T.StringType):
        return F.coalesce(not_blank(col), F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(col) > 0, F.lit(False)) & col.isNotNull()
    return col.isNotNull()


def field_f1(df: DataFrame, struct_col: str) -> Column:
    """Harmonic mean of field precision and recall over a struct column, for use in ``agg``.

    Precision counts populated fields of the structs that are there, recall of all rows.
    """
    fields = df.schema[struct_col].dataType.fields
    n = len(fields)
    if not n:
        return F.lit(0.0)
    good = F.coalesce(F.sum(sum((populated(F.col(struct_col)[f.name], f.dataType).cast("int") for f in fields), F.lit(0))), F.lit(0)).cast("double")
    extracted, expected = F.count_if(F.col(struct_col).isNotNull()) * n, F.count(F.lit(1)) * n
    precision, recall = F.try_divide(good, extracted), F.try_divide(good, expected)
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


# value and unit

NUMBER = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"


def number_in(text: Column) -> Column:
    """The first number, thousands commas dropped; null without one."""
    found = F.regexp_extract(text, f"({NUMBER})", 1)
    return F.when(found != "", F.regexp_replace(found, ",", "").cast("double"))


def unit_in(text: Column) -> Column:
    """The unit after the first number, else a currency sign before it, else an empty string."""
    after = F.regexp_extract(text, f"{NUMBER}\\s*([A-Za-z%°µ€£¥$][A-Za-z%°µ/²³]*)", 1)
    before = F.regexp_extract(text, f"([$€£¥])\\s*{NUMBER}", 1)
    return F.when(after != "", after).otherwise(before)
