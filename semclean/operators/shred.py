"""Log lines into several tables."""

from __future__ import annotations

from pydantic import BaseModel, Field
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import code_key, require_column, require_positive
from ..functions.json_repair import parse
from ..plans.sampling import length_stratified
from ..providers import Provider
from ..sources.cache import CodeCache
from .extract import generate_verified, struct_udf

MODULES = ("re", "json", "datetime", "collections")


class Table(BaseModel):
    """A table of the relational schema; keys describe, nothing enforces them."""

    name: str
    columns: list[str]
    primary_key: str = ""
    foreign_key: str | None = None


class Relational(BaseModel):
    tables: list[Table] = Field(min_length=2)


def _struct(tables: list[Table]) -> T.StructType:
    text = lambda names: T.StructType([T.StructField(c, T.StringType()) for c in names])
    return T.StructType([T.StructField(t.name, text(t.columns)) for t in tables])


def _check(tables: list[Table]):
    def check(found: object) -> None:
        if not isinstance(found, dict):
            raise ValueError("extract_relations must return a dict")
        lacking = [t.name for t in tables if t.name not in found]
        if lacking:
            raise ValueError(f"missing tables {lacking}")

    return check


def infer_schema(samples: list[str], provider: Provider, max_retries: int = 3) -> Relational:
    why: Exception | None = None
    for _ in range(max_retries):
        try:
            return Relational.model_validate(parse(provider.generate("Infer at least two related tables (name, columns, primary_key, foreign_key) for these logs, as JSON with key tables:\n" + "\n".join(samples), Relational)))
        except Exception as error:
            why = error
    raise ValueError("Failed to parse relational schema") from why


def shred_to_relations(df: DataFrame, target_col: str, *, sample_size: int = 30, max_retries: int = 3, provider: Provider | None = None, schema: Relational | None = None, source: str | None = None, cache: CodeCache | None = None) -> dict[str, DataFrame]:
    """One frame per table, one row per input row, all columns strings; ``{}`` if no working code comes about.

    With ``schema`` and ``source`` given nothing is sampled, so streams work too. A row that fails is null in
    every table. The parser is one Arrow batch function; a table's frame reads its own part of the struct.
    """
    require_column(df, target_col)
    require_positive(sample_size=sample_size, max_retries=max_retries)
    if schema is None or source is None:
        if provider is None:
            raise ValueError("a provider is needed to infer the schema and the parser")
        samples = length_stratified(df, target_col, sample_size, always_sorted=True)
        if not samples:
            raise ValueError(f"No valid entries in column '{target_col}'")
        schema = schema or infer_schema(samples, provider, max_retries)
        key = code_key([target_col], [t.name for t in schema.tables], target_col, "shredder")
        source = source or (cache.get_code(key) if cache else None)
        if source is None:
            prompt = f"Write Python extract_relations(log) -> dict of tables {[(t.name, t.columns) for t in schema.tables]}.\nSamples:\n" + "\n".join(samples)
            try:
                source = generate_verified(prompt, "extract_relations", samples[:5], _check(schema.tables), provider, max_retries, MODULES)
            except ValueError:
                return {}
            if cache:
                cache.set_code(key, source)
    made = struct_udf(source, "extract_relations", _struct(schema.tables), MODULES)(F.col(target_col).cast("string"))
    wide = df.select(made.alias("r"))
    return {t.name: wide.select(*[F.col("r")[t.name][c].alias(c) for c in t.columns]) for t in schema.tables}
