"""Values and units from messy text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import not_blank, number_in, require_column, require_positive, unit_in
from ..plans.dedup_map import dedup_map
from ..providers import Provider, RuleProvider

INSTRUCTION = "Extract the numeric value and unit as-is."
FIELDS = T.StructType([T.StructField("clean_value", T.DoubleType()), T.StructField("clean_unit", T.StringType()), T.StructField("clean_reasoning", T.StringType())])


def clean(df: DataFrame, target_col: str, instruction: str = INSTRUCTION, *, provider: Provider | None = None, batch_size: int = 50, parallel: bool = False, max_workers: int | None = None) -> DataFrame:
    """Add ``clean_value``, ``clean_unit`` and ``clean_reasoning`` for the text of ``target_col``.

    With the rules these are column expressions: no shuffle, streams too. A model is asked once per
    distinct value. Null and blank text gives nulls; without any text the frame comes back as it is. Names
    that are taken get ``_right``. The distinct values are asked about where their shuffle leaves them;
    ``parallel`` spreads them over the session's parallelism, or over ``max_workers`` tasks.
    """
    require_column(df, target_col)
    require_positive(batch_size=batch_size)
    provider = provider or RuleProvider()
    text = F.col(target_col).cast("string")
    if type(provider) is RuleProvider:
        if not df.isStreaming and not df.select(text.alias("t")).filter(not_blank(F.col("t"))).head(1):
            return df
        value = number_in(text)
        found = value.isNotNull()
        made = {"clean_value": value, "clean_unit": F.when(found, unit_in(text)), "clean_reasoning": F.when(found, F.lit("first number and its unit"))}
        return df.withColumns({name + "_right" if name in df.columns else name: c for name, c in made.items()})

    def answer(items: list[str]) -> list[dict | None]:
        found = provider.clean_batch(items, instruction)
        return [None if (r := found.get(x)) is None else {"clean_value": float(r["value"]), "clean_unit": r["unit"], "clean_reasoning": r["reasoning"]} for x in items]

    tasks = (max(1, max_workers) if max_workers is not None else df.sparkSession.sparkContext.defaultParallelism) if parallel else None
    return dedup_map(df, target_col, answer, FIELDS, batch_size, tasks)
