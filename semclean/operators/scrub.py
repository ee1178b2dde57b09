"""Personal data out of text."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pii
from ..functions.columns import require_column
from ..functions.json_repair import parse
from ..plans.dedup_map import dedup_map
from ..providers import Provider

DEFAULT = ["person", "phone", "email"]


def model_entities(text: str, strategies: list[str], provider: Provider | None) -> list[pii.Entity]:
    """People and addresses by a model; positions are looked up in the text. None without provider or valid reply."""
    wanted = [s for s in strategies if s in pii.MODEL_STRATEGIES]
    if not wanted or provider is None or provider.deterministic:
        return []
    try:
        reply = parse(provider.generate(f"List all {', '.join(wanted)} entities as JSON with key entities (type, value).\nInput: {text}"), accept=lambda x: isinstance(x, dict))
    except Exception:
        return []
    out = []
    for e in (reply or {}).get("entities", []):
        if isinstance(e, dict) and e.get("value") and e.get("type") in pii.STRATEGIES:
            out += [pii.Entity(e["type"], e["value"], a, b) for a, b in pii.find_all_positions(text, e["value"])]
    return out


def detect(text: str, strategies: list[str] | None = None, provider: Provider | None = None) -> list[pii.Entity]:
    strategies = DEFAULT if strategies is None else strategies
    return pii.detect(text, strategies, model_entities(text, strategies, provider))


def scrub(data: DataFrame | str, strategies: list[str] | None = None, mode: str = "mask", locale: str = "en_US", *, target_col: str | None = None, provider: Provider | None = None) -> DataFrame | str:
    """Replace entities by ``[TYPE]`` or by fakes, in a string or in a column.

    Strategies by rule run in one Arrow batch function where the rows are, on streams too. People and
    addresses need a model, which sees each distinct value once. Blank and null values stay.
    """
    strategies = DEFAULT if strategies is None else list(strategies)
    if mode not in ("mask", "fake"):
        raise ValueError(f"mode must be 'mask' or 'fake', got {mode!r}")
    if isinstance(data, str):
        return pii.replace_entities(data, detect(data, strategies, provider), mode, locale)
    if target_col is None:
        raise ValueError("target_col required for DataFrame input")
    require_column(data, target_col)
    text = F.col(target_col).cast("string")
    if provider is None and set(strategies) & pii.MODEL_STRATEGIES:
        warnings.warn(f"{sorted(set(strategies) & pii.MODEL_STRATEGIES)} need a provider; without one they stay in place", stacklevel=2)
    if provider is None or provider.deterministic or not set(strategies) & pii.MODEL_STRATEGIES:
        return data.withColumn(target_col, F.coalesce(pii.scrubbed(text, strategies, mode, locale), text))

    def answer(items: list[str]) -> list[dict | None]:
        return [{"__scrubbed": pii.replace_entities(x, detect(x, strategies, provider), mode, locale)} for x in items]

    mapped = dedup_map(data, target_col, answer, T.StructType([T.StructField("__scrubbed", T.StringType())]))
    if "__scrubbed" not in mapped.columns:
        return data
    return mapped.withColumn(target_col, F.coalesce("__scrubbed", text)).drop("__scrubbed")


def detected(df: DataFrame, target_col: str, strategies: list[str] | None = None, as_col: str = "entities") -> DataFrame:
    """Add the entities themselves."""
    require_column(df, target_col)
    return df.withColumn(as_col, pii.entities(F.col(target_col).cast("string"), DEFAULT if strategies is None else list(strategies)))


def masking_recall(actual: pd.Series, tokens: pd.Series) -> pd.Series:
    """Share of the known tokens that are gone; 1 without any."""
    return pd.Series([1.0 if t is None or not len(t) else sum(x not in a for x in t) / len(t) for a, t in zip(actual, tokens, strict=True)])
