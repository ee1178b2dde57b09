"""Choosing the instruction that extracts best."""

from __future__ import annotations

from pydantic import BaseModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import field_f1, require_column, require_positive
from ..functions.json_repair import parse
from ..plans.sampling import length_stratified
from ..plans.schema import require_model, struct_of
from ..providers import Provider, RuleProvider
from .extract import extract_one

VARIATIONS = 3


def variations(provider: Provider, baseline: str, n: int = VARIATIONS) -> list[str]:
    """``n`` other wordings; blanks go, what lacks is the baseline."""
    try:
        reply = parse(provider.generate(f"Reword this instruction {n} times as JSON with key variations: {baseline}"), {}, lambda x: isinstance(x, dict))
    except Exception:
        reply = {}
    found = [v for v in reply.get("variations", []) if isinstance(v, str) and v.strip()]
    return (found + [baseline] * n)[:n]


def score_candidates(df: DataFrame) -> DataFrame:
    """(candidate, f1) of ``df(candidate, extracted)``."""
    return df.groupBy("candidate").agg(field_f1(df, "extracted").alias("f1"))


def optimize_instruction(df: DataFrame, target_col: str, schema: type[BaseModel], baseline_instruction: str | None = None, *, sample_size: int = 20, max_retries: int = 3, provider: Provider | None = None) -> str:
    """The best of the baseline and three rewordings by field F1 on a sample; the earliest of equals.

    Candidates meet samples as rows of one small frame, so a model is asked for all of them in parallel.
    """
    require_column(df, target_col)
    require_model(schema)
    require_positive(sample_size=sample_size, max_retries=max_retries)
    provider = provider or RuleProvider()
    baseline = baseline_instruction or f"Extract {schema.__name__} information from the text."
    samples = length_stratified(df, target_col, sample_size)
    if not samples:
        return baseline
    candidates = [baseline, *variations(provider, baseline)]
    kind = struct_of(schema)
    spark = df.sparkSession
    pairs = spark.createDataFrame([(i, c, s) for i, c in enumerate(candidates) for s in samples], "candidate int, instruction string, value string")

    @F.udf(T.StringType())
    def ask(instruction: str, value: str) -> str | None:
        try:
            return extract_one(value, schema, instruction, provider, max_retries).model_dump_json()
        except ValueError:
            return None

    replies = pairs.withColumn("reply", ask.asNondeterministic()("instruction", "value"))
    scored = score_candidates(replies.select("candidate", F.from_json("reply", kind).alias("extracted")))
    best = scored.orderBy(F.desc("f1"), "candidate").first()
    return candidates[best.candidate]
