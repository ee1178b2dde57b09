"""How many rows keep the rules."""

from __future__ import annotations

import json
from typing import Any

from pydantic import BaseModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_positive
from ..functions.json_repair import parse
from ..plans.sampling import chunks, strided_rows
from ..providers import Provider


class RowCompliance(BaseModel):
    compliant: bool
    reasoning: str


def broken_rules(rules: dict[str, str] | list[str]) -> Column:
    """The names of the SQL rules that a row breaks; a rule that is null is broken."""
    named = rules if isinstance(rules, dict) else {r: r for r in rules}
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in named.items()]))


def flag_rows(df: DataFrame, rules: dict[str, str] | list[str]) -> DataFrame:
    """``df`` with ``compliant`` and ``reasoning`` by SQL rules; no shuffle, streams too."""
    if not rules:
        raise ValueError("At least one rule must be provided")
    marked = df.withColumn("__broken", broken_rules(rules))
    return marked.withColumn("compliant", F.size("__broken") == 0).withColumn("reasoning", F.concat_ws("; ", "__broken")).drop("__broken")


def quality_summary(df: DataFrame, rules: dict[str, str] | list[str]) -> DataFrame:
    """One row over all of ``df``: total_rows, passed_rows, compliance_rate (1 without rows)."""
    ok = F.coalesce(F.count_if("compliant"), F.lit(0)).cast("long")
    total = F.count(F.lit(1)).cast("long")
    return flag_rows(df, rules).agg(total.alias("total_rows"), ok.alias("passed_rows"), F.when(total == 0, 1.0).otherwise(F.round(ok / F.greatest(total, F.lit(1)), 4)).alias("compliance_rate"))


def validate_quality(df: DataFrame, rules: dict[str, str] | list[str], *, batch_size: int = 20, sample_size: int = 100, provider: Provider | None = None, order_by: list[str] | None = None) -> dict[str, Any]:
    """A report over a strided sample: total_rows, passed_rows, compliance_rate, failures (row, reasoning).

    Without a model the rules are SQL predicates, a mapping names them. With one they are plain language, a
    row at a time; a reply that can't be read is not compliant.
    """
    if not rules:
        raise ValueError("At least one rule must be provided")
    require_positive(batch_size=batch_size, sample_size=sample_size)
    sample = strided_rows(df, sample_size, order_by)
    if provider is None or provider.deterministic:
        rows = [r.asDict(recursive=True) for r in flag_rows(sample, rules).collect()]
        judged = [({k: v for k, v in r.items() if k not in ("compliant", "reasoning") or k in df.columns}, r["compliant"], r["reasoning"]) for r in rows]
    else:
        judged = []
        for part in chunks([r.asDict(recursive=True) for r in sample.collect()], batch_size):
            for row in part:
                reply = parse(provider.generate(f"Rules: {list(rules)}\nReply with JSON compliant (bool) and reasoning.\nInput: {json.dumps(row, default=str)}", RowCompliance), {}, lambda x: isinstance(x, dict))
                judged.append((row, reply.get("compliant") is True, str(reply.get("reasoning", "the reply can't be read"))))
    passed = sum(ok for _, ok, _ in judged)
    total = len(judged)
    return {"total_rows": total, "passed_rows": passed, "compliance_rate": round(passed / total, 4) if total else 1.0, "failures": [{"row": r, "reasoning": why} for r, ok, why in judged if not ok]}
