"""Scoring operators on cases with known answers."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.extract import extract_one
from .operators.scrub import scrub
from .plans.schema import model_from_fields
from .providers import Provider, RuleProvider
from .tracking import Tracker

PASS = 0.5


@dataclass
class Case:
    """``task`` is clean, scrub or extract; ``metadata`` may hold strategies, fields, instruction, pii_tokens."""

    input: str
    expected_output: str
    task: str = "clean"
    metric: str = "exact_match"
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass
class Result:
    case: Case
    actual: str
    score: float
    passed: bool
    details: str


@dataclass
class Summary:
    results: list[Result]

    @property
    def mean_score(self) -> float:
        return self._average([r.score for r in self.results])

    @property
    def pass_rate(self) -> float:
        return self._average([float(r.passed) for r in self.results])

    @staticmethod
    def _average(values: list[float]) -> float:
        return sum(values) / max(1, len(values))


def exact_match(actual: str, expected: str, metadata: dict | None = None) -> tuple[float, str]:
    same = actual.strip() == expected.strip()
    return float(same), "equal" if same else f"expected {expected!r}, got {actual!r}"


def partial_json_match(actual: str, expected: str, metadata: dict | None = None) -> tuple[float, str]:
    """Share of the expected object's top-level keys with equal values."""
    try:
        a, e = json.loads(actual), json.loads(expected)
    except ValueError as why:
        return 0.0, f"no JSON: {why}"
    if not (isinstance(a, dict) and isinstance(e, dict)):
        return 0.0, "objects are needed on both sides"
    hits = [k for k in e if k in a and a[k] == e[k]]
    return (len(hits) / len(e) if e else 1.0), f"{len(hits)} of {len(e)} keys"


def pii_masking_recall(actual: str, expected: str, metadata: dict | None = None) -> tuple[float, str]:
    """Share of ``metadata['pii_tokens']`` that are gone."""
    tokens = (metadata or {}).get("pii_tokens") or []
    gone = [t for t in tokens if t not in actual]
    return (len(gone) / len(tokens) if tokens else 1.0), f"{len(gone)} of {len(tokens)} tokens"


METRICS = {"exact_match": exact_match, "partial_json_match": partial_json_match, "pii_masking_recall": pii_masking_recall}


def get_metric(name: str):
    if name not in METRICS:
        raise ValueError(f"Unknown metric '{name}'. Available: {', '.join(sorted(METRICS))}")
    return METRICS[name]


class Evaluator:
    """Runs cases through the scalar paths, which are the operators' own."""

    def __init__(self, provider: Provider | None = None, tracker: Tracker | None = None) -> None:
        self.provider, self.tracker = provider or RuleProvider(), tracker

    def _run(self, case: Case) -> str:
        m = case.metadata
        if case.task == "clean":
            return json.dumps(self.provider.clean_batch([case.input], m.get("instruction", ""))[case.input])
        if case.task == "scrub":
            return scrub(case.input, m.get("strategies"), m.get("mode", "mask"), provider=self.provider)
        if case.task == "extract":
            return extract_one(case.input, model_from_fields(m["fields"]), m.get("instruction", "Extract."), self.provider).model_dump_json()
        raise ValueError(f"Unknown task '{case.task}'")

    def run(self, cases: list[Case]) -> Summary:
        """A case that fails has an empty output."""
        run_id = self.tracker.start_run("semclean-eval", {"num_cases": len(cases)}) if self.tracker else None
        results = []
        for i, case in enumerate(cases):
            try:
                actual = self._run(case)
            except Exception:
                actual = ""
            score, details = get_metric(case.metric)(actual, case.expected_output, case.metadata)
            results.append(Result(case, actual, score, score >= PASS, details))
            if self.tracker:
                self.tracker.log_step(run_id, f"case_{i}_{case.task}", case.input, actual, {"metric": case.metric, "expected": case.expected_output})
                self.tracker.log_score(run_id, case.metric, score, details)
        summary = Summary(results)
        if self.tracker:
            self.tracker.log_score(run_id, "mean_score", summary.mean_score, f"pass rate {summary.pass_rate:.2%}")
            self.tracker.end_run(run_id)
        return summary


# tables


def exact_match_col(actual: Column, expected: Column) -> Column:
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return (strip(actual) == strip(expected)).cast("double")


def masking_recall_col(actual: Column, tokens: Column) -> Column:
    gone = F.size(F.filter(tokens, lambda t: ~F.contains(actual, t)))
    return F.when(F.size(tokens) > 0, gone / F.size(tokens)).otherwise(1.0)


def summarize(scored: DataFrame, score_col: str = "score") -> DataFrame:
    """One row: cases, mean_score, pass_rate."""
    s = F.col(score_col)
    return scored.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.avg(s), F.lit(0.0)).alias("mean_score"), F.coalesce(F.avg((s >= PASS).cast("double")), F.lit(0.0)).alias("pass_rate"))
