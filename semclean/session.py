"""One object with a session and a provider, and the operators as its methods."""

from __future__ import annotations

from typing import Any

from pydantic import BaseModel
from pyspark.sql import DataFrame

from .config import load_config
from .operators import clean as _clean
from .operators import entities, extract, features, optimize, oversample, profile, quality, shred
from .operators import scrub as _scrub
from .providers import Provider, create_provider

_SHARED: list[Provider] = []


def get_provider(**settings: Any) -> Provider:
    """The shared provider of the configuration, or a new one if anything is set."""
    given = {k: v for k, v in settings.items() if v is not None}
    if given:
        return create_provider(**load_config(**given).model_dump())
    if not _SHARED:
        _SHARED.append(create_provider(**load_config().model_dump()))
    return _SHARED[0]


class SemClean:
    """The operators with one provider."""

    def __init__(self, provider: Provider | None = None, **settings: Any) -> None:
        self.provider = provider or get_provider(**settings)

    def clean(self, df: DataFrame, target_col: str, instruction: str = _clean.INSTRUCTION, **options: Any) -> DataFrame:
        return _clean.clean(df, target_col, instruction, provider=self.provider, **options)

    def scrub(self, data: DataFrame | str, strategies: list[str] | None = None, mode: str = "mask", **options: Any) -> DataFrame | str:
        return _scrub.scrub(data, strategies, mode, provider=self.provider, **options)

    def extract(self, data: DataFrame | str, schema: type[BaseModel], instruction: str | None = None, **options: Any) -> Any:
        return extract.extract(data, schema, instruction, provider=self.provider, **options)

    def extract_compiled(self, df: DataFrame, target_col: str, schema: type[BaseModel], instruction: str | None = None, **options: Any) -> DataFrame:
        return extract.extract_compiled(df, target_col, schema, instruction, provider=self.provider, **options)

    def optimize_instruction(self, df: DataFrame, target_col: str, schema: type[BaseModel], baseline_instruction: str | None = None, **options: Any) -> str:
        return optimize.optimize_instruction(df, target_col, schema, baseline_instruction, provider=self.provider, **options)

    def resolve_entities(self, df: DataFrame, target_col: str, **options: Any) -> DataFrame:
        return entities.resolve_entities(df, target_col, provider=self.provider, **options)

    def validate_quality(self, df: DataFrame, rules: Any, **options: Any) -> dict[str, Any]:
        return quality.validate_quality(df, rules, provider=self.provider, **options)

    def oversample(self, df: DataFrame, target_col: str, target_value: Any, n: int, schema: type[BaseModel] | None = None, **options: Any) -> DataFrame:
        return oversample.oversample(df, target_col, target_value, n, schema, provider=self.provider, **options)

    def shred_to_relations(self, df: DataFrame, target_col: str, **options: Any) -> dict[str, DataFrame]:
        return shred.shred_to_relations(df, target_col, provider=self.provider, **options)

    def discover_features(self, df: DataFrame, target_col: str, **options: Any) -> DataFrame:
        return features.discover_features(df, target_col, provider=self.provider, **options)

    def prune_traps(self, df: DataFrame, target_col: str, **options: Any) -> tuple[DataFrame, dict[str, Any]]:
        return profile.prune_traps(df, target_col, provider=self.provider, **options)

    def recognize_missingness(self, df: DataFrame, target_cols: list[str] | None = None, **options: Any) -> tuple[DataFrame, dict[str, Any]]:
        return profile.recognize_missingness(df, target_cols, provider=self.provider, **options)

    def audit_leakage(self, df: DataFrame, target_col: str, domain: str = "", **options: Any) -> tuple[DataFrame, dict[str, Any]]:
        return profile.audit_leakage(df, target_col, domain, provider=self.provider, **options)
