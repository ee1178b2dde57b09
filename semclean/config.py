"""Settings: what is passed, then ``SEMCLEAN_*`` variables, Spark's ``spark.semclean.*``, ``[tool.semclean]`` of the nearest pyproject.toml, defaults."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path
from typing import Any, Literal

from pydantic import BaseModel, ConfigDict
from pyspark.sql import SparkSession


class EngineConfig(BaseModel):
    """Which provider, and how to reach it; unknown keys are refused."""

    model_config = ConfigDict(extra="forbid")

    engine: Literal["rules", "ollama", "openai", "anthropic", "gemini"] = "rules"
    model: str = "phi3"
    host: str = "http://localhost:11434"
    api_key: str | None = None
    verbose: bool = False


def _flag(text: str) -> bool:
    return text.strip().lower() in {"true", "1", "yes", "on"}


def _from_file() -> dict[str, Any]:
    here = Path.cwd()
    for folder in (here, *here.parents):
        try:
            found = tomllib.loads((folder / "pyproject.toml").read_text(encoding="utf-8")).get("tool", {}).get("semclean")
        except (OSError, tomllib.TOMLDecodeError):
            continue
        if found is not None:
            return dict(found)
    return {}


def _texts(get) -> dict[str, Any]:
    found = {name: get(name) for name in EngineConfig.model_fields}
    return {k: _flag(v) if k == "verbose" else v for k, v in found.items() if v is not None}


def load_config(spark: SparkSession | None = None, **runtime: Any) -> EngineConfig:
    merged = _from_file()
    if spark is not None:
        merged |= _texts(lambda n: spark.conf.get(f"spark.semclean.{n}", None))
    merged |= _texts(lambda n: os.environ.get(f"SEMCLEAN_{n.upper()}"))
    merged |= {k: v for k, v in runtime.items() if v is not None}
    return EngineConfig(**merged)
