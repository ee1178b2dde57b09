"""The deterministic provider: the operators' statistical and textual definitions, without a model."""

from __future__ import annotations

import json
import re
from typing import Any

from ..functions.columns import NUMBER
from .base import Provider

_VALUE = re.compile(NUMBER)
_AFTER = re.compile(NUMBER + r"\s*([A-Za-z%°µ€£¥$][A-Za-z%°µ/²³]*)")
_BEFORE = re.compile(r"([$€£¥])\s*" + NUMBER)


class RuleProvider(Provider):
    """Number and unit by pattern; fields of a schema by name from ``name: value`` pairs or JSON in the text."""

    deterministic = True

    def clean_one(self, text: str) -> dict[str, Any] | None:
        m = _VALUE.search(text)
        if not m:
            return None
        unit = _AFTER.search(text) or _BEFORE.search(text)
        return {"reasoning": "first number and its unit", "value": float(m[0].replace(",", "")), "unit": unit[1] if unit else ""}

    def clean_batch(self, items: list[str], instruction: str) -> dict[str, dict[str, Any] | None]:
        return {x: self.clean_one(x) for x in items}

    def extract_one(self, text: str, fields: list[str]) -> dict[str, Any] | None:
        from ..functions.json_repair import parse

        if "{" in text and (found := parse(text[text.find("{") :], accept=lambda x: isinstance(x, dict))):
            return {f: found.get(f) for f in fields}
        out = {}
        for f in fields:
            m = re.search(rf"(?i)\b{re.escape(f)}\b\s*[:=]\s*(\"[^\"]*\"|[^\s,;]+)", text)
            out[f] = m[1].strip('"') if m else None
        return out if any(v is not None for v in out.values()) else None

    def generate(self, prompt: str, schema: type | None = None) -> str:
        text = prompt.rpartition("Input:")[2].strip() or prompt
        if schema is not None and hasattr(schema, "model_fields"):
            return json.dumps(self.extract_one(text, list(schema.model_fields)) or {})
        return json.dumps(self.clean_one(text) or {})
