"""What a provider answers. Providers are small and picklable; executors get them as they are."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any


class Provider(ABC):
    """Free generation and batch cleaning. ``deterministic`` ones have rules that operators use instead of prompts."""

    deterministic = False

    @abstractmethod
    def generate(self, prompt: str, schema: type | None = None) -> str:
        """A reply to ``prompt``; JSON of ``schema`` if one is given."""

    def clean_batch(self, items: list[str], instruction: str) -> dict[str, dict[str, Any] | None]:
        """For each item reasoning, value and unit, or None; a reply without all three is None."""
        from ..functions.json_repair import parse

        out: dict[str, dict[str, Any] | None] = {}
        for item in items:
            try:
                found = parse(self.generate(f"Instruction: {instruction}\nInput: {item}\nReply with JSON keys reasoning, value, unit."), accept=lambda x: isinstance(x, dict))
            except Exception:
                found = None
            whole = found is not None and all(k in found for k in ("reasoning", "value", "unit"))
            out[item] = {k: found[k] for k in ("reasoning", "value", "unit")} if whole else None
        return out
