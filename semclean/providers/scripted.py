"""A provider that plays back replies, for tests and dry runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

from .base import Provider


class ScriptedProvider(Provider):
    """``replies`` in turn (the last again and again) or by a function of the prompt; ``delay_s`` a call."""

    def __init__(self, replies: Sequence[str] | Callable[[str], str] = (), cleaned: dict[str, dict[str, Any] | None] | None = None, delay_s: float = 0.0) -> None:
        self.replies, self.cleaned, self.delay_s = replies, cleaned, delay_s
        self.prompts: list[str] = []

    def generate(self, prompt: str, schema: type | None = None) -> str:
        self.prompts.append(prompt)
        if self.delay_s:
            time.sleep(self.delay_s)
        if callable(self.replies):
            return self.replies(prompt)
        if not self.replies:
            raise RuntimeError("no reply scripted")
        return self.replies[min(len(self.prompts), len(self.replies)) - 1]

    def clean_batch(self, items: list[str], instruction: str) -> dict[str, dict[str, Any] | None]:
        if self.cleaned is None:
            return super().clean_batch(items, instruction)
        if self.delay_s:
            time.sleep(self.delay_s * len(items))
        return {x: self.cleaned.get(x) for x in items}
