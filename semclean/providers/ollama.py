"""A local model server over HTTP, by the standard library."""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Any

from .base import Provider

log = logging.getLogger(__name__)
_PRESENT: set[tuple[str, str]] = set()


class OllamaProvider(Provider):
    """``generate`` posts to the server's API with the schema as its output format."""

    def __init__(self, model: str = "phi3", host: str = "http://localhost:11434", verbose: bool = False, timeout_s: float = 120.0) -> None:
        self.model, self.host, self.verbose, self.timeout_s = model, host.rstrip("/"), verbose, timeout_s

    def _call(self, path: str, body: dict | None = None, timeout_s: float | None = None) -> Any:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.host + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout_s or self.timeout_s) as reply:
            return json.loads(reply.read() or b"{}")

    def generate(self, prompt: str, schema: type | None = None) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False}
        if schema is not None:
            body["format"] = schema.model_json_schema()
        if self.verbose:
            log.info("prompt: %s", prompt)
        reply = self._call("/api/generate", body)["response"]
        if self.verbose:
            log.info("reply: %s", reply)
        return reply

    def alive(self, timeout_s: float = 3.0) -> bool:
        try:
            self._call("/api/tags", timeout_s=timeout_s)
            return True
        except (OSError, ValueError):
            return False

    def wait_until_alive(self, limit_s: float = 30.0, step_s: float = 0.5) -> None:
        """For the driver, before a job; executors never start servers."""
        until = time.monotonic() + limit_s
        while not self.alive():
            if time.monotonic() > until:
                raise ConnectionError(f"No model server at {self.host}")
            time.sleep(step_s)

    def models(self) -> list[str]:
        return [m["name"] for m in self._call("/api/tags").get("models", [])]

    def has_model(self, name: str | None = None) -> bool:
        name = name or self.model
        return any(m == name or m.startswith(name + ":") for m in self.models())

    def pull(self, name: str | None = None) -> Iterator[dict]:
        """Progress reports while the server fetches a model."""
        request = urllib.request.Request(self.host + "/api/pull", json.dumps({"name": name or self.model}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request) as reply:
            for line in reply:
                if line.strip():
                    yield json.loads(line)

    def ensure_model(self) -> None:
        """Pull the model unless it is there; asked once per process."""
        if (self.host, self.model) in _PRESENT:
            return
        if not self.has_model():
            for _ in self.pull():
                pass
        _PRESENT.add((self.host, self.model))
