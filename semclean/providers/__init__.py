"""Where judgement comes from: rules, scripts for tests, or a model over HTTP."""

from .base import Provider
from .ollama import OllamaProvider
from .rules import RuleProvider
from .scripted import ScriptedProvider

__all__ = ["OllamaProvider", "Provider", "RuleProvider", "ScriptedProvider", "create_provider"]


def create_provider(engine: str = "rules", model: str = "phi3", host: str = "http://localhost:11434", api_key: str | None = None, verbose: bool = False) -> Provider:
    """The provider by name; a cloud one isn't there yet."""
    if engine == "rules":
        return RuleProvider()
    if engine == "ollama":
        return OllamaProvider(model=model, host=host, verbose=verbose)
    if engine in ("openai", "anthropic", "gemini"):
        raise NotImplementedError(f"Engine '{engine}' is not implemented")
    raise ValueError(f"Unknown engine '{engine}'")
