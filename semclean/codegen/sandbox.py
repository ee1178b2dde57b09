"""Compiling generated functions with few builtins and listed modules only. Not a security boundary."""

from __future__ import annotations

import builtins
import importlib
import signal
import threading
from collections.abc import Callable
from functools import lru_cache
from typing import Any

_NAMES = """abs all any bool bytes chr complex dict divmod enumerate filter float format frozenset hasattr hash hex int
isinstance issubclass iter len list map max min next oct ord pow print range repr reversed round set slice sorted str sum
tuple type zip None True False Exception ValueError TypeError KeyError IndexError ZeroDivisionError AttributeError
RuntimeError StopIteration ArithmeticError OverflowError""".split()
SAFE_BUILTINS: dict[str, Any] = {n: getattr(builtins, n) for n in _NAMES if hasattr(builtins, n)}


class SandboxTimeout(RuntimeError):
    """A generated function ran too long."""


def compile_sandboxed(source: str, fn_name: str, allowed_modules: tuple[str, ...] | list[str] = ()) -> Callable[..., Any]:
    """The function ``fn_name`` of ``source``; ``ValueError`` if it doesn't compile, run or define it."""
    modules = {m: importlib.import_module(m) for m in allowed_modules}

    def restricted(name: str, globals=None, locals=None, fromlist=(), level: int = 0):
        if level or name.partition(".")[0] not in modules:
            raise ImportError(f"Import of '{name}' is not allowed")
        return builtins.__import__(name, globals, locals, fromlist, level)

    space: dict[str, Any] = {"__builtins__": {**SAFE_BUILTINS, "__import__": restricted}, "__name__": "generated", **modules}
    try:
        exec(compile(source, "<generated>", "exec"), space)
    except Exception as why:
        raise ValueError(f"Compilation failed: {why}") from why
    made = space.get(fn_name)
    if not callable(made):
        raise ValueError(f"Function '{fn_name}' not found in the source")
    return made


@lru_cache(maxsize=64)
def compiled(source: str, fn_name: str, allowed_modules: tuple[str, ...] = ()) -> Callable[..., Any]:
    """Once per Python worker: executors get the source, never the function."""
    return compile_sandboxed(source, fn_name, allowed_modules)


def run_with_timeout(fn: Callable[..., Any], *args: Any, timeout_s: float = 2.0) -> tuple[Any, str]:
    """(result, "") or (None, what went wrong). On a main thread a timer interrupts the call; elsewhere it runs in a thread that is given up on."""
    if timeout_s <= 0:
        raise ValueError("timeout_s must be > 0")
    if threading.current_thread() is threading.main_thread():

        def ring(*_: Any) -> None:
            raise SandboxTimeout(f"timed out after {timeout_s} s")

        before = signal.signal(signal.SIGALRM, ring)
        signal.setitimer(signal.ITIMER_REAL, timeout_s)
        try:
            return fn(*args), ""
        except Exception as why:
            return None, str(why) or type(why).__name__
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    box: list[tuple[Any, str]] = []

    def work() -> None:
        try:
            box.append((fn(*args), ""))
        except Exception as why:
            box.append((None, str(why) or type(why).__name__))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(timeout_s)
    return box[0] if box else (None, f"timed out after {timeout_s} s")
