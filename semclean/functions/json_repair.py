"""Reading JSON as models write it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*\n?|\n?\s*```\s*$")
_WORDS = {"True": "true", "False": "false", "None": "null", "NaN": "null", "undefined": "null"}


class _Reader:
    """A forgiving recursive-descent reader: missing commas, quotes and closers are supplied."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at] if self.at < len(self.text) else ""

    def value(self) -> Any:
        ch = self.peek()
        if ch == "{":
            return self.object()
        if ch == "[":
            return self.array()
        if ch in "\"'":
            return self.string(ch)
        return self.bare()

    def object(self) -> dict:
        self.at += 1
        out: dict = {}
        while (ch := self.peek()) and ch != "}":
            if ch in ",;":
                self.at += 1
                continue
            if ch == "]":
                return out
            key = self.string(ch) if ch in "\"'" else self.word(":,}]")
            if self.peek() == ":":
                self.at += 1
                out[str(key)] = None if self.peek() in ("", ",", "}") else self.value()
            elif not str(key):
                self.at += 1
        self.at += 1
        return out

    def array(self) -> list:
        self.at += 1
        out: list = []
        while (ch := self.peek()) and ch != "]":
            if ch == ",":
                self.at += 1
            elif ch == "}":
                return out
            else:
                before = self.at
                out.append(self.value())
                if self.at == before:
                    self.at += 1
        self.at += 1
        return out

    def string(self, quote: str) -> str:
        self.at += 1
        out = []
        while self.at < len(self.text):
            ch = self.text[self.at]
            if ch == "\\" and self.at + 1 < len(self.text):
                out.append(self.text[self.at : self.at + 2])
                self.at += 2
                continue
            self.at += 1
            if ch == quote:
                break
            out.append({"\n": "\\n", "\t": "\\t", "\r": "\\r", '"': '\\"'}.get(ch, ch))
        raw = "".join(out).replace("\\'", "'")
        try:
            return json.loads(f'"{raw}"')
        except ValueError:
            return raw

    def word(self, stops: str) -> str:
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] not in stops + "\n":
            self.at += 1
        return self.text[begin : self.at].strip()

    def bare(self) -> Any:
        word = self.word(",]}")
        try:
            return json.loads(_WORDS.get(word, word))
        except ValueError:
            return word


def repair_json(text: str) -> str:
    """Valid JSON from nearly valid: fences and prose around it, trailing commas, single quotes, Python words,
    unclosed strings, lists and objects. A text without an object or list comes back as it is."""
    try:
        json.loads(text)
        return text
    except (TypeError, ValueError):
        pass
    if not isinstance(text, str):
        return text
    body = _FENCE.sub("", text)
    starts = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    if not starts:
        return text
    reader = _Reader(body[min(starts) :])
    return json.dumps(reader.value(), ensure_ascii=False)


def parse(reply: Any, default: Any = None, accept: Callable[[Any], bool] | None = None) -> Any:
    """A model's reply as data: a mapping as it is, else JSON, else repaired JSON, else ``default``."""
    accept = accept or (lambda x: isinstance(x, (dict, list)))
    if not isinstance(reply, str):
        return reply if accept(reply) else default
    for attempt in (reply, repair_json(reply)):
        try:
            found = json.loads(attempt)
        except ValueError:
            continue
        if accept(found):
            return found
    return default


def verdict_array(reply: str) -> list:
    """The JSON list between the first ``[`` and the last ``]`` of a reply."""
    begin, end = reply.find("["), reply.rfind("]")
    if begin < 0 or end < begin:
        raise ValueError("No JSON array in the reply")
    found = json.loads(repair_json(reply[begin : end + 1]))
    if not isinstance(found, list):
        raise ValueError("No JSON array in the reply")
    return found
