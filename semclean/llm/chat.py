"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``### role\\n<text>text</turn>\\n``. ``###``, ``<text>`` and ``</turn>`` are control
tokens of the tokenizer, so token boundaries fall on them and nothing merges across a turn's text. Inside
roles and texts a backslash is doubled and control strings get one inside, so no control string is left;
taking each backslash off again restores the text exactly. Conversations are rendered whole and encoded
once with offsets; sorted spans of assistant texts meet the sorted token spans by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ["###", "<text>", "</turn>"]
_ESCAPE = re.compile(r"\\|#(?=##)|<(?=text>|/turn>|\|endoftext\|>)")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\n\\]|\\.)*)\n<text>(.*?)</turn>\n", re.DOTALL)
#: Code points after which a conversation goes on in a further row; a cut falls between two turns only.
CHUNK_CHARS = 1 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's rendering and the span of its text in it."""
    head = "### " + escape(role).replace("\n", "\\\n") + "\n<text>"
    body = escape(text)
    return head + body + "</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


@lru_cache(maxsize=2)
def _chat_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL])
    return made


@lru_cache(maxsize=2)
def _id_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each byte-level token."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = _chat_tokenizer(path).get_vocab(with_added_tokens=False)
    return {i: bytes(to_byte[c] for c in token) for token, i in vocab.items() if all(c in to_byte for c in token)}


def token_spans(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """First and past-last token of each char span, by binary search in sorted token offsets (n, 2)."""
    first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    return np.stack([first, np.maximum(first, last)], 1)


_OUT = "conv_id long, chunk int, n_turns int, formatted string, input_ids array<int>, loss_spans array<struct<start:int,end:int>>"


def _formatter(path: str, trained: str, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        conv, chunk, parts, spans, size, begun = None, 0, [], [], 0, False

        def close() -> None:
            ready.append((conv, chunk, len(parts), "".join(parts), np.array(spans, np.int64).reshape(-1, 2)))

        def flush() -> pa.RecordBatch:
            ids, masks = [], []
            for (*_, char_spans), e in zip(ready, _chat_tokenizer(path).encode_batch([r[3] for r in ready], add_special_tokens=False), strict=True):
                ids.append(e.ids)
                char_spans = char_spans[char_spans[:, 1] > char_spans[:, 0]]
                found = token_spans(np.array(e.offsets, np.int64).reshape(-1, 2), char_spans)
                masks.append([{"start": a, "end": b} for a, b in found.tolist()])
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            cols = [pa.array([r[i] for r in ready], k) for i, k in enumerate(kinds)]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            out = pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int32())), pa.array(masks, span)], names=["conv_id", "chunk", "n_turns", "formatted", "input_ids", "loss_spans"])
            ready.clear()
            return out

        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            for key, role, text in zip(get("conv_id"), get("role"), get("text"), strict=True):
                if begun and (key != conv or size > chunk_chars):
                    close()
                    chunk, parts, spans, size = (chunk + 1 if key == conv else 0), [], [], 0
                conv, begun = key, True
                segment, a, b = render(role or "", text or "")
                if role == trained:
                    spans.append((size + a, size + b))
                parts.append(segment)
                size += len(segment)
                if len(ready) >= 256 or (ready and sum(len(r[3]) for r in ready[-8:]) > 4 << 20):
                    yield flush()
        if begun:
            close()
        if ready:
            yield flush()

    return run


def format_chat(turns: DataFrame, tokenizer_file: str, trained: str = "assistant", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Render and encode conversations: conv_id, chunk, n_turns, formatted, input_ids, loss_spans.

    ``turns`` has conv_id, turn, role and text; a conversation's rows go by turn, ties by role and text. A
    null text or role is empty; a null ``conv_id`` is a conversation of its own; repeated rows are turns like
    any other; other columns are ignored; no rows give none. ``loss_spans`` are half-open ranges of
    ``input_ids``, those of the texts of turns by ``trained``. Rows of one conversation come one after another,
    chunks in order; a conversation beyond ``chunk_chars`` goes on in further rows, which a turn's control
    tokens make equal to encoding it whole, so no conversation is ever held in memory.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_formatter(tokenizer_file, trained, chunk_chars), _OUT)


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _id_bytes(path)
        conv, begun = None, False
        n = loss_chars = chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            for key, text, ids, spans in zip(get("conv_id"), get("formatted"), get("input_ids"), get("loss_spans"), strict=True):
                if begun and key != conv:
                    done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    n = loss_chars = chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                conv, begun = key, True
                for role, body in parse(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
                for s in spans:
                    masked = unescape(b"".join(map(table.__getitem__, ids[s["start"] : s["end"]])).decode())
                    loss.update(masked.encode())
                    loss_chars += len(masked)
                chars += len(text)
        if begun:
            done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)

    return run


def chat_digests(formatted: DataFrame, tokenizer_file: str) -> DataFrame:
    """What the formatter's output holds, read back: turns from the text, trained text from the masked ids.

    ``formatted`` as :func:`format_chat` returns it, with its rows in that order.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "input_ids", "loss_spans").mapInArrow(_reader(tokenizer_file), schema)
