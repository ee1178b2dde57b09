"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts. For each of K samples every term draws, from a hash of itself
and the sample's number, r and c from Gamma(2, 1) and b from U(0, 1); with weight w the term bids
ln a = ln c - r (t - b + 1), t = floor(ln w / r + b), and the lowest bid's (term, t) is the sample. Two
documents' samples agree with a probability equal to their generalised Jaccard similarity, the sum of
the smaller weights over the sum of the larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, mix64, range_bounds, shuffle_partitions, text_bytes, word_hashes

SAMPLES = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = mix64(np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) * _STEP).reshape(3, SAMPLES)


def _two_uniforms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.float32(2.0**-24)
    high = (x >> np.uint64(40)).astype(np.float32)
    low = (x & np.uint64(0xFFFFFF)).astype(np.float32)
    return (high + np.float32(0.5)) * scale, (low + np.float32(0.5)) * scale


def bids(terms: np.ndarray, weights: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """ln a and a 16-bit mark of (term, t), each of shape (terms, SAMPLES); functions of (term, weight) alone."""
    value, mark = np.empty((len(terms), SAMPLES), np.float32), np.empty((len(terms), SAMPLES), np.uint16)
    log_w = np.log(weights.astype(np.float32))
    for lo in range(0, len(terms), block):
        part = terms[lo : lo + block, None]
        u1, u2 = _two_uniforms(mix64(part ^ _SALT[0]))
        u3, u4 = _two_uniforms(mix64(part ^ _SALT[1]))
        last = mix64(part ^ _SALT[2])
        b, _ = _two_uniforms(last)
        r = -np.log(u1 * u2)
        t = np.floor(log_w[lo : lo + block, None] / r + b)
        value[lo : lo + block] = np.log(-np.log(u3 * u4)) - r * (t - b + np.float32(1))
        mark[lo : lo + block] = (mix64(last + t.astype(np.int64).astype(np.uint64) * _STEP) >> np.uint64(48)).astype(np.uint16)
    return value, mark


def signatures(texts: pa.Array) -> np.ndarray:
    """(texts, SAMPLES) marks; a text without words has none, and its row is zeros."""
    words, at = word_hashes(*text_bytes(texts))
    lengths = np.diff(at)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    terms, owner = words[first], owner[first]
    weights = np.diff(np.append(first, len(words)))
    order = np.lexsort((weights, terms))
    change = np.ones(len(order), bool)
    change[1:] = (terms[order][1:] != terms[order][:-1]) | (weights[order][1:] != weights[order][:-1])
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(change) - 1
    value, mark = bids(terms[order][change], weights[order][change])
    out = np.zeros((len(lengths), SAMPLES), np.uint16)
    ends = np.searchsorted(owner, np.arange(len(lengths) + 1))
    columns = np.arange(SAMPLES)
    for i in range(len(lengths)):
        rows = row[ends[i] : ends[i + 1]]
        if len(rows):
            best = rows[value[rows].argmin(0)]
            out[i] = mark[best, columns]
    return out


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """Share of equal samples; 1 for two texts without words, 0 if just one has none."""
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), (a == b).mean(1))


def _hex(rows: np.ndarray, empty: np.ndarray) -> list[str]:
    return ["" if e else r.astype(">u2").tobytes().hex() for r, e in zip(rows, empty, strict=True)]


def _wordless(texts: list[str]) -> np.ndarray:
    return np.array([not t.strip(" \t\n\v\f\r") for t in texts], bool)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex of ``SAMPLES`` 16-bit marks) of every row's whole text.

    A null, empty or blank text has an empty fingerprint; ids may be null or repeated; equal texts have equal
    fingerprints; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import sliced

        for batch in sliced(batches):
            texts = batch.column(batch.schema.get_field_index("text")).fill_null("")
            marks = _hex(signatures(texts), _wordless(texts.to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(marks)], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _compare(ids: list, texts: list[str], upcoming: str) -> pa.RecordBatch:
    following = [*texts[1:], upcoming]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    n = len(texts)
    everything = [*texts, upcoming, *edited]
    marks, empty = signatures(pa.array(everything, pa.large_string())), _wordless(everything)
    own, nxt, new = slice(0, n), slice(1, n + 1), slice(n + 1, None)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(_hex(marks[own], empty[own])),
            pa.array(_hex(marks[new], empty[new])),
            pa.array(likeness(marks[own], marks[new], empty[own], empty[new])),
            pa.array(likeness(marks[own], marks[nxt], empty[own], empty[nxt])),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, then the first row after it (``ahead``)."""
    ids: list = []
    texts: list[str] = []
    held, over = 0, False
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
        for key, text, ahead in zip(get("doc_id"), get("text"), get("ahead"), strict=True):
            text = text or ""
            if over:
                continue
            if ahead:
                over = True
                if ids:
                    yield _compare(ids, texts, text)
                    ids, texts = [], []
                continue
            if held > most and len(ids) > 1:
                yield _compare(ids, texts, text)
                ids, texts, held = [], [], 0
            ids.append(key)
            texts.append(text)
            held += len(text)


def compare_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, and compare them; see the contract of op7.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many
    of the next document's in ascending ``doc_id`` (after the last: the first). A null text is empty, a
    null id sorts first, rows with one id are ordered by text, other columns are ignored, an empty table
    gives no rows. One shuffle of the texts into ranges of ``doc_id``; the first row of each range also goes
    to the range before it, so no range waits for another.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(docs, "doc_id", parts or shuffle_partitions(docs))
    n = len(bounds) + 1
    lowest = docs.agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"))).alias("m")).first()["m"]
    first_id = lowest["b"] if lowest else None
    part = bucket_of("doc_id", bounds)
    begins = F.col("doc_id").eqNullSafe(F.lit(first_id).cast("long"))
    if bounds:
        begins = F.when(part > 0, F.col("doc_id") == F.element_at(F.array(*[F.lit(b) for b in bounds]), F.greatest(part, F.lit(1)))).otherwise(begins)
    here = F.struct(part.alias("part"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(part - 1, F.lit(n)).cast("int").alias("part"), F.lit(True).alias("ahead"))
    rows = docs.select("doc_id", "text", F.explode(F.when(begins, F.array(here, before)).otherwise(F.array(here))).alias("to"))
    rows = rows.select("doc_id", "text", "to.part", "to.ahead").repartitionById(n, F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", "text")
    return rows.mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
