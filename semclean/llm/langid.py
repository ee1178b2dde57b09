"""Language identification by a byte convolutional network trained here in numpy.

Filters of widths 2, 3 and 4 slide over the bytes of fixed-length windows, their maxima over a window go
through a ReLU into a softmax. A convolution over one-hot bytes is a sum of table rows, so applying it
takes two look-ups of byte pairs per position, for all filters at once. Windows overlap by three bytes,
so a text's windows hold every one of its byte n-grams; a text's prediction is the softmax of its
windows' mean log-probabilities, weighted by the bytes they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, sliced, text_bytes, text_column

WINDOW, OVERLAP = 256, 3
WIDTHS = {2: 8, 3: 12, 4: 12}
#: The training sample: at most about this many documents of a language, and windows of a document.
DOCS_PER_LANG, WINDOWS_PER_DOC = 600, 8
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class ByteConvNet:
    """Parameters and passes of the network; ``labels`` are the learned language values."""

    def __init__(self, labels: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        n = sum(WIDTHS.values())
        self.labels = labels
        self.shape = np.zeros((4, 1, n), np.float32)
        at = 0
        for width, count in WIDTHS.items():
            self.shape[:width, :, at : at + count] = 1
            at += count
        self.table = (rng.normal(0, 0.3, (4, 256, n)).astype(np.float32)) * self.shape
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.3, (n, len(labels))).astype(np.float32)
        self.shift = np.zeros(len(labels), np.float32)
        self.pairs: tuple[np.ndarray, np.ndarray] | None = None

    def train(self, windows: np.ndarray, target: np.ndarray, steps: int = 700, batch: int = 128, rate: float = 0.02) -> None:
        """Adam on the cross-entropy; the gradient of a maximum goes to the bytes where it was reached."""
        rng = np.random.default_rng(11)
        params = [self.table, self.bias, self.out, self.shift]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        per = np.bincount(target, minlength=len(self.labels)).astype(float)
        chance = (1 / per[target]) / (1 / per[target]).sum()
        for step in range(1, steps + 1):
            pick = rng.choice(len(windows), batch, p=chance)
            x, y = windows[pick], target[pick]
            act = sum(self.table[k][x[:, k : WINDOW - 3 + k]] for k in range(4))
            where = act.argmax(1)
            top = np.take_along_axis(act, where[:, None], 1)[:, 0] + self.bias
            hidden = np.maximum(top, 0)
            score = hidden @ self.out + self.shift
            score -= score.max(1, keepdims=True)
            soft = np.exp(score)
            soft /= soft.sum(1, keepdims=True)
            soft[np.arange(batch), y] -= 1
            soft /= batch
            d_hidden = (soft @ self.out.T) * (top > 0)
            d_table = np.zeros_like(self.table)
            filters = np.broadcast_to(np.arange(act.shape[2]), where.shape)
            for k in range(4):
                np.add.at(d_table[k], (np.take_along_axis(x, where + k, 1), filters), d_hidden)
            grads = [d_table * self.shape, d_hidden.sum(0), hidden.T @ soft, soft.sum(0)]
            now = rate * (1 - step / (steps + 1))
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)

    def _pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self.pairs is None:
            t = self.table
            self.pairs = tuple((t[k][:, None] + t[k + 1][None]).reshape(65536, -1) for k in (0, 2))
        return self.pairs

    def log_probabilities(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        """One row per window (folded bytes), one column per label."""
        first, second = self._pair_tables()
        n, f = WINDOW - 3, len(self.bias)
        pooled = np.empty((len(windows), f), np.float32)
        a, b = np.empty((block * n, f), np.float32), np.empty((block * n, f), np.float32)
        for lo in range(0, len(windows), block):
            x = windows[lo : lo + block].astype(np.intp)
            pair = x[:, :-1] * 256 + x[:, 1:]
            m = len(x)
            np.take(first, pair[:, :n].ravel(), axis=0, out=a[: m * n], mode="clip")
            np.take(second, pair[:, 2:].ravel(), axis=0, out=b[: m * n], mode="clip")
            np.add(a[: m * n], b[: m * n], out=a[: m * n])
            pooled[lo : lo + m] = a[: m * n].reshape(m, n, f).max(1)
        score = np.maximum(pooled + self.bias, 0) @ self.out + self.shift
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))


def cut_windows(text: np.ndarray) -> np.ndarray:
    """All windows of a text's bytes, folded to lower case; the last is filled up with spaces."""
    step = WINDOW - OVERLAP
    count = max(1, -(-(len(text) - OVERLAP) // step))
    padded = np.full(count * step + OVERLAP, 32, np.uint8)
    padded[: len(text)] = _FOLD[text]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows spread over each whole text."""
    for batch in sliced(batches):
        data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
        lang = batch.column(batch.schema.get_field_index("lang"))
        rows, owner = [], []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            cut = cut_windows(data[a:b])
            take = np.unique(np.linspace(0, len(cut) - 1, WINDOWS_PER_DOC).astype(int))
            rows += [w.tobytes() for w in cut[take]]
            owner += [i] * len(take)
        yield pa.RecordBatch.from_arrays([lang.take(pa.array(owner, pa.int64())), pa.array(rows, pa.binary())], names=["lang", "bytes"])


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string")) % 5


def train(docs: DataFrame) -> ByteConvNet | None:
    """Fit the network on a bounded sample of the labelled rows of ``docs(doc_id, text, lang)``.

    Used are rows with text and lang whose crc32(doc_id) mod 5 isn't 0 (a null id: none of them): about
    ``DOCS_PER_LANG`` documents of each language, chosen by a hash of the id, and of each up to
    ``WINDOWS_PER_DOC`` windows spread over the whole text. None without such rows.
    """
    usable = docs.filter((remainder(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, DOCS_PER_LANG / n))])
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    limit = 2 * DOCS_PER_LANG * WINDOWS_PER_DOC * len(counts)
    rows = sorted(map(tuple, chosen.select("text", "lang").mapInArrow(_sampler, "lang string, bytes binary").limit(limit).collect()))
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    net = ByteConvNet(labels)
    windows = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(-1, WINDOW)
    net.train(windows, np.array([labels.index(r[0]) for r in rows]))
    return net


def _predictor(net: ByteConvNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=2 << 20):
            texts = text_column(batch)
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if net and _LETTER.search(t)]
            if known:
                data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
                cuts = [cut_windows(data[at[i] : at[i + 1]]) for i in known]
                begins = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
                logp = net.log_probabilities(np.concatenate(cuts))
                weight = np.full(len(logp), float(WINDOW - OVERLAP))
                size = np.array([at[i + 1] - at[i] for i in known])
                weight[begins[1:] - 1] = np.maximum(1, size - (np.diff(begins) - 1) * (WINDOW - OVERLAP))
                mean = np.add.reduceat(logp * weight[:, None], begins[:-1]) / np.add.reduceat(weight, begins[:-1])[:, None]
                soft = np.exp(mean - mean.max(1, keepdims=True))
                soft /= soft.sum(1, keepdims=True)
                for i, row in zip(known, soft, strict=True):
                    names[i], scores[i] = net.labels[int(row.argmax())], float(row.max())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(names), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return lean(run)


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs(doc_id, text, ...)``, whole texts.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or nothing was learned;
    a null id is not held out; repeated rows get the same answer; other columns are never read.
    """
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(_predictor(net), "doc_id long, held_out boolean, lang_pred string, score double")


def _marker(net: ByteConvNet | None, least: float):
    run_inner = _predictor(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=2 << 20):
            text = batch.select(["text"]) if hasattr(batch, "select") else batch
            (got,) = run_inner(iter([text]))
            pred, score = got.column(0).to_pylist(), got.column(1).to_numpy()
            yield batch.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score, strict=True)]))

    return lean(run)


def keep_identified(docs: DataFrame, net: ByteConvNet | None, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose text has a language: not ``und``, and a score of ``least``.

    Null, empty and letterless texts go; very long texts are read whole; repeated rows go or stay together;
    ids don't matter; an empty table gives no rows.
    """
    return docs.mapInArrow(_marker(net, least), docs.schema)
