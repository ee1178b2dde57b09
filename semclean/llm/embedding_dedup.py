"""Near-duplicate embeddings by product quantisation.

Unit vectors are put into coarse inverted lists; the residual to a list's centre is coded by subspace. A
query probes its nearest lists, scores members by asymmetric table look-ups, drops those whose score plus
the member's own quantisation error can't reach the threshold (by Cauchy-Schwarz nothing that links is
dropped there), and takes the exact cosine of the rest in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import components

#: Bounds of the training sample and of the number of coarse lists, and members of a list per block.
SAMPLE, MOST_LISTS, PER_LIST, BLOCK = 20_000, 4096, 100, 2048


@dataclass
class Codebook:
    """Coarse centres (lists, dim) and residual centres (subspaces, codes, width)."""

    centres: np.ndarray
    codes: np.ndarray

    @property
    def subspaces(self) -> int:
        return len(self.codes)

    def assign(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, nearest first."""
        score = x @ self.centres.T - 0.5 * (self.centres**2).sum(1)
        n = min(n, score.shape[1])
        near = np.argpartition(-score, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable")
        return np.take_along_axis(near, order, 1).astype(np.int32)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the norm of what the codes leave out."""
        rest = x - self.centres[lists]
        width = self.codes.shape[2]
        out = np.empty((len(x), self.subspaces), np.uint8)
        for m, book in enumerate(self.codes):
            part = rest[:, m * width : (m + 1) * width]
            out[:, m] = (part @ book.T - 0.5 * (book**2).sum(1)).argmax(1)
            part -= book[out[:, m]]
        return out, np.sqrt((rest.astype(np.float64) ** 2).sum(1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, subspaces, codes) inner products."""
        width = self.codes.shape[2]
        return np.stack([q[:, m * width : (m + 1) * width] @ book.T for m, book in enumerate(self.codes)], 1)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=k)
        filled = np.flatnonzero(count)
        begin = np.searchsorted(near[order], filled)
        centres[filled] = np.add.reduceat(x[order], begin) / count[filled][:, None]
        lost = np.flatnonzero(count == 0)
        centres[lost] = x[rng.choice(len(x), len(lost))]
    return centres


def train(sample: np.ndarray, n_rows: int, subspaces: int = 8, seed: int = 3) -> Codebook:
    """Fit on unit vectors; about ``PER_LIST`` of ``n_rows`` vectors to a list."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    while dim % subspaces:
        subspaces -= 1
    lists = int(min(MOST_LISTS, max(1, n_rows // PER_LIST), max(1, len(sample) // 4)))
    centres = kmeans(sample, lists, 6, rng)
    rest = sample - centres[(sample @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)]
    few = rest[rng.choice(len(rest), min(len(rest), 8000), replace=False)]
    width = dim // subspaces
    return Codebook(centres, np.stack([kmeans(few[:, m * width : (m + 1) * width].copy(), min(256, len(few)), 5, rng) for m in range(subspaces)]))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors only: id, dimension, a hash of the direction, the raw floats as bytes."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        keep, blobs, dims = [], [], []
        for i, v in enumerate(lists):
            if not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            with np.errstate(over="ignore"):
                norm = np.sqrt((x * x).sum())
            if not np.isfinite(x).all() or not x.any():
                continue
            if not np.isfinite(norm) or norm < 1e-150:
                x = x / np.abs(x).max()
            keep.append(i)
            blobs.append(x.tobytes())
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "dim", "v"])


def _units(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return raw, (raw / np.sqrt((raw * raw).sum(1, keepdims=True))).astype(np.float32)


def _coder(book: Codebook, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, x = _units(batch.column(batch.schema.get_field_index("v")).to_pylist())
            near = book.assign(x, probes)
            code, error = book.encode(x, near[:, 0])
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("c", "v")]
            probed = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*keep, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), probed], names=["c", "v", "code", "error", "probed"])

    return run


def _searcher(book: Codebook, least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        queries, members = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        a, b = [], []
        if queries.num_rows and members.num_rows:
            raw_q, q = _units(queries.column("v").to_pylist())
            raw_x, _ = _units(members.column("v").to_pylist())
            qc, xc = queries.column("c").to_numpy(), members.column("c").to_numpy()
            code = np.frombuffer(b"".join(members.column("code").to_pylist()), np.uint8).reshape(len(raw_x), -1)
            error = members.column("error").to_numpy()
            norm_q, norm_x = np.sqrt((raw_q * raw_q).sum(1)), np.sqrt((raw_x * raw_x).sum(1))
            for lo in range(0, len(q), 256):
                part = q[lo : lo + 256]
                lookup = book.tables(part)
                score = np.repeat((part @ book.centres[cell])[:, None], len(code), 1)
                for m in range(code.shape[1]):
                    score += lookup[:, m, code[:, m]]
                i, j = np.nonzero(score + error[None, :] >= least - 1e-4)
                i += lo
                apart = qc[i] != xc[j]
                i, j = i[apart], j[apart]
                for at in range(0, len(i), 50_000):
                    s, t = i[at : at + 50_000], j[at : at + 50_000]
                    dots = np.einsum("ij,ij->i", raw_q[s], raw_x[t]) / (norm_q[s] * norm_x[t])
                    hit = dots >= least
                    a.append(np.minimum(qc[s[hit]], xc[t[hit]]))
                    b.append(np.maximum(qc[s[hit]], xc[t[hit]]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def class_links(classes: DataFrame, least: float = 0.9, probes: int = 16) -> DataFrame:
    """Pairs (a, b), a < b, of linked classes; ``classes`` has c (long), dim and v (doubles as bytes).

    Members of a list are cut into blocks by a hash, queries of a list likewise, and each (list, query
    block, member block) is one bounded task; blocks follow the list's counted size, so a list with a third
    of all vectors is many tasks.
    """
    spark, out = classes.sparkSession, None
    for (dim,) in classes.select("dim").distinct().collect():
        own = classes.filter(F.col("dim") == dim)
        n = own.count()
        fraction = min(1.0, SAMPLE / n)
        sample = own.filter(F.pmod(F.xxhash64(F.lit("pq"), "c"), F.lit(1 << 30)) < int(fraction * (1 << 30))).orderBy(F.xxhash64("c"), "c").limit(SAMPLE)
        drawn = sample.select("v").collect() or own.limit(1).select("v").collect()
        book = train(_units([bytes(r[0]) for r in drawn])[1], n)
        coded = materialize(own.select("c", "v").mapInArrow(_coder(book, probes), "c long, v binary, code binary, error double, probed array<int>"), "coded")
        members = coded.groupBy(F.element_at("probed", 1).alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("xs"))
        askers = coded.select(F.explode("probed").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qs"))
        sizes = members.join(askers, "cell")  # a list's row each: at most MOST_LISTS of them
        h = F.xxhash64("c")
        x = coded.withColumn("cell", F.element_at("probed", 1)).join(F.broadcast(sizes), "cell")
        x = x.select("cell", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), F.pmod(h, F.col("xs")).cast("int").alias("xb"), F.lit(False).alias("is_query"), "c", "v", "code", "error")
        q = coded.select("c", "v", F.explode("probed").alias("cell")).join(F.broadcast(sizes), "cell")
        q = q.select("cell", F.pmod(h, F.col("qs")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"), F.lit(True).alias("is_query"), "c", "v", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"))
        found = x.unionByName(q).groupBy("cell", "qb", "xb").applyInArrow(_searcher(book, least), "a long, b long").distinct()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "a long, b long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, probes: int = 16) -> DataFrame:
    """Links of ``vectors(vec_id, embedding, ...)`` by cosine: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths don't link; rows with one and the same vector are one class, linked with each other,
    and searched once; a null ``vec_id`` is a row like any other (its component_id is null only if all of
    its component are); other columns are ignored; an empty table gives no rows.
    """
    usable = vectors.select("vec_id", "embedding").mapInArrow(_unit, "vec_id long, dim int, v binary")
    rows = materialize(usable.withColumn("key", F.sha2("v", 256)), "vectors")
    classes = rows.groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"), F.any_value("dim").alias("dim"), F.any_value("v").alias("v"))
    classes = materialize(classes.withColumn("c", F.xxhash64("key", F.lit(1))), "classes")
    links = materialize(class_links(classes.select("c", "dim", "v"), least, probes), "links")
    sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = classes.select("c", "size")
    degree = sides.join(size, sides["b"] == size["c"]).groupBy("a").agg(F.sum("size").alias("others"))
    roots = components(links).alias("r").join(classes.alias("k"), F.expr("r.node = k.c")).select("node", "root", "least")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component"))
    placed = roots.join(smallest, "root").select(F.col("node").alias("n"), "component")
    full = classes.select("key", "c", "size", "least").join(degree, F.col("c") == F.col("a"), "left").join(placed, F.col("c") == F.col("n"), "left")
    full = full.select("key", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    linked = rows.select("vec_id", "key").join(full, "key").select("vec_id", "n_links", "component_id")
    spare = vectors.select("vec_id", "embedding").mapInArrow(_unusable, "vec_id long").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(spare).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unusable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of the rows that :func:`_unit` leaves out."""
    for batch in batches:
        numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], names=["vec_id", "embedding"])
        (used,) = _unit(iter([numbered]))
        rest = np.setdiff1d(np.arange(batch.num_rows), used.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rest))], names=["vec_id"])
