"""Exact Jaccard self-join of documents' word shingles: size-aware, heavy-light.

1. Every document's set of distinct 5-word shingles becomes 64-bit hashes; equal sets are one class.
2. Most classes can't link: a set with more than a fifth of its shingles found nowhere else has no
   partner at 80%. A fixed hash-chosen share of all shingles meets, in compact blocks by hash range, and
   each class learns how many of its own are unshared; more than a fifth of its size proves it single.
3. The rest are joined exactly. In one global order of shingles (rare before common) light sets list
   fixed-size subsets of their prefix, and sets that share one are candidates; heavy sets scan the
   inverted lists of their prefix. The size at which sets become heavy is where the summed cost, subsets
   listed against list entries scanned, is least for this table's sizes and list lengths.
4. A set's home is the set it shares most lists with among the lists' leaders. Sets of one home are
   compared in blocks, by exact intersection, without listing pairs; only candidates of different homes
   are listed. What comes out is a count of links per class and edges of components, never all links.

Hash collisions of 64 bits aside, the result is exact; no list, pair or document is capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_records, free_name, lean, materialize, mix64, sent, sliced, text_bytes, word_hashes
from .graph import components

WORDS = 5
#: Links need NUM / DEN of the union in common.
NUM, DEN = 80, 100
#: Share (of 256) of shingles that take part in step 2, and the most hashes for one range of it.
TAKEN, RANGE_HASHES = 102, 2_000_000
#: Tokens in an enumerated subset; sets and shingles of a block that is compared.
SUBSET, BLOCK, BLOCK_HASHES = 2, 512, 500_000
#: Rows handed to Python at a time.
BATCH_ROWS = 500
#: Cells of the sketch that orders shingles: two bytes each, so at most 8 MB wherever it is sent.
MOST_CELLS = 1 << 22


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and n + 1 positions."""
    words, at = word_hashes(*text_bytes(texts))
    counts = np.diff(at)
    wide = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    chain = mix64(words + np.uint64(1))
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    whole = []
    for i in short:
        h = chain[at[i] : at[i] + 1]
        for k in range(1, counts[i]):
            h = mix64(h ^ (wide[at[i] + k : at[i] + k + 1] + np.uint64(k)))
        whole.append(h)
    for k in range(1, WORDS):
        chain = mix64(chain ^ (wide[k : len(words) + k] + np.uint64(k)))
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(words)) - at[:-1][owner] <= (counts - WORDS)[owner]
    hashes, owner = chain[inside], owner[inside]
    if len(short):
        hashes, owner = np.concatenate([hashes, *whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def class_keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set; 0 for the empty set."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        key = mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))
        out.append(np.where(np.diff(at) == 0, np.uint64(0), key).view(np.int64))
    return out[0], out[1]


@lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, most=1 << 20):
        hashes, at = shingle_hashes(batch.column(batch.schema.get_field_index("text")))
        c, c2 = class_keys(hashes, at)
        own = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "th")]
        yield pa.RecordBatch.from_arrays([own[0], pa.array(np.diff(at).astype(np.int64)), pa.array(c), pa.array(c2), own[1]], names=["doc_id", "n", "c", "c2", "th"])


_BLOCK = "part int, unit long, keys binary, sizes binary, counts binary, hashes binary, shared binary"
#: Bytes of a set's key and of a shingle that travel in a block. A key's 48 bits tell sets apart; a range has at most some
#: millions of shingles, which 32 bits tell apart but for one in a thousand, and a mix-up only keeps a set for step 3.
KEY_BYTES, HASH_BYTES = 6, 4
#: Documents of a unit, after which a new one begins; two of them still have two-byte numbers.
UNIT_DOCS = 30_000


def _by_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, UNIT_DOCS):
        yield batch.slice(at, UNIT_DOCS)


def _narrow(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each 64-bit word."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(np.int64).ravel()


def _short(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each if they fit, else in four."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32).tobytes()


def _shorts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)


def _blocks(parts: int):
    """Per unit of input and hash range, the sampled shingles of the unit's distinct sets.

    A shingle that several sets of the unit have is sent once, marked as shared.
    """

    def emit(unit: int, hashes: list, sizes: list, keys: list) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(keys)
        size = np.concatenate(sizes)
        flat, begin = np.concatenate(hashes), np.concatenate([[0], np.cumsum(size)])
        _, first = np.unique(key, return_index=True)
        first = first[size[first] > 0]
        owner = np.repeat(np.arange(len(first), dtype=np.uint32), size[first])
        h = flat[np.concatenate([np.arange(begin[i], begin[i + 1]) for i in first])] if len(first) else np.zeros(0, np.uint64)
        taken = (h & np.uint64(0xFF)) < TAKEN
        h, owner = h[taken], owner[taken]
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        begins = np.flatnonzero(head)
        several = np.diff(np.append(begins, len(h))) > 1
        h, owner = h[begins], owner[begins]
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        edges = np.searchsorted(part, np.arange(parts + 1))
        rows = [(int(unit % parts), unit, key[first].tobytes(), size[first].astype(np.int64).tobytes(), None, None, None)]
        for p in range(parts):
            a, b = edges[p], edges[p + 1]
            if a == b:
                continue
            o = np.argsort(owner[a:b], kind="stable")
            own, count = np.unique(owner[a:b], return_counts=True)
            rows.append((p, unit, _narrow(key[first][own], KEY_BYTES), own.astype(np.uint16).tobytes(), _short(count), _narrow(h[a:b][o], HASH_BYTES), np.packbits(several[a:b][o]).tobytes()))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "unit", "keys", "sizes", "counts", "hashes", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit = TaskContext.get().partitionId() << 32
        hashes, sizes, keys, held, docs = [], [], [], 0, 0
        for batch in sliced((x for b in batches for x in _by_rows(b)), most=1 << 20):
            h, at = shingle_hashes(batch.column(batch.schema.get_field_index("text")))
            hashes.append(h)
            sizes.append(np.diff(at))
            keys.append(class_keys(h, at)[0])
            held += len(h)
            docs += batch.num_rows
            if held > 500_000 or docs > UNIT_DOCS:
                yield from emit(unit, hashes, sizes, keys)
                unit, hashes, sizes, keys, held, docs = unit + 1, [], [], [], 0, 0
        if keys:
            yield from emit(unit, hashes, sizes, keys)

    return lean(run)


_REPLY = "unit long, keys binary, sizes binary, owners binary, unshared binary"


@lean
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of a hash range: how many shingles of each unit's set nobody else has."""
    hashes, keys, seen, places, begins, owners = [], [], [], [], [0], []
    for batch in batches:
        for part, unit, key, size, count, packed, shared in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
            if packed is None:
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), pa.array([key], pa.binary()), pa.array([size], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary())], names=["unit", "keys", "sizes", "owners", "unshared"])
                continue
            own = _wide(key, KEY_BYTES)
            n = _shorts(count, len(own))
            total = int(n.sum())
            hashes.append(np.frombuffer(packed, np.uint32))
            keys.append(own)
            places.append(np.repeat(np.arange(begins[-1], begins[-1] + len(n), dtype=np.int32), n))
            seen.append(np.unpackbits(np.frombuffer(shared, np.uint8), count=total).astype(bool))
            begins.append(begins[-1] + len(n))
            owners.append((unit, size))
    if not hashes:
        return
    h, place, flag, key = map(np.concatenate, (hashes, places, seen, keys))
    order = np.argsort(h)
    h, place, flag = h[order], place[order], flag[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(head)
    own = key[place]
    several = (np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)) | np.logical_or.reduceat(flag, start)
    alone = np.bincount(place[~several[np.cumsum(head) - 1]], minlength=begins[-1])
    for (unit, size), a, b in zip(owners, begins[:-1], begins[1:], strict=True):
        yield pa.RecordBatch.from_arrays(
            [pa.array([unit], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([size], pa.binary()), pa.array([_short(alone[a:b])], pa.binary())],
            names=["unit", "keys", "sizes", "owners", "unshared"],
        )


def _survivors(_key: tuple, table: pa.Table) -> pa.Table:
    """A unit's replies: the sets that may have a partner."""
    rows = list(zip(*[table.column(i).to_pylist() for i in range(1, 5)], strict=True))
    key, size = next((np.frombuffer(k, np.int64), np.frombuffer(s, np.int64)) for k, s, _, _ in rows if k is not None)
    alone = np.zeros(len(key), np.int64)
    for k, _, owner, count in rows:
        if k is None:
            own = np.frombuffer(owner, np.uint16)
            np.add.at(alone, own, _shorts(count, len(own)))
    return pa.table({"c": pa.array(key[DEN * (size - alone) >= NUM * size])})


def may_link(docs: DataFrame, total: int) -> DataFrame:
    """``c`` of every class that step 2 can't prove single; ``total`` is the number of shingles in all sets."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total * TAKEN // (256 * RANGE_HASHES)))
    blocks = docs.select("text").mapInArrow(_blocks(parts), _BLOCK).repartitionById(parts, F.col("part"))
    return blocks.mapInArrow(_meet, _REPLY).groupBy("unit").applyInArrow(_survivors, "c long").distinct()


@lean
def _chosen_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts that have the class wanted of them; a class once a task."""
    seen: set[int] = set()
    for batch in sliced(batches, most=1 << 20):
        hashes, at = shingle_hashes(batch.column(batch.schema.get_field_index("text")))
        c, _ = class_keys(hashes, at)
        hit = np.flatnonzero(c == batch.column(batch.schema.get_field_index("want")).to_numpy())
        hit = np.array([i for i, k in zip(hit.tolist(), c[hit].tolist(), strict=True) if not (k in seen or seen.add(k))], np.int64)
        lengths = np.diff(at)[hit]
        values = np.concatenate([hashes[at[i] : at[i + 1]] for i in hit]) if len(hit) else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values.view(np.int64)))
        size = batch.column(batch.schema.get_field_index("size")).take(pa.array(hit))
        yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(lengths), size, lists], names=["c", "n", "size", "hashes"])


def sets_of(docs: DataFrame, info: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, n, size, hashes) of each wanted class from one of its documents: one row, but for each task that has a copy of that row.

    ``docs`` and ``info`` have ``th``, a hash of the text. Ids and text hashes of the chosen documents are
    joined with ``docs``, sent to the tasks if they are few, so texts stay in place.
    """
    least = classes.join(wanted, "c", "left_semi").select("c", "least", "size")
    reps = info.join(sent(least, 32), "c").filter(F.col("doc_id").eqNullSafe(F.col("least")))
    reps = materialize(reps.groupBy("c").agg(F.first("least").alias("id"), F.first("size").alias("size"), F.min("th").alias("rth")), "first-documents")
    same = (docs["th"] == reps["rth"]) & docs["doc_id"].eqNullSafe(reps["id"])
    joined = docs.join(sent(reps, 48), same).select("text", F.col("c").alias("want"), "size")
    return joined.mapInArrow(_chosen_sets, "c long, n long, size long, hashes array<long>")


def _sketch_cells(cells: int, rows: int = 64):
    """Counts of shingle hashes by cell, saturating at 16 bits, in ``rows`` slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy().view(np.uint64)
            cell, count = np.unique((values >> np.uint64(20) & np.uint64(cells - 1)).astype(np.uint32), return_counts=True)
            total[cell] += count.astype(np.uint32)
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(rows, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    return run


def _sum_slices(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.uint16).astype(np.int64) for b in table.column("counts").to_pylist())
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())})


def frequency_sketch(sets: DataFrame, postings: int) -> np.ndarray:
    cells = 1 << min(MOST_CELLS.bit_length() - 1, max(12, int(postings).bit_length()))
    # a task per some millions of postings, so that its slices are small against what it reads
    few = sets.select("hashes").coalesce(max(1, postings // 4_000_000))
    rows = few.mapInArrow(_sketch_cells(cells), "slice int, counts binary").groupBy("slice").applyInArrow(_sum_slices, "slice int, counts binary")
    got = {r["slice"]: bytes(r["counts"]) for r in rows.collect()}
    return np.frombuffer(b"".join(got[i] for i in sorted(got)), np.uint16) if got else np.zeros(cells, np.uint16)


def need(n: int) -> int:
    """Least overlap of a set of size n with any partner."""
    return -(-NUM * n // DEN)


#: Work for an entry of a scanned list, in units of a listed subset, which is a shuffled and sorted row. Measured on
#: 8 cores with self-joins of 4 to 8 million rows of this shape: 0.4 microseconds a row, 2 to 2.8 nanoseconds an entry.
SCAN_COST = 0.006


def light_limit(sizes: dict[int, int], scanned: dict[int, float]) -> int:
    """The largest light size: subsets listed up to it against prefixes posted and entries scanned beyond it.

    ``sizes`` counts sets by size, ``scanned`` the entries in the lists of all prefixes of that size.
    """
    best, cost, at = 0.0, 0.0, 0
    for n in sorted(sizes):
        prefix = n - need(n) + 1
        subsets = math.comb(prefix + SUBSET - 1, SUBSET) if need(n) >= SUBSET else prefix
        cost += sizes[n] * (subsets - prefix) - SCAN_COST * scanned.get(n, 0.0)
        if cost < best:
            best, at = cost, n
    return at


def _in_order(h: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles from rare to common by the sketch, ties by hash, and their counts in it."""
    rank = table[(h >> np.uint64(20) & np.uint64(len(table) - 1)).astype(np.int64)]
    order = np.lexsort((h, rank))
    return h[order], rank[order]


def _scans(counts, noise: float):
    """Per set its size and the entries in the lists of its prefix, less what other shingles put into the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(0).to_pylist()
            found = []
            for size, hashes in zip(n, batch.column(1), strict=True):
                _, rank = _in_order(hashes.values.to_numpy().view(np.uint64), counts.value)
                found.append(float(np.maximum(0.0, rank[: size - need(size) + 1] - 1.0 - noise).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(found, pa.float64())], names=["n", "scanned"])

    return run


_MARK = "kind int, h long, c long, n long, pos long, prev long"


def _marks(counts, limit: int):
    """Light sets: hashes of the SUBSET-subsets of their prefix (kind 0). Sets that a heavy one may link with: prefix postings (kind 1).

    A shingle that no other set has can't be shared, so it makes no mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]

            def add(kind, h, c, n, pos, prev, out=out):
                for slot, x in zip(out, (np.full(len(h), kind, np.int32), h.view(np.int64), np.full(len(h), c, np.int64), np.full(len(h), n, np.int64), pos, prev.view(np.int64)), strict=True):
                    slot.append(x)

            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            for c, n, hashes in zip(get("c").to_pylist(), get("n").to_pylist(), get("hashes"), strict=True):
                h, rank = _in_order(hashes.values.to_numpy().view(np.uint64), counts.value)
                if n <= limit:
                    size = min(SUBSET, need(n))
                    pick = h[: n - need(n) + size][rank[: n - need(n) + size] > 1]
                    subset = np.array(list(combinations(range(len(pick)), size)), np.int64).reshape(-1, size)
                    mark = mix64(pick[subset[:, 0]])
                    for k in range(1, size):
                        mark = mix64(mark ^ (pick[subset[:, k]] + np.uint64(k)))
                    zero = np.zeros(len(mark), np.int64)
                    add(0, mark, c, n, zero, zero.view(np.uint64))
                if n > limit or DEN * n // NUM > limit:
                    pick = h[: n - need(n) + 1]
                    prev = np.concatenate([np.zeros(1, np.uint64), pick[:-1]])
                    met = np.flatnonzero(rank[: len(pick)] > 1)
                    add(1, pick[met], c, n, met.astype(np.int64), prev[met])
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            cols[0] = cols[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "h", "c", "n", "pos", "prev"])

    return lean(run)


def marks(sets: DataFrame) -> tuple[DataFrame, int]:
    """The marks (kind, h, c, n, pos, prev) of ``sets(c, n, hashes)`` and the largest light size: sets that may link share one."""
    spark = sets.sparkSession
    sizes = {r["n"]: r["k"] for r in sets.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    sketch = frequency_sketch(sets, sum(n * k for n, k in sizes.items()))
    held = spark.sparkContext.broadcast(sketch)
    scans = sets.select("n", "hashes").mapInArrow(_scans(held, float(sketch.mean())), "n long, scanned double").groupBy("n").agg(F.sum("scanned").alias("scanned"))
    limit = light_limit(sizes, {r["n"]: r["scanned"] for r in scans.collect()})
    return materialize(sets.select("c", "n", "hashes").mapInArrow(_marks(held, limit), _MARK), "marks"), limit


def lists(marked: DataFrame) -> DataFrame:
    """The marks that two sets or more have, with ``lead``, the smallest set of the list."""
    leads = marked.groupBy("kind", "h").agg(F.min("c").alias("lead"), F.max("c").alias("last")).filter("lead < last").drop("last")
    return materialize(marked.join(leads, ["kind", "h"]), "lists")


def homes(listed: DataFrame) -> DataFrame:
    """(c, home): each set with the set it shares most lists with, of those that lead a list.

    Near copies of one text mostly share a home, so they are compared there in blocks and never listed in pairs.
    """
    votes = listed.groupBy("c", "lead").agg(F.count(F.lit(1)).alias("k"))
    return materialize(votes.groupBy("c").agg((-F.max(F.struct("k", (-F.col("lead")).alias("m")))["m"]).alias("home")), "homes")


def pairs_apart(listed: DataFrame, home: DataFrame, limit: int) -> DataFrame:
    """(a, b, u): distinct pairs that may link and have different homes; u is the smaller one's.

    Lists scanned are those of the sets that don't have the list's leader as their home, against all: a
    list of near copies is not met with itself.
    """
    held = listed.join(sent(home, 32), "c")
    # pairs meet first at their first common token, where the rest of both bounds the overlap; a pair
    # whose preceding tokens agree has met before
    bound = f"least(x.n - x.pos, y.n - y.pos) * {NUM + DEN} >= (x.n + y.n) * {NUM}"
    met = "x.prev = y.prev and x.pos > 0 and y.pos > 0"
    fits = f"least(x.n, y.n) * {DEN} >= greatest(x.n, y.n) * {NUM}"
    once = "(y.home = y.lead or x.c < y.c)"
    minor = held.filter("home != lead").drop("lead")
    found = minor.alias("x").join(held.alias("y"), F.expr(f"x.kind = y.kind and x.h = y.h and x.home != y.home and {once} and {fits} and (x.kind = 0 or (greatest(x.n, y.n) > {limit} and not ({met}) and {bound}))"))
    return found.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"), F.least("x.home", "y.home").alias("u")).distinct()


_UNIT = "apart boolean, u long, s int, t int, a long, b long, slot int, size long, hashes array<long>"
_LINKED = "c long, others long, root long"


def _overlaps(hashes: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    m = len(hashes)
    size = np.array([len(x) for x in hashes], np.int64)
    flat, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    width = np.bincount(inverse, minlength=len(flat))
    keep = width[inverse] > 1
    owner, inverse, width = np.repeat(np.arange(m), size)[keep], inverse[keep], width[width > 1]
    total = np.zeros((m, m), np.int32)
    if not len(width):
        return total
    _, token = np.unique(inverse, return_inverse=True)
    listed = float((width.astype(float) ** 2).sum())
    if listed > m * m * len(width) * 0.01:
        for lo in range(0, len(width), 8192):  # products of 0/1 slices
            part = (token >= lo) & (token < lo + 8192)
            bits = np.zeros((m, min(8192, len(width) - lo)), np.float32)
            bits[owner[part], token[part] - lo] = 1
            total += np.rint(bits @ bits.T).astype(np.int32)
        return total
    order = np.argsort(token, kind="stable")
    owner = owner[order]
    start = np.concatenate([[0], np.cumsum(width)])[:-1]
    entry, first = np.repeat(width, width), np.repeat(start, width)
    upto = np.cumsum(entry)
    lo = 0
    while lo < len(owner):  # each entry with its whole list
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + 2_000_000, side="right")))
        n = entry[lo:hi]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[lo:hi], n)
        total += np.bincount(np.repeat(owner[lo:hi], n) * m + owner[at], minlength=m * m).reshape(m, m).astype(np.int32)
        lo = hi
    return total


def _compare(_key: tuple, table: pa.Table) -> pa.Table:
    """A unit's sets, compared: for each that links, the documents it links with here and its root in this unit.

    A unit with rows of pairs compares those, another one all sets of one slot or those of two slots.
    """
    is_pair = table.column("b").is_valid()
    sets, pairs = table.filter(table.column("b").is_null()), table.filter(is_pair)
    c = sets.column("a").to_numpy()
    _, once = np.unique(c, return_index=True)
    c, slot, size = c[once], sets.column("slot").to_numpy()[once], sets.column("size").to_numpy()[once]
    column = sets.column("hashes").combine_chunks()
    hashes = [column[k].values.to_numpy() for k in once.tolist()]
    empty = pa.table({"c": pa.array([], pa.int64()), "others": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if len(c) < 2:
        return empty
    overlap = _overlaps(hashes)
    n = np.array([len(x) for x in hashes], np.int64)
    links = DEN * overlap.astype(np.int64) >= NUM * (n[:, None] + n[None, :] - overlap)
    if pairs.num_rows:
        wanted = np.zeros_like(links)
        i, j = (np.searchsorted(c, pairs.column(x).to_numpy()) for x in ("a", "b"))
        wanted[i, j] = wanted[j, i] = True
        links &= wanted
    elif table.column("s")[0].as_py() != table.column("t")[0].as_py():
        links &= slot[:, None] != slot[None, :]
    np.fill_diagonal(links, False)
    some = np.flatnonzero(links.any(1))
    if not len(some):
        return empty
    links = links[np.ix_(some, some)]
    others = links @ size[some]
    root = np.arange(len(some))
    i, j = np.nonzero(links)
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        least = least[least]
        if (least == root).all():
            break
        root = least
    return pa.table({"c": pa.array(c[some]), "others": pa.array(others.astype(np.int64)), "root": pa.array(c[some][root])})


def linked_sets(sets: DataFrame) -> DataFrame:
    """(c, others, root) of ``sets(c, n, size, hashes)``: the documents a set's class links with in a unit, and a set it hangs together with there.

    Each pair is compared in one unit, so ``others`` add up over a class's rows, and (c, root) are the edges
    of the components. Sets of one home meet in blocks of at most ``BLOCK`` sets and ``BLOCK_HASHES`` shingles
    (a larger home: each two of its blocks); pairs of different homes gather at the smaller home.
    """
    marked, limit = marks(sets)
    listed = lists(marked)
    home = homes(listed)
    # a home's blocks
    local = sets.select("c", "n").distinct().join(sent(home, 32), "c")
    crowd = local.groupBy("home").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m")).filter("k > 1")
    cuts = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("m") / BLOCK_HASHES)).cast("int")
    local = local.join(crowd.select("home", cuts.alias("cuts")), "home").withColumn("slot", F.pmod(F.xxhash64("c"), F.col("cuts")).cast("int"))
    local = local.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    local = local.select(F.lit(False).alias("apart"), F.col("home").alias("u"), F.least("slot", "j").alias("s"), F.greatest("slot", "j").alias("t"), "c", "slot")
    # pairs apart
    pairs = materialize(pairs_apart(listed, home, limit), "pairs")
    gathered = pairs.select("u", F.explode(F.array("a", "b")).alias("c")).distinct()
    crowd = gathered.join(sets.select("c", "n").distinct(), "c").groupBy("u").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m")).select("u", cuts.alias("cuts"))
    cell = lambda c: F.pmod(F.xxhash64(c), F.col("cuts")).cast("int")
    placed = materialize(pairs.join(crowd, "u").select(F.lit(True).alias("apart"), "u", F.least(cell("a"), cell("b")).alias("s"), F.greatest(cell("a"), cell("b")).alias("t"), "a", "b"), "placed")
    ends = placed.select("apart", "u", "s", "t", F.explode(F.array("a", "b")).alias("c"), F.lit(0).alias("slot")).distinct()
    members = materialize(local.unionByName(ends), "members")
    held = sets.join(sent(members, 48), "c").select("apart", "u", "s", "t", F.col("c").alias("a"), F.lit(None).cast("long").alias("b"), "slot", "size", "hashes")
    rows = placed.select("*", F.lit(0).alias("slot"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("array<long>").alias("hashes"))
    return rows.unionByName(held).groupBy("apart", "u", "s", "t").applyInArrow(_compare, _LINKED)


def similar_documents(docs: DataFrame) -> DataFrame:
    """Near duplicates of ``docs(doc_id, text, ...)``: doc_id, n_shingles, n_similar, component_id, class_id.

    A document without words, or with null text, has an empty set and links with nothing. Documents with
    equal sets (copies) are one class, linked with each other; ``class_id`` tells it (null for empty sets).
    Repeated rows count as documents; a null ``doc_id`` is a document too, but never a component's id unless
    all of its component are null. Texts of any length are taken whole; other columns are ignored; an empty
    table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    # a batch of whole sets or texts is held by the JVM and by Python: small ones keep both small
    with arrow_records(docs.sparkSession, BATCH_ROWS):
        info = materialize(docs.mapInArrow(_sets, "doc_id long, n long, c long, c2 long, th long"), "sets")
        classes = info.filter("n > 0").groupBy("c", "c2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"))
        classes = materialize(classes, "classes")
        total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        wanted = materialize(may_link(docs, total), "survivors")
        sets = materialize(sets_of(docs, info, classes, wanted), "survivor-sets")
        links = materialize(linked_sets(sets), "links")
    degree = links.groupBy(F.col("c").alias("d")).agg(F.sum("others").alias("others"))
    roots = components(links.filter("c != root").select(F.col("root").alias("a"), F.col("c").alias("b"))).join(classes.select("c", "least"), F.col("node") == F.col("c")).select("node", "root", "least")
    placed = roots.join(roots.groupBy("root").agg(F.min("least").alias("component")), "root").select(F.col("node").alias("d"), "component")
    linked = materialize(degree.join(placed, "d"), "linked")
    full = classes.join(linked, classes["c"] == linked["d"], "left")
    full = full.select("c", "c2", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("component", "least").alias("component_id"))
    out = info.join(full, ["c", "c2"], "left")
    single = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(single, F.lit(0)).otherwise(F.col("n_similar")).cast("long").alias("n_similar"),
        F.when(single, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(single, F.lit(None)).otherwise(F.col("c")).alias("class_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns whatever their names, with one document of each group of near duplicates: the smallest id.

    Rows that repeat an id are one document, which stays if any of them would, as its first row by text;
    so do rows without id. Documents without words (null, empty, blank) stay; very long texts are compared
    whole; an empty table gives no rows. Texts stay where they are unless very many documents go: the ids
    of those are joined, in the JVM.
    """
    found = similar_documents(docs)
    stays = (F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.select("doc_id", stays.alias("stays")).groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    key, stay, many = (free_name(docs, x) for x in ("__id", "__stays", "__rows"))
    ids = materialize(ids.filter("not stays or n > 1").select(F.col("doc_id").alias(key), F.col("stays").alias(stay), F.col("n").alias(many)), "marked")
    same = docs["doc_id"].eqNullSafe(ids[key])
    kept = docs.join(sent(ids), same, "left_anti")
    several = ids.filter(F.col(stay) & (F.col(many) > 1))
    if not several.head(1):
        return kept
    first = docs.join(sent(several), same, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.struct("text")).alias(key))
    return kept.unionByName(first.select(F.inline(F.array(key))))
