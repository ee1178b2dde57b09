"""Best-fit packing by minimum bin slack over the histogram of lengths.

Bins are filled one pattern at a time: the longest remaining length is fixed and a bitset subset-sum
dynamic program over the remaining lengths finds the fullest feasible combination, which is removed as
often as the counts allow. A capacity of 4096 has at most 4096 distinct lengths, so the search sees a
table of bounded size however many documents there are; documents then take their places by their rank
within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, sliced, text_column
from .token_output import CACHED_PIECES
from .tokenizer import CACHE_ENTRIES, tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, unit int, rank_in_unit long"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of ``lengths`` (descending), each at most ``counts`` times, with the largest sum <= ``room``.

    Bitset subset sums: bit s of ``reach`` says that sum s can be made. Powers of two of a length's count
    are shifted in; the bitsets before each step are kept to trace the answer back.
    """
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, size = min(counts[length], room // length), 1
        while left:
            size = min(size, left)
            steps.append((length, size, reach))
            reach |= (reach << (length * size)) & mask
            left -= size
            size *= 2
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not before >> at & 1:
            at -= length * size
            taken[length] = taken.get(length, 0) + size
    return sorted(taken.items(), reverse=True)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``histogram[length]`` pieces of each length into bins of ``capacity``.

    Returns segments (length, first rank, ranks, copies per bin, first bin, offset of the first copy): rank
    r of a length lies in the segment with first rank <= r < first rank + ranks.
    """
    counts = {n: c for n, c in histogram.items() if c > 0 and n > 0}
    used = dict.fromkeys(counts, 0)
    lengths = sorted(counts, reverse=True)
    segments, bins = [], 0
    while lengths:
        head = lengths[0]
        counts[head] -= 1
        pattern = dict(fullest(lengths, counts, capacity - head))
        counts[head] += 1
        pattern[head] = pattern.get(head, 0) + 1
        times = min(counts[n] // k for n, k in pattern.items())
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            segments.append((n, used[n], times * k, k, bins, offset))
            offset += n * k
            used[n] += times * k
            counts[n] -= times * k
        bins += times
        lengths = [n for n in lengths if counts[n]]
    return segments


def _cutter(path: str, end_id: int, capacity: int, release: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = tokenizer(path)
        pieces.entries = CACHE_ENTRIES if release else CACHED_PIECES
        unit = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        tail, step = np.array([end_id], "<i4").tobytes(), 4 * capacity
        for batch in sliced(batches, most=1 << 20):
            keys = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            rows: list[tuple] = []
            for key, ids in zip(keys, pieces.encode_all(text_column(batch)), strict=True):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    rows.append((key, piece, at // 4, n, zlib.crc32(part), unit, rank))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "unit", "rank_in_unit"])
        if release:
            pieces.forget()

    return lean(run)


def _placer(segments: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(segments, np.int64).reshape(-1, 6)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        most = np.int64(1) << 44
        key = table[:, 0] * most + table[:, 1]
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy()  # noqa: B023, E731
            length, rank = get("length"), get("rank")
            at = np.searchsorted(key, length * most + rank, side="right") - 1
            within = rank - table[at, 1]
            copies = table[at, 3]
            sequence = table[at, 4] + within // copies
            offset = table[at, 5] + within % copies * length
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 4096, release: bool = False) -> DataFrame:
    """Cut ``docs(doc_id, text, ...)`` into pieces of at most ``capacity`` tokens and place them in sequences.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece. Only documents
    longer than ``capacity`` are cut; a sequence's pieces follow one another without gaps from 0. Null
    text is empty (only the end token); a null or repeated ``doc_id`` is packed row by row; other columns
    are ignored; an empty table gives no rows. With ``release`` a task's end empties its worker's token cache,
    for callers whose workers go on to other work; the next task learns its pieces anew.

    Texts are encoded where they are read and never shuffled. The pieces' table is written, so ranks
    within a (task, length) stay as they are; ranks over all tasks need only one count per task and
    length. The driver gets one count per length: at most ``capacity`` rows.
    """
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer_file, end_id, capacity, release), PIECES), "pieces")
    from pyspark.sql import Window

    counts = pieces.groupBy("length", "unit").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "unit", "base")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(bases, ["length", "unit"]).withColumn("rank", F.col("base") + F.col("rank_in_unit"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_placer(pack_histogram(histogram, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
