"""Token-ID files: Parquet list columns in ascending document order, with page indexes for selective reads.

Layout of a written folder: one file per key range, in file order ascending; each row a document with
``part`` (the range), ``row_in_part``, ``start_in_part`` (ids of the range before it), ``n_tokens`` and
``ids`` (list of int). Ids are dictionary-encoded (the dictionary of a 50k vocabulary stays below one
page, so an id costs at most 16 bits), the ascending metadata columns use delta encoding, row groups and
pages are small enough that the column and offset indexes let a reader fetch a few documents, and
metadata can be read without touching the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, lean, range_bounds, scratch_path, shuffle_partitions, sliced, text_column
from .tokenizer import tokenizer

WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
}
#: Pieces of a generation of a worker's token cache here, where nothing else needs much room.
CACHED_PIECES = 200_000
_SCHEMA = "doc_id long, part int, row_in_part long, start_in_part long, n_tokens long, ids array<int>"


def _encoder(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokenizer(path)
        pieces.entries = CACHED_PIECES
        tail = () if end_id is None else (end_id,)
        part, row, start = -1, 0, 0
        for batch in sliced(batches, most=4 << 20):
            ids, lengths = pieces.encode_joined(text_column(batch), tail)
            parts = batch.column(batch.schema.get_field_index("part")).to_numpy()
            rows, starts = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for i, (p, n) in enumerate(zip(parts.tolist(), lengths.tolist(), strict=True)):
                if p != part:
                    part, row, start = p, 0, 0
                rows[i], starts[i] = row, start
                row, start = row + 1, start + n
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(parts), pa.array(rows), pa.array(starts), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                names=["doc_id", "part", "row_in_part", "start_in_part", "n_tokens", "ids"],
            )

    return lean(run)


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = None, parts: int | None = None) -> None:
    """Encode ``docs(doc_id, text, ...)`` and write token files at ``path`` in ascending ``doc_id`` order.

    One shuffle, of the texts, into ranges of ``doc_id`` whose bounds come from a scan of that column
    alone; encoding follows it, so ids are never shuffled. Null text is empty (only the end id, if any);
    a null ``doc_id`` sorts first; repeated ids keep every row, ordered by text; other columns are
    ignored; an empty table writes an empty folder. A range holds as many rows as its key values have,
    so only one ``doc_id`` repeated over and over could make a range large.
    """
    docs = docs.select("doc_id", "text")
    parts = parts or shuffle_partitions(docs)
    bounds = range_bounds(docs, "doc_id", parts)
    placed = docs.withColumn("part", bucket_of("doc_id", bounds)).repartitionById(len(bounds) + 1, F.col("part"))
    placed = placed.sortWithinPartitions("part", "doc_id", "text")
    placed.mapInArrow(_encoder(tokenizer_file, end_id), _SCHEMA).write.options(**WRITE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Read token files; ``columns`` prunes (metadata only, say), ``first``/``last`` bound ``doc_id`` by page indexes.

    ``start`` (the ids of all earlier documents) is added when asked for or when no columns are named. It
    comes from the metadata columns: one total per file range, summed up in range order; that list of
    totals has one row per range and is all that is broadcast.
    """
    df = spark.read.schema(_SCHEMA).parquet(path)
    want = columns or ["doc_id", "start", "n_tokens", "ids"]
    if "start" in want:
        totals = df.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
        before, rows = 0, []
        for part, n in totals:
            rows.append((part, before))
            before += n
        bases = spark.createDataFrame(rows, "part int, base long")
        df = df.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part"))
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    if last is not None:
        df = df.filter(F.col("doc_id") <= last)
    return df.select(*want)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        values, at = memoryview(ids.values.to_numpy().astype("<u4")).cast("B"), ids.offsets.to_numpy() * 4
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "ids"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(crc, pa.int64())], names=[x for x in batch.schema.names if x != "ids"] + ["ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start, n_tokens and the CRC-32 of its ids."""
    rows = read_tokens(spark, path, ["doc_id", "start", "n_tokens", "ids"])
    return rows.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of_table(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write ``docs`` as token files in the shared folder, then digest what the files hold."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file, end_id)
    return token_digests(docs.sparkSession, path)
