"""Reversible line deduplication: sharded cuckoo filters over exact reference tables.

An index is a folder that only grows until it is compacted. Each insertion or deletion is a version with
  refs     one row per (line key, document) that it brought: exact, so documents can be taken out again;
  gone     the documents that it took out;
  counts   for the keys that it touched, in how many documents they are and the largest ``doc_id`` of these;
  filters  the cuckoo filters, one per shard of the key space, that it changed: every counted key is in once;
  manifest what the versions so far hold, written last, so a version that failed half-way was never there.
An insertion asks its shards' filters first: keys that no filter knows are new and skip the join with the
counts; only the rest (known keys and a few false positives) meet the exact table. A deletion recounts the
keys of its documents and takes those without references out of the filters.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lean, materialize, scratch_path, sent, sliced, text_bytes

#: Keys that one shard's filter should hold.
SHARD_KEYS = 1_000_000
#: Bytes of repeated keys, at 128 each, that may be held by every task.
HOT_BYTES = 16 << 20


_REFS = "k1 long, k2 long, doc_id long, th long"
_COUNTS = "k1 long, k2 long, n_docs long, owner long"
_KEYS = "shard int, k1 long, k2 long, n_docs long, owner long"
_FILTERS = "shard int, blob binary"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; batch insertion, look-up and deletion without a loop over keys."""

    def __init__(self, buckets: int, table: np.ndarray | None = None) -> None:
        self.mask = np.uint64(buckets - 1)
        self.table = np.zeros((buckets, 4), np.uint16) if table is None else table

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        """A filter of these keys (each once), at a load of at most 0.8."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, len(k1)) / 3.2))))
        while True:
            made = cls(buckets)
            if made.insert(k1, k2):
                return made
            buckets *= 2

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        table = np.frombuffer(blob, np.uint16).reshape(-1, 4).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ ((mark.astype(np.uint64) * np.uint64(0x5BD1E995_9E3779B9) >> np.uint64(20)) & self.mask)

    def _keys(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (k2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, k1.astype(np.uint64) >> np.uint64(7) & self.mask

    def _place(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; which ones found none."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.searchsorted(sorted_at, sorted_at, side="left")
        slot = np.arange(len(at)) - first + (self.table[sorted_at] != 0).sum(1)
        fits = slot < 4
        self.table[sorted_at[fits], slot[fits]] = mark[order][fits]
        failed = np.zeros(len(at), bool)
        failed[order[~fits]] = True
        return failed

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Add keys; False if they don't fit, and the filter must be made larger."""
        mark, at = self._keys(k1, k2)
        failed = self._place(mark, at)
        mark, at = mark[failed], self._other(at[failed], mark[failed])
        rng = np.random.default_rng(7)
        for _ in range(400):
            if not len(mark):
                return True
            failed = self._place(mark, at)
            mark, at = mark[failed], at[failed]
            if not len(mark):
                return True
            _, one = np.unique(at, return_index=True)
            slot = rng.integers(0, 4, len(one))
            out = self.table[at[one], slot].copy()
            self.table[at[one], slot] = mark[one]
            at[one] = self._other(at[one], out)
            mark[one] = out
        return False

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, at = self._keys(k1, k2)
        return (self.table[at] == mark[:, None]).any(1) | (self.table[self._other(at, mark)] == mark[:, None]).any(1)

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take out keys that are in; one fingerprint each."""
        mark, at = self._keys(k1, k2)
        while len(mark):
            hit = self.table[at] == mark[:, None]
            other = self._other(at, mark)
            bucket = np.where(hit.any(1), at, other)
            hit = self.table[bucket] == mark[:, None]
            found = hit.any(1)
            mark, at, bucket, slot = mark[found], at[found], bucket[found], hit[found].argmax(1)
            # keys that want one slot take it in turn
            _, one = np.unique(bucket * np.uint64(4) + slot.astype(np.uint64), return_index=True)
            self.table[bucket[one], slot[one]] = 0
            rows = self.table[bucket[one]]
            self.table[bucket[one]] = np.take_along_axis(rows, np.argsort(rows == 0, axis=1, kind="stable"), 1)
            left = np.ones(len(mark), bool)
            left[one] = False
            mark, at = mark[left], at[left]


def line_key(line: bytes) -> bytes:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lowered."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode()) >= least)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
    raw = data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield raw[a:b]


def _line_refs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in sliced(batches):
            found, counts = [], []
            for text in _texts(batch):
                keys = {k for k in map(line_key, text.split(b"\n")) if len(k) >= least and _long_enough(k, least)}
                found.extend(map(digest, keys))
                counts.append(len(keys))
            pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            own = [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), *own], names=["k1", "k2", "doc_id", "th"])

    return lean(run)


def _shard_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard: the old filter's row (blob) and key rows (action: 1 put in, -1 take out) make the new filter."""
    held: dict[int, list] = {}
    for batch in batches:
        shard, k1, k2, action = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        blobs = batch.column(4)
        for s in np.unique(shard).tolist():
            own = held.setdefault(s, [None, []])
            own[1].append((k1[shard == s], k2[shard == s], action[shard == s]))
            for i in np.flatnonzero((shard == s) & (action == 0)).tolist():
                own[0] = blobs[i].as_py()
    for s, (blob, parts) in held.items():
        k1, k2, action = (np.concatenate(x) for x in zip(*parts, strict=True))
        made = CuckooFilter.load(blob) if blob else None
        if made and (action < 0).any():
            made.delete(k1[action < 0], k2[action < 0])
        put = action > 0
        if made is None:
            made = CuckooFilter.of(k1[put], k2[put])
        elif put.any() and not made.insert(k1[put], k2[put]):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([None], pa.binary())], names=["shard", "blob"])
            continue
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([made.dump()], pa.binary())], names=["shard", "blob"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key rows of a shard with its filter's row: which keys the filter may know."""
    keys: list[pa.RecordBatch] = []
    filters: dict[int, CuckooFilter] = {}
    for batch in batches:
        blob = batch.column(batch.schema.get_field_index("blob"))
        for i in np.flatnonzero(blob.is_valid().to_numpy(zero_copy_only=False)).tolist():
            filters[batch.column(0)[i].as_py()] = CuckooFilter.load(blob[i].as_py())
        keys.append(batch.filter(blob.is_null()))
    for batch in keys:
        shard, k1, k2 = (batch.column(i).to_numpy() for i in range(3))
        maybe = np.zeros(len(shard), bool)
        for s in np.unique(shard).tolist():
            if s in filters:
                maybe[shard == s] = filters[s].contains(k1[shard == s], k2[shard == s])
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(maybe)], names=["shard", "k1", "k2", "n_docs", "owner", "maybe"])


def _dropper(columns: list[str], names: tuple[str, str], least: int, hot):
    """Drop the lines whose key is in the broadcast ``hot`` (key to owner) unless the row is the owner's; without it, those listed in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        known = hot.value if hot is not None else {}
        for batch in sliced(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            lists = [None] * len(ids) if hot is not None else batch.column(batch.num_columns - 1).to_pylist()
            kept, n_lines, n_dropped = [], [], []
            for text, doc_id, gone in zip(_texts(batch), ids, lists, strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if gone:
                    drop = {np.array([g["k1"], g["k2"]], "<i8").tobytes() for g in gone}
                    lines = [x for x in lines if digest(line_key(x)) not in drop]
                elif known:
                    lines = [x for x in lines if len(x) < least or known.get(digest(line_key(x)), doc_id) == doc_id]
                kept.append(text if len(lines) == n_lines[-1] else b"\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            made = {"text": pa.array(kept, pa.binary()).cast(pa.string()), names[0]: pa.array(n_lines, pa.int64()), names[1]: pa.array(n_dropped, pa.int64())}
            cols = [made[c] if c in made else batch.column(batch.schema.get_field_index(c)) for c in [*columns, *names]]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, *names])

    return lean(run)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [hashlib.sha256(t).hexdigest() for t in _texts(batch)]
        keep = ["doc_id", "n_lines", "n_dropped"]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(sha)], names=[*keep, "kept_sha256"])


class LineIndex:
    """An incremental, reversible index of lines in a shared folder, opened again by its path.

    Every row inserted is a document: a repeated row counts again, a null text is one empty line, a null
    ``doc_id`` is a document that is never the largest unless all holders are null. Keys shorter than
    ``min_chars`` code points are not indexed. Columns besides doc_id and text are ignored; inserting or
    deleting no rows changes nothing but the version. One writer at a time. An index opened again keeps the
    parameters that it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, min_chars: int = 40, min_docs: int = 5) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.state = {"version": 0, "shards": 1, "keys": 0, "min_chars": min_chars, "min_docs": min_docs, "refs": [], "gone": [], "counts": [], "filters": []}
        held = self._manifests()
        if held:
            row = spark.read.schema("state string").parquet(f"{self.path}/manifest-{max(held)}").first()
            self.state = json.loads(row["state"])

    def _manifests(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [n for n in found if n.startswith("manifest-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return [int(n.rpartition("-")[2]) for n in done]

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}-{version}")

    def _read(self, name: str, version: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}-{version}")

    def _all(self, name: str, schema: str) -> DataFrame:
        """The rows of all live versions of a table, with their ``v``."""
        out = None
        for v in self.state[name]:
            part = self._read(name, v, schema).withColumn("v", F.lit(v))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], f"{schema}, v int")

    def _commit(self, version: int, **changes: object) -> None:
        state = {**self.state, **changes, "version": version}
        self._write(self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1), "manifest", version)
        self.state = state

    def counts(self) -> DataFrame:
        """shard, k1, k2, n_docs, owner: the exact reference counts, of each key as its latest version says."""
        if len(self.state["counts"]) == 1:
            now = self._read("counts", self.state["counts"][0], _COUNTS)
        else:
            latest = self._all("counts", _COUNTS).groupBy("k1", "k2").agg(F.max_by(F.struct("n_docs", "owner"), "v").alias("x"))
            now = latest.select("k1", "k2", "x.n_docs", "x.owner")
        return self._shard(now.filter("n_docs > 0"))

    def filters(self) -> DataFrame:
        """(shard, blob) of the latest filter of each shard."""
        if len(self.state["filters"]) == 1:
            return self._read("filters", self.state["filters"][0], _FILTERS)
        latest = self._all("filters", _FILTERS)
        newest = latest.groupBy("shard").agg(F.max("v").alias("v"))
        return latest.join(newest, ["shard", "v"]).select("shard", "blob")

    def refs(self) -> DataFrame:
        """(k1, k2, doc_id, th) of the documents that are in; ``th`` is a hash of the text."""
        rows = self._all("refs", _REFS)
        if self.state["gone"]:
            gone = self._all("gone", "doc_id long")
            rows = rows.alias("r").join(gone.alias("g"), F.expr("r.doc_id <=> g.doc_id and r.v < g.v"), "left_anti")
        return rows.select("k1", "k2", "doc_id", "th")

    def _lines(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_line_refs(self.state["min_chars"]), _REFS)

    @staticmethod
    def _count(refs: DataFrame) -> DataFrame:
        return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("owner"))

    def _shard(self, df: DataFrame, shards: int | None = None) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.col("k1"), F.lit(shards or self.state["shards"])).cast("int"))

    def _write_filters(self, changes: DataFrame, old: DataFrame | None, version: int, shards: int) -> bool:
        """``changes``: shard, k1, k2, action. Filters of shards without changes stay as they are. False if one overflowed."""
        rows = changes.select("shard", "k1", "k2", "action", F.lit(None).cast("binary").alias("blob"))
        if old is not None:
            touched = old.join(changes.select("shard").distinct(), "shard", "left_semi")
            rows = rows.unionByName(touched.select("shard", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).alias("action"), "blob"))
        self._write(rows.repartitionById(shards, F.col("shard")).mapInArrow(_shard_filters, _FILTERS), "filters", version)
        return old is None or not self._read("filters", version, _FILTERS).filter("blob is null").head(1)

    def insert(self, docs: DataFrame) -> None:
        """Add documents' lines: refs, the counts of their keys, and filters."""
        version, shards, first = self.state["version"] + 1, self.state["shards"], not self.state["counts"]
        self._write(self._lines(docs), "refs", version)
        added = self._count(self._read("refs", version, _REFS))
        if first:
            self._write(added, "counts", version)
            keys = self._read("counts", version, _COUNTS).count()
        else:
            rows = self._shard(added).select("shard", "k1", "k2", "n_docs", "owner", F.lit(None).cast("binary").alias("blob"))
            zero = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "n_docs", "owner")]
            rows = rows.unionByName(self.filters().select("shard", *zero, "blob"))
            probed = materialize(rows.repartitionById(shards, F.col("shard")).mapInArrow(_probe, f"{_KEYS}, maybe boolean"), "probed")
            maybe, old = probed.filter("maybe").alias("a"), self.counts().alias("o")
            met = maybe.join(old, F.expr("o.k1 = a.k1 and o.k2 = a.k2"), "left")
            met = materialize(met.select("a.shard", "a.k1", "a.k2", (F.col("a.n_docs") + F.coalesce("o.n_docs", F.lit(0))).alias("n_docs"), F.greatest("a.owner", "o.owner").alias("owner"), F.col("o.k1").isNull().alias("new")), "met")
            new = probed.filter("not maybe").select("shard", "k1", "k2").unionByName(met.filter("new").select("shard", "k1", "k2"))
            self._write(probed.filter("not maybe").select("k1", "k2", "n_docs", "owner").unionByName(met.select("k1", "k2", "n_docs", "owner")), "counts", version)
            keys = self.state["keys"] + new.count()
        counts, filters = [*self.state["counts"], version], [*self.state["filters"], version]
        before = self.state
        self.state = {**before, "counts": counts}
        try:
            fits = not first and keys <= 2 * SHARD_KEYS * shards and self._write_filters(new.withColumn("action", F.lit(1)), self.filters(), version, shards)
            if not fits:  # the first filters, more keys than the shards are meant for, or a filter that ran full
                shards, filters = max(1, -(-keys // SHARD_KEYS)), [version]
                self._write_filters(self._shard(self.counts(), shards).withColumn("action", F.lit(1)), None, version, shards)
        finally:
            self.state = before
        self._commit(version, shards=shards, keys=keys, counts=counts, filters=filters, refs=[*self.state["refs"], version])

    def delete(self, docs: DataFrame) -> None:
        """Take documents (rows inserted before, with their texts) out again, by their ids."""
        version, before = self.state["version"] + 1, self.state
        self._write(docs.select("doc_id").distinct(), "gone", version)
        touched = materialize(self._lines(docs).select("k1", "k2").distinct(), "touched")
        known = self.counts().join(touched, ["k1", "k2"], "left_semi").select("k1", "k2")
        gone = [*before["gone"], version]
        self.state = {**before, "gone": gone}
        try:
            recount = self._count(self.refs().join(touched, ["k1", "k2"], "left_semi"))
        finally:
            self.state = before
        zero = [F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "owner"]
        self._write(known.join(recount, ["k1", "k2"], "left").select("k1", "k2", *zero), "counts", version)
        out = self._shard(self._read("counts", version, _COUNTS).filter("n_docs = 0")).withColumn("action", F.lit(-1))
        keys = before["keys"] - out.count()
        self._write_filters(out, self.filters(), version, before["shards"])
        self._commit(version, keys=keys, gone=gone, counts=[*before["counts"], version], filters=[*before["filters"], version])

    def compact(self) -> None:
        """Rewrite the live rows as one version; the folders of earlier ones can go."""
        version = self.state["version"] + 1
        self._write(self.refs(), "refs", version)
        self._write(self.counts().select("k1", "k2", "n_docs", "owner"), "counts", version)
        self._write(self.filters(), "filters", version)
        self._commit(version, refs=[version], gone=[], counts=[version], filters=[version])

    def clean(self, docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
        """``docs`` (all of them inserted) without repeated lines: its columns, then two counts under ``names``.

        A key in at least ``min_docs`` documents loses its lines in all but the largest ``doc_id``; other
        lines stay, joined by a line feed. A column of ``docs`` that is called like a count is replaced by
        it. If the repeated keys are few in bytes they go to the tasks and texts stay where they are; else
        they meet the references key by key, each document gets its own list, and texts are shuffled
        once to that list, by id and text, so that neither a null nor a repeated id is one task's load.
        """
        hot = materialize(self.counts().filter(F.col("n_docs") >= self.state["min_docs"]).select("k1", "k2", "owner"), "repeated")
        columns = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
        kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
        schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"`{n}` long" for n in names])
        docs = docs.select(*[f"`{c}`" for c in columns])
        most = HOT_BYTES // 128
        few = hot.limit(most + 1).collect()
        if len(few) <= most:
            held = self.spark.sparkContext.broadcast({np.array([r.k1, r.k2], "<i8").tobytes(): r.owner for r in few})
            return docs.mapInArrow(_dropper(columns, names, self.state["min_chars"], held), schema)
        drops = self.refs().join(sent(hot, 40), ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("owner")))
        key, text_key, gone = (free_name(docs, x) for x in ("__id", "__th", "__gone"))
        lists = drops.groupBy(F.col("doc_id").alias(key), F.col("th").alias(text_key)).agg(F.collect_set(F.struct("k1", "k2")).alias(gone))
        wide = docs.join(lists, docs["doc_id"].eqNullSafe(lists[key]) & (F.xxhash64(docs["text"]) == lists[text_key]), "left")
        return wide.select(*[docs[c] for c in columns], lists[gone]).mapInArrow(_dropper(columns, names, self.state["min_chars"], None), schema)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, names: tuple[str, str] = ("n_lines", "n_dropped"), batches: int = 2) -> DataFrame:
    """``docs`` without their repeated lines: its columns, then ``names``, lines before and lines dropped.

    The documents are put into an index in the shared folder, in ``batches`` by a hash, as they would come
    over time: each batch but the first asks the filters of those before it; the result doesn't depend on it.
    Nulls, repeated rows, long and empty texts, clashing columns and empty tables are as in
    :class:`LineIndex` and :meth:`LineIndex.clean`: a null text is one empty line and comes back empty.
    """
    spark = docs.sparkSession
    index = LineIndex(spark, scratch_path(spark, "lines"), min_chars, min_docs)
    for i in range(batches):
        index.insert(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    return index.clean(docs, names)


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text of every row; other columns are ignored, no rows give none."""
    cleaned = dedup_lines(docs.select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")
    return cleaned.mapInArrow(_hashed, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
ls as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
ks as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from ls),
hot as (select k, max(doc_id) as owner from ks where length(k) >= 40 group by k having count(distinct r) >= 5),
marked as (select ks.*, hot.k is not null and ks.doc_id is distinct from hot.owner as gone from ks left join hot on ks.k = hot.k)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by r
"""
