import hashlib
from collections import defaultdict

import numpy as np
import pytest

from semclean.llm import line_dedup
from semclean.llm.line_dedup import CuckooFilter, LineIndex

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=40, most=5):
    holders = defaultdict(list)
    for i, (_, text) in enumerate(rows):
        for k in {line.strip(SPACE).translate(LOWER) for line in (text or "").split("\n")}:
            holders[k].append(i)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = line.strip(SPACE).translate(LOWER)
            ids = [rows[i][0] for i in holders[k]]
            owner = max((i for i in ids if i is not None), default=None)
            if not (len(k) >= least and len(ids) >= most and doc != owner):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, gone int, owner binary")


def digests(df):
    return sorted(map(tuple, df.collect()), key=str)


LONG = "An Ünusual line of text that is Long Enough to count"
ROWS = [(i, f"{LONG}\nown {i} " + "x" * 50 + f"\n  {LONG.upper().replace('Ü', 'Ü')}\t\n\n") for i in range(8)] + [
    (20, None), (21, ""), (22, "\n\n"), (23, LONG), (23, LONG), (None, LONG), (24, "é" * 39), (25, "é" * 40), (26, "y" * 200_000),
] + [(30 + i, "é" * 40 + "\r\n" + "z" * 39) for i in range(5)]


def test_edges(spark):
    assert digests(line_dedup.line_digests(frame(spark, ROWS))) == brute(ROWS)
    assert line_dedup.line_digests(frame(spark, [])).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert digests(line_dedup.line_digests(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_extra_columns_stay(spark):
    got = line_dedup.dedup_lines(frame(spark, ROWS).withColumnRenamed("gone", "k1"))
    assert got.columns == ["doc_id", "text", "k1", "owner", "n_lines", "n_dropped"]


def test_clashing_columns(spark):
    names = ["N_Lines", "__id", "__th", "__gone", "k1", "k2", "th", "shard", "n_docs"]
    wide = frame(spark, ROWS).selectExpr("*", *[f"doc_id as `{c}`" for c in names], "'mine' as n_dropped")
    got = line_dedup.dedup_lines(wide)
    assert got.columns == [c for c in wide.columns if c.lower() not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got.collect() if r.doc_id is not None) == sorted(r[:3] for r in brute(ROWS) if r[0] is not None)
    other = line_dedup.dedup_lines(wide, names=("before", "less"))
    assert other.columns == [*wide.columns, "before", "less"] and {r.n_dropped for r in other.collect()} == {"mine"}


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_many_repeated_keys_are_joined(spark, monkeypatch, batches):
    monkeypatch.setattr(line_dedup, "HOT_BYTES", 0)
    want = brute(ROWS)
    got = line_dedup.dedup_lines(frame(spark, ROWS), batches=batches).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got), key=str) == want


def test_sql_counts_rows_as_the_operator_does(spark):
    import duckdb
    import pandas as pd

    rows = [(7, LONG), (7, LONG), (7, LONG), (None, LONG), (3, LONG), (3, f"{LONG}\n{LONG}"), (4, None), (5, "")]
    documents = pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    found = duckdb.sql(line_dedup.ORACLE).fetchall()
    assert sorted(found, key=str) == brute(rows) == digests(line_dedup.line_digests(frame(spark, rows)))


def test_index_is_opened_again_and_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    texts = [(i, "\n".join(f"line {j} that is long enough to be counted {'=' * 9}" for j in range(i, i + 6))) for i in range(60)]
    path = str(tmp_path / "i")
    LineIndex(spark, path, min_docs=4).insert(frame(spark, texts[:5]))
    for part in (texts[5:8], texts[8:40], texts[40:]):
        index = LineIndex(spark, path)
        index.insert(frame(spark, part))
    assert index.state["shards"] > 4 and index.state["min_docs"] == 4
    LineIndex(spark, path).delete(frame(spark, texts[50:]))
    LineIndex(spark, path).insert(frame(spark, texts[55:]))
    live = texts[:50] + texts[55:]
    for compacted in (False, True):
        index = LineIndex(spark, path)
        counts = index.counts().collect()
        assert index.state["keys"] == len(counts) == len({x for _, t in live for x in t.split("\n")})
        held = {r.shard: CuckooFilter.load(bytes(r.blob)) for r in index.filters().collect()}
        assert all(held[r.shard].contains(np.array([r.k1]), np.array([r.k2])).all() for r in counts)
        got = index.clean(frame(spark, live)).collect()
        assert sorted((r.doc_id, r.n_dropped) for r in got) == sorted(r[::2] for r in brute(live, most=4))
        if not compacted:
            index.compact()


def test_an_unfinished_version_was_never_there(spark, tmp_path):
    path = str(tmp_path / "i")
    LineIndex(spark, path).insert(frame(spark, ROWS[:9]))
    spark.createDataFrame([(1, 2, 3, 4)], line_dedup._REFS).write.parquet(f"{path}/refs-2")
    index = LineIndex(spark, path)
    index.insert(frame(spark, ROWS[9:]))
    assert digests(index.clean(frame(spark, ROWS)).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)")) == brute(ROWS)


def test_insert_then_delete_is_as_if_never_inserted(spark, tmp_path):
    texts = [(i, f"{LONG} {i % 3}\n{'w' * 45} {i}") for i in range(18)]
    index = LineIndex(spark, str(tmp_path / "i"))
    index.insert(frame(spark, texts[:9]))
    index.insert(frame(spark, texts[9:]))
    want = {(r.k1, r.k2): (r.n_docs, r.owner) for r in index.counts().collect()}
    index2 = LineIndex(spark, str(tmp_path / "j"))
    index2.insert(frame(spark, texts))
    assert want == {(r.k1, r.k2): (r.n_docs, r.owner) for r in index2.counts().collect()}
    assert [(r[0], r[1]) for r in digests(index.clean(frame(spark, texts)).select("doc_id", "n_dropped"))] == [(i, 1 if i < 15 else 0) for i in sorted(range(18), key=lambda x: str((x,)))]
    index.delete(frame(spark, texts[9:]))
    index3 = LineIndex(spark, str(tmp_path / "k"))
    index3.insert(frame(spark, texts[:9]))
    assert {(r.k1, r.k2): (r.n_docs, r.owner) for r in index.counts().collect()} == {(r.k1, r.k2): (r.n_docs, r.owner) for r in index3.counts().collect()}
    gone = [k for k in want if k not in {(r.k1, r.k2) for r in index.counts().collect()}]
    (blob,) = [r.blob for r in index.filters().collect()]
    held = CuckooFilter.load(bytes(blob)).contains(np.array([k[0] for k in gone]), np.array([k[1] for k in gone]))
    assert held.mean() < 0.5


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    k1, k2 = rng.integers(-(2**63), 2**63, (2, 50_000))
    made = CuckooFilter.of(k1, k2)
    assert made.contains(k1, k2).all()
    other = rng.integers(-(2**63), 2**63, (2, 50_000))
    assert made.contains(*other).mean() < 0.001
    made.delete(k1[:2000], k2[:2000])
    twice = CuckooFilter.of(np.array([5 << 7, 5 << 7]), np.array([9, 9]))
    twice.delete(np.array([5 << 7]), np.array([9]))
    assert twice.contains(np.array([5 << 7]), np.array([9])).all() and (twice.table != 0).sum() == 1
    assert made.contains(k1[2000:], k2[2000:]).all()
    assert made.contains(k1[:2000], k2[:2000]).mean() < 0.01
    again = CuckooFilter.load(made.dump())
    assert again.insert(k1[:2000], k2[:2000]) and again.contains(k1, k2).all()
    assert CuckooFilter.of(k1[:0], k2[:0]).dump()
