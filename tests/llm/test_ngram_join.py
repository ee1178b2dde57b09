import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from semclean.llm import common, graph, ngram_join
from semclean.llm.common import text_bytes, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, n long, c long, h string"


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            at[x].add(i)
    links = defaultdict(set)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in at[x]}:
            if j != i and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                links[i].add(j)
    root, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, part = [i], {i}
        while todo:
            for j in links[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        seen |= part
        ids = [rows[k][0] for k in part if rows[k][0] is not None]
        for k in part:
            root[k] = min(ids) if ids else None
    return sorted(((rows[i][0], len(sets[i]), len(links[i]), root[i]) for i in range(len(rows))), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], COLUMNS)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "n_similar", "component_id").collect()), key=str)


def crowd(seed=1):
    """Near copies around several texts, of light and heavy sizes, with a passage that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(12)], []
    for size in (3, 5, 7, 9, 10, 12, 14, 19, 26, 60, 150):
        base = [word() for _ in range(size)] + (passage if size > 20 else [])
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word()] * rng.randint(1, 3)
            rows.append((len(rows), "  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    return rows


EDGES = [(500, None), (501, ""), (502, " \t\n"), (503, "One two"), (504, "one\ttwo "), (505, "one two three"), (506, "a b c d e"), (506, "a b c d e"), (None, "A B C D E"), (None, "only here without any id at all"), (None, None), (507, "w " * 50_000), (508, "w\x0bw w w w"), (509, "x" * 3_000_000 + " tail"), (510, "É é é é é é"), (511, "é é é é é é")]


def test_small_against_brute_force(spark):
    rows = crowd() + EDGES
    assert result(ngram_join.similar_documents(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("limit", [0, 8, 10_000])
def test_any_boundary_finds_all(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "light_limit", lambda *_: min(limit, 40))
    rows = crowd(limit)
    assert result(ngram_join.similar_documents(frame(spark, rows))) == brute(rows)


def test_boundary_follows_cost():
    sizes = {n: 10 for n in range(5, 60)}
    assert ngram_join.light_limit(sizes, {}) <= 9
    assert ngram_join.light_limit(sizes, {n: 10 * 800.0 * n for n in sizes}) > 20
    assert ngram_join.light_limit({}, {}) == 0


def test_small_blocks_and_joined_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(common, "SENT_BYTES", 0)
    rows = crowd(5) + EDGES
    assert result(ngram_join.similar_documents(frame(spark, rows))) == brute(rows)


def hot_rows():
    """Ids and groups that hold a third of all rows each: one id, no id, near copies of one text, copies."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    near = lambda: " ".join(w if rng.random() > 0.01 else f"x{rng.randrange(9999)}" for w in words)
    rows = [(77, f"own text number {i} of the id that all share") for i in range(40)] + [(None, f"a text {i} without any id at all {i}") for i in range(40)]
    return rows + [(1000 + i, near()) for i in range(120)] + [(2000 + i, "copies of one text are one class here") for i in range(60)]


@pytest.mark.parametrize("block", [512, 7])
def test_hot_groups(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = hot_rows()
    assert result(ngram_join.similar_documents(frame(spark, rows))) == brute(rows)


def test_near_copies_are_not_listed_in_pairs(spark):
    words = [f"w{i}" for i in range(200)]
    hashes, at = ngram_join.shingle_hashes(pa.array([" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in range(150)]))
    sets = {hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])}
    rows = [(i, len(s) // 8, 1, np.frombuffer(s, np.int64).tolist()) for i, s in enumerate(sorted(sets))]
    made = spark.createDataFrame(rows, "c long, n long, size long, hashes array<long>")
    marked, limit = ngram_join.marks(made)
    listed = ngram_join.lists(marked)
    pairs = ngram_join.pairs_apart(listed, ngram_join.homes(listed), limit).count()
    linked = ngram_join.linked_sets(made).groupBy().sum("others").first()[0]
    assert linked == 150 * 149 and pairs < linked / 100


@pytest.mark.parametrize("dense", [True, False])
def test_overlaps(dense):
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 40, 40 if dense else 4000)
    sets = [np.unique(rng.choice(pool, 30)) for _ in range(50)]
    got = ngram_join._overlaps(sets)
    for i, a in enumerate(sets):
        assert [x for j, x in enumerate(got[i].tolist()) if j != i] == [len(np.intersect1d(a, b)) for j, b in enumerate(sets) if j != i]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert result(ngram_join.similar_documents(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_and_keep_one(spark):
    assert ngram_join.similar_documents(frame(spark, [])).count() == 0
    rows = crowd(9) + EDGES
    kept = ngram_join.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n", "c", "h"]
    want = {r[0] for r in brute(rows) if r[0] == r[3] or r[1] == 0}
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("sent", [8 << 20, 0])
def test_keep_one_without_repeated_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(common, "SENT_BYTES", sent)
    rows = crowd(4) + [(900, None), (None, "a b c d e f"), (901, "A b c d e f"), (902, "")]
    got = [r.doc_id for r in ngram_join.keep_one(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted((r[0] for r in brute(rows) if r[0] == r[3] or r[1] == 0), key=str)


def test_word_hashes_by_chunks(monkeypatch):
    texts = pa.array(["ab CD  ef", "", None, " x\ty\x0b", "é zz", "long" * 50 + " b", "tail"])
    want, at = word_hashes(*text_bytes(texts))
    assert np.diff(at).tolist() == [3, 0, 0, 2, 2, 2, 1]
    monkeypatch.setattr(common, "_CHUNK", 16)
    again, at2 = word_hashes(*text_bytes(texts))
    assert (want == again).all() and (at == at2).all()
    one, _ = word_hashes(*text_bytes(pa.array(["AB cd"])))
    assert (one == want[:2]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
