import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from semclean.llm import mixing, packing, token_output
from semclean.llm.tokenizer import CACHE_CHARS, PieceTokenizer, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "\n\n a", "It's  they'LL\t\n x", "İstanbul é́ é", "你好 world", "a b c", "<|endoftext|> x", "hello <|endoftext|> bye<|startoftext|>", "<|ENDOFTEXT|> a<|endoftext|><|endoftext|>", "!!'s 12 3", "x" * 5000, "  lead trail  ", "ŉ ǅ ß ẞ", "a\x1cb\x85c", "don't 'S", "½²ª"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, rank long"


def library_ids(path, texts):
    """Ids by the library alone, as the contract's call gives them."""
    library = Tokenizer.from_file(path)
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 7, 7) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_encode_as_the_library(spark, sf_dir, path):
    library = Tokenizer.from_file(path)
    ours = PieceTokenizer(path)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts:
        assert np.frombuffer(ours.encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:80])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_letters_encode_as_the_library(path):
    texts = [f"a{c}b {c} {c}li" for c in map(chr, [*range(0x21, 0x250), *range(0x2010, 0x2028), 0x212A, 0x212B])]
    got = [np.frombuffer(x, "<i4").tolist() for x in PieceTokenizer(path).encode_all(texts)]
    assert [t for t, x, y in zip(texts, got, library_ids(path, texts), strict=True) if x != y] == []


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_new_pieces_take_the_model_alone(path):
    """The normalizer and the pre-tokenizer, which cost more than the merging, aren't run on pieces."""
    rng = np.random.default_rng(3)
    letters = list("abdelmrstv'  \n\t\r1.!-«É") + ["'s", "'LL ", "ı", "Ș"]
    texts = ["=" * 100, "=" * 100] + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    want = library_ids(path, texts)
    ours = PieceTokenizer(path)
    ours.entries, ours.library = 50, type("Library", (), {"model": ours.library.model})
    got = [x for at in range(0, len(texts), 100) for x in ours.encode_all(texts[at : at + 100])]
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == want
    assert max(map(len, ours.cache)) <= CACHE_CHARS


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_batches_encode_as_the_library(path):
    """Cut by batch, with ends, texts that go to the library whole, long pieces and generations of the cache."""
    rng = np.random.default_rng(5)
    parts = list("aestrvmldRE''''   \n\t\r19.!-«É¡—‐’ıȘ") + ["'s", "'re", "'ll ", "'d", "  '", " 'm", "\n've", "é'", "你", "<|endoftext|>", "=" * 70, " " * 70]
    weights = np.array([0.02 if len(x) > 10 or x == "你" else 1 for x in parts])
    texts = ODD + ["".join(rng.choice(parts, rng.integers(0, 25), p=weights / weights.sum())) for _ in range(4000)]
    ours = PieceTokenizer(path)
    ours.entries = 300
    for at in range(0, len(texts), 150):
        some = texts[at : at + 150]
        for tail in ((), (2,), (7, 8)):
            ids, lengths = ours.encode_joined(some, tail)
            want = [[*x, *tail] for x in library_ids(path, some)]
            assert lengths.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]
    assert [len(x) for x in ours.encode_joined([], (2,))] == [0, 0]


def test_new_pieces_are_merged_many_at_once():
    """Calls of the model for one new piece each took most of the time."""
    texts = [f"{a}{b} {b}{a}" for a in "abcdefghijklm" for b in ("ent", "ous", "ing", "lich", "keit", "ción", "eur", "tz")]
    want = library_ids(BYTE, texts)
    ours = PieceTokenizer(BYTE)
    model, calls = ours.library.model, []

    class Counting:
        def tokenize(self, piece):
            calls.append(piece)
            return model.tokenize(piece)

    ours.library = type("Library", (), {"model": Counting()})
    ours.forget()
    assert [np.frombuffer(x, "<i4").tolist() for x in ours.encode_all(texts)] == want
    assert len(ours.cache) > 150
    assert len(calls) <= len(ours.cache) / 20
    assert ours.encode_all(texts) and len(calls) <= len(ours.cache) / 20


def test_marks_stand_only_between_pieces_that_they_leave_alone():
    from semclean.llm.tokenizer import _mark_id

    model = {"vocab": {"Ā": 3, "a": 4}, "merges": [["a", "a"], "a b"]}
    assert _mark_id(model) == 3
    for other in ({"merges": [["Ā", "a"]]}, {"merges": ["a Ā"]}, {"vocab": {}}, {"end_of_word_suffix": "</w>"}, {"continuing_subword_prefix": "##"}, {"ignore_merges": True}):
        assert _mark_id(model | other) is None


def test_token_files(spark, tmp_path):
    rows = [(i * 3, t, "s") for i, t in enumerate(ODD)] + [(6, "repeat", "s"), (6, "repeat", "s"), (None, None, None), (99, None, "s")]
    path = str(tmp_path / "t")
    token_output.write_tokens(docs(spark, rows), path, BYTE, 2, parts=3)
    got = sorted(token_output.token_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    start = 0
    crcs = defaultdict(set)
    for (i, _, _), ids in zip(rows, library_ids(BYTE, [r[1] for r in rows]), strict=True):
        crcs[i].add(zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        assert r.ids_crc32 in crcs[r.doc_id]
    few = token_output.read_tokens(spark, path, ["doc_id", "n_tokens"], first=3, last=9)
    assert sorted(r.doc_id for r in few.collect()) == [3, 6, 6, 6, 9]
    assert "ids" not in few._jdf.queryExecution().executedPlan().toString()


def test_token_files_of_no_rows(spark, tmp_path):
    token_output.write_tokens(docs(spark, []), str(tmp_path / "t"), BYTE, 2)
    assert token_output.token_digests(spark, str(tmp_path / "t")).count() == 0


def check_packing(rows, capacity, texts, path, end):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for (i, _), ids in zip(texts, library_ids(path, [t for _, t in texts]), strict=True):
        ids = [*ids, end]
        for k in range(0, len(ids), capacity):
            part = np.array(ids[k : k + capacity], "<u4")
            want[i, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(bins), sum(r.length for r in rows)


def test_packing_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in table.collect()]
    n, total = check_packing(packing.pack(table, WORD, 1).collect(), 4096, texts, WORD, 1)
    assert n <= -(-total // 4096) + 1


def test_packing_edges(spark):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(3, "same", "s")] * 5 + [(None, None, None)]
    check_packing(packing.pack(docs(spark, rows), WORD, 1, capacity=16).collect(), 16, [r[:2] for r in rows], WORD, 1)
    assert packing.pack(docs(spark, []), WORD, 1).count() == 0


def test_fullest_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 30, 5)}
        room = int(rng.integers(1, 60))
        reach = {0}
        for n, c in counts.items():
            reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
        found = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(n * k for n, k in found) == max(reach)
        assert all(k <= counts[n] for n, k in found)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def brute_mix(rows, most=3, packet=256, seed=17):
    """(doc, epoch, packet, finish, words) served, by queues in plain Python."""
    from hashlib import md5

    queues, sizes = defaultdict(list), Counter()
    for k, (i, text, source) in enumerate(rows):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        h = md5(f"{seed}:{'-' if i is None else i}:{md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        queues[source].append((h, i is not None, i or 0, n, k))
    target, packets = brute_targets(sizes, most=most), []
    for source, queue in queues.items():
        sent = 0
        for epoch in range(most):
            for *_, n, k in sorted(queue):
                for at in range(0, n, packet):
                    words = min(packet, n - at)
                    if sent < target[source]:
                        i = rows[k][0]
                        packets.append(((sent + words) / target[source], i is not None, i or 0, source is not None, source or "", epoch, at // packet, k, words))
                    sent += words
    out, left = [], sum(sizes.values())
    for finish, *_, epoch, at, k, words in sorted(packets):
        if left > 0:
            out.append((k, epoch, at, finish, min(words, left)))
            left -= min(words, left)
    return out, target


MIXED = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "q w", None), (None, "r w", None), (4, " \t\n", "z")] + [(i, "w " * 300 + str(i), "hot") for i in range(9, 40)] + [(41, "long " * 3000, "x"), (42, "u v " * 500, "y")]


def test_mixing_against_queues(spark):
    served, target = brute_mix(MIXED)
    taken = Counter()
    for k, _, _, _, words in served:
        taken[k] += words
    got = mixing.mix(docs(spark, MIXED)).collect()
    want = Counter((i, len((t or "").split()), target[s], taken[k]) for k, (i, t, s) in enumerate(MIXED))
    assert Counter((r.doc_id, r.size, target_of(r.target, target), r.taken) for r in got) == want
    order = mixing.finish_times(docs(spark, MIXED)).collect()
    assert [(r.doc_id, r.source, r.epoch, r.packet, r.words) for r in order] == [(MIXED[k][0], MIXED[k][2], e, p, w) for k, e, p, _, w in served]
    assert [r.finish for r in order] == sorted(r.finish for r in order)


def target_of(x, target):
    return min(target.values(), key=lambda t: abs(t - x))


def test_mixing(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(table).collect()
    source = {r.doc_id: r.source for r in table.collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.source_size == sizes[source[r.doc_id]]
    for s, t in taken.items():
        assert abs(t - want[s]) <= mixing.PACKET
    assert sum(taken.values()) == sum(sizes.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(table.repartition(3)).collect()))


def test_mixing_of_no_rows(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mixed_documents(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "x"), (2, "", None)])).groupBy().sum("taken").first()[0] == 0


def test_mixing_slices_and_ranges_agree(spark, monkeypatch):
    rows = [(i, "w " * (i % 700), f"s{i % 3}") for i in range(300)]
    whole = sorted(map(tuple, mixing.mix(docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 20)
    monkeypatch.setattr(mixing, "RANGE_WORDS", 3000)
    assert sorted(map(tuple, mixing.mix(docs(spark, rows)).collect())) == whole


def test_mixed_documents(spark):
    from pyspark.sql import functions as F

    rows = [r for r in MIXED if r[0] != 1]
    table = docs(spark, rows).withColumn("__copy", F.lit("mine")).withColumn("__epochs", F.col("doc_id"))
    served, _ = brute_mix(rows)
    taken = Counter()
    for k, _, _, _, words in served:
        taken[k] += words
    size = [len((t or "").split()) for _, t, _ in rows]
    want = Counter({(i, t): int(taken[k] / size[k] + 0.5) for k, (i, t, _) in enumerate(rows) if size[k]})
    got = mixing.mixed_documents(table)
    assert got.columns == table.columns and {r["__copy"] for r in got.collect()} == {"mine"}
    assert Counter((r.doc_id, r.text) for r in got.collect()) == +want
