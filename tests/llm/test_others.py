import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from semclean.llm import chat, embedding_dedup, fingerprint, langid
from semclean.llm.tokenizer import tokenizer_path

BYTE = tokenizer_path("byte_bpe_50k.json")


# chat
def turns(spark, rows):
    return spark.createDataFrame([(*r, 5, "y") for r in rows], "conv_id long, turn long, role string, text string, chunk int, formatted string")


TRICKY = ["", "\\### Assistant: </turn> ok", "####### <text> <<text>> </turn></turn>", "\\", "\\\\n\n", "<|endoftext|> é 你好 😀", " lead\n\n", "\n</turn>\n### user\n<text>hi</turn>\n", None]


def want_chat(rows):
    out, by = [], defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        out.append((c, len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1 << 20, 60])
def test_chat_round_trip(spark, sf_dir, chunk):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(TRICKY)] + [(2, 0, "assistant", t) for t in TRICKY] + [(None, None, None, None), (3, 1, "ro\nle\\###", "x"), (3, 0, "system", "y"), (3, 0, "system", "y")]
    rows += [(100 + r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    made = chat.format_chat(turns(spark, rows), BYTE, chunk_chars=chunk)
    got = sorted((tuple(r)[:5] for r in chat.chat_digests(made, BYTE).collect()), key=str)
    assert got == want_chat(rows)
    table = chat._id_bytes(BYTE) | {chat._chat_tokenizer(BYTE).token_to_id(c): c.encode() for c in chat.CONTROL}
    for r in made.collect():
        assert b"".join(table[i] for i in r.input_ids).decode() == r.formatted
        assert 50256 not in r.input_ids


def test_chat_chunks_encode_as_whole(spark):
    rows = [(1, i, "user", t) for i, t in enumerate(TRICKY)]
    whole = chat.format_chat(turns(spark, rows), BYTE).collect()
    parts = sorted(chat.format_chat(turns(spark, rows), BYTE, chunk_chars=10).collect(), key=lambda r: r.chunk)
    assert len(whole) == 1 < len(parts)
    assert sum((list(r.input_ids) for r in parts), []) == list(whole[0].input_ids)
    assert chat.format_chat(turns(spark, []), BYTE).count() == 0


# fingerprints
def texts(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, part int, ahead string")


def jaccard(a, b):
    a, b = (Counter(re.findall(r"[^ \t-\r]+", x.lower())) for x in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_neighbours(spark):
    rows = [(5, "alpha beta beta"), (1, None), (9, "Über Alles x"), (2, ""), (7, "alpha beta beta"), (None, "no id"), (9, "again"), (9, "again"), (12, "w " * 40_000)]
    got = fingerprint.compare_neighbours(texts(spark, rows), parts=3).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:3] for r in got) == want
    marks = defaultdict(set)
    for r in got:
        marks[r.doc_id].add(r.fingerprint)
    assert marks[5] == marks[7] and marks[1] == {""}
    assert [r.near_next for r in got if r.doc_id == 1] == [1.0]
    single = fingerprint.compare_neighbours(texts(spark, [(3, "one two")])).collect()
    assert single[0].near_next == 1.0 and len(single) == 1
    assert fingerprint.compare_neighbours(texts(spark, [])).count() == 0


def test_likeness_estimates_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(docs, parts=4).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    off = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        off += [got[i].near_edited - jaccard(t, edited), got[i].near_next - jaccard(t, n)]
    assert abs(np.mean(off)) < 0.01 and np.abs(off).mean() < 0.04
    again = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert again == {i: r.fingerprint for i, r in got.items()}


# embeddings
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, size int")


def brute_links(rows, least=0.9):
    good = [(k, i, np.array(v, np.float64)) for k, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, _, x in good:
        for b, _, y in good:
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[a].add(b)
    return links


def test_embedding_edges(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = [(k * 10 + j, [float(x) for x in np.float32(base[k] + rng.normal(size=16) * 0.15)]) for k in range(12) for j in range(4)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] * 8), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15), (906, rows[0][1]), (907, rows[0][1]), (908, [1.0, 2.0]), (909, [2.0, 4.0]), (None, rows[4][1]), (910, None), (906, rows[0][1])]
    got = embedding_dedup.near_duplicates(vectors(spark, rows), probes=50).collect()
    links = brute_links(rows)
    assert Counter((r.vec_id, r.n_links) for r in got) == Counter((rows[k][0], len(v)) for k, v in links.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert {r.vec_id: r.component_id for r in got}[906] == 0
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_embedding_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(4)
    base = np.array([v for _, v in rows])
    for k in range(0, 500, 4):
        noise = rng.normal(size=64)
        near = base[k] + noise / np.linalg.norm(noise) * np.linalg.norm(base[k]) * 0.46
        rows.append((1000 + k, [float(x) for x in near]))
    got = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    links = {rows[k][0]: len(v) for k, v in brute_links(rows).items()}
    found = {r.vec_id: r.n_links for r in got}
    assert all(found[i] <= links[i] for i in links)
    assert sum(found.values()) >= 0.95 * sum(links.values()) > 100


def test_embedding_recall_with_many_lists(spark, monkeypatch):
    """600 lists, 16 of them searched: pairs at a cosine of about 0.91 are all near the threshold."""
    monkeypatch.setattr(embedding_dedup, "PER_LIST", 10)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(4000, 64))
    noise = rng.normal(size=(2000, 64))
    near = base[:2000] + noise / np.linalg.norm(noise, axis=1)[:, None] * np.linalg.norm(base[:2000], axis=1)[:, None] * 0.44
    everything = np.float32(np.concatenate([base, near]))
    unit = everything.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    made = []
    train = embedding_dedup.train
    monkeypatch.setattr(embedding_dedup, "train", lambda *a: made.append(train(*a)) or made[-1])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(everything)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert len(made[0].centres) == 600
    assert all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.9 * want.sum() > 1000


def test_hot_list_is_cut(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, [float(x) for x in np.float32(base + rng.normal(size=8) * 0.05)]) for i in range(40)]
    got = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert {r.vec_id: r.n_links for r in got} == {rows[k][0]: len(v) for k, v in brute_links(rows).items()}
    assert {r.component_id for r in got} == {0}


# language
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.95


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, source string, score string"
    rows = [(i, ("der die und " if i % 2 else "the and of ") * 30, "de" if i % 2 else "en", "s", "x") for i in range(60)]
    odd = [(100, None, "en", None, None), (101, "", None, None, None), (102, "123 !? _", "en", None, None), (None, "the and", "en", None, None), (103, "é", None, None, None), (104, "the of and " * 100_000, None, None, None), (104, "x", None, None, None)]
    docs = spark.createDataFrame(rows + odd, schema)
    net = langid.train(docs)
    got = langid.predict(docs, net).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[104].held_out in (True, False)
    assert by[None].held_out is False and by[None].lang_pred == "en"
    kept = langid.keep_identified(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(60))
    assert langid.train(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), net).count() == 0


def plain_prediction(net, text):
    """The network written out: windows, convolutions one position after another, maxima, softmax, weighted mean."""
    data = text.encode().lower() if text.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    step, total, weights = 253, 0, 0
    for at in range(0, max(1, len(data) - 3), step):
        window = data[at : at + 256].ljust(256, b" ")
        top = np.full(len(net.bias), -np.inf)
        for p in range(253):
            top = np.maximum(top, sum(net.table[k][window[p + k]].astype(float) for k in range(4)))
        score = np.maximum(top + net.bias, 0) @ net.out + net.shift
        logp = score - score.max() - np.log(np.exp(score - score.max()).sum())
        weight = step if at + step < max(1, len(data) - 3) else max(1, len(data) - at)
        total, weights = total + weight * logp, weights + weight
    soft = np.exp(total / weights - (total / weights).max())
    return net.labels[int(soft.argmax())], float(soft.max() / soft.sum())


def test_prediction_against_the_network_written_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text) and len(r.text) < 4000}
    for i in sorted(texts)[:40]:
        label, score = plain_prediction(net, texts[i])
        assert got[i].lang_pred == label and abs(got[i].score - score) < 1e-3


def test_windows_cover_the_text():
    for n in (0, 1, 3, 4, 255, 256, 257, 509, 510, 5000):
        text = np.arange(n, dtype=np.uint8) % 251
        cut = langid.cut_windows(text)
        back = np.concatenate([cut[0], *[w[langid.OVERLAP :] for w in cut[1:]]])
        assert (back[:n] == langid._FOLD[text]).all() and (back[n:] == 32).all() and len(back) - n < langid.WINDOW + 1
