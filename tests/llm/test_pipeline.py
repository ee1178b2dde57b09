import re
from collections import Counter, defaultdict

import corpus_pipeline
from semclean.llm import langid
from semclean.llm.common import release_scratch
from tests.llm.test_line_dedup import LOWER, SPACE
from tests.llm.test_ngram_join import brute as brute_groups
from tests.llm.test_others import plain_prediction
from tests.llm.test_tokens_packing_mixing import brute_mix, check_packing
from semclean.llm.tokenizer import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_lines(rows, least=40, most=5):
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) >= most and doc != max(holders[key(x)]))]
        if len(kept) == len(lines) or re.search(r"[^ \t-\r]", "\n".join(kept)):
            out[doc] = "\n".join(kept)
    return out


def test_every_stage_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(90000, None, "en", "src0", 0), (90001, "", None, None, 0), (90002, "12 34 !!", "de", "src1", 8)], docs.schema)
    docs = docs.unionByName(odd)
    got = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, sf_dir)
        made.write.parquet(str(tmp_path / name))
        got[name] = now = spark.read.parquet(str(tmp_path / name))
    release_scratch(corpus_pipeline.OWNER)
    for name in ("language_id", "line_dedup", "ngram_join", "mixing"):
        assert got[name].columns == COLUMNS
    rows = {n: [tuple(r) for r in df.collect()] for n, df in got.items()}
    texts = lambda n: {r[0]: r[1] for r in rows[n]}

    before = {r.doc_id: r.text for r in docs.collect()}
    assert set(before) - set(texts("language_id")) >= {90000, 90001, 90002}
    net = langid.train(docs)
    sure = {i: plain_prediction(net, t)[1] for i, t in before.items() if t and any(c.isalpha() for c in t) and len(t) < 2000}
    assert len(sure) > 100
    assert all((i in texts("language_id")) == (score >= 0.4) for i, score in sure.items() if abs(score - 0.4) > 1e-3)
    assert all(i in sure or len(before[i]) >= 2000 for i in texts("language_id"))

    assert texts("line_dedup") == kept_lines(list(texts("language_id").items()))
    assert all(r[4] == len(r[1]) for r in rows["line_dedup"])

    groups = brute_groups(list(texts("line_dedup").items()))
    assert set(texts("ngram_join")) == {i for i, n, _, root in groups if i == root or not n}

    queue = [(r[0], r[1], r[3]) for r in rows["ngram_join"]]
    taken = Counter()
    for k, _, _, _, words in brute_mix(queue)[0]:
        taken[queue[k][0]] += words
    size = {i: len((t or "").split()) for i, t, _ in queue}
    assert Counter(r[0] for r in rows["mixing"]) == +Counter({i: int(taken[i] / n + 0.5) for i, n in size.items() if n})

    check_packing(got["packing"].collect(), 4096, [(r[0], r[1]) for r in rows["mixing"]], tokenizer_path("word_bpe_49k.json"), 1)


ODD = ["__id", "__stays", "__rows", "n_lines", "n_dropped", "__lines", "__dropped", "__copy", "__epochs", "__last", "__source", "N", "size", "h", "k1", "piece", "length"]


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, repeats, ties, long and empty texts, and columns called like what the stages use."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = [(70000, None, None, None, None), (None, None, "en", "s", 0), (None, "a text that has no id at all " * 3, None, None, 87), (70001, "the same row " * 9, "en", "t", 1), (70001, "the same row " * 9, "en", "t", 1), (70002, "long words and more " * 40_000, "en", "t", 9), (70003, "", "", "", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", *[f"doc_id as `{c}`" for c in ODD])
    kept = set()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        rows = made.collect()
        assert made.columns == (docs.columns if name != "packing" else ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        if name != "packing":
            assert all(r[c] == r.doc_id for r in rows for c in ODD)
            docs = spark.createDataFrame(rows, made.schema)
            kept = {r.doc_id for r in rows}
    assert {70002} <= kept and not {70000, 70003} & kept


def test_stages_on_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_run(spark, sf_dir):
    made = corpus_pipeline.run(spark, sf_dir)
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and made.count() > 50
