"""The corpus pipeline: language ID, line dedup, near duplicates, mixing and packing, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it and rereads it as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semclean.llm import langid, line_dedup, mixing, ngram_join, packing
from semclean.llm.common import free_name, release_scratch, scratch_owner
from semclean.llm.tokenizer import tokenizer_path


def _as(docs: DataFrame, made: DataFrame) -> DataFrame:
    """``made`` with the columns of ``docs``, and ``n_chars`` counted anew where there is one."""
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


OWNER = "pipeline"


def _stage(fn):
    """A stage begins when its predecessor's result is written, so the pipeline's earlier scratch tables can go."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_scratch(OWNER)
        with scratch_owner(OWNER):
            return fn(spark, docs, sf_dir)

    return run


@_stage
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a recognisable language go.

    Those are null, empty and letterless texts and scores under 0.4; very long texts are read whole, repeated
    rows get one answer, a null id is only left out of training. No rows give none, other columns stay.
    """
    return langid.keep_identified(docs, langid.train(docs))


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go from all but the largest ``doc_id`` holding them; a document left blank goes.

    Null texts are empty, repeated rows are documents of their own, a null id is never the largest unless
    all are null. No rows give none; other columns stay, also ones called like the operator's own counts.
    """
    n_lines, n_dropped = (free_name(docs, x) for x in ("__lines", "__dropped"))
    cleaned = line_dedup.dedup_lines(docs, names=(n_lines, n_dropped))
    return _as(docs, cleaned.filter((F.col(n_dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the smallest ``doc_id`` of each group of near duplicates stays.

    Documents without words stay; rows that repeat an id, or have none, are one document, of which the first
    by text stays. No rows give none; other columns stay.
    """
    return ngram_join.keep_one(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document comes as often as the mix takes it whole, half or more of it counting as whole.

    A document that the mix takes less than half of goes, so do those without words; one taken again is
    repeated as rows of its own. A null source is a source, rows alike in id and text are taken alike. No
    rows give none; other columns stay.
    """
    return mixing.mixed_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of every row into sequences of 4096 tokens.

    Null texts are empty, null and repeated ids are packed row by row, long texts are cut into pieces, other
    columns are ignored, no rows give none.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), 1, release=True)


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("ngram_join", one_of_each), ("mixing", mix), ("packing", pack)]

#: A network and a tokenizer are beyond SQL; the tests check run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _kept(stage(spark, docs, sf_dir), name)
    release_scratch(OWNER)
    return docs


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Write a stage's result beside the scratch tables, which the next stage releases, and read it back."""
    from uuid import uuid4

    from semclean.llm.common import shared_dir

    path = f"{shared_dir(df.sparkSession)}/pipeline-{name}-{uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
