"""Variants of one name under its canonical form."""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_column
from ..functions.json_repair import parse
from ..plans.dedup_map import distinct_values, is_small, persisted
from ..providers import Provider

log = logging.getLogger(__name__)

_SUFFIXES = r"(?i)[\s,]+(?:inc|incorporated|corp|corporation|co|company|ltd|limited|llc|gmbh|ag|sa|plc)\.?$"


def normal_form(text: Column) -> Column:
    """Lower case, without legal suffix, punctuation and extra white space."""
    bare = F.regexp_replace(F.trim(text), _SUFFIXES, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def _slack(length: int, threshold: float) -> int:
    return int(length * (1 - threshold) + 1e-9)


def segment_keys(form: str, threshold: float) -> tuple[list[str], list[str]]:
    """Keys of a form as the shorter and as the longer of a pair within the threshold's edit distance d.

    The shorter is cut into d + 1 segments, one of which an alignment of at most d edits leaves whole and moves
    by at most d; the longer lists all strings that such a segment could be. Pairs that qualify share a key.
    """
    n, shorter, longer = len(form), [], []
    size = n
    while size - n <= (d := _slack(size, threshold)):
        if d:
            cut = [i * n // (d + 1) for i in range(d + 2)]
            shorter += [f"{size}|{n}|*"] if n <= d else [f"{size}|{n}|{i}|{form[cut[i] : cut[i + 1]]}" for i in range(d + 1)]
        size += 1
    d = _slack(n, threshold)
    for m in range(max(0, n - d), n + 1) if d else ():
        if m <= d:
            longer.append(f"{n}|{m}|*")
            continue
        cut = [i * m // (d + 1) for i in range(d + 2)]
        for i in range(d + 1):
            width = cut[i + 1] - cut[i]
            longer += [f"{n}|{m}|{i}|{form[at : at + width]}" for at in range(max(0, cut[i] - d), min(n - width, cut[i] + d) + 1)]
    return sorted(set(shorter)), sorted(set(longer))


def near_forms(forms: DataFrame, threshold: float) -> DataFrame:
    """(big, small) of distinct ``forms(form)``: pairs within ``1 - threshold`` of the longer by Levenshtein distance.

    An equi-join on shared segments, so forms without a part in common never meet.
    """

    @F.pandas_udf("struct<shorter:array<string>,longer:array<string>>")
    def keys(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([segment_keys(v, threshold) for v in values], columns=["shorter", "longer"])

    keyed = forms.withColumn("k", keys("form"))
    a = keyed.select(F.col("form").alias("f"), F.explode("k.longer").alias("key"))
    b = keyed.select(F.col("form").alias("g"), F.explode("k.shorter").alias("key"))
    met = a.join(b, "key").filter(F.col("f") != F.col("g")).select(F.greatest("f", "g").alias("big"), F.least("f", "g").alias("small")).distinct()
    return met.filter(F.levenshtein("big", "small") <= F.floor(F.greatest(F.length("big"), F.length("small")) * (1 - threshold) + 1e-9))


def canonical_forms(values: DataFrame, threshold: float) -> DataFrame:
    """(value, canonical) of distinct ``values(value)``.

    Values with one normal form are a group; a group goes to the smallest form within the threshold's edit
    distance of its own. The longest value of a group stands for it, the smallest of these on ties.
    """
    forms = values.withColumn("form", normal_form(F.col("value")))
    moved = near_forms(forms.select("form").distinct(), threshold).groupBy(F.col("big").alias("f")).agg(F.min("small").alias("to"))
    grouped = forms.join(moved, F.col("form") == F.col("f"), "left").withColumn("group", F.coalesce("to", "form"))
    best = grouped.groupBy("group").agg(F.min(F.struct((-F.length("value")).alias("n"), F.col("value").alias("canonical"))).alias("best"))
    return grouped.join(best, "group").select("value", F.col("best.canonical").alias("canonical"))


def resolve_entities(df: DataFrame, target_col: str, *, threshold: float = 0.8, provider: Provider | None = None) -> DataFrame:
    """Add ``{target_col}_canonical``; what isn't mapped keeps its own text.

    The rules group by normal form and edit distance. A model gets all distinct values, sorted, at once and
    replies with a mapping, so it suits columns of few names.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    require_column(df, target_col)
    name, text = f"{target_col}_canonical", F.col(target_col).cast("string")
    values = distinct_values(df, target_col)
    if not values.head(1):
        return df.withColumn(name, text)
    if provider is None or provider.deterministic:
        mapping = persisted(canonical_forms(values, threshold), "canonical")
    else:
        names = [r.value for r in values.orderBy("value").collect()]
        reply = parse(provider.generate(f"Map each variant to one canonical name (similarity {threshold}) as JSON with key mapping:\n" + "\n".join(names)), {}, lambda x: isinstance(x, dict))
        found = {k: v for k, v in (reply.get("mapping") or {}).items() if isinstance(v, str) and v.strip()}
        mapping = df.sparkSession.createDataFrame([(n, found.get(n, n)) for n in names], "value string, canonical string")
    side = mapping.select(F.col("value").alias("__value"), F.col("canonical").alias("__canonical"))
    counts = mapping.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical").alias("k")).first()
    log.info("%s: %d distinct values under %d canonical names", target_col, counts["n"], counts["k"])
    if is_small(side):
        side = F.broadcast(side)
    return df.join(side, text == F.col("__value"), "left").withColumn(name, F.coalesce("__canonical", text)).drop("__value", "__canonical")
