"""Statistics of numeric columns, noise columns, telling gaps and leaks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codegen.sandbox import compile_sandboxed, compiled, run_with_timeout
from ..codegen.sanitizer import sanitize_source
from ..functions.columns import require_column, require_positive
from ..functions.json_repair import verdict_array
from ..plans.sampling import head_rows, null_rows
from ..providers import Provider

TARGET = "Target column '{}' not found"


@dataclass(frozen=True)
class ColumnProfile:
    """Population moments over sample deviations: what the verdicts on noise go by."""

    column: str
    mean: float
    std: float
    variance: float
    corr: float
    skew: float
    kurtosis: float
    min: float
    max: float


def numeric_columns(df: DataFrame, target_col: str) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != target_col]


def _moments(x: Column, y: Column, prefix: str) -> list[Column]:
    """Aggregates of one column; skewness, kurtosis and correlation rescaled from population to sample deviations."""
    n = F.count(x)
    shrink = (n - 1) / n
    std = F.stddev_samp(x)
    varied = std > 0
    return [
        n.alias(prefix + "n"),
        F.avg(x).alias(prefix + "mean"),
        std.alias(prefix + "std"),
        F.var_pop(x).alias(prefix + "variance"),
        F.when(varied, F.skewness(x) * F.pow(shrink, 1.5)).otherwise(0.0).alias(prefix + "skew"),
        F.when(varied, (F.kurtosis(x) + 3) * F.pow(shrink, 2) - 3).otherwise(0.0).alias(prefix + "kurtosis"),
        F.min(x).alias(prefix + "min"),
        F.max(x).alias(prefix + "max"),
    ]


def profile(df: DataFrame, target_col: str, columns: list[str] | None = None) -> list[ColumnProfile]:
    """Profiles of numeric columns in one aggregation; a second one only for columns with nulls.

    Fewer than two rows give none; a constant column has correlation, skewness and kurtosis 0. The
    correlation is the mean product of deviations over the product of sample deviations.
    """
    columns = numeric_columns(df, target_col) if columns is None else columns
    if not columns:
        return []
    y = F.col(target_col).cast("double") if isinstance(df.schema[target_col].dataType, T.NumericType) else F.lit(None).cast("double")
    aggregates = [F.count(F.lit(1)).alias("rows"), F.count(y).alias("ny"), F.avg(y).alias("my"), F.stddev_samp(y).alias("sy")]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggregates += [*_moments(x, y, f"c{i}_"), F.covar_pop(x, y).alias(f"c{i}_cov")]
    row = df.agg(*aggregates).first()
    if row["rows"] < 2:
        return []
    gaps = [i for i in range(len(columns)) if row[f"c{i}_n"] < row["rows"] or row["ny"] < row["rows"]]
    again = {}
    if gaps and row["my"] is not None:
        products = [F.avg((F.col(columns[i]).cast("double") - F.lit(row[f"c{i}_mean"])) * (y - F.lit(row["my"]))).alias(f"c{i}") for i in gaps]
        again = df.agg(*products).first().asDict()
    out = []
    for i, c in enumerate(columns):
        get = lambda k: row[f"c{i}_{k}"]  # noqa: B023, E731
        std, sy = get("std") or 0.0, row["sy"] or 0.0
        cov = again.get(f"c{i}") if i in gaps else get("cov")
        corr = cov / (std * sy) if cov is not None and std > 0 and sy > 0 else 0.0
        out.append(ColumnProfile(c, get("mean") or 0.0, std, get("variance") or 0.0, corr, get("skew") or 0.0, get("kurtosis") or 0.0, get("min") or 0.0, get("max") or 0.0))
    return out


def _asked(provider: Provider, prompt: str, max_retries: int) -> list[dict]:
    for _ in range(max_retries):
        try:
            return [v for v in verdict_array(provider.generate(prompt)) if isinstance(v, dict)]
        except Exception:
            continue
    return []


def prune_traps(df: DataFrame, target_col: str, *, correlation_threshold: float = 0.05, max_retries: int = 2, provider: Provider | None = None, shape_threshold: float = 0.3) -> tuple[DataFrame, dict[str, Any]]:
    """Drop numeric columns that look like Gaussian noise: symmetric, of normal tails, and unrelated to the target.

    The rule: |skewness| and |excess kurtosis| below ``shape_threshold`` and |correlation| below
    ``correlation_threshold``. A model sees profiles under made-up names. Returns the frame and a summary.
    """
    require_column(df, target_col, TARGET)
    require_positive(max_retries=max_retries)
    profiles = profile(df, target_col)
    if not profiles:
        return df, {"dropped_columns": [], "verdicts": []}
    if provider is None or provider.deterministic:
        verdicts = [
            {"column": p.column, "is_trap": p.std > 0 and abs(p.skew) < shape_threshold and abs(p.kurtosis) < shape_threshold and abs(p.corr) < correlation_threshold, "reason": f"skew {p.skew:.3f}, kurtosis {p.kurtosis:.3f}, corr {p.corr:.3f}"}
            for p in profiles
        ]
    else:
        alias = {f"col_{i}": p.column for i, p in enumerate(profiles)}
        shown = [{**asdict(p), "column": a} for a, p in zip(alias, profiles, strict=True)]
        replies = _asked(provider, f"Which columns are noise (skew and kurtosis near 0, |corr| < {correlation_threshold})? Reply with a JSON list of column, is_trap, reason.\n{json.dumps(shown)}", max_retries)
        verdicts = [{"column": alias[v["column"]], "is_trap": v.get("is_trap") is True, "reason": str(v.get("reason", ""))} for v in replies if v.get("column") in alias]
    dropped = [v["column"] for v in verdicts if v["is_trap"]]
    return df.drop(*dropped), {"dropped_columns": dropped, "verdicts": verdicts}


# missingness


def null_counts(df: DataFrame, columns: list[str] | None = None) -> dict[str, int]:
    """Columns with nulls and how many, in one pass."""
    columns = df.columns if columns is None else columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns) if row[i]}


def dependent_gaps(df: DataFrame, column: str, by: str, lift: float = 1.5, least_rows: int = 5) -> DataFrame:
    """(key, rows, gaps, rate, depends): values of ``by`` under which ``column`` is null at ``lift`` times its overall rate."""
    groups = df.groupBy(F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNull()).alias("gaps"))
    overall = groups.agg((F.sum("gaps") / F.sum("rows")).alias("overall"))
    return groups.join(F.broadcast(overall)).select("key", "rows", "gaps", (F.col("gaps") / F.col("rows")).alias("rate"), ((F.col("rows") >= least_rows) & (F.col("gaps") > 0) & (F.col("gaps") / F.col("rows") >= lift * F.col("overall"))).alias("depends"))


#: A context column with more values than this must differ in its null rates by more than chance gives.
MOST_VALUES = 64
#: Standard deviations above what chance gives.
CHANCE = 5.0
#: Dependent values that a condition lists; more are joined.
LISTED_VALUES = 1000


def _beyond_chance(groups: DataFrame, least_rows: int = 5) -> bool:
    """Whether null rates of ``groups(rows, gaps)`` differ more than random gaps would, by the chi-square of all values with rows enough."""
    p = groups.agg(F.sum("gaps") / F.sum("rows")).first()[0]
    if not p or p >= 1:
        return False
    v = p * (1 - p)
    n = F.col("rows")
    row = groups.filter(n >= least_rows).agg(F.count(F.lit(1)).alias("k"), F.sum(F.pow(F.col("gaps") - n * p, F.lit(2)) / (n * v)).alias("chi"), F.sum(2 + (1 - 6 * v) / (n * v)).alias("spread")).first()
    return bool(row["k"]) and row["chi"] - row["k"] > CHANCE * row["spread"] ** 0.5


def _rule_flag(df: DataFrame, out: DataFrame, column: str, lift: float) -> tuple[DataFrame, str] | None:
    """``out``, which is ``df`` with flags, with ``{column}_mnar`` by the category under which gaps depend most."""
    best: tuple[int, str, DataFrame, int] | None = None
    for f in df.schema:
        if f.name == column or not isinstance(f.dataType, (T.StringType, T.BooleanType, T.IntegralType)):
            continue
        groups = dependent_gaps(df, column, f.name, lift)
        got = groups.agg(F.count(F.lit(1)).alias("k"), F.count_if("depends").alias("n"), F.sum(F.when(F.col("depends"), F.col("gaps"))).alias("score")).first()
        if not got["n"] or (best is not None and got["score"] <= best[0]) or (got["k"] > MOST_VALUES and not _beyond_chance(groups)):
            continue
        best = (got["score"], f.name, groups.filter("depends").select("key"), got["n"])
    if best is None:
        return None
    _, name, found, n = best
    if n > LISTED_VALUES:
        there = found.select(F.col("key").alias("__key"), F.lit(True).alias("__there"))
        wide = out.join(there, F.col(name).eqNullSafe(F.col("__key")), "left")
        flag = F.col(column).isNull() & F.coalesce(F.col("__there"), F.lit(False))
        return wide.withColumn(f"{column}_mnar", flag).drop("__key", "__there"), f"null rate depends on {name} in {n} values"
    keys = [r.key for r in found.collect()]
    there = F.col(name).isin([k for k in keys if k is not None])
    if None in keys:
        there = there | F.col(name).isNull()
    return out.withColumn(f"{column}_mnar", F.col(column).isNull() & F.coalesce(there, F.lit(False))), f"null rate depends on {name} in {keys}"


def flag_udf(source: str, columns: list[str]):
    """``encode_missingness(row)`` on whole rows; anything but a bool is False."""

    @F.pandas_udf("boolean")
    def run(rows):
        fn = compiled(source, "encode_missingness", ("math", "re", "statistics"))
        return rows.apply(lambda r: run_with_timeout(fn, {k: None if v != v else v for k, v in r.items()})[0] is True, axis=1)

    return run(F.struct(*columns))


def recognize_missingness(df: DataFrame, target_cols: list[str] | None = None, *, sample_size: int = 50, max_retries: int = 3, provider: Provider | None = None, lift: float = 1.5) -> tuple[DataFrame, dict[str, Any]]:
    """Add ``{col}_mnar`` to columns with nulls whose absence tells something, and say what.

    The rule: among text, boolean and integer columns, values under which the null rate is ``lift`` times the
    overall one; a row is flagged if its value is null under one of them. A column of more than ``MOST_VALUES``
    values counts if its null rates differ beyond chance, since among many values some differ by chance. A model writes ``encode_missingness(row)`` from up
    to ``sample_size`` such rows. A column without a pattern has ``None`` and no flag.
    """
    for c in target_cols or []:
        require_column(df, c)
    require_positive(sample_size=sample_size, max_retries=max_retries)
    gaps = null_counts(df, target_cols)
    patterns: dict[str, Any] = {}
    out = df
    flagged = []
    for c, n in gaps.items():
        if provider is None or provider.deterministic:
            found = _rule_flag(df, out, c, lift)
            if found is None:
                patterns[c] = None
                continue
            out, why = found
        else:
            context = [x for x in df.columns if x != c]
            rows = [r.asDict(recursive=True) for r in null_rows(df, c, sample_size).select(*context).collect()]
            source, why = None, ""
            for _ in range(max_retries):
                try:
                    attempt = sanitize_source(provider.generate(f"Write Python encode_missingness(row) -> bool for column {c}.\n{json.dumps(rows, default=str)}"))
                    fn = compile_sandboxed(attempt, "encode_missingness", ("math", "re", "statistics"))
                    if all(isinstance(run_with_timeout(fn, r)[0], bool) for r in rows[:5]):
                        source, why = attempt, "generated"
                        break
                except Exception:
                    continue
            if source is None:
                patterns[c] = None
                continue
            out = out.withColumn(f"{c}_mnar", flag_udf(source, df.columns))
        flagged.append(c)
        patterns[c] = {"pattern": why, "null_count": n}
    if flagged:
        counts = out.agg(*[F.count_if(F.col(f"{c}_mnar")).alias(f"n{i}") for i, c in enumerate(flagged)]).first()
        for i, c in enumerate(flagged):
            patterns[c]["mnar_count"] = counts[i]
    return out, {"patterns": patterns}


# leakage


def purity(df: DataFrame, target_col: str, features: list[str]) -> dict[str, tuple[float, int]]:
    """For each feature the share of rows that its value's commonest target explains, and its distinct values.

    One pass: rows become (feature, value, target) counts by map-side combining, so a value with a third of
    all rows is one row per task.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("x")) for i, c in enumerate(features)]))
    counts = df.select(F.col(target_col).cast("string").alias("y"), cells.alias("f")).groupBy("f.i", "f.x", "y").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("i", "x").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    rows = best.groupBy("i").agg((F.sum("top") / F.sum("n")).alias("p"), F.count(F.lit(1)).alias("k")).collect()
    return {features[r.i]: (r.p, r.k) for r in rows}


def audit_leakage(df: DataFrame, target_col: str, domain: str = "", *, max_retries: int = 2, sample_n: int = 10, provider: Provider | None = None, least_purity: float = 0.99, unique_share: float = 0.5) -> tuple[DataFrame, dict[str, Any]]:
    """Drop features that give the target away.

    The rule: knowing the feature's value leaves the target sure (purity at least ``least_purity``, and more
    than the commonest target alone), unless the feature is nearly unique. A model judges by ``sample_n`` rows
    and the domain; names it makes up are ignored.
    """
    require_column(df, target_col, TARGET)
    require_positive(max_retries=max_retries, sample_n=sample_n)
    features = [c for c in df.columns if c != target_col]
    if not features:
        return df, {"dropped_columns": [], "verdicts": []}
    if provider is None or provider.deterministic:
        # sketches first: a feature that is clearly nearly unique is no leak by the rule and isn't shuffled
        about = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c, 0.05).alias(f"k{i}") for i, c in enumerate(features)]).first()
        total = about["n"]
        counted = [c for i, c in enumerate(features) if about[f"k{i}"] <= 1.25 * unique_share * total]
        sure = purity(df, target_col, counted) if counted else {}
        base = (df.groupBy(target_col).count().agg(F.max("count")).first()[0] or 0) / max(1, total)
        verdicts = [{"column": c, "is_leakage": p >= least_purity and p > base and k <= unique_share * total, "reason": f"purity {p:.4f} over {k} values"} for c, (p, k) in sure.items()]
        verdicts += [{"column": c, "is_leakage": False, "reason": "nearly unique"} for c in features if c not in sure]
    else:
        rows = [r.asDict(recursive=True) for r in head_rows(df, sample_n).collect()]
        replies = _asked(provider, f"Domain: {domain}. Which features are known only after {target_col}? Reply with a JSON list of column, is_leakage, reason.\n{json.dumps(rows, default=str)}", max_retries)
        verdicts = [{"column": v["column"], "is_leakage": v.get("is_leakage") is True, "reason": str(v.get("reason", ""))} for v in replies if v.get("column") in features]
    dropped = [v["column"] for v in verdicts if v["is_leakage"]]
    return df.drop(*dropped), {"dropped_columns": dropped, "verdicts": verdicts}
