"""New features from pairs of numeric columns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codegen.sandbox import compile_sandboxed, compiled, run_with_timeout
from ..codegen.sanitizer import sanitize_source
from ..functions.columns import require_column, require_positive
from ..plans.sampling import strided_rows
from ..providers import Provider
from .profile import numeric_columns

MODULES = ("math", "statistics", "operator")
BINS = 10


def crosses(columns: list[str]) -> dict[str, Column]:
    """Logarithms, ratios, products, differences and sums; null where undefined."""
    x = lambda c: F.col(c).cast("double")
    out = {f"log_{c}": F.when(x(c) > -1, F.log1p(x(c))) for c in columns}
    for a, b in combinations(columns, 2):
        out[f"{a}_over_{b}"] = F.try_divide(x(a), x(b))
        out[f"{a}_times_{b}"] = x(a) * x(b)
        out[f"{a}_minus_{b}"] = x(a) - x(b)
        out[f"{a}_plus_{b}"] = x(a) + x(b)
    return out


def _count_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a target and feature bins (-1: null) as counts (i, b, y, n), added up over a task."""
    width, total = BINS + 1, {}
    for frame in frames:
        codes, values = pd.factorize(frame["y"], use_na_sentinel=False)
        for i, name in enumerate(frame.columns[1:]):
            count = np.bincount(codes * width + frame[name].to_numpy() + 1, minlength=width * len(values)).reshape(-1, width)
            for k, b in zip(*np.nonzero(count), strict=True):
                key = i, int(b) - 1, None if pd.isna(values[k]) else values[k]
                total[key] = total.get(key, 0) + int(count[k, b])
    yield pd.DataFrame([(*key, n) for key, n in total.items()], columns=["i", "b", "y", "n"])


def mutual_information(df: DataFrame, target_col: str, features: dict[str, Column]) -> dict[str, float]:
    """Binned mutual information of each feature with the target, by one table of (feature, bin, bin) counts.

    Arrow batches are counted feature by feature where the rows are; a task sends one row per count. Bins are of equal width between the feature's extremes; a numeric target is binned likewise.
    """
    numeric = target_col not in [f.name for f in df.schema if f.dataType.simpleString() in ("string", "boolean")]
    named = {f"f{i}": c for i, c in enumerate(features.values())}
    wide = df.select(F.col(target_col).alias("y"), *[c.alias(n) for n, c in named.items()])
    spans = wide.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), *[g(n).alias(f"{n}{k}") for n in named for k, g in (("0", F.min), ("1", F.max))]).first()

    def binned(col: Column, lo: float | None, hi: float | None) -> Column:
        if lo is None or hi is None or not hi > lo:
            return F.lit(0)
        return F.when(col.isNotNull(), F.least(F.floor((col - lo) / ((hi - lo) / BINS)).cast("int"), F.lit(BINS - 1)))

    y = binned(F.col("y").cast("double"), float(spans["y0"]), float(spans["y1"])).cast("string") if numeric and spans["y0"] is not None else F.col("y").cast("string")
    cells = wide.select(y.alias("y"), *[F.coalesce(binned(F.col(n), spans[f"{n}0"], spans[f"{n}1"]), F.lit(-1)).alias(n) for n in named])
    counts = cells.mapInPandas(_count_cells, "i int, b int, y string, n long").groupBy("i", "b", "y").agg(F.sum("n").cast("double").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("i", *by))
    terms = counts.select("i", "n", total().alias("t"), total("b").alias("x"), total("y").alias("z"))
    rows = terms.groupBy("i").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("x") * F.col("z")))).alias("mi")).collect()
    found = {r.i: r.mi for r in rows}
    return {name: found.get(i, 0.0) for i, name in enumerate(features)}


def feature_udf(source: str, columns: list[str]):
    """``generate_features(row)`` as ``map<string,double>``; a row that fails is empty."""

    @F.pandas_udf("map<string,double>")
    def run(rows: pd.DataFrame) -> pd.Series:
        fn = compiled(source, "generate_features", MODULES)
        out = []
        for r in rows.to_dict("records"):
            found, _ = run_with_timeout(fn, {k: None if v != v else v for k, v in r.items()})
            out.append({str(k): float(v) for k, v in found.items() if isinstance(v, (int, float))} if isinstance(found, dict) else {})
        return pd.Series(out)

    return run(F.struct(*columns))


def discover_features(df: DataFrame, target_col: str, *, n_features: int = 5, max_retries: int = 3, provider: Provider | None = None) -> DataFrame:
    """Append features; a name that is taken is replaced. The frame as it is if none can be made.

    The rules rank crosses of numeric columns by binned mutual information with the target and append the
    ``n_features`` best as column expressions. A model writes ``generate_features(row)``; its names come from
    ten sampled rows, a row that fails has nulls.
    """
    require_column(df, target_col)
    require_positive(n_features=n_features, max_retries=max_retries)
    if provider is None or provider.deterministic:
        columns = numeric_columns(df, target_col)
        if not columns:
            return df
        made = crosses(columns)
        score = mutual_information(df, target_col, made)
        best = sorted(made, key=lambda k: (-round(score[k], 12), k))[:n_features]
        return df.withColumns({k: made[k] for k in best})
    rows = [r.asDict(recursive=True) for r in strided_rows(df, 10).collect()]
    inputs = [c for c in df.columns if c != target_col]
    for _ in range(max_retries):
        try:
            source = sanitize_source(provider.generate(f"Write Python generate_features(row) -> dict of {n_features} floats to predict {target_col}.\n{json.dumps(rows, default=str)}"))
            fn = compile_sandboxed(source, "generate_features", MODULES)
            names: dict[str, None] = {}
            for r in rows:
                found, why = run_with_timeout(fn, {k: r[k] for k in inputs})
                if isinstance(found, dict):
                    names.update(dict.fromkeys(map(str, found)))
        except Exception:
            continue
        if names:
            wide = df.withColumn("__features", feature_udf(source, inputs))
            return wide.withColumns({k: F.col("__features")[k] for k in list(names)[:n_features]}).drop("__features")
    return df
