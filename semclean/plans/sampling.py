"""Bounded samples with a stated order.

Spark has no row order, so every strided sample takes an ordering; without one all columns order. Ranks
are computed without one global window: rows are range-sorted into partitions, partitions are counted
(one small row each), and a row's rank is its partition's base plus its place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import not_blank, require_positive
from .dedup_map import persisted


def ranked(df: DataFrame, order: list[Column], name: str = "__rank") -> tuple[DataFrame, int]:
    """``df`` with a global 0-based rank in ``order``, and the number of rows."""
    # kept, since the layout into partitions may be another one when the plan runs again
    spread = persisted(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    # partition number and place within it, as that id is laid out
    spread = spread.withColumn("__part", F.shiftright("__at", 33)).withColumn("__in", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    totals = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    bases, total = [], 0
    for part, n in totals:
        bases.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(bases, "__part long, __base long")
    return spread.join(F.broadcast(table), "__part").withColumn(name, F.col("__base") + F.col("__in")).drop("__at", "__part", "__in", "__base"), total


def _strides(rows: DataFrame, total: int, n: int) -> DataFrame:
    want = sorted({int(i * (total / n)) for i in range(n)})
    return rows.filter(F.col("__rank").isin(want)).orderBy("__rank").drop("__rank")


def strided_rows(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """All rows if there are at most ``n``, else those at ``floor(i * rows / n)`` in the order; ties by all columns.

    With ``order_by`` only those columns are sorted and ranked; the rows with the sampled keys are fetched after.
    """
    require_positive(n=n)
    if len(df.limit(n + 1).collect()) <= n:
        return df
    if not order_by or set(order_by) == set(df.columns):
        rows, total = ranked(df, [F.col(c) for c in order_by or df.columns])
        return _strides(rows, total, n)
    keys, total = ranked(df.select(*order_by), [F.col(c) for c in order_by])
    want = sorted({int(i * (total / n)) for i in range(n)})
    at = [F.col(c).alias(f"__k{i}") for i, c in enumerate(order_by)]
    picked = keys.filter(F.col("__rank").isin(want)).select(*at, F.col("__rank").alias("__want"))
    same = lambda left: [left[c].eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(order_by)]
    names = [f"__k{i}" for i in range(len(order_by))]
    first = keys.join(F.broadcast(picked.select(*names).distinct()), same(keys), "left_semi").groupBy(*order_by).agg(F.min("__rank").alias("__first"))
    fetched = df.join(F.broadcast(picked.select(*names).distinct()), same(df), "left_semi")
    place = F.row_number().over(Window.partitionBy(*order_by).orderBy(*df.columns)) - 1
    placed = fetched.withColumn("__place", place).join(F.broadcast(first.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(order_by)], "__first")), same(fetched))
    found = placed.withColumn("__rank", F.col("__first") + F.col("__place")).filter(F.col("__rank").isin(want))
    return found.orderBy("__rank").select(*df.columns)


def length_stratified(df: DataFrame, column: str, n: int, always_sorted: bool = False) -> list[str]:
    """Distinct non-blank values: all if at most ``n``, else strided over (length, value)."""
    require_positive(sample_size=n)
    values = df.select(F.col(column).cast("string").alias("v")).filter(not_blank(F.col("v"))).distinct()
    few = values.limit(n + 1).collect()
    if len(few) <= n:
        found = [r.v for r in few]
        return sorted(found, key=lambda v: (len(v), v)) if always_sorted else sorted(found)
    rows, total = ranked(values, [F.length("v"), F.col("v")])
    return [r.v for r in _strides(rows, total, n).collect()]


def null_rows(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first ``n`` rows where ``column`` is null."""
    return df.filter(F.col(column).isNull()).limit(n)


def head_rows(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def chunks(values: list, size: int) -> list[list]:
    """Slices of at most ``size`` values."""
    require_positive(batch_size=size)
    return [values[i : i + size] for i in range(0, len(values), size)]
