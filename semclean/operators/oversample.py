"""More rows of a minority."""

from __future__ import annotations

import json
from typing import Any

from pydantic import BaseModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_column, require_positive, row_key
from ..functions.json_repair import parse
from ..plans.sampling import strided_rows
from ..plans.schema import require_model
from ..providers import Provider

ROUNDS = 5


def resampled(df: DataFrame, target_col: str, target_value: Any, n: int, seed: int = 7) -> DataFrame:
    """Up to ``n`` new rows whose columns are drawn from minority rows one by one, by hashes; none copies a row of ``df``.

    Minority rows are numbered by a hash order; a new row takes its columns from rows that a hash of its
    number and the column's name picks. All picks are looked up by one join, nothing is collected.
    """
    minority = df.filter(F.col(target_col) == F.lit(target_value))
    m = minority.count()
    if not m:
        raise ValueError(f"No rows found where {target_col} = {target_value!r}")
    from ..plans.sampling import ranked

    rows, _ = ranked(minority, [F.xxhash64(F.lit(seed), *df.columns), *[F.col(c) for c in df.columns]])
    draws = [F.struct(F.lit(k).alias("k"), F.pmod(F.xxhash64(F.lit(seed), F.lit(c), "id"), F.lit(m)).alias("pick")) for k, c in enumerate(df.columns)]
    picks = df.sparkSession.range(n * ROUNDS).select(F.col("id").alias("__i"), F.explode(F.array(*draws)).alias("d")).select("__i", "d.k", "d.pick")
    met = picks.alias("p").join(rows.select("__rank", F.struct(*[F.col(c) for c in df.columns]).alias("__row")), F.expr("p.pick = __rank"))
    values = [F.first(F.when(F.col("p.k") == k, F.col("__row")[c]), ignorenulls=True).alias(c) for k, c in enumerate(df.columns)]
    made = met.groupBy(F.col("p.__i").alias("__i")).agg(*values).withColumn("__key", row_key(df.columns))
    first = made.groupBy("__key").agg(F.min("__i").alias("__i"))
    new = made.join(first, ["__key", "__i"]).join(df.select(row_key(df.columns).alias("__key")), "__key", "left_anti")
    return new.orderBy("__i").limit(n).select(*df.columns)


def oversample(df: DataFrame, target_col: str, target_value: Any, n: int, schema: type[BaseModel] | None = None, *, batch_size: int = 10, provider: Provider | None = None, seed: int = 7) -> DataFrame:
    """``df`` and up to ``n`` new rows with ``target_value``, none a copy of one that is there.

    A model's records must validate against ``schema``; it is asked at most ``ROUNDS`` times for
    ``batch_size`` each, columns it lacks are null, and never more than ``n`` are added.
    """
    require_column(df, target_col)
    require_positive(n=n, batch_size=batch_size)
    if provider is None or provider.deterministic:
        return df.unionByName(resampled(df, target_col, target_value, n, seed))
    require_model(schema)
    minority = df.filter(F.col(target_col) == F.lit(target_value))
    examples = [r.asDict(recursive=True) for r in strided_rows(minority, 20).collect()]
    if not examples:
        raise ValueError(f"No rows found where {target_col} = {target_value!r}")
    found: list[dict] = []
    for _ in range(ROUNDS):
        if len(found) >= n:
            break
        try:
            reply = parse(provider.generate(f"Write {min(batch_size, n - len(found))} new records like these as JSON with key records:\n{json.dumps(examples, default=str)}"), [])
        except Exception:
            continue
        for record in reply.get("records", []) if isinstance(reply, dict) else reply:
            try:
                found.append(schema.model_validate(record).model_dump())
            except Exception:
                continue
    if not found:
        return df
    rows = [(i, *[r.get(c) for c in df.columns]) for i, r in enumerate(found)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    made = df.sparkSession.createDataFrame(rows, f"__i int, {kinds}").withColumn("__key", row_key(df.columns))
    once = made.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("__i"))).filter("__n = 1")
    new = once.join(df.select(row_key(df.columns).alias("__key")), "__key", "left_anti").orderBy("__i").limit(n)
    return df.unionByName(new.select(*df.columns))
