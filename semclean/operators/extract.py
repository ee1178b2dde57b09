"""Typed structs from free text: by a provider with a cache, or by generated code."""

from __future__ import annotations

import pandas as pd
from pydantic import BaseModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..codegen.sandbox import compile_sandboxed, compiled, run_with_timeout
from ..codegen.sanitizer import sanitize_source
from ..functions.columns import require_column, require_positive
from ..functions.json_repair import parse
from ..plans.dedup_map import distinct_values, join_back, map_values, persisted
from ..plans.sampling import length_stratified
from ..plans.schema import plain, require_model, struct_of, to_models
from ..providers import Provider, RuleProvider
from ..sources.cache import ResultCache

MODULES = ("re", "json", "datetime", "math", "collections", "decimal", "string")


def extract_one(text: str, schema: type[BaseModel], instruction: str, provider: Provider, max_retries: int = 3) -> BaseModel:
    """One text as a model; each further attempt (``max_retries`` in all) is told what went wrong."""
    prompt = f"{instruction}\nReply with JSON for: {', '.join(schema.model_fields)}.\n"
    hint = ""
    why: Exception | None = None
    for _ in range(max_retries):
        try:
            found = parse(provider.generate(f"{prompt}{hint}Input: {text}", schema), accept=lambda x: isinstance(x, dict))
            if found is None:
                raise ValueError("the reply is no JSON object")
            return schema.model_validate(found)
        except Exception as error:
            why = error
            hint += f"IMPORTANT: the last reply was invalid ({type(error).__name__}); reply with valid JSON only.\n"
    raise ValueError(f"Extraction failed after {max_retries} attempts: {why}") from why


def _answers(schema: type[BaseModel], instruction: str, provider: Provider, max_retries: int):
    def answer(items: list[str]) -> list[dict | None]:
        out: list[dict | None] = []
        for x in items:
            try:
                out.append({"reply": extract_one(x, schema, instruction, provider, max_retries).model_dump_json()})
            except ValueError as why:
                out.append({"error": type(why.__cause__ or why).__name__})
        return out

    return answer


def extract(data: DataFrame | str, schema: type[BaseModel], instruction: str | None = None, *, target_col: str | None = None, output_type: str = "dict", max_retries: int = 3, provider: Provider | None = None, cache: ResultCache | None = None, batch_size: int = 50):
    """``{target_col}_extracted`` as a struct of the schema, asked once per distinct value.

    Replies that validate are cached by instruction and text; values that fail are null and asked
    again next time. A string gives a model. ``output_type='pydantic'`` gives (frame, models of its rows in
    their order) for small frames, since a column can't hold Python objects.
    """
    require_model(schema)
    require_positive(max_retries=max_retries)
    if output_type not in ("dict", "pydantic"):
        raise ValueError("output_type must be 'dict' or 'pydantic'")
    provider = provider or RuleProvider()
    instruction = instruction or f"Extract {schema.__name__} information from the text."
    if isinstance(data, str):
        return extract_one(data, schema, instruction, provider, max_retries)
    if target_col is None:
        raise ValueError("target_col required for DataFrame input")
    require_column(data, target_col)
    values = distinct_values(data, target_col)
    if not values.head(1):
        return data
    kind = struct_of(schema)
    reply = T.StructType([T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])
    ask = lambda todo: map_values(todo, _answers(schema, instruction, provider, max_retries), reply, batch_size)
    if cache is None:
        replies = persisted(ask(values), "replies")
    else:
        hits, misses = cache.split(values, instruction)
        fresh = persisted(ask(misses), "replies")
        cache.append(fresh, instruction)
        replies = persisted(hits.unionByName(fresh, allowMissingColumns=True), "replies")
    name = f"{target_col}_extracted"
    mapping = replies.select("value", F.from_json("reply", kind).alias(name))
    out = join_back(data.drop(name), target_col, mapping)
    return (out, to_models(out, name, schema)) if output_type == "pydantic" else out


def error_counts(df: DataFrame, target_col: str, schema: type[BaseModel], instruction: str = "Extract.", *, provider: Provider | None = None, max_retries: int = 1) -> DataFrame:
    """(error, n, samples) of the distinct values that can't be extracted: how many by kind, up to three of each."""
    require_column(df, target_col)
    fields = T.StructType([T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])
    replies = map_values(distinct_values(df, target_col), _answers(schema, instruction, provider or RuleProvider(), max_retries), fields)
    return replies.filter("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.array_distinct(F.array(F.min("value"), F.max("value"), F.min_by("value", F.xxhash64("value"))))), 1, 3).alias("samples"))


# compiled


def struct_udf(source: str, fn_name: str, kind: T.StructType, modules: tuple[str, ...] = MODULES, schema: type[BaseModel] | None = None, timeout_s: float = 2.0):
    """An Arrow batch function applying generated code to texts; a row that fails or doesn't fit the type is null.

    The source travels, each worker compiles it once.
    """

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        fn = compiled(source, fn_name, modules)
        rows = []
        for t in texts:
            row = None
            if t is not None and t.strip():
                found, _ = run_with_timeout(fn, t, timeout_s=timeout_s)
                if isinstance(found, dict):
                    try:
                        row = plain(schema.model_validate(found) if schema else found, kind)
                    except Exception:
                        row = None
            rows.append(row or dict.fromkeys(kind.names))
        return pd.DataFrame(rows, columns=kind.names)

    return run


def verify_source(source: str, fn_name: str, samples: list[str], check, modules: tuple[str, ...] = MODULES) -> str:
    """An empty string, or the first thing that is wrong with generated code on the samples."""
    try:
        fn = compile_sandboxed(source, fn_name, modules)
    except ValueError as why:
        return str(why)
    for s in samples:
        found, why = run_with_timeout(fn, s)
        if why:
            return why
        try:
            check(found)
        except Exception as error:
            return str(error)
    return ""


def generate_verified(prompt: str, fn_name: str, samples: list[str], check, provider: Provider, max_retries: int, modules: tuple[str, ...] = MODULES) -> str:
    """Source by the provider, repaired until it passes on the samples; every reply is verified, the last too."""
    ask, why = prompt, ""
    for _ in range(max_retries):
        source = sanitize_source(provider.generate(ask))
        why = verify_source(source, fn_name, samples, check, modules)
        if not why:
            return source
        ask = f"{prompt}\nThe last version failed: {why}\n{source}\nReply with the repaired code only."
    raise ValueError(f"No working '{fn_name}' after {max_retries} attempts: {why}")


RULE_SOURCE = '''
import re, json
def extract_data(text):
    names = {names!r}
    found = None
    if "{{" in text:
        try:
            found = json.loads(text[text.index("{{"):])
        except ValueError:
            found = None
    out = {{}}
    for name in names:
        if found is not None:
            out[name] = found.get(name)
            continue
        m = re.search("(?i)\\\\b" + re.escape(name) + "\\\\b\\\\s*[:=]\\\\s*(\\"[^\\"]*\\"|[^\\\\s,;]+)", text)
        out[name] = m.group(1).strip('"') if m else None
    return out
'''


def extract_compiled(df: DataFrame, target_col: str, schema: type[BaseModel], instruction: str | None = None, *, max_retries: int = 3, sample_size: int = 50, provider: Provider | None = None, source: str | None = None) -> DataFrame:
    """``{target_col}_extracted`` by a generated ``extract_data(text)``, applied where the rows are.

    The provider sees up to 20 of the sampled values; its code has to give schema-valid dicts on them.
    ``source`` skips generation; the rules have a parser of ``name: value`` pairs and JSON.
    """
    require_column(df, target_col)
    require_model(schema)
    require_positive(max_retries=max_retries, sample_size=sample_size)
    kind = struct_of(schema)
    optional = T.StructType([T.StructField(f.name, f.dataType, True) for f in kind])
    if source is None and (provider is None or provider.deterministic):
        source = RULE_SOURCE.format(names=list(schema.model_fields))
    if source is None:
        samples = length_stratified(df, target_col, sample_size)
        if not samples:
            return df
        prompt = f"Write Python extract_data(text) -> dict with keys {list(schema.model_fields)}. {instruction or ''}\nSamples:\n" + "\n".join(samples[:20])
        source = generate_verified(prompt, "extract_data", samples, schema.model_validate, provider, max_retries)
    elif not df.isStreaming and not distinct_values(df, target_col).head(1):
        return df
    name = f"{target_col}_extracted"
    made = struct_udf(source, "extract_data", optional, schema=schema)(F.col(target_col).cast("string"))
    filled = sum((F.col(name)[f.name].isNotNull().cast("int") for f in optional), F.lit(0))
    return df.withColumn(name, made).withColumn(name, F.when(filled > 0, F.col(name)))
