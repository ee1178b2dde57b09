"""Queries over whole tables, one or more per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pydantic import BaseModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate
from .functions import pii
from .functions.columns import cache_key, field_f1, row_key
from .operators import profile
from .operators.clean import clean
from .operators.entities import resolve_entities
from .operators.extract import extract, extract_compiled
from .operators.features import crosses, discover_features
from .operators.optimize import score_candidates
from .operators.oversample import oversample
from .operators.quality import flag_rows, quality_summary, validate_quality
from .operators.scrub import detected, scrub
from .operators.shred import Relational, shred_to_relations
from .plans.dedup_map import shared_folder
from .plans.sampling import length_stratified, null_rows, ranked, strided_rows
from .providers import RuleProvider
from .sources.cache import temporary_cache

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EMAIL_SQL, CARD_SQL, IP_SQL = pii.EMAIL, pii.CARD, pii.IPV4_STRICT

# personal data


@query(f"select doc_id, regexp_replace(text, '{EMAIL_SQL}', '[EMAIL]', 'g') as text from documents")
def scrub_email(spark, sf_dir):
    return scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), ["email"], target_col="text")


@query(f"select doc_id, regexp_replace(text, '{IP_SQL}', '[IP_ADDRESS]', 'g') as text from documents")
def scrub_ip_address(spark, sf_dir):
    return scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), ["ip_address"], target_col="text")


@query(f"select doc_id, regexp_replace(text, '{CARD_SQL}', '[CREDIT_CARD]', 'g') as text from documents")
def scrub_credit_card(spark, sf_dir):
    return scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), ["credit_card"], target_col="text")


@query()
def scrub_all_rules(spark, sf_dir):
    """Phones need look-behind, which the SQL engine lacks; unit tests hold the rules."""
    return scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), ["phone", "email", "credit_card", "ip_address"], target_col="text")


@query()
def scrub_fake(spark, sf_dir):
    return scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), ["phone", "email", "credit_card", "ip_address"], "fake", target_col="text")


@query(
    f"""select doc_id, len(regexp_extract_all(text, '{EMAIL_SQL}'))::bigint as emails, len(regexp_extract_all(text, '{CARD_SQL}'))::bigint as cards,
    len(regexp_extract_all(text, '{IP_SQL}'))::bigint as addresses from documents"""
)
def pii_counts(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[pii.count_pattern(text, p).alias(n) for n, p in (("emails", pii.EMAIL), ("cards", pii.CARD), ("addresses", pii.IPV4_STRICT))])


@query(f"select doc_id, value, strpos(text, value)::bigint as position from (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '{EMAIL_SQL}'))) as value from documents)")
def pii_entities(spark, sf_dir):
    """The first place of each email of a document."""
    rows = detected(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["email"])
    found = rows.select("doc_id", F.explode("entities").alias("e"))
    return found.groupBy("doc_id", F.col("e.value").alias("value")).agg((F.min("e.start") + 1).cast("long").alias("position"))


# clean


@query("select l_orderkey, l_linenumber, (l_quantity::int)::varchar || ' kg' as raw, (l_quantity::int)::double as clean_value, 'kg' as clean_unit from lineitem")
def clean_numeric_unit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("int"), F.lit(" kg")).alias("raw"))
    return clean(rows, "raw").drop("clean_reasoning")


@query("select l_orderkey, l_linenumber, '$' || (floor(l_extendedprice + 0.5)::bigint)::varchar as raw, floor(l_extendedprice + 0.5)::double as clean_value, '$' as clean_unit from lineitem")
def clean_by_provider(spark, sf_dir):
    """The path of a model: each distinct value once, then joined back."""

    class Asked(RuleProvider):
        pass

    price = F.floor(F.col("l_extendedprice") + 0.5).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("$"), price).alias("raw"))
    return clean(rows, "raw", provider=Asked(), parallel=True).drop("clean_reasoning")


@query(
    """select o_orderkey, case o_orderstatus when 'P' then null when 'F' then '  ' else o_orderkey::varchar || 'g' end as raw,
    case when o_orderstatus not in ('P', 'F') then o_orderkey::double end as clean_value, case when o_orderstatus not in ('P', 'F') then 'g' end as clean_unit from orders"""
)
def clean_null_blank(spark, sf_dir):
    raw = F.when(F.col("o_orderstatus") == "P", None).when(F.col("o_orderstatus") == "F", "  ").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("g")))
    return clean(table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "raw").drop("clean_reasoning")


# extract and shred


class Address(BaseModel):
    scheme: str
    host: str
    path: str


ADDRESS_SOURCE = '''
import re
def extract_data(text):
    m = re.match(r"^([a-z]+)://([^/]+)(/.*)?$", text)
    return {"scheme": m.group(1), "host": m.group(2), "path": m.group(3) or ""} if m else None
'''


@query("""select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/]+(/.*)?$', 1) as path from pages""")
def extract_compiled_url(spark, sf_dir):
    rows = extract_compiled(table(spark, sf_dir, "pages").select("page_id", "url"), "url", Address, source=ADDRESS_SOURCE)
    return rows.select("page_id", "url_extracted.scheme", "url_extracted.host", "url_extracted.path")


class Props(BaseModel):
    k: int


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def extract_json_props(spark, sf_dir):
    rows = extract(table(spark, sf_dir, "events").select("event_id", "props"), Props, target_col="props")
    return rows.select("event_id", "props_extracted.k")


SHRED_SCHEMA = Relational.model_validate({"tables": [{"name": "events", "columns": ["event_id", "kind"]}, {"name": "users", "columns": ["event_id", "user_id"], "foreign_key": "event_id"}]})
SHRED_SOURCE = '''
def extract_relations(log):
    a, b, c = log.split("|")
    return {"events": {"event_id": a, "kind": b}, "users": {"event_id": a, "user_id": c}}
'''


def _shred(spark, sf_dir, name):
    log = F.concat_ws("|", "event_id", "event_type", "user_id").alias("log")
    return shred_to_relations(table(spark, sf_dir, "events").select(log), "log", schema=SHRED_SCHEMA, source=SHRED_SOURCE)[name]


@query("select event_id::varchar as event_id, event_type as kind from events")
def shred_events(spark, sf_dir):
    return _shred(spark, sf_dir, "events")


@query("select event_id::varchar as event_id, user_id::varchar as user_id from events")
def shred_users(spark, sf_dir):
    return _shred(spark, sf_dir, "users")


# statistics

_PROFILED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    " union all ".join(
        f"""select '{c}' as column_name, round(avg(x), 6) as mean, round(any_value(s), 6) as std, round(avg(pow(x - m, 2)), 4) as variance, round(avg(pow(x - m, 3)) / pow(any_value(s), 3), 6) as skew,
        round(avg(pow(x - m, 4)) / pow(any_value(s), 4) - 3, 6) as kurtosis, round(avg((x - m) * (y - my)) / (any_value(s) * any_value(sy)), 6) as corr, min(x) as min_value, max(x) as max_value
        from (select {c} as x, l_tax as y from lineitem), (select avg({c}) as m, stddev_samp({c}) as s, avg(l_tax) as my, stddev_samp(l_tax) as sy from lineitem)"""
        for c in _PROFILED
    )
)
def trap_profile(spark, sf_dir):
    rows = profile.profile(table(spark, sf_dir, "lineitem"), "l_tax", _PROFILED)
    data = [(p.column, round(p.mean, 6), round(p.std, 6), round(p.variance, 4), round(p.skew, 6), round(p.kurtosis, 6), round(p.corr, 6), float(p.min), float(p.max)) for p in rows]
    return spark.createDataFrame(data, "column_name string, mean double, std double, variance double, skew double, kurtosis double, corr double, min_value double, max_value double")


@query("select p_partkey, p_size, p_retailprice from part")
def trap_prune(spark, sf_dir):
    """A column of noise, made from hashes as a sum of twelve uniforms, goes; the others stay."""
    uniform = lambda i: F.pmod(F.xxhash64(F.lit(i), "p_partkey"), F.lit(1 << 20)) / float(1 << 20)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (sum((uniform(i) for i in range(12)), F.lit(0.0)) - 6).alias("noise"))
    return profile.prune_traps(rows, "p_retailprice", correlation_threshold=0.2, shape_threshold=0.5)[0]


def _gappy(spark, sf_dir):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", price.alias("price"))


@query("select 'price' as column_name, count(*)::bigint as nulls from orders where o_orderstatus = 'P'")
def null_counts(spark, sf_dir):
    found = profile.null_counts(_gappy(spark, sf_dir))
    return spark.createDataFrame(list(found.items()), "column_name string, nulls long")


@query("select o_orderkey, o_orderstatus, case when o_orderstatus <> 'P' then o_totalprice end as price, o_orderstatus = 'P' as price_mnar from orders")
def mnar_flags(spark, sf_dir):
    return profile.recognize_missingness(_gappy(spark, sf_dir))[0].drop("o_orderpriority")


@query(
    """with o as (select o_orderstatus, o_orderpriority, case when o_orderstatus <> 'P' then o_totalprice end as price from orders),
    g as (select o_orderstatus as key, count(*) as n, count(*) filter (where price is null) as gaps from o group by 1)
    select key, n::bigint as "rows", gaps::bigint as gaps, round(gaps / n, 6) as rate, n >= 5 and gaps > 0 and gaps / n >= 1.5 * (select sum(gaps) / sum(n) from g) as depends from g"""
)
def mnar_rates(spark, sf_dir):
    rows = profile.dependent_gaps(_gappy(spark, sf_dir), "price", "o_orderstatus")
    return rows.withColumn("rate", F.round("rate", 6))


def _leaky(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.lower("o_orderstatus").alias("status_copy"), "o_orderstatus")


@query("select o_orderkey, o_orderpriority, o_orderstatus from orders")
def leakage_audit(spark, sf_dir):
    return profile.audit_leakage(_leaky(spark, sf_dir), "o_orderstatus")[0]


@query(
    """with t as (select o_orderpriority as x, o_orderstatus as y, count(*) as n from orders group by 1, 2), u as (select lower(o_orderstatus) as x, o_orderstatus as y, count(*) as n from orders group by 1, 2)
    select 'o_orderpriority' as feature, round(sum(top) / sum(n), 6) as purity, count(*)::bigint as n_values from (select x, max(n) as top, sum(n) as n from t group by 1)
    union all select 'status_copy', round(sum(top) / sum(n), 6), count(*)::bigint from (select x, max(n) as top, sum(n) as n from u group by 1)"""
)
def leakage_purity(spark, sf_dir):
    found = profile.purity(_leaky(spark, sf_dir), "o_orderstatus", ["o_orderpriority", "status_copy"])
    return spark.createDataFrame([(k, round(float(p), 6), n) for k, (p, n) in found.items()], "feature string, purity double, n_values long")


# features, entities, samples


@query(
    """select l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) as ratio, l_extendedprice * l_quantity as product,
    l_extendedprice - l_quantity as difference, round(ln(1 + l_quantity), 6) as log_quantity from lineitem"""
)
def feature_cross(spark, sf_dir):
    made = crosses(["l_extendedprice", "l_quantity"])
    named = {"ratio": "l_extendedprice_over_l_quantity", "product": "l_extendedprice_times_l_quantity", "difference": "l_extendedprice_minus_l_quantity"}
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", *[made[k].alias(n) for n, k in named.items()], F.round(made["log_l_quantity"], 6).alias("log_quantity"))


@query()
def feature_discovery(spark, sf_dir):
    """Ranked by binned mutual information; held to a brute-force version in the tests."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return discover_features(rows, "l_extendedprice", n_features=3)


@query(
    """with v as (select distinct case when c_custkey % 2 = 0 then c_mktsegment else lower(c_mktsegment) || ' Inc.' end as raw from customer),
    f as (select raw, lower(regexp_replace(raw, ' Inc\\.$', '')) as form from v),
    c as (select form, arg_min(raw, [(-length(raw))::varchar, raw]) as canonical from (select *, row_number() over (partition by form order by length(raw) desc, raw) as k from f) where k = 1 group by 1)
    select c_custkey, raw, canonical as raw_canonical from (select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment else lower(c_mktsegment) || ' Inc.' end as raw from customer) join f using (raw) join c using (form)"""
)
def entities_canonical(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" Inc.")))
    return resolve_entities(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "raw")


@query("select quality, toxic, count(*) > 0 as present from labels group by 1, 2")
def oversample_values(spark, sf_dir):
    """The combinations that the table has are all that resampling of these columns can make."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return oversample(rows, "toxic", 1, 50).select("quality", "toxic").distinct().withColumn("present", F.lit(True))


@query("select 50::bigint as added, 0::bigint as copies, 1 as least_toxic")
def oversample_dedup(spark, sf_dir):
    """New rows are as many as asked for, minority rows, and no copies of old ones."""
    rows = table(spark, sf_dir, "orders").withColumn("toxic", F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).select("o_orderkey", "o_custkey", "o_totalprice", "toxic")
    keyed = lambda df: df.select(row_key(df.columns).alias("k"), "toxic")
    new = keyed(oversample(rows, "toxic", 1, 50)).join(keyed(rows).select("k").distinct(), "k", "left_anti")
    distinct = new.agg(F.count_distinct("k").alias("added"), F.min("toxic").alias("least_toxic"), F.count(F.lit(1)).alias("n"))
    return distinct.select("added", (F.col("n") - F.col("added")).alias("copies"), "least_toxic")


@query("""select count(*)::bigint as total_rows, (count(*) filter (where o_totalprice > 1000 and o_orderpriority <> '5-LOW'))::bigint as passed_rows,
    round((count(*) filter (where o_totalprice > 1000 and o_orderpriority <> '5-LOW'))::double / count(*), 4) as compliance_rate from orders""")
def quality_report(spark, sf_dir):
    return quality_summary(table(spark, sf_dir, "orders"), {"price": "o_totalprice > 1000", "priority": "o_orderpriority <> '5-LOW'"})


@query("""select o_orderkey, o_totalprice > 1000 and o_orderpriority <> '5-LOW' as compliant,
    concat_ws('; ', case when not o_totalprice > 1000 then 'price' end, case when not o_orderpriority <> '5-LOW' then 'priority' end) as reasoning from orders""")
def quality_failures(spark, sf_dir):
    rules = {"price": "o_totalprice > 1000", "priority": "o_orderpriority <> '5-LOW'"}
    return flag_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), rules).select("o_orderkey", "compliant", "reasoning")


_STRIDE = "select * from (select {cols}, row_number() over (order by {order}) - 1 as r, count(*) over () as n from {source}) where r in (select floor(i * (n / {k}))::bigint from range({k}) t(i))"


@query("select o_orderkey, o_totalprice from (" + _STRIDE.format(cols="o_orderkey, o_totalprice", order="o_totalprice, o_orderkey", source="orders", k=20) + ")")
def strided_sample(spark, sf_dir):
    return strided_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 20, ["o_totalprice", "o_orderkey"])


@query(
    "select count(*)::bigint as total_rows, (count(*) filter (where o_totalprice > 100000 and o_orderpriority <> '5-LOW'))::bigint as passed_rows, "
    "round((count(*) filter (where o_totalprice > 100000 and o_orderpriority <> '5-LOW'))::double / count(*), 4) as compliance_rate, "
    "(count(*) filter (where not o_totalprice > 100000))::bigint as price_failures from ("
    + _STRIDE.format(cols="*", order="o_orderkey", source="orders", k=60)
    + ")"
)
def quality_sample(spark, sf_dir):
    """The report over a strided sample, with its failures."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    found = validate_quality(rows, {"price": "o_totalprice > 100000", "priority": "o_orderpriority <> '5-LOW'"}, sample_size=60, order_by=["o_orderkey"])
    price = sum("price" in f["reasoning"].split("; ") for f in found["failures"])
    return spark.createDataFrame([(found["total_rows"], found["passed_rows"], found["compliance_rate"], price)], "total_rows long, passed_rows long, compliance_rate double, price_failures long")


@query("select o_orderkey, o_totalprice, o_custkey from (" + _STRIDE.format(cols="o_orderkey, o_totalprice, o_custkey", order="o_custkey, o_custkey, o_orderkey, o_totalprice", source="orders", k=40) + ")")
def strided_ties(spark, sf_dir):
    """An order with ties, which all columns break in turn."""
    return strided_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 40, ["o_custkey"])


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'P'")
def missing_rows(spark, sf_dir):
    rows = _gappy(spark, sf_dir)
    return null_rows(rows, "price", rows.count() + 1).select("o_orderkey", "o_orderpriority")


@query("select url from (" + _STRIDE.format(cols="url", order="length(url), url", source="(select distinct url from pages)", k=50) + ")")
def length_sample(spark, sf_dir):
    found = length_stratified(table(spark, sf_dir, "pages"), "url", 50)
    return spark.createDataFrame([(v,) for v in found], "url string")


@query("select c_custkey, row_number() over (order by c_acctbal, c_custkey) - 1 as place from customer")
def ranked_rows(spark, sf_dir):
    rows, _ = ranked(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")], "place")
    return rows.select("c_custkey", "place")


# scores and caches


@query(
    """with t as (select e, case when e % 3 <> 0 then case when e % 2 = 0 then 2 else 1 end end as good from (select event_id as e from events))
    select candidate, round(2 * p * r / (p + r), 6) as f1 from (
      select e % 4 as candidate, sum(good) / (2.0 * count(good)) as p, sum(good) / (2.0 * count(*)) as r from t group by 1)"""
)
def instruction_f1(spark, sf_dir):
    """Structs of two fields, the second blank for odd ids, null for every third row."""
    second = F.when(F.col("event_id") % 2 == 0, F.lit("x")).otherwise(" ")
    made = F.when(F.col("event_id") % 3 != 0, F.struct(F.col("event_type").alias("a"), second.alias("b")))
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("candidate"), made.alias("extracted"))
    return score_candidates(rows).withColumn("f1", F.round("f1", 6))


@query("select doc_id, sha256('v3::keep::' || text) as hash_key, doc_id % 2 = 0 as hit from documents")
def cache_hit_miss(spark, sf_dir):
    """Replies for even documents are stored; texts then split into hits and misses by joins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").alias("value"), "text")
    cache = temporary_cache(spark, shared_folder(spark))
    cache.append(docs.filter("doc_id % 2 = 0").select("value", F.lit("{}").alias("reply")), "keep")
    hits, misses = cache.split(docs.select("value"), "keep")
    marked = hits.select("value", F.lit(True).alias("hit")).unionByName(misses.select("value", F.lit(False).alias("hit")))
    return docs.join(marked, "value").select("doc_id", cache_key("keep", F.col("text")).alias("hash_key"), "hit")


@query("select count(*)::bigint as cases, round(avg((lower(c_mktsegment) = c_mktsegment or c_custkey % 2 = 0)::int::double), 6) as mean_score, round(avg((lower(c_mktsegment) = c_mktsegment or c_custkey % 2 = 0)::int::double), 6) as pass_rate from customer")
def eval_exact_match(spark, sf_dir):
    seg = F.col("c_mktsegment")
    actual = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("\n "), seg, F.lit("\t"))).otherwise(F.lower(seg))
    scored = table(spark, sf_dir, "customer").select(evaluate.exact_match_col(actual, seg).alias("score"))
    return evaluate.summarize(scored).select("cases", F.round("mean_score", 6).alias("mean_score"), F.round("pass_rate", 6).alias("pass_rate"))


@query(
    f"""with m as (select doc_id, regexp_replace(text, '{EMAIL_SQL}', '[EMAIL]', 'g') as masked, list_append(regexp_extract_all(text, '{EMAIL_SQL}'), left(text, 4)) as tokens from documents)
    select doc_id, len(list_filter(tokens, lambda x: not contains(masked, x)))::double / len(tokens) as recall from m"""
)
def eval_masking_recall(spark, sf_dir):
    """The emails of a text, which go, and its first characters, which stay."""
    tokens = F.array_append(F.regexp_extract_all("text", F.lit("(?U)" + pii.EMAIL), F.lit(0)), F.substring("text", 1, 4))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tokens.alias("tokens"))
    return scrub(docs, ["email"], target_col="text").select("doc_id", evaluate.masking_recall_col(F.col("text"), F.col("tokens")).alias("recall"))


@query("select c_mktsegment, round(sum(((c_name <> '')::int + (c_mktsegment <> '')::int)) / (2.0 * count(*)), 6) as f1 from customer group by 1")
def field_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.struct("c_name", "c_mktsegment").alias("s"))
    return rows.groupBy("c_mktsegment").agg(F.round(field_f1(rows, "s"), 6).alias("f1"))
