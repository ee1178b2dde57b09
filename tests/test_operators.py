import json
import random
import statistics

import pytest
from pydantic import BaseModel
from pyspark.sql import functions as F

import semclean
from semclean.operators import profile
from semclean.operators.entities import near_forms
from semclean.operators.extract import error_counts, extract_one
from semclean.operators.features import crosses, mutual_information
from semclean.operators.shred import Relational
from semclean.plans.sampling import length_stratified, strided_rows
from semclean.plans.schema import ddl_of, struct_of
from semclean.providers import RuleProvider, ScriptedProvider
from semclean.sources.cache import CodeCache, ResultCache


class Product(BaseModel):
    name: str
    price: int


class Deep(BaseModel):
    ok: bool | None = None
    tags: list[int] | None = None
    inner: Product | None = None
    more: dict[str, float] = {}


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame([("10kg", 1), ("500g", 2), ("10kg", 3), (None, 4), ("  ", 5), ("none", 6)], "weight string, other long")


def test_clean_fans_out_and_keeps_nulls(weights):
    rows = {r.other: (r.clean_value, r.clean_unit) for r in semclean.clean(weights, "weight").collect()}
    assert rows == {1: (10.0, "kg"), 2: (500.0, "g"), 3: (10.0, "kg"), 4: (None, None), 5: (None, None), 6: (None, None)}
    with pytest.raises(ValueError, match="Column 'x' not found in DataFrame"):
        semclean.clean(weights, "x")
    with pytest.raises(ValueError):
        semclean.clean(weights, "weight", batch_size=0)


def test_clean_without_values_and_twice(spark, weights):
    blank = spark.createDataFrame([(None,), ("",), ("   ",)], "weight string")
    assert semclean.clean(blank, "weight").columns == ["weight"]
    twice = semclean.clean(semclean.clean(weights, "weight"), "weight")
    assert "clean_value_right" in twice.columns and twice.count() == 6


def test_clean_by_model_and_failing_batches(weights):
    told = ScriptedProvider(cleaned={"10kg": {"reasoning": "r", "value": 10, "unit": "kg"}})
    rows = {r.other: r.clean_value for r in semclean.clean(weights, "weight", provider=told).collect()}
    assert rows[1] == rows[3] == 10.0 and rows[2] is None
    broken = ScriptedProvider(replies=["no"])
    assert {r.clean_unit for r in semclean.clean(weights, "weight", provider=broken, parallel=True, max_workers=0).collect()} == {None}


def test_rules_agree_with_columns(spark):
    texts = ["1,234.5 kg", "$10", "20 EUR", "-3.5°C", "about 7", "x", "€ 99", "12 m/s then 4 kg"]
    rows = semclean.clean(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    for r in rows:
        want = RuleProvider().clean_one(r.t)
        assert (r.clean_value, r.clean_unit) == ((want["value"], want["unit"]) if want else (None, None)), r.t


def test_scrub(spark):
    df = spark.createDataFrame([("mail a@b.co", 1), (None, 2), (" ", 3), ("plain", 4)], "t string, i long")
    rows = {r.i: r.t for r in semclean.scrub(df, ["email"], target_col="t").collect()}
    assert rows == {1: "mail [EMAIL]", 2: None, 3: " ", 4: "plain"}
    assert semclean.scrub("x a@b.co") == "x [EMAIL]"
    with pytest.raises(ValueError, match="target_col required"):
        semclean.scrub(df)
    told = ScriptedProvider(replies=['{"entities": [{"type": "person", "value": "plain"}]}'])
    rows = {r.i: r.t for r in semclean.scrub(df, ["person", "email"], target_col="t", provider=told).collect()}
    assert rows[4] == "[PERSON]" and rows[1] == "mail [EMAIL]" and rows[2] is None


def test_extract_and_cache(spark, tmp_path):
    df = spark.createDataFrame([('{"name": "a", "price": 1}',), ('{"name": "a", "price": 1}',), ("bad",), (None,)], "t string")
    cache = ResultCache(spark, str(tmp_path / "cache"))
    for _ in range(2):
        rows = semclean.extract(df, Product, target_col="t", cache=cache).collect()
        assert sorted(str(r.t_extracted) for r in rows) == ["None", "None", "Row(name='a', price=1)", "Row(name='a', price=1)"]
    assert cache.table().count() == 1
    with pytest.raises(ValueError, match="BaseModel"):
        semclean.extract(df, dict, target_col="t")
    with pytest.raises(ValueError, match="target_col required"):
        semclean.extract(df, Product)
    out, models = semclean.extract(df.limit(1), Product, target_col="t", output_type="pydantic")
    assert models == [Product(name="a", price=1)] and out.count() == 1


def test_error_counts(spark):
    df = spark.createDataFrame([('{"name": "a", "price": 1}',), ("bad",), ("worse",), ('{"name": "a", "price": "x"}',), (None,)], "t string")
    rows = error_counts(df, "t", Product).collect()
    assert sum(r.n for r in rows) == 3 and all(r.samples for r in rows)


def test_retries_tell_what_went_wrong():
    told = ScriptedProvider(replies=["nope", '{"name": "x"}', '{"name": "x", "price": 2}'])
    assert extract_one("t", Product, "i", told).price == 2
    assert [p.count("IMPORTANT") for p in told.prompts] == [0, 1, 2]
    with pytest.raises(ValueError, match="2 attempts"):
        extract_one("t", Product, "i", ScriptedProvider(replies=["no"]), max_retries=2)


def test_cache_keeps_first_and_skips_nulls(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "c"))
    assert cache.get_batch(["a"], "i") == {}
    cache.set_batch({"a": '{"v": 1}', "b": None, "c": "not json"}, "i")
    cache.set_batch({"a": '{"v": 2}'}, "i")
    assert cache.get_batch(["a", "b", "c", "a"], "i") == {"a": '{"v": 1}'}
    assert cache.get_batch(["a"], "other") == {} and cache.compact().count() == 2
    code = CodeCache(tmp_path / "x" / "code.db")
    assert code.get_code("k") is None
    code.set_code("k", "1")
    code.set_code("k", "2")
    assert code.get_code("k") == "2"


def test_extract_compiled(spark):
    df = spark.createDataFrame([("name: ab, price: 3",), ("name: x",), (None,), ("boom",)], "t string")
    rows = {r.t: r.t_extracted for r in semclean.extract_compiled(df, "t", Product).collect()}
    assert rows["name: ab, price: 3"].price == 3 and rows["name: x"] is None and rows[None] is None
    good = "def extract_data(text):\n    return {'name': text, 'price': len(text)}"
    told = ScriptedProvider(replies=["def extract_data(text): return 1", f"```python\n{good}\n```"])
    rows = {r.t: r.t_extracted for r in semclean.extract_compiled(df, "t", Product, provider=told).collect()}
    assert rows["boom"].price == 4 and len(told.prompts) == 2
    with pytest.raises(ValueError, match="after 3 attempts"):
        semclean.extract_compiled(df, "t", Product, provider=ScriptedProvider(replies=["nothing"]))


def test_schema_types():
    assert ddl_of(Product) == "name string, price bigint"
    assert struct_of(Deep).simpleString() == "struct<ok:boolean,tags:array<bigint>,inner:struct<name:string,price:bigint>,more:map<string,double>>"


def test_shred(spark, tmp_path):
    df = spark.createDataFrame([("1|a",), ("2|b",), ("bad",), (None,)], "log string")
    schema = {"tables": [{"name": "x", "columns": ["id"]}, {"name": "y", "columns": ["id", "v"]}]}
    source = "def extract_relations(log):\n    a, b = log.split('|') if '|' in log else (log, None)\n    return {'x': {'id': a}, 'y': {'id': a, 'v': b}}"
    cache = CodeCache(tmp_path / "c.db")
    told = ScriptedProvider(replies=[json.dumps(schema), source])
    out = semclean.shred_to_relations(df, "log", provider=told, cache=cache)
    assert set(out) == {"x", "y"} and out["y"].columns == ["id", "v"] and out["x"].count() == 4
    again = semclean.shred_to_relations(df, "log", provider=ScriptedProvider(replies=[json.dumps(schema)]), cache=cache)
    assert sorted(str(r.v) for r in again["y"].collect()) == ["None", "None", "a", "b"]
    assert semclean.shred_to_relations(df, "log", schema=Relational.model_validate(schema), provider=ScriptedProvider(replies=["x"])) == {}
    with pytest.raises(ValueError, match="No valid entries"):
        semclean.shred_to_relations(df.filter("log is null"), "log", provider=told)


def test_resolve_entities(spark):
    df = spark.createDataFrame([("Acme Inc.",), ("acme",), ("ACME",), ("Globex Corp",), ("Globexx",), (None,), ("Other",)], "n string")
    rows = {r.n: r.n_canonical for r in semclean.resolve_entities(df, "n").collect()}
    assert rows["Acme Inc."] == rows["acme"] == rows["ACME"] == "Acme Inc." and rows["Globexx"] == rows["Globex Corp"] and rows[None] is None and rows["Other"] == "Other"
    told = ScriptedProvider(replies=['{"mapping": {"acme": "ACME", "Other": " "}}'])
    rows = {r.n: r.n_canonical for r in semclean.resolve_entities(df, "n", provider=told).collect()}
    assert rows["acme"] == "ACME" and rows["Other"] == "Other"
    for bad in (0, 1.5):
        with pytest.raises(ValueError, match="threshold"):
            semclean.resolve_entities(df, "n", threshold=bad)
    assert semclean.resolve_entities(df.filter("n is null"), "n").columns == ["n", "n_canonical"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.95, 0.8, 0.6, 0.3])
def test_near_forms_against_all_pairs(spark, threshold):
    rng = random.Random(5)
    forms = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(70)}
    forms |= {f[:-1] + rng.choice("abc") + rng.choice(["", "x"]) for f in forms}
    got = {(r.big, r.small) for r in near_forms(spark.createDataFrame([(f,) for f in forms], "form string"), threshold).collect()}
    assert got == {(a, b) for a in forms for b in forms if a > b and edits(a, b) <= int(max(len(a), len(b)) * (1 - threshold) + 1e-9)}


def test_quality(spark):
    df = spark.createDataFrame([("a", 5), ("", 200), (None, 7)], "name string, age long")
    report = semclean.validate_quality(df, {"named": "name <> ''", "age": "age < 120"})
    assert (report["total_rows"], report["passed_rows"], report["compliance_rate"]) == (3, 1, 0.3333)
    assert sorted(f["reasoning"] for f in report["failures"]) == ["named", "named; age"]
    assert semclean.validate_quality(df.limit(0), ["age > 1"])["compliance_rate"] == 1.0
    told = ScriptedProvider(replies=['{"compliant": true, "reasoning": ""}', "garbage"])
    assert semclean.validate_quality(df, ["be nice"], provider=told)["passed_rows"] == 1
    with pytest.raises(ValueError, match="At least one rule"):
        semclean.validate_quality(df, [])


def test_oversample(spark):
    df = spark.createDataFrame([(i % 7, i * 1.5, "m" if i < 6 else "M") for i in range(40)], "a long, v double, label string")
    out = semclean.oversample(df, "label", "m", 10)
    new = out.subtract(df).collect()
    assert out.count() == 50 and len(new) == 10 and {r.label for r in new} == {"m"}
    with pytest.raises(ValueError, match="No rows found"):
        semclean.oversample(df, "label", "zz", 3)

    class Record(BaseModel):
        a: int
        v: float
        label: str

    told = ScriptedProvider(replies=['{"records": [{"a": 1, "v": 2, "label": "m"}, {"a": 0, "v": 0.0, "label": "m"}, {"a": "x"}]}'])
    assert semclean.oversample(df, "label", "m", 3, Record, provider=told).count() == 41


def noise_frame(spark):
    rng = random.Random(42)
    rows = [(float(rng.randint(500, 3000)), rng.gauss(0, 1), 3) for _ in range(400)]
    return spark.createDataFrame([(s, g, c, s * 100 + 5) for s, g, c in rows], "sqft double, noise double, constant int, price double")


def test_profile_and_traps(spark):
    df = noise_frame(spark)
    found = {p.column: p for p in profile.profile(df, "price")}
    x = [r.noise for r in df.collect()]
    m, s = statistics.fmean(x), statistics.stdev(x)
    assert found["noise"].skew == pytest.approx(statistics.fmean((v - m) ** 3 for v in x) / s**3)
    assert found["noise"].kurtosis == pytest.approx(statistics.fmean((v - m) ** 4 for v in x) / s**4 - 3)
    assert (found["constant"].corr, found["constant"].skew, found["constant"].kurtosis) == (0, 0, 0)
    assert profile.profile(df.limit(1), "price") == []
    out, summary = semclean.prune_traps(df, "price", correlation_threshold=0.15, shape_threshold=0.8)
    assert summary["dropped_columns"] == ["noise"] and "noise" not in out.columns
    told = ScriptedProvider(replies=['[{"column": "col_0", "is_trap": true}, {"column": "made_up", "is_trap": true}]'])
    assert semclean.prune_traps(df, "price", provider=told)[1]["dropped_columns"] == ["sqft"]
    with pytest.raises(ValueError, match="Target column 'x' not found"):
        semclean.prune_traps(df, "x")
    assert semclean.prune_traps(df.select("price"), "price")[1]["dropped_columns"] == []


def test_profile_with_nulls(spark):
    rows = [(float(i) if i % 3 else None, float(i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "x double, y double")
    (p,) = profile.profile(df, "y")
    xs, ys = [a for a, _ in rows if a is not None], [b for _, b in rows]
    mx, my = statistics.fmean(xs), statistics.fmean(ys)
    want = statistics.fmean((a - mx) * (b - my) for a, b in rows if a is not None) / (statistics.stdev(xs) * statistics.stdev(ys))
    assert p.corr == pytest.approx(want)


def test_missingness(spark):
    rows = [(None if c == "b" else float(i), c, i) for i, c in enumerate("abcab" * 8)]
    df = spark.createDataFrame(rows, "price double, category string, quantity long")
    assert profile.null_counts(df) == {"price": 16}
    out, summary = semclean.recognize_missingness(df)
    assert out.filter("price_mnar").count() == 16 and summary["patterns"]["price"]["mnar_count"] == 16
    told = ScriptedProvider(replies=["def encode_missingness(row):\n    return row.get('quantity', 0) > 20"])
    out, summary = semclean.recognize_missingness(df, provider=told)
    assert summary["patterns"]["price"]["mnar_count"] == 19
    out, summary = semclean.recognize_missingness(df, provider=ScriptedProvider(replies=["junk"]))
    assert summary["patterns"] == {"price": None} and out.columns == df.columns
    assert semclean.recognize_missingness(df.select("quantity"))[1] == {"patterns": {}}


@pytest.mark.parametrize("listed", [1000, 3])
def test_missingness_of_many_values(spark, monkeypatch, listed):
    monkeypatch.setattr(profile, "LISTED_VALUES", listed)
    rows = [(None if s % 10 == 0 else float(i), None if s == 7 else f"s{s}", i) for s in range(100) for i in range(10)]
    df = spark.createDataFrame(rows, "price double, store string, id long")
    out, summary = semclean.recognize_missingness(df, ["price"])
    assert out.columns == [*df.columns, "price_mnar"] and out.count() == 1000
    assert out.filter("price_mnar").count() == summary["patterns"]["price"]["mnar_count"] == 100
    assert out.filter("price_mnar and price is not null").count() == 0
    # gaps by chance: some of 200 values have many of them, which tells nothing
    by_chance = df.withColumn("price", F.when(F.xxhash64("store", "id") % 5 != 0, F.lit(1.0))).select("price", "store")
    assert semclean.recognize_missingness(by_chance, ["price"])[1]["patterns"] == {"price": None}


def test_leakage(spark):
    df = spark.createDataFrame([(i, i % 2, "xy"[i % 2], i % 5) for i in range(50)], "id long, y long, copy string, other long")
    out, summary = semclean.audit_leakage(df, "y")
    assert summary["dropped_columns"] == ["copy"] and out.columns == ["id", "y", "other"]
    told = ScriptedProvider(replies=["[{", '[{"column": "other", "is_leakage": true}, {"column": "ghost", "is_leakage": true}]'])
    assert semclean.audit_leakage(df, "y", provider=told)[1]["dropped_columns"] == ["other"]


def test_features(spark):
    df = spark.createDataFrame([(float(i + 1), float(i % 5), (i + 1) / (i % 5 + 1)) for i in range(60)], "a double, b double, t double")
    out = semclean.discover_features(df, "t", n_features=2)
    assert len(out.columns) == 5 and out.count() == 60
    made = crosses(["a", "b"])
    score = mutual_information(df, "t", {"self": F.col("t"), **made})
    assert max(score, key=score.get) == "self" and all(v >= -1e-9 for v in score.values())
    told = ScriptedProvider(replies=["def generate_features(row):\n    return {'s': row['a'] / row['b']}"])
    rows = semclean.discover_features(df, "t", provider=told).collect()
    assert sum(r.s is None for r in rows) == 12
    assert semclean.discover_features(df, "t", provider=ScriptedProvider(replies=["no"])).columns == df.columns
    with pytest.raises(ValueError):
        semclean.discover_features(df, "t", n_features=0)


def test_optimize(spark):
    df = spark.createDataFrame([("name: a, price: 1",), ("name: b, price: 2",)], "t string")

    def reply(prompt):
        if "Reword" in prompt:
            return '{"variations": ["better", " "]}'
        return '{"name": "a", "price": 1}' if prompt.startswith("better") else '{"name": "", "price": 1}'

    assert semclean.optimize_instruction(df, "t", Product, "base", provider=ScriptedProvider(reply)) == "better"
    assert semclean.optimize_instruction(df, "t", Product, "base") == "base"


def test_samples(spark):
    df = spark.createDataFrame([(f"val_{i:03d}",) for i in range(200)], "v string")
    assert length_stratified(df, "v", 10) == [f"val_{i:03d}" for i in range(0, 200, 20)]
    few = spark.createDataFrame([("aaa",), ("b",), (None,), (" ",), ("cc",)], "v string")
    assert length_stratified(few, "v", 9, always_sorted=True) == ["b", "cc", "aaa"]
    assert [r.v for r in strided_rows(df, 4, ["v"]).collect()] == ["val_000", "val_050", "val_100", "val_150"]


def test_join_by_shuffle_spreads_blank_texts(spark, monkeypatch):
    from semclean.plans import dedup_map

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else " " if i % 3 == 1 else f"{i} kg") for i in range(60)], "i int, t string").repartition(4)
    mapping = spark.createDataFrame([(f"{i} kg", float(i)) for i in range(60)], "value string, made double")
    sent = sorted(map(tuple, dedup_map.join_back(rows, "t", mapping).collect()))
    monkeypatch.setattr(dedup_map, "BROADCAST_BYTES", 0)
    joined = dedup_map.join_back(rows, "t", mapping)
    assert sorted(map(tuple, joined.collect())) == sent and joined.columns == ["i", "t", "made"]
    assert {i: v for i, _, v in sent} == {i: float(i) if i % 3 == 2 else None for i in range(60)}


def test_strided_rows_with_ties_and_nulls(spark):
    from semclean.plans.sampling import strided_rows

    data = [(None if i % 7 == 0 else i % 5, i) for i in range(83)]
    got = [tuple(r) for r in strided_rows(spark.createDataFrame(data, "k int, i int"), 9, ["k"]).collect()]
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [order[int(i * (83 / 9))] for i in range(9)]


def test_mutual_information_against_counting(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from semclean.operators.features import mutual_information

    data = [(float(i % 13) if i % 11 else None, "abc"[i % 3] if i % 17 else None) for i in range(400)]
    got = mutual_information(spark.createDataFrame(data, "x double, y string").repartition(3), "y", {"x": F.col("x")})
    bins = [(None if x is None else min(int(x / 1.2), 9), y) for x, y in data]
    both, left, right = Counter(bins), Counter(b for b, _ in bins), Counter(y for _, y in bins)
    want = sum(n / 400 * math.log(n * 400 / (left[b] * right[y])) for (b, y), n in both.items())
    assert abs(got["x"] - want) < 1e-9
