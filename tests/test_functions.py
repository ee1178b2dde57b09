import json

import pytest

from semclean.codegen.sandbox import compile_sandboxed, run_with_timeout
from semclean.codegen.sanitizer import sanitize_source
from semclean.functions import pii
from semclean.functions.columns import code_key
from semclean.functions.json_repair import parse, repair_json, verdict_array
from semclean.functions.pii import Entity


def test_longer_entity_wins_and_first_given_on_ties():
    person, email = Entity("person", "nam", 0, 3), Entity("email", "nam@x.com", 0, 9)
    assert pii.resolve_overlaps([person, email]) == [email]
    a, b = Entity("phone", "1234", 2, 6), Entity("credit_card", "1234", 2, 6)
    assert pii.resolve_overlaps([a, b]) == [a]
    apart = [Entity("email", "b", 5, 6), Entity("email", "a", 0, 1)]
    assert pii.resolve_overlaps(apart) == apart[::-1]


def test_find_all_positions_overlap():
    assert pii.find_all_positions("aaaa", "aa") == [(0, 2), (1, 3), (2, 4)]
    assert pii.find_all_positions("abc", "x") == [] == pii.find_all_positions("abc", "")


@pytest.mark.parametrize("text,kind,values", [
    ("write to a.b+c@mail.example.org now", "email", ["a.b+c@mail.example.org"]),
    ("call 0909123456 or +84901234567", "phone", ["0909123456", "+84901234567"]),
    ("(555) 123-4567 and 555-1234", "phone", ["(555) 123-4567", "555-1234"]),
    ("card 4532-1234-5678-9010.", "credit_card", ["4532-1234-5678-9010"]),
    ("hosts 192.168.1.1, 10.0.0.1, 999.999.999.999, 010.1.1.1", "ip_address", ["192.168.1.1", "10.0.0.1"]),
    ("v6 2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ip_address", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
])
def test_detectors(text, kind, values):
    found = pii.DETECTORS[kind](text)
    assert [e.value for e in found] == values
    assert all(text[e.start : e.end] == e.value for e in found)


def test_bare_card_is_a_phone_by_order():
    text = "4532123456789010"
    assert [e.type for e in pii.detect(text, ["credit_card", "phone"])] == ["phone"]
    assert pii.detect(text, ["unknown"]) == [] and pii.detect(None, ["email"]) == []


def test_replace():
    found = pii.detect("a@b.co and 10.0.0.1", ["email", "ip_address"])
    assert pii.replace_entities("a@b.co and 10.0.0.1", found) == "[EMAIL] and [IP_ADDRESS]"
    with pytest.raises(ValueError):
        pii.replace_entities("a@b.co", found[:1], "blur")
    fake = pii.fake_value(Entity("phone", "(555) 123-4567", 0, 14))
    assert fake == pii.fake_value(Entity("phone", "(555) 123-4567", 3, 17)) and fake[0] == "(" and fake[9] == "-" and len(fake) == 14
    assert len(pii.fake_value(Entity("credit_card", "4", 0, 1))) == 16
    assert pii.fake_value(Entity("other", "x", 0, 1)) == "[OTHER]"


@pytest.mark.parametrize("text,want", [
    ('{"a": 1}', {"a": 1}),
    ('{"a": 1,}', {"a": 1}),
    ("{'a': 'x', b: True, c: None}", {"a": "x", "b": True, "c": None}),
    ('```json\n{"a": [1, 2\n```', {"a": [1, 2]}),
    ('Sure! Here: {"a": "unclosed', {"a": "unclosed"}),
    ('{"a": {"b": [1, {"c": 2}', {"a": {"b": [1, {"c": 2}]}}),
    ('[1, 2,, 3', [1, 2, 3]),
    ('{"q": "say \\"hi\\"\nthere"}', {"q": 'say "hi"\nthere'}),
])
def test_repair(text, want):
    assert json.loads(repair_json(text)) == want


def test_parse_and_verdicts():
    assert parse("no json at all", 7) == 7 and parse({"a": 1}) == {"a": 1} and parse(None, 0) == 0
    assert repair_json("nothing") == "nothing"
    assert verdict_array('Here: [{"column": "a"}] ok') == [{"column": "a"}]
    with pytest.raises(ValueError):
        verdict_array("none")


def test_sanitize():
    source = "Here is the code you asked for\n```python\ndef f(x):\n    y = x × 2 − 1\n    return y if y ≤ 0b3 else 100$\n```\nThis function does what you want"
    clean = sanitize_source(source)
    assert clean.startswith("def f") and "```" not in clean and compile_sandboxed(clean, "f")(1) == 1
    assert sanitize_source("def f(x):\n    return x + 10%3") .endswith("10%3")
    assert sanitize_source("x = `1`") == "x = 1"


def test_sandbox():
    assert compile_sandboxed("import math\ndef f(x): return math.sqrt(x)", "f", ["math"])(4) == 2
    for bad in ("import os\ndef f(): pass", "def g(): pass", "def f(:", "x = open('a')\ndef f(): pass"):
        with pytest.raises(ValueError):
            compile_sandboxed(bad, "f", ["math"])
    with pytest.raises(NameError):
        compile_sandboxed("def f(): return eval('1')", "f")()
    assert run_with_timeout(lambda x: x + 1, 2) == (3, "")
    assert run_with_timeout(lambda: 1 / 0)[0] is None
    found, why = run_with_timeout(compile_sandboxed("def f():\n while True: pass", "f"), timeout_s=0.2)
    assert found is None and "timed out" in why
    with pytest.raises(ValueError):
        run_with_timeout(len, "a", timeout_s=0)


def test_code_key_ignores_order():
    a = code_key(["x", "y"], ["int", "string"], "x", "features")
    assert a == code_key(["y", "x"], ["string", "int"], "x", "features") != code_key(["x"], ["int"], "x", "features")
    assert len(a) == 64


def test_phones_are_found_as_by_plain_search():
    import random
    import re

    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["+1 (98", "12", "555", "-", " ", "(", ")", "a", "+", "0", "84912345678", "\u0663", "02079460000"]) for _ in range(rng.randrange(25)))
        assert [(e.start, e.end) for e in pii.detect_phone(text)] == [m.span() for m in re.finditer(pii.PHONE, text)], text


def test_overlaps_as_by_comparing_all():
    import random

    rng = random.Random(5)
    for _ in range(200):
        found = [pii.Entity("x", "v", a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(12))]
        kept = []
        for e in sorted(found, key=lambda e: (e.start - e.end, e.start)):
            if all(e.end <= k.start or k.end <= e.start for k in kept):
                kept.append(e)
        assert pii.resolve_overlaps(found) == sorted(kept, key=lambda e: e.start)


def test_columns_mask_as_texts_do(spark):
    from pyspark.sql import functions as F

    texts = [None, "", " ", "no sign at all", "a.b@c.org and 4111 1111 1111 1111", "call +1 (988) 555-2485", "::1 or 10.0.0.1", "\u0663\u0664\u0665\u0666\u0667\u0668\u0669", "x@y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for strategies in (["email"], ["credit_card"], ["phone"], ["ip_address"], ["email", "phone", "credit_card", "ip_address"], ["person"]):
        got = [r[0] for r in rows.select(F.coalesce(pii.scrubbed(F.col("t"), strategies), "t")).collect()]
        assert got == [t if t is None else pii.replace_entities(t, pii.detect(t, strategies)) for t in texts], strategies
