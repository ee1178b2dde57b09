"""Surrogates for personal data: keyed, type-consistent replacements that keep distinctness and coreference.

Detected values are collected over the whole corpus once each, get a surrogate, and are replaced wherever
they stand: a name found after a title in one document is replaced in every document that holds the word,
under the one kind that the whole corpus settles for it. A string of letters and digits is enciphered as a number in its own format (same length,
case, digit and letter places, separators, check digit, private or public address), which is a permutation,
so different values stay different. A name gets a made-up one of the same gender and script; equal ones
are told apart in a collision check, and every surrogate is checked against the real values.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, lean, materialize, sliced

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MALE = r"Mr|Sir|Herr|Herrn|Señor|Sr|Monsieur|Don|г-н|господин|κύριος"
_FEMALE = r"Mrs|Ms|Miss|Madam|Frau|Señora|Sra|Señorita|Madame|Mme|Mlle|Doña|г-жа|госпожа|κυρία"
_EITHER = r"Dr|Prof|Doctor|Professor|Doktor|Доктор"
_CAPITALS = "".join(c for c in map(chr, range(0x10000)) if c.isupper() or c.istitle())
_CAPITAL = f"[{_CAPITALS}]"
_JOINED = r"(?:-[^\W\d_]+|['’](?!s\b)[^\W\d_]+)"  # O'Brien, but not the genitive's 's
_WORD = rf"{_CAPITAL}(?:[^\W\d_]+{_JOINED}{{0,3}}|{_JOINED}{{1,3}})"
_INITIAL = rf"{_CAPITAL}\."
_NAME = rf"(?:{_INITIAL} ?){{0,3}}(?:{_WORD} (?:{_INITIAL} ?){{0,2}}){{0,2}}{_WORD}"
_H = "[0-9A-Fa-f]{1,4}"
_TITLES = f"(?:{_MALE}|{_FEMALE}|{_EITHER})"
_PATTERN = re.compile(
    "|".join(
        [
            r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
            r"(?P<key>\bAKIA[0-9A-Z]{16}\b)",
            r"(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|secret(?:[_-]?key)?|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?)"
            r"(?P<secret>(?<=\")[^\"\n]{6,}(?=\")|(?<=')[^'\n]{6,}(?=')|(?:[^\s\"',;#&]|#(?=[^\s\"',;#&])|&(?![\w-]+=)){6,})",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
            # short forms hold a digit and a group of three or more, unlike a slice [1::2] or a scope a::b
            rf"(?P<ipv6>(?<![\w:])(?:(?:{_H}:){{7}}{_H}|(?=[0-9A-Fa-f:]*\d)(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?!(?:[0-9A-Fa-f]*:+){{8,}}[0-9A-Fa-f])(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)(?![\w:]|\.\d))",
            rf"(?P<ipv4>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))",
            r"(?P<phone>(?<!\w)(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:(?:[ .-]?\d{3,4}){2}|(?:[ .-]?\d{2}){4}|(?:[ .-]?\d{2,4}){2,3})|\+\d{8,15}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d|\.\d))",
            rf"(?P<title>\b{_TITLES}\b\.?)\s+(?P<name>{_NAME})",
        ]
    )
)
_NAME_PART = re.compile(rf"(?P<initial>{_CAPITAL})\.|{_WORD}")
_ANCHOR = re.compile(rf"[0-9@=]|(?i:password|passwd|pwd|secret|token|key)[\"']?\s*:|\b{_TITLES}\b")
#: Where names may stand: words from a capital on, with what hyphens and apostrophes join to them.
_RUN, _PART = re.compile(rf"(?<!\w){_CAPITAL}\w*(?:[-'’]\w+)*"), re.compile(r"\w+")
#: Parts of the longest name between hyphens and apostrophes.
MOST_PARTS = 4
#: Names that are sent to every task; more are joined.
SENT_NAMES = 100_000
_IS_MALE, _IS_FEMALE = re.compile(f"(?:{_MALE})$"), re.compile(f"(?:{_FEMALE})$")
_GIVEN_F = {"mary", "anna", "maria", "emma", "sofia", "julia", "laura", "sarah", "claire", "marie", "carmen", "elena", "olga", "jane", "lucy", "ingrid", "petra", "анна", "мария", "елена", "ольга"}
_GIVEN_M = {"john", "james", "peter", "paul", "hans", "karl", "juan", "carlos", "pedro", "pierre", "jean", "luc", "ivan", "robert", "david", "thomas", "max", "иван", "пётр", "павел"}


def script_of(text: str) -> str:
    for ch in text:
        if "Ѐ" <= ch <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= ch <= "Ͽ":
            return "greek"
    return "latin"


def candidates(text: str) -> Iterator[str]:
    """All words of ``text`` that could be names, parts joined by hyphens and apostrophes in every grouping."""
    for run in _RUN.finditer(text):
        parts = [m.span() for m in _PART.finditer(run[0])]
        for i, (begin, _) in enumerate(parts):
            for _, end in parts[i : i + MOST_PARTS]:
                yield run[0][begin:end]


def standing(text: str, names: dict[str, str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of the whole words of ``text`` in ``names``, ascending, the longest at a place."""
    for run in _RUN.finditer(text):
        parts, i = [m.span() for m in _PART.finditer(run[0])], 0
        while i < len(parts):
            ends = (j for j in range(min(len(parts), i + MOST_PARTS), i, -1) if run[0][parts[i][0] : parts[j - 1][1]] in names)
            if j := next(ends, 0):
                yield run.start() + parts[i][0], run.start() + parts[j - 1][1], run[0][parts[i][0] : parts[j - 1][1]]
            i = j or i + 1


def is_name(kind: str) -> bool:
    return kind == "surname" or kind.startswith("given")


def detect(text: str, known: dict[str, str] | None = None) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, kind, value), ascending and apart.

    Names are found after a title, word by word (kind given-f/m/x or surname), and then wherever the same
    word stands alone in the text; an initial only after a title. Only lines with a digit, ``@``, assignment or title are looked into.
    With ``known``, the kinds by name that the corpus settled, those names are found wherever they stand,
    title or not, and under those kinds.
    """
    out: list[tuple[int, int, str, str]] = []
    names: dict[str, str] = dict(known or {})
    done = -1
    for anchor in _ANCHOR.finditer(text):
        if anchor.start() < done:
            continue
        begin = text.rfind("\n", 0, anchor.start()) + 1
        done = text.find("\n", anchor.start())
        done = len(text) if done < 0 else done
        for m in _PATTERN.finditer(text, begin, done):
            if m["name"]:
                parts = list(_NAME_PART.finditer(m["name"]))
                words = [p[0] for p in parts]
                title = m["title"].rstrip(".")
                gender = "m" if _IS_MALE.match(title) else "f" if _IS_FEMALE.match(title) else "f" if words[0].lower() in _GIVEN_F else "m" if words[0].lower() in _GIVEN_M else "x"
                at = m.start("name")
                for i, part in enumerate(parts):
                    w = part["initial"] or part[0]
                    kind = "initial" if part["initial"] else names.setdefault(w, "surname" if i == len(words) - 1 else f"given-{gender}")
                    out.append((at + part.start(), at + part.start() + len(w), kind, w))
            else:
                kind = m.lastgroup
                out.append((m.start(kind), m.end(kind), kind, m[kind]))
    if names:
        begins, ends = [x[0] for x in out], [x[1] for x in out]
        for begin, end, name in standing(text, names):
            if bisect_right(ends, begin) == bisect_left(begins, end):
                out.append((begin, end, names[name], name))
    out.sort()
    return out


# surrogates


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n): an eight-round Feistel network, walked until back in range."""
    if n < 2:
        return x
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for i in range(8):
            bits = _prf(key, tweak, i, b)
            while bits.bit_length() < half:
                bits = bits << 128 | _prf(key, tweak, i, b, bits)
            a, b = b, a ^ bits & mask
        x = a << half | b
        if x < n:
            return x


_SETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]


@lru_cache(maxsize=4096)
def _kin(c: str) -> str:
    """The letters, marks or numbers like ``c``, of no set above: those of its general category nearby."""
    kind, block = unicodedata.category(c), ord(c) >> 8
    near = range(block << 8, block + 1 << 8)
    kin = "".join(x for x in map(chr, near) if unicodedata.category(x) == kind and not any(x in s for s in _SETS))
    return kin if len(kin) > 1 else "".join(x for x in map(chr, range(0x100, 0x250)) if x.isalpha())


def _set_of(c: str, sets: list[str]) -> str | None:
    found = next((s for s in sets if c in s), None)
    return _kin(c) if found is None and sets is _SETS and unicodedata.category(c)[0] in "LMN" and ord(c) > 127 else found


def encipher(value: str, key: bytes, tweak: str, sets: list[str] | None = None, ok: Callable[[str], bool] | None = None) -> str:
    """The value's letters and digits, of any script, permuted within their classes; others stay. With ``ok`` walked until it holds."""
    sets = sets or _SETS
    classes = [_set_of(c, sets) for c in value]
    n = 1
    for s in classes:
        n *= len(s) if s else 1
    form = "".join(c if s is None else str(sets.index(s)) if s in sets else s[0] for c, s in zip(value, classes, strict=True))
    x = 0
    for c, s in zip(value, classes, strict=True):
        if s:
            x = x * len(s) + s.index(c)
    while True:
        x = permute(x, n, key, f"{tweak}|{form}")
        y, out = x, []
        for c, s in zip(reversed(value), reversed(classes), strict=True):
            if s:
                y, r = divmod(y, len(s))
                c = s[r]
            out.append(c)
        made = "".join(reversed(out))
        if ok is None or ok(made):
            return made


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(value: str) -> str:
    return re.sub(r"\D", "", value)


def _fill(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _card(value: str, key: bytes) -> str:
    d = _digits(value)
    if luhn(d):
        body = encipher(d[1:-1], key, f"card{d[0]}")
        return _fill(value, next(x for x in (d[0] + body + str(k) for k in range(10)) if luhn(x)))
    return _fill(value, d[0] + encipher(d[1:], key, f"card!{d[0]}", ok=lambda x: not luhn(d[0] + x)))


def _phone(value: str, key: bytes) -> str:
    head = re.match(r"\+1(?=\D)|\+\d{1,3}(?=\D)|\+\d{2}|", value)[0]
    rest = value[len(head) :]
    d = _digits(rest)
    return head + _fill(rest, encipher(d, key, f"phone{head}", ok=(lambda x: x[0] > "1") if d[0] > "1" else None))


_PRIVATE = [(10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24), (169 << 24 | 254 << 16, 16)]


def _ipv4(value: str, key: bytes) -> str:
    a, b, c, d = map(int, value.split("."))
    x = a << 24 | b << 16 | c << 8 | d
    held = next(((base, bits) for base, bits in _PRIVATE if x >> bits == base >> bits), None)
    if held:
        x = held[0] | permute(x & ((1 << held[1]) - 1), 1 << held[1], key, f"ip{held[0]}")
    else:
        low, high = (1 << 24, 224 << 24) if 1 <= a < 224 else (0, 1 << 32)
        while True:
            x = low + permute(x - low, high - low, key, f"ip{low}")
            if not any(x >> bits == base >> bits for base, bits in _PRIVATE):
                break
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _email(value: str, key: bytes) -> str:
    local, _, domain = value.rpartition("@")
    name, _, tld = domain.rpartition(".")
    return encipher(local, key, "local") + "@" + encipher(name, key, "domain") + "." + tld


def _iban_sum(iban: str) -> int:
    """The IBAN's remainder by 97: 1 if its check digits are right."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def _iban(value: str, key: bytes) -> str:
    """Country and spaces stay; right check digits become the surrogate's own, wrong ones stay wrong."""
    bare = value.replace(" ", "")
    if _iban_sum(bare) == 1:
        body = encipher(bare[4:], key, f"iban{bare[:2]}")
        made = f"{bare[:2]}{98 - _iban_sum(bare[:2] + '00' + body):02d}{body}"
    else:
        made = bare[:2] + encipher(bare[2:], key, f"iban!{bare[:2]}", ok=lambda x: _iban_sum(bare[:2] + x) != 1)
    it = iter(made)
    return "".join(c if c == " " else next(it) for c in value)


_SYLLABLES = {
    "latin": ["ba", "be", "bri", "ca", "da", "do", "el", "fa", "ga", "ha", "jo", "ka", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "pa", "ra", "re", "ri", "ro", "sa", "se", "si", "ta", "te", "ti", "to", "va", "ve", "vi", "za"],
    "cyrillic": ["ба", "ва", "га", "да", "до", "за", "ка", "ла", "ле", "ли", "ма", "ми", "мо", "на", "не", "ни", "но", "па", "ра", "ри", "ро", "са", "се", "си", "та", "ти", "то", "фа"],
    "greek": ["βα", "γα", "δα", "δη", "ζα", "θα", "κα", "λα", "λε", "μα", "μι", "να", "νι", "πα", "ρα", "ρι", "σα", "σε", "τα", "τι", "φα", "χα"],
}
_ENDINGS = {"latin": {"f": "a", "m": "n", "x": "l", "surname": "rt"}, "cyrillic": {"f": "на", "m": "н", "x": "ль", "surname": "нов"}, "greek": {"f": "να", "m": "ς", "x": "ν", "surname": "κης"}}


def _name(kind: str, value: str, key: bytes, attempt: int) -> str:
    script = script_of(value)
    table, ending = _SYLLABLES[script], _ENDINGS[script][kind.rpartition("-")[2]]
    x, out = _prf(key, kind, value), ""
    for _ in range(3):
        x, r = divmod(x, len(table))
        out += table[r]
    while attempt:  # written out, so attempts of one name and of names alike stay apart
        attempt, r = divmod(attempt - 1, len(table))
        out += table[r]
    out += ending
    return out.upper() if value.isupper() and len(value) > 1 else out.capitalize()


def _initial(value: str, key: bytes) -> str:
    """Another capital of the same set for each; the letters of a set change places, so all are real ones."""
    ours = next((s for s in _SETS if value in s), None) or "".join(c for c in _CAPITALS if not any(c in s for s in _SETS) and (c < "ɐ") == (value < "ɐ"))
    return ours[(ours.index(value) + 1 + _prf(key, "initial", ours) % (len(ours) - 1)) % len(ours)]


_HEX = ["0123456789abcdef"]
#: Attempts after which a surrogate may be another real value: only where a format has hardly a free one.
MOST_ATTEMPTS = 32


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The ``attempt``-th surrogate of a value; for all kinds but names each attempt is a permutation of the kind's values."""
    if is_name(kind):
        return _name(kind, value, key, attempt)
    if kind == "initial":
        return _initial(value, key)
    if attempt:
        key = hashlib.blake2b(str(attempt).encode(), key=key, digest_size=32).digest()
    if kind == "email":
        made = _email(value, key)
        return made if made != value or not attempt else f"{encipher('a' * 12, key, value)}@{value.rpartition('@')[2]}"
    if kind == "card":
        return _card(value, key)
    if kind == "phone":
        return _phone(value, key)
    if kind == "ipv4":
        return _ipv4(value, key)
    if kind == "key":
        return value[:4] + encipher(value[4:], key, "key")
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return encipher(value, key, "hex", sets=_HEX)
    if kind == "iban":
        return _iban(value, key)
    if kind == "ipv6":
        return encipher(value.lower(), key, "ipv6", sets=_HEX)
    if not any(_set_of(c, _SETS) for c in value):  # a secret of signs alone
        return encipher("a" * len(value), key, f"{kind}|{value}")
    return encipher(value, key, kind)


# tables


def _detector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        k1, k2 = (batch.column(i).to_pylist() for i in (0, 1))
        rows = []
        for a, b, text in zip(k1, k2, batch.column(2).to_pylist(), strict=True):
            if text:
                rows += [(a, b, kind, value) for kind, value in {(k, v) for *_, k, v in detect(text)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["k1", "k2", "kind", "value"])


def _scanner(held):
    """(k1, k2, value): words of each text that could be names; with ``held``, only those in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            k1, k2 = (batch.column(i).to_pylist() for i in (0, 1))
            rows = []
            for a, b, text in zip(k1, k2, batch.column(2).to_pylist(), strict=True):
                if text:
                    words = set(candidates(text))
                    rows += [(a, b, w) for w in (words if held is None else words & held.value)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "value"])

    return run


def settled(found: DataFrame) -> DataFrame:
    """(value, kind) of all names in ``found(kind, value)``: one kind for each, whatever document it is in.

    By count, surname if more rows say so than given; a given name's gender is the commoner of the known ones.
    """
    f, m, x, surname = (F.count_if(F.col("kind") == k) for k in ("given-f", "given-m", "given-x", "surname"))
    kind = F.when(surname > f + m + x, "surname").when(f > m, "given-f").when(m > f, "given-m").otherwise("given-x")
    return found.filter(_IS_NAME).groupBy("value").agg(kind.alias("kind"))


_IS_NAME = "kind = 'surname' or kind like 'given%'"


def entities(docs: DataFrame) -> DataFrame:
    """(k1, k2, kind, value) distinct: what is to be replaced in each text of ``docs(__k1, __k2, text)``.

    Names of the whole corpus are looked for in every text. Up to ``SENT_NAMES`` names go to the tasks;
    beyond, the texts' words are joined with them.
    """
    found = materialize(docs.mapInArrow(_detector, "k1 long, k2 long, kind string, value string"), "entities")
    names = materialize(settled(found), "names")
    count = names.limit(SENT_NAMES + 1).count()
    if not count:
        return found.distinct()
    held = docs.sparkSession.sparkContext.broadcast(frozenset(r.value for r in names.collect())) if count <= SENT_NAMES else None
    stand = docs.mapInArrow(_scanner(held), "k1 long, k2 long, value string").unionByName(found.filter(_IS_NAME).select("k1", "k2", "value"))
    stand = stand.join(names, "value").select("k1", "k2", "kind", "value")
    return materialize(found.filter(f"not ({_IS_NAME})").unionByName(stand).distinct(), "entities")


def _assigner(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, value, attempt = (batch.column(i).to_pylist() for i in range(3))
            made = [surrogate(k, v, key, n) for k, v, n in zip(kind, value, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return run


def surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) of distinct ``values(kind, value)``: no two values of a kind share a surrogate, and none is a real value of its kind.

    Values in a clash go on to their next surrogate until there is none. The smallest value of a clash
    keeps its own unless it is a real one. A format with hardly a free value left (all one-letter mailboxes
    in use, say; always that of initials) may after ``MOST_ATTEMPTS`` give other real values, still distinct.
    """
    schema = "kind string, value string, attempt int, surrogate string"
    values = values.distinct()
    now = materialize(values.withColumn("attempt", F.lit(0)).mapInArrow(_assigner(key), schema), "surrogates")
    while True:
        real = now.select(F.col("kind").alias("rk"), F.col("value").alias("rv"))
        same = Window.partitionBy("kind", "surrogate").orderBy("attempt", "value")
        marked = now.withColumn("nth", F.row_number().over(same)).join(real, (F.col("kind") == F.col("rk")) & (F.col("surrogate") == F.col("rv")), "left")
        marked = marked.withColumn("clash", (F.col("nth") > 1) | (F.col("rk").isNotNull() & (F.col("kind") != "initial") & (F.col("attempt") < MOST_ATTEMPTS))).select("kind", "value", "attempt", "surrogate", "clash", "nth")
        marked = materialize(marked, "clashes")
        if not marked.filter("clash").head(1):
            return now.select("kind", "value", "surrogate")
        again = marked.filter("clash").select("kind", "value", (F.col("attempt") + F.greatest(F.lit(1), F.col("nth") - 1)).cast("int").alias("attempt"))
        kept = marked.filter("not clash").select("kind", "value", "attempt", "surrogate")
        now = materialize(kept.unionByName(again.mapInArrow(_assigner(key), schema)), "surrogates")


def _replacer(columns: list[str], found_column: str, count: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, lists = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", found_column))
            out, counts = [], []
            for text, found in zip(texts, lists, strict=True):
                if not found:
                    out.append(text)
                    counts.append(0)
                    continue
                to = {(f["kind"], f["value"]): f["surrogate"] for f in found}
                spans, at, parts = detect(text, {v: k for k, v in to if is_name(k)}), 0, []
                for begin, end, kind, value in spans:
                    parts += [text[at:begin], to[kind, value]]
                    at = end
                out.append("".join(parts) + text[at:])
                counts.append(len(spans))
            made = {"text": pa.array(out, pa.string()), count: pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(batch.schema.get_field_index(c)) for c in [*columns, count]], names=[*columns, count])

    return lean(run)


def replace_entities(docs: DataFrame, key: bytes, count: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``: its columns in order, then ``count`` (spans replaced).

    Whoever has the key can undo most surrogates, so it is a secret of the caller's. Reruns with one key
    agree, and one value has one surrogate in the whole corpus; a name that any document has after a title
    is replaced in all of them, also where it is an ordinary word. A null text stays null and an empty one
    empty; a very long one is read whole; equal texts get equal results; rows keep their ids, null or
    repeated as they are; a column of ``docs`` that is called like ``count`` is replaced by it; an empty
    table gives no rows. Real values stay in the tables in the shared folder, never in the result. The
    texts are shuffled once, to the lists of their own surrogates, by a 128-bit hash of the text.
    """
    if not key:
        raise ValueError("a secret key is required")
    columns = [c for c in docs.columns if c.lower() != count.lower()]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    docs = docs.select(*[f"`{c}`" for c in columns])
    keys = [F.xxhash64("text").alias("__k1"), F.xxhash64(F.lit("pii"), "text").alias("__k2")]
    found = entities(docs.select(*keys, "text"))
    made = surrogates(found.select("kind", "value"), key)
    k1, k2, own = (free_name(docs, x) for x in ("__k1", "__k2", "__found"))
    lists = found.join(made, ["kind", "value"]).groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(own))
    wide = docs.join(lists, (F.xxhash64(docs["text"]) == lists[k1]) & (F.xxhash64(F.lit("pii"), docs["text"]) == lists[k2]), "left")
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + [f"`{count}` long"])
    return wide.select(*[docs[c] for c in columns], lists[own]).mapInArrow(_replacer(columns, own, count), schema)
