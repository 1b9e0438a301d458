"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Found are e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment card numbers, bank accounts (IBAN with a right
check), social security numbers of the form 123-45-6789 and names: those after a title, and in the same text every other
mention of their parts. A value is normalised (digits only, lower case), and its surrogate
follows from a secret key and the normalised value alone. Names go part by part, and by what hyphens join: a surname has
one surrogate whatever title or given name stands before it, so that one person stays one person in all documents; given
names end by gender, which the title tells, or else the name's own ending. Digits go through a keyed permutation of all
digit strings of their length, so that different numbers stay different; country codes stay, and card numbers with
a right check digit get one. E-mail parts keep their lengths and alphabets. Capitals and punctuation stay where they were.

Collisions are looked for over the distinct values of the whole corpus: where two values of a type share a surrogate,
or a surrogate is itself a value of the corpus, all but the smallest of the former, and the latter, draw again until none
is left. Later draws of names and addresses are longer, so that there always are free ones. Digit strings keep their
length, so a format can be too full for that: one of which the corpus holds more than a quarter of all there can be (short
telephone numbers first). There every value takes a keyed permutation of the format that leaves none in place: surrogates
stay different from one another and from their own value, but may be another's. Elsewhere each draw is free with a chance of
a half or more. Values that drew again are broadcast while fewer than ``BROADCAST``; beyond that they are joined by document.

Defined results: null text stays null with no entities; texts without entities stay as they are; rows that repeat a
doc_id are each rewritten; an empty table gives an empty one. Identifiers keep all their bits beside nulls. Extra columns
are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import beside, texts_of
from .kernels import apart_from
from .shared import keep

KEY, BROADCAST, ROUNDS = "shelfmark-surrogates", 50_000, 64
#: The draw of values whose format is too full to draw from.
FULL = -1
# Titles by gender, and syllables by script.
TITLES = {"m": "Mr Herr Señor Sr Monsieur Don Господин".split(), "f": "Mrs Ms Miss Frau Señora Sra Mme Madame Doña Госпожа".split(), "n": "Dr Prof Mx".split()}
GENDER = {t: g for g, ts in TITLES.items() for t in ts}
SYLLABLES = {"latin": "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(), "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви во".split()}
LAST = {("latin", "m"): "n", ("latin", "f"): "a", ("latin", "n"): "s", ("cyrillic", "m"): "н", ("cyrillic", "f"): "а", ("cyrillic", "n"): "с"}

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{6,39}(?![\w:]|\.\w)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_CARD = re.compile(r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])")
_PHONE = re.compile(r"(?<![\dA-Za-z+])(?:\+(\d{1,3})[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\dA-Za-z])")
_PART = "(?:[A-ZÀ-ÖØ-Þ](?:['’-]?[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+)+|[А-ЯЁ](?:-?[А-ЯЁ]?[а-яё]+)+)"
_NAME = re.compile(rf"\b({'|'.join(sorted(GENDER, key=len, reverse=True))})\b\.?[ \u00a0]({_PART}(?:[ \u00a0]{_PART}){{0,2}})")
_WORD = re.compile(rf"(?<!\w){_PART}(?!\w)")
_DIGIT = re.compile(r"\d")


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _ip6(text: str) -> str | None:
    """The address that a text of hexadecimal digits and colons is, in its short form; None for times, scopes and the like."""
    if text.count(":") < 2 or not any(len(g) > 2 and _DIGIT.search(g) for g in text.split(":")):
        return None
    try:
        return str(ipaddress.IPv6Address(text))
    except ValueError:
        return None


def _check97(country: str, rest: str) -> int:
    """The two check digits of an account number."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def _iban(m: re.Match) -> str | None:
    value = m[0].replace(" ", "")
    return value if 15 <= len(value) <= 34 and int(value[2:4]) == _check97(value[:2], value[4:]) else None


def _is_ssn(digits: str) -> bool:
    return _SSN.fullmatch(f"{digits[:3]}-{digits[3:5]}-{digits[5:]}") is not None


def _phone(m: re.Match) -> str:
    digits = re.sub(r"\D", "", m[0])
    code = m[1] if m[1] and not m[0][len(m[1]) + 1].isdigit() else ""
    return f"{code}:{digits[len(code) :]}"


def _given(part: str, title: str) -> str:
    gender = GENDER[title]
    gender = gender if gender != "n" else "f" if part[-1].lower() in "aeая" else "m"
    return f"given-{gender}"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value) of each entity in order; of overlapping ones the earlier kind stays.

    Kinds are email, ip6, ip, iban, ssn, card, phone, and of names surname, given-m and given-f.
    """
    kinds: list[list[tuple[int, int, str, str]]] = []
    if "@" in text:
        kinds.append([(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(text)])
    if _DIGIT.search(text):
        if ":" in text:
            kinds.append([(*m.span(), "ip6", v) for m in _IP6.finditer(text) if (v := _ip6(m[0]))])
        kinds.append([(*m.span(), "ip", m[0]) for m in _IP.finditer(text)])
        kinds.append([(*m.span(), "iban", v) for m in _IBAN.finditer(text) if (v := _iban(m))])
        kinds.append([(*m.span(), "ssn", re.sub(r"\D", "", m[0])) for m in _SSN.finditer(text)])
        kinds.append([(*m.span(), "card", re.sub(r"\D", "", m[0])) for m in _CARD.finditer(text)])
        kinds.append([(*m.span(), "phone", _phone(m)) for m in _PHONE.finditer(text)])
    titled, known = [], {}
    for m in _NAME.finditer(text):
        parts = list(_WORD.finditer(text, *m.span(2)))
        for i, x in enumerate(parts):
            kind = "surname" if i == len(parts) - 1 else _given(x[0], m[1])
            titled.append((*x.span(), kind, x[0].lower()))
            if kind == "surname" or x[0].lower() not in known:
                known[x[0].lower()] = kind
    if titled:
        kinds.append(titled)
        kinds.append([(*m.span(), known[v], v) for m in _WORD.finditer(text) if (v := m[0].lower()) in known])
    out: list[tuple[int, int, str, str]] = []
    for found in kinds:
        stay = set(apart_from([e[:2] for e in found], [e[:2] for e in out]))
        out += [e for e in found if e[:2] in stay]
    return sorted(out)


def _number(key: str, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), key=key.encode()[:64], digest_size=16).digest(), "big")


def permute(n: int, size: int, key: str, what: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a Feistel network over the next power of four, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = n >> half, n & mask
        for i in reversed(range(6)) if back else range(6):
            a, b = (b ^ (_number(key, what, i, a) & mask), a) if back else (b, a ^ (_number(key, what, i, b) & mask))
        n = (a << half) | b
        if n < size:
            return n


def drawn(n: int, size: int, key: str, what: str, draw: int) -> int:
    """The permutation of a draw; that of ``FULL`` leaves nothing in place."""
    if draw != FULL:
        return permute(n, size, key, f"{what}:{draw}")
    return permute((permute(n, size, key, what) + 1) % size, size, key, what, back=True)


def _word(key: str, shape: str, *what) -> str:
    """Letters for letters and digits for digits, drawn by key."""
    n, out = _number(key, *what), []
    for c in shape:
        base = 10 if c.isdigit() else 26 if c.isalpha() else 0
        if base:
            n, k = divmod(n, base)
            out.append("0123456789"[k] if base == 10 else chr(97 + k))
            if n < 1 << 16:
                n = _number(key, *what, len(out))
        else:
            out.append(c)
    return "".join(out)


def _digits(kind: str, value: str, key: str, draw: int) -> str:
    return f"{drawn(int(value), 10 ** len(value), key, f'{kind}{len(value)}', draw):0{len(value)}d}"


def surrogate(kind: str, value: str, key: str = KEY, draw: int = 0) -> str:
    """Normalised surrogate of a normalised value."""
    if kind == "card" and luhn(value[:-1]) == int(value[-1]):
        new = _digits("checked", value[:-1], key, draw)
        return f"{new}{luhn(new)}"
    if kind == "card":
        return _digits(kind, value, key, draw)
    if kind == "phone":
        code, _, rest = value.partition(":")
        return f"{code}:{_digits(kind, rest, key, draw)}"
    if kind == "ip":
        n = 0
        for x in value.split("."):
            n = n * 256 + int(x)
        n = drawn(n, 1 << 32, key, "ip", draw)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ip6":
        return str(ipaddress.IPv6Address(drawn(int(ipaddress.IPv6Address(value)), 1 << 128, key, "ip6", draw)))
    if kind == "ssn":
        value = _digits(kind, value, key, draw)
        while not _is_ssn(value):  # walks on to the next that can be one, so different ones stay different
            value = _digits(kind, value, key, draw)
        return value
    if kind == "iban":
        country, rest = value[:2], value[4:]
        letters = iter(_word(key, re.sub(r"\d", "", rest), "bank", re.sub(r"\d", "", rest)).upper())
        digits = re.sub(r"\D", "", rest)
        new = iter(_digits(f"{kind}{country}", digits, key, draw)) if digits else iter(())
        rest = "".join(next(new) if c.isdigit() else next(letters) for c in rest)
        return f"{country}{_check97(country, rest):02d}{rest}"
    if kind == "email":
        local, _, domain = value.partition("@")
        site, dot, top = domain.rpartition(".")
        return f"{_word(key, local + 'x' * (draw // 3), 'local', value, draw)}@{_word(key, site, 'site', domain)}{dot}{top}"
    script = "cyrillic" if re.search("[а-яё]", value) else "latin"
    pieces, s = re.split("(-)", value), SYLLABLES[script]
    for i in range(0, len(pieces), 2):
        n = _number(key, "name", kind, pieces[i], draw)
        pieces[i] = "".join(s[n // len(s) ** j % len(s)] for j in range(3 + n % 2 + draw // 3)) + LAST[script, kind.rpartition("-")[2] if kind != "surname" else "n"]
    return "".join(pieces)


def _cased(new: str, shown: str) -> str:
    """``new`` with capitals where ``shown`` has them, from its start; wholly in capitals if that is."""
    if shown.isupper() and len(shown) > 1:
        return new.upper()
    return "".join(c.upper() if i < len(shown) and shown[i].isupper() else c for i, c in enumerate(new))


def laid_out(shown: str, kind: str, new: str) -> str:
    """The surrogate in the original's punctuation and letter case."""
    if kind == "iban":
        signs = iter(new)
        return "".join(c if c == " " else next(signs) for c in shown)
    if kind in ("card", "phone", "ssn"):
        digits = iter(new.replace(":", ""))
        return re.sub(r"\d", lambda _: next(digits), shown)
    if kind == "email":
        return "@".join(_cased(x, y) for x, y in zip(new.split("@"), shown.split("@"), strict=True))
    return new.upper() if kind == "ip6" and shown.isupper() else new if kind in ("ip", "ip6") else "-".join(_cased(x, y) for x, y in zip(new.split("-"), shown.split("-"), strict=True))


#: Valid social security numbers.
SSNS = (999 - 100 - 1) * 99 * 9999


def layout(kind: str, value: str) -> str:
    """What a surrogate shares with its value, of kinds of which a corpus may hold a large part; empty for the others."""
    return f"{value.partition(':')[0]}:{len(value)}" if kind == "phone" else kind if kind in ("ip", "ssn") else ""


def room(kind: str, value: str) -> int:
    """How many values there can be of a value's layout."""
    return 10 ** len(value.partition(":")[2]) if kind == "phone" else {"ip": 1 << 32, "ssn": SSNS}.get(kind, 0)


def _exceptions(documents: DataFrame, key: str) -> tuple[DataFrame | None, set[tuple[str, str]]]:
    """Values that must draw again (kind, value, draw; None if there are none), and the layouts that are full.

    Full layouts are collected: a country code has three digits at most and a full layout ten, so there are few.
    """
    def find(batches):
        for b in batches:
            rows = {(k, v) for t in b["text"] if isinstance(t, str) for _, _, k, v in entities(t)}
            yield pd.DataFrame([(k, v, layout(k, v), float(room(k, v))) for k, v in sorted(rows)], columns=["kind", "value", "layout", "room"])

    def draws(batches):
        for b in batches:
            yield b.assign(new=[surrogate(k, v, key, int(d)) for k, v, d in zip(b["kind"], b["value"], b["draw"], strict=True)])

    schema = "kind string, value string, draw int, new string"
    every = keep(documents.select("text").mapInPandas(find, "kind string, value string, layout string, room double").distinct(), "entities")
    tight = every.filter("layout <> ''").groupBy("kind", "layout").agg(F.count("*").alias("n"), F.max("room").alias("room")).filter("4 * n > room").select("kind", "layout")
    full = {(r["kind"], r["layout"]) for r in tight.collect()}
    values = (every.join(F.broadcast(tight), ["kind", "layout"], "left_anti") if full else every).select("kind", "value")
    now = keep(values.withColumn("draw", F.lit(0)).mapInPandas(draws, schema), "surrogates")
    real = values.select("kind", F.col("value").alias("new")).withColumn("real", F.lit(True))
    for _ in range(ROUNDS):
        first = now.groupBy("kind", "new").agg(F.min(F.struct("draw", "value")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("kind", "new", F.col("first.value").alias("first"))
        judged = now.join(first, ["kind", "new"], "left").join(real, ["kind", "new"], "left").withColumn("again", F.coalesce(F.col("first") != F.col("value"), F.lit(False)) | F.coalesce("real", F.lit(False)))
        judged = keep(judged.select("kind", "value", F.when(F.col("again"), F.col("draw") + 1).otherwise(F.col("draw")).alias("draw"), "new", "again"), "draws")
        if not judged.filter("again").take(1):
            found = now.filter("draw > 0").select("kind", "value", "draw")
            return (found if found.take(1) else None), full
        redrawn = judged.filter("again").select("kind", "value", "draw").mapInPandas(draws, schema)
        now = keep(judged.filter("NOT again").select("kind", "value", "draw", "new").unionByName(redrawn), "surrogates")
    raise ValueError(f"after {ROUNDS} draws some values still share surrogates, which each draw leaves with a chance of a half at most")


def replace(documents: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, spans of the original, and the rewritten text of every row."""
    again, full = _exceptions(documents, key)
    rows = documents.select("doc_id", "text")
    held = None
    if again is not None and again.count() <= BROADCAST:
        held = documents.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): r["draw"] for r in again.collect()})
        again = None
    if again is not None:

        def of_documents(batches):
            for b in batches:
                found = [(i, k, v) for i, t in enumerate(texts_of(b)) if t for k, v in {e[2:] for e in entities(t)}]
                at, kinds, values = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["id", "kind", "value"])

        kind = documents.schema["doc_id"].dataType.simpleString()
        per = rows.mapInArrow(of_documents, f"id {kind}, kind string, value string").distinct().join(again, ["kind", "value"])
        per = per.groupBy("id").agg(F.collect_list(F.concat_ws("\u0001", "kind", "value", F.col("draw").cast("string"))).alias("draws"))
        rows = rows.join(per, rows["doc_id"].eqNullSafe(per["id"]), "left").drop("id")

    def run(batches):
        for b in batches:
            own = b.column("draws").to_pylist() if "draws" in b.schema.names else None
            counts, spans, texts = [], [], texts_of(b)
            for i, t in enumerate(texts):
                found = entities(t) if t else []
                draws = held.value if held is not None else {}
                if own and own[i]:
                    draws = {tuple(x.split("\u0001")[:2]): int(x.split("\u0001")[2]) for x in own[i]}
                pieces, at = [], 0
                for a, e, k, v in found:
                    pieces += [t[at:a], laid_out(t[a:e], k, surrogate(k, v, key, FULL if full and (k, layout(k, v)) in full else draws.get((k, v), 0)))]
                    at = e
                counts.append(len(found))
                spans.append(",".join(f"{k}:{a}:{e}" for a, e, k, _ in found))
                texts[i] = "".join([*pieces, t[at:]]) if t else t
            yield beside(b, ["doc_id"], n_entities=(counts, pa.int64()), spans=(spans, pa.string()), text=(texts, pa.string()))

    return rows.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_entities bigint, spans string, text string")
