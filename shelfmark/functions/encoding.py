"""Bytes to text: which encoding a body of bytes is in, how sure that is, and the text, as Column expressions.

A byte-order mark settles it, then whether the bytes are valid UTF-8; what is neither is one of two eight-bit code pages,
told apart by the longest run of bytes from 0xC0 up: in Cyrillic words they stand together, in Western ones alone.
Bytes are looked at as Latin-1 text, in which every byte is one character, so that all of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.expressions import col

#: How sure each finding is.
CERTAIN, LONG_RUN, PLAIN, SHORT_RUN, SCATTERED, NO_MARK, DOUBTFUL = 1.0, 0.9, 0.85, 0.75, 0.7, 0.6, 0.5
#: Bytes of a run that make a word, and a word beyond doubt; texts shorter than the sample are not called controls; the share of them that is too much.
WORD, LONG_WORD, SAMPLE, SHARE = 3, 6, 8, 0.05

_ALL = bytes(range(0x80, 0x100))
_LATIN = _ALL.decode("latin-1")


def _page(name: str) -> str:
    """The characters of a code page's upper half; bytes that it leaves open stand for themselves."""
    return "".join(bytes([b]).decode(name, "replace").replace("�", chr(b)) for b in _ALL)


def bytes_as_text(body) -> Column:
    """Every byte as the character of its number."""
    return F.decode(col(body), "ISO-8859-1")


def _utf16(body: Column, big: bool) -> Column:
    """UTF-16 of either order; half a pair and a last odd byte become U+FFFD. Units are mended as hex digits, in order."""
    even = F.substring(F.hex(body), F.lit(1), F.floor(F.octet_length(body) / 2).cast("int") * 4)
    units = F.regexp_replace(even, "(..)(..)", "$1$2 " if big else "$2$1 ")
    units = F.regexp_replace(units, "D[89AB].. (?!D[C-F])", "FFFD ")
    units = F.regexp_replace(units, "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    whole = F.decode(F.unhex(F.translate(units, " ", "")), "UTF-16BE")
    return F.when(F.octet_length(body) % 2 == 1, F.concat(whole, F.lit("�"))).otherwise(whole)


def _after(body: Column, n: int) -> Column:
    return F.substring(body, F.lit(n + 1), F.greatest(F.octet_length(body) - n, F.lit(0)))


def longest_run(latin: Column) -> Column:
    """The longest run of bytes from 0xC0 up."""
    runs = F.regexp_extract_all(latin, F.lit("([À-ÿ]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def mostly_controls(text: Column) -> Column:
    """More than a twentieth of a text of some length is control characters; tabs, line ends and zeros at its end are none."""
    said = F.regexp_replace(text, "\u0000+$", "")
    controls = F.length(said) - F.length(F.regexp_replace(said, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f]", ""))
    return (F.length(said) >= SAMPLE) & (controls > F.length(said) * SHARE)


def _found(text, encoding, confidence) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(text).alias("text"), lit(encoding).alias("encoding"), lit(confidence).alias("confidence"))


def _eight_bit(body: Column) -> Column:
    latin = bytes_as_text(body)
    run = longest_run(latin)
    page = lambda name: F.translate(latin, _LATIN, _page(name))
    return F.when(run >= WORD, _found(page("cp1251"), "windows-1251", F.when(run >= LONG_WORD, LONG_RUN).otherwise(SHORT_RUN))).otherwise(_found(page("cp1252"), "windows-1252", F.when(run == 0, PLAIN).otherwise(SCATTERED)))


def _valid(body: Column) -> Column:
    return F.is_valid_utf8(body.cast("string"))


def _utf8(body: Column) -> Column:
    """Of valid UTF-8: doubtful where it holds C1 controls, as twice encoded text does, or is mostly controls."""
    text = body.cast("string")
    return _found(text, "utf-8", F.when(text.rlike("[\u0080-\u009f]") | mostly_controls(text), DOUBTFUL).otherwise(CERTAIN))


def _begins(body: Column, mark: str) -> Column:
    return F.startswith(F.hex(F.substring(body, 1, 3)), F.lit(mark))


def _without_zeros(found: Column) -> Column:
    return F.struct(F.regexp_replace(found["text"], "\u0000+$", "").alias("text"), found["encoding"].alias("encoding"), found["confidence"].alias("confidence"))


def decoded(body) -> Column:
    """(text, encoding, confidence) of a document whose encoding nothing declares; null of null."""
    b = col(body)
    marked = F.when(_begins(b, "EFBBBF"), _found(F.make_valid_utf8(_after(b, 3).cast("string")), "utf-8", CERTAIN)).when(_begins(b, "FFFE"), _found(_utf16(_after(b, 2), False), "utf-16le", CERTAIN)).when(_begins(b, "FEFF"), _found(_utf16(_after(b, 2), True), "utf-16be", CERTAIN))
    return F.when(b.isNotNull(), marked.when(_valid(b), _utf8(b)).otherwise(_eight_bit(b)))


def decoded_comment(body) -> Column:
    """The same of a tag that must be UTF-8: marks count for nothing, zeros at the end go."""
    b = col(body)
    return F.when(b.isNotNull(), _without_zeros(F.when(_valid(b), _utf8(b)).otherwise(_eight_bit(b))))


def decoded_frame(declared, body) -> Column:
    """The same of a tag that declares its encoding: 0 Latin-1, 1 UTF-16 with a mark, 2 big-endian UTF-16, 3 UTF-8. The bytes may tell otherwise."""
    b, kind = col(body), col(declared)
    eight = _eight_bit(b)
    western = _found(eight["text"], "windows-1252", F.when(mostly_controls(eight["text"]), DOUBTFUL).otherwise(CERTAIN))
    first = F.when(eight["encoding"] == "windows-1251", eight).otherwise(western)
    second = F.when(_begins(b, "FFFE"), _found(_utf16(_after(b, 2), False), "utf-16le", CERTAIN)).when(_begins(b, "FEFF"), _found(_utf16(_after(b, 2), True), "utf-16be", CERTAIN)).otherwise(_found(_utf16(b, False), "utf-16le", NO_MARK))
    told = F.when(kind == 0, first).when(kind == 1, second).when(kind == 2, _found(_utf16(b, True), "utf-16be", CERTAIN)).when((kind == 3) & _valid(b), _utf8(b)).otherwise(eight)
    return F.when(b.isNotNull(), _without_zeros(told))
