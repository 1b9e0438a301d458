"""Texts of notes that lie beside folders, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import col

#: White space that is layout around a text.
WHITE = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
#: The named references of XML, and the code points that are characters.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
CHARACTERS = ((0, 0xD7FF), (0xE000, 0x10FFFF))


def character(point: Column) -> Column:
    """The character of a code point; null where there is none."""
    known = F.lit(False)
    for least, most in CHARACTERS:
        known = known | point.between(least, most)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def unescaped(text) -> Column:
    """Text with its named and numeric references resolved, once; what is no reference stays as it was written."""
    pieces = F.split(col(text), "&")

    def resolve(piece: Column) -> Column:
        body = F.regexp_extract(piece, r"^(#[0-9]+|#x[0-9a-fA-F]+|[a-z]+);", 1)
        point = F.when(body.startswith("#x"), F.conv(F.substr(body, F.lit(3)), 16, 10)).when(body.startswith("#"), F.substr(body, F.lit(2)))
        known = character(point.try_cast("bigint"))
        for name, said in NAMED.items():
            known = F.when(body == name, F.lit(said)).otherwise(known)
        return F.coalesce(F.concat(known, F.substr(piece, F.length(body) + 2)), F.concat(F.lit("&"), piece))

    return F.concat(F.element_at(pieces, 1), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), resolve), ""))


def biography(xml) -> Column:
    """The text of the first ``biography`` element of a note, without white space around it; null where it is empty or absent."""
    raw = F.regexp_extract(col(xml), "(?s)<biography>(.*?)</biography>", 1)
    return F.nullif(F.btrim(unescaped(raw), F.lit(WHITE)), F.lit(""))
