"""Scalar kernels as Column expressions, kept inside whole-stage code generation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.sources.tables import BLANKS, trimmed

__all__ = ["BLANKS", "trimmed"]


def col(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _base(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))


#: Letters that are a base letter and marks, by rule, in Latin, Greek and Cyrillic, each with its base.
MARKED = {chr(i): b for a, e in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)) for i in range(a, e) if len(b := _base(chr(i))) == 1 and b != chr(i)}


def without_marks(text) -> Column:
    """Letters without their accents, composed or not."""
    return F.regexp_replace(F.translate(col(text), "".join(MARKED), "".join(MARKED.values())), r"\p{M}", "")


def marks_in(text) -> Column:
    """How many letters of a text carry a mark, composed or not."""
    return F.length(col(text)) - F.length(F.regexp_replace(F.translate(col(text), "".join(MARKED), ""), r"\p{M}", ""))


def basename(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def folder_of(path) -> Column:
    """Everything before the last slash; empty where there is none."""
    return F.when(F.instr(col(path), "/") > 0, F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def extension(name) -> Column:
    """Lower-case extension without the dot; a leading dot is part of the name."""
    return F.lower(F.regexp_extract(basename(name), r"^.+\.([^.]*)$", 1))


def stem(name) -> Column:
    return F.regexp_replace(basename(name), r"^(.+)\.[^.]*$", "$1")


def nocase_key(c) -> Column:
    """Case folding of ASCII letters alone."""
    return F.translate(col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def half_up(c) -> Column:
    """Round half towards positive infinity."""
    return F.floor(col(c) + F.lit(0.5)).cast("bigint")


def seconds(ms) -> Column:
    return F.coalesce(half_up(col(ms) / 1000), F.lit(0).cast("bigint"))


def clock(ms) -> Column:
    """h:mm:ss, m:ss below an hour, --:-- for null."""
    s = half_up(col(ms) / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(col(ms).isNull(), F.lit("--:--")).when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def year_of(text) -> Column:
    """The year that a date text begins with: 1000 to 2999 only."""
    head = F.substring(col(text), 1, 4)
    return F.when(head.rlike("^[12][0-9]{3}$"), head.cast("int"))


def _finite(text) -> Column:
    number = F.when(col(text).rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), col(text).try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def decibels(text) -> Column:
    """A gain such as ``-6.5 dB``; null unless finite and numeric."""
    return _finite(F.btrim(F.regexp_replace(F.btrim(col(text)), r"(?i)\s*dB$", "")))


def peak(text) -> Column:
    """A peak level: finite and not negative."""
    number = _finite(F.btrim(col(text)))
    return F.when(number >= 0, number)


def cut_size(bitrate, ms) -> Column:
    """Bytes that a stretch of ``ms`` takes at ``bitrate`` bits a second, about."""
    return half_up(col(bitrate) * col(ms) / 8000)


def kilobits(bitrate) -> Column:
    return half_up(col(bitrate) / 1000)


def bitrate_of(size, ms) -> Column:
    """Bits a second of a file of ``size`` bytes; null without a duration."""
    return F.when(col(ms) > 0, half_up(col(size) * 8000 / col(ms)))


def minutes_ago(then, now) -> Column:
    """Whole minutes since, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor((F.unix_timestamp(col(now)) - F.unix_timestamp(col(then))) / 60))


def parse_id(text) -> tuple[Column, Column]:
    """Kind and number of an id such as ``ar-1`` or ``al:7``; nulls for anything else."""
    m = F.regexp_extract(col(text), r"^(ar|al|tr|fd|ro)[-:](\d+)$", 1)
    return F.nullif(m, F.lit("")), F.when(m != "", F.regexp_extract(col(text), r"^(ar|al|tr|fd|ro)[-:](\d+)$", 2).cast("bigint"))


def index_letter(name) -> Column:
    first = F.upper(F.substring(col(name), 1, 1))
    return F.when(first.rlike(r"^[\p{L}\p{N}]$"), first).otherwise(F.lit("#"))


def natural_key(text) -> Column:
    """Sorts as text in which runs of digits count by value, of any length: each run follows the count of its digits."""
    pieces = F.regexp_extract_all(F.lower(without_marks(text)), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(plain(p)).cast("string"), 9, "0"), plain(p))).otherwise(p)), "")


def sort_key(name) -> Column:
    """``The X`` sorts as ``X, The``."""
    return F.when(col(name).rlike(r"(?i)^the\s+"), F.concat(F.regexp_replace(col(name), r"(?i)^the\s+", ""), F.lit(", The"))).otherwise(col(name))


def ancestors(path) -> Column:
    """The path itself and every folder above it, as an array."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def site_like(text) -> Column:
    """Text that is a bare host name rather than a name: lower-case labels with dots between, the last of two to six letters.

    A label holds letters, digits and inner hyphens.
    """
    labels = F.split(F.btrim(col(text)), "[.]")
    fit = F.forall(labels, lambda x: (x != "") & (F.translate(x, "abcdefghijklmnopqrstuvwxyz0123456789-", "") == "") & ~x.startswith("-") & ~x.endswith("-"))
    top = F.element_at(labels, -1)
    return (F.size(labels) > 1) & fit & F.length(top).between(2, 6) & (F.translate(top, "0123456789-", "") == top)


#: Words for a disc.
DISC_WORDS = ("cd", "disc", "disk")
#: A word for a disc, perhaps a separator, and one or two digits that stand alone and are not the first of several numbers.
_DISC = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(DISC_WORDS)})[ \t._-]*([0-9]{{1,2}})(?![\p{{L}}\p{{N}}_])(?! +[0-9])"


def disc_marker(name) -> Column:
    """The number that follows a word for a disc anywhere in a name: ``Name (Disk 3)``, ``CD04 extra``."""
    return F.nullif(F.regexp_extract(col(name), _DISC, 1), F.lit("")).cast("int")


def disc_number(name) -> Column:
    """Disc number of a folder's name: a marker in it, or all of it a ``d`` and a number."""
    short = F.regexp_extract(F.lower(F.btrim(col(name))), r"^d[ ._-]*([0-9]{1,2})$", 1)
    return F.coalesce(disc_marker(name), F.nullif(short, F.lit("")).cast("int"))


def without_disc_marker(name) -> Column:
    """What stands in front of a name's disc marker; the name itself where it has none."""
    return F.regexp_extract(col(name), rf"^(.*?)(?:{_DISC}|$)", 1)


def leading_number(name) -> Column:
    """The number that a name begins with, up to nine digits."""
    return F.nullif(F.regexp_extract(F.btrim(col(name)), "^([0-9]{1,9})(?![0-9])", 1), F.lit("")).cast("int")


def stated_discs(name) -> Column:
    """How many discs a name says it has: the first of its words that is a number and ``cd``, with or without blanks between."""
    glued = F.regexp_replace(F.lower(col(name)), r"([0-9])\s+cd", "$1cd")
    words = F.filter(F.split(glued, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("(^|_)[0-9]{1,9}cd$"))
    return F.regexp_extract(F.get(words, F.lit(0)), "([0-9]+)cd$", 1).cast("int")


def unique_ordinals(stated: Column) -> Column:
    """Ordinals of one list made unique: the first claim stands, a later or null one takes the next free slot from its own place on."""

    def step(taken, x):
        free = F.filter(F.sequence(F.size(taken) + 1, F.size(taken) * 2 + 1), lambda k: ~F.array_contains(taken, k))
        return F.concat(taken, F.array(F.when(x.isNull() | F.array_contains(taken, x), F.element_at(free, 1)).otherwise(x)))

    return F.aggregate(stated, F.array().cast("array<int>"), step)


def cue_time(text) -> Column:
    """Milliseconds of mm:ss or mm:ss:ff, 75 frames a second; null if out of range."""
    parts = F.split(F.btrim(col(text)), ":")
    number = lambda i, least, most: F.when(F.get(parts, F.lit(i)).rlike(f"^[0-9]{{{least},{most}}}$"), F.get(parts, F.lit(i)).cast("bigint"))
    frames = F.when(F.size(parts) == 2, F.lit(0)).when(F.size(parts) == 3, number(2, 2, 2))
    seconds_ = number(1, 2, 2)
    return F.when((seconds_ < 60) & (frames < 75), number(0, 1, 3) * 60000 + seconds_ * 1000 + half_up(frames * 1000 / F.lit(75.0)))


def resolved(folder, reference) -> Column:
    """A reference written in ``folder``: either slash parts it, ``.`` and empty parts are nothing, ``..`` goes up."""
    base = F.filter(F.split(col(folder), "/"), lambda x: x != "")
    step = lambda path, x: F.when(x.isin("", "."), path).when(x == "..", F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(F.concat(path, F.array(x)))
    return F.array_join(F.aggregate(F.split(F.translate(col(reference), "\\", "/"), "/"), base, step), "/")


#: What rippers write for a stretch that is no song.
RIPPER_MARKS = ("(empty)", "(silence)", "(untitled)", "(data track)")


def without_marker(title) -> Column:
    return F.when(~F.lower(F.btrim(col(title))).isin(*RIPPER_MARKS), col(title))


def is_text(text) -> Column:
    """Whether at most a twentieth of a text of four characters or more is control characters (tabs and line ends are none)."""
    body = F.regexp_replace(col(text), "\u0000+$", "")
    controls = F.length(F.regexp_replace(body, "[^\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f]", ""))
    return (F.length(body) < 4) | (controls * 20 <= F.length(body))


def explicit_status(itunes, mp4) -> Column:
    """1 is explicit (4 too in the second), 2 is clean; the first wins where it is present."""
    first = F.when(col(itunes) == 1, "explicit").when(col(itunes) == 2, "clean")
    second = F.when(col(mp4).isin(1, 4), "explicit").when(col(mp4) == 2, "clean")
    return F.when(col(itunes).isNotNull(), first).otherwise(second)


#: File kinds by extension.
KINDS = {
    "audio": "aif aifc aiff alac ape dff dsf flac m4a mp3 mpc oga ogg opus shn tak tta wav wma wv".split(),
    "cue": ["cue"], "image": "bmp gif jpeg jpg png tif tiff webp".split(), "nfo": ["nfo"], "log": ["log"], "playlist": "m3u m3u8 pls".split(),
}


def file_kind(name) -> Column:
    e, out = extension(name), None
    for kind, extensions in KINDS.items():
        out = F.when(e.isin(extensions), kind) if out is None else out.when(e.isin(extensions), kind)
    return out.otherwise(F.lit("other"))


def replay_gain(track_gain, album_gain, track_peak, album_peak) -> Column:
    """The readable ones of four values as a map; null where none is."""
    said = {"trackGain": decibels(track_gain), "albumGain": decibels(album_gain), "trackPeak": peak(track_peak), "albumPeak": peak(album_peak)}
    every = F.create_map(*(x for name, value in said.items() for x in (F.lit(name), value)))
    some = F.map_filter(every, lambda _, v: v.isNotNull())
    return F.when(F.size(some) > 0, some)


def play_time(text, now) -> Column:
    """When something was played, of milliseconds as text; ``now`` for anything else."""
    ms = F.when(F.btrim(col(text)).rlike("^-?[0-9]+$"), F.btrim(col(text)).try_cast("bigint"))
    return F.coalesce(F.when(F.abs(ms) <= 8_640_000_000_000_000, F.timestamp_millis(ms)), col(now))


def listed_texts(json) -> Column:
    """The texts of a JSON list; other items are dropped, what is no list is empty."""
    items = F.from_json(col(json), "array<variant>")
    texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string")))
    return F.coalesce(F.array_compact(texts), F.array().cast("array<string>"))


def quiet(now, begins: int, ends: int) -> Column:
    """Whether an hour of the day lies in quiet hours, which may span midnight; equal bounds mean none."""
    h = F.hour(col(now))
    if begins == ends:
        return F.lit(False)
    return (h >= begins) & (h < ends) if begins < ends else (h >= begins) | (h < ends)


def cut_path(path, ordinal) -> Column:
    """The path of a song cut from a longer file: `` (track N)`` before the extension."""
    p, n = col(path), col(ordinal).cast("string")
    end = F.when(extension(p) != "", F.concat(F.lit("."), F.substring_index(p, ".", -1))).otherwise(F.lit(""))
    return F.when(col(ordinal).isNull(), p).otherwise(F.concat(F.left(p, F.length(p) - F.length(end)), F.lit(" (track "), n, F.lit(")"), end))


def first_word(name) -> Column:
    """The first word of a file's stem, in lower case."""
    return F.lower(F.regexp_extract(stem(name), r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1))
