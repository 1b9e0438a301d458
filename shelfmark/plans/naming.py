"""What names of folders, shelves, files, discs and fields say, over names made of the columns of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import expressions as X
from shelfmark.functions import folders
from shelfmark.plans.views import Views

_YEAR, _SIZE = "(1960 + p_size)", "p_size"


def _by(n: int, *texts: str) -> Column:
    """One of SQL's ``texts`` for each part, by its number."""
    return F.expr(f"case p_partkey % {n} " + " ".join(f"when {i} then {x}" for i, x in enumerate(texts)) + " end")


def _told(n: int, *texts: str) -> str:
    return f"case p_partkey % {n} " + " ".join(f"when {i} then {x}" for i, x in enumerate(texts)) + " end"


_FOLDER = (
    f"{_YEAR} || ' - ' || p_name || ' & ' || p_brand || ' - ' || p_name || ' (Cass, C60)'", f"p_name || ' - ' || p_brand || ' - ' || {_YEAR} || ' (' || p_size || 'CD FLAC)'", f"{_YEAR} || ' - ' || p_name || ' (' || p_partkey || '-' || p_size || ')'",
    f"{_YEAR} || ' - ' || p_name || ' - EP'", f"p_name || '_-_' || p_type || '-' || {_YEAR} || '-GRP'", f"{_YEAR} || '. ' || p_name", "p_name || ' feat. ' || p_type", f"{_YEAR} || ' - ' || p_name || ' (2019, ' || p_brand || ', 2CD)'",
    f"p_brand || ' - ' || {_YEAR} || ' - ' || p_name || ' - more'",
)
_N = "cast(null as string)"


def folder_names(v: Views) -> DataFrame:
    named = v.read("part").select(F.col("p_partkey").alias("id"), _by(9, *_FOLDER).alias("name"))
    return folders.folder_names(named, "name").select("id", "said.*", folders.record_title("name", F.col("said")).alias("record"))


def shelf_names(v: Views) -> DataFrame:
    q = v.read("part").select(F.col("p_partkey").alias("id"), _by(4, "p_name || ' ' || p_brand", "p_name", "p_name || 'it'", "p_name || '_-_' || p_brand").alias("shelf"), F.col("p_name").alias("artist"))
    words = q.withColumn("words", folders.qualifier("shelf", "artist"))
    return words.select("id", "words", folders.qualified(folders.qualified(F.lit("Song"), "words"), "words").alias("title"))


_FILE = ("'0' || (p_size % 9 + 1) || ' - ' || p_name || ' - ' || p_type || '.flac'", "p_size || '.' || p_name || '.mp3'", "'05-' || replace(p_name, ' ', '_') || '_-_the_' || lower(p_type) || '-site' || p_partkey || '.ogg'", "p_size || '.wav'", "p_name || ' - ' || p_type || '.ape'")


def file_titles(v: Views) -> DataFrame:
    album = _by(5, "p_name || ' ' || p_brand", _N, "p_name || ' site' || p_partkey", "p_brand", "p_type || ' ' || p_name")
    named = v.read("part").select(F.col("p_partkey").alias("id"), _by(5, *_FILE).alias("name"), album.alias("album"))
    return named.select("id", folders.file_title("name", "album").alias("title"), folders.pair_key("name").alias("key"))


def disc_names(v: Views) -> DataFrame:
    name = _by(6, "'CD ' || p_size", "p_name || ' (Disk ' || p_size || ')'", "p_name || ' ' || p_size || 'CD'", "'Vol ' || p_size", "'CD' || (100 + p_size)", "'d' || p_size")
    return v.read("part").select(F.col("p_partkey").alias("id"), name.alias("name")).select("id", X.disc_number("name").alias("disc"), X.stated_discs("name").alias("discs"))


_GLUED = "replace(p_name, ' ', '')"
_LEVEL = (
    "'-' || p_size || '.5 dB'", "'+' || p_size || ' db'", "p_size || 'e2'", "'nan'", "'0.' || (100 + p_size)", "'-.' || (p_size % 9 + 1)", "p_size || 'e999'", "'dB'", "''", "' ' || p_size || '. '",
    "p_size || ' dB'", "p_name", "'+' || p_size || 'e1'",
)
_TIME = (
    "'00:00:00'", "lpad(p_size, 2, '0') || ':02:37'", "(50 + p_size % 50) || ':59:74'", "p_size || ':05'", "p_size || ':60:00'", "p_size || ':00:75'", "p_size || ':2:3'", "p_size || ':02:03:04'", "p_name", "' ' || (100 + p_size) || ':00 '",
    "lpad(p_size, 2, '0') || ':05:37'", "p_size || ':61'", "p_size || ':07'",
)
_HOST = (
    "replace(p_name, ' ', '-') || '.ru'", f"{_GLUED} || p_size || '.com'", f"'www.' || {_GLUED} || '.co.uk'", "upper(replace(p_name, ' ', '.'))", "'Vol. ' || p_size", f"'http://' || {_GLUED} || '.com'", f"{_GLUED} || '.b'", _GLUED,
    "replace(p_name, ' ', '-') || '-.com'", f"' ' || {_GLUED} || '.travel '", f"{_GLUED} || '.toolongs'", "replace(p_name, ' ', '-') || '.org'", "p_name",
)
_REFERENCE = ("p_size || '.flac'", "'../' || p_type || '/./x.flac'", "'..\\\\..\\\\..\\\\' || p_size || '.wav'", "'CD1\\\\' || p_size || '.ape'", "''", "'./'")
_KIND = (
    "p_name || '.FLAC'", "p_name || '.mp4'", "p_name || '.jpeg'", "p_name || '.m3u8'", "p_name || '.cue'", "'.flac'", "p_name", "p_name || '.tak'", "p_name || '.aac'", "p_name || '.NFO'", "p_name || '.log'", "p_name || '.'", "p_name || '.xyz'",
)
_SONG = ("'(silence)'", "' (Data Track) '", "'Silence'", "'(untitled) ' || p_name", "' (Silence)'", "p_name", "'(Empty)'", "'(untitled)'")


def text_fields(v: Views) -> DataFrame:
    """Gains, peaks, times, hosts, references, kinds and markers as tags and sheets write them, well and badly."""
    by = lambda texts: _by(len(texts), *texts)
    said = v.read("part").select(
        F.col("p_partkey").alias("id"), by(_LEVEL).alias("level"), by(_TIME).alias("time"), by(_HOST).alias("host"), by(_REFERENCE).alias("reference"), by(_KIND).alias("file"), by(_SONG).alias("song")
    )
    return said.select(
        "id", X.decibels("level").alias("gain"), X.peak("level").alias("peak"), X.cue_time("time").alias("ms"), X.site_like("host").alias("site"), X.resolved(F.lit("a/b"), "reference").alias("path"), X.file_kind("file").alias("kind"), X.without_marker("song").alias("title"),
    )


def disc_pairs(v: Views) -> DataFrame:
    """Sheets and audio files named for parts, of which every third has a second sheet and every fifth no audio file."""
    n, size = F.col("p_partkey").cast("string"), F.col("p_size")
    names = F.array(F.concat(n, F.lit(".flac.cue")), F.when(F.col("p_partkey") % 5 > 0, F.concat(n, F.lit(".FLAC"))), F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit(".cue"))))
    return folders.disc_pairs(v.read("part").select(size.alias("folder"), F.explode(names).alias("name")).filter("name IS NOT NULL"))


def queries() -> dict:
    t = _told
    y = f"cast({_YEAR} as int)"
    title = t(9, "p_name", "p_brand", "p_name || ' (' || p_partkey || '-' || p_size || ')'", "p_name", "p_type", "p_name", "null", "p_name", "p_name || ' - more'")
    note = t(9, "'Cass, C60'", "p_size || 'CD FLAC'", "null", "null", "null", "null", "null", "'2019, ' || p_brand || ', 2CD'", "null")
    record = t(9, "p_name || ' (Cass, C60)'", "p_brand || ' (' || p_size || 'CD FLAC)'", "p_name || ' (' || p_partkey || '-' || p_size || ')'", "p_name", "p_type", "p_name", "p_name || ' feat. ' || p_type", "p_name || ' (' || p_brand || ', 2CD)'", "p_name || ' - more'")
    credit = t(9, "p_name || ' & ' || p_brand", "p_name", "null", "null", "p_name", "null", "p_name || ' feat. ' || p_type", "null", "null")
    level, third = "cast(p_size as double)", "cast(100 + p_size as double) / cast(1000 as double)"
    gain = (f"-{level} - 0.5", level, f"{level} * 100", "null", third, "-cast(p_size % 9 + 1 as double) / cast(10 as double)", "null", "null", "null", level, level, "null", f"{level} * 10")
    peak = ("null", "null", f"{level} * 100", "null", third, "null", "null", "null", "null", level, "null", "null", f"{level} * 10")
    ms = ("0", "p_size * 60000 + 2493", "(50 + p_size % 50) * 60000 + 59987", "p_size * 60000 + 5000", "null", "null", "null", "null", "null", "(100 + p_size) * 60000", "p_size * 60000 + 5493", "null", "p_size * 60000 + 7000")
    yes, no = "p_name <> ''", "case when p_name is not null then false end"
    site = (yes, yes, yes, no, "false", no, no, no, no, yes, no, yes, no)
    path = ("'a/b/' || p_size || '.flac'", "'a/' || p_type || '/x.flac'", "p_size || '.wav'", "'a/b/CD1/' || p_size || '.ape'", "'a/b'", "'a/b'")
    kind = ("'audio'", "'other'", "'image'", "'playlist'", "'cue'", "'other'", "'other'", "'audio'", "'other'", "'nfo'", "'log'", "'other'", "'other'")
    song = ("null", "null", "'Silence'", "'(untitled) ' || p_name", "null", "p_name", "null", "null")
    return {
        "folder_names": (folder_names, f"select p_partkey as id, {t(9, y, y, y, y, y, y, 'null', y, y)} as year, {credit} as credit, {title} as title, {note} as format, {record} as record from part"),
        "shelf_names": (shelf_names, f"select p_partkey as id, {t(4, 'p_brand', 'null', 'null', 'p_brand')} as words, case when p_partkey % 4 in (0, 3) then 'Song (' || p_brand || ')' else 'Song' end as title from part"),
        "file_titles": (file_titles, f"select p_partkey as id, {t(5, 'p_type', 'p_name', chr(39) + 'the ' + chr(39) + ' || lower(p_type)', 'cast(p_size as varchar)', 'p_type')} as title, lower(regexp_replace({t(5, *_FILE)}, '\\.[a-z0-9]+$', '')) as key from part"),
        "disc_names": (disc_names, f"select p_partkey as id, cast({t(6, _SIZE, _SIZE, 'null', 'null', 'null', _SIZE)} as int) as disc, cast({t(6, 'null', 'null', _SIZE, 'null', 'null', 'null')} as int) as discs from part"),
        "text_fields": (text_fields, f"""select p_partkey as id, {t(13, *gain)} as gain, {t(13, *peak)} as peak, cast({t(13, *ms)} as bigint) as ms, {t(13, *site)} as site, {t(6, *path)} as path,
          case when p_name is null then 'other' else {t(13, *kind)} end as kind, {t(8, *song)} as title from part"""),
        "disc_pairs": (disc_pairs, "select p_size as folder, p_partkey || '.flac.cue' as cue, p_partkey || '.FLAC' as audio from part where p_partkey % 5 > 0 and p_partkey % 3 > 0"),
    }
