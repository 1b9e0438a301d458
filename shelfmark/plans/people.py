"""Artists of albums by identity, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import identity
from shelfmark.plans.views import Views
from shelfmark.sources.kept import stage

#: Letters that stand for one another in the names below: the Cyrillic name of a part is its Latin one, letter by letter.
LATIN, CYRILLIC = "abvgdezijklmnoprstufhc", "абвгдезийклмнопрстуфхц"


def _parts(v: Views) -> DataFrame:
    """Parts as albums (album_id, root_path, rel_path), with their Latin and Cyrillic names."""
    p = F.col("p_partkey")
    album = F.concat(F.lit("album "), p.cast("string"))
    path = F.when(p % 3 == 0, F.concat("p_name", F.lit("/"), album)).when(p % 3 == 1, F.concat("p_type", F.lit("/"), "p_name", F.lit("/x/"), album)).otherwise(F.concat(F.lit("misc/"), album))
    return v.read("part").select(p.alias("album_id"), F.concat(F.lit("/music/"), (p % 2).cast("string")).alias("root_path"), path.alias("rel_path"), F.col("p_name").alias("latin"), F.translate("p_name", LATIN, CYRILLIC).alias("cyrillic"), F.col("p_brand").alias("brand"))


def _evidence(v: Views) -> DataFrame:
    """A fifth of the albums is credited by a sheet, by a folder, by an album artist, by what its artists share, by nobody; some by several."""
    a, k = _parts(v), F.col("album_id") % 5
    cue = a.filter(k == 0).select("album_id", F.lit("cue").alias("source"), F.lit(0).alias("place"), F.concat("latin", F.lit(" & "), "brand").alias("text"))
    folder = a.filter(k.isin(0, 1)).select("album_id", F.lit("folder").alias("source"), F.lit(0).alias("place"), F.col("cyrillic").alias("text"))
    tag = lambda on, name, value, place: F.when(on, F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(place).alias("place")))
    said = F.array(
        tag(k.isin(0, 2), "albumartist", F.concat(F.lit("The "), "latin"), 0), tag(k == 2, "albumartist", F.lit("second"), 1), tag(k == 2, "artist", F.lit("zzz"), 0),
        tag(k == 3, "artist", F.concat("latin", F.lit(" & Guest")), 0), tag(k == 3, "artist", F.concat(F.lit("Other feat. "), "latin"), 1), tag(k == 4, "artist", F.lit("A"), 0), tag(k == 4, "artist", F.lit("B"), 1),
    )
    tags = identity.credit_of_tags(a.select("album_id", F.inline(F.array_compact(said))))
    return cue.union(folder).union(tags.select("album_id", F.lit("tag").alias("source"), F.lit(0).alias("place"), "text"))


def album_credits(v: Views) -> DataFrame:
    return identity.chosen(_evidence(v))


def _people(v: Views) -> tuple[DataFrame, DataFrame]:
    return identity.artists_and_credits(stage(identity.chosen(_evidence(v)), "credits"), _parts(v).select("album_id", "root_path", "rel_path"))


def credited_artists(v: Views) -> DataFrame:
    return _people(v)[0]


def credit_entries(v: Views) -> DataFrame:
    return _people(v)[1]


def artist_twins(v: Views) -> DataFrame:
    return identity.twins(stage(_people(v)[0], "artists"))


def artist_alphabets(v: Views) -> DataFrame:
    return identity.alphabets(stage(_people(v)[0], "artists"))


PEOPLE_SQL = f"""with recursive a as (
  select p_partkey as album_id, '/music/' || p_partkey % 2 as root_path, p_name as latin, translate(p_name, '{LATIN}', '{CYRILLIC}') as cyrillic, p_brand as brand, p_type as kind, p_partkey % 5 as k, p_partkey % 3 as m from part
), entry as (
  select album_id, 0 as position, '' as join_phrase, case k when 1 then cyrillic when 2 then 'The ' || latin else latin end as name, case k when 1 then cyrillic else latin end as base, case when k <> 1 and m = 0 then latin when k <> 1 and m = 1 then kind || '/' || latin end as folder, root_path from a where k < 4
  union all select album_id, 1, ' & ', brand, trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')), null, root_path from a where k = 0
), home as (
  select base, root_path, folder, row_number() over (partition by base order by root_path, folder) as place from (select distinct base, root_path, folder from entry where folder is not null)
), keyed as (
  select e.*, case when h.place > 1 then e.base || '#' || h.place else e.base end as key, (select count(*) from home x where x.base = e.base) > 1 as homonym from entry e left join home h on h.base = e.base and h.root_path = e.root_path and h.folder = e.folder
), spelt as (
  select key, name, count(*) as n from keyed group by 1, 2
), shown as (
  select key, name from (select *, row_number() over (partition by key order by length(name) - length(translate(name, 'йё', '')) desc, n desc, length(name), name) as r from spelt) where r = 1
), artist as (
  select k.key, any_value(k.base) as base, any_value(s.name) as name, any_value(case when s.name like 'The %' then substr(s.name, 5) || ', The' else s.name end) as sort_key, bool_or(homonym) as ambiguous, bool_or(homonym) as homonym, count(distinct album_id) as albums from keyed k join shown s using (key) group by k.key
), spelling as (
  select key, replace(replace(replace(translate(key, 'абвгдезиклмнопрстуф', 'abvgdeziklmnoprstuf'), 'й', 'y'), 'х', 'kh'), 'ц', 'ts') as latin from artist where regexp_matches(key, '[а-я]') and not contains(key, '#')
  union select key, replace(replace(replace(translate(key, 'абвгдезиклмнопрстуф', 'abvgdeziklmnoprstuf'), 'й', 'i'), 'х', 'h'), 'ц', 'c') from artist where regexp_matches(key, '[а-я]') and not contains(key, '#')
), twin as (
  select s.key, s.latin from spelling s where s.latin in (select key from artist where not regexp_matches(key, '[а-я]'))
), reach as (
  select key as node, latin as other from twin union select latin, key from twin union select r.node, case when t.key = r.other then t.latin else t.key end from reach r join twin t on t.key = r.other or t.latin = r.other
)
"""


def queries() -> dict:
    s = PEOPLE_SQL
    return {
        "album_credits": (album_credits, s + "select album_id, case k when 0 then 'cue' when 1 then 'folder' else 'tag' end as source, case k when 0 then latin || ' & ' || brand when 1 then cyrillic when 2 then 'The ' || latin else latin end as text from a where k < 4"),
        "credited_artists": (credited_artists, s + "select key, base, name, sort_key, ambiguous, homonym, albums from artist"),
        "credit_entries": (credit_entries, s + "select album_id, position, key, join_phrase from keyed"),
        "artist_twins": (artist_twins, s + "select key, latin from twin"),
        "artist_alphabets": (artist_alphabets, s + 'select node as key, least(node, min(other)) as "group" from reach group by node'),
    }
