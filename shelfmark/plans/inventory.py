"""The catalogue's report in full, who performs single songs, and what notes beside an artist's folder say; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.notes import WHITE, biography
from shelfmark.operators import inventory
from shelfmark.operators.issues import issue
from shelfmark.plans.views import Views
from shelfmark.sources.kept import stage
from shelfmark.sources.tables import TABLES_SQL


def _album(v: Views) -> DataFrame:
    return v.album.withColumns({"credit_raw": F.when(F.col("id") % 2 == 0, F.lit("Solo 1")), "junk_source": F.when(F.col("id") % 2 == 0, "hand").otherwise("scan")})


def _track(rows: DataFrame) -> DataFrame:
    """Songs; those of every tenth album are cut from one file, every fifth has no title."""
    n, cut = F.col("ordinal").cast("bigint"), F.col("album_id") % 10 == 0
    return rows.withColumns({"title": F.when(F.col("id") % 5 > 0, F.concat(F.lit("Song "), F.col("id").cast("string"))), "start_ms": F.when(cut, (n - 1) * 70_000), "end_ms": F.when(cut & (F.col("id") % 3 > 0), n * 70_000)})


def _file(v: Views) -> DataFrame:
    p = F.col("id")
    return v.file.withColumns({"kind": F.when(p % 4 < 2, "audio").when(p % 4 == 2, "cue"), "unmoved": p % 3 == 0})


def _folder(v: Views) -> DataFrame:
    role = F.when(F.length("folder_rel_path") % 3 == 0, "album").when(F.length("folder_rel_path") % 3 == 1, "disc")
    return v.file.select("root_id", "folder_rel_path").distinct().withColumn("role", role)


def _cue(v: Views) -> DataFrame:
    """Two sheets for every sixth file."""
    p = F.col("id")
    return v.file.filter(p % 6 == 0).select(F.explode(F.array(p * 2, p * 2 + 1)).alias("id"), p.alias("audio_file_id"))


def _cue_track(v: Views) -> DataFrame:
    """The later sheet of two names everybody, the earlier leaves some out or blank."""
    c, n = F.col("id"), F.col("ordinal")
    said = F.when((c % 2 == 0) & (n == 3), F.lit(None)).when((c % 2 == 0) & (n == 4), F.lit(" ")).otherwise(F.concat(F.lit("Solo "), (c % 3).cast("string")))
    return _cue(v).select(c.alias("cue_id"), c, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ordinal")).select("cue_id", "ordinal", said.alias("performer"))


def _credit(rows: DataFrame, key: str, every: int) -> DataFrame:
    """Of every so many rows a credit of one to three names."""
    k, i = F.col("id"), F.col("i")
    listed = rows.filter(k % every == 0).select(k, F.explode(F.sequence(F.lit(1).cast("bigint"), k % 3 + 1)).alias("i"))
    return listed.select(k.alias(key), i.alias("position"), F.when(i == 1, "").when(i == 2, " & ").otherwise(" feat. ").alias("phrase"), F.concat(F.lit("N"), (k % 7 + i).cast("string")).alias("name"))


def _issue(v: Views) -> DataFrame:
    e = v.read("events").select((F.col("user_id") % 7).alias("root"), F.col("event_type").alias("what"), F.col("event_id").cast("string").alias("at"))
    gone = issue(e.filter("what = 'purchase'"), "scan", "file-unsettled", "info", F.col("at"), "root", "what")
    return gone.unionByName(issue(e.filter("what = 'view'"), "tags", "tag-unreadable", "error", F.col("at"), "root"))


def full_report(v: Views) -> DataFrame:
    """Every section over the whole catalogue; what takes a shuffle and several sections read is written once."""
    album, file, folder = _album(v), _file(v), stage(_folder(v), "report-folders")
    artist = v.artist.withColumns({"ambiguous": F.col("id") % 4 == 0, "name_key": F.concat("name_key", F.when(F.col("id") % 4 == 0, "#2").otherwise(""))})
    place = stage(inventory.places(album, artist), "report-places", tidy=True)
    placed = _track(stage(inventory.in_places(v.track, place), "report-songs", tidy=True))
    track, found, cue = placed.filter("NOT again"), _issue(v), _cue(v)
    before = inventory.in_order(
        inventory.roots(v.root, folder, file, album), inventory.counter(folder, 0, "folders", F.col("role")), inventory.counter(file, 1, "files", F.col("kind")),
        inventory.counter(album, 2, "albums", hidden=F.col("junk_reason").isNotNull()), inventory.counter(track, 3, "tracks"), inventory.counter(v.release, 4, "releases"),
        inventory.counter(artist, 5, "artists", ambiguous=F.col("ambiguous")), inventory.counter(found, 6, "issues", F.col("severity")), inventory.counter(file, 7, "ledger", unmoved=F.col("unmoved")),
        inventory.unaccounted(folder, file, album, track, cue), inventory.hidden(v.root, album),
    )
    credit = _credit(v.album, "album_id", 11), _credit(track, "track_id", 13)
    artists = inventory.artists(v.root, file, place, v.release, placed, *credit, inventory.performers(cue, _cue_track(v)))
    return before.union(artists).union(inventory.in_order(inventory.issues(v.root, found)))


def performers(v: Views) -> DataFrame:
    return inventory.performers(_cue(v), _cue_track(v))


def biographies(v: Views) -> DataFrame:
    """Documents as notes beside artists' folders: escaped texts in an element, some without one, references good and bad behind them."""
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("\n <biography>\n"), F.coalesce(escaped, F.lit("")), F.lit(" &#1046;&#x1F600;&quot;&gt;&bogus;&#xD800;&#1114112; & &amp\n</biography><biography>no</biography>"))
    empty = F.lit("<biography> \n&#32;</biography>")
    xml = F.concat(F.lit("<artist><outline>short</outline>"), F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, empty).otherwise(body), F.lit("</artist>"))
    return v.read("documents").select("doc_id", biography(xml).alias("biography"))


ROWS_SQL = """, al as (select *, case when id % 2 = 0 then 'Solo 1' end as credit_raw, case when id % 2 = 0 then 'hand' else 'scan' end as source from album),
tr as (select *, coalesce('Song ' || case when id % 5 > 0 then id end, '(untitled)') as title, case when album_id % 10 = 0 then (ordinal - 1) * 70000 end as start_ms, case when album_id % 10 = 0 and id % 3 > 0 then ordinal * 70000 end as end_ms from track),
fi as (select *, case when id % 4 < 2 then 'audio' when id % 4 = 2 then 'cue' end as kind from file),
fo as (select distinct root_id, folder_rel_path, case length(folder_rel_path) % 3 when 0 then 'album' when 1 then 'disc' end as role from file),
ar as (select id, name, name_key || case when id % 4 = 0 then '#2' else '' end as name_key from artist),
pf as (select id as file_id, o as ordinal, case o when 3 then null when 4 then ' ' else 'Solo ' || id * 2 % 3 end as performer from file, (select unnest([1, 2, 3, 4, 5]) as o) where id % 6 = 0),
iss as (select user_id % 7 as root_id, 'file-unsettled' as kind, 'info' as severity, event_type as rel_path, event_id as detail from events where event_type = 'purchase' union all select user_id % 7, 'tag-unreadable', 'error', null, event_id from events where event_type = 'view'),
mk as (select id as root_id, path, '#' || (id + 1) as mark from root)
"""


def queries() -> dict:
    pad = lambda x, n: f"rpad({x}, greatest({n}, cast(length({x}) as int)), ' ')"
    clock = lambda x: f"case when {x} is null then '--:--' else {x} // 60000 || ':' || lpad(cast({x} // 1000 % 60 as varchar), 2, '0') end"
    credit = lambda k: f"'N' || ({k} % 7 + 1) || case when {k} % 3 >= 1 then ' & N' || ({k} % 7 + 2) else '' end || case when {k} % 3 = 2 then ' feat. N' || ({k} % 7 + 3) else '' end"
    counted = lambda place, label, rest: f"select 2 as section, null as unnamed, null as artist_key, null as root_id, null as rel_path, null as level, {place} as ordinal, rpad('{label}', 10, ' ') || {rest} as line"
    tally = lambda key, rows: f"(select count(*) from {rows}) || (select string_agg('  ' || k || ' ' || n, '' order by k) from (select coalesce({key}, 'none') as k, count(*) as n from {rows} group by 1))"
    nothing = lambda place, label, rows: f"select 3, null, null, null, null, null, {place}, rpad('{label}', 34, ' ') || (select count(*) from {rows})"
    lines = [
        "select 1 as section, cast(null as boolean) as unnamed, cast(null as varchar) as artist_key, root_id, cast(null as varchar) as rel_path, cast(null as int) as level, cast(null as bigint) as ordinal, rpad(mark, 4, ' ') || path || '  folders ' || (select count(*) from fo where fo.root_id = mk.root_id) || '  files ' || (select count(*) from fi where fi.root_id = mk.root_id) || '  albums ' || (select count(*) from al where al.root_id = mk.root_id) as line from mk",
        counted(0, "folders", tally("role", "fo")), counted(1, "files", tally("kind", "fi")), counted(2, "albums", "(select count(*) || '  hidden ' || count(junk_reason) from al)"), counted(3, "tracks", "(select count(*) from tr)"), counted(4, "releases", "(select count(*) from release)"),
        counted(5, "artists", "(select count(*) || '  ambiguous ' || count(*) filter (id % 4 = 0) from ar)"), counted(6, "issues", tally("severity", "iss")), counted(7, "ledger", "(select count(*) || '  unmoved ' || count(*) filter (id % 3 = 0) from fi)"),
        nothing(0, "folders with no role", "fo where role is null"), nothing(1, "albums with no track", "al where id not in (select album_id from tr)"), nothing(2, "audio files with no track or cue", "fi where kind = 'audio' and id % 6 <> 0 and id not in (select file_id from tr)"),
        f"select 4, null, null, root_id, rel_path, null, id, rpad(source, 6, ' ') || rpad(mark, 4, ' ') || {pad('rel_path', 44)} || title || '  -  ' || junk_reason from al join mk using (root_id) where junk_reason is not null",
        f"select 5, name_key is null, name_key, null, null, 0, artist_id, {pad('coalesce(name, ' + chr(39) + '(unattributed)' + chr(39) + ')', 40)} || '  ' || n || case when n = 1 then ' album' else ' albums' end || case when name_key like '%#%' then '  [' || name_key || ']' else '' end from (select artist_id, count(*) as n from al group by 1) o left join ar on ar.id = o.artist_id",
        f"select 5, name_key is null, name_key, root_id, rel_path, 1, id, '  ' || rpad(mark, 4, ' ') || {pad('facts', 30)} || '  ' || rel_path || '  -  ' || title from (select al.*, mark, name_key, coalesce(n, 0) || case when n = 1 then ' track' else ' tracks' end || case when n > 0 and al.id % 10 = 0 then '  split' else '' end || coalesce('  disc ' || disc_number, '') || coalesce(' of ' || release.title, '') as facts from al join mk using (root_id) left join ar on ar.id = al.artist_id left join release on release.id = al.release_id left join (select album_id, count(*) as n from tr group by 1) t on t.album_id = al.id)",
        f"select 5, name_key is null, name_key, root_id, rel_path, 2, al.id, '    credit  ' || {credit('al.id')} from al left join ar on ar.id = al.artist_id where al.id % 11 = 0 and al.id % 3 > 0",
        f"select 5, name_key is null, name_key, al.root_id, al.rel_path, 3, tr.id, '    ' || lpad(cast(tr.ordinal as varchar), 2, '0') || '. ' || rpad({clock('duration_ms')}, 7, ' ') || tr.title || '  ' || fi.rel_path || case when start_ms is not null then '  [' || {clock('start_ms')} || '-' || {clock('end_ms')} || ']' else '' end || coalesce('  by ' || case when tr.id % 13 = 0 then {credit('tr.id')} when trim(performer) <> '' and performer is distinct from credit_raw then performer end, '') from tr join al on al.id = tr.album_id join fi on fi.id = tr.file_id left join ar on ar.id = al.artist_id left join pf on pf.file_id = tr.file_id and pf.ordinal = tr.ordinal",
        f"select 6, null, kind, root_id, rel_path, case severity when 'error' then 0 else 2 end, null, rpad(severity, 6, ' ') || rpad(kind, 24, ' ') || rpad(coalesce(mark, ''), 4, ' ') || {pad('coalesce(rel_path, ' + chr(39) * 2 + ')', 40)} || detail from iss left join mk using (root_id)",
    ]
    told = f"""select doc_id, case when doc_id % 5 > 1 then trim(coalesce(text, '') || ' Ж😀">&bogus;&#xD800;&#1114112; & &amp', '{WHITE}') end as biography from documents"""
    return {
        "full_report": (full_report, TABLES_SQL + ROWS_SQL + " union all ".join(lines)),
        "performers": (performers, TABLES_SQL + ROWS_SQL + "select file_id, ordinal, performer from pf"),
        "biographies": (biographies, told),
    }
