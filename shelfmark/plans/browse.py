"""Browsing the tree and looking after the catalogue: child folders, current verdicts, queue seats, issues, the text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.tables import TABLES_SQL
from shelfmark.functions.expressions import unique_ordinals
from shelfmark.plans.views import Views


def child_folders(folders: DataFrame, albums: DataFrame, parents: DataFrame) -> DataFrame:
    """Folders (root_id, rel_path, parent_rel_path) under ``parents`` (root_id, parent_rel_path); none is its own child, none is a hidden album."""
    hidden = albums.filter("junk_reason IS NOT NULL").select("root_id", "rel_path")
    return folders.join(parents, ["root_id", "parent_rel_path"], "left_semi").filter("rel_path <> parent_rel_path").join(hidden, ["root_id", "rel_path"], "left_anti")


def current(ledger: DataFrame) -> DataFrame:
    """Rows that the run saw which last walked their root; a root's runs are counted before the join, so the small side has one row a root."""
    return ledger.join(ledger.groupBy("root_id").agg(F.max("last_seen_run_id").alias("last_seen_run_id")), ["root_id", "last_seen_run_id"])


def seats(entries: DataFrame, seat: Column, keys: list[str], position: str) -> DataFrame:
    """Each queue's current position: the seat itself, else the next after it, else the last one."""
    return entries.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(position) >= seat, F.col(position))), F.max(position)).alias("current"))


def issues(found: DataFrame, roots: DataFrame, limit: int, severity: str | None = None) -> DataFrame:
    """The newest issues (id, kind, severity, root_id) with their root's path, null where the root is unknown."""
    rows = found if severity is None else found.filter(F.col("severity") == severity)
    newest = rows.orderBy(F.desc("id")).limit(limit)
    return newest.join(roots.select(F.col("id").alias("root_id"), F.col("path").alias("root_path")), "root_id", "left").select("id", "kind", "severity", "root_path")


def report_lines(df: DataFrame, section: str, name: str) -> DataFrame:
    """One padded line for each value of ``name`` with its count; null counts as none."""
    counted = df.groupBy(F.coalesce(F.col(name), F.lit("none")).alias("name")).agg(F.count("*").cast("string").alias("n"))
    return counted.select(F.lit(section).alias("section"), F.concat(F.rpad("name", 32, " "), F.lpad("n", 10, " ")).alias("line"))


def folders_below(v: Views) -> DataFrame:
    """What lies directly in the roots and in releases before 2000."""
    root = F.col("root_id").cast("bigint").alias("root_id")
    tops = v.root.select(F.col("id").alias("root_id")).select(root, F.lit("").alias("rel_path"), F.lit("").alias("parent_rel_path"))
    shelves = v.release.select(root, "rel_path", F.lit("").alias("parent_rel_path"))
    discs = v.album.select(root, "rel_path", F.substring_index("rel_path", "/", 1).alias("parent_rel_path"))
    asked = tops.select("root_id", "parent_rel_path").union(v.release.filter("year < 2000").select(root, F.col("rel_path").alias("parent_rel_path")))
    return child_folders(tops.union(shelves).union(discs), v.album, asked).select("root_id", "parent_rel_path", "rel_path")


def current_files(v: Views) -> DataFrame:
    run = F.when(F.col("id") % 4 == 0, 1).otherwise(F.col("root_id") % 2 + 2)
    return current(v.file.select("id", "root_id", run.cast("int").alias("last_seen_run_id"))).select("id", "root_id", "last_seen_run_id")


def queue_seats(v: Views) -> DataFrame:
    return seats(v.read("conversations").select("conv_id", "turn"), F.col("conv_id") % 6, ["conv_id"], "turn")


def repaired_ordinals(v: Views) -> DataFrame:
    """Sheets that state every other number twice; each album's list is one sheet."""
    sheets = v.track.groupBy("album_id").agg(F.array_sort(F.collect_list(F.col("ordinal").cast("int"))).alias("said"))
    stated = F.transform("said", lambda x, i: (i - i % 2 + 1).cast("int"))
    placed = sheets.select("album_id", F.posexplode(unique_ordinals(stated)).alias("place", "ordinal"))
    return placed.select("album_id", (F.col("place") + 1).cast("int").alias("place"), "ordinal")


def newest_issues(v: Views) -> DataFrame:
    found = v.read("events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), F.col("event_type").alias("severity"), (F.col("user_id") % 7).alias("root_id"))
    return issues(found, v.root, 50, "purchase")


def report(v: Views) -> DataFrame:
    """The catalogue's counts as lines of text; ordered by section and line, they make the same file every time."""
    rooted = v.album.join(v.root.select(F.col("id").alias("root_id"), "path"), "root_id", "left")
    named = v.album.join(v.artist.select(F.col("id").alias("artist_id"), "name"), "artist_id", "left")
    used = v.track.select(F.col("file_id").alias("id")).distinct()
    unused = v.file.join(used, "id", "left_anti").select("folder_rel_path")
    parts = [report_lines(rooted, "albums by root", "path"), report_lines(named, "albums by artist", "name"), report_lines(v.album, "hidden", "junk_reason"), report_lines(unused, "files of no song", "folder_rel_path")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).orderBy("section", "line")


def queries() -> dict:
    q = lambda text: TABLES_SQL + text
    line = lambda section, name, rows: f"select '{section}' as section, concat(rpad(coalesce({name}, 'none'), 32, ' '), lpad(cast(count(*) as varchar), 10, ' ')) as line from {rows} group by coalesce({name}, 'none')"
    return {
        "child_folders": (folders_below, q("""select cast(f.root_id as bigint) as root_id, f.parent_rel_path, f.rel_path from (select id as root_id, '' as rel_path, '' as parent_rel_path from root
            union all select root_id, rel_path, '' from release union all select root_id, rel_path, split_part(rel_path, '/', 1) from album) f
          where f.rel_path <> f.parent_rel_path and (f.parent_rel_path = '' or exists (select 1 from release r where r.year < 2000 and r.root_id = f.root_id and r.rel_path = f.parent_rel_path))
            and (f.parent_rel_path <> '' or f.root_id in (select id from root))
            and not exists (select 1 from album a where a.root_id = f.root_id and a.rel_path = f.rel_path and a.junk_reason is not null)""")),
        "current_ledger": (current_files, q("""select id, root_id, run as last_seen_run_id from (select *, max(run) over (partition by root_id) as latest
          from (select id, root_id, cast(case when id % 4 = 0 then 1 else root_id % 2 + 2 end as int) as run from file)) where run = latest""")),
        "queue_seats": (queue_seats, "select conv_id, coalesce(min(turn) filter (turn >= conv_id % 6), max(turn)) as current from conversations group by conv_id"),
        "unique_ordinals": (repaired_ordinals, q("""select album_id, cast(row_number() over w as int) as place, cast(row_number() over w as int) as ordinal from track
          window w as (partition by album_id order by ordinal)""")),
        "issues": (newest_issues, q("select event_id as id, 'event' as kind, event_type as severity, path as root_path from events left join root on root.id = user_id % 7 where event_type = 'purchase' order by event_id desc limit 50")),
        "report": (report, q(" union all ".join([
            line("albums by root", "path", "album left join root on root.id = album.root_id"), line("albums by artist", "name", "album left join artist on artist.id = album.artist_id"),
            line("hidden", "junk_reason", "album"), line("files of no song", "folder_rel_path", "file where not exists (select 1 from track where track.file_id = file.id)")]))),
    }
