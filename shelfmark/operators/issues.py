"""What stages could not settle, as rows of one ledger: (stage, kind, severity, root_id, rel_path, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("info", "warn", "error")


def issue(rows: DataFrame, stage: str, kind: str, severity: str, detail: Column, root_id: str | None = None, rel_path: str | None = None) -> DataFrame:
    """An issue for each of ``rows``."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity is one of {', '.join(SEVERITIES)}")
    at = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    return rows.select(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), at(root_id, "bigint").alias("root_id"), at(rel_path, "string").alias("rel_path"), detail.alias("detail"))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def of_artists(artists: DataFrame, twins: DataFrame) -> DataFrame:
    """Names that several folders claim, that several spellings share, or that may be one name in two alphabets."""
    return together(
        issue(artists.filter("homonym AND key = base"), "artists", "artist-homonym", "warn", F.col("base")), issue(artists.filter("ambiguous AND NOT homonym"), "artists", "artist-ambiguous", "warn", F.col("key")),
        issue(twins, "artists", "artist-transliteration", "warn", F.concat_ws(" / ", "latin", "key")),
    )


def of_playlists(told: DataFrame) -> DataFrame:
    """Curated lists of which files are missing."""
    return issue(told.filter("verdict = 'curated' AND missing > 0"), "playlists", "playlist-entries-missing", "warn", F.concat(F.col("list_id").cast("string"), F.lit(": "), F.col("missing").cast("string")), "root_id")


def of_scan(feed: DataFrame) -> DataFrame:
    """Files that were still being written, and folders that could not be entered."""
    return together(issue(feed.filter("state = 'held'"), "scan", "file-unsettled", "info", F.col("state"), "root_id", "rel_path"), issue(feed.filter("state = 'closed'"), "scan", "folder-closed", "error", F.col("state"), "root_id", "rel_path"))


def of_sheets(unmatched: DataFrame, tracks: DataFrame, key: str) -> DataFrame:
    """Sheets that speak for no file, numbers of songs that had to be mended, and songs whose sheet does not say where they begin."""
    at = lambda what: F.concat(F.col(key).cast("string"), F.lit(": "), F.coalesce(F.col(what).cast("string"), F.lit("none")))
    return together(
        issue(unmatched, "cues", "cue-file-missing", "warn", F.col("reference"), rel_path="rel_path"), issue(tracks.filter("start_ms IS NULL"), "cues", "cue-start-missing", "error", at("place")),
        issue(tracks.filter("NOT (track <=> ordinal)"), "cues", "cue-number-mended", "info", at("track")),
    )


def taken_in(ledger: DataFrame, found: DataFrame, stages: list[str]) -> DataFrame:
    """The ledger after ``stages`` ran: what they said before goes, also where they now say nothing."""
    return ledger.filter(~F.col("stage").isin(stages)).unionByName(found)
