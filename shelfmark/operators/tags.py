"""Tags as read from files: places of repeated names, older tag blocks, genre codes, stale readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.expressions import col

#: Genres that are no number.
GENRE_WORDS = {"RX": "Remix", "CR": "Cover"}


def placed(read: DataFrame) -> DataFrame:
    """(file_id, name, value, position) of ``read`` (file_id, seq, name, value, older): each name counts its values by ``seq``.

    What an older block says counts only for names that the newer one does not state at all.
    """
    newer = read.filter("NOT older").select("file_id", "name").distinct()
    rows = read.filter("NOT older").unionByName(read.filter("older").join(newer, ["file_id", "name"], "left_anti"))
    place = F.row_number().over(Window.partitionBy("file_id", "name").orderBy("seq")) - 1  # one file's values of one name
    return rows.select("file_id", "name", "value", place.alias("position"))


def resolved_genre(value, names: list[str]) -> Column:
    """A genre that is written as its number in ``names``, or as a word for it, in brackets at the beginning or alone; any other value as it is."""
    v = col(value)
    closed = v.startswith("(") & (F.instr(v, ")") > 0)
    inner = F.when(closed, F.substring_index(F.substr(v, F.lit(2)), ")", 1)).otherwise(v)
    number = F.when(inner.rlike("^[0-9]{1,9}$"), inner.cast("int"))
    word = F.try_element_at(F.create_map(*(F.lit(x) for pair in GENRE_WORDS.items() for x in pair)), inner)
    return F.coalesce(F.get(F.array(*map(F.lit, names)), number), word, v)


def stale(files: DataFrame, probes: DataFrame, tags_method: int, probe_method: int) -> DataFrame:
    """How many audio files' tags, and how many probes, an older method read; what no method read is neither."""
    a = files.filter("kind = 'audio'").agg(F.count_if(F.col("tags_method") != tags_method).alias("tags"))
    return a.join(F.broadcast(probes.agg(F.count_if(F.col("probe_method") != probe_method).alias("probes"))))
