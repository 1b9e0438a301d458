"""Word search: an inverted index as a DataFrame, and pages of hits that hold all asked words."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.names import without_marks

WORD = r"[\p{L}\p{N}]+"


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(word, key, hits) of every text. A row's words are counted in the task that reads it, before anything is shuffled."""
    return rows.select(key, F.explode(words_of(F.col(text))).alias("word")).groupBy("word", key).agg(F.count("*").alias("hits"))


def hits(rows: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """Keys of the texts that hold all ``words``, the last as a prefix, with how often: only the asked words of a row are looked at.

    A row's words are bound once and its counts leave the row only if none is zero: a filter beside them would cut the text again.
    """
    exact = lambda said, w: F.size(F.filter(said, lambda x: x == w))
    begun = lambda said, w: F.size(F.filter(said, lambda x: x.startswith(w)))
    counts = lambda said: F.array(*(begun(said, w) if i == len(words) - 1 else exact(said, w) for i, w in enumerate(words)))
    each = F.filter(F.transform(F.array(words_of(F.col(text))), counts), lambda n: F.forall(n, lambda x: x > 0))
    found = rows.select(key, F.explode(each).alias("n"))
    once = [i for i, w in enumerate(words) if i == len(words) - 1 or not w.startswith(words[-1])]  # a word that the prefix covers counts with it
    return found.select(key, reduce(lambda a, b: a + b, [F.get("n", F.lit(i)) for i in once]).cast("bigint").alias("hits"))


def words_of(text) -> F.Column:
    """Lower-case words without accents, in order; texts of ASCII alone have none to lose."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(F.when(F.octet_length(low) == F.length(low), low).otherwise(without_marks(low)), F.lit(f"({WORD})"))


#: Constants of BM25: saturation of repeats, and how much length counts.
K1, B = 1.2, 0.75


def ranked(rows: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """``rows`` that hold all ``words``, the last as a prefix, with their BM25 ``rank``: the smaller the better.

    Columns count as one text. The first pass yields one row of statistics; the second scores inside the row.
    """
    said = words_of(F.concat_ws(" ", *columns))
    exact = lambda w: F.filter("_words", lambda x: x == w)
    begun = lambda w: F.filter("_words", lambda x: x.startswith(w))
    hits = [F.size(begun(w) if i == len(words) - 1 else exact(w)) for i, w in enumerate(words)]
    counted = rows.withColumn("_words", said).withColumns({f"_h{i}": h for i, h in enumerate(hits)}).withColumn("_n", F.size("_words")).drop("_words")
    of = counted.agg(F.count("*").alias("all"), F.avg("_n").alias("long"), *(F.count_if(F.col(f"_h{i}") > 0).alias(f"n{i}") for i in range(len(words)))).first()
    score, found = F.lit(0.0), F.lit(bool(words))
    for i in range(len(words)):
        weight = max(1e-6, math.log((of["all"] - of[f"n{i}"] + 0.5) / (of[f"n{i}"] + 0.5)))
        h = F.col(f"_h{i}")
        score = score - F.lit(weight) * h * (K1 + 1) / (h + K1 * (1 - B + B * F.col("_n") / F.lit(of["long"] or 1.0)))
        found = found & (h > 0)
    return counted.filter(found).withColumn("rank", score).drop("_n", *(f"_h{i}" for i in range(len(words))))


def matching(rows: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Rows whose text holds every word, the last one as a prefix: a scan, where no index is kept."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    ends = [*[r"(?![\p{L}\p{N}])"] * (len(words) - 1), ""]
    tests = [low.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(w)}{end}") for w, end in zip(words, ends, strict=True)]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows.limit(0)


def ask(index: DataFrame, key: str, words: list[str], prefix: bool = True) -> DataFrame:
    """Keys that have all ``words`` in an index of ``postings``, the last one as a ``prefix``, with the hits together."""
    tests = [F.col("word").startswith(w) if prefix and i == len(words) - 1 else F.col("word") == w for i, w in enumerate(words)]
    found = index.filter(reduce(lambda a, b: a | b, tests)).groupBy(key).agg(*(F.max(t).alias(f"t{i}") for i, t in enumerate(tests)), F.sum("hits").alias("hits"))
    return found.filter(reduce(lambda a, b: a & b, [F.col(f"t{i}") for i in range(len(tests))])).select(key, "hits")
