"""WARC archives: written from pages, read back, and their indexes merged into globally ordered capture histories.

Pages with equal payloads keep the payload once: the smallest page_id's record is a response, the others' records are
revisits that refer to it and carry the HTTP head only. Archives are gzip-compressed WARC/1.1 files written by Spark's
text writer, whose line separator is WARC's record separator, and read back whole-file by ``binaryFile``; a file holds
at most ``RECORDS`` records, fewer where they would be more than ``ARCHIVE_BYTES`` at the average size. A file is one
gzip stream; offsets count uncompressed bytes. Payload digests are computed again on reading and must agree.

The index of each archive is a capture run, sorted locally by URL key, time and page. Runs are cut at common bounds,
each range of all runs meets in one task, and a loser tree merges them there: ``range_no`` and ``range_pos`` give
the global order. The bounds come from a bounded sample of keys and affect only how even the ranges are; they may fall
inside one URL's captures, so that a hot URL or host is no task's alone.

Defined results: null html is the empty payload; null url is the empty URL, sorted first; rows that repeat both
page_id and payload are all the same kind of record; a null page_id is never the one referred to unless no other has
that payload; line breaks and blanks in URLs are percent-encoded in the record; an empty table gives an empty one.
Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import pickle
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, shared_dir

RECORDS, ARCHIVE_BYTES, LEAST = 10_000, 64 << 20, 0
_SEP = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits make four base32 digits."""
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, size, kind of record and what it refers to.

    Which payloads are equal is found without them: only identifiers meet by digest, and pages then meet their revisits
    by identifier, so that a payload that many pages have gathers nowhere.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("bigint").alias("bytes"), base32_sha1(html.cast("binary")).alias("digest"))
    ids = p.filter(F.col("bytes") >= least).groupBy("page_id", "digest").agg(F.count("*").alias("n"))
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"))
    revisits = ids.join(first, "digest").filter(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "first")
    joined = p.join(revisits, p["page_id"].eqNullSafe(revisits["id"]) & (p["digest"] == revisits["of"]), "left").drop("id", "of")
    return joined.withColumn("kind", F.when(F.col("first").isNotNull(), "revisit").otherwise("response")).withColumnRenamed("first", "refers_to")


def write(pages: DataFrame, path: str, least: int = LEAST) -> str:
    """Write a record for each row of ``pages`` to archives under ``path``; times are the page_id's seconds from 2024 on."""
    r = records(pages, least)
    total, n = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    most = max(1, min(RECORDS, ARCHIVE_BYTES * n // max(int(total or 0), 1)))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    record_id = lambda c: F.concat(F.lit("<urn:x-page:"), shown(c), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), " ", "%20")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_SEP))
    block = F.when(F.col("kind") == "revisit", head).otherwise(F.concat(head, "html"))
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.col("page_id").cast("bigint"), F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id("refers_to"))
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "kind", F.lit("\r\nWARC-Record-ID: "), record_id("page_id"), F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest", F.when(F.col("kind") == "revisit", revisit).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_SEP), block,
    )
    r.select(lines.alias("value")).write.option("lineSep", _SEP).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    return path


def parse(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of one archive, compressed or not."""
    raw = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    at = 0
    while line := raw.readline():
        start, at = at, at + len(line)
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {start}: {line[:40]!r}")
        fields = {}
        while (line := raw.readline()) not in (b"\r\n", b""):
            at += len(line)
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = raw.read(int(fields["content-length"]))
        at += len(line) + len(block)
        yield start, fields, block


_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)(?::(\d+))?([^#]*)", re.IGNORECASE)


def url_key(url: str) -> str:
    """Sort key: host labels from the top down, a closing parenthesis, path and query; no scheme, www or fragment."""
    m = _URL.match(url)
    if not m:
        return url.partition("#")[0]
    host = m[1].lower().removeprefix("www.")
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (m[3] or "/")


def _page(shown: str) -> int | None:
    digits = shown.removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def index(content: bytes) -> list[tuple]:
    """An archive's capture run: (URL key, time, page, offset, bytes, digest, kind, refers to), sorted."""
    run = []
    for at, fields, block in parse(content):
        head, _, payload = block.partition(_SEP.encode())
        said = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != said):
            raise ValueError(f"payload of {fields['warc-record-id']} does not agree with its record")
        page = _page(fields["warc-record-id"])
        refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
        run.append((url_key(fields["warc-target-uri"]), fields["warc-date"], page, at, size, said, kind, refers))
    run.sort(key=_key)
    return run


def _key(entry: tuple) -> tuple:
    return entry[0], entry[1], -(2**63) if entry[2] is None else entry[2], entry[3]


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so one new entry replays one path to the top."""

    def __init__(self, runs: Iterable[list], key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [self._next(i) for i in range(len(self.runs))]
        self.k = len(self.runs)
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self._enter(i)

    def _next(self, i: int):
        entry = next(self.runs[i], None)
        return None if entry is None else (self.key(entry), i, entry)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _enter(self, i: int) -> None:
        node, up = (i + self.k) // 2, i
        while node > 0:
            if self.losers[node] < 0:  # the first of two waits here
                self.losers[node] = up
                return
            if self._beats(self.losers[node], up):
                self.losers[node], up = up, self.losers[node]
            node //= 2
        self.winner = up

    def __iter__(self):
        while self.k and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            node, up = (i + self.k) // 2, i
            while node > 0:
                if self._beats(self.losers[node], up):
                    self.losers[node], up = up, self.losers[node]
                node //= 2
            self.winner = up


def histories(spark, path: str, bounds: list[tuple], page_type: str = "bigint") -> DataFrame:
    """The captures in all archives under ``path`` in order of URL key, time and page."""

    def runs(batches):
        for b in batches:
            for content in b["content"]:
                cut: dict[int, list] = {}
                for e in index(content):
                    cut.setdefault(bisect_right(bounds, _key(e)[:3]), []).append(e)
                yield pd.DataFrame({"range_no": list(cut), "run": [pickle.dumps(x) for x in cut.values()]})

    def merge(batches):
        held: dict[int, list] = {}
        for b in batches:
            for no, run in zip(b["range_no"], b["run"], strict=True):
                held.setdefault(no, []).append(pickle.loads(run))
        for no in sorted(held):
            rows = ((e[2], e[4], e[5], e[6], e[7], e[0], e[1], no, i) for i, e in enumerate(LoserTree(held.pop(no), _key)))
            while some := list(islice(rows, 10_000)):
                out = pd.DataFrame(some, columns=[x.split()[0] for x in schema.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = f"page_id {page_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {page_type}, url_key string, captured_at string, range_no int, range_pos bigint"
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return archives.mapInPandas(runs, "range_no int, run binary").repartitionById(len(bounds) + 1, F.col("range_no")).mapInPandas(merge, schema)


def bounds(pages: DataFrame, n: int, sample: int = 16) -> list[tuple]:
    """Where to cut the key range into ``n`` pieces, from at most ``4 * sample * n`` keys."""
    total = pages.count()
    part = int(min(1.0, sample * n / max(total, 1)) * (1 << 20)) + 1
    some = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < part).limit(4 * sample * n)
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.col("page_id").cast("bigint"), F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    found = sorted((url_key(r["url"]), r["at"], -(2**63) if r["page_id"] is None else r["page_id"]) for r in some.withColumn("at", when).collect())
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and merge their indexes."""
    spark = pages.sparkSession
    path = write(pages, f"{shared_dir(spark)}/shelfmark/warc-{uuid.uuid4().hex}", least)
    return histories(spark, path, bounds(pages, partitions(spark)), pages.schema["page_id"].dataType.simpleString())


ROUND_TRIP_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as html, coalesce(url, '') as url, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(encode(coalesce(html, ''))) as h from pages
), d as (
  select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest from p
), f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from f
"""
