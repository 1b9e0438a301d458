"""What clients can play, and bytes read as text, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import encoding
from shelfmark.operators import profiles
from shelfmark.plans.views import Views


def _clients(v: Views) -> DataFrame:
    """A client for each nation, with rules that differ by its number."""
    n = F.col("n_nationkey")
    j = lambda x: F.lit(x)
    pick = lambda m, *x: F.element_at(F.array(*map(F.lit, x)), (n % m + 1).cast("int"))
    body = F.concat(
        j('{"maxAudioBitrate": '), pick(4, "320000", "null", "0", "128000"), j(', "maxTranscodingAudioBitrate": '), pick(2, "null", "96400"),
        j(', "directPlayProfiles": [{"containers": '), pick(3, '["mp3"]', '["m4a", "flac"]', "[]"), j(', "audioCodecs": '), pick(2, '["mp3", "aac"]', "[]"), j(', "protocols": '), pick(5, '["hls", "rtsp"]', '["http"]', "[]", '["http"]', '["http"]'),
        j(', "maxAudioChannels": '), pick(7, "1", "null", "null", "null", "null", "null", "null"), j("}"), pick(6, "", ', {"containers": ["opus"], "audioCodecs": ["vorbis"]}', "", "", "", ""), j('], "transcodingProfiles": ['),
        pick(4, '{"container": "ts", "audioCodec": "aac", "protocol": "hls"}, {"container": "mp3", "audioCodec": "mp3", "protocol": "http", "maxAudioChannels": 2}', '{"container": "m4b", "audioCodec": "aac", "protocol": "http"}', "", '{"container": "avi", "audioCodec": "mp3", "protocol": "http"}'),
        j('], "codecProfiles": [{"name": "'), pick(2, "mp3", ""), j('", "limitations": [{"name": "audioChannels", "comparison": "LessThanEqual", "values": ["4"], "required": true}, {"name": "audioSamplerate", "comparison": "Equals", "values": ["44100", 48000], "required": '), pick(3, "true", "false", "true"),
        j('}, {"name": "audioBitrate", "comparison": "GreaterThanEqual", "values": ["x"], "required": true}]}]}'),
    )
    return v.read("nation").select(n.cast("bigint").alias("client_id"), body.alias("body"))


def _songs(v: Views) -> DataFrame:
    p = F.col("p_partkey")
    pick = lambda m, *x: F.element_at(F.array(*map(F.lit, x)), (p % m + 1).cast("int"))
    return v.read("part").select(
        p.alias("id"), pick(4, "mp3", "m4a", "flac", "oga").alias("container"), pick(4, "mp3", "aac", "flac", "vorbis").alias("codec"), F.when(p % 5 != 0, (p % 7 + 1).cast("int")).alias("channels"),
        F.when(p % 9 != 0, F.col("p_size").cast("bigint") * 10000).alias("bitrate"), pick(3, 44100, 96000, None).cast("int").alias("samplerate"),
    )


def play_decisions(v: Views) -> DataFrame:
    d = profiles.decisions(_songs(v), _clients(v))
    return d.select("id", "client_id", "can_play", F.array_join(F.transform("reasons", lambda x: F.coalesce(x, F.lit("-"))), "; ").alias("reasons"), "target.format", "target.max_kbps", "target.max_channels")


DECISIONS_SQL = """with song as (
  select p_partkey as id, ['mp3', 'mp4', 'flac', 'ogg'][cast(p_partkey % 4 as int) + 1] as container, ['mp3', 'aac', 'flac', 'vorbis'][cast(p_partkey % 4 as int) + 1] as codec, case when p_partkey % 5 <> 0 then p_partkey % 7 + 1 end as channels,
    case when p_partkey % 9 <> 0 then p_size * 10000 end as bitrate, case p_partkey % 3 when 0 then 44100 when 1 then 96000 end as rate from part
), client as (
  select n_nationkey as n, case n_nationkey % 4 when 0 then 320000 when 3 then 128000 end as most, case n_nationkey % 3 when 0 then ['mp3'] when 1 then ['mp4', 'flac'] else [] end as containers, case n_nationkey % 2 when 0 then ['mp3', 'aac'] else [] end as codecs from nation
), met as (
  select *, (n % 2 = 1 or codec = 'mp3') as ruled from song, client
), told as (
  select *, case when n % 5 = 0 then 'ProtocolNotSupported: hls, rtsp' when len(containers) > 0 and not list_contains(containers, container) then 'ContainerNotSupported: ' || container when len(codecs) > 0 and not list_contains(codecs, codec) then 'AudioCodecNotSupported: ' || codec
      when n % 7 = 0 and channels > 1 then 'AudioChannelsNotSupported: ' || channels when bitrate > most then 'AudioBitrateNotSupported: ' || bitrate when ruled and channels > 4 then 'LimitationNotMet: audioChannels'
      when ruled and n % 3 <> 1 and rate = 96000 then 'LimitationNotMet: audioSamplerate' end as one,
    case when n % 6 = 1 then case when container <> 'ogg' then 'ContainerNotSupported: ' || container when bitrate > most then 'AudioBitrateNotSupported: ' || bitrate when ruled and channels > 4 then 'LimitationNotMet: audioChannels'
      when ruled and n % 3 <> 1 and rate = 96000 then 'LimitationNotMet: audioSamplerate' end end as two from met
), final as (
  select *, one is null or (n % 6 = 1 and two is null) as plays from told
)
select id, cast(n as bigint) as client_id, plays as can_play, case when plays then '' when n % 6 = 1 then one || '; ' || two else one end as reasons, case n % 4 when 0 then 'mp3' when 1 then 'aac' end as format,
  case when n % 4 in (0, 1) then case when n % 2 = 1 then 96 else cast(most / 1000 as int) end end as max_kbps, case when n % 4 = 0 and channels > 2 then 2 end as max_channels from final"""


def decoded_documents(v: Views) -> DataFrame:
    """Documents as bytes, by their number: UTF-8, UTF-16 with a mark, a Western and a Cyrillic code page; and what is read in them."""
    n = F.col("doc_id") % 4
    western = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\u0001-\u007fÀ-ÿ]", "")
    cyrillic = F.regexp_replace(western, "[aeo]", "àîå")  # as bytes, three Cyrillic letters
    body = F.when(n == 0, F.encode("text", "UTF-8")).when(n == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(n == 2, F.encode(western, "ISO-8859-1")).otherwise(F.encode(cyrillic, "ISO-8859-1"))
    found = v.read("documents").select("doc_id", encoding.decoded(body).alias("d"))
    return found.select("doc_id", "d.encoding", "d.confidence", F.md5(F.encode("d.text", "UTF-8")).alias("digest"), F.length("d.text").cast("bigint").alias("n_chars"))


_CYRILLIC = "".join(chr(c) for c in range(0x410, 0x450))
DECODED_SQL = f"""with w as (
  select doc_id, doc_id % 4 as n, text, regexp_replace(coalesce(text, ''), '[^\\x01-\\x7FÀ-ÿ]', '', 'g') as western from documents
), b as (
  select *, case n when 2 then western when 3 then regexp_replace(western, '[aeo]', 'àîå', 'g') end as bytes from w
), r as (
  select *, coalesce(list_max([len(x) for x in regexp_extract_all(bytes, '[À-ÿ]+')]), 0) as run from b
), t as (
  select *, case when n < 2 then text when run >= 3 then translate(bytes, '{"".join(chr(c) for c in range(0xC0, 0x100))}', '{_CYRILLIC}') else bytes end as said from r
)
select doc_id, case when text is null and n < 2 then null when n = 0 then 'utf-8' when n = 1 then 'utf-16le' when run = 0 then 'utf-8' when run >= 3 then 'windows-1251' else 'windows-1252' end as encoding,
  cast(case when text is null and n < 2 then null when n < 2 or run = 0 then 1.0 when run >= 6 then 0.9 when run >= 3 then 0.75 else 0.7 end as double) as confidence, md5(said) as digest, length(said) as n_chars from t"""


def queries() -> dict:
    return {"play_decisions": (play_decisions, DECISIONS_SQL), "decoded_documents": (decoded_documents, DECODED_SQL)}
