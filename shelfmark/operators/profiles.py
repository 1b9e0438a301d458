"""What clients can play: their capabilities as rules in data, asked of every song.

A client states its capabilities as one JSON document. The documents of all clients asked for are one constant, read
once when the plan is made; every song is then told beside each client without a join. A rule on a value that
a song lacks, or that cannot be understood, is neither met nor broken. Of each profile the first rule that the song
breaks is the reason; of the profiles to convert to, the first that can be made is the target.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSPORT = "http"
#: Containers that are another by a different ending.
SAME_CONTAINER = {"m4a": "mp4", "m4b": "mp4", "mov": "mp4", "oga": "ogg", "opus": "ogg"}
#: What can be made, in order of preference: format, container, codecs that it is told by, whether it keeps every sample.
FORMATS = (
    ("mp3", "mp3", ("mp3", "mp3float"), False), ("opus", "ogg", ("opus",), False), ("ogg", "ogg", ("vorbis",), False), ("aac", "mp4", ("aac", "aac_latm"), False), ("flac", "flac", ("flac",), True),
    ("wav", "wav", ("pcm_s16le", "pcm_s24le", "pcm_s32le", "pcm_u8", "pcm_f32le", "pcm_s16be", "pcm_s24be", "pcm_mulaw", "pcm_alaw"), True),
)
#: From these on a ceiling is none: kilobits a second, channels.
MOST_KBPS, MOST_CHANNELS = 10_000, 32
#: Clients of one plan: its constant stays small.
MOST_CLIENTS = 1000

_RULE = "struct<name: string, comparison: string, values: array<string>, required: boolean>"
CLIENT = f"""struct<client_id: bigint, maxAudioBitrate: bigint, maxTranscodingAudioBitrate: bigint,
  directPlayProfiles: array<struct<containers: array<string>, audioCodecs: array<string>, protocols: array<string>, maxAudioChannels: int>>,
  transcodingProfiles: array<struct<container: string, audioCodec: string, protocol: string, maxAudioChannels: int>>,
  codecProfiles: array<struct<name: string, limitations: array<{_RULE}>>>>"""


def container_of(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SAME_CONTAINER.items() for x in p)), name), name)


def some(c: Column, kind: str) -> Column:
    """A list, empty where it is absent."""
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def holds(rule: Column, value: Column) -> Column:
    """Whether a rule holds of a number: null where either is missing or the rule says nothing that can be understood."""
    values = some(rule["values"], "string")
    bound = F.get(values, F.lit(0)).try_cast("double")
    said = rule["comparison"]
    among = F.array_contains(values, value.cast("string"))
    told = F.when(said == "Equals", among).when(said == "NotEquals", ~among).when(said == "LessThanEqual", value <= bound).when(said == "GreaterThanEqual", value >= bound)
    return F.when(value.isNotNull() & (F.size(values) > 0), told)


def _named(rule: Column, song: dict[str, Column]) -> Column:
    return F.when(rule["name"] == "audioChannels", song["channels"]).when(rule["name"] == "audioBitrate", song["bitrate"]).when(rule["name"] == "audioSamplerate", song["samplerate"])


def broken_rule(client: Column, song: dict[str, Column]) -> Column:
    """The name of the first required rule, of the client's profiles for the song's codec, that the song breaks."""
    kind = f"struct<name: string, limitations: array<{_RULE}>>"
    mine = F.filter(some(client["codecProfiles"], kind), lambda p: (F.coalesce(p["name"], F.lit("")) == "") | (p["name"] == song["codec"]))
    rules = F.flatten(F.transform(mine, lambda p: some(p["limitations"], _RULE)))
    broken = F.filter(rules, lambda r: F.coalesce(r["required"], F.lit(False)) & ~F.coalesce(holds(r, _named(r, song)), F.lit(True)))
    return F.get(broken, F.lit(0))["name"]


def refusal(profile: Column, client: Column, song: dict[str, Column], broken: Column) -> Column:
    """Why a profile does not let a song be played as it is: the first rule in order; null if it does."""
    protocols, containers, codecs = (some(profile[x], "string") for x in ("protocols", "containers", "audioCodecs"))
    limit = client["maxAudioBitrate"]
    return (
        F.when((F.size(protocols) > 0) & ~F.array_contains(protocols, TRANSPORT), F.concat(F.lit("ProtocolNotSupported: "), F.array_join(protocols, ", ")))
        .when((F.size(containers) > 0) & ~F.exists(containers, lambda x: container_of(x) == song["container"]), F.concat(F.lit("ContainerNotSupported: "), song["container"]))
        .when((F.size(codecs) > 0) & ~F.array_contains(codecs, song["codec"]), F.concat(F.lit("AudioCodecNotSupported: "), song["codec"]))
        .when(song["channels"] > profile["maxAudioChannels"], F.concat(F.lit("AudioChannelsNotSupported: "), song["channels"].cast("string")))
        .when((limit > 0) & (song["bitrate"] > limit), F.concat(F.lit("AudioBitrateNotSupported: "), song["bitrate"].cast("string")))
        .when(broken.isNotNull(), F.concat(F.lit("LimitationNotMet: "), broken))
    )


def format_of(container: Column, codec: Column) -> Column:
    """The first format that is a container and codec; null if none can be made."""
    out = F.lit(None).cast("string")
    for name, held, codecs, _ in reversed(FORMATS):
        out = F.when((container_of(container) == held) & codec.isin(*codecs), name).otherwise(out)
    return out


def target(client: Column, song: dict[str, Column]) -> Column:
    """(format, max_kbps, max_channels) of the first profile that can be made; null ceilings where nothing is cut."""
    kind = "struct<container: string, audioCodec: string, protocol: string, maxAudioChannels: int>"
    feasible = F.filter(some(client["transcodingProfiles"], kind), lambda p: (p["protocol"] == TRANSPORT) & format_of(p["container"], p["audioCodec"]).isNotNull())
    first = F.get(feasible, F.lit(0))
    bits = F.coalesce(client["maxTranscodingAudioBitrate"], client["maxAudioBitrate"])
    kbps = F.greatest(F.lit(1), F.floor(bits / 1000 + 0.5)).cast("int")
    cap = first["maxAudioChannels"]
    channels = F.when((cap > 0) & (cap < MOST_CHANNELS) & (song["channels"] > cap), cap)
    return F.when(F.size(feasible) > 0, F.struct(format_of(first["container"], first["audioCodec"]).alias("format"), F.when((bits > 0) & (kbps < MOST_KBPS), kbps).alias("max_kbps"), channels.alias("max_channels")))


def decisions(songs: DataFrame, clients: DataFrame) -> DataFrame:
    """One row for each of ``songs`` (id, container, codec, channels, bitrate, samplerate) and each of ``clients`` (client_id, body): can_play, reasons, target.

    A client's ``body`` is its JSON; one that is no JSON object has no profiles, so it plays nothing and asks for nothing.
    Reasons are one for each profile, none where the song can be played as it is.
    """
    asked = clients.select("client_id", "body").orderBy("client_id").limit(MOST_CLIENTS + 1).collect()
    if len(asked) > MOST_CLIENTS:
        raise ValueError(f"ask for at most {MOST_CLIENTS} clients at a time")
    bodies = []
    for r in asked:
        try:
            body = json.loads(r["body"] or "{}")
        except ValueError:
            body = {}
        bodies.append((body if isinstance(body, dict) else {}) | {"client_id": r["client_id"]})
    known = F.from_json(F.lit(json.dumps(bodies)), f"array<{CLIENT}>")
    song = {c: F.col(c) for c in ("container", "codec", "channels", "bitrate", "samplerate")} | {"container": container_of(F.col("container"))}
    client = F.col("_client")
    # songs are few bytes and much work: dealt out first, as one block of a file would be one task's
    tasks = int(songs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = songs.select("id", "container", "codec", "channels", "bitrate", "samplerate").repartition(tasks, "id")
    rows = dealt.withColumn("_client", F.explode(known)).withColumn("_broken", broken_rule(client, song))
    direct = some(client["directPlayProfiles"], "struct<containers: array<string>, audioCodecs: array<string>, protocols: array<string>, maxAudioChannels: int>")
    told = rows.withColumn("_why", F.transform(direct, lambda p: refusal(p, client, song, F.col("_broken"))))
    plays = F.exists("_why", lambda x: x.isNull())
    return told.select("id", F.col("_client.client_id").alias("client_id"), plays.alias("can_play"), F.when(plays, F.array().cast("array<string>")).otherwise(F.col("_why")).alias("reasons"), target(client, song).alias("target"))
