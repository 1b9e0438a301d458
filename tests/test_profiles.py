"""Rules of clients over songs: order of reasons, rules that cannot be told, targets."""

import json

import pytest

from shelfmark.operators import profiles

SONG = "id int, container string, codec string, channels int, bitrate bigint, samplerate int"


def decide(spark, song, *clients):
    rows = spark.createDataFrame([(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, c in enumerate(clients)], "client_id bigint, body string")
    got = profiles.decisions(spark.createDataFrame([(1, *song)], SONG), rows).orderBy("client_id").collect()
    return [(r["can_play"], list(r["reasons"]), r["target"] and tuple(r["target"])) for r in got]


def rule(name, comparison, *values, required=True):
    return {"name": name, "comparison": comparison, "values": list(values), "required": required}


def client(*rules, codec="", **more):
    return {"directPlayProfiles": [{}], "codecProfiles": [{"name": codec, "limitations": list(rules)}]} | more


def test_rules(spark):
    song = ("m4a", "aac", 6, 300000, None)
    cases = [
        (client(), True, []), (client(rule("audioChannels", "LessThanEqual", "2")), False, ["LimitationNotMet: audioChannels"]), (client(rule("audioChannels", "LessThanEqual", "2"), codec="mp3"), True, []),
        (client(rule("audioChannels", "LessThanEqual", 2, required=False)), True, []), (client(rule("audioSamplerate", "Equals", "44100")), True, []), (client(rule("audioProfile", "Equals", "LC")), True, []),
        (client(rule("audioChannels", "Matches", "2")), True, []), (client(rule("audioChannels", "LessThanEqual")), True, []), (client(rule("audioChannels", "LessThanEqual", "many")), True, []),
        (client(rule("audioChannels", "NotEquals", "6")), False, ["LimitationNotMet: audioChannels"]), (client(rule("audioChannels", "Equals", "2", 6)), True, []), (client(rule("audioBitrate", "GreaterThanEqual", "3e5")), True, []),
        ({"directPlayProfiles": [{"containers": ["mov"], "audioCodecs": ["aac"], "protocols": ["http"], "maxAudioChannels": 6}]}, True, []),
        ({"directPlayProfiles": [{"containers": ["flac"]}, {"protocols": ["hls"], "containers": ["flac"]}, {"audioCodecs": ["mp3"]}, {"maxAudioChannels": 2}]}, False, ["ContainerNotSupported: mp4", "ProtocolNotSupported: hls", "AudioCodecNotSupported: aac", "AudioChannelsNotSupported: 6"]),
        ({"directPlayProfiles": [{}], "maxAudioBitrate": 256000}, False, ["AudioBitrateNotSupported: 300000"]), ({"directPlayProfiles": [{}], "maxAudioBitrate": 0}, True, []),
        ({"directPlayProfiles": [{"containers": ["flac"]}, {}]}, True, []), ({}, False, []), (None, False, []), ("no json", False, []), ("[1]", False, []),
    ]
    got = decide(spark, song, *(c for c, *_ in cases))
    assert [(a, b) for a, b, _ in got] == [(a, b) for _, a, b in cases]


def test_targets(spark):
    t = lambda *x, **more: {"transcodingProfiles": [dict(zip(("container", "audioCodec", "protocol", "maxAudioChannels"), p, strict=False)) for p in x]} | more
    cases = [
        (t(("mp3", "mp3", "hls"), ("avi", "mp3", "http"), ("oga", "opus", "http", 2), ("mp3", "mp3", "http")), ("opus", None, 2)), (t(("mp3", "mp3", "http"), maxAudioBitrate=256_499), ("mp3", 256, None)),
        (t(("mp4", "aac_latm", "http", 8), maxAudioBitrate=256000, maxTranscodingAudioBitrate=400), ("aac", 1, None)), (t(("flac", "flac", "http", 32), maxAudioBitrate=10_000_000), ("flac", None, None)), (t(("wav", "mp3", "http")), None), (t(), None),
        (t(("ogg", "vorbis", "http", 0), maxTranscodingAudioBitrate=-1), ("ogg", None, None)),
    ]
    assert [x for *_, x in decide(spark, ("m4a", "aac", 6, 300000, None), *(c for c, _ in cases))] == [want for _, want in cases]


def test_songs_with_nulls_and_too_many_clients(spark, monkeypatch):
    assert decide(spark, (None, None, None, None, None), {"directPlayProfiles": [{"maxAudioChannels": 1}], "maxAudioBitrate": 1})[0][0] is True
    monkeypatch.setattr(profiles, "MOST_CLIENTS", 1)
    with pytest.raises(ValueError):
        decide(spark, ("mp3", "mp3", 2, 1, 1), {}, {})
