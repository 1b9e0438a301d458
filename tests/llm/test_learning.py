"""What is learnt is learnt from every row: none of a hash too large to be looked at."""

from pyspark.sql import functions as F

from shelfmark.llm import quality, secret_scan


def test_quality_learns_from_documents_of_any_hash(spark):
    """The faulty documents all come after the 3,000 sound ones of smallest hash."""
    sound = spark.range(5000).select(F.expr("'The keeper of house ' || id || ' walked along the river in the evening. Nobody asked ' || (id * 7919) % 10007 || ' people about it.'").alias("text"))
    faulty = spark.range(400).select(F.expr("repeat('BUY ' || id % 13 || ' NOW | $$ !! ', 6 + cast(id % 5 as int)) || id").alias("text"))
    edge = sound.select(F.xxhash64("text").alias("h")).orderBy("h").limit(3000).agg(F.max("h")).first()[0]
    faulty = faulty.filter(F.xxhash64("text") > edge)
    found = quality.score(sound.union(faulty).select(F.monotonically_increasing_id().alias("doc_id"), "text")).filter("posterior <= 0.5")
    assert faulty.count() > 50
    assert [tuple(r) for r in found.groupBy("keep").count().collect()] == [(False, faulty.count())]


def test_secret_network_learns_from_candidates_beyond_a_group(spark, monkeypatch):
    """Windows of all labelled candidates take part, long ones with every window, however many groups they are dealt into."""
    texts = spark.range(60).select(F.expr("'password=' || substr(sha2('a' || id, 256), 1, 30) || ' then see a_long_name_of_' || id || '_things and /' || array_join(transform(sequence(1, 60), i -> repeat('winter', cast(i % 4 + 1 as int))), '/') || id").alias("text"))
    rows = secret_scan.labelled(texts)
    assert rows.groupBy("y").agg(F.countDistinct("owner")).orderBy("y").collect() == [(0, 62), (1, 60)]  # long paths after names with as many digits look alike
    assert rows.groupBy("owner").count().agg(F.max("count")).first()[0] > 24
    learnt = []
    monkeypatch.setattr(secret_scan, "GROUP", 1000)
    monkeypatch.setattr(secret_scan, "SYNTHETIC", 400)
    monkeypatch.setattr(secret_scan, "_round", lambda rows, groups, *x, do=secret_scan._round: learnt.append((groups, rows.count())) or do(rows, groups, *x))
    net = secret_scan.trained(texts)
    aside = rows.filter("pmod(xxhash64(owner, 1), 5) = 0").count()
    assert learnt == [(-(-rows.count() // 1000), rows.count() - aside)] * secret_scan.ROUNDS
    assert net.measured["corpus"][0] == 1 and net.measured["corpus"][2] == rows.filter("pmod(xxhash64(owner, 1), 5) = 0").select("owner").distinct().count()
