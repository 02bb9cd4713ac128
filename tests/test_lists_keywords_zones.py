"""Keywords, lists of domains and networks, and told times against plain loops."""

import datetime
import random
import time
from collections import Counter
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from sievework.functions import zones
from sievework.operators import blocklists, keywords


@pytest.mark.parametrize("shard", [200_000, 7])
def test_keywords_by_plain_loops(spark, monkeypatch, shard):
    monkeypatch.setattr(keywords, "SHARD", shard)
    rng = random.Random(6)
    words = ["".join(rng.choices("abc ", k=rng.randint(1, 4))) for _ in range(30)] + ["é", "ab", "abc", "b"]
    table = [(w, g) for w in words for g in rng.sample(range(6), rng.randint(1, 3))] + [("", 1), (None, 2), ("a", None), ("ab", 0), ("ab", 0)]
    texts = [(k, "".join(rng.choices("abc dé", k=rng.randint(0, 60)))) for k in range(80)] + [(90, None), (91, ""), (92, "ab" * 50_000)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    got = {r["id"]: {x["g"]: x["n"] for x in r["groups"]} for r in keywords.with_groups(df, F.col("text"), spark.createDataFrame(table, "w string, g int"), "w", "g").collect()}
    pairs = {(w, g) for w, g in table if w and g is not None}
    assert got == {k: dict(Counter(g for w, g in pairs if t and w in t)) for k, t in texts}
    assert all(x == {} for x in ({r["id"]: r["groups"] for r in keywords.with_groups(df.where("id = 91"), F.col("text"), spark.createDataFrame([], "w string, g int"), "w", "g").collect()} and [{}]))


def test_many_keywords_take_no_longer():
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40_000))

    def seconds(n):
        trie = keywords.compile_keywords([("".join(rng.choices("abcdefghij", k=12)), [0]) for _ in range(n)])
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            keywords.groups_found(trie, text)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(100_000) < 20 * seconds(100) + 0.2  # a thousand times the keywords: memory is farther, the pass is one


def test_domains_by_plain_loops(spark):
    listed = ["example.org", "a.example.org", "net", "x.y.z", None]
    hosts = ["example.org", "b.a.example.org", "A.Example.ORG", "notexample.org", "foo.net", "net", "y.z", "x.y.z.", "", None, "..", "w.x.y.z"]
    rows = spark.createDataFrame(list(enumerate(hosts)), "id int, host string")
    table = spark.createDataFrame([(d,) for d in listed], "d string")

    def plain(host):
        h = (host or "").lower().rstrip(".")
        found = [d for d in listed if d and (h == d or h.endswith("." + d))]
        return max(found, key=len) if found else None

    for in_row in (100, 0):
        got = {r["id"]: r["match"] for r in blocklists.longest_match(rows, "id", blocklists.suffixes(F.col("host")), table, "d", in_row).collect()}
        assert got == {k: plain(h) for k, h in enumerate(hosts)}
        assert {r["match"] for r in blocklists.longest_match(rows, "id", blocklists.suffixes(F.col("host")), table.limit(0), "d", in_row).collect()} == {None}


def test_networks_by_plain_loops(spark):
    rng = random.Random(9)
    networks = [(rng.getrandbits(32), rng.choice([0, 4, 8, 12, 24, 32])) for _ in range(40)]
    addresses = [rng.getrandbits(32) for _ in range(300)] + [n for n, _ in networks] + [0, 2**32 - 1]
    rows = spark.createDataFrame(list(enumerate(addresses)), "id int, n long")
    table = spark.createDataFrame(networks, "network long, bits int").select(blocklists.network_key(F.col("network"), F.col("bits")).alias("k"))
    lengths = sorted({b for _, b in networks}, reverse=True)

    def plain(n):
        found = [(b, x >> (32 - b)) for x, b in networks if n >> (32 - b) == x >> (32 - b)]
        return "{}/{}".format(*max(found)) if found else None

    for in_row in (100, 0):
        got = {r["id"]: r["match"] for r in blocklists.longest_match(rows, "id", blocklists.prefixes(F.col("n"), lengths), table, "k", in_row).collect()}
        assert got == {k: plain(n) for k, n in enumerate(addresses)}


def test_lists_are_joined_by_keys(spark):
    rows = spark.range(1000).select("id", F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.org")).alias("host"))
    listed = spark.range(0, 1000, 3).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.org")).alias("d"))
    df = blocklists.longest_match(rows, "id", blocklists.suffixes(F.col("host")), listed, "d", 10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert df.where("match is not null").count() == 334
    bits, words = blocklists.bloom_filter(listed, "d", 334)
    filled = bits.select(F.aggregate("bits", F.lit(0), lambda a, x: a + F.bit_count(x))).first()[0]
    assert words == 83 and len(bits.first()["bits"]) == words and 700 < filled <= 3 * 334


def test_told_times(spark):
    names = ["UTC", "America/New_York", "Asia/Kolkata", "Europe/Berlin", "Pacific/Chatham", "No/Where"]
    times = [datetime.datetime(2024, m, d, h, 30, 5, us, tzinfo=datetime.UTC) for m, d, h, us in ((1, 1, 0, 0), (3, 10, 6, 5), (3, 10, 7, 0), (7, 1, 13, 120_000), (10, 27, 1, 0), (12, 31, 23, 999_999))]
    rows = [(z, t) for z in names for t in times]
    df = spark.createDataFrame([(z, t.timestamp() * 1e6) for z, t in rows], "zone string, us double").select("zone", F.timestamp_micros(F.col("us").cast("bigint")).alias("ts"))
    got = df.select("zone", *(c.alias(n) for n, c in zones.told(F.col("ts"), F.col("zone"), names[:-1]).items())).collect()
    for (z, t), r in zip(rows, got, strict=True):
        if z == "No/Where":
            assert r["iso"] == r["readable"] == "Error: no time zone found with key No/Where"
            continue
        local = t.astimezone(ZoneInfo(z))
        assert (r["iso"], r["unix"], r["readable"]) == (local.isoformat(), int(t.timestamp()), local.strftime("%A, %B %d, %Y at %I:%M:%S %p %Z"))
