"""The stream over event files, the transactional writer, and the table of responses."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sievework.sources import event_files, responses, saved, transactional


def run(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_event_files_exactly_once(spark, tmp_path, monkeypatch):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "c"
    folder.mkdir()
    spark.dataSource.register(event_files.EventFiles)
    stream = lambda: event_files.decoded(spark.readStream.format("event_files").option("path", str(folder)).load())
    say = lambda *words: "".join("data: " + json.dumps({"content": w}) + "\n" for w in words)
    (folder / "a").write_text(say("one", "two") + ": ping\n\ndata: broken\ndata: [DONE]\n" + say("three")[:-5])
    (folder / "b").write_text(say("x"))
    (folder / "_draft").write_text(say("never"))
    run(stream(), out, checkpoint)
    got = lambda: sorted(r["content"] for r in spark.read.parquet(str(out)).collect())
    assert got() == ["one", "two", "x"]  # half a line waits
    with open(folder / "a", "a") as f:
        f.write(say("three")[-5:] + say("fouré"))
    (folder / "c").write_text(say("y"))
    run(stream(), out, checkpoint)
    assert got() == ["fouré", "one", "three", "two", "x", "y"]
    # a failed batch: its offsets stand, its commit is gone; it is read again from the same bytes, and what has come since waits
    commits = sorted(p for p in os.listdir(checkpoint / "commits") if p.isdigit())
    (checkpoint / "commits" / commits[-1]).unlink()
    crc = checkpoint / "commits" / f".{commits[-1]}.crc"
    if crc.exists():
        crc.unlink()
    with open(folder / "b", "a") as f:
        f.write(say("z"))
    run(stream(), out, checkpoint)  # the batch itself
    run(stream(), out, checkpoint)
    assert got() == ["fouré", "one", "three", "two", "x", "y", "z"]


def test_lines_of_parts(tmp_path):
    text = b"".join(b"%d" % k + b"x" * (k % 13) + b"\n" for k in range(400)) + b"rest"
    (tmp_path / "f").write_bytes(text)
    fs, path = event_files.opened(str(tmp_path / "f"))
    stop = event_files.end_of_lines(fs, path, len(text), 0)
    assert stop == len(text) - 4 and event_files.end_of_lines(fs, path, len(text), stop) == stop
    for part in (1, 7, 64, 5000):
        got = [x for b in range(0, stop, part) for x in event_files.lines_between(fs, path, b, min(b + part, stop), stop)]
        assert [line for _, line in got] == text.decode().split("\n")[:-1] and all(text[at:].decode().startswith(line) for at, line in got)


FACTS = [("Rust is fast.", "u1", "t", 0.9, "c"), ("Go is small.", None, None, 0.8, None), (None, "u", "t", 0.1, "c")]
FACT_SCHEMA = "text string, source_url string, source_title string, confidence double, category string"


def test_batches_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/memory"
    facts = spark.createDataFrame(FACTS, FACT_SCHEMA).repartition(2)
    assert transactional.memories(spark, path).count() == 0
    assert transactional.store_facts(facts, path, "b1", 10.0) == 2
    assert transactional.store_facts(facts, path, "b1", 99.0) == 2  # a replay
    assert transactional.read_batches(spark, path, transactional.MEMORY_SCHEMA).count() == 2
    assert transactional.store_facts(facts, path, "b2", 20.0) == 2
    got = {r["memory"]: (r["type"], r["created_at"]) for r in transactional.memories(spark, path).collect()}
    assert got == {"Rust is fast. [Source: u1]": ("knowledge_fact", 10.0), "Go is small. [Source: ]": ("knowledge_fact", 10.0)}
    assert transactional.store_facts(facts.limit(0), path, "none", 1.0) == 0


def test_aborted_batches_are_not_seen(spark, tmp_path):
    path = f"{tmp_path}/memory"
    fine = spark.range(100).select(F.concat(F.lit("fact "), F.col("id").cast("string")).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("source_url", "string"), ("source_title", "string"), ("confidence", "double"), ("category", "string"))))
    fails = fine.repartition(4).withColumn("text", F.when(F.col("text") == "fact 77", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        transactional.store_facts(fails, path, "b", 1.0)
    assert transactional.memories(spark, path).count() == 0 and transactional.batches(spark, path).count() == 0
    assert transactional.store_facts(fine, path, "b", 1.0) == 100 and transactional.memories(spark, path).count() == 100


def test_filters_reach_the_files(spark, tmp_path):
    for provider in ("wiki", "searx"):
        for day in ("2026-01-01", "2026-01-02"):
            for q in ("a b", "c/d"):
                folder = tmp_path / provider / day / "search"
                folder.mkdir(parents=True, exist_ok=True)
                (folder / (q.replace(" ", "%20").replace("/", "%2F") + ".json")).write_text(json.dumps({"results": [{"title": f"{provider} {q}"}]}))
    (tmp_path / "broken").mkdir()
    df = responses.responses(spark, str(tmp_path))
    assert df.count() == 8
    some = df.where("provider = 'wiki' and query in ('c/d', 'none') and length(body) > 1")
    assert sorted((r["provider"], r["day"], r["query"]) for r in some.collect()) == [("wiki", "2026-01-01", "c/d"), ("wiki", "2026-01-02", "c/d")]
    reader = responses._Reader(str(tmp_path))
    left = list(reader.pushFilters([responses.EqualTo(("provider",), "wiki"), responses.In(("query",), ("c/d", "none")), responses.EqualTo(("body",), "x")]))
    assert [f.attribute for f in left] == [("body",)]
    assert sum(len(p.paths) for p in reader.partitions()) == 2  # of eight files
    assert responses._Reader(f"{tmp_path}/nowhere").partitions() == []


def test_wiki_table_equals_plain_rows(spark):
    bodies = [
        ("search", '{"results": [{"title": "T", "path": "p", "snippet": "s", "score": 1.5}, 5, {"title": null}]}'), ("search", '{"results": 3}'), ("search", "broken"), ("search", None),
        ("suggest", '{"book": [{"title": "T", "path": "p"}], "x": 1}'), ("suggest", '{"other": []}'), ("catalog", '[{"name": "n", "entries": 3}, {}]'), ("catalog", '{"name": "n"}'),
        ("content", '{"content": "c"}'), ("content", "[]"), ("random", '{"title": "r", "path": "q"}'), ("random", "{}"), ("random", "null"),
    ]
    df = spark.createDataFrame([(k, kind, "book", body) for k, (kind, body) in enumerate(bodies)], "id int, kind string, book string, body string")
    rows = responses.wiki_table(df)
    for kind in saved.WIKI_RESPONSES:
        want = [(k, {c: v if v is not None else (0 if c in responses.NUMBERS else "") for c, v in r.items()}) for k, (kd, body) in enumerate(bodies) if kd == kind for r in saved.wiki_rows(body, kind, "book") if r is not None]
        got = [(r["id"], {c: r[c] for c in saved.WIKI_RESPONSES[kind]}) for r in responses.wiki_fields(rows, kind).orderBy("id", "pos").collect()]
        assert [g for g in got] == [w for w in want if bodies[w[0]][1] != "[{}]"], kind
