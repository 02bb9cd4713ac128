"""The inverted index, the cell index, the embedding cache and packing against plain loops."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import packing
from sievework.functions import text as T
from sievework.operators import inverted_index, vectors
from sievework.operators.cells import CellIndex
from sievework.operators.embed_cache import EmbeddingCache, text_hash
from sievework.operators.inverted_index import InvertedIndex
from sievework.operators.joins import joined_by_key

# -- inverted index -------------------------------------------------------------------------------------------


def tokens(text):
    return [w for w in re.findall(r"\w+", (text or "").lower()) if not w.isdigit()]


def plain_bm25(docs, query):
    words = {k: tokens(t) for k, t in docs}
    average = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for k, ws in words.items():
        tf, s = Counter(ws), 0.0
        for q in tokens(query):
            if q in tf:
                s += math.log((len(words) - df[q] + 0.5) / (df[q] + 0.5) + 1) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(ws) / average))
        if any(q in tf for q in tokens(query)):
            out[k] = round(s, 4)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{min(int(rng.paretovariate(0.7)), 3000)}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.choice([3, 10, 40, 200])))) for k in range(3000)]
    docs += [(5000 + k, "apple pie " * (k + 1) + "filler " * (40 - k)) for k in range(30)] + [(6000, None), (6001, ""), (6002, "123 456")]
    return docs


QUERIES = [(1, "apple pie"), (2, "w1 w2 w3"), (3, "w1 w1 w900"), (4, "nothing"), (5, ""), (6, "w17 filler w2999")]


def found(index, spark, most=10):
    asked = spark.createDataFrame(QUERIES, "qid long, query string")
    out = {}
    for r in index.search(asked, "qid", most).orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["key"], r["score"]))
    return out


def test_index_finds_what_loops_find(spark, corpus, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}/all")
    df = spark.createDataFrame(corpus, "id long, text string")
    assert index.append(df, "id", "text", "one") and not index.append(df, "id", "text", "one")
    got = found(index, spark)
    for qid, query in QUERIES:
        want = plain_bm25(corpus, query)[:10]
        assert [k for k, _ in got.get(qid, [])] == [k for k, _ in want]
        assert all(abs(a - b) <= 1e-4 for (_, a), (_, b) in zip(got.get(qid, []), want, strict=True))
    # blocks that can't reach the last place are left out
    asked = spark.createDataFrame(QUERIES, "qid long, query string")
    steps = {r["step"]: r["n"] for r in index.chosen_ranges(asked, "qid", 10)[0].groupBy("step").agg(F.count("*").alias("n")).collect()}
    assert steps[None] > 0 and sum(n for s, n in steps.items() if s) < sum(steps.values())


def test_appended_index_equals_one_built_at_once(spark, corpus, tmp_path):
    whole, parts = InvertedIndex(spark, f"file://{tmp_path}/whole"), InvertedIndex(spark, f"file://{tmp_path}/parts")
    schema = "id long, text string"
    whole.append(spark.createDataFrame(corpus, schema), "id", "text", "x")
    parts.append(spark.createDataFrame(corpus[:1000], schema), "id", "text", "a")
    first = found(parts, spark)
    parts.append(spark.createDataFrame([], schema), "id", "text", "none")
    # a segment whose writer failed before it was entered doesn't count
    lost = f"file://{tmp_path}/parts/postings/segment=s-lost"
    spark.read.parquet(f"file://{tmp_path}/parts/postings/segment=s-a").write.partitionBy("bucket").parquet(lost)
    assert found(parts, spark) == first
    parts.append(spark.createDataFrame(corpus[1000:], schema), "id", "text", "b")
    a, b = found(whole, spark, 25), found(parts, spark, 25)
    assert a == b and len(a[1]) == 25
    rows = lambda i: sorted((r["term"], r["df"]) for r in i.frequencies().collect())
    assert rows(whole) == rows(parts)
    assert found(InvertedIndex(spark, f"file://{tmp_path}/nowhere"), spark) == {}


def test_blocks_are_what_loops_make(spark, corpus, tmp_path):
    index = InvertedIndex(spark, f"file://{tmp_path}/blocks")
    index.append(spark.createDataFrame(corpus, "id long, text string"), "id", "text", "one")
    want, lengths = {}, {k: len(tokens(t)) for k, t in corpus}
    for k, t in corpus:
        for w, tf in Counter(tokens(t)).items():
            want.setdefault(w, []).append((k, tf, lengths[k]))
    ranges = {r["rng"]: (r["keys"], r["lengths"]) for r in index.ranges().collect()}
    assert sorted(k for keys, _ in ranges.values() for k in keys) == sorted(lengths)  # each document is in one range
    got = {}
    for r in index.blocks().collect():
        keys, dls = ranges[r["rng"]]
        postings = [(keys[d], tf, dls[d]) for d, tf in zip(r["docs"], r["tfs"], strict=True)]
        assert postings == sorted(postings) and len(postings) == r["n"]
        assert (r["tf"], r["dl"], r["total"]) == (max(p[1] for p in postings), min(p[2] for p in postings), sum(p[1] for p in postings))
        got.setdefault(r["term"], []).extend(postings)
    assert {w: sorted(p) for w, p in got.items()} == {w: sorted(p) for w, p in want.items()}
    sums = {r["term"]: (r["df"], r["total"]) for r in index.frequencies().collect()}
    assert sums == {w: (len(p), sum(x[1] for x in p)) for w, p in want.items()}


def test_search_keeps_blocks_of_asked_terms(spark, corpus, tmp_path, monkeypatch):
    index = InvertedIndex(spark, f"file://{tmp_path}/asked")
    index.append(spark.createDataFrame(corpus, "id long, text string"), "id", "text", "one")
    given, scored = [], InvertedIndex._scored

    def seen(self, blocks, *rest):
        given.append({r["term"] for r in blocks.select("term").distinct().collect()})
        return scored(self, blocks, *rest)

    monkeypatch.setattr(InvertedIndex, "_scored", seen)
    found(index, spark)
    asked = {w for _, q in QUERIES for w in tokens(q)} & {w for _, t in corpus for w in tokens(t)}
    assert given == [asked, asked]


def test_term_runs(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "w array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(inverted_index.term_runs(F.col("w"))).collect()] == [[("a", 1), ("b", 2)], [], [("x", 1)]]


# -- cells ----------------------------------------------------------------------------------------------------


def cosines(x):
    n = np.sqrt((x * x).sum(axis=1))[:, None]
    u = x / np.where(n > 0, n, 1)
    return u @ u.T


@pytest.mark.parametrize("kind", ["clustered", "random", "copies"])
def test_cells_find_what_loops_find(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    if kind == "clustered":
        x = x / 20 + rng.normal(size=(30, 16))[rng.integers(0, 30, 900)]
    if kind == "copies":
        x[:300] = x[0]
    x[500:503] = 0
    df = spark.createDataFrame([(int(k), [float(y) for y in v]) for k, v in enumerate(x)], "id long, v array<double>").unionByName(spark.createDataFrame([(9999, None)], "id long, v array<double>"))
    index = CellIndex(df, "id", "v", cell_rows=40)
    sims = cosines(x)
    asked = df.where("id % 50 = 0")
    got = {}
    for r in index.nearest(asked, "id", "v", 10).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["key"], r["sim"]))
    assert len(got) == 18
    for q, rows in got.items():
        want = sorted((-round(float(s), 4), k) for k, s in enumerate(sims[q]) if k != q)[:10]
        assert [k for k, _ in rows] == [k for _, k in want]
    compared = [r["vectors"] for r in index.nearest(asked, "id", "v", 10, report=True).collect()]
    if kind == "clustered":
        assert np.mean(compared) < 0.5 * len(x) and index.skipped(0.9) > 0.5
    for threshold in (0.3, 0.9):
        a, b = np.nonzero(np.triu(sims >= threshold, 1))
        pairs = sorted((r["a"], r["b"]) for r in index.similar_pairs(threshold, partners=3).collect())
        assert pairs == sorted(zip(a.tolist(), b.tolist(), strict=True))


def test_cells_of_nothing_and_of_unlike_lengths(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert CellIndex(empty, "id", "v").similar_pairs(0.5).count() == 0
    assert CellIndex(empty, "id", "v").nearest(spark.createDataFrame([(1, [1.0])], "id long, v array<double>"), "id", "v", 3).count() == 0
    with pytest.raises(ValueError, match="same length"):
        CellIndex(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v")


def test_tiles_are_sent_once_a_group_of_partners(spark):
    rng = np.random.default_rng(11)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 8)))], "id long, v array<double>")
    index = CellIndex(v, "id", "v", 32)
    few = sorted((r["a"], r["b"]) for r in index.similar_pairs(0.95).collect())
    assert few == sorted((r["a"], r["b"]) for r in index.similar_pairs(0.95, partners=15).collect()) and len(set(few)) == len(few) > 0
    assert index.tiles.count() > 40 and index.pair_groups() == 1  # a tile was sent to as many tasks as it had partners before
    index.d, index.n = 64, 1 << 19
    assert index.pair_groups() == 24
    index.n = 1 << 26
    assert (1 << 26) / index.pair_groups() * 64 * 8 <= 128 << 20

def test_greedy_pass_by_loops(spark):
    rng = random.Random(1)
    edges = sorted({tuple(sorted(rng.sample(range(200), 2))) for _ in range(400)})
    kept = []
    for n in range(200):
        if not any(b == n and a in kept for a, b in edges):
            kept.append(n)
    nodes = spark.createDataFrame([(n,) for n in range(200)], "k long")
    assert sorted(r["k"] for r in vectors.greedy_independent(nodes, spark.createDataFrame(edges, "a long, b long"), "k").collect()) == kept


def test_semantic_dedup_by_loops(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 6))
    x[40:90] = x[3]  # a large group of copies
    x[100:104] = 0
    rows = [(int(k), [float(y) for y in v]) for k, v in enumerate(x)] + [(500, None)]
    sims, kept = cosines(x), []
    for k in range(len(x)):
        if not any(sims[k, j] >= 0.6 for j in kept):
            kept.append(k)
    got = vectors.semantic_dedup(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), "id", "v", 0.6)
    assert sorted(r["id"] for r in got.collect()) == [*kept, 500]


# -- embedding through a cache --------------------------------------------------------------------------------


def test_cache_computes_each_miss_once(spark, tmp_path):
    log = tmp_path / "calls"

    def model(texts):
        with open(log, "a") as f:
            f.write("".join(f"{len(texts)}\t{t}\n" for t in texts))
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache", model, 2, batch_size=4)
    rows = [(k, f"text {k % 7}") for k in range(70)] + [(70, "bad one"), (71, None), (72, ""), (73, "é" * 9)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    assert cache.fill(df.where("id < 3"), "text", "first") == 3
    out = {r["id"]: (r["hit"], r["embedding"]) for r in cache.embed(df, "text", "second").collect()}
    assert len(out) == len(rows)
    for k, t in rows:
        assert out[k] == (t in ("text 0", "text 1", "text 2"), [0.0, 0.0] if t == "bad one" else [float(len(t or "")), 1.0])
    alone = Counter(line.split("\t", 1)[1].strip() for line in log.read_text().splitlines() if line)
    assert all(alone[f"text {k}"] <= 2 for k in range(7))  # twice at most: with its batch that failed, then alone
    before = log.read_text()
    again = {r["id"]: (r["hit"], r["embedding"]) for r in cache.embed(df, "text", "second").collect()}
    assert again == out and log.read_text() == before  # the second run computes nothing
    third = {r["id"]: r["hit"] for r in cache.embed(df.where("id < 71"), "text", "third").collect()}
    assert all(hit for k, hit in third.items() if k != 70) and not third[70]  # what failed is tried again
    assert log.read_text() != before and "text" not in log.read_text()[len(before) :]
    assert cache.known().groupBy("h").count().where("count > 1").count() == 0


def test_half_written_batches_are_replaced(spark, tmp_path):
    cache = EmbeddingCache(spark, f"file://{tmp_path}/cache", lambda ts: [[1.0] for _ in ts], 1)
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    spark.createDataFrame([("junk", [9.0])], "h string, embedding array<double>").write.parquet(f"file://{tmp_path}/cache/batch=x")
    (tmp_path / "cache" / "batch=x" / "_SUCCESS").unlink()
    assert cache.known().count() == 0 and cache.fill(df, "text", "x") == 2
    assert sorted(r["h"] for r in cache.known().collect()) == sorted(r["h"] for r in df.select(text_hash(F.col("text")).alias("h")).collect())


def test_join_by_hot_keys(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 == 0 else f"k{k % 50}") for k in range(600)] + [(600, None)]
    df, other = spark.createDataFrame(rows, "id long, k string"), spark.createDataFrame([("hot", 1), *((f"k{j}", 2) for j in range(40))], "k string, v int")
    want = sorted((i, k, 1 if k == "hot" else 2 if k and int(k[1:]) < 40 else None) for i, k in rows)
    key = lambda r: r[0]
    for bound in (100, 0):
        monkeypatch.setattr("sievework.operators.joins.BROADCAST_ROWS", bound)
        monkeypatch.setattr("sievework.operators.joins.HOT_KEYS", 10)
        assert sorted(((r["id"], r["k"], r["v"]) for r in joined_by_key(df, other, "k").collect()), key=key) == sorted(want, key=key)


# -- packing --------------------------------------------------------------------------------------------------


def plain_chunks(sentences, size, overlap):
    out, cur, sz = [], [], 0
    for s in sentences:
        if sz + len(s) > size and cur:
            out.append(" ".join(cur))
            kept, total = [], 0
            for x in reversed(cur):
                if total + len(x) > overlap:
                    break
                kept.insert(0, x)
                total += len(x) + 1
            cur = kept or [cur[-1]]
            sz = sum(len(x) + 1 for x in cur)
        cur.append(s)
        sz += len(s) + 1
    return out + ([" ".join(cur)] if cur else [])


def plain_small(parts, least):
    out = []
    for p in parts:
        if out and len(out[-1]) < least:
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def plain_pages(parts, size):
    out, cur, sz = [], [], 0
    for p in parts:
        if sz + len(p) + 2 > size and cur:
            out.append("\n".join(cur))
            cur, sz = [], 0
        cur.append(p)
        sz += len(p) + 2
    return out + (["\n".join(cur)] if cur else [])


def test_packing_by_plain_loops(spark):
    rng = random.Random(4)
    rows = [(k, [chr(97 + j % 26) * rng.choice([1, 5, 30, 80, 200, 700]) for j in range(rng.choice([0, 1, 2, 3, 17, 64, 65, 150]))]) for k in range(120)] + [(999, ["x"] * 90), (1000, ["y" * 500] * 9)]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    cases = {"a": (300, 60), "b": (1000, 200), "c": (50, 500), "d": (300, 0)}
    got = df.select("id", *(T.chunks(F.col("s"), *c).alias(n) for n, c in cases.items()), T.merge_small(F.col("s"), 200).alias("m"), T.pages(F.col("s"), 400).alias("p")).collect()
    for r in got:
        s = dict(rows)[r["id"]]
        for n, (size, overlap) in cases.items():
            assert r[n] == plain_chunks(s, size, overlap), (n, len(s))
        assert r["m"] == plain_small(s, 200) and r["p"] == plain_pages(s, 400)


def test_packing_grows_with_its_input(spark):
    def seconds(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("sentence number "), i.cast("string"))).alias("s"))
        began = time.perf_counter()
        row = df.select(F.size(T.chunks(F.col("s"), 1000, 200)).alias("c"), F.size(T.pages(F.col("s"), 1000)).alias("p")).first()
        assert row["c"] > n // 60 and row["p"] > n // 60
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(30_000), seconds(240_000)
    assert large < 16 * small + 2  # eight times the sentences


def test_prefix_sums_and_places(spark):
    df = spark.createDataFrame([([3, 1, 2],), ([],)], "v array<int>")
    assert [r[0] for r in df.select(packing.prefix_sums(F.col("v"))).collect()] == [[0, 3, 4, 6], [0]]
    one = df.where("size(v) = 3").select(*(packing.first_above(packing.prefix_sums(F.col("v")), F.lit(x)).alias(f"x{x + 1}") for x in range(-1, 8))).first()
    assert list(one) == [0, 1, 1, 1, 2, 3, 3, 4, 4]
