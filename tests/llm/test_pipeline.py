"""The pipeline's stages against their decisions made plainly."""

import random
import re

import corpus_pipeline as P
from conftest import DATA
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "12 34 !!", "en", "s", 8), (9002, "write to a@b.cc now please", None, None, None)], docs.schema)
    docs, before = docs.unionByName(odd), docs.count() + 3
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "mixture":
            assert out.columns == P.COLUMNS
        after = out.count()
        ids = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language":
            assert after >= before - 4 and not {9000, 9001} & set(ids) and 9002 in ids
        if name == "near_duplicates":
            assert after < before and len(ids) == after
        if name == "benchmark_free":
            assert not any(b in t for b in items for t in ids.values())
            assert after == docs.where(~F.exists(F.array(*(F.lit(b) for b in items)), lambda b: F.contains(F.col("text"), b))).count()
        if name == "personal_data":
            assert after == before and ids[9002] == "write to <EMAIL> now please"
        docs, before = out, after
    assert {"pass_no", "block", "position"} <= set(docs.columns)


def plain_stages(rows, items):
    """What near_duplicates, benchmark_free and personal_data decide, by loops over few rows of (doc_id, text)."""
    seen, kept = set(), []
    for i, t in rows:  # rows equal in id and text are one; null ids stay
        if i is None or (i, t) not in seen:
            kept.append((i, t))
        seen.add((i, t))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in ((t or "").lower().split() for _, t in kept)]
    part = list(range(len(kept)))
    for _ in kept:
        for a in range(len(kept)):
            for b in range(len(kept)):
                if kept[a][0] is not None and kept[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    best = {}
    for k, (i, _) in enumerate(kept):
        if i is not None and (part[k] not in best or (i, k) < best[part[k]]):
            best[part[k]] = (i, k)
    near = [kept[k] for k in range(len(kept)) if kept[k][0] is None or best[part[k]][1] == k]
    clean = [(i, t) for i, t in near if not any(b in (t or "") for b in items)]
    return near, clean, [(i, re.sub(r"\S+@\S+\.\w+", "<EMAIL>", t) if t else t) for i, t in clean]


def test_stages_on_awkward_rows(spark, tmp_path):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(300)]
    long = " ".join(rng.choice(words) for _ in range(200))
    near = long + " tail"
    items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(3)]
    rows = [
        (1, long), (1, "another text under the same id, mail ann@example.org now"), (2, near), (2, near), (3, f"prefix {items[0]} suffix"), (None, long), (None, near), (None, near), (4, None), (5, ""),
        (6, " ".join(rng.choice(words) for _ in range(60_000))), (7, "short text"), (7, "short text"), (9, "short text"), (8, long.replace("word1 ", "word2 ")),
    ]
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    sf = str(tmp_path / "sf")
    docs = spark.createDataFrame([(i, t, "en", None if k % 3 else "s", None, 1, "x", 2) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, key int, part string, w int")
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    for k, want in enumerate(plain_stages(rows, items), 1):
        name, stage = P.STAGES[k]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == P.COLUMNS
        got = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert [(i, t or None) for i, t in sorted(got, key=order)] == [(i, t or None) for i, t in sorted(want, key=order)], name
    mixed = P.STAGES[4][1](spark, docs, sf)
    assert mixed.count() >= 1 and mixed.join(docs.select("text").distinct(), "text", "left_semi").count() == mixed.where("text is not null").count()
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
