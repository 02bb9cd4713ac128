"""Manifest, centroids and exact copies against plain loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sievework.llm import centroids, exact_dedup, merkle
from sievework.llm import queries as Q

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "g", "name", "digest", "pos", "path", "shift", "c", "n", "__h", "__n", "__id", "v", "x", "h", "lo"]
AWKWARD = [
    (1, None, None, None, None), (2, "", "", "", 0), (3, "é ß", "de", None, 3), (3, "é ß", "de", None, 3), (3, "É ß", "de", None, 3), (4, "ABC", "en", "s", 3),
    (5, "abc", "en", "s", 3), (None, "Abc", "en", "s", 3), (None, "alone", None, None, None), (None, "alone", None, None, None), (6, "x" * 200_000, "ä", "s", 1), (7, "X" * 200_000, "z", "s", 1), (-8, "", "z", "s", 1),
]


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in CLASH})


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def low(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


# -- exact copies ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("route", ["broadcast", "shuffled", "collisions", "collisions shuffled"])
def test_exact_groups(spark, monkeypatch, keep, route):
    rows = AWKWARD + [(100 + k, "hot copy", "en", "s", 8) for k in range(40)] + [(200 + k, f"text {k % 25}", "en", "s", 8) for k in range(60)]
    if "shuffled" in route:
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
        monkeypatch.setattr(exact_dedup, "HEAVY_ROWS", 30)
        monkeypatch.setattr(exact_dedup, "HEAVY_KEYS", 4)
    df = clashing(spark.createDataFrame(rows, DOC)).repartition(5)
    weak = {"hash_of": lambda s: F.unhex(F.substring(s, 1, 2))} if "collisions" in route else {}
    got = exact_dedup.exact_groups(df, keep=keep, carry=["text", "id"], **weak).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1] or "")].append(r[0])
    assert len(got) == len(rows)
    stays = defaultdict(list)
    for r in got:
        t = low(r["text"] or "")
        ids = [i for i in groups[t] if i is not None]
        best = (min if keep == "smallest" else max)(ids) if ids else None
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == (best, len(groups[t]), sha(t))
        if r["kept"]:
            stays[t].append(r["doc_id"])
            assert r["doc_id"] == best
    assert set(stays) == set(groups) and all(len(x) == 1 for x in stays.values())


def test_exact_groups_of_nothing(spark):
    empty = spark.createDataFrame([], DOC)
    assert exact_dedup.exact_groups(empty).count() == 0
    got = exact_dedup.exact_groups(spark.createDataFrame([(None, None, None, None, None)], DOC)).collect()
    assert [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got] == [(None, None, 1, True)]
    text_ids = spark.createDataFrame([("b", "t"), ("a", "T"), (None, "t")], "doc_id string, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(text_ids).collect()} == {("b", "a", False), ("a", "a", True), (None, "a", False)}


# -- manifest -------------------------------------------------------------------------------------------------


def plain_manifest(rows, columns):
    """``(leaf, lang) -> set of (subroot, root, siblings)`` by whole trees."""

    def spelled(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves):
        layers = [leaves]
        while len(layers[-1]) > 1:
            layers.append([sha("".join(layers[-1][i : i + 8])) for i in range(0, len(layers[-1]), 8)])
        return layers

    def path(layers, i):
        out = []
        for layer in layers[:-1]:
            run = i // 8 * 8
            out += [layer[j] for j in range(run, min(run + 8, len(layer))) if j != i]
            i //= 8
        return out

    by = defaultdict(list)
    for r in rows:
        leaf = sha("".join(spelled(r[c]) for c in columns))
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([leaf for *_, leaf in sorted(by[x])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    return [
        (leaf, trees[x][-1][0], top[-1][0], sha("".join(path(trees[x], i) + path(top, k))))
        for k, x in enumerate(langs)
        for i, leaf in enumerate(trees[x][0])
    ]


@pytest.mark.parametrize(("n", "levels", "langs"), [(1, 4, 1), (9, 4, 2), (150, 1, 12), (5000, 2, 3), (4600, 4, 1)])
def test_manifest_by_plain_trees(spark, n, levels, langs):
    rng = random.Random(n)
    rows = [(rng.randrange(n * 2), f"Text {rng.randrange(n)}", f"l{min(rng.randrange(langs), rng.randrange(langs))}", "s", k % 7) for k in range(n)]
    rows += AWKWARD if n > 1 else []
    df = clashing(spark.createDataFrame(rows, DOC).repartition(4))
    found = merkle.verify(merkle.manifest(df, Q.MANIFEST_COLUMNS, levels=levels)).collect()
    names = [x.split()[0] for x in DOC.split(", ")]
    plain = plain_manifest([dict(zip(names, r, strict=True)) for r in rows], Q.MANIFEST_COLUMNS)
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in found) == sorted(plain)
    assert all(r["folded_root"] == r["root"] for r in found)


def test_manifest_notices_changes(spark):
    got = Q.op11_merkle(spark, DATA)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and low(texts[r["doc_id"]]) != texts[r["doc_id"]]
        assert r["verified"] == (not changed)
    assert {r["verified"] for r in rows} == {True, False}
    assert merkle.verify(merkle.manifest(spark.createDataFrame([], DOC), Q.MANIFEST_COLUMNS)).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3, 5])
def test_fractal_traversal(levels):
    for n in {1, 2, 8, 9, 63, 64, 65, 600, 8**levels}:
        if n > min(8**levels, 5000):
            continue
        leaves = [sha(str(k)).encode() for k in range(n)]
        root = merkle.block_root(leaves, levels)
        whole = merkle.Subtree(levels)
        for x in leaves:
            whole.add(x)
        whole.end()
        paths = list(merkle.authentication_paths(leaves, levels))
        assert len(paths) == n
        for i, path in enumerate(paths):
            assert merkle.folded(leaves[i], path)[0] == root
            steps = list(merkle.siblings(path))
            assert [k for k, _ in steps] == [i // 8**h % 8 for h in range(levels)]
            for h, (_, others) in enumerate(steps):
                run = whole.rows[h][i // 8 ** (h + 1) * 8 :][:8]
                assert others == [x for j, x in enumerate(run) if j != i // 8**h % 8]


# -- centroids ------------------------------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))[:k]
    cs = [x for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        near = [nearest(x)[1] for _, x in kept]
        for j in range(len(cs)):
            mine = [x for (_, x), n in zip(kept, near, strict=True) if n == j]
            if mine:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = defaultdict(int)
    for _, j, d in out:
        inertia[j] += d
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), sha(",".join(map(str, cs[j])))) for i, j, d in out)


def vectors(spark, rows, kind="float"):
    return clashing(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).repartition(3)


@pytest.mark.parametrize("kind", ["clustered", "random", "copies", "large", "few"])
def test_clusters_by_plain_loops(spark, kind):
    rng = np.random.default_rng(5)
    n = 5 if kind == "few" else 700
    x = rng.normal(size=(n, 64))
    if kind == "clustered":
        x = x / 50 + rng.normal(size=(12, 64))[rng.integers(0, 12, n)]
    if kind == "copies":
        x[: n // 3] = x[0]
        x = np.round(x)
    if kind == "large":
        x *= 5000  # products beyond what doubles hold exactly
    rows = [(int(k), [float(y) for y in v]) for k, v in enumerate(x)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (9001, None), (9002, []), (9003, [1.0] * 63), (9004, [1.0] * 65), (9005, [None] + [1.0] * 63), (9006, [float("nan")] * 64), (9007, [float("inf")] * 64)]
    got = centroids.cluster_vectors(vectors(spark, rows, "double")).collect()
    assert sorted((str(r["vec_id"]), *r[1:]) for r in got) == plain_clusters(rows)


def test_clusters_of_nothing_and_too_large(spark):
    assert centroids.cluster_vectors(vectors(spark, [(1, None)])).count() == 0
    with pytest.raises(Exception, match="a component reaches"):
        centroids.cluster_vectors(vectors(spark, [(1, [1e9] * 64)], "double")).collect()


def test_balls_bound_their_rows():
    rng = np.random.default_rng(1)
    around = rng.integers(-900, 900, (6, 64))
    x = rng.integers(-50, 50, (999, 64)) + around[rng.integers(0, 6, 999)]
    order, nodes = centroids.build_tree(x)
    assert sorted(order) == list(range(999))
    x = x[order]
    for lo, hi, c, r2, total, n in zip(*(nodes[k] for k in ("lo", "hi", "centre", "radius2", "total", "count")), strict=True):
        assert n == hi - lo and (x[lo:hi].sum(axis=0) == total).all() and (((x[lo:hi] - c) ** 2).sum(axis=1) <= r2).all()
    count, total, compared = centroids._sums(x, nodes, x[:8])
    label, _ = centroids._labels(x, nodes, x[:8])
    assert (np.bincount(label, minlength=8) == count).all() and (total[label[0]] == x[label == label[0]].sum(axis=0)).all()
    # groups far apart: whole balls are assigned, few vectors are compared
    assert centroids._sums(x, nodes, around)[2] < 400


@pytest.mark.parametrize("name", ["op11_merkle", "op12_centroids", "op13_exact_dedup"])
def test_new_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    cur = con.execute(Q.oracle_sql()[name])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
