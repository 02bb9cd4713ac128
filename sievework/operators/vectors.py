"""Cosine search within groups, and greedy deduplication of vectors."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.cells import CellIndex
from sievework.sources.shared import shared_dir, written


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of double; 0 for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


#: Queries that are looked at together at most, and vectors of a task (of all groups, before they are dealt by group).
BROADCAST_QUERIES = 20_000
PART_ROWS = 32_768
MOST_SLICES = 4096


def nearest_within(vectors: DataFrame, queries: DataFrame, group: str, key: str, qid: str, most: int) -> DataFrame:
    """``qid, rank, key, sim``: of each query (column ``q``) the nearest vectors (column ``v``) of its group, itself left out.

    A group's vectors are dealt into parts and its queries into slices; a task compares a part with a slice by matrix products and
    passes on the best ``most`` of each query. Vectors that can't be compared (null, or of another length) have no cosine and come last.
    """
    parts, slices = (-(-df.count() // rows) or 1 for df, rows in ((vectors, PART_ROWS), (queries, max(1, BROADCAST_QUERIES))))
    slices = min(slices, MOST_SLICES)
    column = lambda c: F.col(c).cast("array<double>")
    kinds = dict(vectors.dtypes)[key], dict(queries.dtypes)[qid]
    mine = vectors.where(F.col(group).isNotNull()).select(group, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.col(key).alias("key"), column("v").alias("v"))
    asked = queries.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.pmod(F.xxhash64(qid), F.lit(slices)).cast("int").alias("s"), F.col(qid).alias("qid"), column("q").alias("q"))
    met = asked.groupBy("g", "p", "s").cogroup(mine.groupBy(group, "part", "slice")).applyInArrow(_nearest(most), f"qid {kinds[1]}, key {kinds[0]}, s double")
    scored = met.select(F.col("qid").alias(qid), F.col("key").alias(key), F.round("s", 4).alias("sim"))
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("sim"), key))
    return scored.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= most)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Where the arrays of each length without nulls are, and these as rows."""
    length = pc.list_value_length(column).fill_null(-1).to_numpy()
    out = {}
    for d in set(length[length >= 0].tolist()):
        at = np.flatnonzero(length == d)
        flat = column.take(pa.array(at)).combine_chunks().flatten()
        if flat.null_count:
            whole = ~np.any(flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), d), axis=1)
            at, flat = at[whole], flat.filter(pa.array(np.repeat(whole, d)))
        out[d] = at, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
    return out


def _nearest(most: int):
    def best(asked: pa.Table, mine: pa.Table) -> pa.Table:
        mine = mine.sort_by("key")
        key, qid = mine["key"].to_numpy(), asked["qid"].to_numpy()
        out: list[tuple] = [(qid[:0], key[:0], np.empty(0))]
        vectors, left = _by_length(mine["v"]), np.ones(len(qid), bool)
        few = min(most, len(key))
        for d, (rows, x) in _by_length(asked["q"]).items() if few else ():
            left[rows] = False
            at, y = vectors.get(d, (np.empty(0, np.int64), np.empty((0, d))))
            others = np.setdiff1d(np.arange(len(key)), at)[: most + 1]  # without a cosine: the first by key
            with np.errstate(all="ignore"):
                nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
                for a in range(0, len(x), 256):
                    sim = x[a : a + 256] @ y.T / (nx[a : a + 256, None] * ny)
                    sim[(nx[a : a + 256] == 0)[:, None] | (ny == 0)] = 0.0
                    # rounded, then the key: keys ascend; what is no number comes first, as in an order by Spark
                    scaled = np.sign(sim) * np.floor(np.abs(sim) * 1e4 + 0.5 + 1e-9)
                    place = np.where(np.isnan(sim), 20_000, scaled).astype(np.int64) * max(1, len(at)) - np.arange(len(at))
                    q = qid[rows[a : a + 256]]
                    own = q[:, None] == key[at]
                    place[own] = np.iinfo(np.int64).min
                    n = min(most, len(at))
                    edge = np.partition(place, len(at) - n, axis=1)[:, len(at) - n, None] if n else np.empty((len(q), 1), np.int64)
                    r, c = np.nonzero((place >= edge) & ~own)
                    out.append((q[r], key[at[c]], sim[r, c]))
            _without(out, qid[rows], key[others])
        _without(out, qid[left], key[: most + 1])
        q, k, s = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"qid": pa.array(q, asked.schema.field("qid").type), "key": pa.array(k, mine.schema.field("key").type), "s": pa.array(s, mask=np.isneginf(s))})

    return best


def _without(out: list[tuple], qid: np.ndarray, key: np.ndarray) -> None:
    """Pairs without a cosine (minus infinity until they are written)."""
    q, k = np.repeat(qid, len(key)), np.tile(key, len(qid))
    out.append((q[q != k], k[q != k], np.full(int((q != k).sum()), -np.inf)))


def greedy_independent(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """The nodes that a greedy pass in order of the key keeps: those without an edge to a smaller kept one.

    A round looks at the edges between nodes that are still open: who has no smaller open neighbour is kept, and its
    larger neighbours go, with all their edges. Edges become fewer each round; a long chain of alternating nodes needs a round each two nodes.
    """
    folder = f"{shared_dir(nodes.sparkSession)}/greedy-{uuid.uuid4().hex}"
    live, gone, at = written(edges.select("a", "b"), f"{folder}/0"), None, 0
    while live.limit(1).count():
        at += 1
        held = live.select(F.col("b").alias("a")).distinct()
        lost = written(live.join(held, "a", "left_anti").select(F.col("b").alias("n")).distinct(), f"{folder}/lost{at}")
        rest = live.join(lost.withColumnRenamed("n", "a"), "a", "left_anti").join(lost.withColumnRenamed("n", "b"), "b", "left_anti")
        live = written(rest.select("a", "b"), f"{folder}/{at}")
        gone = lost if gone is None else gone.unionAll(lost)
    every = nodes.select(F.col(key).alias("n"))
    return (every if gone is None else every.join(gone, "n", "left_anti")).withColumnRenamed("n", key)


def semantic_dedup(vectors: DataFrame, key: str, vec: str, threshold: float) -> DataFrame:
    """The keys of vectors that stay: those without a cosine of ``threshold`` (above 0) with an earlier one that stays.

    Equal vectors are one from the start: whatever drops or keeps the first of them drops the others. So a large group of copies makes no pairs.
    Null and zero vectors are similar to nothing and stay.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("k"), F.col(vec).cast("array<double>").alias("v"))
    some = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    folder = f"{shared_dir(vectors.sparkSession)}/semantic-{uuid.uuid4().hex}"
    first = written(rows.where(some).groupBy("v").agg(F.min("k").alias("k")), folder)
    kept = greedy_independent(first, CellIndex(first, "k", "v").similar_pairs(threshold), "k")
    return kept.select(F.col("k").alias(key)).unionByName(rows.where(~some).select(F.col("k").alias(key)))
