"""Centroid clustering (Lloyd rounds) over integer vectors, filtered by partition-local ball trees.

Vectors become integers, so distances, sums and means are exact and no result depends on the order of rows. Each
partition packs its vectors into trees of at most ``TREE_ROWS``, once: a node is a ball with an integer centre, the
squared radius, the count and the componentwise sum of its vectors. Trees are written as a table, one row each.

A round sends the centroids (k vectors) to the trees. A ball keeps the centroids that may be nearest to one of its
vectors: by the triangle inequality no other can be, if it is farther from the centre than the nearest by more than two
radii. A ball with one centroid left is assigned whole, by its count and sum; otherwise its halves are tried, down to
leaves, where distances are computed. What leaves a task is one count and sum a cluster.

Bounds are taken with a margin and may only keep a centroid too many; distances that decide are integers.

Defined cases: vectors of another length, null, or with null or non-finite components are left out; rows that occur twice or
share an id are two vectors; rows with a null id are clustered, but start no cluster while there are others; with fewer vectors than
clusters there are as many clusters as vectors; no vectors give an empty result; a scaled component of 2**27 or more
would not leave distances within 64 bits, and is refused; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import Tables

TREE_ROWS = 4096
LEAF_ROWS = 32
#: Components of this size and more are refused; below the second bound all products are exact in doubles.
LARGEST = 1 << 27
EXACT_IN_DOUBLE = 1 << 22


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, rows by rows."""
    if max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) < EXACT_IN_DOUBLE:
        a, b = x.astype(np.float64), centres.astype(np.float64)
        out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
        return out.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)


def build_tree(x: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the rows of ``x`` and the tree's nodes, parents first: children are ``2 i + 1`` and ``2 i + 2`` of a whole binary tree.

    A node is cut at the median of its rows' projections on the line between two far rows, so both
    halves differ by one row at most, also where all rows are equal.
    """
    levels = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
    order = np.arange(len(x))
    spans = [(0, len(x))]
    for level in range(levels):
        first = (1 << level) - 1
        for lo, hi in spans[first:]:
            mine = order[lo:hi]
            part = x[mine].astype(np.float64)
            far = part[np.argmax(((part - part.mean(axis=0)) ** 2).sum(axis=1))]
            other = part[np.argmax(((part - far) ** 2).sum(axis=1))]
            half = (hi - lo) // 2
            if not half:  # too few rows to cut: an empty ball and the row
                spans += [(lo, lo), (lo, hi)]
                continue
            order[lo:hi] = mine[np.argpartition(part @ (other - far), half)]
            spans += [(lo, lo + half), (lo + half, hi)]
    spans = np.array(spans)
    sums = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[order], axis=0)])
    total = sums[spans[:, 1]] - sums[spans[:, 0]]
    count = spans[:, 1] - spans[:, 0]
    centre = total // np.maximum(count, 1)[:, None]
    radius2 = np.array([((x[order[lo:hi]] - c) ** 2).sum(axis=1).max(initial=0) for (lo, hi), c in zip(spans, centre, strict=True)], np.int64)
    return order, {"lo": spans[:, 0], "hi": spans[:, 1], "centre": centre, "radius2": radius2, "total": total, "count": count}


def filter_tree(x: np.ndarray, nodes: dict[str, np.ndarray], centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Balls assigned whole (node, cluster) by the triangle inequality, then leaves that have to be compared (node, -1)."""
    far = np.sqrt(squared_distances(nodes["centre"], centres).astype(np.float64))
    reach = np.sqrt(nodes["radius2"].astype(np.float64))
    nearest = far.argmin(axis=1)
    # a centroid farther than this can't be nearest to any vector of the ball
    bound = (far[np.arange(len(far)), nearest] + 2 * reach) * (1 + 1e-9) + 1e-6
    sole = (far <= bound[:, None]).sum(axis=1) == 1
    live = np.zeros(1, np.int64)
    while len(live):
        live = live[nodes["count"][live] > 0]
        whole = sole[live]
        yield live[whole], nearest[live[whole]]
        rest = live[~whole]
        leaves = 2 * rest + 1 >= len(far)
        yield rest[leaves], np.full(leaves.sum(), -1)
        live = np.concatenate([2 * rest[~leaves] + 1, 2 * rest[~leaves] + 2])


def _rows_of(nodes: dict[str, np.ndarray], some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(0, np.int64)
    return np.concatenate([np.arange(nodes["lo"][i], nodes["hi"][i]) for i in some])


def _sums(x: np.ndarray, nodes: dict[str, np.ndarray], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Count and sum of each cluster over one tree, and how many vectors were compared."""
    count, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
    compared = 0
    for some, cluster in filter_tree(x, nodes, centres):
        if len(some) and cluster[0] >= 0:
            np.add.at(count, cluster, nodes["count"][some])
            np.add.at(total, cluster, nodes["total"][some])
        elif len(some):
            at = _rows_of(nodes, some)
            near = squared_distances(x[at], centres).argmin(axis=1)
            compared += len(at)
            count += np.bincount(near, minlength=len(count))
            np.add.at(total, near, x[at])
    return count, total, compared


def _labels(x: np.ndarray, nodes: dict[str, np.ndarray], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector of one tree."""
    label, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    for some, cluster in filter_tree(x, nodes, centres):
        if len(some) and cluster[0] >= 0:
            for i, c in zip(some, cluster, strict=True):
                lo, hi = nodes["lo"][i], nodes["hi"][i]
                label[lo:hi], distance[lo:hi] = c, squared_distances(x[lo:hi], centres[c : c + 1])[:, 0]
        elif len(some):
            at = _rows_of(nodes, some)
            d = squared_distances(x[at], centres)
            label[at] = d.argmin(axis=1)
            distance[at] = d.min(axis=1)
    return label, distance


_TREE = "ids array<bigint>, x binary, lo binary, hi binary, centre binary, radius2 binary, total binary"


def _read_trees(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    for batch in batches:
        for row in range(batch.num_rows):
            raw = {n: np.frombuffer(batch.column(n)[row].as_buffer(), np.int64) for n in ("lo", "hi", "centre", "radius2", "total")}
            x = np.frombuffer(batch.column("x")[row].as_buffer(), np.int32).reshape(-1, d).astype(np.int64)
            nodes = raw | {"centre": raw["centre"].reshape(-1, d), "total": raw["total"].reshape(-1, d), "count": raw["hi"] - raw["lo"]}
            yield batch.column("ids")[row].values, x, nodes


def _trees(kept: DataFrame, d: int) -> DataFrame:
    """One row per tree over ``id, x`` (integer components), built where the rows lie: no shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = t["x"].combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, d)
            order, nodes = build_tree(x)
            ids = t["id"].combine_chunks().take(pa.array(order))
            values = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x[order].astype(np.int32).tobytes()], pa.binary())]
            values += [pa.array([nodes[n].astype(np.int64).tobytes()], pa.binary()) for n in ("lo", "hi", "centre", "radius2", "total")]
            return pa.RecordBatch.from_arrays(values, names=["ids", "x", "lo", "hi", "centre", "radius2", "total"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, TREE_ROWS - rows)
                held.append(part)
                at, rows = at + part.num_rows, rows + part.num_rows
                if rows == TREE_ROWS:
                    yield close()
                    held, rows = [], 0
        if rows:
            yield close()

    return kept.mapInArrow(pack, _TREE)


def _moved(tables: Tables, trees: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after one round: k counts and sums reach the driver, pre-aggregated in each task."""
    d = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, compared = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64), 0
        for _, x, nodes in _read_trees(batches, d):
            n, s, c = _sums(x, nodes, centres)
            count, total, compared = count + n, total + s, compared + c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres)), pa.int32()), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))], names=["c", "n", "s"])

    each = trees.mapInArrow(run, "c int, n bigint, s array<bigint>").select("c", "n", F.posexplode("s").alias("j", "s"))
    sums = each.groupBy("c", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")
    out = centres.copy()
    for r in tables.collect(sums):
        out[r["c"], r["j"]] = r["s"] // r["n"]
    return out


def cluster_vectors(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 1024, seed: int = 3
) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each vector of ``dims`` finite components."""
    spark = vectors.sparkSession
    tables = Tables(spark, "centroids")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == dims) & F.coalesce(finite, F.lit(False)))

    def whole(x):  # a component too large is refused, not cut
        scaled = F.floor(x * scale)
        return F.when(F.abs(x * scale) < LARGEST, scaled.cast("int")).otherwise(F.raise_error(F.lit(f"a component reaches {LARGEST} when scaled by {scale}")).cast("int"))

    kept = rows.select("id", F.transform("v", whole).alias("x"))
    start = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters)
    trees = tables.write("trees", _trees(kept, dims))
    centres = np.array([r["x"] for r in start.collect()], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centres) else 0):
        after = _moved(tables, trees, centres)
        if (after == centres).all():
            break
        centres = after
    final = centres

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, nodes in _read_trees(batches, dims):
            cluster, distance = _labels(x, nodes, final)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    labelled = tables.write("labelled", trees.mapInArrow(label, "id bigint, cluster int, distance bigint"))
    tables.drop("trees")
    within = {r["cluster"]: r["d"] for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    known = spark.createDataFrame([(k, within.get(k, 0), sha) for k, sha in enumerate(shas)], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return labelled.join(F.broadcast(known), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(sum(within.values())).cast("bigint").alias("inertia"), "centroid_sha256"
    )
