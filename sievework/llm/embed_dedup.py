"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are rotated to their principal axes, strongest first, and cut into tiles
along the first. Pairs of tiles whose boxes in the leading axes are too far apart
are never formed. Within a pair of tiles the leading dimensions are accumulated
first; by Cauchy-Schwarz the rest adds at most the product of the norms of the
two suffixes, so a pair of vectors is given up as soon as that can't reach the
threshold. Only survivors see their remaining dimensions.

Equal vectors are one class with a multiplicity from the start. A pair of tiles
returns counts of links per class and a spanning forest of the links it found, at
most one edge per vector, so groups of near copies never become all their pairs.

Cosines near the threshold (1e-9) are recomputed in double precision from the
vectors as given. Vectors are brought to the size of 1 by powers of two first, which changes no
cosine, so neither huge nor tiny components are lost when squared.

What grows with the input on the driver is one box (17 numbers) a tile of ``TILE`` vectors.

Defined cases: a vector that is null, empty, zero, or has null or non-finite
components links with nothing; so does a row with a null id, whose component is
null; vectors of different lengths don't link; rows that occur twice, or share an id, are two
vectors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.graph import components
from sievework.llm.shared import Tables

TILE = 4096
ROWS_AT_ONCE = 1024
STEP = 16
BOX_DIMS = 8
NEAR = 1e-9
BROADCAST_RANGES = 100_000


def _matrix(column: pa.Array, d: int, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), d)


def _sized(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 1/2 or more, below 1."""
    _, power = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x.astype(np.float64), -power[:, None])


def _second_moments(unit: DataFrame, d: int) -> np.ndarray:
    """Sum of the outer products of all vectors; what reaches the driver has d * d numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _sized(_matrix(batch.column(0), d, np.float64))
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    sums = unit.select("v").mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    got = sums.toArrow().to_pydict()
    out = np.zeros((d, d))
    out[got["i"], got["j"]] = got["x"]
    return out


def link_tiles(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` that link, in parts; rotated unit vectors, and the vectors as given. ``same``: only pairs below the diagonal."""
    d = a.shape[1]
    ends = list(range(STEP, d, STEP)) + [d]
    tails_a = [np.sqrt(np.maximum(0, (a[:, e:] ** 2).sum(axis=1))) for e in ends]
    tails_b = [np.sqrt(np.maximum(0, (b[:, e:] ** 2).sum(axis=1))) for e in ends]
    least = threshold - NEAR
    for at in range(0, len(a), ROWS_AT_ONCE):
        part = a[at : at + ROWS_AT_ONCE]
        dots = part[:, : ends[0]] @ b[:, : ends[0]].T
        reach = np.outer(tails_a[0][at : at + ROWS_AT_ONCE], tails_b[0])
        reach += dots
        r, c = np.nonzero(reach >= least)
        if same:
            below = r + at > c
            r, c = r[below], c[below]
        if not len(r):
            continue
        if len(r) > dots.size // 8:  # dense: one product is cheaper than gathered rows
            dots = part @ b.T
            s = dots[r, c]
        else:
            s = dots[r, c]
            for k in range(1, len(ends)):
                lo, hi = ends[k - 1], ends[k]
                s = s + np.einsum("ij,ij->i", part[r, lo:hi], b[c, lo:hi])
                alive = s + tails_a[k][r + at] * tails_b[k][c] >= least
                r, c, s = r[alive], c[alive], s[alive]
        keep = s >= threshold + NEAR
        close = np.flatnonzero(~keep & (s >= least))
        if len(close):
            x, y = _sized(raw_a[r[close] + at]), _sized(raw_b[c[close]])
            exact = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            keep[close] = exact >= threshold
        if keep.any():
            yield r[keep] + at, c[keep]


class _Forest:
    """Smallest labels of the rows of two tiles that parts of links connect."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.label = ids, ids.copy()

    def add(self, r: np.ndarray, c: np.ndarray) -> None:
        label = self.label
        while True:
            low = np.minimum(label[r], label[c])
            before = label.copy()
            np.minimum.at(label, r, low)
            np.minimum.at(label, c, low)
            if (label == before).all():
                return


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    spark = vectors.sparkSession
    tables = Tables(spark, "embed-dedup")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    wide = dict(rows.dtypes)["v"] == "array<double>"
    rows = rows if wide else rows.withColumn("v", F.col("v").cast("array<float>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # a class has a number of its own, which stays as it is written
    classes = rows.where(usable).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("c", F.monotonically_increasing_id())
    classes = tables.write("classes", classes)
    degrees = edges = None
    for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect():
        found = _compare(spark, tables, classes.where(F.size("v") == r["d"]), r["d"], r["n"], wide, threshold)
        deg, edge = found.where("other is null").select("c", "n"), found.where("other is not null").select(F.col("c").alias("a"), F.col("other").alias("b"))
        degrees, edges = (deg, edge) if degrees is None else (degrees.unionAll(deg), edges.unionAll(edge))
    keyed = rows.withColumn("v", F.when(usable, F.col("v")))
    if degrees is None:
        per_class = classes.select("v", "c", F.lit(0).cast("bigint").alias("n"), F.col("id").alias("component"))
    else:
        labels = components(edges, tables).select(F.col("node").alias("c"), "component")
        counted = degrees.groupBy("c").agg(F.sum("n").alias("n"))
        parted = classes.join(counted, "c", "left").join(labels, "c", "left").withColumn("part", F.coalesce("component", "c")).drop("component")
        parted = tables.write("parted", parted)
        smallest = parted.groupBy("part").agg(F.min("id").alias("component"))
        per_class = parted.join(smallest, "part").select("v", "c", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    per_class = tables.write("per_class", per_class)
    return keyed.join(per_class, "v", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
    )


def _compare(spark, tables: Tables, classes: DataFrame, d: int, n: int, wide: bool, threshold: float) -> DataFrame:
    """Rows ``c, n, other``: links of class c with other classes (n, their copies counted), or an edge to ``other``."""
    dtype = np.float64 if wide else np.float32
    _, axes = np.linalg.eigh(_second_moments(classes, d))
    axes = np.ascontiguousarray(axes[:, ::-1])
    boxes_of = min(BOX_DIMS, d)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _sized(_matrix(batch.column(0), d, np.float64))
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            y = x @ axes
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(0), pa.array(list(y), pa.list_(pa.float64())), pa.array(y[:, 0])], names=["c", "copies", "v", "y", "p"]
            )

    kind = "array<double>" if wide else "array<float>"
    turned = tables.write(f"turned{d}", classes.select("v", "c", "copies").mapInArrow(rotate, f"c bigint, copies bigint, v {kind}, y array<double>, p double"))
    wanted = max(1, -(-n // TILE))
    cuts = np.array(turned.approxQuantile("p", [i / wanted for i in range(1, wanted)], 0.05 / wanted) if wanted > 1 else [])

    def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.searchsorted(cuts, batch.column(4).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(q) for q in range(4)), pa.array(k)], names=["c", "copies", "v", "y", "k"])

    # a range that many vectors share is cut further by a hash
    ranged = turned.mapInArrow(range_of, f"c bigint, copies bigint, v {kind}, y array<double>, k int")
    parts = ranged.groupBy("k").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (2 * TILE))).alias("parts"))
    parts = F.broadcast(parts) if wanted <= BROADCAST_RANGES else parts
    ranged = ranged.join(parts, "k").withColumn("sub", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        t = pa.Table.from_batches(got)
        if not len(t):
            return
        t = t.combine_chunks()
        y = _matrix(t["y"].combine_chunks(), d, np.float64)
        tail = np.sqrt(np.maximum(0, (y[:, boxes_of:] ** 2).sum(axis=1))).max()
        box = np.concatenate([y[:, :boxes_of].min(axis=0), y[:, :boxes_of].max(axis=0), [tail]])
        raw = _matrix(t["v"].combine_chunks(), d, dtype)
        values = [t["k"][0].as_py(), t["sub"][0].as_py(), t["c"].to_numpy().astype(np.int64).tobytes(), t["copies"].to_numpy().astype(np.int64).tobytes(), y.tobytes(), raw.tobytes(), list(box)]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([v], ty) for v, ty in zip(values, types, strict=True)], names=["k", "sub", "c", "copies", "y", "raw", "box"])

    packed = ranged.groupBy("k", "sub").applyInArrow(lambda t: pa.Table.from_batches(list(pack(iter(t.to_batches())))), "k int, sub int, c binary, copies binary, y binary, raw binary, box array<double>")
    tiles = tables.write(f"tiles{d}", packed)
    boxes = sorted((r["k"], r["sub"], np.array(r["box"])) for r in tiles.select("k", "sub", "box").collect())
    low, high, tails = (np.array([b[i:j] for _, _, b in boxes]) for i, j in ((0, boxes_of), (boxes_of, 2 * boxes_of), (2 * boxes_of, 2 * boxes_of + 1)))
    names = [(k, s) for k, s, _ in boxes]
    every = spark.sparkContext.broadcast((low, high, tails, names))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, tails, names = every.value
        for batch in batches:
            left, right = [], []
            for i in batch.column(0).to_pylist():
                most = np.maximum.reduce([low[i] * low[: i + 1], low[i] * high[: i + 1], high[i] * low[: i + 1], high[i] * high[: i + 1]]).sum(axis=1) + tails[i] * tails[: i + 1, 0]
                hit = np.flatnonzero(most >= threshold - NEAR)
                left += [i] * len(hit)
                right += hit.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([names[x][q] for x in side], pa.int32()) for side in (left, right) for q in (0, 1)], names=["k", "sub", "k2", "sub2"])

    pairs = spark.range(0, len(boxes), 1, min(len(boxes), 64)).mapInArrow(partners, "k int, sub int, k2 int, sub2 int")
    # the partners of a tile in slices, each of which gets the tile itself once
    pairs = tables.write(f"pairs{d}", pairs.withColumn("slice", F.pmod(F.hash("k2", "sub2"), F.lit(4))))
    block = ["c", "copies", "y", "raw"]
    own = pairs.select("k", "sub", "slice").distinct().join(tiles, ["k", "sub"]).select("k", "sub", "slice", F.lit(None).cast("int").alias("k2"), F.lit(None).cast("int").alias("sub2"), *block)
    others = pairs.join(tiles.select(F.col("k").alias("k2"), F.col("sub").alias("sub2"), *block), ["k2", "sub2"]).select("k", "sub", "slice", "k2", "sub2", *block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_key, mine = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(q)[i].as_py() for q in range(3))
                other = tuple(batch.column(q)[i].as_py() for q in (3, 4))
                ids, copies = (np.frombuffer(batch.column(q)[i].as_buffer(), np.int64) for q in (5, 6))
                y = np.frombuffer(batch.column(7)[i].as_buffer(), np.float64).reshape(-1, d)
                raw = np.frombuffer(batch.column(8)[i].as_buffer(), dtype).reshape(-1, d)
                if other[0] is None:
                    own_key, mine = key, (ids.copy(), copies.copy(), y.copy(), raw.copy())
                    continue
                if key != own_key:
                    raise RuntimeError("a tile's partners came without the tile")
                same = other == key[:2]
                m = len(mine[0])
                forest = _Forest(np.concatenate([mine[0], ids]))
                deg = np.zeros(m + len(ids), np.int64)
                for r, c in link_tiles(mine[2], y, mine[3], raw, threshold, same):
                    deg += np.bincount(r, weights=copies[c], minlength=len(deg)).astype(np.int64)
                    deg += np.bincount(c if same else c + m, weights=mine[1][r], minlength=len(deg)).astype(np.int64)
                    forest.add(r, c if same else c + m)
                at = np.flatnonzero(deg)
                moved = np.flatnonzero(forest.label != forest.ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([forest.ids[at], forest.ids[moved]])),
                        pa.array(np.concatenate([deg[at], np.zeros(len(moved), np.int64)])),
                        pa.array([None] * len(at) + forest.label[moved].tolist(), pa.int64()),
                    ],
                    names=["c", "n", "other"],
                )

    placed = own.unionAll(others).repartition("k", "sub", "slice").sortWithinPartitions("k", "sub", "slice", F.col("k2").asc_nulls_first(), "sub2")
    found = tables.write(f"found{d}", placed.mapInArrow(compare, "c bigint, n bigint, other bigint"))
    tables.drop(f"turned{d}", f"tiles{d}", f"pairs{d}")
    return found
