"""A cell index over vectors: exact nearest vectors of many queries, and exact similar pairs, without comparing all with all.

Centres are fitted on a bounded sample (``SAMPLE`` vectors, taken by a hash); every vector is then put into the cell of its nearest
centre, and a cell is stored in tiles with the least and largest distance of its vectors from the centre. For unit vectors
a cosine is a distance, so by the triangle inequality a query's distance from a centre bounds its cosine with each
vector of the cell. Cells whose bound is too low are left out; all others are compared in full, in double precision, by matrix products.

Nearest vectors: cells are tried from the best bound on until they hold enough vectors; the last of these is what other cells
must be able to reach. Similar pairs: tiles meet if their cells' bounds allow the threshold.

A zero vector has cosine 0 with everything; zero vectors have a cell of their own (-1). Vectors must have one length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators import ranking
from sievework.sources.shared import shared_dir, written

CELL_ROWS = 512
MOST_CELLS = 4096
SAMPLE = 16_384
TILE = 2048
#: Queries that meet one tile in one task.
SLICE = 2048
#: For pairs, tiles are dealt into so many groups; a group has that many vectors at least, and not more than so many bytes of them.
GROUPS, GROUP_ROWS, GROUP_BYTES = 24, 8192, 128 << 20
#: What rounding may take from a distance.
SLACK = 1e-7


def unit_rows(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)
    largest = np.abs(x).max(axis=1, initial=0)[:, None]
    x = x / np.where(largest > 0, largest, 1)
    norm = np.sqrt((x * x).sum(axis=1))[:, None]
    return x / np.where(norm > 0, norm, 1)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of rows from rows; both unit vectors (or zero)."""
    out = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(out, 0))


def cosine_bound(d: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The largest cosine of a unit vector at distance ``d`` of a centre with a unit vector at a distance between ``near`` and ``far`` of it."""
    gap = np.maximum(np.maximum(d - far, near - d) - SLACK, 0)
    return 1 - gap * gap / 2


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 3) -> np.ndarray:
    """Unit centres by a few spherical rounds over a bounded sample; the first ``cells`` rows start."""
    centres = sample[:cells]
    for _ in range(rounds if len(sample) > cells else 0):
        near = np.concatenate([(sample[i : i + 2048] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 2048)])
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(axis=1))[:, None]
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


class CellIndex:
    """Over ``vectors`` (columns ``key``: a number, ``vec``: an array of numbers)."""

    def __init__(self, vectors: DataFrame, key: str, vec: str, cell_rows: int = CELL_ROWS) -> None:
        self.spark = vectors.sparkSession
        self.path = f"{shared_dir(self.spark)}/cells-{uuid.uuid4().hex}"
        rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
        shape = rows.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
        self.n, self.d = shape["n"], shape["hi"] or 0
        if self.n and shape["lo"] != shape["hi"]:
            raise ValueError("vectors must have the same length")
        cells = max(1, min(MOST_CELLS, -(-self.n // cell_rows)))
        order = F.xxhash64("key", "v")
        some = rows.where(F.exists("v", lambda x: x != 0)).orderBy(order).limit(min(SAMPLE, 4 * cells)).select("v").toArrow()
        sample = unit_rows(some["v"].combine_chunks(), self.d) if len(some) else np.zeros((1, self.d))
        self.centres = fit_centres(sample, min(cells, len(sample)))
        self.tiles = written(self._tiles(rows), f"{self.path}/tiles")
        # one line a tile without its vectors: the bounds of its cell
        info = self.tiles.groupBy("cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"), F.count("*").alias("parts"))
        self.info = sorted((r["cell"], r["n"], r["near"], r["far"], r["parts"]) for r in info.collect())  # MOST_CELLS lines at most

    def _tiles(self, rows: DataFrame) -> DataFrame:
        d, centres = self.d, self.centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = unit_rows(part.column("v"), d)
                    far = distances(x, centres)
                    cell = np.where(x.any(axis=1), far.argmin(axis=1), -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(list(x), pa.list_(pa.float64())), pa.array(cell), pa.array(far.min(axis=1))], names=["key", "x", "cell", "r"])

        placed = written(rows.mapInArrow(assign, "key bigint, x array<double>, cell int, r double"), f"{self.path}/placed")
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("parts"))  # MOST_CELLS rows at most
        spread = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("key", "x"), "parts").cast("int"))

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by("key").combine_chunks()
            x = t["x"].combine_chunks().flatten().to_numpy()
            r = t["r"].to_numpy()
            values = [[t["cell"][0].as_py()], [t["part"][0].as_py()], [len(t)], [r.min()], [r.max()], [t["key"].to_numpy().tobytes()], [x.tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["cell", "part", "n", "near", "far", "keys", "x"])

        # equal vectors with equal keys can't be told apart by a hash; a tile then is as large as they are many
        return spread.groupBy("cell", "part").applyInArrow(pack, "cell int, part int, n bigint, near double, far double, keys binary, x binary")

    def _bounds(self) -> tuple[np.ndarray, ...]:
        cell, n, near, far, parts = (np.array([i[k] for i in self.info]) for k in range(5))
        return cell.astype(np.int64), n.astype(np.int64), near.astype(float), far.astype(float), parts.astype(np.int64)

    def nearest(self, queries: DataFrame, qid: str, vec: str, most: int, digits: int = 4, report: bool = False) -> DataFrame:
        """``qid, rank, key, sim``: the ``most`` nearest vectors of each query but the one whose key is the query's (ties by key). ``report``: ``qid, vectors`` compared instead."""
        asked = queries.select(F.col(qid).cast("bigint").alias("qid"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
        asked = written(asked, f"{self.path}/asked-{uuid.uuid4().hex}")
        d, cell, n = self.d, *self._bounds()[:2]
        reach_of = self._reach_function()

        def choose(first: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(0, batch.num_rows, 512):
                        part = batch.slice(at, 512)
                        x = unit_rows(part.column("v"), d)
                        bound = reach_of(x)
                        order = np.argsort(-bound, axis=1, kind="stable")
                        held = np.cumsum(n[order], axis=1) - n[order]  # vectors in the cells before
                        begin = np.empty(bound.shape, bool)
                        np.put_along_axis(begin, order, held < most + 1, axis=1)
                        wanted = begin if first else ~begin & (bound >= part.column("least").to_numpy(zero_copy_only=False)[:, None])
                        r, c = np.nonzero(wanted)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("qid").take(pa.array(r)), pa.array(list(x), pa.list_(pa.float64())).take(pa.array(r)), pa.array(cell[c].astype(np.int32))], names=["qid", "x", "cell"]
                        )

            return run

        kinds = "qid bigint, x array<double>, cell int"
        slices = max(1, -(-asked.count() // SLICE))
        begun = written(self._best(asked.mapInArrow(choose(True), kinds), slices, most, digits), f"{self.path}/begun-{uuid.uuid4().hex}")
        nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim")))
        last = begun.where("key is not null").withColumn("nth", nth).where(F.col("nth") == most).select("qid", (F.col("sim") - 2 * 10.0**-digits).alias("least"))
        rest = asked.join(last, "qid", "left").select("qid", "v", F.coalesce("least", F.lit(-2.0)).alias("least"))
        more = self._best(rest.mapInArrow(choose(False), kinds), slices, most, digits)
        both = begun.unionByName(more)
        if report:
            return both.where("key is null").groupBy("qid").agg(F.sum("sim").cast("bigint").alias("vectors"))
        return ranking.top_of_query(both.where("key is not null").select("qid", "key", F.col("sim").alias("score")), "qid", "key", most, digits).select(F.col("qid").alias(qid), "rank", "key", F.col("score").alias("sim"))

    def _reach_function(self):
        """``_reach`` for tasks, which get the numbers and not the index."""
        cell, _, near, far, _ = self._bounds()
        centres = self.centres[np.maximum(cell, 0)]

        def reach(x: np.ndarray) -> np.ndarray:
            out = cosine_bound(distances(x, centres), near, far)
            return np.where(x.any(axis=1)[:, None] & (cell >= 0), out, 0.0)

        return reach

    def _best(self, wanted: DataFrame, slices: int, most: int, digits: int) -> DataFrame:
        """``qid, key, sim`` of the best of each wanted tile (``qid, x, cell``), and a line with a null key that says how many were compared."""
        parts = self.tiles.select("cell", "part")
        met = wanted.withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int")).join(F.broadcast(parts) if len(self.info) < ranking.BROADCAST_TERMS else parts, "cell")
        keys = ["cell", "part", "slice"]
        shown = met.select(*keys).distinct().join(self.tiles, ["cell", "part"])
        d = self.d

        def best(queries: pa.Table, tile: pa.Table) -> pa.Table:
            qid = queries["qid"].to_numpy()
            key = np.frombuffer(tile["keys"][0].as_buffer(), np.int64)
            y = np.frombuffer(tile["x"][0].as_buffer(), np.float64).reshape(-1, d)
            x = queries["x"].combine_chunks().flatten().to_numpy().reshape(-1, d)
            out: list[tuple] = [(qid, np.full(len(qid), -1), np.full(len(qid), float(len(key))), np.zeros(len(qid), bool))]
            for at in range(0, len(x), 512):
                sim = x[at : at + 512] @ y.T
                # rounded cosines, then the key: keys ascend in a tile
                place = np.rint(sim * 10.0**digits).astype(np.int64) * len(key) - np.arange(len(key))
                own = qid[at : at + 512, None] == key
                place[own] = np.iinfo(np.int64).min
                few = min(most, len(key))
                edge = np.partition(place, len(key) - few, axis=1)[:, len(key) - few, None]
                r, c = np.nonzero((place >= edge) & ~own)
                out.append((qid[at : at + 512][r], key[c], sim[r, c], np.ones(len(r), bool)))
            q, k, s, real = (np.concatenate(z) for z in zip(*out, strict=True))
            return pa.table({"qid": q, "key": pa.array(k, pa.int64(), mask=~real), "sim": s})

        shown = shown.select(*(F.col(k).alias(f"{k}_") for k in keys), "keys", "x")
        return met.groupBy(*keys).cogroup(shown.groupBy(*(f"{k}_" for k in keys))).applyInArrow(best, "qid bigint, key bigint, sim double")

    def _allowed_function(self, threshold: float):
        """For tasks: whether a cell's bounds (by its place in ``info``) allow the threshold with each of all cells."""
        cell, _, _, far, _ = self._bounds()
        centres = self.centres[np.maximum(cell, 0)]

        def allowed(i: int) -> np.ndarray:
            gap = np.maximum(distances(centres[i : i + 1], centres)[0] - far[i] - far - 2 * SLACK, 0)
            return np.where((cell[i] >= 0) & (cell >= 0), 1 - gap * gap / 2, 0.0) >= threshold - 1e-9

        return allowed

    def tile_pairs(self, threshold: float) -> DataFrame:
        """``cell, part, cell2, part2, hit``: pairs of tiles, and whether their cells' bounds allow the threshold."""
        cell, _, _, _, parts = self._bounds()
        allowed = self._allowed_function(threshold)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    hit = allowed(i)[: i + 1]
                    k = i + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, cell[i], np.int32)), pa.array(np.full(k, parts[i], np.int32)), pa.array(cell[:k].astype(np.int32)), pa.array(parts[:k].astype(np.int32)), pa.array(hit)],
                        names=["cell", "parts", "cell2", "parts2", "hit"],
                    )

        count = len(self.info)
        tasks = min(count, 2 * self.spark.sparkContext.defaultParallelism) or 1
        # cells have few or many partners by their place: dealt round robin
        numbers = self.spark.range(count).repartition(tasks)
        each = numbers.mapInArrow(pairs, "cell int, parts int, cell2 int, parts2 int, hit boolean")
        numbered = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
        return numbered.where("cell > cell2 or part >= part2").select("cell", "part", "cell2", "part2", "hit")

    def pair_groups(self) -> int:
        """Into how many groups tiles are dealt for pairs: as many whatever the number of vectors, until a group would be too large for a task."""
        rows = max(GROUP_ROWS, min(-(-self.n // GROUPS), GROUP_BYTES // (8 * max(self.d, 1))))
        return max(1, -(-self.n // rows))

    def similar_pairs(self, threshold: float, partners: int | None = None) -> DataFrame:
        """``a, b, sim`` for a < b. Tiles are dealt into groups (of about ``partners``, if given), and a task has two groups or one and itself: so a tile is sent once a group, not once a partner."""
        groups = max(1, self.tiles.count() // partners) if partners else self.pair_groups()
        g = F.pmod(F.xxhash64("cell", "part"), F.lit(groups)).cast("int")
        tiles = self.tiles.select(g.alias("g"), "cell", "part", "keys", "x")
        first = tiles.select(F.col("g").alias("i"), F.explode(F.sequence(F.lit(0), F.col("g"))).alias("j"), F.lit(0).alias("side"), "cell", "part", "keys", "x")
        second = tiles.select(F.explode(F.sequence(F.col("g"), F.lit(groups - 1))).alias("i"), F.col("g").alias("j"), F.lit(1).alias("side"), "cell", "part", "keys", "x")
        laid = first.unionByName(second).repartition(groups * (groups + 1) // 2, "i", "j").sortWithinPartitions("i", "j", "side", "cell", "part")
        d, cells, allowed = self.d, self._bounds()[0], self._allowed_function(threshold)

        def met(mine: list[tuple], hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """The chosen tiles' keys and vectors, adjacent small ones together."""
            some: list[tuple] = []
            for k in np.flatnonzero(hit):
                if some and sum(len(t[1]) for t in some) + len(mine[k][1]) > TILE:
                    yield np.concatenate([t[1] for t in some]), np.concatenate([t[2] for t in some])
                    some = []
                some.append(mine[k])
            if some:
                yield np.concatenate([t[1] for t in some]), np.concatenate([t[2] for t in some])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, mine, places = None, [], np.empty(0, np.int64)
            for batch in batches:
                for n in range(batch.num_rows):
                    i, j, side, cell, part = (batch.column(k)[n].as_py() for k in range(5))
                    key = np.frombuffer(batch.column(5)[n].as_buffer(), np.int64)
                    x = np.frombuffer(batch.column(6)[n].as_buffer(), np.float64).reshape(-1, d)
                    if task != (i, j):
                        task, mine, places = (i, j), [], np.empty(0, np.int64)
                    if side == 0:
                        mine.append(((cell, part), key.copy(), x.copy()))
                        continue
                    if len(places) != len(mine):
                        places = np.searchsorted(cells, [t[0][0] for t in mine])
                    hit = allowed(int(np.searchsorted(cells, cell)))[places] if mine else np.zeros(0, bool)
                    own = i == j
                    if own:  # of two tiles of one group the later has the earlier, and itself
                        hit = hit & np.array([t[0] <= (cell, part) for t in mine])
                        self_at = next(k for k, t in enumerate(mine) if t[0] == (cell, part))
                        itself, hit[self_at] = hit[self_at], False
                    for once, (ka, y) in [*((False, t) for t in met(mine, hit)), *([(True, (key, x))] if own and itself else [])]:
                        for at in range(0, len(ka), 512):
                            sim = y[at : at + 512] @ x.T
                            r, c = np.nonzero(sim >= threshold - 1e-9)
                            kb = ka[at : at + 512]
                            keep = kb[r] < key[c] if once else kb[r] != key[c]
                            r, c = r[keep], c[keep]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(kb[r], key[c])), pa.array(np.maximum(kb[r], key[c])), pa.array(sim[r, c])], names=["a", "b", "sim"])

        return laid.mapInArrow(run, "a bigint, b bigint, sim double").where(F.col("sim") >= threshold)

    def skipped(self, threshold: float) -> float:
        """The share of pairs of tiles that are left out."""
        r = self.tile_pairs(threshold).agg(F.count("*").alias("all"), F.count_if("hit").alias("hit")).first()
        return 1 - r["hit"] / max(r["all"], 1)
