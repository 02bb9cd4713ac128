"""Merkle manifest of a dataset: leaves, a root per group, one root, and an authentication path per row.

Rows are leaves in a stated order within their group. A tree of fan-out 8 stands over each group, another over the groups'
roots. Leaves are placed by a range sort and dealt in aligned blocks of ``8 ** levels`` (4096 rows); a block is one subtree. The
blocks' roots are rows of the next layer, which is dealt in blocks in the same way, until each group
is one block; then the groups' roots are a layer. Layers shrink by 4096, so there are four of them at 10**11 rows.

Paths come down the same layers. Within a block they are made by fractal traversal: of each level of stacked subtrees (64 nodes
wide) the existing one serves the paths, and the desired one, its right neighbour, grows by a node's
share of hashing with each path given out, so that it is ready when the walk reaches it. What is
held is two subtrees a level, not the block's tree. The path of the block's own root, from the layer above, is appended.

Digests: SHA-256 in lowercase hexadecimal, of hexadecimal children joined. A path is bytes: per level the place in the run, the number
of siblings, and their digests (32 bytes each) from left to right.

Defined cases: a null value is a leaf's ``-`` (an empty text is ``0:``); null ids and null groups come first; rows
that share an id are ordered by their leaf; equal rows are leaves of their own; one row is its group's root; an empty table gives an empty result;
columns that aren't named in ``columns`` are no part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.shared import Tables

FAN = 8
#: Levels of hashing of one block as a rule, and of one of the stacked subtrees within it.
LEVELS = 4
SUB_LEVELS = 2
#: Offsets (a row for each partition and group that meet) are broadcast up to this number.
BROADCAST_OFFSETS = 100_000


def spelled(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(spelled, columns)), 256)


def node(children: list[bytes]) -> bytes:
    """The digest of a run of hexadecimal digests, itself hexadecimal."""
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def levels_of(leaves: int) -> int:
    """Levels of hashing until one node remains."""
    n, out = leaves, 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


class Subtree:
    """One aligned subtree of ``SUB_LEVELS`` levels (fewer at the top), filled leaf by leaf from the left.

    ``rows[k]``: the nodes at height k above its own leaves. ``add`` closes every run that is full; ``end`` closes the rest.
    """

    def __init__(self, levels: int) -> None:
        self.levels, self.rows = levels, [[] for _ in range(levels + 1)]

    def add(self, digest: bytes) -> None:
        rows, k = self.rows, 0
        rows[0].append(digest)
        while k < self.levels and len(rows[k]) % FAN == 0:
            rows[k + 1].append(node(rows[k][-FAN:]))
            k += 1

    def end(self) -> bytes:
        for k in range(self.levels):
            done = len(self.rows[k + 1]) * FAN
            if done < len(self.rows[k]):
                self.rows[k + 1].append(node(self.rows[k][done:]))
        return self.rows[-1][0]


class Builder:
    """Computes the nodes at a given height one after the other, a leaf a step, with one open run a level."""

    def __init__(self, leaves: list[bytes], height: int, first: int, last: int) -> None:
        self.leaves, self.height, self.at, self.last = leaves, height, first, last
        self.open: list[list[bytes]] = [[] for _ in range(height + 1)]

    def step(self) -> bytes | None:
        """Reads one leaf; a node if that completes one. At the last leaf unfinished runs are closed."""
        if self.at >= self.last:
            return None
        self.open[0].append(self.leaves[self.at])
        self.at += 1
        ends, k = self.at == self.last, 0
        while k < self.height and self.open[k] and (ends or len(self.open[k]) == FAN):
            self.open[k + 1].append(node(self.open[k]))
            self.open[k] = []
            k += 1
        while ends and k < self.height:  # a higher run may be open although the one below was empty
            if self.open[k]:
                self.open[k + 1].append(node(self.open[k]))
                self.open[k] = []
            k += 1
        return self.open[self.height].pop() if self.open[self.height] else None


def block_root(leaves: list[bytes], levels: int) -> bytes:
    """The root at exactly ``levels`` above the leaves."""
    whole = Subtree(levels)
    for digest in leaves:
        whole.add(digest)
    return whole.end()


def authentication_paths(leaves: list[bytes], levels: int) -> Iterator[bytes]:
    """The path of each leaf in turn, by fractal traversal of a block (hexadecimal leaves, exactly ``levels`` levels)."""
    n = len(leaves)
    heights = list(range(0, levels, SUB_LEVELS))  # of the subtrees' own leaves
    spans = [FAN ** min(h + SUB_LEVELS, levels) for h in heights]  # leaves below one subtree
    tops = [min(SUB_LEVELS, levels - h) for h in heights]

    def opened(k: int, first: int) -> tuple[Subtree, Builder]:
        return Subtree(tops[k]), Builder(leaves, heights[k], first, min(first + spans[k], n))

    existing: list[Subtree] = []
    desired: list[tuple[Subtree, Builder] | None] = []
    for k in range(len(heights)):
        tree, builder = opened(k, 0)
        for _ in range(min(spans[k], n)):
            made = builder.step()
            if made is not None:
                tree.add(made)
        tree.end()
        existing.append(tree)
        desired.append(opened(k, spans[k]) if spans[k] < n else None)
    for i in range(n):
        for k, span in enumerate(spans):
            if i and i % span == 0:  # the walk enters the desired subtree
                tree, _ = desired[k]
                tree.end()
                existing[k] = tree
                desired[k] = opened(k, i + span) if i + span < n else None
        path = []
        for k, tree in enumerate(existing):
            inside = i % spans[k] // FAN ** heights[k]
            for row in tree.rows[: tops[k]]:
                run, at = inside // FAN * FAN, inside % FAN
                others = row[run : run + at] + row[run + at + 1 : run + FAN]
                path.append(bytes((at, len(others))))
                path.append(bytes.fromhex(b"".join(others).decode()))
                inside //= FAN
        yield b"".join(path)
        for waiting in desired:
            if waiting is not None:
                made = waiting[1].step()
                if made is not None:
                    waiting[0].add(made)


def siblings(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Per level the place in the run and the siblings' hexadecimal digests."""
    at = 0
    while at < len(path):
        place, k = path[at], path[at + 1]
        digits = path[at + 2 : at + 2 + 32 * k].hex().encode()
        yield place, [digits[64 * j : 64 * j + 64] for j in range(k)]
        at += 2 + 32 * k


def folded(leaf: bytes, path: bytes) -> tuple[bytes, bytes]:
    """The root that a leaf and its path lead to, and the digest of all siblings."""
    seen = hashlib.sha256()
    for place, others in siblings(path):
        seen.update(b"".join(others))
        leaf = node(others[:place] + [leaf] + others[place:])
    return leaf, seen.hexdigest().encode()


def _placed(rows: DataFrame, order: list[Column], tables: Tables, name: str) -> DataFrame:
    """``rows`` (with the column ``g``) with ``pos``, their place within their group in the stated order, and the group's ``size``.

    One range sort; the counts by partition and group, as many as partitions and groups together, give the offsets.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = tables.write(name, rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    laid = laid.withColumn("part", F.shiftright("at", 33))
    counts = laid.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before, whole = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    offsets = tables.write(f"{name}_offsets", counts.select("g", "part", shift.alias("shift"), F.sum("n").over(whole).alias("size")))
    if offsets.count() <= BROADCAST_OFFSETS:
        offsets = F.broadcast(offsets)
    return laid.join(offsets, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _levels(size: int, levels: int) -> int:
    """Of a block: all, or fewer where it is its group's only one."""
    return levels if size > FAN**levels else levels_of(size)


def _by_pos(block: pa.Table) -> pa.Table:
    return block.sort_by("pos").combine_chunks()


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _layers(rows: DataFrame, tables: Tables, name: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The layers of the trees over ``g, pos, size, digest``, lowest first, and each group's root (``g, digest``)."""
    width = FAN**levels

    def roots(block: pa.Table) -> pa.Table:
        block = _by_pos(block.select(["g", "block", "pos", "size", "digest"]))
        size = block["size"][0].as_py()
        root = bytes.fromhex(block_root(_hex(block["digest"]), _levels(size, levels)).decode())
        return pa.table({"g": block["g"][:1], "pos": block["block"][:1], "size": pa.array([-(-size // width)], pa.int64()), "digest": pa.array([root], pa.binary())})

    out = []
    while True:
        rows = rows.withColumn("block", F.floor(F.col("pos") / width))
        out.append(rows)
        most = rows.agg(F.max("size").alias("most")).first()["most"] or 0
        narrow = rows.select("g", "block", "pos", "size", "digest")
        rows = tables.write(f"{name}{len(out)}", narrow.groupBy("g", "block").applyInArrow(roots, "g string, pos bigint, size bigint, digest binary"))
        if most <= width:
            return out, rows.select("g", "digest")


def _paths_down(layers: list[DataFrame], upper: DataFrame, tables: Tables, name: str, levels: int) -> DataFrame:
    """The rows of the lowest layer with ``path, subroot, root``; ``upper`` has these of each group (``g, block, path, subroot, root``)."""

    def down(block: pa.Table, above: pa.Table) -> pa.Table:
        block = _by_pos(block)
        rest = above["path"][0].as_py()
        own = authentication_paths(_hex(block["digest"]), _levels(block["size"][0].as_py(), levels))
        block = block.append_column("path", pa.array((p + rest for p in own), pa.binary(), size=len(block)))
        for c in ("subroot", "root"):
            block = block.append_column(c, pa.array([above[c][0].as_py()] * len(block), pa.binary()))
        return block

    for k in range(len(layers) - 1, -1, -1):
        layer = layers[k]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layer.schema.fields)
        found = layer.groupBy("g", "block").cogroup(upper.groupBy("g", "block")).applyInArrow(down, f"{kinds}, path binary, subroot binary, root binary")
        if not k:
            return found
        upper = tables.write(f"{name}_paths{k}", found.select("g", F.col("pos").alias("block"), "path", "subroot", "root"))


def manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """Each row with its proof: ``id_col, leaf, position, path, subroot, root`` and the columns of ``carry``.

    ``columns``: what a leaf is made of, in order. Groups are ordered by ``group_col`` (null first, bytewise), rows by ``id_col``.
    Digests are hexadecimal, paths as above; ``verify`` reads them.
    """
    carry = carry or {}
    tables = Tables(docs.sparkSession, "merkle")
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        spelled(group).alias("g"),
        group.alias("name"),
        F.col(id_col).alias("id"),
        F.unhex(leaf_digest([F.col(c) for c in columns])).alias("digest"),
        *(c.alias(f"c{k}") for k, c in enumerate(carry.values())),
        F.monotonically_increasing_id().alias("seq"),  # spreads equal rows over the sort's ranges
    )
    leaves = tables.write("leaves", leaves)
    order = [F.col("name").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest").asc(), F.col("seq").asc()]
    placed = _placed(leaves, order, tables, "ordered").drop("seq")
    layers, subroots = _layers(placed.drop("name"), tables, "layer", levels)

    names = leaves.groupBy("g").agg(F.max("name").alias("name"))
    groups = subroots.join(names, "g").select(F.lit("").alias("g"), "name", F.col("g").alias("of"), "digest")
    top, roots = _layers(_placed(groups, [F.col("name").asc_nulls_first()], tables, "groups").drop("name"), tables, "top", levels)
    above = roots.select("g", F.lit(0).cast("bigint").alias("block"), F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    of_group = _paths_down(top, above, tables, "top", levels)
    of_group = tables.write("of_group", of_group.select(F.col("of").alias("g"), F.lit(0).cast("bigint").alias("block"), "path", F.col("digest").alias("subroot"), "root"))
    found = _paths_down(layers, of_group, tables, "layer", levels)
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias(id_col), text("digest").alias("leaf"), F.col("pos").alias("position"), "path", text("subroot").alias("subroot"), text("root").alias("root"),
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(carry)),
    )


def verify(proofs: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """``proofs`` with ``proof_sha256`` (of the path's siblings) and ``folded_root`` (from ``leaf_col`` and the path) in place of ``path``."""
    names = [c for c in proofs.columns if c != "path"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema.fields if f.name != "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [folded(leaf.encode(), path) for leaf, path in zip(batch.column(leaf_col).to_pylist(), batch.column("path").to_pylist(), strict=True)]
            new = [pa.array([x[k].decode() for x in got], pa.string()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, "proof_sha256", "folded_root"])

    return proofs.mapInArrow(run, f"{kinds}, proof_sha256 string, folded_root string")
