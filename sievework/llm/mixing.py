"""Mixing sources to target weights by temperature.

A source's token share is raised to an exponent and normalised. The exponent is
the smallest for which the mixture keeps to a target entropy and no source is
repeated beyond a limit, found by bisection (1: in proportion, 0: uniform). A budget
that even shares in proportion can't meet within the limit is refused.

The weights are realised as budgeted block permutations. A mixture of ``T`` tokens
has ``blocks`` blocks; each gives a source its weight's part of ``T / blocks`` tokens. A
source's documents come in passes, each a permutation of its own (the order of a hash); laid end to
end, the passes are cut where a block's budget is full. So each block, and not
just the whole, has the target weights, but for the document at each cut, which
goes to the block in which it ends. The last cut ends the source: a document that no longer
fits the budget is left out. ``position`` permutes the documents of a block.

Per source, pass and hash bucket one sum is gathered, then documents of only the
buckets with a cut, without their texts: the documents themselves are never shuffled, and a
source that holds most of the rows has the more buckets. What reaches the driver are
the sources' sizes, equal ones as one row. The cuts are broadcast
if there are at most ``BROADCAST_SOURCES`` sources, else joined by source and salt.

Defined cases: null text counts as empty (0 tokens); null sources count as the
source ''; a source without tokens has weight 0 and is left out; ids may be null or repeat;
rows equal in all columns are taken or left together; an empty table gives an empty
result. Columns of the input named like a new one are replaced by it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.shared import Tables

BROADCAST_SOURCES = 5000
SALTS = 64
#: Documents a bucket, about.
BUCKET_ROWS = 1024


@dataclass(frozen=True)
class MixParams:
    entropy_share: float = 0.95  # of the entropy that equal weights would have
    max_repeats: float = 4.0
    budget_tokens: int | None = None  # None: as many as the corpus has
    blocks: int = 64
    seed: int = 7


def weights_at(shares: list[float], exponent: float) -> list[float]:
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def solve_exponent(tokens: list[int], budget: float, p: MixParams) -> float:
    """The smallest exponent in [0, 1] that keeps the repetition limit and doesn't flatten beyond the target entropy; 1 if only the entropy can't be met."""
    total = sum(tokens)
    if total and budget > p.max_repeats * total * (1 + 1e-12):
        raise ValueError(f"a budget of {budget:.0f} tokens repeats {total} tokens more than {p.max_repeats} times")
    alive = [(t / total, t) for t in tokens if t > 0]
    if len(alive) < 2:
        return 1.0
    target = p.entropy_share * math.log(len(alive))

    def fits(a: float) -> bool:
        w = weights_at([s for s, _ in alive], a)
        return entropy(w) <= target and max(budget * x / t for x, (_, t) in zip(w, alive, strict=True)) <= p.max_repeats

    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def _tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+", -1), lambda w: w != "")).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of the documents of the mixture, with ``pass_no, block, position``.

    A document occurs once per pass that takes it. ``position`` in [0, 1) orders the whole mixture, block by block.
    """
    p = params or MixParams()
    spark = docs.sparkSession
    tables = Tables(spark, "mixing")
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("pass_no", "block", "position")]
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    # rows are told apart by all their columns, be ids missing or repeated
    key = F.xxhash64(F.lit(p.seed), F.col(id_col), F.col(text_col), F.col(source_col), *(F.col(c).cast("string") for c, t in docs.dtypes if c not in (id_col, text_col, source_col) and not t.startswith(("map", "variant"))))
    sized = tables.write("sized", docs.select(source.alias("s"), key.alias("key"), _tokens(F.col(text_col)).alias("n")))
    totals = tables.write("totals", sized.groupBy("s").agg(F.sum("n").alias("total"), F.count("*").alias("rows")).where("total > 0"))
    # sources of one size have one weight: as many rows as there are sizes
    sizes = totals.groupBy("total").agg(F.count("*").alias("k"), F.max("rows").alias("rows")).collect()
    every = [r["total"] for r in sizes for _ in range(r["k"])]
    total = sum(every)
    budget = float(p.budget_tokens if p.budget_tokens is not None else total)
    a = solve_exponent(every, budget, p)
    scale = sum((t / total) ** a for t in every) if total else 1.0
    n_sources, most = len(every), max((r["rows"] for r in sizes), default=0)
    # budget of the source, of one of its blocks, and passes over it
    target = F.lit(budget / scale) * F.pow(F.col("total") / F.lit(float(max(total, 1))), F.lit(a))
    plan = totals.select("s", "total", target.alias("target")).withColumn("part", F.col("target") / p.blocks).withColumn("passes", F.ceil(F.col("target") / F.col("total")))
    hint = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda d: d)
    bits = max(6, (most // BUCKET_ROWS).bit_length())

    def occurrences(df: DataFrame) -> DataFrame:
        """A row per document and pass, with its place in the pass."""
        df = df.withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("passes") - 1, F.lit(0).cast("bigint")))))
        return df.withColumn("h", F.xxhash64("key", "pass_no"))

    placed = occurrences(sized.join(hint(plan.where("passes > 0").select("s", "passes")), "s")).withColumn("b", F.shiftright("h", 64 - bits))
    sums = tables.write("sums", placed.groupBy("s", "pass_no", "b").agg(F.sum("n").alias("n")))
    running = F.sum("n").over(Window.partitionBy("s").orderBy("pass_no", "b"))
    # the buckets in which blocks end: cut k is where the passes first exceed k parts
    around = sums.withColumn("upto", running).withColumn("before", F.col("upto") - F.col("n")).join(hint(plan.select("s", "part")), "s")
    ends = F.sequence(F.greatest(F.floor(F.col("before") / F.col("part")), F.lit(1)), F.least(F.ceil(F.col("upto") / F.col("part")), F.lit(p.blocks)))
    near = around.where((F.ceil(F.col("upto") / F.col("part")) >= 1) & (F.floor(F.col("before") / F.col("part")) <= p.blocks))
    edges = tables.write("edges", near.withColumn("k", F.explode(ends)).where("before <= k * part and k * part < upto").select("s", "pass_no", "b", "k", (F.col("k") * F.col("part")).alias("end"), "before"))
    cut_buckets = edges.groupBy("s", "pass_no", "b").agg(F.first("before").alias("before"))
    inside = placed.join(hint(cut_buckets), ["s", "pass_no", "b"])
    within = F.sum("n").over(Window.partitionBy("s", "pass_no", "b").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.select("s", "pass_no", "b", "h", (F.col("before") + within).alias("cum")).distinct()
    cuts = inside.join(edges.drop("before"), ["s", "pass_no", "b"]).where("cum > end").groupBy("s", "k").agg(F.min(F.struct("pass_no", "h")).alias("cut"))
    of_source = tables.write("cuts", plan.where("passes > 0").select("s", "passes").join(cuts.groupBy("s").agg(F.array_sort(F.collect_list("cut")).alias("cuts")), "s", "left"))
    of_source = of_source.select(F.col("s").alias("__s"), F.col("passes"), F.coalesce("cuts", F.array().cast("array<struct<pass_no:bigint,h:bigint>>")).alias("__cuts"))
    df = docs.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(names)), source.alias("__s"), key.alias("key"))
    if n_sources <= BROADCAST_SOURCES:
        df = df.join(F.broadcast(of_source), "__s")
    else:
        salted = of_source.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.withColumn("__salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["__s", "__salt"])
    df = occurrences(df)
    # cuts are in order: as many blocks have ended as cuts lie at or before the document
    here = F.struct("pass_no", "h")
    block = F.size(F.filter("__cuts", lambda c: c <= here))
    spread = F.pmod(F.xxhash64("h", F.lit(p.seed + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    df = df.withColumn("block", block).where(F.col("block") < p.blocks)
    return df.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(names)), "pass_no", "block", ((F.col("block") + spread) / p.blocks).alias("position"))
