"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens: its lower-cased words, then an end. A token is a
sequence of binary decisions along a Huffman tree of the most frequent tokens; any
other token is an escape and its add-one share among the other training tokens
and one class for all unseen ones, the events of the base score. Each decision is
predicted by three models: the counts below the tree's node, and counts under a hash
of the node with one or two tokens before. Their log odds are summed with weights that a gate
selects by how much evidence the longer contexts have. The weights begin with what a rule
gives the evidence and follow the coding errors of the text after each ``STEP_BITS``
decisions (a few words); a table over the levels of the mixed odds, which follows the errors
likewise, refines the result. The counts stay as they are, and each text starts anew, so
scores don't depend on partitions.

On top stands a long context. Where the hash of ``ANCHOR_TOKENS`` tokens is a multiple of
``ANCHOR_RATE`` a run begins, which reaches to the next such place. How often which runs
follow those tokens in the other training documents is counted exactly, over all of them.
A run is then predicted by a mixture, gated by the number of those documents: one that
repeats what another document has costs next to nothing, be its words frequent or not.

The score is the log10 probability of the text; ``bits_per_byte`` is the length of
its code, in which unseen words are followed by their bytes as they are, per byte.

What is gathered from the corpus, over all training documents, and never from a sample:

* exact counts of tokens (they also give the base score: add-one unigrams) and of runs, summed by
  hash bucket. Both grow with the input and stay distributed; buckets answer what texts ask. Only
  the ``VOCAB`` most frequent tokens are broadcast, for the tree;
* counts of the decisions in two hashed tables, whose size follows the number of tokens up
  to ``2**MAX_SLOT_BITS`` slots. Beyond that contexts share slots and tell less.

A training document is scored by the runs of the others, its own are left out.

Defined cases: null or blank text is a sequence of the end alone; documents with
a null id are hashed as the empty text; rows that share an id, or all their values, are
documents of their own; with no training documents all counts are 0; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bytesarrays import mix64, text_chunks, trimmed, words_of
from sievework.llm.shared import Tables

VOCAB = 1 << 16
MIN_SLOT_BITS, MAX_SLOT_BITS = 12, 20
HASHED = 2  # contexts of one and of two tokens
MODELS = HASHED + 1
BLOCK = 1 << 16
#: Texts are taken in parts of so many bytes (a longer text is one), whose arrays stay in the processor's cache.
LM_BYTES = 48 << 10
#: Tokens of the context of a run, and one in how many places begins one.
ANCHOR_TOKENS, ANCHOR_RATE = 4, 16
STEP_BITS, RATE = 32, 0.02
#: Of a longer context, by its evidence: none, 1, 4, 32 decisions and more.
SHARE = np.array([0.0, 0.1, 0.4, 0.7])
GATES = len(SHARE) ** HASHED
#: Leading bits by which a token is found in the tree.
FIND_BITS = 18
#: Levels of the mixed odds that are refined, one a unit.
ODDS = 14
LEVELS = 2 * ODDS + 1
_U = np.uint64
END = _U(0x5851F42D4C957F2D)
_COUNT = np.dtype([("h", "u8"), ("c", "u8")])
_RUN = np.dtype([("h", "u8"), ("run", "u8"), ("c", "u4")])
_ASK = np.dtype([("h", "u8"), ("seg", "i4"), ("size", "i4")])
_ASK_RUN = np.dtype([("h", "u8"), ("run", "u8"), ("seg", "i4"), ("own", "i4")])
TOKENS, RUNS, HOME = 0, 1, 2


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and sizes in bytes of all tokens in order; ends of texts have size 0."""
    h, row, s, e = words_of(data, offsets)
    rows = len(offsets) - 1
    at = np.searchsorted(row, np.arange(rows), "right")
    return np.insert(h, at, END), np.insert(row, at, np.arange(rows)), np.insert(e - s, at, 0)


def runs_of(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens of all runs; hashes of the contexts they follow (0: the text's start) and of the runs with these."""
    n = len(h)
    if not n:
        return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U)
    context = h.copy()
    for k in range(1, ANCHOR_TOKENS):
        context *= _U(0x9E3779B97F4A7C15)
        context[k:] += h[: n - k]
    context = mix64(context)
    whole = np.zeros(n, bool)
    whole[ANCHOR_TOKENS - 1 :] = row[ANCHOR_TOKENS - 1 :] == row[: n - ANCHOR_TOKENS + 1]
    opens = np.ones(n, bool)
    opens[1:] = row[1:] != row[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (whole & (context % _U(ANCHOR_RATE) == 0))[:-1] & ~opens[1:]
    first = np.flatnonzero(opens | follows)
    before = np.where(follows[first], context[first - 1], _U(0))
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    spelled = mix64(h + _U(0xA24BAED4963EE407) * (place.astype(_U) + _U(1)))
    return first, before, mix64(np.add.reduceat(spelled, first) + before * _U(3))


def runs_counted(before: np.ndarray, run: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs with a context are the first of their kind in their text, and per run how many kinds its text has after that context."""
    keep = np.flatnonzero(before)
    order = keep[np.lexsort((run[keep], before[keep], row[keep]))]
    same = (row[order][1:] == row[order][:-1]) & (before[order][1:] == before[order][:-1])
    new = np.ones(len(order), bool)
    new[1:] = ~(same & (run[order][1:] == run[order][:-1]))
    group = np.cumsum(np.concatenate(([True], ~same))[: len(order)]) - 1
    first, kinds = np.zeros(len(before), bool), np.zeros(len(before), np.int32)
    first[order] = new
    if len(order):
        kinds[order] = np.bincount(group, weights=new)[group]
    return first, kinds


def _huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per symbol the start of its path (one more start at the end); nodes and bits of all paths; per node the weights on either side."""
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side, sums = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int8), []
    new = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j], side[j] = new, new, 1
        heapq.heappush(heap, (a + b, new))
        sums.append((a, b))
        new += 1
    root = new - 1
    starts, nodes, bits = [0], [], []
    for i in range(n):
        path, at = [], i
        while at != root:
            path.append((parent[at] - n, side[at]))
            at = parent[at]
        nodes += [x for x, _ in reversed(path)]
        bits += [x for _, x in reversed(path)]
        starts.append(len(nodes))
    return np.array(starts, np.int64), np.array(nodes, np.int32), np.array(bits, np.uint8), np.array(sums, np.float64).reshape(-1, 2)


def _odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds in 1/256 (within +-31)."""
    return np.clip(np.round(256 * np.log((n1 + 0.25) / (n0 + 0.25))), -8191, 8191).astype(np.int16)


def lookup(counts: np.ndarray) -> np.ndarray:
    """Per slot of (zeros, ones) counts: log odds in 1/256, shifted, with two bits for the evidence; 16 bits hold both."""
    n0, n1 = counts[..., 0].astype(np.float64), counts[..., 1].astype(np.float64)
    return (_odds(n0, n1) << 2) | np.searchsorted([1, 4, 32], n0 + n1, "right").astype(np.int16)


@dataclass
class Codes:
    """The tree of the tokens (``vocab``: sorted hashes; the last symbol is the escape); per step of a path the bit, a hash of the node, and the node's log odds."""

    vocab: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    steps: np.ndarray  # 32 bits of hash, 16 of odds, 8 with the bit
    slot_bits: int
    table: np.ndarray  # where in vocab the hashes with the same leading bits begin

    @staticmethod
    def build(vocab: np.ndarray, counts: np.ndarray, rest: int, tokens: int) -> Codes:
        starts, nodes, bits, sums = _huffman(np.append(counts.astype(np.int64) + 1, rest + 1))
        hashed = (mix64(nodes.astype(_U) + _U(1)) >> _U(32)) << _U(32)
        odds = _odds(sums[:, 0], sums[:, 1])[nodes].astype(np.uint16).astype(_U)
        slot_bits = min(MAX_SLOT_BITS, max(MIN_SLOT_BITS, (4 * tokens).bit_length()))
        table = np.searchsorted(vocab, np.arange(1 << FIND_BITS, dtype=_U) << _U(64 - FIND_BITS)).astype(np.int32)
        return Codes(vocab, counts, starts.astype(np.int32), hashed | (odds << _U(8)) | bits.astype(_U), slot_bits, table)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each token, and whether it has one of its own."""
        n = len(self.vocab)
        out = np.full(len(h), n, np.int32)
        if not n:
            return out, np.zeros(len(h), bool)
        at = self.table[h >> _U(64 - FIND_BITS)]
        some = np.arange(len(h))
        while len(some):  # as often as the most hashes that share their leading bits
            here = np.minimum(at, n - 1)
            have = self.vocab[here]
            hit = have == h[some]
            out[some[hit]] = here[hit]
            on = ~hit & (at < n - 1) & (have < h[some])
            some, at = some[on], at[on] + 1
        return out, out < n


def decisions(h: np.ndarray, row: np.ndarray, sym: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All decisions of tokens: bit, log odds of the node, slots (HASHED rows); where each token's begin, and the end."""
    n = len(h)

    def before(k: int) -> np.ndarray:
        out = np.zeros(n, _U)
        out[k:] = np.where(row[k:] == row[: n - k], h[: n - k], _U(0))
        return out

    one = before(1)
    contexts = mix64(one + _U(1)) >> _U(32) | mix64(mix64(one * _U(3) + before(2)) + _U(2)) >> _U(32) << _U(32)
    size = (codes.starts[1:] - codes.starts[:-1])[sym]
    at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    index = np.ones(at[-1], np.int32 if len(codes.steps) < 1 << 30 else np.int64)
    some = np.flatnonzero(size)
    if len(some):
        index[at[some]] = np.diff(codes.starts[sym[some]], prepend=0)
        index[at[some[1:]]] -= size[some[:-1]] - 1
        np.cumsum(index, out=index)
    step = codes.steps[index]
    mixed = np.repeat(contexts, size)
    node = (step >> _U(32)).astype(np.uint32)
    slots = np.empty((HASHED, len(index)), np.int32)
    for k in range(HASHED):
        slot = slots[k].view(np.uint32)
        np.bitwise_xor((mixed >> _U(32) if k else mixed).astype(np.uint32), node, out=slot)
        slot *= np.uint32(0x9E3779B1)
        slot >>= np.uint32(32 - codes.slot_bits)
    return step.astype(np.uint8), (step >> _U(8)).astype(np.int16), slots, at


def start_weights() -> np.ndarray:
    """Per gate the weights of the models: each longer context takes its share of what is left."""
    two, one = np.repeat(SHARE, len(SHARE)), np.tile(SHARE, len(SHARE))
    return np.stack([(1 - two) * (1 - one), (1 - two) * one, two], axis=1)


@dataclass
class Stream:
    """Decisions of texts in turn: bits, log odds of the models in 1/256 and gates; where each text's decisions begin, and the end."""

    bit: np.ndarray
    odds: list[np.ndarray]  # MODELS arrays
    gate: np.ndarray
    at: np.ndarray


def stream(bit: np.ndarray, node_odds: np.ndarray, slots: np.ndarray, at: np.ndarray, table: np.ndarray) -> Stream:
    raw = [table[k][slots[k]] for k in range(HASHED)]
    gate = ((raw[1] & 3) * np.int16(len(SHARE)) + (raw[0] & 3)).astype(np.uint8)
    return Stream(bit, [node_odds, *(x >> 2 for x in raw)], gate, at)


def joined(streams: list[Stream], at: np.ndarray) -> Stream:
    """The streams as one; they are emptied array by array, as a batch's decisions are many times its text."""

    def taken(own: str, k: int | None = None) -> np.ndarray:
        out = np.concatenate([getattr(s, own) if k is None else getattr(s, own)[k] for s in streams])
        for s in streams:
            if k is None:
                setattr(s, own, None)
            else:
                s.odds[k] = None
        return out

    return Stream(taken("bit"), [taken("odds", k) for k in range(MODELS)], taken("gate"), at)


def mix_stream(s: Stream, rate: float = RATE) -> np.ndarray:
    """Natural log probability of each decision. Weights and refinement follow the errors after each ``STEP_BITS`` of a text; the texts go step by step side by side."""
    size = np.diff(s.at)
    order = np.argsort(-size, kind="stable")
    start, size = s.at[:-1][order], size[order]
    texts = int((size > 0).sum())
    w = [np.tile(x, texts) for x in start_weights().astype(np.float32).T]
    fine = np.zeros(texts * LEVELS, np.float32)
    out = np.empty(len(s.bit), np.float32)
    lane = np.arange(STEP_BITS)
    gates, levels = np.repeat(np.arange(texts, dtype=np.int32) * np.int32(GATES), STEP_BITS), np.repeat(np.arange(texts) * LEVELS + ODDS, STEP_BITS)
    n = texts
    for a in range(0, int(size[0]) if texts else 0, STEP_BITS):
        while n and size[n - 1] <= a:  # texts that are at their end
            n -= 1
        index = (start[:n, None] + (a + lane)).ravel()
        cell, level = gates[: n * STEP_BITS], levels[: n * STEP_BITS]
        if size[n - 1] < a + STEP_BITS:
            inside = np.flatnonzero(((a + lane) < size[:n, None]).ravel())
            index, cell, level = index[inside], cell[inside], level[inside]
        cell = np.add(cell, s.gate[index], dtype=np.int64)
        here = [s.odds[k].take(index) * np.float32(1 / 256) for k in range(MODELS)]
        z = here[0] * w[0].take(cell)
        for k in range(1, MODELS):
            z += here[k] * w[k].take(cell)
        level = level + np.clip(np.rint(z), -ODDS, ODDS).astype(np.int64)
        z += fine.take(level)
        # the odds against what came give both the loss and the error
        side = s.bit.take(index) * np.float32(2) - np.float32(1)
        z *= side
        np.clip(z, -ODDS, ODDS, out=z)
        against = np.exp(-z)
        against += 1
        out[index] = -np.log(against)
        err = side - side / against
        err *= np.float32(rate)
        fine[: n * LEVELS] += np.bincount(level, weights=err, minlength=n * LEVELS)
        for k in range(MODELS):
            here[k] *= err
            w[k][: n * GATES] += np.bincount(cell, weights=here[k], minlength=n * GATES)
    return out


def run_logs(streams: list[Stream], cuts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability, token by token, of each run: ``cuts`` has where the runs of each stream begin, and its end. ``streams`` are emptied."""
    steps = np.cumsum([0, *(len(s.bit) for s in streams)])
    starts = np.concatenate([s.at[:-1] + o for s, o in zip(streams, steps, strict=False)])
    whole = joined(streams, np.append(starts, steps[-1]))
    logged = mix_stream(whole)
    del whole
    upto = np.zeros(len(logged) + 1)
    for a in range(0, len(logged), BLOCK):  # numpy would widen a copy of the whole
        part = logged[a : a + BLOCK].astype(np.float64)
        part[0] += upto[a]
        np.cumsum(part, out=upto[a + 1 : a + 1 + len(part)])
    del logged
    return np.concatenate([upto[c[1:] + o] - upto[c[:-1] + o] for c, o in zip(cuts, steps, strict=False)])


def with_runs(logs: np.ndarray, times: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Natural log probability of runs: of ``others`` documents with their context ``times`` have the run itself, and token by token it has ``logs``.

    The probabilities of all runs after a context sum to 1: those of the runs seen
    to the gate, the tokens' to the rest.
    """
    gate = np.where(others > 0, (others + 0.5) / (others + 1.0), 0.0)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(gate * times / np.maximum(others, 1)), np.log(1 - gate) + logs)


def _blocks(flat: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of an array of counts that aren't all 0."""
    for b in range(0, len(flat), BLOCK):
        part = flat[b : b + BLOCK]
        if part.any():
            part = part.astype(np.uint16) if part.max() < 1 << 16 else part
            yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([part.itemsize], pa.int32())], names=["block", "counts", "wide"])


def _summed(df: DataFrame, width: int, tasks: int) -> np.ndarray:
    """Sums arrays of counts of fixed size: ``df`` has rows (block, counts, wide) with 16 or 32 bits a count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw, wide in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                part = np.frombuffer(raw.as_buffer(), np.uint16 if wide == 2 else np.uint32)
                sums[b] = sums[b] + part if b in sums else part.astype(np.uint64)
        for b, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["block", "counts"])

    out = np.zeros(width, np.uint32)
    for r in df.repartition(tasks, "block").mapInArrow(trimmed(add), "block int, counts binary").toLocalIterator():
        part = np.frombuffer(r["counts"], np.uint32)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out


def _split(records: np.ndarray, bits: int) -> list[tuple[int, bytes]]:
    """Records as one blob a bucket, sorted by hash; a blob has the records field by field, which compresses."""
    records = records[np.argsort(records["h"], kind="stable")]
    cuts = np.searchsorted((records["h"] >> _U(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    return [(b, b"".join(records[f][cuts[b] : cuts[b + 1]].tobytes() for f in records.dtype.names)) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def _joined(blob: bytes, kind: np.dtype) -> np.ndarray:
    """Records from a blob."""
    n = len(blob) // kind.itemsize
    out, at = np.empty(n, kind), 0
    for f in kind.names:
        size = kind[f].itemsize
        out[f] = np.frombuffer(blob, kind[f], n, at)
        at += n * size
    return out


def _rows(kinds: list[int], buckets: list, batches: list, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(batches, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "batch", "blob"])


_ROWS = "kind int, bucket int, batch bigint, blob binary"


def _added(parts: list[np.ndarray], key: str) -> np.ndarray:
    """Records with the counts of equal ones (by ``key``) summed, in its order."""
    every = np.concatenate(parts)
    every = every[np.argsort(every[key], kind="stable")]
    first = np.flatnonzero(np.concatenate(([True], every[key][1:] != every[key][:-1]))) if len(every) else np.empty(0, np.int64)
    out = every[first].copy()
    if len(out):
        out["c"] = np.add.reduceat(every["c"], first)
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for each row.

    Learns from documents whose crc32 of the id as text, modulo ``folds``, is not ``held_fold``.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "lm-score")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(7, (2 * tasks - 1).bit_length())  # two buckets a task, so that a bucket doesn't grow with the input
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), (fold == held_fold).alias("held"), F.col(text_col).alias("t"))
    train = rows.where("not held")

    # 1. counts of tokens and runs
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, runs = [np.empty(0, _COUNT)], [np.empty(0, _RUN)]
            for _, _, data, offsets in text_chunks(batch.column(0), LM_BYTES):
                h, row, _ = _tokens(data, offsets)
                first, before, run = runs_of(h, row)
                kept = runs_counted(before, run, row[first])[0]
                own = np.ones(int(kept.sum()), _RUN)
                own["h"], own["run"] = before[kept], run[kept]
                runs.append(own)
                h, c = np.unique(h, return_counts=True)
                own = np.empty(len(h), _COUNT)
                own["h"], own["c"] = h, c
                tokens.append(own)
            out = [(kind, *x) for kind, parts, key in ((TOKENS, tokens, "h"), (RUNS, runs, "run")) for x in _split(_added(parts, key), bits)]
            yield _rows([k for k, _, _ in out], [b for _, b, _ in out], [None] * len(out), [x for _, _, x in out])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for kind, b, raw in zip(*(batch.column(q).to_pylist() for q in (0, 1)), batch.column(3), strict=True):
                parts = held.setdefault((kind, b), [])
                parts.append(_joined(raw.as_buffer().to_pybytes(), _RUN if kind else _COUNT))
                if len(parts) > 1 and sum(map(len, parts[1:])) > max(1 << 16, len(parts[0])):
                    held[kind, b] = [_added(parts, "run" if kind else "h")]
        for (kind, b), parts in held.items():
            sums = _added(parts, "run" if kind else "h")
            n, v = (0, 0) if kind else (int(sums["c"].sum()), len(sums))
            blob = b"".join(sums[f].tobytes() for f in sums.dtype.names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([b], pa.int32()), pa.array([blob], pa.binary()), pa.array([n], pa.int64()), pa.array([v], pa.int64())], names=["kind", "bucket", "blob", "n", "v"]
            )

    gathered = train.select("t").mapInArrow(trimmed(count), _ROWS).repartition(tasks, "bucket")
    counted = tables.write("counts", gathered.mapInArrow(trimmed(total), "kind int, bucket int, blob binary, n bigint, v bigint"))
    sums = counted.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, n_distinct = sums["n"] or 0, sums["v"] or 0

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                r = _joined(raw.as_buffer().to_pybytes(), _COUNT)
                r = r[np.argsort(r["c"])[::-1][:VOCAB]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r["h"]).view(np.int64)), pa.array(r["c"].astype(np.int64))], names=["h", "c"])

    top = counted.where(F.col("kind") == TOKENS).select("blob").mapInArrow(frequent, "h bigint, c bigint").orderBy(F.desc("c"), "h").limit(VOCAB).toArrow()
    vocab, freq = top["h"].to_numpy().astype(np.int64).view(_U), top["c"].to_numpy().astype(np.int64)
    order = np.argsort(vocab)
    codes = Codes.build(vocab[order], freq[order], max(0, n_train - int(freq.sum())), n_train)
    shared = spark.sparkContext.broadcast(codes)

    # 2. counts of decisions
    slots_of = 2 << codes.slot_bits

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((HASHED, slots_of), np.uint32)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), LM_BYTES):
                h, row, _ = _tokens(data, offsets)
                bit, _, slots, _ = decisions(h, row, shared.value.find(h)[0], shared.value)
                slots <<= 1
                slots |= bit
                for k in range(HASHED):
                    np.add.at(counts[k], slots[k], np.uint32(1))
        yield from _blocks(counts.ravel())

    counts = _summed(train.select("t").mapInArrow(trimmed(decide), "block int, counts binary, wide int"), HASHED * slots_of, tasks)
    tables.release()
    lookups = spark.sparkContext.broadcast(lookup(counts.reshape(HASHED, -1, 2)))
    del counts

    # 3. scores token by token; texts ask the buckets for their runs and for the tokens that aren't broadcast
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        codes_, table_ = shared.value, lookups.value
        for batch in batches:
            name = (context.partitionId() << 32) + number
            number += 1
            held, parts, asks, ask_runs = batch.column(1).to_numpy(zero_copy_only=False), [], [], []
            segments = 0
            for a, b, data, offsets in text_chunks(batch.column(2), LM_BYTES):
                h, row, sizes = _tokens(data, offsets)
                sym, known = codes_.find(h)
                bit, odds, slots, at = decisions(h, row, sym, codes_)
                first, before, run = runs_of(h, row)
                owner = row[first]
                n_rows = b - a
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n_rows))))
                log_c = np.zeros(len(h))
                log_c[known] = np.log10(codes_.counts[sym[known]] + 1.0)
                parts.append(
                    (
                        stream(bit, odds, slots, at[ends], table_), np.append(at[first], at[-1]), owner + a, np.diff(ends), np.bincount(row[known], minlength=n_rows),
                        np.bincount(row, weights=log_c, minlength=n_rows), np.diff(offsets),
                    )
                )
                seg = np.cumsum(np.bincount(first, minlength=len(h))) - 1 + segments
                ask = np.empty(int((~known).sum()), _ASK)
                ask["h"], ask["seg"], ask["size"] = h[~known], seg[~known], sizes[~known]
                asks.append(ask)
                kinds = runs_counted(before, run, owner)[1]
                some = np.flatnonzero(before)
                ask = np.empty(len(some), _ASK_RUN)
                ask["h"], ask["run"], ask["seg"] = before[some], run[some], some + segments
                ask["own"] = np.where(held[a:b][owner[some]], 0, kinds[some])
                ask_runs.append(ask)
                segments += len(first)
            if not parts:
                continue
            streams, cuts, parts = [p[0] for p in parts], [p[1] for p in parts], [p[2:] for p in parts]
            logs = run_logs(streams, cuts)
            ids = batch.column(0)
            columns = [logs, *(np.concatenate([p[q] for p in parts]) for q in range(5)), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), held]
            types = [np.float64, np.int32, np.int64, np.int64, np.float64, np.int64, np.int64, np.uint8, np.uint8]
            home = len(logs).to_bytes(8, "little") + len(ids).to_bytes(8, "little") + b"".join(c.astype(t).tobytes() for c, t in zip(columns, types, strict=True))
            out = [(kind, *x) for kind, got in ((TOKENS, asks), (RUNS, ask_runs)) for x in _split(np.concatenate(got), bits)]
            yield _rows([HOME, *(k for k, _, _ in out)], [None, *(b for _, b, _ in out)], [name] * (1 + len(out)), [home, *(x for _, _, x in out)])

    scored = tables.write("scored", rows.mapInArrow(trimmed(score), _ROWS))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tokens, runs = None, np.empty(0, _COUNT), np.empty(0, _RUN)
        contexts, totals = np.empty(0, _U), np.empty(0, np.int64)

        def found(keys: np.ndarray, values: np.ndarray, sought: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(sought), np.int64)
            at = np.searchsorted(keys, sought)
            at[at == len(keys)] = 0
            return np.where(keys[at] == sought, values[at], 0).astype(np.int64)

        for batch in batches:
            for kind, b, name, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                data = raw.as_buffer().to_pybytes()
                if b != now:
                    now, tokens, runs, contexts = b, tokens[:0], runs[:0], contexts[:0]
                if name is None:
                    if kind == TOKENS:
                        tokens = _joined(data, _COUNT)
                    else:
                        runs = _joined(data, _RUN)
                        by = np.argsort(runs["h"], kind="stable")
                        contexts, first = np.unique(runs["h"][by], return_index=True)
                        totals = np.add.reduceat(runs["c"][by], first, dtype=np.int64)
                    continue
                if kind == TOKENS:
                    ask = _joined(data, _ASK)
                    got = [ask["seg"], found(tokens["h"], tokens["c"], ask["h"]), ask["size"]]
                else:
                    ask = _joined(data, _ASK_RUN)
                    others = found(contexts, totals, ask["h"]) - ask["own"]
                    some = others > 0
                    ask = ask[some]
                    got = [ask["seg"], found(runs["run"], runs["c"], ask["run"]) - (ask["own"] > 0), others[some]]
                order = np.argsort(got[0], kind="stable")
                if len(order):
                    blob = b"".join(x[order].astype(np.int32 if q != 1 else np.int64).tobytes() for q, x in enumerate(got))
                    yield _rows([kind], [None], [name], [blob])

    asked = scored.where(F.col("kind") != HOME)
    known = counted.select("kind", "bucket", F.lit(None).cast("bigint").alias("batch"), "blob")
    answers = known.unionByName(asked).repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("batch").asc_nulls_first()).mapInArrow(trimmed(answer), _ROWS)
    smoothing = float(np.log10(n_train + n_distinct + 1.0))
    # what is left for tokens outside the tree, the unseen class among them
    others = float(np.log(n_train + n_distinct + 1.0 - float((freq + 1).sum())))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[tuple[int, bytes]] = []

        def out() -> pa.RecordBatch:
            home = next(blob for kind, blob in held if kind == HOME)
            segs, n = (int.from_bytes(home[a : a + 8], "little") for a in (0, 8))
            at, got = 16, []
            for size, t in ((segs, np.float64), (segs, np.int32), (n, np.int64), (n, np.int64), (n, np.float64), (n, np.int64), (n, np.int64), (n, np.uint8), (n, np.uint8)):
                got.append(np.frombuffer(home, t, size, at))
                at += size * np.dtype(t).itemsize
            logs, owner, tokens, hits, base, n_bytes, ids, valid, held_out = got
            logs, hits, base, plain, replies = logs.copy(), hits.copy(), base.copy(), np.zeros(n), []
            for kind, blob in held:
                m = len(blob) // 16
                if kind == HOME:
                    continue
                seg, c, x = np.frombuffer(blob, np.int32, m), np.frombuffer(blob, np.int64, m, 4 * m), np.frombuffer(blob, np.int32, m, 12 * m)
                if kind == RUNS:
                    replies.append((seg, c, x))
                    continue
                logs += np.bincount(seg, weights=np.log(c + 1.0) - others, minlength=segs)
                base += np.bincount(owner[seg], weights=np.log10(c + 1.0), minlength=n)
                hits += np.bincount(owner[seg], weights=c > 0, minlength=n).astype(np.int64)
                # an unseen word is followed by its bytes and an end of eight bits
                plain += np.bincount(owner[seg], weights=np.where(c > 0, 0, 8 * (x + 1)), minlength=n)
            for seg, c, x in replies:
                logs[seg] = with_runs(logs[seg], c, x)
            score_ = np.bincount(owner, weights=logs, minlength=n) / np.log(10)
            length = np.where(n_bytes > 0, (plain - score_ * np.log2(10)) / np.maximum(n_bytes, 1), np.nan)
            columns = [
                pa.array(ids, mask=valid == 0), pa.array(held_out.astype(bool)), pa.array(tokens), pa.array(hits), pa.array(np.full(n, n_train, np.int64)), pa.array(base - tokens * smoothing),
                pa.array(score_), pa.array(length, mask=n_bytes == 0),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for kind, name, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if name != now:
                    if held:
                        yield out()
                    now, held = name, []
                held.append((kind, raw.as_buffer().to_pybytes()))
        if held:
            yield out()

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    homes = scored.where(F.col("kind") == HOME)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return homes.unionByName(answers).repartition(tasks, "batch").sortWithinPartitions("batch").mapInArrow(trimmed(gather), schema)
