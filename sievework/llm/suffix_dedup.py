"""Removal of byte strings that occur earlier, by merging Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts earlier
(smaller document id, or same document and earlier start) is removed.

1. Each window of ``length`` bytes has an anchor: the least hash of its k-byte
   substrings. Runs of windows with one anchor are segments; equal windows have
   equal anchors at equal places, so they only have to be sought among segments
   of one anchor. Segments of one batch that are equal, byte for byte, are one segment
   with several places: the first goes on, the others are covered.
2. Anchors with one segment are done. So are segments of whole copies of a document (equal digests of
   the segment and of the whole text, at one place). The bytes of all others are brought together by
   anchor; hashes of windows narrow them down to runs of windows that may occur twice. Of runs that are
   equal, byte for byte, the first ``COPIES`` go on, so a passage in thousands of texts is little work.
3. Those runs are strings in shards. Each shard has its suffix array and its
   Burrows-Wheeler transform; these are merged by refining their interleave ``STRIDE``
   characters at a time: the refinement to depth h + ``STRIDE`` follows from that to depth h
   through the transforms alone, no suffix is compared or sorted again. Block
   boundaries carried along are the common prefixes; a block that shrinks to one
   suffix can't be repeated and leaves. The blocks left at depth ``length`` are the
   repeated intervals, equal strings among them; in each, all but the earliest occurrence are covered.
4. The covered runs of each document are united and cut out.

The bytes of one anchor's segments, each batch's distinct ones, meet in one task.

Defined cases: null text counts as empty; texts shorter than ``length`` lose
nothing; null ids come before all others; rows that share an id are ordered by a
hash of their text, rows equal in both are one document; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bytesarrays import BYTE_VALUE, POWERS, mix64, text_bytes, text_chunks, trim_memory
from sievework.llm.shared import Tables

ANCHOR = 20
CHUNK = 1 << 20
LEAST_BUCKETS = 512
SHARD_BYTES = 32 << 10
GROUP_BYTES = 128 << 10
#: Characters by which an interleave is refined at a time.
STRIDE = 5
#: Copies of one string that enter the shards; more are compared with the first.
COPIES = 4
_U = np.uint64
_NULL_ID = -(1 << 63)

_HEAD = np.dtype([("anchor", "u8"), ("seg", "u8"), ("id", "i8"), ("x", "i8"), ("lo", "i4"), ("run", "i4")])
_PIECE = np.dtype([("anchor", "u8"), ("id", "i8"), ("x", "i8"), ("lo", "i4"), ("run", "i4")])
_COVER = "id bigint, x bigint, lo int, hi int"


def _prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], dtype=_U, out=total[1:])
    return total, down


def _window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    total, down = _prefix_hash(data)
    return mix64((total[k:] - total[:-k]) * down[: len(data) - k + 1])


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (w - span)], h[w - span :]) if span < w else h


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: row, first window, windows, anchor, hash of all its bytes."""
    n = len(data)
    if n < length:
        e = np.empty(0, np.int64)
        return e, e, e, e.astype(_U), e.astype(_U)
    total, down = _prefix_hash(data)
    h = mix64((total[ANCHOR:] - total[:-ANCHOR]) * down[: n - ANCHOR + 1])
    # the leftmost of the least: equal but for their places, hashes are compared without their last bits
    bits = _U(max(22, n.bit_length()))
    least = _sliding_min(((h >> bits) << bits) | np.arange(len(h), dtype=_U), length - ANCHOR + 1)
    least &= (_U(1) << bits) - _U(1)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    whole = row[: n - length + 1] == row[length - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1 : len(least)] != row[: len(least) - 1])
    new |= ~whole
    starts = np.flatnonzero(new & whole)
    breaks = np.append(np.flatnonzero(new), len(least))
    ends = breaks[np.searchsorted(breaks, starts, "right")]
    runs = ends - starts
    seg = mix64((total[ends - 1 + length] - total[starts]) * down[starts] + runs.astype(_U))
    # mixed once more: the least of many hashes are small numbers, which would share few buckets
    return row[starts], starts - offsets[row[starts]], runs, mix64(h[least[starts].astype(np.int64)]), seg


def _planes(r: np.ndarray) -> bytes:
    """Records as planes of bytes: those that hardly differ, as the high bytes of ids, then compress."""
    return np.ascontiguousarray(r).view(np.uint8).reshape(len(r), -1).T.tobytes()


def _records(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel() for b in blobs]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _order(r: np.ndarray) -> np.ndarray:
    return np.lexsort((r["lo"], r["x"], r["id"], r["seg"], r["anchor"]))


def _settle(r: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments in order of (anchor, bytes, place), with whether each equals the one before: which are the first of their kind, which are covered (equal to an earlier one)."""
    first = np.ones(len(r), bool)
    first[1:] = ~same
    at = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    head = r[at]
    return first, (r["id"] != head["id"]) | (r["x"] != head["x"]) | (r["lo"] != head["lo"])


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` on and those from ``b`` on are equal, for each pair of places."""
    out = np.ones(len(a), bool)
    cuts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    k = 0
    while k < len(a):
        end = max(k + 1, int(np.searchsorted(cuts, cuts[k] + CHUNK, "right")) - 1)
        n, starts = sizes[k:end], cuts[k:end] - cuts[k]
        within = np.arange(cuts[end] - cuts[k]) - np.repeat(starts, n)
        differs = data[np.repeat(a[k:end], n) + within] != data[np.repeat(b[k:end], n) + within]
        out[k:end] = ~np.logical_or.reduceat(differs, starts)
        k = end
    return out


def shard_transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, transform and LF mapping of strings of bytes 1..255, each ended by a 0. The ends count as distinct, in their order."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    owner = np.searchsorted(ends, np.arange(n))
    left = ends[owner] - np.arange(n)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, _U)
    for j in range(8):
        key = (key << _U(8)) | np.where(j < left, padded[j : j + n], 0).astype(_U)
    tie = np.where(left < 8, owner + 1, 0)
    order = np.lexsort((tie, key))
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (tie[order][1:] != tie[order][:-1])
    rank = np.empty(n, np.int64)
    slots = np.flatnonzero(new)
    rank[order] = slots[np.cumsum(new) - 1]
    h = 8
    while True:
        # suffixes that share a rank, in order of it
        size = np.diff(np.append(slots, n))
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            break
        some = order[open_]
        pair = rank[some] * (n + 1) + rank[np.minimum(some + h, n - 1)]
        inner = np.argsort(pair, kind="stable")
        order[open_] = some[inner]
        p = pair[inner]
        where = np.flatnonzero(open_)
        change = np.ones(len(p), bool)
        change[1:] = p[1:] != p[:-1]
        new[where] = change
        slots = np.flatnonzero(new)
        rank[order] = slots[np.cumsum(new) - 1]
        h *= 2
    before = np.where(order > 0, text[order - 1], 0).astype(np.uint8)
    lf = np.where(order > 0, rank[order - 1], 0)
    return order, before, lf


def strides(before: np.ndarray, lf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A transform and its LF mapping by ``STRIDE`` characters: dense numbers of what stands before each suffix (0: not as much of its string), and the suffix that begins there."""
    grams, place = np.zeros(len(before), _U), np.arange(len(before))
    whole = np.ones(len(before), bool)
    for k in range(STRIDE):
        c = before[place]
        whole &= c > 0
        grams |= c.astype(_U) << _U(8 * k)
        place = lf[place]
    grams[~whole] = 0
    return grams, place


def _refined(place: np.ndarray, block: np.ndarray, key: np.ndarray, lf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of the refinement: ``key``, dense numbers of the characters before each suffix (0: none). Blocks of one suffix leave."""
    c = key[place]
    some = np.flatnonzero(c)
    if len(some) < len(c):
        c, place, block = c[some], place[some], block[some]
    if c.dtype.itemsize <= 2:  # by radix; in two halves if there are many keys
        order = np.argsort(c, kind="stable")
    else:
        order = np.argsort(c.astype(np.uint16), kind="stable")
        order = order[np.argsort((c[order] >> 16).astype(np.uint16), kind="stable")]
    c, block, place = c[order], block[order], place[order]
    new = np.ones(len(place) + 1, bool)
    np.not_equal(c[1:], c[:-1], out=new[1:-1])
    new[1:-1] |= block[1:] != block[:-1]
    several = np.flatnonzero(~(new[:-1] & new[1:]))
    return lf[place[several]], np.cumsum(new[:-1], dtype=np.int32)[several]


def merge_transforms(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Refines the interleave of shards (transform, LF mapping) to ``depth``.

    Returns the suffixes, as places in the shards' transforms laid end to end, of
    blocks of two and more that share ``depth`` characters, and their block numbers.
    """
    base = np.cumsum([0, *(len(b) for b, _ in shards)])
    before = np.concatenate([b for b, _ in shards])
    lf = np.concatenate([m + o for (_, m), o in zip(shards, base, strict=False)]).astype(np.int32)
    place = np.arange(base[-1], dtype=np.int32)
    block = np.zeros(base[-1], np.int32)
    for _ in range(depth % STRIDE):
        place, block = _refined(place, block, before, lf)
    if depth >= STRIDE and len(place):
        grams, jump = strides(before, lf)
        distinct, dense = np.unique(grams, return_inverse=True)
        dense += 1 if distinct[0] else 0  # 0 stays for what has no whole stride
        dense = dense.astype(np.uint16 if len(distinct) < 1 << 16 else np.uint32)
        jump = jump.astype(np.int32)
        for _ in range(depth // STRIDE):
            place, block = _refined(place, block, dense, jump)
            if not len(place):
                break
    return place, block


def _slices(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of pieces of about SHARD_BYTES, so that hashing needs little room beside the bytes."""
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(at, at[a] + SHARD_BYTES)))
        yield a, b
        a = b


def repeated_windows(pieces: np.ndarray, blobs: list, length: int) -> np.ndarray:
    """Covered runs (id, x, lo, hi) among strings: ``pieces`` (id, x, lo, run) with bytes of ``run + length - 1`` each."""
    data = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = pieces["run"] + length - 1
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    none = np.empty(0, np.dtype([("id", "i8"), ("x", "i8"), ("lo", "i4"), ("hi", "i4")]))
    if not len(data):
        return none
    wide = np.int32 if len(data) < 1 << 30 else np.int64
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), pieces["run"])
    within = np.arange(len(owner), dtype=wide) - np.repeat((np.cumsum(pieces["run"]) - pieces["run"]).astype(wide), pieces["run"])
    starts = at.astype(wide)[owner] + within
    sought = np.empty(len(owner), _U)
    windows = np.concatenate(([0], np.cumsum(pieces["run"])))
    for a, b in _slices(at, len(data)):
        part = slice(windows[a], windows[b])
        sought[part] = _window_hashes(data[at[a] : at[b - 1] + sizes[b - 1]], length)[starts[part] - at[a]]
    order = np.argsort(sought, kind="stable")
    equal = sought[order][1:] == sought[order][:-1]
    wanted = np.zeros(len(sought), bool)
    wanted[order[1:][equal]] = True
    wanted[order[:-1][equal]] = True
    if not wanted.any():
        return none
    # runs of wanted windows become strings
    opens = wanted.copy()
    opens[1:] &= ~(wanted[:-1] & (owner[1:] == owner[:-1]))
    first = np.flatnonzero(opens)
    runs = np.diff(np.append(np.cumsum(wanted)[first] - 1, wanted.sum()))
    lens = runs + length - 1
    begin = starts[first]
    owner, within = owner[first], within[first]
    strings = np.empty(len(first), _HEAD)
    strings["id"], strings["x"], strings["lo"], strings["run"] = pieces["id"][owner], pieces["x"][owner], pieces["lo"][owner] + within, runs
    # of a string that very many texts hold the first COPIES go on, the others, equal to the first byte for byte, are covered
    places = np.cumsum(runs) - runs
    placed = sought[wanted] * ((np.arange(wanted.sum(), dtype=_U) - np.repeat(places.astype(_U), runs)) * _U(2) + _U(1))
    strings["anchor"], strings["seg"] = 0, mix64(np.add.reduceat(placed, places) + runs.astype(_U))
    order = _order(strings)
    begin, lens, strings = begin[order], lens[order], strings[order]
    at = np.flatnonzero(strings["seg"][1:] != strings["seg"][:-1]) + 1
    head = np.repeat(np.concatenate(([0], at)), np.diff(np.concatenate(([0], at, [len(strings)]))))
    more = np.flatnonzero((np.arange(len(strings)) - head >= COPIES) & (lens == lens[head]))
    more = more[_equal_bytes(data, begin[more], begin[head[more]], lens[more])]
    known = np.empty(len(more), none.dtype)
    known["id"], known["x"], known["lo"], known["hi"] = strings["id"][more], strings["x"][more], strings["lo"][more], strings["lo"][more] + lens[more]
    rest = np.ones(len(strings), bool)
    rest[more] = False
    begin, lens, strings = begin[rest], lens[rest], strings[rest]
    del placed, sought, wanted, opens, starts, equal
    ends = np.cumsum(lens + 1)
    text = np.zeros(ends[-1], np.uint8)
    at = ends - lens - 1
    index = np.arange(ends[-1], dtype=wide) - np.repeat((at - begin).astype(wide), lens + 1)
    text[:] = data[np.minimum(index, len(data) - 1)] + np.uint8(1)
    del index
    text[ends - 1] = 0
    # shards of whole strings
    cuts = np.unique(np.searchsorted(ends, np.arange(SHARD_BYTES, ends[-1] + SHARD_BYTES, SHARD_BYTES)) + 1)
    shards, suffixes, done = [], [], 0
    for cut in cuts:
        end = ends[min(cut, len(ends)) - 1]
        if end > done:
            order, before, lf = shard_transform(text[done:end])
            shards.append((before, lf))
            suffixes.append(order + done)
            done = end
    place, block = merge_transforms(shards, length)
    if not len(place):
        return known
    where = np.concatenate(suffixes)[place]
    string = np.searchsorted(ends, where, "right")
    ids, xs = strings["id"][string], strings["x"][string]
    lo = strings["lo"][string] + (where - at[string])
    key = np.lexsort((lo, xs, ids, block))
    head = np.ones(len(key), bool)
    head[1:] = block[key][1:] != block[key][:-1]
    lead = key[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    later = (ids[key] != ids[lead]) | (xs[key] != xs[lead]) | (lo[key] != lo[lead])
    hit, lo = string[key][later], lo[key][later]
    # consecutive windows of one string are one run
    order = np.lexsort((lo, hit))
    hit, lo = hit[order], lo[order]
    new = np.ones(len(lo) + 1, bool)
    new[1:-1] = (hit[1:] != hit[:-1]) | (lo[1:] > lo[:-1] + 1)
    opened = np.flatnonzero(new)
    out = np.empty(len(opened) - 1, none.dtype)
    out["id"], out["x"] = strings["id"][hit[opened[:-1]]], strings["x"][hit[opened[:-1]]]
    out["lo"], out["hi"] = lo[opened[:-1]], lo[opened[1:] - 1] + length
    return np.concatenate([known, out])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Buffer]]]:
    """Blobs of each bucket, from rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != now:
                if held:
                    yield now, held
                now, held = b, []
            held.append(blob.as_buffer().to_pybytes())
    if held:
        yield now, held


def _by_anchor(blobs: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[memoryview]]]:
    """The pieces of a bucket and their bytes, in groups of about GROUP_BYTES that keep the pieces of an anchor together."""
    pieces, parts = [], []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        own = np.frombuffer(blob, _PIECE, n, 8)
        view, at = memoryview(blob), 8 + n * _PIECE.itemsize
        for size in (own["run"] + length - 1).tolist():
            parts.append(view[at : at + size])
            at += size
        pieces.append(own)
    every = np.concatenate(pieces)
    order = np.argsort(every["anchor"], kind="stable")
    every = every[order]
    upto = np.cumsum(every["run"] + length - 1)
    ends = np.append(np.flatnonzero(every["anchor"][1:] != every["anchor"][:-1]) + 1, len(every))
    done = 0
    for k, end in enumerate(ends):
        last = k == len(ends) - 1
        if last or upto[ends[k + 1] - 1] - (upto[done - 1] if done else 0) > GROUP_BYTES:
            yield every[done:end], [parts[i] for i in order[done:end]]
            done = end


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row, and ``kept`` (binary) if asked for."""
    spark = docs.sparkSession
    tables = Tables(spark, "suffix-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("x"), text.alias("t"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(LEAST_BUCKETS.bit_length() - 1, (4 * tasks - 1).bit_length())
    shift = _U(64 - buckets.bit_length() + 1)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs, found, begin = _ids(batch.column(0)), batch.column(1).to_numpy(), [], []
            for a, b, data, offsets in text_chunks(batch.column(2), CHUNK):
                row, lo, runs, anchor, seg = segments(data, offsets, length)
                part = np.empty(len(row), _HEAD)
                part["anchor"], part["seg"], part["lo"], part["run"] = anchor, seg, lo, runs
                part["id"], part["x"] = ids[a:b][row], xs[a:b][row]
                found.append(part)
                begin.append(row + a)
            r = np.concatenate(found) if found else np.empty(0, _HEAD)
            order = _order(r)
            r = r[order]
            offsets, data = text_bytes(batch.column(2))
            place = offsets[np.concatenate(begin)[order]] + r["lo"] if found else np.empty(0, np.int64)
            same = (r["anchor"][1:] == r["anchor"][:-1]) & (r["seg"][1:] == r["seg"][:-1]) & (r["run"][1:] == r["run"][:-1])
            at = np.flatnonzero(same)
            same[at] = _equal_bytes(data, place[at], place[at + 1], r["run"][at] + np.int64(length - 1))
            first, covered = _settle(r, same)
            covered = r[covered]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(covered), pa.int32()),
                    pa.nulls(len(covered), pa.binary()),
                    *(pa.array(np.ascontiguousarray(v)) for v in (covered["id"], covered["x"], covered["lo"], covered["lo"] + covered["run"] - 1 + np.int32(length))),
                ],
                names=["bucket", "blob", "id", "x", "lo", "hi"],
            )
            r = r[first]
            # in order of the anchor already: its leading bits are the bucket
            cuts = np.searchsorted((r["anchor"] >> shift).astype(np.int64), np.arange(buckets + 1))
            blobs = [(b, _planes(r[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts)).tolist()]
            none = pa.nulls(len(blobs), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary()), none, none, none.cast(pa.int32()), none.cast(pa.int32())],
                names=["bucket", "blob", "id", "x", "lo", "hi"],
            )
        trim_memory()

    seen = tables.write("anchors", rows.mapInArrow(anchors, f"bucket int, blob binary, {_COVER}"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches):
            r = _records(blobs, _HEAD)
            order = np.argsort(r["anchor"], kind="stable")
            a = r["anchor"][order]
            equal = a[1:] == a[:-1]
            some = np.zeros(len(a), bool)
            some[1:] |= equal
            some[:-1] |= equal
            r = r[order[some]]
            # copies of whole documents: equal texts by their digests, equal segments at one place
            r = r[np.lexsort((r["id"], r["lo"], r["x"], r["seg"], r["anchor"]))]
            same = (r["anchor"][1:] == r["anchor"][:-1]) & (r["seg"][1:] == r["seg"][:-1]) & (r["x"][1:] == r["x"][:-1]) & (r["lo"][1:] == r["lo"][:-1])
            first, covered = _settle(r, same)
            # of anchors with several others the bytes are wanted
            new = np.ones(len(r), bool)
            new[1:] = r["anchor"][1:] != r["anchor"][:-1]
            group = np.cumsum(new) - 1
            many = first & (np.bincount(group, weights=first, minlength=1)[group] > 1) if len(r) else first
            for mask, asked in ((covered, False), (many, True)):
                q = r[mask]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(q["anchor"].view(np.int64) if asked else None, pa.int64()) if asked else pa.nulls(len(q), pa.int64()),
                        *(pa.array(np.ascontiguousarray(v)) for v in (q["id"], q["x"], q["lo"], q["lo"] + q["run"] - 1 + np.int32(length))),
                    ],
                    names=["anchor", "id", "x", "lo", "hi"],
                )

    by_anchor = seen.where("bucket is not null").select("bucket", "blob").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    settled = tables.write("settled", by_anchor.mapInArrow(settle, f"anchor bigint, {_COVER}"))

    early = tables.write("early", seen.where("bucket is null").select("id", "x", "lo", "hi"))
    tables.drop("anchors")
    # the bytes of segments that differ
    asked = settled.where("anchor is not null").groupBy("id", "x").agg(F.collect_list(F.struct("anchor", "lo", "hi")).alias("q"))
    keyed = rows.withColumn("id", F.coalesce("id", F.lit(_NULL_ID)))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(3)
            counts = np.diff(q.offsets.to_numpy())
            flat = q.flatten()
            anchor = flat.field(0).to_numpy().view(_U)
            lo, hi = flat.field(1).to_numpy(), flat.field(2).to_numpy()
            r = np.empty(len(lo), _PIECE)
            r["anchor"], r["lo"], r["run"] = anchor, lo, hi - lo - length + 1
            r["id"], r["x"] = np.repeat(batch.column(0).to_numpy(), counts), np.repeat(batch.column(1).to_numpy(), counts)
            texts = batch.column(2).cast(pa.large_string())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :]
            data = np.frombuffer(texts.buffers()[2], np.uint8)
            begin = np.repeat(offsets[: len(counts)], counts) + lo
            bucket = (anchor >> shift).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[b] : cuts[b + 1]]
                if len(mine):
                    out.append((b, len(mine).to_bytes(8, "little") + r[mine].tobytes() + b"".join(data[begin[i] : begin[i] + hi[i] - lo[i]].tobytes() for i in mine)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches):
            for pieces, data in _by_anchor(blobs, length):
                got = repeated_windows(pieces, data, length)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[c])) for c in ("id", "x", "lo", "hi")], names=["id", "x", "lo", "hi"])
        trim_memory()

    brought = keyed.join(asked, ["id", "x"]).select("id", "x", "t", "q").mapInArrow(fetch, "bucket int, blob binary")
    merged = tables.write("merged", brought.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, _COVER))

    covers = early.unionAll(settled.where("anchor is null").select("id", "x", "lo", "hi")).unionAll(merged)
    spans = covers.groupBy("id", "x").agg(F.collect_set(F.struct("lo", "hi")).alias("q"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for raw, q in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                text_ = memoryview(raw.as_buffer())
                parts, at, removed, runs = [], 0, 0, 0
                if q.is_valid:
                    lo, hi = (q.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order])
                    opens = np.flatnonzero(np.concatenate(([True], lo[1:] > reach[:-1])))
                    ends = reach[np.append(opens[1:], len(lo)) - 1]
                    for s, e in zip(lo[opens].tolist(), ends.tolist(), strict=True):
                        parts.append(text_[at:s])
                        at, removed, runs = e, removed + e - s, runs + 1
                parts.append(text_[at:])
                digest = hashlib.sha256()
                for part in parts:
                    digest.update(part)
                out.append((len(text_), removed, runs, digest.hexdigest(), b"".join(parts) if keep_text else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [batch.column(0), *(pa.array(v, t) for v, t in zip(columns, types, strict=True))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if keep_text else 5], names=names[: 6 if keep_text else 5])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    final = keyed.join(spans, ["id", "x"], "left").select(F.when(F.col("id") != _NULL_ID, F.col("id")).alias("id"), "t", "q")
    return final.mapInArrow(cut, schema)
