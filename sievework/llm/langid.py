"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (elastic net),
then calibrated with one temperature.

* Document frequencies come from all training rows; they are summed per hashed
  feature, so what reaches the driver has the size of the feature space.
* The weights are fitted on the driver on at most ``sample_rows`` training rows,
  as many of each language (those with the least hashes of their ids; one row a
  language at least), a fifth of which sets the temperature.
* Prediction is one pass without a shuffle; the model has a fixed size.

Defined cases: text that is null, empty or without any letter gives the language
``und`` and score 0; training rows without a language are not used; with no
usable training row every prediction is ``und``; ids may be null or repeat; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.bytesarrays import trim_memory, trimmed

#: Characters of a text that are turned into features at a time.
PART = 1 << 16
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; built once a process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


@dataclass(frozen=True)
class LangIdParams:
    dims: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    sample_rows: int = 4000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    seed: int = 11


def features(text: str | None, p: LangIdParams) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of a whole text; nothing if it has no letter.

    Runs of other characters count as one blank, and there is one at either end.
    The text is read in parts of ``PART`` characters, which overlap by what an
    n-gram needs, so a very long text takes no more room than a part.
    """
    counts = np.zeros(p.dims, np.int64)
    found, before = False, np.full(1, 32, np.uint32)  # the characters that the next part's n-grams begin with
    fresh = 1  # how many of them aren't counted yet
    for a in range(0, len(text or ""), PART):
        points = np.frombuffer(text[a : a + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        found = found or bool(letter.any())
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= before[-1] != 32
        words = np.concatenate((before, np.where(letter, points, 32)[keep]))
        _count_grams(words, len(before) - fresh, counts, p)
        before, fresh = words[-max(p.orders) :], 0
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if before[-1] != 32:
        _count_grams(np.append(before, np.uint32(32)), len(before), counts, p)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _count_grams(words: np.ndarray, done: int, counts: np.ndarray, p: LangIdParams) -> None:
    """Adds the n-grams that end behind the first ``done`` characters."""
    wide = words.astype(np.uint64)
    grams = np.zeros(len(wide), np.uint64)
    for n in range(1, max(p.orders) + 1):
        if len(wide) < n:
            break
        m = len(wide) - n + 1
        grams = grams[:m] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :]
        if n in p.orders:
            mixed = (grams[max(0, done - n + 1) :] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % p.dims, minlength=p.dims)


@dataclass
class LangIdModel:
    params: LangIdParams
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        norm = np.sqrt(x @ x)
        return x / norm if norm > 0 else x

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = features(text, self.params)
        if not len(at) or not self.langs:
            return "und", 0.0
        z = (self.vector(at, counts) @ self.weights[at] + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max())
        k = int(np.argmax(z))
        return self.langs[k], float(min(1.0, e[k] / e.sum()))


def fit_ftrl(model: LangIdModel, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Sets weights and temperature from rows of (features, counts, class).

    Per-coordinate FTRL-proximal: only the coordinates of the row at hand are
    touched; a weight is zero unless its accumulated gradient exceeds l1. ``rows`` is emptied.
    """
    p, k = model.params, len(model.langs)
    z, n = np.zeros((p.dims + 1, k)), np.zeros((p.dims + 1, k))
    rng = np.random.default_rng(p.seed)
    mixed = [rows[i] for i in rng.permutation(len(rows))]
    # a fifth of each class gives the temperature; of fewer than five rows none
    left = {y: n // 5 for y, n in Counter(y for _, _, y in mixed).items()}
    held, used = [], []
    for row in mixed:
        (held if left[row[2]] > 0 else used).append(row)
        left[row[2]] -= 1
    vectors = [(np.append(a, np.int32(p.dims)), np.append(model.vector(a, c), 1.0).astype(np.float32), y) for a, c, y in used]
    del mixed, used, row
    rows.clear()

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= p.l1, 0.0, -(zs - np.sign(zs) * p.l1) / ((p.beta + np.sqrt(ns)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i in rng.permutation(len(vectors)):
            at, x, y = vectors[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            s = x @ w
            e = np.exp(s - s.max())
            g = e / e.sum()
            g[y] -= 1
            grad = np.outer(x, g)
            sigma = (np.sqrt(ns + grad * grad) - np.sqrt(ns)) / p.alpha
            z[at] = zs + grad - sigma * w
            n[at] = ns + grad * grad
    model.weights = weights(z, n).astype(np.float32)
    if held:
        logits = np.array([model.vector(a, c) @ model.weights[a] + model.weights[-1] for a, c, _ in held])
        classes = np.array([y for _, _, y in held])

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), classes]).mean())

        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))


def fit_langid(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", params: LangIdParams | None = None) -> LangIdModel:
    """Learns from all rows of ``train`` that have a language (see the module's notes)."""
    p = params or LangIdParams()
    df = train.where(F.col(lang_col).isNotNull()).select(
        # of id and text: ids may be null or repeat
        F.xxhash64(F.col(id_col), F.col(text_col), F.lit(p.seed)).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")
    )
    placed = F.col("h") / float(1 << 64) + 0.5

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df_, rows = np.zeros(p.dims + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                at, _ = features(text.as_py(), p)
                df_[at] += 1
                rows += len(at) > 0
        df_[p.dims] = rows
        at = np.flatnonzero(df_)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df_[at], pa.int64())], names=["f", "n"])

    found = df.select("t").mapInArrow(trimmed(count), "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    freq = np.zeros(p.dims + 1)
    freq[found["f"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + freq[p.dims]) / (1 + freq[: p.dims])) + 1

    # of each language the same number of rows, those with the smallest hashes: half as many again as
    # are wanted lie below a bound that follows from the language's number of rows; the row with the least hash always does
    sizes = [(r["l"], r["n"], r["least"]) for r in df.groupBy("l").agg(F.count("*").alias("n"), F.min(placed).alias("least")).collect()]
    share = max(1, p.sample_rows // max(1, len(sizes)))
    bounds = [(lang, max(least, min(1.0, 1.5 * (share + 10) / n))) for lang, n, least in sizes]
    langs: list[str] = []
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    if sizes:

        def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [features(t.as_py(), p) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in got], pa.list_(pa.int32()))],
                    names=["r", "l", "f", "c"],
                )

        upto = train.sparkSession.createDataFrame(bounds, "l string, bound double")
        near = df.join(F.broadcast(upto), "l").withColumn("r", F.when(placed >= F.col("bound"), F.when(placed == F.col("bound"), 1.0)).otherwise(placed / F.col("bound"))).where("r <= 1")
        picked = near.select("r", "t", "l").mapInArrow(trimmed(featurise), "r double, l string, f array<int>, c array<int>")
        # equal rows share a hash: the limit holds for them as well
        got = picked.orderBy("r", F.hash("f", "c"), "l").limit(2 * max(p.sample_rows, len(sizes))).toArrow().combine_chunks()
        # slices of two flat arrays: lists of Python numbers would take many times the room
        names = got["l"].to_pylist()
        langs = sorted(set(names))
        number = {lang: k for k, lang in enumerate(langs)}
        f, c = (got[x].combine_chunks() for x in ("f", "c"))
        ends, flat_f, flat_c = f.offsets.to_numpy(), f.values.to_numpy(), c.values.to_numpy()
        used: Counter[str] = Counter()
        for a, b, lang in zip(ends[:-1], ends[1:], names, strict=True):
            if b > a and used[lang] < share:
                used[lang] += 1
                rows.append((flat_f[a:b], flat_c[a:b], number[lang]))
        del got, f, c, flat_f, flat_c
    model = LangIdModel(p, langs if rows else [], idf)
    if rows:
        fit_ftrl(model, rows)
    del rows
    trim_memory()
    return model


def identify(docs: DataFrame, model: LangIdModel, text_col: str = "text", *, lang_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs`` with the predicted language and its calibrated probability.

    A kept column named like a new one is replaced by it.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in (lang_col, score_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # only texts go to Python and only predictions come back; the other columns stay where they are
    @F.arrow_udf("lang string, score double")
    def predicted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for text in texts:
                got = [shared.value.predict(t.as_py()) for t in text]
                yield pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["lang", "score"])
        finally:
            trim_memory()

    # marked so that a filter on what it returns doesn't predict once more
    found = predicted.asNondeterministic()(docs[text_col].cast("string"))
    df = docs.select(*(docs[c] for c in names), found.alias("__found"))
    return df.select(*(df[c] for c in names), df["__found.lang"].alias(lang_col), df["__found.score"].alias(score_col))


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of an id written as text, modulo m (null ids: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % m
