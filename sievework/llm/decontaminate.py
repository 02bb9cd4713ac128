"""Benchmark decontamination by templates (Spark expressions only).

Texts are canonicalised: numbers (parted from attached units), units and names
(capitalised words, wherever they stand, but function words) become typed
placeholders, the rest is lower-cased and loses its punctuation. Windows of five canonical words of
the documents are hash-joined with those of the benchmark. Matches on one
alignment (document position less item position) must agree on their slots: each
value in the item stands for the document's value at most of its places (of equally
many for the value itself, then for the one at the first place). A window counts if
each of its slots holds the item's own value or the one that stands for it; other
windows are lost, but not the rest of the alignment. Two values may stand for
the same one. A question with other numbers or names thus counts, a chance mixture
of similar phrases doesn't. A document is contaminated by an item if the windows
that count cover at least 0.8 of the item's distinct windows.

Each window row carries only a hash and, if it has slots, the hashes of their
values; texts are never shuffled. The benchmark's windows are broadcast if there
are at most ``BROADCAST_ROWS`` of them, else both sides are shuffled by the hash and one
of ``SALTS`` salts, so that a window which very many documents share meets in as many tasks.

An item of fewer than five words is one window of its own length, sought in all documents;
so few words hold no template, its slots must have the item's own values.

Defined cases: null or blank texts have no windows and match nothing; items with equal text
are judged once and reported each; documents with a null id are judged together under the null
id, as are documents that share an id; items are known by their text, so null or shared item ids lose none; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, COVERAGE = 5, 0.8
BROADCAST_ROWS = 1_000_000
SALTS = 32

# Words that count as units.
UNITS = (
    "kg|mg|lb|lbs|oz|km|cm|mm|mi|ft|inch|inches|mile|miles|meter|meters|metre|metres|kilometers|kilometres|gram|grams|kilogram|kilograms|pound|pounds"
    "|liter|liters|litre|litres|ml|gallon|gallons|hour|hours|minute|minutes|second|seconds|day|days|week|weeks|month|months|year|years|dollar|dollars"
    "|euro|euros|cent|cents|usd|eur|percent|mph|kmh|degrees|celsius|fahrenheit"
)
#: Words that are no names, capitalised or not. The rule looks at the word alone: a copy has the same template whatever surrounds it.
PLAIN_WORDS = (
    "a|about|after|all|also|although|an|and|any|are|as|assume|at|because|before|both|but|by|calculate|can|compute|consider|could|determine|did|do|does|each|either|every"
    "|explain|find|finally|first|for|from|give|given|had|has|have|he|her|here|his|how|however|i|if|in|into|is|it|its|let|many|most|much|my|no|not|now|of|on|once|one|only"
    "|or|other|our|out|over|she|should|show|since|so|solve|some|suppose|that|the|their|them|then|there|these|they|this|those|though|to|two|under|until|up|was|we|were"
    "|what|when|where|whether|which|while|who|whom|whose|why|with|without|would|write|yes|yet|you|your"
)
SPACE = r"[\x09-\x0D\x20]"
NUMBER_SLOT, UNIT_SLOT, NAME_SLOT = "\u0001", "\u0002", "\u0003"
SLOTS = NUMBER_SLOT + UNIT_SLOT + NAME_SLOT


def _canonical(text: Column) -> Column:
    """The text in lower case without punctuation; in front of each number and name stands the mark of its slot."""
    t = F.translate(text, SLOTS, "")
    # numbers are words of their own, be they joined to a unit or a sign
    t = F.regexp_replace(t, r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*+(?:[.,:/][0-9]++)*+", f" {NUMBER_SLOT}$0 ")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}\p{{M}}\x09-\x0D\x20{SLOTS}]+", "")
    return F.lower(F.regexp_replace(t, rf"(?<![^\x09-\x0D\x20])(?=\p{{Lu}})(?!(?i:{PLAIN_WORDS})(?![^\x09-\x0D\x20]))", NAME_SLOT))


def windows(df: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...] = (WINDOW,)) -> DataFrame:
    """``id, words, at, size, h, slots`` for each window of as many words as one of ``sizes``."""
    words = F.filter(F.split(_canonical(F.coalesce(F.col(text_col), F.lit(""))), SPACE, -1), lambda c: c != "")

    def typed(c: Column) -> Column:
        marked, unit = c < NAME_SLOT + "\uffff", c.isin(*UNITS.split("|"))
        return F.struct(
            F.when(marked, F.substring(c, 1, 1)).when(unit, UNIT_SLOT).otherwise(c).alias("c"), F.when(marked | unit, F.xxhash64(c)).alias("v")
        )

    kept = df.select(F.col(id_col).alias("id"), F.transform(words, typed).alias("t"))

    def of_size(size: int) -> Column:
        def window(i: Column) -> Column:
            each = [F.get(F.col("t"), i + k) for k in range(size)]
            values = [x["v"] for x in each]
            slotted = F.coalesce(*values, F.lit(None)).isNotNull()
            return F.struct(
                i.alias("at"),
                F.lit(size).alias("size"),
                F.xxhash64(*([] if size == WINDOW else [F.lit(size)]), *(x["c"] for x in each)).alias("h"),
                F.when(slotted, F.array(*values)).alias("slots"),
            )

        return F.when(F.size("t") >= size, F.transform(F.sequence(F.lit(0), F.greatest(F.size("t") - size, F.lit(0))), window))

    # inline_outer: of an inner one the optimizer would derive a filter that holds these expressions once more, inside the lambda
    one = of_size(sizes[0])
    made = one if len(sizes) == 1 else F.flatten(F.array_compact(F.array(*map(of_size, sizes))))
    return kept.select("id", F.size("t").alias("words"), made.alias("w")).select("id", "words", F.inline_outer("w")).where(F.col("h").isNotNull())


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, reparameterised``: one row per contaminated document and item.

    ``reparameterised``: some slot of the document holds another value than the item's.
    """
    text = F.col(item_text_col)
    # an item is known by its text: ids may be null, or stand for several texts
    named = benchmark.where(text.isNotNull()).select(text.alias("__t"), F.col(item_col).alias("__i"), F.substring(F.sha2(text.cast("string"), 256), 1, 32).alias("__k"))
    unique = named.groupBy("__k").agg(F.first("__t").alias("__t"))
    every = windows(unique, "__k", "__t", tuple(range(WINDOW, 0, -1)))
    of_items = every.where(F.col("size") == F.least("words", F.lit(WINDOW))).drop("words").withColumnsRenamed({"id": "item_id", "at": "i", "slots": "item_slots"})
    items = of_items.join(of_items.groupBy("item_id").agg(F.count_distinct("h").alias("n_windows")), "item_id")
    found = of_items.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    sizes = tuple(sorted(found["sizes"], reverse=True)) or (WINDOW,)
    probe = windows(docs, id_col, text_col, sizes).select(F.col("id").alias("doc_id"), "at", "h", "slots")
    if found["n"] <= BROADCAST_ROWS:
        hits = probe.join(F.broadcast(items), "h")
    else:
        salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = probe.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).drop("salt")
    none = F.array().cast("array<struct<a:bigint,p:bigint,b:bigint>>")
    # per slot of a window: the item's value, its place in the item, the document's value
    pairs = F.coalesce(
        F.filter(
            F.transform(F.arrays_zip("item_slots", "slots"), lambda z, k: F.struct(z["item_slots"].alias("a"), (F.col("i") + k).cast("bigint").alias("p"), z["slots"].alias("b"))),
            lambda s: s["a"].isNotNull(),
        ),
        none,
    )
    hits = hits.withColumn("pairs", pairs).where((F.col("size") == WINDOW) | F.forall("pairs", lambda s: s["a"].eqNullSafe(s["b"])))
    aligned = (
        hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("i")).alias("shift"))
        .agg(F.first("n_windows").alias("n_windows"), F.collect_set(F.struct("h", "pairs")).alias("found"))
        .withColumn("slots", F.array_distinct(F.flatten(F.transform("found", lambda w: w["pairs"]))))
        .withColumn("mapped", F.array_distinct(F.transform("slots", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))))
    )

    def rank(m: Column) -> Column:
        places = F.transform(F.filter("slots", lambda s: (s["a"] == m["a"]) & (s["b"] == m["b"])), lambda s: s["p"])
        return F.struct(m["a"].alias("a"), F.size(places).alias("n"), (m["a"] == m["b"]).alias("same"), (-F.array_min(places)).alias("first"), m["b"].alias("b"))

    # only where a value has several counterparts they are ranked
    split = F.size(F.array_distinct(F.transform("mapped", lambda m: m["a"]))) < F.size("mapped")
    ranked = F.when(split, F.transform("mapped", rank))
    lost = F.when(
        F.col("ranked").isNotNull(),
        F.transform(
            F.filter("ranked", lambda r: ~r["same"] & F.exists("ranked", lambda o: (o["a"] == r["a"]) & (o > r))),
            lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b")),
        ),
    ).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    counts = lambda w: ~F.exists(w["pairs"], lambda s: F.exists("lost", lambda x: (x["a"] == s["a"]) & (x["b"] == s["b"])))
    judged = (
        aligned.withColumn("ranked", ranked)
        .withColumn("lost", lost)
        .withColumn("found", F.filter("found", counts))
        .groupBy("doc_id", "item_id")
        .agg(
            F.first("n_windows").cast("bigint").alias("n_windows"),
            F.size(F.array_distinct(F.flatten(F.collect_set(F.transform("found", lambda w: w["h"]))))).cast("bigint").alias("n_matched"),
            F.bool_or(F.exists("found", lambda w: F.exists(w["pairs"], lambda s: s["a"] != s["b"]))).alias("reparameterised"),
        )
        .where(F.col("n_matched") >= COVERAGE * F.col("n_windows"))
    )
    # each item of an equal text
    copies = named.select(F.col("__k").alias("item_id"), "__i").distinct()
    return judged.join(copies, "item_id").select("doc_id", F.col("__i").alias("item_id"), "n_windows", "n_matched", "reparameterised")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    bad = contaminated_pairs(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")
