"""Text expressions: tokens, sentences, cleaning, truncation, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import packing

# Abbreviations after which a sentence goes on, and where sentences end.
ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "vs", "etc", "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.",
    "e.g", "i.e", "cf", "viz", "al", "ca", "v", "no.", "ed.", "eds.",
]
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s+(?=\d)|(?<=\n)\s*"


def tokens(text: Column) -> Column:
    """Lower-cased words (letters, digits, marks, underscore) without pure numbers."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(words, lambda w: ~F.regexp_like(w, F.lit(r"^(?U)\d+$")))


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_outer(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _quote(abbreviation: str) -> str:
    return abbreviation.replace(".", r"\.")


_SHORTENED = "|".join(_quote(a) for a in ABBREVIATIONS)
#: Where a sentence ends, but for the full stop of an abbreviation.
_BREAK = rf"(?<!\b(?:{_SHORTENED})\. ?)(?:{SENTENCE_BREAK})"


def raw_sentences(text: Column) -> Column:
    """Sentences before short ones are merged. An abbreviation comes out in lower case, and what follows it on the same line."""
    spelled = text
    for a in ABBREVIATIONS:
        spelled = F.regexp_replace(spelled, rf"(?i)\b{_quote(a)}\.\s+", f"{a}. ")
    # sought from the full stop backwards: few places of a text have one
    some = F.regexp_like(text, F.lit(rf"(?i)\.\s(?<=\b(?:{_SHORTENED})\.\s)"))
    parts = F.when(some, F.split(spelled, _BREAK)).otherwise(F.split(text, SENTENCE_BREAK))
    return F.filter(F.transform(parts, squeeze), lambda p: p != "")


def merge_short(sentences: Column, min_words: int = 5) -> Column:
    """Sentences of fewer words join the one before. A sentence's own length says whether it opens a part, so each part is one slice."""
    places = F.sequence(F.lit(0), F.size(sentences) - 1)
    opens = F.filter(places, lambda i: (i == 0) | (F.size(F.split(F.get(sentences, i), " ")) >= min_words))

    def part(at: Column, k: Column, every: Column) -> Column:
        return F.array_join(F.slice(sentences, at + 1, F.coalesce(F.get(every, k + 1), F.size(sentences)) - at), " ")

    # bound once: the array of openings stands in a struct that a transform passes on
    bound = F.transform(F.array(opens), lambda every: F.transform(every, lambda at, k: part(at, k, every)))
    return F.when(F.size(sentences) > 0, F.get(bound, F.lit(0))).otherwise(F.array().cast("array<string>"))


def chunks(sentences: Column, size: int, overlap: int) -> Column:
    """Sentences packed into chunks; a chunk begins with the last whole sentences of the one before that fit ``overlap`` (one at least)."""

    def begins(above, sums: Column, i: Column) -> Column:
        return F.greatest(F.lit(0), F.least(i - 1, above(F.get(sums, i) - 2 - overlap)))

    def ends(above, sums: Column, i: Column) -> Column:
        return above(F.get(sums, begins(above, sums, i)) + size + 1) - 1

    return packing.packed(sentences, lambda s: F.length(s) + 1, ends, begins, " ")


def merge_small(parts: Column, least: int) -> Column:
    """Texts of fewer than ``least`` characters take in the next one."""
    ends = lambda above, sums, i: above(F.get(sums, i) + least)
    return packing.packed(parts, lambda s: F.length(s) + 1, ends, lambda above, sums, i: i, " ")


def pages(paragraphs: Column, size: int) -> Column:
    """Paragraphs packed into pages of ``size`` characters, a paragraph's break counted as two."""
    ends = lambda above, sums, i: above(F.get(sums, i) + size) - 1
    return packing.packed(paragraphs, lambda s: F.length(s) + 2, ends, lambda above, sums, i: i, "\n")


def strip_tags(text: Column) -> Column:
    """Tags dropped, white space collapsed; character references stay."""
    return squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^<]+?>", ""))


def sanitize(text: Column, limit: int = 10_000) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.substring(F.regexp_replace(clean, r"<[^>]+>", ""), 1, limit)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def truncate_simple(text: Column, limit: int) -> Column:
    estimate = F.floor(F.length(text) / 4)
    keep = F.floor(F.length(text) * (F.lit(float(limit)) / estimate)).cast("int")
    return F.when(estimate > limit, F.substring(text, F.lit(1), keep)).otherwise(text)


def truncate_smart(text: Column, limit: int, separator: str = r"\n\n+", joiner: str = "\n\n") -> Column:
    """The first paragraphs, as many as the share of the limit; at least one."""
    estimate = F.floor(F.length(text) / 4)
    parts = F.split(text, separator)
    keep = F.greatest(F.lit(1), F.floor(F.size(parts) * (F.lit(float(limit)) / estimate)).cast("int"))
    return F.when(estimate > limit, F.array_join(F.slice(parts, F.lit(1), keep), joiner)).otherwise(text)


def normal_md5(text: Column) -> Column:
    return F.md5(F.lower(strip_outer(text)))
