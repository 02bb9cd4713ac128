"""HTML expressions on built-in patterns: one pass per pattern, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import squeeze, strip_tags

#: Elements whose content is never text of the page.
NOISE = r"(?s)<(script|style|header|footer|nav|aside)[^>]*>.*?</\1>"


def clean_html(html: Column) -> Column:
    """Text without boilerplate elements; headings become ``#`` lines; one line a block."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), NOISE, "")
    for level in range(1, 7):
        x = F.regexp_replace(x, rf"(?s)<h{level}[^>]*>\s*(.*?)\s*</h{level}>", "\n" + "#" * level + " $1\n")
    lines = F.transform(F.split(F.regexp_replace(x, r"<[^<]+?>", "\n"), "\n"), lambda line: F.trim(line))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def element(html: Column, name: str) -> Column:
    """Content of the first element of that name, '' if there is none."""
    return F.regexp_extract(html, rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)


def readable(html: Column) -> Column:
    """Text of the article, else of the main element, else of the page, without scripts and styles."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</\1>", "")
    inner = F.coalesce(*(F.when(element(bare, n) != "", element(bare, n)) for n in ("article", "main")), bare)
    return squeeze(F.regexp_replace(inner, r"<[^<]+?>", " "))


def title_of(html: Column) -> Column:
    h1 = strip_tags(element(html, "h1"))
    return F.when(h1 != "", h1).otherwise(strip_tags(element(html, "title")))

