"""Extraction by a parser: selectors, result pages of search engines, links, and the extension point for extractors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.operators import dom

SILENT = frozenset(("script", "style"))


def select_text(html: str | None, selector: str) -> str:
    """Text of the first element that matches, without scripts and styles; '' if there is none."""
    for node in dom.select(dom.parse(html), selector):
        return dom.text_of(node, skip=SILENT)
    return ""


@dataclass(frozen=True)
class Selectors:
    """What a site's pages hold where; a field without a selector is null."""

    title: str = "h1"
    text: str = "article, .content, main"
    author: str | None = None
    date: str | None = None

    def extract(self, html: str | None) -> dict[str, str | None]:
        tree = dom.parse(html)

        def first(selector: str | None, separator: str = "") -> str | None:
            node = next(dom.select(tree, selector), None) if selector else None
            return None if node is None else dom.text_of(node, skip=SILENT, separator=separator)

        return {"title": first(self.title), "author": first(self.author), "date": first(self.date), "text": first(self.text, " ") or ""}


# ---- result pages


@dataclass(frozen=True)
class ResultLayout:
    """Selectors of a result page: a result's title link, what encloses a result, its address (first that is there) and snippet."""

    title: str
    result: str
    url: tuple[str, ...]
    snippet: tuple[str, ...]
    target: str | None = None  # the parameter of a redirect that holds the address
    refused: tuple[str, ...] = ()  # parts of addresses that are no results


# How result pages are marked up.
RESULT_LAYOUTS = {
    "searx": ResultLayout("article h3 a, article a[class*=result-title]", "article[class*=result]", ("a[class*=url][href]", "h3 a[href]"), ("p[class*=result-content]", "span[class*=content]")),
    "duckduckgo": ResultLayout("a[class*=result__a]", "div[class*=result]", ("a[class*=result__a][href]",), ("a[class*=result__snippet]",), "uddg", ("y.js?", "ad_domain=", "duckduckgo.com")),
}
# What pages say that refuse to answer; parts of addresses that lead back to the search or nowhere; the shortest title.
REFUSALS = re.compile(r"Too Many Requests|Rate limit|\b(?i:http|error|status|code)\W{1,3}429\b|(?:^|<(?:title|h\d|p|body)\b[^>]*>)\s*429\s*(?:<|$)")
NO_RESULT = ("search?", "page=", "javascript:", "mailto:")
LEAST_TITLE = 5


def _address(href: str, target: str | None) -> str:
    href = href.strip()
    inner = parse_qs(urlsplit(href).query).get(target) if target and f"{target}=" in href else None
    return inner[0] if inner else "https:" + href if href.startswith("//") else href


def result_rows(html: str | None, layout: str = "searx") -> list[dict[str, str]]:
    """``url, title, snippet`` of the results on a page, in order; a result without address or title is left out.

    A result is found by its title link: what encloses it innermost is the result. Texts keep their character references.
    """
    spec, seen, out = RESULT_LAYOUTS[layout], set(), []
    for link in dom.select(dom.parse(html), spec.title):
        result = dom.closest(link, spec.result)
        if result is None or id(result) in seen:
            continue
        seen.add(id(result))
        found = next((n for s in spec.url for n in dom.select(result, s)), None)
        url = _address(found.attrs.get("href", ""), spec.target) if found else ""
        title = dom.text_of(link, decode=False)
        if not url or not title or any(part in url for part in spec.refused):
            continue
        about = next((n for s in spec.snippet for n in dom.select(result, s)), None)
        out.append({"url": url, "title": title, "snippet": dom.text_of(about, decode=False) if about else ""})
    return out


def link_rows(html: str | None) -> list[dict[str, str]]:
    """``url, title, snippet`` ('') of the absolute links of any page with plain titles, each address once: what a page of unknown layout offers."""
    out: dict[str, dict[str, str]] = {}
    for link in dom.select(dom.parse(html), "a[href]"):
        url = link.attrs["href"].strip()
        title = dom.text_of(link, decode=False)
        raw = sum(len(piece) for part in link.parts if isinstance(part, list) for piece in part)
        if not url.lower().startswith(("http://", "https://")) or any(part in url.lower() for part in NO_RESULT):
            continue
        if link.elements or raw < LEAST_TITLE or len(title) < 3:
            continue
        out.setdefault(url, {"url": url, "title": title, "snippet": ""})
    return list(out.values())


def refuses(html: str | None) -> bool:
    """Whether a page says that it refuses. The status counts where it stands as one, not in numbers, texts and addresses of results."""
    return REFUSALS.search(html or "") is not None


def search_page(html: str | None, layout: str, most: int | None = None) -> list[dict[str, str]]:
    """Results by the layout, else by links; none if the page refuses. ``most``: as many at most (the searcher's limit)."""
    if refuses(html):
        return []
    return (result_rows(html, layout) or link_rows(html))[:most]


# ---- on tables


def extract_with(pages: DataFrame, key: str, html: str, extractor: Callable[[str | None], dict[str, str | None]], fields: list[str]) -> DataFrame:
    """Runs a user's extractor (html -> fields) over Arrow batches: the extension point for extractors."""
    return extract_rows(pages, key, html, lambda x: [extractor(x)], fields).drop("pos")


def extract_rows(pages: DataFrame, key: str, html: str, extractor: Callable[[str | None], list[dict[str, str | None]]], fields: list[str]) -> DataFrame:
    """Runs an extractor that gives any number of rows (``fields``) a page; each has the page's key and its place, ``pos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, pos, row) for k, x in enumerate(batch.column(1)) for pos, row in enumerate(extractor(x.as_py()))]
            keys = batch.column(0).take(pa.array([k for k, _, _ in rows], pa.int64()))
            columns = [pa.array([row.get(f) for _, _, row in rows], pa.string()) for f in fields]
            yield pa.RecordBatch.from_arrays([keys, pa.array([pos for _, pos, _ in rows], pa.int32()), *columns], names=[key, "pos", *fields])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, pos int, " + ", ".join(f"`{f}` string" for f in fields))
