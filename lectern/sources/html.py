"""Snapshots of captured HTML pages: title, dates, body text, links, access level."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_SKIP = {"script", "style", "noscript", "svg", "form", "button", "nav", "footer"}
_BREAK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "blockquote"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Body roots by priority: a root is an element name, or a class that the element has.
ROOTS = (".markup", ".post-content", ".available-content", "article", "main", "body")


class _Page(HTMLParser):
    """Collects the page's metadata, and the text and links of every root that is open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.stack: list[tuple[str, list[int]]] = []
        self.skip, self.title, self.h1, self.script = 0, "", "", ""
        self.roots: list[tuple[int, list[str], list[tuple[str, str]]]] = []
        self.link: list | None = None
        self.series: str | None = None
        self.series_text: str | None = None  # of an open link to a series
        self.in_title = self.in_h1 = self.in_json = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := a.get("property") or a.get("name")):
            self.meta.setdefault(name, a.get("content", ""))
        if tag == "link" and a.get("rel") == "canonical":
            self.meta["canonical"] = a.get("href", "")
        self.in_json |= tag == "script" and a.get("type") == "application/ld+json"
        if tag in _BREAK:
            self._add("\n")
        if tag in _VOID:
            return
        classes = a.get("class", "").split()
        own = []
        for rank, root in enumerate(ROOTS):
            if root == tag or root[0] == "." and root[1:] in classes:
                own.append(len(self.roots))
                self.roots.append((rank, [], []))
        self.stack.append((tag, own))
        self.skip += tag in _SKIP
        self.in_title |= tag == "title"
        self.in_h1 |= tag == "h1" and not self.h1
        if tag == "a" and a.get("href") and not self.skip:
            self.link = [a["href"], ""]
        if tag == "a" and "/s/" in a.get("href", ""):
            self.series_text = ""

    def handle_endtag(self, tag):
        if tag == "a" and self.series_text is not None:
            name, self.series_text = " ".join(self.series_text.split()), None
            if self.series is None and 0 < len(name) <= 120:
                self.series = name
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, _ = self.stack.pop()
            self.skip -= t in _SKIP
            if t == "a" and self.link:
                for i in self._open():
                    self.roots[i][2].append((" ".join(self.link[1].split()), self.link[0]))
                self.link = None
            if t == tag:
                break
        self.in_title &= tag != "title"
        self.in_h1 &= tag != "h1"
        self.in_json &= tag != "script"
        if tag in _BREAK:
            self._add("\n")

    def _open(self) -> list[int]:
        return [i for _, own in self.stack for i in own]

    def _add(self, text: str) -> None:
        if not self.skip:
            for i in self._open():
                self.roots[i][1].append(text)

    def handle_data(self, data):
        if self.in_json:
            self.script += data
        if self.in_title:
            self.title += data
        if self.in_h1:
            self.h1 += data
        if self.link:
            self.link[1] += data
        if self.series_text is not None:
            self.series_text += data
        self._add(data)


def snapshot(html: str | None, url: str | None) -> tuple:
    """(canonical_url, title, published, author, text, word_count, links, n_links, access_level) of one page.

    The body is the longest root of the first kind that the page has.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    best = max((r for r in page.roots if r[0] == min(x[0] for x in page.roots)), key=lambda r: len("".join(r[1])), default=(0, [], []))
    lines = [" ".join(x.split()) for x in "".join(best[1]).split("\n")]
    text = "\n".join(x for x in lines if x)
    try:
        data = json.loads(page.script) if page.script.strip() else {}
    except ValueError:
        data = {}
    data = data[0] if isinstance(data, list) and data else data
    data = data if isinstance(data, dict) else {}
    links = list(dict.fromkeys((a, u) for a, u in best[2] if a and not u.startswith("#")))
    words = len(text.split())
    free = str(data.get("isAccessibleForFree", "true")).lower() != "false"
    level = "PARTIAL_PREVIEW" if not free or "subscribe to continue reading" in text.lower() else "TITLE_ONLY" if words < 20 else "FULL_PUBLIC"
    title = (page.meta.get("og:title") or page.h1 or page.title).strip()
    return page.meta.get("canonical") or url, " ".join(title.split()), data.get("datePublished") or page.meta.get("article:published_time"), page.meta.get("author"), text, words, [{"anchor": a, "url": u} for a, u in links], len(links), level


def series_name(html: str | None) -> str | None:
    """The text of the first link to a series (/s/) that has one of at most 120 characters."""
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.series


def series_names(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and series of each page, null without one."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "series": [series_name(h) for h in b[html]]})

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, series string")


def snapshots(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """One row for each page; pages are parsed in batches by the standard library's parser."""
    names = ["canonical_url", "title", "published_date", "author", "text", "word_count", "links", "n_links", "access_level"]

    def run(batches):
        for b in batches:
            rows = [snapshot(h, u) for h, u in zip(b[html], b[url])]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, key, b[key].to_numpy())
            yield out

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, url, html).mapInPandas(run, f"{key} {kind}, canonical_url string, title string, published_date string, author string, text string, word_count int, links array<struct<anchor: string, url: string>>, n_links int, access_level string")
