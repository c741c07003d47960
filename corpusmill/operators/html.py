"""HTML and line parsers that need a tree or nesting, as Arrow-batched functions over the standard library."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import SPACE

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("p div ul ol dl table blockquote h1 h2 h3 h4 h5 h6 section article nav aside footer header hr pre".split())
_SPACE = re.compile(SPACE)


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


class Element:
    __slots__ = ("tag", "attrs", "parent", "kids", "start")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else "" if k.tag in ("script", "style") else k.text() for k in self.kids)

    def walk(self):
        for k in self.kids:
            if not isinstance(k, str):
                yield k
                yield from k.walk()

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def ancestors(self):
        at = self.parent
        while at is not None:
            yield at
            at = at.parent


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        ends_p = ("p",) if tag in _ENDS_P else ()
        closes = {"li": ("li", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ends_p)
        while self.at.tag in closes:
            self.at = self.at.parent
        e = Element(tag, dict(attrs), self.at)
        self.at.kids.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_endtag(self, tag):
        for a in [self.at, *self.at.ancestors()]:
            if a.tag == tag and a.parent is not None:
                self.at = a.parent
                return

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str) -> Element:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def paragraphs(html: str | None) -> list[tuple[str | None, str, list[str], list[str]]]:
    """(anchor, text, headings before it since the previous paragraph, links in it) of each p and blockquote."""
    out, heads = [], []
    for e in tree(html or "").walk():
        if e.tag in _HEADINGS:
            heads.append(clean(e.text()))
        elif e.tag in ("p", "blockquote") and not any(a.tag in ("nav", "aside", "footer") for a in e.ancestors()):
            text = clean(e.text())
            if text:
                anchor = next((k.attrs.get("name") or k.attrs.get("id") for k in e.walk() if k.tag == "a" and (k.attrs.get("name") or k.attrs.get("id"))), None)
                out.append((anchor, text, heads, [k.attrs["href"] for k in e.walk() if k.tag == "a" and k.attrs.get("href")]))
                heads = []
    return out


def links(html: str | None, base: str | None) -> list[str]:
    """Absolute addresses of the anchors without fragments, each once; in-page, script and mail links left out, as malformed ones."""
    out = {}
    for e in tree(html or "").walk():
        href = (e.attrs.get("href") or "").strip() if e.tag == "a" else ""
        if not href or href.startswith("#") or href.lower().startswith(("javascript:", "mailto:")):
            continue
        try:
            out[urldefrag(urljoin(base or "", href))[0]] = None
        except ValueError:
            continue
    return list(out)


def first_table_after(html: str | None, anchor: str) -> str | None:
    """Source of the first balanced table after a named anchor."""
    m = re.search(rf"<a\s[^>]*(?:name|id)\s*=\s*[\"']?{re.escape(anchor)}\b", html or "", re.I)
    if not m:
        return None
    depth, start = 0, None
    for t in re.finditer(r"<(/?)table\b[^>]*>", html[m.end() :], re.I):
        depth += -1 if t.group(1) else 1
        start = t.start() if start is None and depth == 1 else start
        if start is not None and depth == 0:
            return html[m.end() + start : m.end() + t.end()]
    return None


def bilingual_rows(html: str | None) -> list[tuple[str, str]]:
    """(left, right) of each table row; a row with one cell goes to both sides."""
    out = []
    for row in tree(html or "").walk():
        if row.tag == "tr":
            cells = [clean(c.text()) for c in row.kids if not isinstance(c, str) and c.tag in ("td", "th")]
            if cells:
                out.append((cells[0], cells[1] if len(cells) > 1 else cells[0]))
    return out


def select_rows(rows: list[tuple[str, str]], keep) -> list[tuple[str, str]]:
    """The rows for which the caller's keep(left, right) holds."""
    return [r for r in rows if keep(*r)]


def index_entries(html: str | None, base: str | None) -> list[tuple[str, str | None, list[str]]]:
    """(title, title link, numeric chapter links) of each list item."""
    out = []
    for li in tree(html or "").walk():
        if li.tag == "li":
            found = [(clean(a.text()), urljoin(base or "", a.attrs["href"])) for a in li.walk() if a.tag == "a" and a.attrs.get("href")]
            chapters = [u for t, u in found if t.isdigit()]
            named = next((u for t, u in found if not t.isdigit()), None)
            out.append((clean(li.text()), named, chapters))
    return out


def split_canons(html: str | None) -> list[tuple[int, str]]:
    """(number, text) of each canon: a block ends before the next 'Can. n', in bold or after a blank; '[Earlier version]' closes it."""
    text = clean(tree(re.sub(r"(?i)(?=<b>\s*can\.\s*\d+)", "\n", html or "")).text())
    out = []
    for part in re.split(r"(?i)(?=\bcan\.\s*\d+)", text):
        m = re.match(r"(?i)can\.\s*(\d+)[.:]?\s*(.*)", part)
        if m:
            out.append((int(m.group(1)), re.split(r"(?i)\[earlier version\]", m.group(2))[0].strip()))
    return out


def apply_rows(df: DataFrame, keep: list[str], args: list[str], fn, schema: str) -> DataFrame:
    """One row for each row that fn(*args) returns, besides the columns in keep: a narrow pass in Arrow batches."""
    types = dict(df.dtypes)
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, vals in zip(zip(*(b[c] for c in keep)), zip(*(b[c] for c in args))):
                for n, r in enumerate(fn(*(v if isinstance(v, str) else None for v in vals))):
                    rows.append((*k, n, *(r if isinstance(r, tuple) else (r,))))
            yield pd.DataFrame(rows, columns=[*keep, "pos", *names])

    used = df.select(*dict.fromkeys([*keep, *args]))
    return used.mapInPandas(part, ", ".join([f"{c} {types[c]}" for c in keep] + ["pos int", schema]))

