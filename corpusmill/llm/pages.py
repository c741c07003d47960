"""Main body of web pages, by layout-aware rendering.

A tree builder that knows implied end tags and what is invisible renders a page into blocks; each piece of visible text
keeps its block, its links and its line in the source. The body is the container that holds most text outside links;
chrome (navigation, notices, related links, footers) is told by tags, by links and by how blocks differ from the
container's usual ones. Lines that other pages show in their chrome are taken out last, over the whole table, by an
aggregation and an anti-join on their hashes, so nothing is collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the markup standard: invisible elements, void elements, blocks, and what an opening tag closes.
INVISIBLE = frozenset("head title script style noscript template svg iframe select option button form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "body main article section div p h1 h2 h3 h4 h5 h6 ul ol li blockquote table tbody tr td th center nav aside footer header dl dt dd pre figure hr".split()
)
CHROME = frozenset("nav aside footer header".split())
IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol table body div td th".split())
PASS_THROUGH = frozenset("ul ol dl blockquote table tbody tr td article section main".split())
#: A look that at least this many pages show, and mostly in their chrome, is chrome on every site of which this share of the pages shows it.
REPEATED, CHROME_SHARE, SITE_SHARE = 3, 0.6, 0.002


class Node:
    __slots__ = ("tag", "cls", "parent", "runs", "kids", "id")

    def __init__(self, tag: str, cls: str, parent: Node | None, nid: int):
        self.tag, self.cls, self.parent, self.id = tag, cls, parent, nid
        self.runs: list[tuple[int, str, str]] = []  # (line, text, "" or "a" outward link or "#" inner link or "n" named anchor)
        self.kids: list[Node] = []


class Builder(HTMLParser):
    """A tree of blocks; inline elements only mark the runs of text in them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("body", "", None, 0)
        self.at = self.root
        self.nodes = [self.root]
        self.open: list[tuple[str, Node]] = []
        self.hidden = 0
        self.link = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("html",):
            return
        if tag == "body":
            self.hidden = 0
            return
        if tag in INVISIBLE:
            self.hidden += 1
            self.open.append((tag, self.at))
            return
        a = dict(attrs)
        if tag == "a":
            href = a.get("href")
            self.link = "" if href is None and "name" not in a else "n" if href is None else "#" if href.startswith("#") else "a"
            if self.link == "n":
                self.at.runs.append((self.getpos()[0] - 1, "", "n"))
                self.link = "n"
            return
        style = (a.get("style") or "").replace(" ", "").lower()
        if tag in VOID:
            if tag == "hr" or tag == "br":
                self.at.runs.append((self.getpos()[0] - 1, "\n", ""))
            return
        if tag in BLOCKS:
            closes = IMPLIED.get(tag, {"p"} if tag not in ("td", "th") else set())
            while self.open and self.open[-1][0] in closes:
                self._pop()
            node = Node(tag, " ".join(filter(None, (a.get("class") or a.get("id") or "", "!" if "display:none" in style or "hidden" in a else ""))), self.at, len(self.nodes))
            self.nodes.append(node)
            self.at.kids.append(node)
            self.open.append((tag, self.at))
            self.at = node
        elif tag == "font":
            self.at.runs.append((self.getpos()[0] - 1, "", "f:" + str(a.get("face") or "")))

    def _pop(self):
        tag, before = self.open.pop()
        if tag in INVISIBLE:
            self.hidden = max(0, self.hidden - 1)
        self.at = before

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = ""
            return
        if tag in BLOCKS or tag in INVISIBLE:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    while len(self.open) > k:
                        self._pop()
                    return
                if self.open[k][0] in SCOPES and tag in ("p", "li"):
                    return

    def handle_data(self, data):
        if self.hidden or not data:
            return
        line = self.getpos()[0] - 1
        for k, part in enumerate(data.split("\n")):
            if part.strip():
                self.at.runs.append((line + k, part, self.link if self.link in ("a", "#") else ""))


def build(content: str) -> Builder:
    b = Builder()
    b.feed(content)
    b.close()
    return b


_MARKUP = re.compile(r"</[A-Za-z]|<(?:!doctype|html|body|p|div|br)\b", re.I)


def is_markup(content: str) -> bool:
    return bool(_MARKUP.search(content))


def _own(n: Node) -> str:
    return re.sub(r"[^\S\n]+", " ", "".join(t if not t or t == "\n" or k == 0 else " " + t if n.runs[k - 1][0] != ln else t for k, (ln, t, _) in enumerate(n.runs))).strip()


def _cells(table: Node) -> list[list[Node]] | None:
    """Rows of cells of a table that holds data; None if a cell holds blocks of its own: the table then lays out the page."""
    rows: list[list[Node]] = []
    todo = list(reversed(table.kids))
    while todo:
        n = todo.pop()
        if n.tag == "tr":
            if any(c.kids for c in n.kids):
                return None
            rows.append(n.kids)
        elif n.tag in ("tbody", "table"):
            todo += reversed(n.kids)
        elif n.kids:
            return None
        else:
            rows.append([n])
    return rows


def layout(root: Node) -> list[tuple[str, str, list[int]]]:
    """The page as it is seen: (kind, text, ids of the nodes in it) of each block, list item and table row, in order.

    Hidden blocks are left out; list items are marked, further lines of a preformatted block stand under the first; the cells
    of a row stand in one line, in columns as wide as their widest cell. A table whose cells hold blocks is no row of cells.
    """
    out: list[tuple[str, str, list[int]]] = []
    todo: list[tuple[Node, str]] = [(root, "")]
    while todo:
        n, lead = todo.pop()
        if "!" in n.cls:
            continue
        if n.tag == "table" and (rows := _cells(n)) is not None:
            texts = [[_own(c).replace("\n", " ") for c in r] for r in rows]
            width = [max((len(r[k]) for r in texts if k < len(r)), default=0) for k in range(max(map(len, texts), default=0))]
            for r, t in zip(rows, texts):
                out.append(("row", "  ".join(v.ljust(width[k]) for k, v in enumerate(t)).rstrip(), [n.id, *(c.id for c in r)]))
            continue
        own = _own(n)
        if own:
            out.append(("item" if lead else "block", lead + own, [n.id]))
        todo += [(c, "- " if c.tag == "li" else "") for c in reversed(n.kids)]
    return out


def spaced(rows: list[tuple[str, str]]) -> str:
    """(kind, text) of blocks, items and rows as one text: blocks apart, items of a list and rows of a table under each other."""
    out, before = [], ""
    for kind, text in rows:
        if text:
            out.append("" if not out else "\n" if kind == before and kind != "block" else "\n\n")
            out.append(text)
            before = kind
    return "".join(out)


def render(content: str) -> str:
    """All visible text of a page; one without markup as it is."""
    return spaced([x[:2] for x in layout(build(content).root)]) if is_markup(content) else content


def _outward(n: Node) -> tuple[int, int, int]:
    """Letters of a block's own text, of them in outward links, and in inner links."""
    total = sum(len(t.strip()) for _, t, _ in n.runs)
    return total, sum(len(t.strip()) for _, t, k in n.runs if k == "a"), sum(len(t.strip()) for _, t, k in n.runs if k == "#")


def _in_chrome(n: Node | None) -> bool:
    while n is not None:
        if n.tag in CHROME or "!" in n.cls:
            return True
        n = n.parent
    return False


def markup_lines(content: str) -> list[tuple[int, str, int]]:
    """(line, its visible text, verdict) with 2 for a body paragraph, 1 for a heading of the body and 0 for chrome."""
    return [x[:3] for x in _markup_lines(content)]


def _markup_lines(content: str) -> list[tuple[int, str, int, bool, int, str, str | None]]:
    """The same, whether the line holds a link, and of the rendered page which block, item or row it is in: its place, kind and, for a row of cells, text.

    The lines are those of the rendering: what isn't in it, as hidden text, is no line.
    """
    built = build(content)
    nodes = built.nodes
    shown = {i: (k, kind, text) for k, (kind, text, ids) in reversed(list(enumerate(layout(built.root)))) for i in ids}
    leaf = [n for n in nodes if n.id in shown and any(t.strip() for _, t, _ in n.runs)]
    linky: dict[int, bool] = {}
    for n in leaf:
        total, a, inner = _outward(n)
        linky[n.id] = a > 0 or inner > 0.5 * total
    # of every container: its blocks with text and how many of them are links
    held: Counter = Counter()
    held_links: Counter = Counter()
    for n in leaf:
        p = n.parent
        while p is not None:
            held[p.id] += 1
            held_links[p.id] += linky[n.id]
            p = p.parent

    def related(n: Node) -> bool:
        """Whether the block lies in a container most of whose blocks are links."""
        p = n.parent
        while p is not None and p.parent is not None:
            if held[p.id] > 1 and held_links[p.id] >= 0.5 * held[p.id]:
                return True
            p = p.parent
        return False

    own_links = {n.id: sum(len(t) for _, t, k in n.runs if k == "a") for n in leaf}
    fair = [n for n in leaf if not _in_chrome(n) and not linky[n.id] and not related(n) and n.tag not in ("center",)]
    weight: Counter = Counter()
    for n in fair:
        p = n.parent
        while p is not None and p.tag in ("ul", "ol", "blockquote", "tr", "tbody"):
            p = p.parent
        if p is not None and n.tag in ("p", "li", "blockquote", "div"):
            weight[p.id] += sum(len(t) for _, t, _ in n.runs)
    main = nodes[max(weight, key=lambda k: (weight[k], -k))] if weight else None
    usual: Counter = Counter()
    for n in fair:
        if n.parent is main and n.tag in ("p", "div"):
            usual[n.tag, n.cls] += sum(len(t) for _, t, _ in n.runs)
    dominant = max(usual, key=lambda k: usual[k]) if usual else None
    verdict: dict[int, int] = {}
    fair_ids = {n.id for n in fair}
    for n in leaf:
        v = 0
        if main is not None and n.id in fair_ids and _reaches(n, main):
            if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                v = 1
            elif n.tag in ("li", "blockquote", "td", "dd", "dt", "pre"):
                v = 2
            elif n.tag == "p":
                v = 2 if not n.cls or (n.tag, n.cls) == dominant else 0
            elif n.tag == "div":
                v = 2 if (n.tag, n.cls) == dominant else 0
        verdict[n.id] = v
    by_line: dict[int, list[tuple[str, int, bool, int]]] = {}
    for n in leaf:
        named = ""
        line = -1
        for ln, t, k in n.runs:
            if k == "n":
                named, line = "n", ln
            elif k.startswith("f:"):
                named = named if ln == line else ""
            v = verdict[n.id]
            if not t.strip():
                continue
            # notes typeset without blocks of their own: a named anchor begins the line
            if v == 0 and named and ln == line and n.id not in (own_links.keys() if own_links[n.id] and n.tag not in ("body", "td", "center") else ()) and k != "a":
                v = 2
            by_line.setdefault(ln, []).append((t.strip(), v, k in ("a", "#"), n.id))
    out = []
    for ln, parts in sorted(by_line.items()):
        top = max(v for _, v, _, _ in parts)
        place, kind, text = shown[next(i for _, v, _, i in parts if v == top)]
        out.append((ln, " ".join(t for t, _, _, _ in parts), top, any(x for _, _, x, _ in parts), place, kind, text if kind == "row" else None))
    return out


def _reaches(n: Node, main: Node) -> bool:
    """Whether n lies in the main container, at most within lists, quotations and the like."""
    at = n.parent
    while at is not None and at is not main:
        if at.tag not in PASS_THROUGH:
            return False
        at = at.parent
    return at is main


_SEPARATED = re.compile(r"\s[|>]\s|｜")
_ENDED = re.compile(r"[.!?。！？؟”»\"」)）]\s*$")


def plain_lines(content: str, site: str | None) -> list[tuple[int, str, int]]:
    """The same for a page without markup."""
    lines = content.split("\n")
    out: list[tuple[int, str, int]] = []
    host = re.sub(r"[^a-z]", "", (site or "").rsplit(".", 1)[0].lower())
    k = 0
    while k < len(lines):
        s = lines[k].strip()
        if not s:
            k += 1
            continue
        if s[:2] in ("- ", "* ", "• "):
            e = k
            while e < len(lines) and lines[e].strip()[:2] == s[:2]:
                e += 1
            items = [x.strip() for x in lines[k:e]]
            v = 2 if sum(bool(_ENDED.search(x)) for x in items) > 0.5 * len(items) else 0
            out += [(k + i, x, v) for i, x in enumerate(items)]
            k = e
            continue
        parts = len(_SEPARATED.findall(s))
        chrome = (
            s.startswith(("<<", ">>", "(c)", "©", "[ "))
            or (parts and len(s) / (parts + 1) < 45)
            or (host and re.sub(r"[^a-z]", "", s.lower()) == host)
        )
        out.append((k, s, 0 if chrome else 1 if len(s) < 60 and not _ENDED.search(s) else 2))
        k += 1
    return out


def lines(pages: DataFrame) -> DataFrame:
    """page_id, local_path, site, line_no, text, its look, verdict, link flag, and place, kind and row of the rendered page of each line with visible text.

    One narrow pass. Rows with a null page_id or content have none.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pid, path, site, content in zip(b["page_id"], b["local_path"], b["site"], b["content"]):
                if is_markup(content):
                    found = _markup_lines(content)
                else:
                    # without markup, the items of a list that isn't body are titles of links
                    found = [(ln, t, v, v == 0 and t.startswith(("- ", "* ", "• ")), ln, "item" if t.startswith(("- ", "* ", "• ")) else "block", None) for ln, t, v in plain_lines(content, site)]
                rows += [(pid, path, site, ln, t, v, linked, *place) for ln, t, v, linked, *place in found]
            yield pd.DataFrame(rows, columns=["page_id", "local_path", "site", "line_no", "text", "verdict", "linked", "place", "kind", "cells"])

    some = pages.where("content IS NOT NULL AND page_id IS NOT NULL").select("page_id", "local_path", "site", "content")
    got = some.mapInPandas(part, "page_id long, local_path string, site string, line_no int, text string, verdict int, linked boolean, place int, kind string, cells string")
    return got.withColumn("h", look(F.col("text")))


def body_text(found: DataFrame, body: DataFrame) -> DataFrame:
    """page_id and text of each page's main body: its lines (body_lines) as they stand in the rendered page, blocks apart, items marked, rows aligned."""
    kept = found.join(body, ["page_id", "line_no"], "left_semi").groupBy("page_id", "place", "kind").agg(
        F.max("cells").alias("cells"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text")
    )
    lead = F.when((F.col("kind") == "item") & ~F.col("text").rlike(r"^[-*•] "), "- ").otherwise("")
    blocks = F.array_sort(F.collect_list(F.struct("place", "kind", F.coalesce("cells", F.concat(lead, "text")).alias("text"))))  # the blocks of one page

    def add(acc: Column, x: Column) -> Column:
        gap = F.when(acc["text"] == "", "").when((acc["kind"] == x["kind"]) & (x["kind"] != "block"), "\n").otherwise("\n\n")
        return F.struct(x["kind"].alias("kind"), F.concat(acc["text"], gap, x["text"]).alias("text"))

    start = F.struct(F.lit("").alias("kind"), F.lit("").alias("text"))
    return kept.groupBy("page_id").agg(blocks.alias("blocks")).select("page_id", F.aggregate("blocks", start, add)["text"].alias("text"))


def look(text: Column) -> Column:
    """Hash of a line with digits as 0 and blanks as one."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\d+", "0"), r"\s+", " "))


def body_lines(found: DataFrame) -> DataFrame:
    """page_id and line_no of the main body, from lines() that were written once.

    A line's look is chrome if REPEATED or more sources show it, mostly as chrome, and the line's own site shows it on a
    share of its pages; copies of one page count once. Titles of links say nothing about the body of other pages and have
    no vote. Pages of which only headings are left have no body. Null and empty contents give no row.
    """
    found = found.withColumn("site", F.coalesce("site", F.lit("")))
    sites = found.groupBy("site").agg(F.count_distinct("local_path").alias("pages"))
    seen = found.where("verdict > 0 OR NOT linked").groupBy("h", "site", "local_path").agg(F.max((F.col("verdict") == 0).cast("int")).alias("c"))
    looks = seen.groupBy("h", "site").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    often = looks.groupBy("h").agg(F.sum("n").alias("all"), F.sum("c").alias("as_chrome")).where((F.col("all") >= REPEATED) & (F.col("as_chrome") >= CHROME_SHARE * F.col("all")))
    chrome = looks.join(often, "h", "left_semi").join(sites, "site").where(F.col("n") >= SITE_SHARE * F.col("pages")).select("h", "site")
    kept = found.where("verdict > 0").join(chrome, ["h", "site"], "left_anti")
    prose = kept.groupBy("page_id").agg(F.max("verdict").alias("best")).where("best = 2").select("page_id")
    return kept.join(prose, "page_id", "left_semi").select("page_id", "line_no").distinct()
