"""Web pages as documents: metadata, sections, tables and formulas of one page as a nested row.

A stack of open elements over the tags of one page. Headings h1 to h4 open
sections; paragraphs, lists, quotes and preformatted blocks are their
paragraphs, in the order in which they open, and a block inside another is read
on its own as well as in the outer one. Tables keep header cells, rows and
caption, and are written as Markdown too. Navigation and the like, scripts and
comments are left out. Formulas become TeX between dollar signs: MathML by its
TeX annotation, its ``alttext`` or its text, spans of formula renderers by their
label or annotation.

End tags may be missing: paragraphs, list items, rows and cells end where the
next one or an enclosing end tag says so, as browsers do it, and whatever is
open at the end of the page ends there.

Scale. One narrow pass; beside its Arrow batch a task holds the pages of a million
characters, or one page. Text is kept once and cut by places, so work follows the page's size
and that of its result.

Defined cases: a null or blank page, or one without any block, has no sections
and the status FAILED; elements nested deeper than ``DEPTH`` are read as text of
what holds them; keys may be null or repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrow import slices

# Elements that are left out, that head sections, that are paragraphs; meta names by what they give.
STRIPPED = frozenset(("nav", "header", "footer", "aside", "script", "style", "noscript", "iframe", "form", "button", "svg", "menu"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
PARAGRAPHS = frozenset(("p", "ul", "ol", "pre", "blockquote"))
TITLE_NAMES = ("citation_title", "og:title", "dc.title", "twitter:title")
AUTHOR_NAMES = ("citation_author", "author", "dc.creator")
ABSTRACT_NAMES = ("citation_abstract", "description", "og:description")
EXTRA_NAMES = ("citation_pdf_url", "citation_abstract_html_url")
TEX = ("application/x-tex", "TeX")
FORMULA_CLASSES = ("katex", "math", "MathJax")

# Of HTML itself: elements without content, what ends an open paragraph, and what a start tag ends, up to which element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = PARAGRAPHS | STRIPPED - {"script", "style", "noscript", "iframe", "button", "svg"} | frozenset("h1 h2 h3 h4 h5 h6 address article details dir div dl fieldset figcaption figure hgroup hr main search section summary table".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th", "caption"), ("tr", "table")),
    "th": (("td", "th", "caption"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select",)),
}
#: End tags of other elements do not reach out of these.
FENCES = frozenset(("table", "td", "th", "caption", "button"))
TABLE_PARTS = frozenset(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"))
DEPTH = 256

TABLE = "struct<number:int,caption:string,headers:array<string>,rows:array<array<string>>,markdown:string>"
SECTION = f"struct<number:int,kind:string,title:string,paragraphs:array<string>,tables:array<{TABLE}>>"
PAGE = f"struct<title:string,authors:array<string>,abstract:string,canonical_url:string,extra:map<string,string>,sections:array<{SECTION}>,n_tables:int,n_chars:long,status:string>"

_TABLE = pa.struct([("number", pa.int32()), ("caption", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("markdown", pa.string())])
_SECTION = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("title", pa.string()), ("paragraphs", pa.list_(pa.string())), ("tables", pa.list_(_TABLE))])
_PAGE = pa.struct([
    ("title", pa.string()), ("authors", pa.list_(pa.string())), ("abstract", pa.string()), ("canonical_url", pa.string()), ("extra", pa.map_(pa.string(), pa.string())),
    ("sections", pa.list_(_SECTION)), ("n_tables", pa.int32()), ("n_chars", pa.int64()), ("status", pa.string()),
])


# Of HTML itself: elements whose content is text up to their own end tag, with or without character references.
RAW = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I) for tag in ("script", "style", "iframe", "noembed", "noframes", "xmp", "textarea", "title")}
REFERENCES = ("textarea", "title")
_NAME = re.compile(r"[A-Za-z][^ \t\n\f\r/>]*")
_ATTRIBUTE = re.compile(r"[ \t\n\f\r/]*([^ \t\n\f\r/>=]?[^ \t\n\f\r/>=]*)[ \t\n\f\r]*(=?)[ \t\n\f\r]*")
_UNQUOTED = re.compile(r"[^ \t\n\f\r>]*")


def markup(html: str) -> Iterator[tuple]:
    """("data", text), ("start", tag, attributes) and ("end", tag) of a page, in order.

    Every search that finds nothing ends the page, as in browsers, so no part is read twice.
    """
    at, n = 0, len(html)
    while at < n:
        tag_at = html.find("<", at)
        if tag_at < 0:
            tag_at = n
        if tag_at > at:
            yield "data", unescape(html[at:tag_at])
        at = tag_at
        following = html[at + 1 : at + 2]
        if following.isascii() and following.isalpha():
            name = _NAME.match(html, at + 1)
            tag, given = name.group().lower(), {}
            at = name.end()
            while at < n and html[at] != ">":
                found = _ATTRIBUTE.match(html, at)
                key, value, at = found.group(1).lower(), "", found.end()
                if found.group(2):
                    if html[at : at + 1] in ('"', "'"):
                        end = html.find(html[at], at + 1)
                        if end < 0:
                            return
                        value, at = html[at + 1 : end], end + 1
                    else:
                        found = _UNQUOTED.match(html, at)
                        value, at = found.group(), found.end()
                if key:
                    given.setdefault(key, unescape(value))
            if at >= n:
                return
            at += 1
            yield "start", tag, given
            if tag in RAW:
                end = RAW[tag].search(html, at)
                stop = end.start() if end else n
                if stop > at:
                    yield "data", unescape(html[at:stop]) if tag in REFERENCES else html[at:stop]
                at = stop
        elif following in ("/", "!", "?"):
            comment = html.startswith("<!--", at)
            end = html.find("-->", at + 4) if comment and not html.startswith(("<!-->", "<!--->"), at) else html.find(">", at + 2)
            name = _NAME.match(html, at + 2) if following == "/" else None
            if end < 0:
                return
            at = end + (3 if html.startswith("-->", end) else 1)
            if name:
                yield "end", name.group().lower()
        elif following or at < n:
            yield "data", "<"
            at += 1


class _Open:
    """An element that is open: where its text begins, and what its end fills in."""

    __slots__ = ("tag", "at", "blocks", "fill", "formula", "tex", "skips")

    def __init__(self, tag: str, at: int, blocks: int):
        self.tag, self.at, self.blocks = tag, at, blocks
        self.fill: dict | list | None = None  # gets the text at the element's end
        self.formula: str | None = None  # "math", "span" or the kind of note that feeds one
        self.tex: str | None = None
        self.skips = False


class Reader:
    """Reads one page; :meth:`page` gives the nested row."""

    def __init__(self, html: str) -> None:
        self.parts: list[str] = []
        self.stack: list[_Open] = []
        self.blocks: list[dict] = []
        self.meta: dict = {"title": None, "authors": [], "abstract": None, "canonical_url": None, "extra": {}}
        self.titles: list[str] | None = None
        self.skipping = self.beyond = 0
        take = {"start": self._start, "end": self._end, "data": self._data}
        for kind, *rest in markup(html):
            take[kind](*rest)
        while self.stack:
            self._pop()

    # ---- tags

    def _start(self, tag: str, given: dict[str, str]) -> None:
        self._meta(tag, given)
        self._end_implied(tag)
        if tag in VOID:
            return
        if len(self.stack) >= DEPTH:
            self.beyond += 1
            return
        own = _Open(tag, len(self.parts), len(self.blocks))
        self.stack.append(own)
        if tag == "title" and self.meta["title"] is None and self.titles is None:
            self.titles = []
        if tag in STRIPPED:
            own.skips = True
            self.skipping += 1
        if not self.skipping:
            self._begin(own, given)

    def _end(self, tag: str) -> None:
        if self.beyond:
            self.beyond -= 1
            return
        if tag in VOID:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].tag in FENCES and tag not in TABLE_PARTS:
                return

    def _data(self, data: str) -> None:
        if self.stack and self.stack[-1].tag == "title" and self.titles is not None:
            self.titles.append(data)
        if not self.skipping:
            self.parts.append(data)

    def _end_implied(self, tag: str) -> None:
        if tag in ENDS_P:
            self._end_up_to(("p",), FENCES)
        if tag in HEADINGS and self.stack and self.stack[-1].tag in HEADINGS:
            self._pop()
        if tag in IMPLIED:
            self._end_up_to(*IMPLIED[tag])

    def _end_up_to(self, tags, fences) -> None:
        """End the outermost open element among ``tags`` that lies within the next fence."""
        last = None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in fences:
                break
            if self.stack[k].tag in tags:
                last = k
        if last is not None:
            while len(self.stack) > last:
                self._pop()

    # ---- content

    def _meta(self, tag: str, given: dict[str, str]) -> None:
        meta = self.meta
        if tag == "link" and "canonical" in given.get("rel", "").lower().split() and given.get("href") and meta["canonical_url"] is None:
            meta["canonical_url"] = given["href"].strip()
        if tag != "meta" or not (content := given.get("content")):
            return
        name = (given.get("name") or given.get("property") or "").lower()
        if name in TITLE_NAMES and not meta["title"] and not meta.get("named"):
            meta["named"] = content.strip()
        elif name in AUTHOR_NAMES:
            meta["authors"].append(content.strip())
        elif name in ABSTRACT_NAMES:
            meta["abstract"] = content.strip()
        elif name in EXTRA_NAMES:
            meta["extra"][name] = content.strip()

    def _begin(self, own: _Open, given: dict[str, str]) -> None:
        tag, within_math = own.tag, any(o.formula == "math" for o in self.stack)
        if tag == "math" and not within_math:
            own.formula, own.tex = "math", None
            own.fill = {"alttext": given.get("alttext", "")}
            return
        spans = [o for o in self.stack[:-1] if o.formula == "span"]
        if tag == "annotation" and (within_math or spans):
            own.formula = "tex" if within_math and given.get("encoding") in TEX else "note" if not within_math else None
        if spans and not within_math and given.get("aria-label"):
            for o in spans:
                o.fill.setdefault("label", given["aria-label"])
        if tag == "span" and not within_math and any(c in given.get("class", "") for c in FORMULA_CLASSES):
            own.formula, own.fill = "span", {}
        if within_math:
            return
        if tag in HEADINGS or tag in PARAGRAPHS:
            own.fill = {"kind": "heading" if tag in HEADINGS else "text", "text": ""}
            self.blocks.append(own.fill)
        elif tag == "table":
            own.fill = {"kind": "table", "caption": None, "headers": [], "rows": []}
            self.blocks.append(own.fill)
        elif tag in TABLE_PARTS:
            tables = [o for o in self.stack[:-1] if o.tag == "table" and o.fill]
            if tag == "tr":
                own.fill = []
                for o in tables:
                    o.fill["rows"].append(own.fill)
            elif tag in ("th", "td", "caption"):
                own.fill = {"text": ""}
                for o in tables:
                    if tag == "th":
                        o.fill["headers"].append(own.fill)
                    elif tag == "caption" and o.fill["caption"] is None:
                        o.fill["caption"] = own.fill
                if tag == "td":
                    for o in self.stack[:-1]:
                        if o.tag == "tr" and o.fill is not None:
                            o.fill.append(own.fill)

    def _pop(self) -> None:
        own = self.stack.pop()
        if own.tag == "title" and self.titles is not None:
            self.meta["title"] = "".join(self.titles).strip()
            self.titles = None
        if own.skips:
            self.skipping -= 1
            return
        if self.skipping:
            return
        if own.formula == "math":
            self._put(own, own.tex or own.fill["alttext"].strip() or self._text(own))
        elif own.formula == "span":
            if own.fill.get("label") or own.fill.get("note"):
                self._put(own, own.fill.get("label") or own.fill["note"])
        elif own.formula == "tex":
            for o in self.stack:
                if o.formula == "math" and not o.tex:
                    o.tex = self._text(own)
        elif own.formula == "note":
            for o in self.stack:
                if o.formula == "span" and not o.fill.get("note"):
                    o.fill["note"] = "".join(self.parts[own.at :])
        elif isinstance(own.fill, dict) and "text" in own.fill:
            own.fill["text"] = self._text(own)

    def _text(self, own: _Open) -> str:
        return "".join(self.parts[own.at :]).strip()

    def _put(self, own: _Open, tex: str) -> None:
        """A formula in place of what its element held."""
        del self.parts[own.at :], self.blocks[own.blocks :]
        self.parts.append(f" ${tex}$ ")

    # ---- result

    def page(self) -> dict:
        meta = self.meta
        title = meta["title"] or meta.get("named")
        sections, current, number, n_tables = [], None, 0, 0

        def opened(kind: str, name: str) -> dict:
            nonlocal number
            number += 1
            sections.append({"number": number, "kind": kind, "title": name, "paragraphs": [], "tables": []})
            return sections[-1]

        for block in self.blocks:
            if block["kind"] == "table":
                n_tables += 1
                current = current or opened("main", title or "Content")
                current["tables"].append(_table(block, n_tables))
            elif block["text"] and block["kind"] == "heading":
                current = opened("heading", block["text"])
            elif block["text"]:
                current = current or opened("main", title or "Introduction")
                current["paragraphs"].append(block["text"])
        sections = [s for s in sections if s["paragraphs"] or s["tables"]]
        n_chars = sum(len(section_text(s)) for s in sections)
        kept = {k: meta[k] for k in ("authors", "abstract", "canonical_url")}
        return {"title": title, **kept, "extra": list(meta["extra"].items()), "sections": sections, "n_tables": n_tables, "n_chars": n_chars, "status": "SUCCESS" if n_chars else "FAILED"}


def _table(block: dict, number: int) -> dict:
    headers = [c["text"] for c in block["headers"]]
    rows = [[c["text"] for c in row] for row in block["rows"] if row]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    lines = ([line(headers), line(["---"] * len(headers))] if headers else []) + [line(r) for r in rows]
    return {"number": number, "caption": block["caption"]["text"] if block["caption"] else None, "headers": headers, "rows": rows, "markdown": "\n".join(lines) or None}


def section_text(section: dict) -> str:
    """A section as Markdown: its heading, paragraphs and tables."""
    parts = [f"## {section['title']}\n", *section["paragraphs"], *(t["markdown"] for t in section["tables"])]
    return "\n\n".join(p for p in parts if p)


def read_page(html: str | None) -> dict:
    return Reader(html or "").page()


def parsed(pages: DataFrame, key: str = "page_id", html: str = "html", chars: int = 1_000_000) -> DataFrame:
    """``key`` and ``page``, the nested row of each page; see the module."""
    kind = pages.schema[key].dataType.simpleString()

    def read(batches):
        for part in slices(batches, chars):
            rows = pa.array([read_page(t) for t in part.column(1).to_pylist()], _PAGE)
            yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["key", "page"])

    found = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(read, f"key {kind}, page {PAGE}")
    return found.select(F.col("key").alias(key), "page")


def sections(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per section of parsed pages: key, and the section's fields."""
    return pages.select(key, F.explode("page.sections").alias("s")).select(key, "s.*")


def tables(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per table of parsed pages: key, the section's number, and the table's fields."""
    return pages.select(key, F.explode("page.sections").alias("s")).select(key, F.col("s.number").alias("section"), F.explode("s.tables").alias("t")).select(key, "section", "t.*")


def formulas(text: Column) -> Column:
    """What stands between single dollar signs, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\$([^$]+)\$"), F.lit(1)), F.trim)
