"""Documents as nested rows: sections over page borders, their tables and equations, references, and chunks that carry both.

A document comes as an array of pages (number, title, paragraphs, tables). Its
lines are read in order with the state that runs on from page to page: the open
section, and whether the list of references has begun. Each section then gives
up its pipe tables and equations, and its paragraphs, tables and display
equations are gathered into chunks. One pass makes all three levels.

Scale. One narrow Arrow pass, linear in the text; nothing is shuffled. Write the
result once where several levels are read.

Defined cases: a null array or text counts as empty and has no sections, as has
a document of blank lines; keys may be null or repeat; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrow import slices
from millrace.operators.chunks import HEADINGS, RULE_LINE

TABLE = "struct<number:int,caption:string,headers:array<string>,rows:array<array<string>>,markdown:string>"
PAGES = f"array<struct<page:int,title:string,paragraphs:array<string>,tables:array<{TABLE}>>>"
EQUATION = "struct<number:int,kind:string,form:string,tag:string,latex:string,valid:boolean>"
SECTION = f"struct<number:int,title:string,kind:string,page_start:int,page_end:int,paragraphs:array<string>,tables:array<{TABLE}>,equations:array<{EQUATION}>>"
CHUNK = "struct<number:int,chunk_id:string,section:int,page_start:int,page_end:int,tokens:int,n_tables:int,n_equations:int,text:string>"
DOCUMENT = f"struct<sections:array<{SECTION}>,references:array<string>,chunks:array<{CHUNK}>,n_chars:long,n_tables:int,n_equations:int>"

_S, _I, _STRINGS = pa.string(), pa.int32(), pa.list_(pa.string())
_TABLE = pa.struct([("number", _I), ("caption", _S), ("headers", _STRINGS), ("rows", pa.list_(_STRINGS)), ("markdown", _S)])
_EQUATION = pa.struct([("number", _I), ("kind", _S), ("form", _S), ("tag", _S), ("latex", _S), ("valid", pa.bool_())])
_SECTION = pa.struct([("number", _I), ("title", _S), ("kind", _S), ("page_start", _I), ("page_end", _I), ("paragraphs", _STRINGS), ("tables", pa.list_(_TABLE)), ("equations", pa.list_(_EQUATION))])
_CHUNK = pa.struct([("number", _I), ("chunk_id", _S), ("section", _I), ("page_start", _I), ("page_end", _I), ("tokens", _I), ("n_tables", _I), ("n_equations", _I), ("text", _S)])
_DOCUMENT = pa.struct([("sections", pa.list_(_SECTION)), ("references", _STRINGS), ("chunks", pa.list_(_CHUNK)), ("n_chars", pa.int64()), ("n_tables", _I), ("n_equations", _I)])

MOST_TOKENS = 1024

# Forms of display equations (opening and closing mark), lone dollar signs, numbered lines, items of a list of references.
DISPLAY = (
    ("dollars", r"\$\$", r"\$\$"),
    ("brackets", r"\\\[", r"\\\]"),
    ("equation", r"\\begin\{equation\*?\}", r"\\end\{equation\*?\}"),
    ("align", r"\\begin\{align\*?\}", r"\\end\{align\*?\}"),
    ("gather", r"\\begin\{gather\*?\}", r"\\end\{gather\*?\}"),
)
INLINE = r"(?<!\$)\$(?!\$)(.*?)(?<!\$)\$(?!\$)"
NUMBERED = r"(?m)^(.*?)(?<!\s)(?:\s{2,}+|\t++)\((\d+(?:\.\d+)*)\)\s*$"
REFERENCE = r"^(?:\[(\d+)\]|(\d+)\.)\s+(.+)$"
# What a line of mathematics holds (two of the first and one of the second, or three of the first), and where a sentence may end in a full stop.
MATH_SIGNS = (
    r"\\(?:frac|partial|nabla|int|sum|prod|sqrt|vec|hat|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|rho|sigma|tau|phi|psi|omega)"
    r"|[∂∇∫∑∏√αβγδεθλμπρστφψω]|\b(?:dm/dt|d[A-Za-z]/dt|dx/dt|dy/dt|dz/dt)\b|[=≈≡≤≥∝]"
)
RELATIONS = "=≈≡→∝"
FORMULA_END = r"[=\d\)]\.$"

_DISPLAY = [(form, re.compile(a), re.compile(b)) for form, a, b in DISPLAY]
_INLINE, _NUMBERED, _REFERENCE = re.compile(INLINE), re.compile(NUMBERED), re.compile(REFERENCE)
_SIGNS, _FORMULA_END, _RULE = re.compile(MATH_SIGNS), re.compile(FORMULA_END), re.compile(RULE_LINE)
# All headings as one pattern; the empty group behind each closes last when it meets.
_HEADING = re.compile("|".join((f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})") + "()" for p, _ in HEADINGS))
_KINDS: dict[int, str] = {}
for _p, _kind in HEADINGS:
    _KINDS[max(_KINDS, default=0) + re.compile(_p).groups + 1] = _kind
_PAIRS = {")": "(", "]": "[", "}": "{"}


def heading_kind(line: str) -> str | None:
    """The kind of section that a stripped line names, None if none."""
    found = _HEADING.match(line)
    return _KINDS[found.lastindex] if found else None


def is_heading(line: str) -> bool:
    """Whether a stripped line reads as a heading."""
    if not 3 <= len(line) <= 120 or line.endswith(".") and not re.match(r"\d+\.", line):
        return False
    return heading_kind(line) is not None or line.isupper() and len(line.split()) <= 8 and len(line) >= 4


# ---- equations


def tidy(latex: str) -> str:
    """Runs of blanks as one, a line's end after each double backslash."""
    return re.sub(r"[ \t]+", " ", latex.strip()).replace("\\\\ ", "\\\\\n").strip()


def balanced(latex: str) -> bool:
    """Whether round, square and curly brackets close in order."""
    held = []
    for sign in latex:
        if sign in "([{":
            held.append(sign)
        elif sign in _PAIRS and (not held or held.pop() != _PAIRS[sign]):
            return False
    return not held


def is_math(line: str) -> bool:
    """Whether a stripped line stands for a formula by itself."""
    if not 3 <= len(line) <= 300 or line.endswith(".") and not _FORMULA_END.search(line):
        return False
    signs = len(_SIGNS.findall(line))
    return signs >= 3 or signs == 2 and any(r in line for r in RELATIONS)


def _between(text: str, opening: re.Pattern, closing: re.Pattern):
    """What stands between two marks, from left to right; an opening mark without a closing one ends the search."""
    at = 0
    while (a := opening.search(text, at)) and (b := closing.search(text, a.end())):
        yield text[a.end() : b.start()]
        at = b.end()


def find_equations(text: str, lines_too: bool = True) -> tuple[list[dict], str]:
    """Equations by phase, each formula once, and the text in which lines of mathematics are set as display.

    Phases: the display forms in their order, numbered lines, lines of
    mathematics, and what stands between lone dollar signs in the text so far. A
    formula that an earlier phase found belongs to that phase. Without
    ``lines_too`` only marks make a formula, numbered lines and lines of
    mathematics stay text.
    """
    found: list[dict] = []
    seen: set[str] = set()

    def claim(raw: str, kind: str, form: str, tag: str | None = None) -> str | None:
        raw = raw.strip()
        if not raw or raw in seen:
            return None
        seen.add(raw)
        latex = tidy(f"{raw} \\tag{{{tag}}}" if tag else raw)
        found.append({"number": len(found) + 1, "kind": kind, "form": form, "tag": tag, "latex": latex, "valid": balanced(latex)})
        return latex

    marked = "$" in text or "\\" in text
    if not marked and not lines_too:
        return found, text
    for form, opening, closing in _DISPLAY if marked else ():
        for raw in _between(text, opening, closing):
            claim(raw, "display", form)
    for m in _NUMBERED.finditer(text) if lines_too else ():
        if is_math(m.group(1).strip()):
            claim(m.group(1), "display", "numbered", m.group(2))
    lines = text.split("\n")
    for i, line in enumerate(lines if lines_too else ()):
        bare = line.strip()
        if not bare.startswith("$") and is_math(bare) and (latex := claim(bare, "display", "line")):
            lines[i] = f"\n$${latex}$$\n"
    text = "\n".join(lines)
    for m in _INLINE.finditer(text):
        claim(m.group(1), "inline", "dollar")
    return found, text


def equations(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: int = 1_000_000) -> DataFrame:
    """One row per equation: key and the equation's fields. A task holds the equations of about ``chars`` characters, or one text."""
    kind = docs.schema[key].dataType.simpleString()

    def read(batches):
        for part in slices(batches, chars):
            rows = pa.array([find_equations(t or "")[0] for t in part.column(1).to_pylist()], pa.list_(_EQUATION))
            yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["key", "equations"])

    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(read, f"key {kind}, equations array<{EQUATION}>")
    return found.select(F.col("key").alias(key), F.explode("equations").alias("e")).select(key, "e.*")


# ---- tables


def take_tables(paragraph: str, number: int) -> tuple[list[dict], str]:
    """Pipe tables of a paragraph, numbered on from ``number``, and the lines that remain."""
    if "|" not in paragraph:
        return [], paragraph
    tables, rest, run = [], [], []

    def close() -> None:
        if len(run) > 1:
            cells = [[c.strip() for c in line.strip("|").split("|")] for line in run]
            head, body = cells[0], cells[2 if _RULE.match(run[1]) else 1 :]
            rows = [(row + [""] * len(head))[: len(head)] for row in body]
            line = lambda row: "| " + " | ".join(row) + " |"
            tables.append({"number": number + len(tables) + 1, "caption": None, "headers": head, "rows": rows, "markdown": "\n".join(map(line, [head, ["---"] * len(head), *rows]))})
        else:
            rest.extend(run)
        run.clear()

    for line in paragraph.split("\n"):
        bare = line.strip()
        if len(bare) > 1 and bare.startswith("|") and bare.endswith("|"):
            run.append(bare)
        else:
            close()
            rest.append(line)
    close()
    return tables, "\n".join(rest)


# ---- sections over pages


def merge_pages(pages: list[dict]) -> tuple[list[dict], list[str]]:
    """Sections and references of a document's pages.

    A heading ends the section before it, on whatever page that began; a section
    without paragraphs and tables goes. In a section of references, items of the
    list are taken out; all else there is text. Tables stay with the section that
    is open when their page begins, pipe tables with the one around them.
    """
    sections: list[dict] = []
    references: list[str] = []
    n_tables = 0
    first = pages[0]
    start = end = first["page"] or 1
    title = first["title"] if first["title"] and first["title"] != "Page 1" else "Overview"
    paragraphs: list[str] = []
    tables: list[dict] = []
    listed = False

    def flush() -> None:
        nonlocal paragraphs, tables
        if paragraphs or tables:
            sections.append({"number": len(sections), "title": title, "kind": heading_kind(title) or "section", "page_start": start, "page_end": end, "paragraphs": paragraphs, "tables": tables, "equations": []})
        paragraphs, tables = [], []

    for page in pages:
        number = page["page"] or 1
        end = max(end, number)
        for table in page["tables"] or []:
            n_tables += 1
            tables.append(table | {"number": n_tables})
        for paragraph in page["paragraphs"] or []:
            found, paragraph = take_tables(paragraph or "", n_tables)
            n_tables += len(found)
            tables += found
            body: list[str] = []
            for line in filter(None, map(str.strip, paragraph.split("\n"))):
                item = _REFERENCE.match(line) if listed else None
                if item:
                    references.append(item.group(3).strip())
                elif is_heading(line):
                    if body:
                        paragraphs.append(" ".join(body))
                    body = []
                    flush()
                    title, start, end = line, number, number
                    listed = heading_kind(line) == "references"
                else:
                    body.append(line)
            if body:
                paragraphs.append(" ".join(body))
    flush()
    return sections, references


def bind_equations(sections: list[dict], lines_too: bool = True) -> None:
    """Move each section's equations into its own list; numbers run through the document."""
    n = 0
    for section in sections:
        kept = []
        for paragraph in section["paragraphs"]:
            found, text = find_equations(paragraph, lines_too)
            for e in found:
                n += 1
                section["equations"].append(e | {"number": n})
            kept.append(text)
        section["paragraphs"] = [p for p in kept if p.strip()]


# ---- chunks


def estimate(text: str) -> int:
    """Estimated tokens: a quarter of the characters, or the words if they are more."""
    return max(len(text.split()), len(text) // 4)


def chunk_sections(sections: list[dict], document: str, most: int = MOST_TOKENS) -> list[dict]:
    """Chunks of each section: its paragraphs, then tables, then display equations, until the next part would pass ``most`` tokens."""
    chunks: list[dict] = []
    for section in sections:
        parts = [(p.strip(), 0, 0) for p in section["paragraphs"]]
        parts += [(t["markdown"].strip(), 1, 0) for t in section["tables"] if t["markdown"]]
        parts += [(f"$${e['latex']}$$", 0, 1) for e in section["equations"] if e["kind"] == "display"]
        held: list[tuple[str, int, int]] = []
        size = 0

        def flush(section=section) -> None:
            if not held:
                return
            text = "\n\n".join(p for p, *_ in held)
            mark = f"{document}:{section['number']}:{len(chunks)}:{text}"
            chunks.append({
                "number": len(chunks), "chunk_id": hashlib.sha256(mark.encode("utf-8", "surrogatepass")).hexdigest()[:16], "section": section["number"], "page_start": section["page_start"], "page_end": section["page_end"],
                "tokens": estimate(text), "n_tables": sum(t for _, t, _ in held), "n_equations": sum(e for *_, e in held), "text": text,
            })
            held.clear()

        for part in parts:
            if part[0]:
                n = estimate(part[0])
                if held and size + n > most:
                    flush()
                    size = 0
                held.append(part)
                size += n
        flush()
    return chunks


def read_document(pages: list[dict] | None, document: str, most: int = MOST_TOKENS, lines_too: bool = True) -> dict:
    """The nested row of one document."""
    sections, references = merge_pages(pages) if pages else ([], [])
    bind_equations(sections, lines_too)
    return {
        "sections": sections, "references": references, "chunks": chunk_sections(sections, document, most), "n_chars": sum(len(p) for s in sections for p in s["paragraphs"]),
        "n_tables": sum(len(s["tables"]) for s in sections), "n_equations": sum(len(s["equations"]) for s in sections),
    }


def _read_pages(column: pa.Array) -> Iterator[list[dict] | None]:
    """The pages of each document; columns are taken apart as wholes, which costs a fraction of nested rows."""
    sizes = pc.list_value_length(column).to_pylist()
    number, title, paragraphs, tables = column.flatten().flatten()
    lengths = pc.list_value_length(paragraphs).to_pylist()
    lines = iter(paragraphs.flatten().to_pylist())
    some = tables.to_pylist() if pc.sum(pc.list_value_length(tables)).as_py() else repeat(None)
    pages = ({"page": n, "title": t, "paragraphs": list(islice(lines, k or 0)), "tables": own} for n, t, k, own in zip(number.to_pylist(), title.to_pylist(), lengths, some))
    for size in sizes:
        yield None if size is None else list(islice(pages, size))


def _by_document(docs: DataFrame, key: str, pages: str, rows: int, name: str, made: str, shape: pa.DataType, read: Callable) -> DataFrame:
    """``key`` and ``name``, what ``read`` makes of each document's pages and key; ``rows`` documents are held at a time."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                found = [read(p, k) for k, p in zip(part.column(0).to_pylist(), _read_pages(part.column(1)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, shape)], names=["key", name])

    shaped = docs.select(F.col(key).alias("key"), F.col(pages).cast(PAGES).alias("pages"))
    return shaped.mapInArrow(run, f"key {kind}, {name} {made}").select(F.col("key").alias(key), name)


def structured(docs: DataFrame, key: str = "doc_id", pages: str = "pages", most: int = MOST_TOKENS, rows: int = 64, lines_too: bool = True) -> DataFrame:
    """``key`` and ``document``, the nested row of each document given as pages (``PAGES``).

    Where prose may hold lines that look like formulas (settings with signs of
    equality), ``lines_too=False`` leaves them as they are.
    """
    return _by_document(docs, key, pages, rows, "document", DOCUMENT, _DOCUMENT, lambda p, k: read_document(p, str(k), most, lines_too))


def listed(docs: DataFrame, key: str = "doc_id", pages: str = "pages", rows: int = 64) -> DataFrame:
    """One row per reference, as :func:`references`, straight from pages: neither equations nor chunks are made."""
    found = _by_document(docs, key, pages, rows, "references", "array<string>", _STRINGS, lambda p, _: merge_pages(p)[1] if p else [])
    return _numbered(found, key, "references")


def sections(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per section."""
    return documents.select(key, F.explode("document.sections").alias("s")).select(key, "s.*")


def chunks(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per chunk."""
    return documents.select(key, F.explode("document.chunks").alias("c")).select(key, "c.*")


def _numbered(rows: DataFrame, key: str, references: str) -> DataFrame:
    return rows.select(key, F.posexplode(references).alias("k", "reference")).select(key, (F.col("k") + 1).alias("number"), "reference")


def references(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per reference, numbered from 1."""
    return _numbered(documents, key, "document.references")


def text_pages(text: Column, break_at: str = "\f") -> Column:
    """Pages of a plain text, cut at form feeds, with paragraphs cut at blank lines."""
    none = F.array().cast(f"array<{TABLE}>")
    page = lambda part, k: F.struct((k + 1).cast("int").alias("page"), F.concat(F.lit("Page "), (k + 1).cast("string")).alias("title"), F.split(part, r"\n\s*\n").alias("paragraphs"), none.alias("tables"))
    return F.transform(F.split(text, break_at), page)


def html_pages(page: Column) -> Column:
    """Sections of a parsed web page (see sources.pages) as pages of one document, all on page 1."""
    heading = lambda s: F.when(s["kind"] == "heading", F.array(s["title"])).otherwise(F.array().cast("array<string>"))
    return F.transform(page["sections"], lambda s: F.struct(F.lit(1).alias("page"), s["title"].alias("title"), F.concat(heading(s), s["paragraphs"]).alias("paragraphs"), s["tables"].alias("tables")))
