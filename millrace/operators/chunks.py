"""Chunks, sections and structure inside documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# Heading lines and the section type each names, first match first.
NUMBER = r"(?i)^(?:[0-9]+(?:\.[0-9]+)*\.?\s*)?"
HEADINGS = (
    (rf"{NUMBER}(?:module\s+[0-9]+|module\s+[ivxlcdm]+)\s*[:\-–—]?\s*(.*)$", "module"),
    (rf"{NUMBER}(?:lecture\s+[0-9]+|lecture\s+[ivxlcdm]+)\s*[:\-–—]?\s*(.*)$", "lecture"),
    (rf"{NUMBER}(?:week\s+[0-9]+)\s*[:\-–—]?\s*(.*)$", "week"),
    (rf"{NUMBER}(?:lesson\s+[0-9]+|unit\s+[0-9]+)\s*[:\-–—]?\s*(.*)$", "lesson"),
    (rf"{NUMBER}(?:summary|recap|key\s+takeaways)\b", "summary"),
    (rf"{NUMBER}(?:assignment|quiz|practice\s+problems|tutorial)\b", "assignment"),
    (rf"{NUMBER}abstract\b", "abstract"),
    (rf"{NUMBER}introduction\b", "introduction"),
    (rf"{NUMBER}(?:background|related\s+work)\b", "background"),
    (rf"{NUMBER}(?:methodology|methods|theory|theoretical\s+formulation|model)\b", "methodology"),
    (rf"{NUMBER}(?:experiments|experimental\s+setup|evaluation)\b", "experiments"),
    (rf"{NUMBER}(?:(?:experimental|simulation|empirical)\s+)?(?:results|findings)\b", "results"),
    (rf"{NUMBER}discussion\b", "discussion"),
    (rf"{NUMBER}(?:conclusion|conclusions|concluding\s+remarks)\b", "conclusion"),
    (rf"{NUMBER}references\b", "references"),
    (rf"{NUMBER}bibliography\b", "references"),
    (rf"{NUMBER}appendix\b", "appendix"),
    (r"^(?:(\d+(?:\.\d+)*)\.?\s+([A-Z][A-Za-z0-9\s,\-–—\(\)]{2,80}))$", "numbered_section"),
)


def heading_type(line: Column) -> Column:
    """Section type that a heading names, ``section`` if none."""
    out = None
    for pattern, name in HEADINGS:
        out = (F.when if out is None else out.when)(line.rlike(pattern), name)
    return out.otherwise("section")


def is_heading(line: Column) -> Column:
    """Whether a stripped line reads as a heading."""
    size = F.length(line)
    stop = line.endswith(".") & ~line.rlike(r"^\d+\.")
    capitals = (F.upper(line) == line) & (F.lower(line) != line) & (T.n_words(line) <= 8) & (size >= 4)
    return (size >= 3) & (size <= 120) & ~stop & ((heading_type(line) != "section") | capitals)


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, place and stripped line of each line."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    return rows.select("doc_id", "place", T.strip(F.col("raw")).alias("line"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section (0 before the first heading), heading, n_lines and n_chars; rows of one document meet in one task."""
    w = Window.partitionBy("doc_id").orderBy("place")
    marked = lines(docs).withColumn("head", is_heading(F.col("line"))).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    return marked.groupBy("doc_id", "section").agg(F.min_by("line", F.when(F.col("head"), F.col("place"))).alias("heading"), F.count_if(~F.col("head") & (F.col("line") != "")).alias("n_lines"), F.sum(F.when(~F.col("head"), F.length("line")).otherwise(0)).cast("long").alias("n_chars"))


def chunks(docs: DataFrame, most: int = 1024) -> DataFrame:
    """Paragraphs gathered in order until the next would pass ``most`` estimated tokens: doc_id, chunk, text.

    A fold over one document's paragraphs; nothing is shuffled.
    """
    paragraphs = F.filter(F.transform(F.split("text", r"\n"), T.strip), lambda p: p != "")
    sized = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), T.estimate(p).alias("n")))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).cast("long").alias("n"))

    def add(state, para):
        full = (F.size(state["open"]) > 0) & (state["n"] + para["n"] > most)
        flushed = F.struct(F.concat(state["done"], F.array(F.array_join(state["open"], "\n\n"))).alias("done"), F.array(para["p"]).alias("open"), para["n"].alias("n"))
        grown = F.struct(state["done"].alias("done"), F.concat(state["open"], F.array(para["p"])).alias("open"), (state["n"] + para["n"]).alias("n"))
        return F.when(full, flushed).otherwise(grown)

    end = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n")))).otherwise(s["done"])
    return docs.select("doc_id", F.posexplode(F.aggregate(sized, empty, add, end)).alias("chunk", "text"))


def chunk_id(doc: Column, section: Column, chunk: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", doc.cast("string"), section.cast("string"), chunk.cast("string"), text).cast("binary"), 256), 1, 16)


def pipe_tables(docs: DataFrame) -> DataFrame:
    """Maximal runs of lines with two pipes or more: doc_id, first, n_rows, n_columns."""
    w = Window.partitionBy("doc_id").orderBy("place")
    pipes = T.occurrences(F.col("line"), "|")
    rows = lines(docs).where(pipes >= 2).withColumn("run", F.col("place") - F.row_number().over(w)).withColumn("cells", T.occurrences(F.col("line"), "|") + 1)
    return rows.groupBy("doc_id", "run").agg(F.min("place").alias("first"), F.count("*").alias("n_rows"), F.max("cells").alias("n_columns")).drop("run")


def equations(text: Column) -> Column:
    """Display equations, then inline ones, each once, in order."""
    display = F.regexp_extract_all(text, F.lit(r"(?s)\$\$(.*?)\$\$"), F.lit(1))
    inline = F.regexp_extract_all(F.regexp_replace(text, r"(?s)\$\$.*?\$\$", " "), F.lit(r"\$([^$\n]+)\$"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(F.concat(display, inline), T.strip), lambda e: F.length(e) > 2))


def hash_sections(text: Column) -> Column:
    """Array of (title, paragraphs) of a text with ``#`` headings; null title before the first one, sections without paragraphs go.

    A line that starts with ``#`` opens a section; every other line that is not blank is a paragraph. Nothing is shuffled.
    """
    filled = lambda lines: F.filter(F.transform(lines, T.strip), lambda p: p != "")

    def parsed(lines):
        headed = lines[0].startswith("#")
        title = F.when(headed, T.strip(F.regexp_replace(lines[0], "^#+", "")))
        rest = F.when(headed, F.slice(lines, 2, F.size(lines))).otherwise(lines)
        return F.struct(title.alias("title"), filled(rest).alias("paragraphs"))

    parts = F.split(text, "(?dm)^(?=#)")
    return F.filter(F.transform(parts, lambda part: T.let(F.split(part, "\n"), parsed)), lambda s: F.size(s["paragraphs"]) > 0)


def hash_title(text: Column, name: Column) -> Column:
    """The first ``# `` heading of the first ten lines, else ``name``."""
    first = F.get(F.filter(F.slice(F.split(text, "\n"), 1, 10), lambda line: line.startswith("# ")), F.lit(0))
    return F.coalesce(T.strip(F.substring(first, F.lit(3), F.length(first))), name)


# Fixed value: the line below a table's headings.
RULE_LINE = r"^\|?[\s\-:]+(?:\|[\s\-:]+)+\|?$"


def tables(text: Column) -> Column:
    """Array of (headers, rows) of the pipe tables of a text, in order; rows are filled up or cut to the headers' number.

    A table is a run of two lines or more that start and end with a pipe. The
    pattern's repeats are possessive, so a long run costs neither stack nor retries.
    """
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), T.strip)

    def parsed(lines):
        headers = cells(lines[0])
        body = F.when(lines[1].rlike(RULE_LINE), F.slice(lines, 3, F.size(lines))).otherwise(F.slice(lines, 2, F.size(lines)))
        return T.let(headers, lambda h: F.struct(h.alias("headers"), F.transform(body, lambda line: F.slice(F.concat(cells(line), F.array_repeat(F.lit(""), F.size(h))), F.lit(1), F.size(h))).alias("rows")))

    runs = F.regexp_extract_all(text, F.lit(r"(?dm)(?:^[^\S\n]*\|[^\n]*\|[^\S\n]*(?:\n|\z))++"), F.lit(0))
    lined = F.transform(runs, lambda run: F.filter(F.transform(F.split(run, "\n"), T.strip), lambda line: line != ""))
    return F.transform(F.filter(lined, lambda lines: F.size(lines) > 1), parsed)


def table_markdown(table: Column) -> Column:
    """A parsed table as Markdown."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = row(F.transform(table["headers"], lambda _: F.lit("---")))
    return F.array_join(F.concat(F.array(row(table["headers"]), rule), F.transform(table["rows"], row)), "\n")
