"""Knowledge units: what a text holds, how dense its mathematics is, how hard it is, and which tasks suit it.

All are Columns over one text with the numbers of its equations and tables; a
null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

# Signs of mathematics, formulas between marks, and the phrases that tell each kind of content.
SIGNS = r"[$\=+\-*/^_(){}\[\]\d]|\\(?:alpha|beta|gamma|delta|omega|nabla|partial|int|sum|frac|sqrt)"
FORMULAS = r"(?s)\$\$.*?\$\$|\$.*?\$|\\\[.*?\\\]|\\\(.*?\\\)"
DEFINITION = (r"(?i)\b(?:is|are)\s+defined\s+as\b", r"(?i)\brefers\s+to\b", r"(?i)\bdenotes\b", r"(?i)\b(?:we\s+define|definition\s*[:\-])\b", r"(?i)\bis\s+called\s+the\b", r"(?i)\bknown\s+as\s+the\b")
DERIVATION = (
    r"(?i)\b(?:we\s+derive|derivation|deriving)\b", r"(?i)\bsubstituting\s+(?:eq|equation|\(.*?\))\b", r"(?i)\bdifferentiating\s+with\s+respect\s+to\b", r"(?i)\bintegrating\s+both\s+sides\b",
    r"(?i)\btaking\s+the\s+limit\b", r"(?i)\bfrom\s+(?:eq|equation)\s+\(?\d+\)?\s*,\s*we\s+obtain\b", r"(?i)\byields\s+the\s+(?:following|relation)\b",
)
CALCULATION = (
    r"\b\d+(?:\.\d+)?\s*(?:m/s|km/s|m/s\^2|eV|keV|MeV|GeV|J|kJ|N|Pa|kPa|MPa|Hz|kHz|MHz|GHz|K|°C|mol|kg|g|mg|C|V|A|mA|Ω|T|W|kW|MW)\b",
    r"(?i)\b(?:calculate|determine|compute|find\s+the\s+value|numerical\s+value)\b",
)
EXPERIMENT = (r"(?i)\b(?:experiment|experimental\s+setup|apparatus|measurement|measured|sample|detector|spectroscopy)\b", r"(?i)\b(?:laboratory|observed|trial|observation|calibrated)\b")
COMPARISON = (r"(?i)\b(?:whereas|in\s+contrast\s+to|compared\s+(?:with|to)|differs\s+from|on\s+the\s+other\s+hand)\b", r"(?i)\b(?:distinction\s+between|versus|vs\.?)\b")
METHODOLOGY = (r"(?i)\b(?:methodology|formalism|formulation|theoretical\s+framework|algorithm|protocol)\b",)
CONCLUSION = (r"(?i)\b(?:in\s+conclusion|to\s+summarize|summary|concluding\s+remarks|we\s+have\s+demonstrated)\b",)
# Tasks that each kind of content allows, in their order.
TASKS = (
    (("derivation",), ("proof", "explanation", "reasoning")),
    (("calculation",), ("calculation", "problem_solving")),
    (("table_data",), ("data_interpretation", "analysis")),
    (("comparison",), ("comparison", "analysis")),
    (("experiment", "methodology"), ("analysis", "scenario_analysis")),
    (("conclusion",), ("summarization",)),
    (("definition",), ("question_answering", "explanation")),
    (("concept",), ("explanation", "question_answering")),
)
LEAST_WORDS, TALK_WORDS = 25, 80


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    found = text.rlike(patterns[0])
    for p in patterns[1:]:
        found |= text.rlike(p)
    return found


def _count(text: Column, *patterns: str) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in patterns[1:]), F.regexp_count(text, F.lit(patterns[0])))


def analysed(units: DataFrame, text: str = "text", equations: str = "n_equations", tables: str = "n_tables") -> DataFrame:
    """Adds n_words, math_density, definition_density, content (array), difficulty and rationale."""
    x, eq, tab = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(equations), F.lit(0)), F.coalesce(F.col(tables), F.lit(0))
    size = F.greatest(F.length(x), F.lit(1))
    formulas = _count(x, FORMULAS)
    rows = units.withColumns({"n_words": F.when(x == "", 0).otherwise(T.n_words(x)), "_formulas": formulas, "_defined": _count(x, *DEFINITION)})
    rows = rows.withColumn("math_density", F.least(F.lit(1.0), (_count(x, SIGNS) + F.col("_formulas") * 20) / size))
    d = F.col("math_density")
    held = {
        "definition": F.col("_defined") > 0,
        "derivation": _any(x, DERIVATION) | ((eq > 0) & (d > 0.15)),
        "equation": (eq > 0) | (F.col("_formulas") > 0) | (d > 0.08),
        "calculation": _any(x, CALCULATION),
        "experiment": _any(x, EXPERIMENT),
        "comparison": _any(x, COMPARISON),
        "methodology": _any(x, METHODOLOGY),
        "conclusion": _any(x, CONCLUSION),
        "table_data": (tab > 0) | F.contains(x, F.lit("|---|")),
    }
    named = F.array_compact(F.array(*[F.when(holds, kind) for kind, holds in held.items()]))
    content = T.let(named, lambda c: F.when((F.size(c) == 0) | F.array_contains(c, "definition"), F.array_append(c, "concept")).otherwise(c))
    rows = rows.withColumns({
        "content": F.when(x == "", F.array().cast("array<string>")).otherwise(content),
        "definition_density": F.when(F.col("_defined") > 0, F.least(F.lit(1.0), F.col("_defined") / (F.col("n_words") / 50 + 1))).otherwise(0.0),
    })
    has = lambda *kinds: F.arrays_overlap("content", F.array(*[F.lit(k) for k in kinds]))
    words = F.col("n_words")
    reason = (
        F.when(x == "", "empty")
        .when(has("derivation") & ((eq >= 2) | (d >= 0.20)), F.when((words > 300) | (eq >= 4), "long_derivation").otherwise("derivation"))
        .when(has("calculation") | (has("equation") & (d >= 0.10)), "quantitative")
        .when(has("methodology", "experiment"), "methodical")
        .when(has("definition", "concept"), F.when(words > 250, "long_concept").otherwise("concept"))
        .otherwise("standard")
    )
    level = {"empty": "beginner", "long_derivation": "expert", "derivation": "advanced", "quantitative": "intermediate", "methodical": "advanced", "long_concept": "intermediate", "concept": "beginner", "standard": "intermediate"}
    known = F.create_map(*[F.lit(x) for pair in level.items() for x in pair])
    return rows.withColumn("rationale", reason).withColumn("difficulty", F.element_at(known, F.col("rationale"))).drop("_formulas", "_defined")


def selected(units: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Units that are long enough for a task."""
    return units.where(T.n_words(F.coalesce(F.col(text), F.lit(""))) >= least)


def tasks(content: Column, n_words: Column, most: int = 3, talks: bool = True) -> Column:
    """Tasks that the content of a unit allows, each once, in order, at most ``most``."""
    none = F.array().cast("array<string>")
    parts = [F.when(F.arrays_overlap(content, F.array(*[F.lit(k) for k in kinds])), F.array(*[F.lit(t) for t in allowed])).otherwise(none) for kinds, allowed in TASKS]
    if talks:
        parts.append(F.when(n_words >= TALK_WORDS, F.array(F.lit("multi_turn"))).otherwise(none))
    found = F.array_distinct(F.concat(*parts))
    return F.slice(F.when(F.size(found) == 0, F.array(F.lit("explanation"))).otherwise(found), 1, most)


# Fixed values of the chunk analysis: signs that make a formula substantial, numbered equations, definitions (term and meaning, or term alone), laws, steps of a derivation, measured numbers.
SUBSTANTIAL = r"[∂∇∫∑∏√±×÷≡≈≠≤≥∝αβγδεθλμπρστφψω\\]"
EQUATION_NUMBER = r"(?:Eq(?:uation)?\.?\s*\((\d+(?:\.\d+)*)\)|\((\d+(?:\.\d+)*)\)\s*$)"
TERM = r"(?i)([A-Z][a-zA-Z\s]{2,30})"
MEANINGS = (
    r"(?i)([A-Z][a-zA-Z\s]{2,30})\s+is\s+(?:defined|known|referred to)\s+as\s+([^.\n]+)", r"(?i)([A-Z][a-zA-Z\s]{2,30})\s+(?:represents|denotes|signifies)\s+([^.\n]+)",
    r"(?i)([A-Z][a-zA-Z\s]{2,30})\s+states\s+that\s+([^.\n]+)",
)
NAMED = r"(?i)called\s+(?:the\s+)?([a-zA-Z\s]{3,30})[.\n]"
LAWS = (
    r"(?i)\b(?:Newton's\s+(?:first|second|third)?\s*law|conservation\s+of\s+(?:mass|momentum|energy|charge)|Gauss(?:'s)?\s+theorem|Schrodinger\s+equation|Navier[- ]Stokes\s+equation|Euler\s+equation"
    r"|Bernoulli(?:'s)?\s+equation|First\s+law\s+of\s+thermodynamics|Second\s+law\s+of\s+thermodynamics|Heisenberg\s+uncertainty\s+principle)\b"
)
STEPS = (
    r"(?i)\b(?:substituting|introducing|differentiating|integrating|simplifying|expanding|yielding)\b", r"(?i)\b(?:we\s+obtain|we\s+get|which\s+gives|leads\s+to|can\s+be\s+written\s+as)\b",
    r"(?i)\b(?:from\s+equation|using\s+Eq|by\s+Gauss|by\s+Newton)\b",
)
MEASURED = (
    r"\b\d+(?:\.\d+)?\s*(?:[eE][+-]?\d+)?\s*(?:m/s|km/s|m/s\^2|eV|keV|MeV|GeV|TeV|J|kJ|N|kN|Pa|kPa|MPa|Hz|kHz|MHz|GHz|K|°C|mol|kg|g|mg|V|mV|kV|A|mA|Ω|kΩ|W|kW|MW|nm|μm|mm|cm|km|rad)\b",
    r"\b\d+\s*[%°]\b",
)
#: Head, rule and first row of a pipe table.
TABLE_HEAD = r"(?m)^\|.+\|\n\|\s*[-:]+[-| :]*\|\n\|.+\|"


def chunk_analysis(text: Column) -> Column:
    """Struct of a chunk: equations in order, number of tables, definitions (term, meaning), laws, whether it derives and measures, and its difficulty."""
    x = T.strip(F.coalesce(text, F.lit("")))
    every = lambda t, p, g: F.regexp_extract_all(t, F.lit(p), F.lit(g))
    kept = lambda parts, good: F.filter(F.transform(parts, T.strip), good)

    def read(t: Column) -> Column:
        display = kept(every(t, r"(?s)\$\$(.*?)\$\$", 1), lambda e: F.length(e) > 2)
        inline = kept(every(t, r"(?<!\$)\$(?!\$)(.*?)(?<!\$)\$(?!\$)", 1), lambda e: (F.length(e) > 3) & (e.contains("=") | e.rlike(SUBSTANTIAL)))
        numbered = kept(F.split(t, "\n"), lambda e: ~e.startswith("$$") & ~e.endswith("$$") & e.rlike(EQUATION_NUMBER) & e.rlike(SUBSTANTIAL))
        fits = lambda d: (F.length(d["term"]) > 2) & (F.length(d["term"]) < 50) & ((d["meaning"] == "") | (F.length(d["meaning"]) > 5) & (F.length(d["meaning"]) < 250))
        pair = lambda a, b: F.struct(T.strip(a).alias("term"), T.strip(b).alias("meaning"))
        # Terms are dear to look for, so a text is first asked whether what follows them stands there at all.
        cue = lambda p: "(?i)" + p.removeprefix(TERM)
        part = lambda m, p, g: F.regexp_extract(m, p, g)
        found = lambda p: F.when(t.rlike(cue(p)), every(t, p, 0)).otherwise(F.array().cast("array<string>"))
        by = lambda p: F.transform(found(p), lambda m: pair(part(m, p, 1), part(m, p, 2)))
        stated = [F.filter(by(p), lambda d: d["meaning"] != "") for p in MEANINGS]
        named = F.transform(every(t, NAMED, 1), lambda n: pair(n, F.lit("")))
        derives, tables, words = _any(t, STEPS), F.regexp_count(t, F.lit(TABLE_HEAD)), T.n_words(t)
        eqs = F.array_distinct(F.concat(display, inline, numbered))

        def judged(e: Column) -> Column:
            n = F.size(e)
            level = F.when((n >= 3) | ((n >= 1) & derives & (words > 250)), "advanced").when((n >= 1) | (tables >= 1) | derives | (words > 180), "intermediate").otherwise("beginner")
            return F.struct(
                e.alias("equations"), tables.alias("n_tables"), F.filter(F.concat(*stated, named), fits).alias("definitions"), F.array_sort(F.array_distinct(every(t, LAWS, 0))).alias("laws"),
                derives.alias("has_derivation"), _any(t, MEASURED).alias("has_numbers"), level.alias("difficulty"),
            )

        return T.let(eqs, judged)

    return T.let(x, read)
