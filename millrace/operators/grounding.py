"""Whether an answer stands on its source, and quality figures built on that, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunks as C

# Words that do not count as shared, units, and placeholders for a missing citation.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "of", "to", "in", "for", "with",
    "on", "at", "by", "from", "as", "is", "was", "are", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "this", "that", "these", "those", "we",
    "you", "it", "they", "which", "what", "where", "when", "how", "can", "could", "will",
    "would", "should", "may", "might", "must", "each", "all", "both", "such", "than",
)
UNITS = r"\b(?:m/s|km/s|m/s\^2|eV|keV|MeV|GeV|TeV|J|kJ|MJ|N|kN|Pa|kPa|MPa|GPa|Hz|kHz|MHz|GHz|K|°C|mol|kmol|kg|g|mg|μg|C|V|mV|kV|A|mA|μA|Ω|kΩ|MΩ|T|mT|W|kW|MW|GW|rad|sr|Å|nm|μm|mm|cm|km)\b"
PLACEHOLDER = r"(?i)\[(?:citation\s+needed|\?|xx|todo)\]"
QUANTITY = r"\b\d+(?:\.\d+)?(?:e[+-]?\d+)?\b"
REASONING = "because|therefore|thus|hence|leads to|consequently|step"
# Signs and words of an equation, and the rules of tables made in an answer.
SYMBOL = r"[a-zA-Z∂∇∫∑ρσλθ\\]+"
TABLE_RULES = ("| --- |", "|:---:|")


def letters(text: Column) -> Column:
    """Distinct lower-case words of three plain letters or more."""
    return F.array_distinct(F.filter(T.tokens(text), lambda w: w.rlike("^[a-z]{3,}$")))


def key_words(text: Column) -> Column:
    """:func:`letters` without the stop words."""
    return F.array_except(letters(text), F.array(*[F.lit(w) for w in STOPWORDS]))


def delimiters_even(text: Column) -> Column:
    """Code fences and display marks come in pairs, and brackets nest."""
    return (T.occurrences(text, "```") % 2 == 0) & (T.occurrences(text, "$$") % 2 == 0) & T.balanced(text)


def unknown_symbols(answer: Column, source: Column) -> Column:
    """Symbols of the answer's display equations that a source without equations does not hold."""
    shown = F.regexp_extract_all(answer, F.lit(r"(?s)\$\$(.*?)\$\$"), F.lit(1))
    symbols = F.flatten(F.transform(shown, lambda e: F.regexp_extract_all(e, F.lit(SYMBOL), F.lit(0))))
    strange = T.let(F.lower(source), lambda low: F.filter(symbols, lambda s: (F.length(s) > 1) & ~low.contains(F.lower(s)) & ~s.startswith("\\")))
    return F.when((F.size(shown) > 0) & (F.size(C.equations(source)) == 0), strange).otherwise(F.array().cast("array<string>"))


def made_table(answer: Column, source: Column) -> Column:
    """The answer has a table and the source none."""
    has = answer.contains(TABLE_RULES[0]) | answer.contains(TABLE_RULES[1])
    return has & ~source.rlike(r"(?m)^[ \t]*\|.*\|[ \t]*$")


def overlap(answer: Column, source: Column) -> Column:
    """Share of the answer's key words that the source holds; 1 for an answer without any."""
    return T.let(key_words(answer), lambda a: F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, key_words(source))) / F.size(a)))


def evaluate(question: Column, answer: Column, source: Column, least: float = 0.2) -> Column:
    """Struct of even, n_unknown, made_table, overlap and reason (null if grounded); the first rule broken is the reason."""
    facts = F.struct(
        delimiters_even(F.concat(question, F.lit(" "), answer)).alias("even"),
        F.size(unknown_symbols(answer, source)).cast("long").alias("n_unknown"),
        made_table(answer, source).alias("made_table"),
        overlap(answer, source).alias("overlap"),
    )

    def judged(f):
        reason = F.when(~f["even"], "delimiters").when(f["n_unknown"] > 2, "symbols").when(f["made_table"], "table").when(f["overlap"] < least, "overlap")
        return F.struct(f["even"].alias("even"), f["n_unknown"].alias("n_unknown"), f["made_table"].alias("made_table"), f["overlap"].alias("overlap"), reason.alias("reason"))

    return T.let(facts, judged)


def composite_six(question: Column, answer: Column, grounding: Column, even: Column) -> Column:
    """Weighted score of correctness, grounding, relevance, clarity, completeness and technical accuracy: base values less penalties."""
    lines = F.filter(F.transform(F.split(answer, "\n"), T.strip), lambda x: x != "")
    repeats = T.let(lines, lambda x: F.when(F.size(x) > 0, 1.0 - F.size(F.array_distinct(x)) / F.size(x)).otherwise(0.0)) > 0.30
    broken = question.contains("�") | answer.contains("�")
    less = lambda rule, by: F.when(rule, by).otherwise(0.0)
    parts = (
        (F.lit(0.95) - less(~even, 0.25), 0.25),
        (grounding, 0.25),
        (F.lit(0.95) - less(T.n_words(question) < 5, 0.20), 0.15),
        (F.lit(0.94) - less(broken, 0.30) - less(repeats, 0.25), 0.10),
        (F.lit(0.92) - less(T.n_words(answer) < 20, 0.30) - less(repeats, 0.20), 0.10),
        (F.lit(0.95) - less(broken, 0.30), 0.15),
    )
    return sum((F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * weight for value, weight in parts), F.lit(0.0))


def composite_nine(question: Column, answer: Column, found: Column) -> Column:
    """Struct of score, grounding and passed from a result of :func:`evaluate`, over nine weighted dimensions."""
    grounding = F.when(found["reason"].isNotNull(), 0.0).otherwise(F.least(F.lit(1.0), found["overlap"] + 0.35))
    parts = (
        (F.when(found["even"] & (grounding >= 0.8), 0.95).otherwise(0.70), 0.20),
        (grounding, 0.25),
        (F.when(T.n_words(question) >= 8, 0.95).otherwise(0.85), 0.10),
        (F.when(answer.contains("###") | answer.contains("\n\n"), 0.95).otherwise(0.85), 0.10),
        (T.let(T.n_words(answer), lambda n: F.when(n >= 60, 0.95).when(n >= 30, 0.85).otherwise(0.70)), 0.10),
        (F.when(found["n_unknown"] == 0, 0.95).otherwise(0.60), 0.10),
        (F.when(F.lower(answer).rlike(REASONING), 0.95).otherwise(0.88), 0.05),
        (F.when(~answer.contains("$$"), 1.0).when(found["even"], 0.98).otherwise(0.40), 0.05),
        (F.when(~answer.contains("| --- |"), 1.0).when(~found["made_table"], 0.98).otherwise(0.40), 0.05),
    )
    score = sum((value * weight for value, weight in parts), F.lit(0.0))
    return T.let(F.struct(score.alias("score"), grounding.alias("grounding")), lambda s: F.struct(s["score"].alias("score"), s["grounding"].alias("grounding"), ((s["score"] >= 0.85) & (s["grounding"] >= 0.8) & found["reason"].isNull()).alias("passed")))


def scientific(question: Column, answer: Column, quantitative: Column) -> Column:
    """Struct of n_equations, even, n_units, has_numbers, placeholder, overlap and status of a record.

    FAILED: marks of equations that do not pair (escaped ones aside), brackets
    inside an equation that do not nest, a placeholder for a citation, or a
    quantitative question answered without a number; VALIDATION_UNCERTAIN: such
    a question answered without an equation; else VERIFIED.
    """
    bare = F.replace(answer, F.lit("\\$"), F.lit(""))
    pairs = (T.occurrences(bare, "$$") % 2 == 0) & (T.occurrences(F.replace(bare, F.lit("$$"), F.lit("")), "$") % 2 == 0)
    equations = F.regexp_extract_all(answer, F.lit(r"(?s)\$\$.*?\$\$|\$[^$]+\$"), F.lit(0))
    asked = letters(question)
    share = F.when((F.size(asked) > 0) & (F.size(letters(answer)) > 0), F.size(F.array_intersect(asked, letters(answer))) / F.size(asked)).otherwise(1.0)
    facts = F.struct(
        F.size(equations).cast("long").alias("n_equations"),
        (pairs & F.forall(equations, T.balanced)).alias("even"),
        F.size(F.array_distinct(F.regexp_extract_all(answer, F.lit(UNITS), F.lit(0)))).cast("long").alias("n_units"),
        answer.rlike(QUANTITY).alias("has_numbers"),
        answer.rlike(PLACEHOLDER).alias("placeholder"),
        F.round(share, 6).alias("overlap"),
        quantitative.alias("quantitative"),
    )

    def judged(f):
        status = F.when(~f["even"] | f["placeholder"] | (f["quantitative"] & ~f["has_numbers"]), "FAILED").when(f["quantitative"] & (f["n_equations"] == 0), "VALIDATION_UNCERTAIN").otherwise("VERIFIED")
        return F.struct(*[f[n].alias(n) for n in ("n_equations", "even", "n_units", "has_numbers", "placeholder", "overlap")], status.alias("status"))

    return T.let(facts, judged)
