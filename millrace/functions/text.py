"""Text functions as Columns: they stay inside whole-stage code generation.

Word and space classes are Unicode ones (``(?U)``); a null text gives null
unless a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Role names of other formats.
ROLES = {"human": "user", "client": "user", "customer": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "response": "assistant"}
# Private-use glyphs of equation editors and what they stand for.
GLYPHS = {
    0xF8EB: "(", 0xF8EC: "(", 0xF8ED: "(", 0xF8EE: "{", 0xF8EF: "|", 0xF8F0: "}", 0xF8F1: "[", 0xF8F2: "[", 0xF8F3: "[", 0xF8F4: "|",
    0xF8F6: ")", 0xF8F7: ")", 0xF8F8: ")", 0xF8F9: "}", 0xF8FA: "|", 0xF8FB: "{", 0xF8FC: "]", 0xF8FD: "]", 0xF8FE: "]",
    0xF072: " \\vec{} ", 0xF026: " \\partial ", 0xF075: " \\upsilon ", 0xF0A7: " • ", 0xF03D: " = ", 0xF02B: " + ", 0xF02D: " - ", 0xF0B1: " ± ", 0xF0B4: " × ", 0xF0B8: " ÷ ",
}
# Running headers of preprints and course notes.
HEADERS = (
    r"(?im)^\s*arXiv:\d{4}\.\d{4,5}(?:v\d+)?\s*\[[a-zA-Z\.\-]+\]\s*.*$",
    r"(?im)^\s*NPTEL\s*[-–—]\s*.*$",
    r"(?im)^\s*Joint\s+Initiative\s+of\s+IITs\s+and\s+IISc\s*[-–—]?\s*.*$",
    r"(?im)^\s*Funded\s+by\s+MHRD\s*[-–—]?\s*.*$",
)
# What a log line must not show.
SECRETS = ((r"(?i)(password|secret|token|key|api_key|auth)\s*[:=]\s*[\"']?([^\"'\s]+)[\"']?", "$1: [REDACTED]"), (r"Bearer\s+[A-Za-z0-9\-\._~\+/]+=*", "Bearer [REDACTED]"))


def strip(text: Column) -> Column:
    """Without white space at both ends. The end is looked for once per run of white space, so long runs cost no more than their length."""
    return F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s++$", "")


def strip_ends(text: Column) -> Column:
    """:func:`strip` of a stored column, whose two ends are looked at first; most texts need no more."""
    blank = lambda c: c.rlike(r"(?U)\s")
    return F.when(blank(F.substring(text, 1, 1)) | blank(F.substring(text, -1, 1)), strip(text)).otherwise(text)


def collapse(text: Column) -> Column:
    """Stripped, and every run of white space one blank."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Parts between white space; none for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))


@F.udf(StringType(), useArrow=False)
def _composed(form: str, text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize(form, text)


def _normal(form: str, text: Column, plain: str) -> Column:
    """``text`` in a normal form. Texts of ``plain`` characters alone are in it already and stay where they are.

    Spark has no such function, so the others go through Python, and not in
    Arrow batches: those hold 10,000 texts at once, plain batches a hundred, so
    that a worker's memory follows the texts' size and not the table's.
    """
    return F.coalesce(_composed(F.lit(form), F.when(text.rlike(f"[^{plain}]"), text)), text)


def nfc(text: Column) -> Column:
    """Canonical composition. No character below U+0300 composes with one before it or is composed anew."""
    return _normal("NFC", text, r"\x00-\u02FF")


def nfkc(text: Column) -> Column:
    """Compatibility composition. No character below U+00A0 stands for another."""
    return _normal("NFKC", text, r"\x00-\x9F")


def plain_lines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def no_controls(text: Column) -> Column:
    """Without characters of the categories C*, but LF and TAB."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def trim_lines(text: Column) -> Column:
    """Lines without trailing blanks; no blank lines first or last."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\x0B\f]+(?=\n|$)", ""), r"^\n+|\n+$", "")


def role(name: Column) -> Column:
    """Known role names as user, assistant or system; empty is user, others stay."""
    name = F.lower(strip(F.coalesce(name, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.when(name == "", F.lit("user")).otherwise(F.coalesce(F.element_at(known, name), name))


def glyphs(text: Column) -> Column:
    """Private-use glyphs by what they stand for; others, and U+FFFD, as a blank."""
    single = {chr(k): v for k, v in GLYPHS.items() if len(v) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    for code, value in GLYPHS.items():
        if len(value) > 1:
            text = F.replace(text, F.lit(chr(code)), F.lit(value))
    return F.regexp_replace(text, "[-�]", " ")


def dehyphenate(text: Column) -> Column:
    """Words cut at a line's end are joined; ``word- word`` loses its blank."""
    text = F.regexp_replace(text, r"([a-zA-Z]{2,})-\s*[\r\n]+\s*([a-zA-Z]{2,})", "$1$2")
    return F.regexp_replace(text, r"([a-zA-Z]{3,})-\s+([a-zA-Z]{3,})", "$1-$2")


def no_page_numbers(text: Column) -> Column:
    """Without lines that only number a page."""
    text = F.regexp_replace(text, r"(?m)^\s*(?:Page\s+)?\d+(?:\s+of\s+\d+)?\s*$", "")
    return F.regexp_replace(text, r"(?m)^\s*\[\d+\]\s*$", "")


def no_headers(text: Column, more: tuple[str, ...] = ()) -> Column:
    """Without running headers."""
    for pattern in (*HEADERS, *more):
        text = F.regexp_replace(text, pattern, "")
    return text


# What a line of a formula that was cut apart may be, which signs a formula must hold, and where such a line ends at most.
FRAGMENTS = ("(", ")", "[", "]", "{", "}", "+", "-", "=", "±", "×", "•", "∂", "∇", "∫", "∫∫", "∫∫∫", "cv", "s", "v", "ds", "dt", "dx", "dy", "dz", "dxdydz", "ρ", "σ", "λ", "θ")
FRAGMENT = r"^[∂∇+\-=()\[\]·^/\\\s\p{L}\p{N}\p{M}_]+$"
NUMBERED = r"^\(\d+(?:\.\d+)*\)$"
FORMULA = r"∂|∇|∫|∑|ρ|σ|λ|θ|vec|hat|alpha|beta|psi"
RELATION = r"[=+-]|\(\d+(?:\.\d+)*\)"
LONGEST_FRAGMENT = 25
# Two code points that are no characters stand for "this line is a fragment" and "joined here".
MARK, SEAM = "\ufdd0", "\ufdd1"


def join_formulas(text: Column) -> Column:
    """Runs of short formula lines become one ``$$...$$`` block if they hold a formula, and stay lines (stripped) if not.

    Fragments are marked, a pattern joins marked neighbours, and each run is
    judged once: linear in the text, without a fold. Blank lines end a run and
    become empty; U+FDD0 and U+FDD1, which are no characters, are taken out.
    """

    def marked(line, bare):
        short = (F.length(bare) <= LONGEST_FRAGMENT) & (bare.isin(*FRAGMENTS) | bare.rlike(f"(?U){FRAGMENT}") | bare.rlike(NUMBERED)) & ~(bare.endswith(".") & (F.length(bare) > 6))
        return F.when(bare == "", "").when(short, F.concat(F.lit(MARK), bare)).otherwise(line)

    def judged(run):
        block = F.replace(run, F.lit(SEAM), F.lit(" "))
        whole = F.concat(F.lit("\n$$"), block, F.lit("$$\n"))
        return F.when(block.rlike(FORMULA) & block.rlike(RELATION), whole).otherwise(F.replace(run, F.lit(SEAM), F.lit("\n")))

    lines = F.transform(F.split(F.translate(text, MARK + SEAM, ""), "\n"), lambda line: let(strip(line), lambda bare: marked(line, bare)))
    joined = F.regexp_replace(F.array_join(lines, "\n"), f"({MARK}[^\n]*)\n(?={MARK})", f"$1{SEAM}")
    runs = F.transform(F.split(joined, "\n"), lambda run: F.when(run.startswith(MARK), judged(F.translate(run, MARK, ""))).otherwise(run))
    return F.array_join(runs, "\n")


def spaces(text: Column) -> Column:
    """No-break blanks as blanks, no zero-width ones, at most one empty line, one blank in a row."""
    text = F.replace(F.replace(text, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def document(text: Column) -> Column:
    """The whole chain for extracted documents, in order."""
    return spaces(join_formulas(dehyphenate(no_page_numbers(no_headers(nfkc(glyphs(text)))))))


def redact_log(text: Column) -> Column:
    """Without terminal escapes and secrets, and safe to show in HTML."""
    text = F.regexp_replace(text, r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "")
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


# Parts of keys whose values an event must not show.
HIDDEN_KEYS = "password|secret|token|api_key|cookie|auth"


HIDDEN = "[REDACTED]"
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]++|\s++|"', re.S)
_HIDDEN_KEY = re.compile(HIDDEN_KEYS, re.I)


def hide(text: str | None) -> str | None:
    """JSON text with the values of telling keys replaced, at any depth, whatever they hold; all else stays as it is.

    One pass over the tokens with a depth instead of a stack of calls, so nesting
    has no limit. Text that is no JSON is passed on as far as it reads like it.
    """
    if text is None:
        return None
    out, key, pending, depth = [], None, False, 0
    for found in _JSON_TOKEN.finditer(text):
        token = found.group()
        if depth:  # inside a hidden object or list
            depth += (token in "{[") - (token in "}]")
            continue
        if pending and not token.isspace():
            pending = False
            out.append(f'"{HIDDEN}"')
            if token in "{[":
                depth = 1
            elif token in "}],":
                out[-1] = token
            continue
        if token == ":" and key is not None and _HIDDEN_KEY.search(key):
            pending = True
        if not token.isspace():
            key = token if token[0] == '"' else None
        out.append(token)
    return "".join(out)


@F.pandas_udf(StringType())
def _hide(text: pd.Series) -> pd.Series:
    return text.map(hide)


def redact_json(text: Column) -> Column:
    """:func:`hide` in Arrow batches: what nests without a limit is beyond a pattern."""
    return _hide(text)


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` occurs, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used (also inside other lambdas)."""
    return F.transform(F.array(value), use)[0]


def ngrams(parts: Column, n: int) -> Column:
    """Runs of ``n`` parts, joined by blanks, in order; none if there are fewer."""
    runs = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(p, i, n), " "))
    return let(parts, lambda p: F.when(F.size(p) >= n, runs(p)).otherwise(F.array().cast("array<string>")))


def shingles(text: Column, n: int = 3, short: str = "whole") -> Column:
    """Distinct word n-grams. Short texts: ``whole`` (one gram), ``tokens`` (their words) or ``none``."""
    none = F.array().cast("array<string>")

    def made(parts):
        few = {"whole": F.when(F.size(parts) > 0, F.array(F.array_join(parts, " "))).otherwise(none), "tokens": parts, "none": none}[short]
        return F.array_distinct(F.when(F.size(parts) >= n, ngrams(parts, n)).otherwise(few))

    return let(tokens(text), made)


def gram_hashes(text: Column, n: int = 3, short: str = "whole") -> Column:
    """Distinct word n-grams as 64-bit hashes, made from the hashes of the words; short texts as in :func:`shingles`."""
    none = F.array().cast("array<long>")

    def made(parts):
        few = {"whole": F.when(F.size(parts) > 0, F.array(F.xxhash64(parts))).otherwise(none), "tokens": parts, "none": none}[short]
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1))), lambda i: F.xxhash64(*[F.try_element_at(parts, i + k) for k in range(n)]))
        return F.array_distinct(F.when(F.size(parts) >= n, runs).otherwise(few))

    return let(F.transform(tokens(text), lambda w: F.xxhash64(w)), made)


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the collapsed lower-case text; a short text is one."""

    def made(flat):
        runs = lambda signs: F.transform(F.sequence(F.lit(1), F.size(signs) - n + 1), lambda i: F.concat(*[F.element_at(signs, i + k) for k in range(n)]))
        return F.when(F.length(flat) == 0, F.array().cast("array<string>")).when(F.length(flat) <= n, F.array(flat)).otherwise(F.array_distinct(let(F.split(flat, ""), runs)))

    return let(collapse(F.lower(text)), made)


def repetition(parts: Column, n: int) -> Column:
    """Share of n-grams that repeat an earlier one."""
    return let(ngrams(parts, n), lambda g: F.coalesce((F.size(g) - F.size(F.array_distinct(g))) / F.nullif(F.size(g), F.lit(0)), F.lit(0.0)))


def balanced(text: Column) -> Column:
    """Whether the brackets ``(){}[]`` nest: a fold over them with a stack of the open ones."""
    signs = F.split(F.regexp_replace(text, r"[^(){}\[\]]", ""), "")
    closes = F.create_map(*[F.lit(x) for x in (")", "(", "]", "[", "}", "{")])
    start = F.struct(F.lit("").alias("open"), F.lit(True).alias("ok"))

    def step(state, sign):
        opener = F.element_at(closes, sign)
        top = F.substring(state["open"], 1, 1)
        opened = F.struct(F.concat(sign, state["open"]).alias("open"), state["ok"].alias("ok"))
        closed = F.struct(F.substring(state["open"], F.lit(2), F.lit(1 << 30)).alias("open"), (state["ok"] & (top == opener)).alias("ok"))
        return F.when(sign == "", state).when(opener.isNull(), opened).otherwise(closed)

    return F.aggregate(signs, start, step, lambda s: s["ok"] & (s["open"] == ""))


def estimate(text: Column, kind: str = "chunk") -> Column:
    """Tokens of a text by rule: ``chunk`` max(words, chars/4), ``suite`` words times 1.3 up, ``audit`` words times 1.3."""
    n = n_words(text)
    if kind == "chunk":
        return F.greatest(n, F.floor(F.length(text) * 0.25).cast("int")).cast("long")
    return (F.ceil(n * F.lit(1.3)) if kind == "suite" else F.floor(n * F.lit(1.3))).cast("long")


def formatting(text: Column) -> Column:
    """1 less 0.3 for an open code fence and 0.1 for each kind of bracket whose counts differ; 0 for a blank text."""
    score = F.lit(1.0) - F.when(occurrences(text, "```") % 2 != 0, 0.3).otherwise(0.0)
    for left, right in ("{}", "[]", "()"):
        score = score - F.when(occurrences(text, left) != occurrences(text, right), 0.1).otherwise(0.0)
    return F.when(strip(text) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.round(score, 2)))
