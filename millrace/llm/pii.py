"""Personal data: patterns propose spans, validators confirm, context scores.

Every text is scanned once, inside the executors, whatever its length. The
four base kinds (email, ip, card, phone) are fixed patterns whose confirmed
matches always stay. Two further kinds need more evidence: an IBAN must pass
mod-97, and a national phone number must have a context word nearby.

Defined cases: a null text counts as empty and yields no spans; a null or
repeated ``doc_id`` is carried through row by row; an empty table gives an
empty result; further columns of the input are ignored, whatever their names.
Spans are code point offsets, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import fresh

#: Order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "tel")
BASE_KINDS = KINDS[:4]
ACCEPT = 0.6
CONTEXT_CHARS = 40

# Score before context, and the words that raise it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.75, "iban": 0.7, "tel": 0.3}
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write", "schreib", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "tel": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
}
CONTEXT_GAIN = 0.35
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

# Possessive repeats and digit guards keep each scan linear on hostile texts;
# they accept exactly what the plain patterns accept.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_TEL = re.compile(r"(?<![0-9+])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.rank]


def luhn(digits: str) -> bool:
    """The check-digit rule of payment cards."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: rearranged and read base 36, the rest is 1."""
    code = iban.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(ch, 36)) for ch in code[4:] + code[:4])) % 97 == 1


def _only_digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # first code point that no earlier match or sign holds
    at = text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL_CHARS))
        free = at + 1
        if start < at and (tail := _DOMAIN.match(text, at)):
            yield start, tail.end()
            free = tail.end()
        at = text.find("@", free)


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans by start that cover the same code points."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _score(text: str, rank: int, start: int, end: int) -> float:
    """Prior of the kind, raised once if a context word stands near."""
    kind = KINDS[rank]
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    words = {w.lower() for w in _WORD.findall(near)}
    return round(min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(w in words for w in CONTEXT_WORDS[kind])), 2)


def find_spans(text: str | None) -> list[Span]:
    """Confirmed spans of one text, by start and then kind."""
    if not text:
        return []
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split("."))]
        found += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m[0])) <= 15]
        found += [(4, m.start(), m.end()) for m in _IBAN.finditer(text) if mod97(m[0])]
        held = _merged((s, e) for _, s, e in found)
        found += [(5, m.start(), m.end()) for m in _TEL.finditer(text) if (i := bisect_left(held, (m.end(),))) == 0 or held[i - 1][1] <= m.start()]
    spans = (Span(s, rank, e, _score(text, rank, s, e)) for rank, s, e in found)
    return sorted(x for x in spans if x.rank < len(BASE_KINDS) or x.score >= ACCEPT)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    if not spans:
        return text
    out, at = [], 0
    for x in spans:
        if x.start >= at:
            out += [text[at : x.start], f"[{x.kind.upper()}]"]
        at = max(at, x.end)
    return "".join([*out, text[at:]])


SPAN_SCHEMA = "array<struct<kind:string,start:long,end:long,score:double>>"


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key and its spans.

    A narrow stage: no shuffle, one batch of texts in memory per task.
    """

    def scan(batches):
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            spans = [[{"kind": x.kind, "start": x.start, "end": x.end, "score": x.score} for x in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kinds)], names=["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan, f"key {kind}, spans {SPAN_SCHEMA}").withColumnRenamed("key", key)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``documents`` with its spans replaced in the text and ``n_chars`` set anew where the text changed."""

    def scan(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = batch.column(i).to_pylist()
            yield batch.set_column(i, batch.schema.field(i), pa.array([redact(t, find_spans(t)) for t in texts], pa.string()))

    before = fresh(docs, "_before")
    marked = docs.withColumn(before, F.xxhash64("text"))
    out = marked.mapInArrow(scan, marked.schema)
    changed = F.col(before) != F.xxhash64("text")
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(before)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, derived from :func:`detect`."""
    spans = detect(docs)
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in KINDS[4:]],
        F.array_max(F.transform("spans", lambda x: x["score"])).alias("top_score"),
    )


def sha256_of(spans: list[Span]) -> str:
    """The base digest of one text, for checks outside Spark."""
    return hashlib.sha256(",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans if x.rank < len(BASE_KINDS)).encode()).hexdigest()
