"""Queries of source adapters: raw items of four kinds of sources as records, with defaults and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import adapters as A
from millrace.plans.records import TRIMMED
from millrace.plans.registry import Tables, query

# Each kind of source comes in three shapes: v 0 names little, 1 names much, 2 is odd.
KIND = "CASE doc_id % 4 WHEN 0 THEN 'existing' WHEN 1 THEN 'documentation' WHEN 2 THEN 'human_authored' ELSE 'synthetic' END"
V = "CAST(floor(doc_id / 4) AS BIGINT) % 3"


def items(t: Tables):
    """doc_id, kind and the raw item of each document."""
    s = lambda **fields: F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
    text, lang, source, i = F.col("text"), F.col("lang"), F.col("source"), F.col("doc_id").cast("string")
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    st = lambda **fields: F.struct(*[c.alias(k) for k, c in fields.items()])
    shapes = {
        "existing": (
            s(question=text, answer=lang, topic=lang, quality_score=F.lit(0.25)),
            s(messages=F.array(say("gpt", text)), metadata=st(task_type=F.lit("chat"), source=F.lit("m"), source_type=F.lit("curated"), source_id=i), domain=F.lit("passed over")),
            s(other=text),
        ),
        "documentation": (
            s(title=source, content=text, doc_id=i, url=F.concat(F.lit("https://e.example/"), i)),
            s(question=F.concat(F.lit("What is "), lang), answer=text, content=F.lit("passed over"), source_id=F.concat(F.lit("s"), i), domain=lang, quality_score=F.lit(0.5), license=F.lit("MIT")),
            s(content=text, provenance=st(source=F.lit("p"), license=F.lit("BSD"))),
        ),
        "human_authored": (
            s(prompt=text, response=lang),
            s(instruction=text, output=lang, metadata=st(domain=lang, source_id=F.concat(F.lit("h"), i)), topic=F.lit("passed over")),
            s(messages=F.array(say("human", text), say("bot", lang)), difficulty=F.lit("expert")),
        ),
        "synthetic": (s(prompt=text, response=lang, generator=F.lit("g")), s(prompt=text, response=lang, metadata=st(generator_version=F.lit("2"), source_id=i)), s(prompt=text)),
    }
    v = F.expr(V)
    rows = t.documents.select("doc_id", F.expr(KIND).alias("kind"), *[F.when(v == 0, a).when(v == 1, b).otherwise(c).alias(k) for k, (a, b, c) in shapes.items()])
    return rows.withColumn("v", v)


SOURCE = A.Source(license="CC0", generator="maker", generator_version="9", now="2024-01-01T00:00:00+00:00")


def records(t: Tables):
    """doc_id, kind and the record of each document, by the adapter of its kind."""
    made = None
    for kind in ("existing", "documentation", "human_authored", "synthetic"):
        column = A.ADAPTERS[kind](F.col(kind), SOURCE)
        made = F.when(F.col("kind") == kind, column) if made is None else made.when(F.col("kind") == kind, column)
    return items(t).select("doc_id", "kind", made.alias("r"))


def _by(**of: tuple[str, str, str]) -> str:
    """A CASE over kind and v."""
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN CASE v WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END" for k, (a, b, c) in of.items()) + " END"


def three(x: str) -> tuple[str, str, str]:
    return (x, x, x)


TEXT = TRIMMED.format(c="text")
OWN = {
    "domain": _by(existing=three("'general_knowledge'"), documentation=("'linux_systems'", "lang", "'linux_systems'"), human_authored=("'programming'", "lang", "'programming'"), synthetic=three("'programming'")),
    "topic": _by(existing=("lang", "'general'", "'general'"), documentation=three("'documentation'"), human_authored=three("'python'"), synthetic=three("'python'")),
    "task_type": _by(existing=("'question_answering'", "'chat'", "'question_answering'"), documentation=three("'explanation'"), human_authored=three("'coding'"), synthetic=three("'coding'")),
    "difficulty": _by(existing=three("'intermediate'"), documentation=three("'intermediate'"), human_authored=("'intermediate'", "'intermediate'", "'expert'"), synthetic=three("'intermediate'")),
    "quality_score": _by(existing=("0.25::DOUBLE", "NULL", "NULL"), documentation=("0.9::DOUBLE", "0.5", "0.9"), human_authored=three("0.95::DOUBLE"), synthetic=three("0.9::DOUBLE")),
    "source": _by(existing=("'raw_ingestion'", "'m'", "'raw_ingestion'"), documentation=("'technical_documentation'", "'technical_documentation'", "'p'"), human_authored=three("'human_authored_internal'"), synthetic=three("'synthetic_generator'")),
    "source_type": _by(existing=("'raw'", "'curated'", "'raw'"), documentation=("'documentation'", "'documentation'", "'unknown'"), human_authored=three("'human_authored'"), synthetic=three("'synthetic'")),
    "source_id": _by(existing=("'ext_'", "CAST(doc_id AS VARCHAR)", "'ext_'"), documentation=("CAST(doc_id AS VARCHAR)", "'s' || doc_id", "NULL"), human_authored=("NULL", "'h' || doc_id", "NULL"), synthetic=("'synth_'", "CAST(doc_id AS VARCHAR)", "'synth_'")),
    "license": _by(existing=three("'CC0'"), documentation=("'CC0'", "'MIT'", "'BSD'"), human_authored=three("'CC0'"), synthetic=three("'CC0'")),
    "generator": _by(existing=three("'maker'"), documentation=("'maker'", "'maker'", "NULL"), human_authored=three("'maker'"), synthetic=("'g'", "'maker'", "'maker'")),
    "generator_version": _by(existing=three("'9'"), documentation=("'9'", "'9'", "NULL"), human_authored=three("'9'"), synthetic=("'9'", "'2'", "'9'")),
    "source_url": _by(existing=three("NULL"), documentation=("'https://e.example/' || doc_id", "NULL", "NULL"), human_authored=three("NULL"), synthetic=three("NULL")),
}
SAID = _by(
    existing=(f"'user:' || {TEXT} || '|assistant:' || lang", f"'assistant:' || {TEXT}", "''"),
    documentation=(f"'user:Explain the technical concepts behind ' || source || '.|assistant:' || {TEXT}", f"'user:What is ' || lang || '|assistant:' || {TEXT}", f"'user:Explain the technical concepts behind this topic.|assistant:' || {TEXT}"),
    human_authored=three(f"'user:' || {TEXT} || '|assistant:' || lang"),
    synthetic=(f"'user:' || {TEXT} || '|assistant:' || lang", f"'user:' || {TEXT} || '|assistant:' || lang", f"'user:' || {TEXT} || '|assistant:'"),
)
ITEMS = f"d AS (SELECT *, {KIND} AS kind, {V} AS v FROM documents)"


def _said():
    return F.md5(F.array_join(F.transform("r.messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").cast("binary")).alias("messages_md5")


def _shown_id():
    """Ids made from the raw item are shown by their prefix."""
    return F.regexp_replace("r.metadata.source_id", "^(ext|synth|rec)_[0-9a-f]+$", "$1_").alias("source_id")


@query("txt5_record_defaults", f"WITH {ITEMS} SELECT doc_id, {', '.join(f'{OWN[f]} AS {f}' for f in ('domain', 'topic', 'task_type', 'difficulty', 'quality_score', 'source', 'source_type'))} FROM d WHERE kind = 'existing'")
def _(t: Tables):
    rows = items(t).where("kind = 'existing'").select("doc_id", A.defaulted(F.col("existing")).alias("m"))
    return rows.select("doc_id", *[F.col(f"m.{f}") for f in ("domain", "topic", "task_type", "difficulty", "quality_score", "source", "source_type")])


@query("txt6_adapter_records", f"WITH {ITEMS} SELECT doc_id, kind, {', '.join(f'{x} AS {f}' for f, x in OWN.items())}, md5({SAID}) AS messages_md5 FROM d")
def _(t: Tables):
    fields = [F.col(f"r.metadata.{f}") for f in OWN if f not in ("source_id", "source_url")]
    return records(t).select("doc_id", "kind", *fields, _shown_id(), F.col("r.provenance.source_url"), _said())


FILLED = {"source_id": f"coalesce({OWN['source_id']}, 'rec_')", "generator": f"coalesce({OWN['generator']}, 'enricher')", "generator_version": f"coalesce({OWN['generator_version']}, '1.0.0')", "license": OWN["license"], "source": OWN["source"], "source_type": OWN["source_type"]}


@query("txt7_enriched_records", f"WITH {ITEMS} SELECT doc_id, {', '.join(f'{x} AS {f}' for f, x in FILLED.items())}, '2024-01-01T00:00:00+00:00' AS created_at, true AS agrees FROM d")
def _(t: Tables):
    rows = records(t).select("doc_id", A.enriched(F.col("r"), generator="enricher").alias("r"))
    same = [F.col(f"r.metadata.{f}").eqNullSafe(F.col(f"r.provenance.{f}")) for f in ("source", "source_id", "license", "generator")]
    return rows.select("doc_id", _shown_id(), *[F.col(f"r.metadata.{f}") for f in ("generator", "generator_version", "license", "source", "source_type", "created_at")], (same[0] & same[1] & same[2] & same[3]).alias("agrees"))
