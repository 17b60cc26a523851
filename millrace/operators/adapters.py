"""Source adapters: raw JSON items of four kinds of sources as records with metadata and provenance.

All are Column expressions over one parse of the item. A field that an item
names, even as null, is its own; one it leaves out takes the default of its
kind. Where an item has no id, one is made from its text, so a second run gives
the same.

Defined cases: no JSON object gives no messages and the defaults; null items
give null records; values of another type than the field's count as left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.extensions import ADAPTERS, STAGES, STRATEGIES
from millrace.functions import text as T
from millrace.operators import allocation as A
from millrace.operators import records as R

FIELDS = ("domain", "topic", "task_type", "difficulty", "quality_score", "source", "source_type", "created_at", "source_id", "license", "generator", "generator_version")
PROVENANCE = ("source_type", "source", "source_id", "license", "created_at", "generator", "generator_version", "source_url")

# What a field is where an item leaves it out, by kind of source.
DEFAULTS = {
    "raw": {"domain": "general_knowledge", "topic": "general", "task_type": "question_answering", "difficulty": "intermediate", "quality_score": None, "source": "raw_ingestion", "source_type": "raw"},
    "documentation": {"domain": "linux_systems", "topic": "documentation", "task_type": "explanation", "difficulty": "intermediate", "quality_score": 0.90, "source": "technical_documentation", "source_type": "documentation"},
    "human_authored": {"domain": "programming", "topic": "python", "task_type": "coding", "difficulty": "intermediate", "quality_score": 0.95, "source": "human_authored_internal", "source_type": "human_authored"},
    "synthetic": {"domain": "programming", "topic": "python", "task_type": "coding", "difficulty": "intermediate", "quality_score": 0.90, "source": "synthetic_generator", "source_type": "synthetic"},
}
# Kinds of sources and the adapter of each; all others are read as existing datasets.
KINDS = {"existing_dataset": "existing", "curated": "existing", "raw": "existing", "benchmark": "existing", "documentation": "documentation", "human_authored": "human_authored", "internal": "human_authored", "synthetic": "synthetic"}


@dataclass(frozen=True)
class Source:
    """What is known of a source before its items are read; each field given here wins over an item's own."""

    name: str | None = None
    source_type: str | None = None
    license: str | None = None
    generator: str | None = None
    generator_version: str | None = None
    source_url: str | None = None
    file: str | None = None
    now: str = "1970-01-01T00:00:00+00:00"


_TEXTS = [f for f in FIELDS if f != "quality_score"]
_PROVENANCE = "struct<" + ",".join(f"{f}:string" for f in PROVENANCE) + ">"
_META = ",".join(f"{f}:string" for f in _TEXTS) + f",quality_score:double,provenance:{_PROVENANCE}"
_ITEM = f"struct<{_META},metadata:struct<{_META}>,title:string,question:string,answer:string,content:string,prompt:string,instruction:string,response:string,output:string,doc_id:string,url:string,messages:array<struct<role:string,content:string>>>"


def _clean(text: Column) -> Column:
    return T.trim_lines(T.plain_lines(F.coalesce(text, F.lit(""))))


def _said(question: Column, answer: Column) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), _clean(text).alias("content"))
    return F.array(message("user", question), message("assistant", answer))


def _filled(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def _record(raw: Column, item: Column, messages: Column, meta: Column, kind: str, source: Source, item_id: Column, url: Column) -> Column:
    """messages, metadata and provenance of one item."""
    null = F.lit(None).cast("string")
    defaults = DEFAULTS[kind]
    known = {"source": source.name, "source_type": source.source_type}
    built = {f: F.lit(known[f]) if known.get(f) else F.coalesce(meta[f], F.lit(defaults[f])) for f in ("source", "source_type")}
    if kind == "raw" and not source.name and source.file:
        built["source"] = F.coalesce(meta["source"], F.lit(source.file))
    built |= {"source_id": item_id, "created_at": _filled(meta["created_at"], F.lit(source.now))}
    built["license"] = F.coalesce(meta["license"], F.lit(source.license))
    built["generator"] = F.coalesce(_filled(meta["generator"]), F.lit(source.generator)) if kind == "synthetic" else F.lit(source.generator).cast("string")
    built["generator_version"] = F.coalesce(_filled(meta["generator_version"]), F.lit(source.generator_version)) if kind == "synthetic" else F.lit(source.generator_version).cast("string")
    built["source_url"] = F.coalesce(url, F.lit(source.source_url)).cast("string")
    given = meta["provenance"]
    stated = {"source_type": F.coalesce(given["source_type"], F.lit("unknown")), "source": F.coalesce(given["source"], F.lit("unknown")), "created_at": F.coalesce(given["created_at"], F.lit(source.now))}
    provenance = F.struct(*[F.when(given.isNotNull(), stated.get(f, given[f])).otherwise(built[f]).cast("string").alias(f) for f in PROVENANCE])

    def whole(p: Column) -> Column:
        own = {f: F.coalesce(meta[f], F.lit(defaults[f])) for f in ("domain", "topic", "task_type", "difficulty")}
        own["quality_score"] = F.coalesce(meta["quality_score"], F.lit(defaults["quality_score"]).cast("double"))
        fields = [(own[f] if f in own else p[f] if f in PROVENANCE else null).alias(f) for f in FIELDS]
        return F.struct(messages.alias("messages"), F.struct(*fields).alias("metadata"), p.alias("provenance"))

    return F.when(raw.isNotNull(), T.let(provenance, whole))


def _item(raw: Column, use) -> Column:
    return T.let(F.from_json(raw, _ITEM), use)


def _made_id(prefix: str, raw: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(raw.cast("binary"), 256), 1, 10))


@ADAPTERS.register("existing")
def existing(raw: Column, source: Source = Source()) -> Column:
    """Conversations in any of the five shapes; metadata by its own object, else by top-level fields."""

    def read(item: Column) -> Column:
        meta = F.coalesce(item["metadata"], F.struct(*[item[f].alias(f) for f in _TEXTS], item["quality_score"].alias("quality_score"), item["provenance"].alias("provenance")))
        item_id = lambda m: _filled(m["source_id"], *([] if source.name else [_made_id("ext_", raw)]))
        return T.let(meta, lambda m: _record(raw, item, R.adapt(raw), m, "raw", source, item_id(m), F.lit(None).cast("string")))

    return _item(raw, read)


@ADAPTERS.register("documentation")
def documentation(raw: Column, source: Source = Source()) -> Column:
    """Pages of documentation: a question, or one on the title, and the answer, or the content."""

    def read(item: Column) -> Column:
        asked = F.concat(F.lit("Explain the technical concepts behind "), F.coalesce(item["title"], F.lit("this topic")), F.lit("."))
        messages = _said(_filled(item["question"], asked), _filled(item["answer"], item["content"]))
        return _record(raw, item, messages, item, "documentation", source, _filled(item["source_id"], item["doc_id"]), item["url"])

    return _item(raw, read)


def _messages(item: Column, question: Column, answer: Column) -> Column:
    given = F.transform(item["messages"], lambda m: F.struct(T.role(m["role"]).alias("role"), _clean(m["content"]).alias("content")))
    return F.when(item["messages"].isNotNull(), given).otherwise(_said(question, answer))


def _meta(item: Column) -> Column:
    return F.coalesce(item["metadata"], F.struct(*[item[f].alias(f) for f in _TEXTS], item["quality_score"].alias("quality_score"), item["provenance"].alias("provenance")))


@ADAPTERS.register("human_authored")
def human_authored(raw: Column, source: Source = Source()) -> Column:
    """Written by people: messages, or prompt or instruction with response or output."""

    def read(item: Column) -> Column:
        messages = _messages(item, _filled(item["prompt"], item["instruction"]), _filled(item["response"], item["output"]))
        return T.let(_meta(item), lambda m: _record(raw, item, messages, m, "human_authored", source, m["source_id"], F.lit(None).cast("string")))

    return _item(raw, read)


@ADAPTERS.register("synthetic")
def synthetic(raw: Column, source: Source = Source()) -> Column:
    """Written by a generator, which is named: messages, or prompt with response."""

    def read(item: Column) -> Column:
        messages = _messages(item, item["prompt"], item["response"])
        return T.let(_meta(item), lambda m: _record(raw, item, messages, m, "synthetic", source, _filled(m["source_id"], _made_id("synth_", raw)), F.lit(None).cast("string")))

    return _item(raw, read)


def adapter_of(source_type: str):
    """The adapter of a kind of source."""
    return ADAPTERS[KINDS.get(source_type.lower(), "existing")]


def defaulted(raw: Column, source: Source = Source()) -> Column:
    """The metadata of a raw record with the defaults of ingestion."""
    return existing(raw, source)["metadata"]


def enriched(record: Column, source_id: Column | None = None, version: str = "1.0.0", source_type: str = "unknown", generator: str | None = None, now: str | None = None) -> Column:
    """A record whose metadata and provenance are complete: own fields, else those of its provenance, else what is given.

    With ``now`` every record gets that time, else those that have none get the epoch.
    """
    null = F.lit(None).cast("string")

    def whole(r: Column) -> Column:
        meta, p = r["metadata"], r["provenance"]
        made = F.concat(F.lit("rec_"), F.substring(F.sha2(F.to_json(r["messages"]).cast("binary"), 256), 1, 12))
        fields = {
            "source_type": _filled(meta["source_type"], p["source_type"], F.lit(source_type)),
            "source": _filled(meta["source"], p["source"], F.lit("unknown")),
            "source_id": _filled(meta["source_id"], p["source_id"], source_id if source_id is not None else null, made),
            "license": _filled(meta["license"], p["license"]),
            "created_at": F.lit(now) if now else _filled(meta["created_at"], F.lit(Source.now)),
            "generator": _filled(meta["generator"], p["generator"], F.lit(generator).cast("string")),
            "generator_version": _filled(meta["generator_version"], p["generator_version"], F.lit(version)),
        }
        new = F.struct(*[fields.get(f, meta[f]).alias(f) for f in FIELDS])
        origin = F.struct(*[fields.get(f, p[f]).alias(f) for f in PROVENANCE])
        return F.struct(r["messages"].alias("messages"), new.alias("metadata"), origin.alias("provenance"))

    return F.when(record.isNotNull(), T.let(record, whole))


@STAGES.register("normalize_text")
def normalize_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Line ends and trailing blanks of a text column."""
    return df.withColumn(column, _clean(F.col(column)))


@STAGES.register("deduplicate")
def deduplicate(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The row with the smallest key of each distinct text."""
    digest = F.sha2(T.strip(F.col(column)).cast("binary"), 256)
    first = df.groupBy(digest.alias("_digest")).agg(F.min(key).alias(key))
    return df.join(first.select(key), key, "left_semi")


@STAGES.register("split_dataset")
def split_dataset(df: DataFrame, key: str = "doc_id", train: float = 0.9, validation: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split`` in exact shares."""
    return A.ratio_split(df, key, train, validation, seed)


@STAGES.register("generate_statistics")
def generate_statistics(df: DataFrame, column: str = "text") -> DataFrame:
    """One row: rows, characters and words, and their means."""
    n = F.count("*")
    return df.agg(n.alias("n_rows"), F.sum(F.length(column)).alias("n_chars"), F.sum(T.n_words(F.col(column))).alias("n_words"), F.round(F.avg(F.length(column)), 4).alias("mean_chars"))


@STRATEGIES.register("proportional")
def proportional(df: DataFrame, key: str, stratum: str, total: int, weights: DataFrame) -> DataFrame:
    """Rows by the quotas of given weights (category, weight)."""
    return A.take(df, key, stratum, A.quotas(weights, total))


@STRATEGIES.register("balanced")
def balanced(df: DataFrame, key: str, stratum: str, total: int) -> DataFrame:
    """The same number of rows of each stratum, as far as it has them."""
    groups = df.select(F.col(stratum).alias("category")).distinct()  # as many rows as strata
    groups = groups.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy()))
    return A.take(df, key, stratum, A.quotas(groups, total))
