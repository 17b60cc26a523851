"""Queries of files, conversions, digests, checkpoints, gates and release steps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import grounding as G
from millrace.operators import quality as Q
from millrace.operators import records as R
from millrace.operators import release as L
from millrace.plans import sqltext as S
from millrace.plans.corpus import SPLIT, by_hash
from millrace.plans.records import PAIRED, exchanges
from millrace.plans.registry import Tables, query
from millrace.session import work_folder, written
from millrace.sources import raw


def x():
    return F.col("text")


def folder(t: Tables, label: str) -> str:
    return f"{work_folder(t.spark)}/{label}-{uuid.uuid4().hex}"


def md5(c):
    return F.md5(c.cast("binary"))


# Files


@query("src3_directory_scan", "SELECT role, count(*) AS n, CAST(sum(turn) FILTER (WHERE (conv_id + turn) % 5 <> 0) AS BIGINT) AS turns, count(*) FILTER (WHERE (conv_id + turn) % 5 = 0) AS failed FROM conversations GROUP BY role")
def _(t: Tables):
    path = folder(t, "scan")
    whole = F.to_json(F.struct("conv_id", "turn"))
    # Every fifth line is cut short.
    lines = t.conversations.select("role", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("value"))
    # Nested folders of .jsonl files, as a user's data folder would have them.
    lines.write.partitionBy("role").option("encoding", "UTF-8").json(f"{path}/a/b")
    rows = t.spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("_raw"))
    outer = raw.json_lines(rows, "value string").select("_file", F.col("record.value").alias("_raw"), "error")
    inner = raw.json_lines(outer.drop("error"), "conv_id long, turn long")
    role = F.regexp_extract("_file", "role=([^/]*)/", 1)
    return inner.groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.sum("record.turn").alias("turns"), F.count("error").alias("failed"))


@query("src4_csv_scan", "SELECT p_partkey, p_name, p_size, round(p_retailprice, 4) AS p_retailprice, false AS other_width FROM part")
def _(t: Tables):
    path = folder(t, "csv")
    t.part.select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("header", "true").csv(path)
    rows = raw.read_csv(t.spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double")
    return rows.select("p_partkey", "p_name", "p_size", F.round("p_retailprice", 4).alias("p_retailprice"), F.col("_corrupt").isNotNull().alias("other_width"))


@query("src4_csv_other_width", "SELECT p_partkey % 3 = 0 AS other_width, count(*) AS n, count(DISTINCT p_partkey) AS n_keys FROM part GROUP BY 1")
def _(t: Tables):
    path = folder(t, "csv")
    wide = F.col("p_partkey") % 3 == 0
    t.part.where(~wide).select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("header", "true").csv(f"{path}/one")
    t.part.where(wide).select("p_partkey", "p_name", "p_size", "p_retailprice", "p_type").write.option("header", "true").csv(f"{path}/two")
    rows = raw.read_csv(t.spark, f"{path}/*", "p_partkey long, p_name string, p_size int, p_retailprice double")
    return rows.groupBy(F.col("_corrupt").isNotNull().alias("other_width")).agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("n_keys"))


@query("src5_file_discovery", "SELECT lang, count(*) * 33 AS bytes FROM documents GROUP BY lang")
def _(t: Tables):
    path = folder(t, "discovery")
    t.documents.select("lang", md5(x()).alias("line")).write.partitionBy("lang").text(path)
    found = raw.inventory(t.spark, path, ("txt",))
    return found.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(F.sum("bytes").alias("bytes"))


@query("flt25_file_validity", "SELECT count(*) * 33 AS total_bytes, true AS all_valid FROM documents")
def _(t: Tables):
    path = folder(t, "validity")
    t.documents.select(F.coalesce(md5(x()), F.lit("-" * 32)).alias("line")).where("line is not null").write.text(path)
    found = raw.validity(t.spark, path)
    # The marker of a finished write is the one empty file.
    return found.select("total_bytes", ((F.col("empty_files") <= 1) & (F.col("valid_files") > 0)).alias("all_valid"))


@query("flt25_file_states", "SELECT kind, n * 33 AS total_bytes, empty AS empty_files, empty = 0 AND n > 0 AS all_valid FROM (SELECT count(*) AS n FROM documents), (VALUES ('whole', 0::BIGINT, true), ('with_empty', 1, true)) v(kind, empty, filled) UNION ALL SELECT 'nothing', 0, 1, false")
def _(t: Tables):
    lines = t.documents.select(F.coalesce(md5(x()), F.lit("-" * 32)).alias("line"))
    rows = []
    for kind, parts in (("whole", ("full",)), ("with_empty", ("full", "empty")), ("nothing", ("empty",))):
        path = folder(t, f"validity-{kind}")
        for part in parts:
            (lines if part == "full" else lines.limit(0).coalesce(1)).write.text(f"{path}/{part}")
        # The marker of each finished write is an empty file, too.
        empty = F.col("empty_files") - len(parts)
        rows.append(raw.validity(t.spark, path).select(F.lit(kind).alias("kind"), "total_bytes", empty.alias("empty_files"), ((empty == 0) & (F.col("valid_files") > 0)).alias("all_valid")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Rows in which a value is missing, all are, a field is too many, the line is cut short, or nothing stands.
ODD_CSV = "CASE p_partkey % 6 WHEN 0 THEN p_partkey || ',,\"a, \"\"b\"\"\"' WHEN 1 THEN ',,' WHEN 2 THEN p_partkey || ',x,y,z' WHEN 3 THEN '' ELSE p_partkey || ',' || p_size || ',z' END"
ODD_JSON = "CASE p_partkey % 6 WHEN 0 THEN '{\"k\": ' || p_partkey || ', \"v\": null, \"w\": \" \"}' WHEN 1 THEN '[1]' WHEN 2 THEN '{\"k\": ' WHEN 3 THEN '  ' ELSE '{\"k\": \"v\"}' END"


@query("ag28_file_profile", f"""WITH c AS (SELECT p_partkey % 6 AS k, {ODD_CSV} AS v FROM part), j AS (SELECT p_partkey % 6 AS k, {ODD_JSON} AS v FROM part)
SELECT 'csv' AS kind, 2 AS file_count, CAST(sum(strlen(v) + 1) AS BIGINT) + 12 AS total_bytes, count(*) FILTER (WHERE k <> 3) AS row_count, count(*) FILTER (WHERE k IN (1, 3)) AS empty_rows, CAST(sum(CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END) AS BIGINT) AS missing_values, count(*) FILTER (WHERE k = 2) AS malformed_rows FROM c
UNION ALL SELECT 'jsonl', 2, CAST(sum(strlen(v) + 1) AS BIGINT), count(*) FILTER (WHERE k <> 3), count(*) FILTER (WHERE k = 3), CAST(sum(CASE k WHEN 0 THEN 2 ELSE 0 END) AS BIGINT), count(*) FILTER (WHERE k IN (1, 2)) FROM j""")
def _(t: Tables):
    path, out = folder(t, "profile"), []
    head = t.spark.createDataFrame([("a,b,c",)], "line string")
    for kind, lines, columns in (("csv", F.expr(ODD_CSV), ["a", "b", "c"]), ("jsonl", F.expr(ODD_JSON), None)):
        for half in (0, 1):
            rows = t.part.where(F.col("p_partkey") % 2 == half).select(lines.alias("line"))
            # One file of each half, named as its kind; a table of parts is small.
            text = head.unionByName(rows).coalesce(1) if kind == "csv" else rows.coalesce(1)
            text.write.text(f"{path}/{kind}/{half}")
        raw.rename_endings(t.spark, f"{path}/{kind}", ".txt", f".{kind}")
        out.append(raw.profile(t.spark, f"{path}/{kind}", kind, columns).select(F.lit(kind).alias("kind"), F.col("file_count").cast("int"), "total_bytes", "row_count", "empty_rows", "missing_values", "malformed_rows"))
    return out[0].unionByName(out[1])


@query("snk3_convert_format", "SELECT p_partkey, md5(concat_ws('|', p_brand, p_partkey, p_size, p_type)) AS row_md5, 'p_brand,p_partkey,p_size,p_type' AS header FROM part")
def _(t: Tables):
    path = folder(t, "convert")
    large = F.when(F.col("p_size") > 0, F.col("p_size"))
    t.part.select("p_partkey", "p_type", large.alias("p_size"), "p_brand").write.json(f"{path}/one")
    raw.convert(t.spark, "jsonl", "csv", f"{path}/one", f"{path}/two")
    raw.convert(t.spark, "csv", "jsonl", f"{path}/two", f"{path}/three")
    raw.convert(t.spark, "json", "jsonl", f"{path}/one", f"{path}/four")
    head = ",".join(t.spark.read.option("header", "true").csv(f"{path}/two").columns)
    rows = t.spark.read.schema("p_partkey string, p_type string, p_size string, p_brand string").json(f"{path}/three")
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), md5(F.concat_ws("|", "p_brand", "p_partkey", "p_size", "p_type")).alias("row_md5"), F.lit(head).alias("header"))


DIGEST = """l1 AS (SELECT source, doc_id // 1000 AS a, sha256(string_agg(d, '' ORDER BY doc_id, d)) AS s, count(*) AS n FROM (SELECT source, doc_id, sha256(coalesce(text, '')) AS d FROM documents) GROUP BY ALL),
l2 AS (SELECT source, a // 1000 AS b, sha256(string_agg(s, '' ORDER BY a)) AS s, sum(n) AS n FROM l1 GROUP BY ALL)"""


@query("snk2_digest", f"WITH {DIGEST} SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(s, '' ORDER BY b)) AS digest FROM l2 GROUP BY source")
def _(t: Tables):
    return L.ordered_digest(t.documents, "source", "doc_id", x())


@query("snk7_manifest", f"WITH {DIGEST.replace('source', 'lang')} SELECT lang, CAST(sum(n) AS BIGINT) AS records, sha256(string_agg(s, '' ORDER BY b)) AS digest, CAST(sum(n) * 33 AS BIGINT) AS bytes FROM l2 GROUP BY lang")
def _(t: Tables):
    path = folder(t, "manifest")
    t.documents.select("lang", md5(F.coalesce(x(), F.lit(""))).alias("line")).write.partitionBy("lang").text(path)
    files = raw.inventory(t.spark, path, ("txt",)).groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(F.sum("bytes").alias("bytes"))
    digests = L.ordered_digest(t.documents, "lang", "doc_id", x())
    return digests.join(files, "lang").select("lang", F.col("n").alias("records"), "digest", "bytes")


# Files of up to 1,000 documents each, so that no task writes a language alone.
FILES_SQL = "fl AS (SELECT lang, doc_id // 1000 AS part, count(*) AS records, count(*) * 33 AS bytes, sha256(string_agg(md5(coalesce(text, '')) || chr(10), '' ORDER BY doc_id, md5(coalesce(text, '')))) AS sha256 FROM documents GROUP BY ALL)"


def text_files(t: Tables, rows, path: str):
    """Write (lang, part, key, line) as one text file per lang and part, lines by key."""
    ordered = rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "key", "line")
    ordered.select("lang", "part", "line").write.partitionBy("lang", "part").text(path)


def file_lines(t: Tables):
    return t.documents.select("lang", F.expr("doc_id div 1000").alias("part"), F.col("doc_id").alias("key"), md5(F.coalesce(x(), F.lit(""))).alias("line"))


def files_of(t: Tables, path: str):
    """lang, part, bytes and sha256 of the files below a path."""
    at = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    return raw.inventory(t.spark, path, ("txt",)).select(at("lang").alias("lang"), at("part").cast("long").alias("part"), "bytes", "sha256")


@query("snk7_file_manifest", f"WITH {FILES_SQL} SELECT lang, part, records, bytes, sha256 FROM fl")
def _(t: Tables):
    path = folder(t, "manifest")
    text_files(t, file_lines(t), path)
    records = t.documents.groupBy("lang", F.expr("doc_id div 1000").alias("part")).agg(F.count("*").alias("records"))
    return files_of(t, path).join(records, ["lang", "part"]).select("lang", "part", "records", "bytes", "sha256")


@query("gt7_file_integrity", f"WITH {FILES_SQL} SELECT lang || '/' || part AS file, CASE lang WHEN 'de' THEN 'mismatch' WHEN 'fr' THEN 'missing' ELSE 'ok' END AS state FROM fl UNION ALL SELECT 'xx/' || part, 'unexpected' FROM fl WHERE lang = 'en'")
def _(t: Tables):
    """A manifest of files against a folder in which some changed, some went and some came."""
    path, lines = folder(t, "integrity"), file_lines(t)
    text_files(t, lines, f"{path}/listed")
    changed = F.when(F.col("lang") == "de", F.reverse("line")).otherwise(F.col("line"))
    now = lines.where("lang <> 'fr'").withColumn("line", changed)
    text_files(t, now.unionByName(lines.where("lang = 'en'").withColumn("lang", F.lit("xx"))), f"{path}/found")
    named = lambda df: df.select(F.concat_ws("/", "lang", "part").alias("file"), "sha256")
    return L.verify(named(files_of(t, f"{path}/listed")), named(files_of(t, f"{path}/found")), "file", "sha256")


@query("lk7_frozen_files", f"WITH {SPLIT}, n AS (SELECT split, count(*) AS n FROM sp GROUP BY split) SELECT kind, split, n + CASE WHEN kind = 'grown' AND split = 'train' THEN 1 ELSE 0 END AS n, kind = 'untouched' OR (kind = 'edited' AND split <> 'test') OR (kind = 'grown' AND split <> 'train') AS unchanged FROM n, (VALUES ('untouched'), ('edited'), ('grown')) v(kind)")
def _(t: Tables):
    """Digests recorded when splits were written, against the files as they are now: untouched, with one split edited, and with a row more."""
    path = folder(t, "frozen")
    rows = by_hash(t).select("split", "doc_id", x())
    edited = rows.withColumn("text", F.when(F.col("split") == "test", F.concat("text", F.lit("."))).otherwise(x()))
    more = t.spark.createDataFrame([("train", -1, "one more")], "split string, doc_id long, text string")
    for kind, df in (("untouched", rows), ("edited", edited), ("grown", rows.unionByName(more))):
        df.write.partitionBy("split").parquet(f"{path}/{kind}")
    read = lambda kind: t.spark.read.schema("split string, doc_id long, text string").parquet(f"{path}/{kind}")
    frozen = written(L.ordered_digest(rows, "split", "doc_id", x()), "frozen").select("split", F.col("digest").alias("recorded"))
    out = None
    for kind in ("untouched", "edited", "grown"):
        now = L.ordered_digest(read(kind), "split", "doc_id", x()).join(frozen, "split", "left")
        one = now.select(F.lit(kind).alias("kind"), "split", "n", F.col("digest").eqNullSafe(F.col("recorded")).alias("unchanged"))
        out = one if out is None else out.unionByName(one)
    return out


@query("snk5_report", "WITH m AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang) SELECT 0::BIGINT AS line, '# Documents by language' AS text UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| lang | n | sources |' UNION ALL SELECT 3, '| --- | --- | --- |' UNION ALL SELECT 3 + row_number() OVER (ORDER BY lang), '| ' || lang || ' | ' || n || ' | ' || sources || ' |' FROM m")
def _(t: Tables):
    metrics = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    return L.markdown(metrics, ["lang", "n", "sources"], "Documents by language")


# Resuming


@query("snk8_append_and_resume", """
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), s AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS first, coalesce(l.quality, 1) = 1 AS good FROM documents d LEFT JOIN l USING (doc_id))
SELECT 'first' AS run, count(*) AS appended, count(*) FILTER (WHERE good) AS completed FROM s WHERE first UNION ALL SELECT 'resumed', count(*), count(*) FROM s WHERE NOT (first AND good)""")
def _(t: Tables):
    path = folder(t, "results")
    quality = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    status = F.when(F.col("quality") == 1, "COMPLETED").otherwise("FAILED")
    t.documents.select("doc_id").join(quality, "doc_id").select("doc_id", status.alias("status"), F.lit("first").alias("run")).write.mode("append").parquet(path)
    done = t.spark.read.schema("doc_id long, status string, run string").parquet(path)
    # The second run takes all that is not completed, failed ones again.
    rest = t.documents.select("doc_id").join(done.where("status = 'COMPLETED'"), "doc_id", "left_anti")
    rest.select("doc_id", F.lit("COMPLETED").alias("status"), F.lit("resumed").alias("run")).write.mode("append").parquet(path)
    stored = t.spark.read.schema("doc_id long, status string, run string").parquet(path)
    return stored.groupBy("run").agg(F.count("*").alias("appended"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))


@query("ck2_skip_completed", "WITH s AS (SELECT d.source, d.doc_id IN (SELECT doc_id FROM labels) AS done FROM documents d) SELECT source, count(*) AS n_documents, count(*) FILTER (WHERE NOT done) AS pending FROM s GROUP BY source")
def _(t: Tables):
    path = folder(t, "checkpoint")
    t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "source").write.parquet(path)
    done = t.spark.read.schema("doc_id long, source string").parquet(path).select("doc_id").distinct()
    flagged = t.documents.select("doc_id", "source").join(done.withColumn("done", F.lit(True)), "doc_id", "left")
    return flagged.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("done").isNull()).alias("pending"))


@query("ck1_stage_checkpoints", "SELECT run, stage, state, n FROM (VALUES (1, 'normalise', 'computed'), (1, 'count', 'computed'), (2, 'normalise', 'reused'), (2, 'count', 'reused'), (3, 'normalise', 'recomputed'), (3, 'count', 'reused')) v(run, stage, state) JOIN (SELECT 'normalise' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'count', count(DISTINCT lang) FROM documents) USING (stage)")
def _(t: Tables):
    path, rows = folder(t, "stages"), []
    for run in (1, 2, 3):
        if run == 3:  # the mark names rows that its digest was not taken of
            other = folder(t, "other")
            t.documents.select("doc_id", "lang", x()).where("lang = 'none'").write.parquet(other)
            mark = t.spark.read.parquet(f"{path}/normalise/mark").withColumn("path", F.lit(other))
            written(mark, "mark").write.mode("overwrite").parquet(f"{path}/normalise/mark")
        texts, a = L.stage(t.spark, path, "normalise", lambda: t.documents.select("doc_id", "lang", T.collapse(x()).alias("text")))
        counts, b = L.stage(t.spark, path, "count", lambda texts=texts: texts.groupBy("lang").agg(F.count("*").alias("n")))
        rows += [one.agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), F.lit(name).alias("stage"), F.lit(state).alias("state"), "n") for one, name, state in ((texts, "normalise", a), (counts, "count", b))]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


@query("gt7_integrity", """
WITH c AS (SELECT doc_id FROM labels GROUP BY doc_id), a AS (SELECT doc_id, length(text) AS n, n_chars FROM documents)
SELECT coalesce(c.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN c.doc_id IS NULL THEN 'unexpected' WHEN a.n IS DISTINCT FROM a.n_chars THEN 'mismatch' ELSE 'ok' END AS state FROM c FULL JOIN a ON c.doc_id = a.doc_id""")
def _(t: Tables):
    # The catalog lists what was labelled, with the length that was recorded; found is what the texts are.
    listed = t.labels.select("doc_id").distinct().join(t.documents.select("doc_id", F.col("n_chars").cast("long").alias("size")), "doc_id", "left")
    found = t.documents.select("doc_id", F.length("text").cast("long").alias("size"))
    return L.verify(listed, found, "doc_id", "size")


# Gates

LANGS = ("de", "en", "es", "fr")
TIERS = ((60, "beginner"), (180, "intermediate"), (350, "advanced"))
QUANTITATIVE = "(?i)how (?:much|many)|calculate|compute"
ARTEFACT = r"(?i)<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<unk>"


def facts(t: Tables):
    """One row of all that the gates look at: documents once by row, once by digest, conversations, labels."""
    docs = by_hash(t)
    words = T.n_words(x())
    tier = F.when(words < 60, "beginner").when(words < 180, "intermediate").when(words < 350, "advanced").otherwise("expert")
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    cells = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda line: line.rlike(r"^\s*\|.*\|\s*$")), lambda line: T.occurrences(line, "|")))
    by_row = docs.agg(
        F.count("*").alias("n"),
        F.count_if(~filled("text") | ~F.col("n_chars").eqNullSafe(F.length("text"))).alias("invalid"),
        F.count_if(filled("source") & filled("lang")).alias("traced"),
        F.count_distinct(F.when(F.col("lang").isin(*LANGS), F.col("lang"))).alias("langs"),
        F.count_distinct("lang").alias("all_langs"),
        F.count_distinct("source").alias("sources"),
        F.count_distinct(tier).alias("tiers"),
        F.count_if(T.estimate(x()) > 4096).alias("over"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "validation").alias("validation"),
        F.count_if(F.col("split") == "test").alias("test"),
        F.count_if(T.occurrences(x(), "$$") % 2 != 0).alias("odd_equations"),
        F.count_if(F.size(cells) > 1).alias("uneven_tables"),
        F.count_if(x().rlike(ARTEFACT)).alias("artefacts"),
        F.count_if(~Q.licence(x(), F.lit(None).cast("string"), F.col("source"))["known"]).alias("unlicensed"),
        F.count(F.sha2(x().cast("binary"), 256)).alias("digests"),
    )
    copies = docs.groupBy(F.sha2(x().cast("binary"), 256).alias("h")).agg(F.count("*").alias("c"), (F.min("split") != F.max("split")).alias("leak"))
    by_digest = copies.agg(F.count("*").alias("unique"), F.sum(F.col("c") - 1).alias("removed"), F.count_if("leak").alias("leaks"))
    largest = docs.groupBy("lang").agg(F.count("*").alias("c")).agg(F.max("c").alias("largest"))
    grounding = exchanges(t).agg(F.avg(G.overlap(F.col("ans"), F.col("usr"))).alias("grounding"))
    said = R.from_turns(t.conversations).select(F.array_join(R.of_role(F.col("messages"), "user"), " ").alias("u"), F.array_join(R.of_role(F.col("messages"), "assistant"), " ").alias("a"))
    status = G.scientific(F.col("u"), F.col("a"), F.col("u").rlike(QUANTITATIVE))["status"]
    science = said.agg((F.count_if(status == "FAILED") / F.greatest(F.count("*"), F.lit(1))).alias("unscientific"))
    out = by_row
    for one_row in (by_digest, largest, grounding, science, t.labels.agg(F.avg("quality").alias("quality"))):
        out = out.join(F.broadcast(one_row))
    return out


FACTS = rf"""WITH RECURSIVE {SPLIT}, {PAIRED},
r AS (SELECT *, len({S.words("text")}) AS w, length(text) AS size, list_distinct(list_transform(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\s*\|.*\|\s*$')), lambda l: length(l) - length(replace(l, '|', '')))) AS cells FROM sp),
dd AS (SELECT sha256(text) AS h, count(*) AS c, count(DISTINCT split) AS k FROM sp GROUP BY 1),
sc AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS ans, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS usr FROM conversations GROUP BY conv_id),
sf AS (SELECT (({S.count("ans", "$$")}) % 2 <> 0 OR ({S.count("replace(ans, '$$', '')", "$")}) % 2 <> 0 OR regexp_matches(ans, '(?i)\[(?:citation\s+needed|\?|xx|todo)\]') OR (regexp_matches(usr, '(?i)how (?:much|many)|calculate|compute') AND NOT regexp_matches(ans, '\b\d+(?:\.\d+)?(?:e[+-]?\d+)?\b'))) AS failed FROM sc),
f AS (SELECT (SELECT count(*) FROM documents) AS total,
 (SELECT count(*) FROM documents WHERE coalesce(trim(text), '') = '' OR n_chars IS DISTINCT FROM length(text)) AS broken,
 (SELECT count(*) FROM documents WHERE coalesce(trim(source), '') = '' OR coalesce(trim(lang), '') = '') AS untraced,
 (SELECT count(DISTINCT lang) FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')) AS wanted_langs, (SELECT count(DISTINCT lang) FROM documents) AS langs, (SELECT count(DISTINCT source) FROM documents) AS sources,
 (SELECT count(DISTINCT CASE WHEN w < 60 THEN 1 WHEN w < 180 THEN 2 WHEN w < 350 THEN 3 ELSE 4 END) FROM r) AS tiers,
 (SELECT count(*) / (SELECT count(*) FROM documents) FROM r WHERE greatest(w, size // 4) > 4096) AS over_share,
 (SELECT count(*) FROM sp WHERE split = 'train') AS tr, (SELECT count(*) FROM sp WHERE split = 'validation') AS va, (SELECT count(*) FROM sp WHERE split = 'test') AS te,
 (SELECT count(*) FROM documents WHERE {S.count("text", "$$")} % 2 = 1) AS odd_eq, (SELECT count(*) FROM r WHERE len(cells) > 1) AS uneven,
 (SELECT count(*) FROM documents WHERE regexp_matches(lower(text), '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<unk>')) AS dirty,
 (SELECT count(*) FROM documents WHERE NOT (regexp_matches(lower(text), 'creative\s+commons\s+attribution\s+4\.0\s+international|creative\s+commons\s+attribution-sharealike|creative\s+commons\s+attribution-noncommercial|cc0\s+1\.0\s+universal|public\s+domain\s+dedication|arxiv\.org\s+non-exclusive\s+license\s+to\s+distribute|mit\s+license|apache\s+license,?\s+version\s+2\.0|nptel\s+open\s+access|nptel.*?license') OR regexp_matches(lower(coalesce(source, '')), 'nptel|arxiv'))) AS unlicensed,
 (SELECT count(text) FROM documents) AS hashed, (SELECT count(*) FROM dd) AS uniq, (SELECT count(*) FROM dd WHERE k > 1) AS leaked, (SELECT max(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang)) AS biggest,
 (SELECT avg(CASE WHEN len(ka) = 0 THEN 1.0 ELSE len(list_intersect(ka, ku)) / len(ka) END) FROM (SELECT {"{ka}"} AS ka, {"{ku}"} AS ku FROM pr)) AS grounded,
 (SELECT count(*) FILTER (WHERE failed) / count(*) FROM sf) AS bad_science, (SELECT avg(quality) FROM labels) AS q)"""
KEYS = "list_filter(list_distinct(list_filter({t}, lambda w: regexp_matches(w, '^[a-z]{{3,}}$'))), lambda w: NOT list_contains([{stop}], w))"
FACTS = FACTS.replace("{ka}", KEYS.format(t=S.tokens("ans"), stop=", ".join(f"'{w}'" for w in G.STOPWORDS))).replace("{ku}", KEYS.format(t=S.tokens("usr"), stop=", ".join(f"'{w}'" for w in G.STOPWORDS)))


def gates_sql(cases: str, overall: str) -> str:
    """Rows of gates from ``(name, critical, verdict)`` tuples, and the overall verdict over them."""
    return f"{FACTS}, g AS (SELECT unnest([{cases}]) AS g FROM f), v AS (SELECT g.gate AS gate, g.verdict AS verdict, g.critical AS critical FROM g) SELECT * FROM v UNION ALL SELECT 'overall', {overall}, true FROM v"


def case(name: str, verdict: str, critical: bool = True) -> str:
    return f"{{'gate': '{name}', 'verdict': {verdict}, 'critical': {str(critical).lower()}}}"


WORST = "CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'WARN') THEN 'WARN' ELSE 'PASS' END"


def worst(any_is):
    return F.when(any_is("FAIL"), "FAIL").when(any_is("WARN"), "WARN").otherwise("PASS")


READINESS_SQL = ", ".join((
    case("schema_validity", "if(broken > 0, 'FAIL', 'PASS')"),
    case("provenance_completeness", "if(untraced > 0, 'FAIL', 'PASS')"),
    case("domain_coverage", "if(wanted_langs < 4, 'FAIL', 'PASS')"),
    case("difficulty_coverage", "if(tiers < 4, 'FAIL', 'PASS')"),
    case("quality_score_mean", "if(coalesce(q, 0) < 0.85, 'FAIL', 'PASS')"),
    case("duplicate_rate", "if(uniq < 0.95 * total, 'FAIL', 'PASS')"),
    case("cross_split_leakage", "if(leaked > 0, 'FAIL', 'PASS')"),
    case("context_length_risk", "if(over_share > 0.01, 'WARN', 'PASS')", False),
    case("minimum_records", "if(total < 50, 'WARN', 'PASS')", False),
))


def readiness(t: Tables):
    """Nine gates of a dataset; any FAIL fails it."""
    c = F.col
    gates = (
        L.gate("schema_validity", c("invalid") == 0),
        L.gate("provenance_completeness", c("traced") == c("n")),
        L.gate("domain_coverage", c("langs") == len(LANGS)),
        L.gate("difficulty_coverage", c("tiers") == len(TIERS) + 1),
        L.gate("quality_score_mean", c("quality") >= 0.85),
        L.gate("duplicate_rate", c("removed") * 100 <= c("n") * 5),
        L.gate("cross_split_leakage", c("leaks") == 0),
        L.gate("context_length_risk", c("over") * 100 <= c("n"), "WARN", False),
        L.gate("minimum_records", c("n") >= 50, "WARN", False),
    )
    return L.judged(facts(t), gates, worst)


@query("gt1_readiness_gates", gates_sql(READINESS_SQL, WORST))
def _(t: Tables):
    return readiness(t)


@query("gt2_scorecard", gates_sql(", ".join((
    case("Schema Validity", "if(broken > 0, 'FAIL', 'PASS')"),
    case("Source Grounding", "if(grounded >= 0.15, 'PASS', 'WARN')", False),
    case("Provenance Completeness", "if(untraced > 0, 'FAIL', 'PASS')"),
    case("Rights Compliance", "if(unlicensed > 0, 'WARN', 'PASS')", False),
    case("Scientific Correctness", "if(bad_science > 0.05, 'FAIL', 'PASS')"),
    case("Quality", "if(coalesce(q, 0) < 0.85, 'FAIL', 'PASS')"),
    case("Deduplication", "'PASS'", False),
    case("Domain Coverage", "if(langs = 0, 'WARN', 'PASS')", False),
    case("Difficulty Coverage", "if(tiers = 0, 'WARN', 'PASS')", False),
    case("Split Integrity", "if(leaked > 0, 'FAIL', 'PASS')"),
)), "CASE WHEN bool_and(verdict = 'PASS') FILTER (WHERE critical) THEN 'READY' ELSE 'REJECTED' END"))
def _(t: Tables):
    c = F.col
    gates = (
        L.gate("Schema Validity", c("invalid") == 0),
        L.gate("Source Grounding", c("grounding") >= 0.15, "WARN", False),
        L.gate("Provenance Completeness", c("traced") == c("n")),
        L.gate("Rights Compliance", c("unlicensed") == 0, "WARN", False),
        L.gate("Scientific Correctness", c("unscientific") <= 0.05),
        L.gate("Quality", c("quality") >= 0.85),
        L.gate("Deduplication", F.lit(True), critical=False),  # duplicates are taken out before a release
        L.gate("Domain Coverage", c("all_langs") >= 1, "WARN", False),
        L.gate("Difficulty Coverage", c("tiers") >= 1, "WARN", False),
        L.gate("Split Integrity", c("leaks") == 0),
    )
    return L.judged(facts(t), gates, lambda any_is: F.when(any_is("FAIL", True) | any_is("WARN", True), "REJECTED").otherwise("READY"))


@query("gt3_final_gates", gates_sql(", ".join((
    case("G1", "if(broken > 0, 'FAIL', 'PASS')"),
    case("G2", "if(uniq > total, 'FAIL', 'PASS')"),
    case("G3", "if(tr > 0 AND va > 0 AND te > 0 AND tr + va + te = total, 'PASS', 'FAIL')"),
    case("G4", "if(leaked > 0, 'FAIL', 'PASS')"),
    case("G5", "if(grounded >= 0.15, 'PASS', 'FAIL')"),
    case("G6", "if(untraced > 0, 'FAIL', 'PASS')"),
    case("G7", "if(unlicensed > 0, 'WARN', 'PASS')", False),
    case("G8", "if(bad_science > 0.05, 'FAIL', 'PASS')"),
    case("G9", "if(odd_eq > 0, 'WARN', 'PASS')", False),
    case("G10", "if(uneven > 0, 'WARN', 'PASS')", False),
    case("G11", "if(uniq < total, 'FAIL', 'PASS')", False),
    case("G12", "if(biggest <= 0.6 * total AND langs >= 2, 'PASS', 'WARN')", False),
    case("G13", "if(dirty > 0, 'FAIL', if(over_share > 0.05, 'WARN', 'PASS'))", False),
    case("G14", "'PASS'"),
    case("G15", "if(hashed < total, 'FAIL', 'PASS')"),
)), "CASE WHEN bool_and(verdict = 'PASS') FILTER (WHERE critical) THEN 'READY' ELSE 'BLOCKED' END"))
def _(t: Tables):
    c = F.col
    share = F.when(c("artefacts") > 0, "FAIL").when(c("over") * 20 <= c("n"), "PASS").otherwise("WARN")
    gates = (
        L.gate("G1", c("invalid") == 0),
        L.gate("G2", c("unique") + c("removed") == c("n")),
        L.gate("G3", (c("train") > 0) & (c("validation") > 0) & (c("test") > 0) & (c("train") + c("validation") + c("test") == c("n"))),
        L.gate("G4", c("leaks") == 0),
        L.gate("G5", c("grounding") >= 0.15),
        L.gate("G6", c("traced") == c("n")),
        L.gate("G7", c("unlicensed") == 0, "WARN", False),
        L.gate("G8", c("unscientific") <= 0.05),
        L.gate("G9", c("odd_equations") == 0, "WARN", False),
        L.gate("G10", c("uneven_tables") == 0, "WARN", False),
        L.gate("G11", c("removed") == 0, critical=False),
        L.gate("G12", (c("largest") * 10 <= c("n") * 6) & (c("all_langs") >= 2), "WARN", False),
        F.struct(F.lit("G13").alias("gate"), share.alias("verdict"), F.lit(False).alias("critical")),
        L.gate("G14", F.lit(True)),  # splits are drawn by digest, so a second run cannot differ
        L.gate("G15", c("digests") == c("n")),
    )
    return L.judged(facts(t), gates, lambda any_is: F.when(any_is("FAIL", True) | any_is("WARN", True), "BLOCKED").otherwise("READY"))


@query("gt4_pilot_dimensions", gates_sql(", ".join((
    case("schema_validity", "if(broken > 0, 'WARN', 'PASS')", False),
    case("domain_coverage", "if(langs < 4, 'WARN', 'PASS')", False),
    case("difficulty_coverage", "if(tiers < 4, 'WARN', 'PASS')", False),
    case("quality", "if(coalesce(q, 0) < 0.85, 'WARN', 'PASS')", False),
    case("deduplication", "if(uniq < 0.95 * total, 'WARN', 'PASS')", False),
    case("provenance", "if(untraced > 0.01 * total, 'WARN', 'PASS')", False),
    case("split_integrity", "if(abs(tr / total - 0.9) > 0.05, 'WARN', 'PASS')", False),
    case("leakage", "if(leaked > 0, 'FAIL', 'PASS')"),
    case("source_diversity", "if(sources < 2, 'WARN', 'PASS')", False),
)), WORST))
def _(t: Tables):
    c = F.col
    rules = (
        ("schema_validity", c("invalid") == 0),
        ("domain_coverage", c("all_langs") >= len(LANGS)),
        ("difficulty_coverage", c("tiers") >= len(TIERS) + 1),
        ("quality", c("quality") >= 0.85),
        ("deduplication", c("removed") * 100 <= c("n") * 5),
        ("provenance", c("traced") * 100 >= c("n") * 99),
        ("split_integrity", F.abs(c("train") / c("n") - 0.9) <= 0.05),
    )
    gates = [L.gate(name, rule, "WARN", False) for name, rule in rules] + [L.gate("leakage", c("leaks") == 0), L.gate("source_diversity", c("sources") >= 2, "WARN", False)]
    return L.judged(facts(t), gates, worst)


@query("gt5_freeze", f"WITH RECURSIVE gt AS ({gates_sql(READINESS_SQL, WORST)}), o AS (SELECT verdict FROM gt WHERE gate = 'overall'), {SPLIT}, m AS (SELECT split, count(*) AS n FROM sp GROUP BY split) SELECT attempt, split, n, CASE WHEN attempt = 'forced' THEN 'FROZEN' WHEN attempt = 'again' OR verdict = 'FAIL' THEN 'REFUSED' ELSE 'FROZEN' END AS state, CASE attempt WHEN 'forced' THEN NULL WHEN 'again' THEN 'already frozen' ELSE CASE WHEN verdict = 'FAIL' THEN 'gates failed' END END AS reason FROM m, o, (VALUES ('first'), ('again'), ('forced')) a(attempt)")
def _(t: Tables):
    path = folder(t, "freeze")
    readiness(t).write.parquet(path)
    gates = t.spark.read.schema("gate string, verdict string, critical boolean").parquet(path)
    files = L.ordered_digest(by_hash(t), "split", "doc_id", x())
    out = None
    for attempt, state, force in (("first", "DRAFT", False), ("again", "FROZEN", False), ("forced", "FROZEN", True)):
        one = L.freeze(gates, files, state, force).select(F.lit(attempt).alias("attempt"), "split", "n", "state", "reason")
        out = one if out is None else out.unionByName(one)
    return out
