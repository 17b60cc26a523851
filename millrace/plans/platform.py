"""Queries of sources, sinks, structure, events, gates and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunks as C
from millrace.operators.lineage import depths
from millrace.plans import sqltext as S
from millrace.plans.corpus import SPLIT, by_hash
from millrace.plans.registry import Tables, query
from millrace.session import work_folder
from millrace.sources import raw
from millrace.streaming import events as E


def x():
    return F.col("text")


def turn_lines(t: Tables):
    """Turns as JSON lines, every seventh cut short."""
    whole = F.to_json(F.struct("conv_id", "turn", "role"))
    n = F.col("conv_id") * 10 + F.col("turn")
    return t.conversations.select(n.alias("_line"), F.when(n % 7 == 0, F.expr("substr(to_json(struct(conv_id, turn, role)), 1, 9)")).otherwise(whole).alias("_raw"))


@query("src1_jsonl_loader", "SELECT conv_id * 10 + turn AS line, CASE WHEN (conv_id * 10 + turn) % 7 <> 0 THEN role END AS role, (conv_id * 10 + turn) % 7 = 0 AS failed FROM conversations")
def _(t: Tables):
    rows = raw.json_lines(turn_lines(t), "conv_id long, turn long, role string")
    return rows.select(F.col("_line").alias("line"), "record.role", F.col("error").isNotNull().alias("failed"))


@query("flt26_malformed_rows", "SELECT count(*) AS total, count(*) FILTER (WHERE (conv_id * 10 + turn) % 7 = 0) AS malformed FROM conversations")
def _(t: Tables):
    return raw.json_lines(turn_lines(t), "conv_id long").agg(F.count("*").alias("total"), F.count("error").alias("malformed"))


@query("src2_json_arrays", "SELECT conv_id, turn, role FROM conversations")
def _(t: Tables):
    arrays = t.conversations.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role"))).alias("j"))
    return arrays.select("conv_id", F.explode(F.from_json("j", "array<struct<turn:long,role:string>>")).alias("r")).select("conv_id", "r.turn", "r.role")


@query("src6_text_titles", f"SELECT doc_id, {S.strip('string_split(text, chr(10))[1]')} AS title, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents")
def _(t: Tables):
    parts = F.split("text", "\n")
    return t.documents.select("doc_id", T.strip(parts[0]).alias("title"), F.size(parts).cast("long").alias("n_lines"))


MARKED_SQL = "replace(text, '. ', '.' || chr(10) || '## Part ' || lang || ' #' || chr(10))"


def marked():
    return F.replace(x(), F.lit(". "), F.concat(F.lit(".\n## Part "), F.col("lang"), F.lit(" #\n")))


@query("src6_text_sections", rf"""
WITH a AS (SELECT doc_id, source, string_split(CASE WHEN lang = 'en' THEN '# ' || source || ' title' || chr(10) ELSE '' END || {MARKED_SQL}, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, CASE WHEN len(list_filter(l[1:10], lambda x: starts_with(x, '# '))) > 0 THEN {S.strip("substr(list_filter(l[1:10], lambda x: starts_with(x, '# '))[1], 3)")} ELSE source END AS doc_title, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM a),
c AS (SELECT *, starts_with(line, '#') AS head, sum(CAST(starts_with(line, '#') AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS s, {S.strip("line")} AS bare FROM b),
d AS (SELECT doc_id, s, any_value(doc_title) AS doc_title, max(CASE WHEN head THEN {S.strip("regexp_replace(line, '^#+', '')")} END) AS title, count(*) FILTER (WHERE NOT head AND bare <> '') AS n, md5(string_agg(bare, chr(10) ORDER BY i) FILTER (WHERE NOT head AND bare <> '')) AS text_md5 FROM c GROUP BY doc_id, s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS section, coalesce(title, doc_title) AS title, n AS n_paragraphs, text_md5 FROM d WHERE n > 0""")
def _(t: Tables):
    text = F.concat(F.when(F.col("lang") == "en", F.concat(F.lit("# "), "source", F.lit(" title\n"))).otherwise(""), marked())
    docs = t.documents.select("doc_id", "source", text.alias("text"))
    rows = docs.select("doc_id", C.hash_title(x(), F.col("source")).alias("doc_title"), F.posexplode(C.hash_sections(x())).alias("k", "s"))
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("section"), F.coalesce("s.title", "doc_title").alias("title"), F.size("s.paragraphs").cast("long").alias("n_paragraphs"), F.md5(F.array_join("s.paragraphs", "\n").cast("binary")).alias("text_md5"))


@query("src7_document_fields", "SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN lang ELSE source END) AS body_md5 FROM documents")
def _(t: Tables):
    k = F.col("doc_id") % 3
    j = F.to_json(F.struct(F.when(k == 0, x()).alias("text"), F.when(k == 1, F.col("lang")).alias("abstract"), F.when(k == 2, F.col("source")).alias("content")))
    r = t.documents.select("doc_id", F.from_json(j, "text string, abstract string, content string, dump string").alias("r"))
    return r.select("doc_id", F.md5(F.coalesce("r.text", "r.abstract", "r.content", "r.dump").cast("binary")).alias("body_md5"))


@query("src8_html_extract", r"""
WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<header\b.*?</header>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM a)
SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS lang, sha256(trim(regexp_replace(h, '[ \t\r\n\f\x0B]+', ' ', 'g'))) AS text_sha FROM b""")
def _(t: Tables):
    h = F.col("html")
    return t.pages.select("page_id", F.regexp_extract(h, "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("lang"), F.sha2(raw.html_text(h).cast("binary"), 256).alias("text_sha"))


@query("gen7_html_structure", r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<h[1-6][^>]*>')) AS BIGINT) AS n_headings, CAST(len(regexp_extract_all(html, '(?i)<table\b')) AS BIGINT) AS n_tables, CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '(?i)<li\b')) AS BIGINT) AS n_items FROM pages")
def _(t: Tables):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return t.pages.select("page_id", n("(?i)<h[1-6][^>]*>").alias("n_headings"), n(r"(?i)<table\b").alias("n_tables"), n(r"(?i)<a\s").alias("n_links"), n(r"(?i)<li\b").alias("n_items"))


@query("src10_name_metadata", r"SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, regexp_extract(url, '(\d+)', 1) AS number, regexp_extract(url, '\.([a-z]+)$', 1) AS ending FROM pages")
def _(t: Tables):
    e = lambda p: F.regexp_extract("url", p, 1)
    return t.pages.select("page_id", e("/([a-z]{2})/").alias("lang"), e(r"(\d+)").alias("number"), e(r"\.([a-z]+)$").alias("ending"))


UNION = "u AS (SELECT 'doc' AS kind, doc_id AS id, text, lang FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text, NULL FROM conversations UNION ALL SELECT 'item', item_id, text, NULL FROM benchmark)"


def pool(t: Tables):
    d = t.documents.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text", "lang")
    c = t.conversations.select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    b = t.benchmark.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text")
    return d.unionByName(c, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)


@query("src11_source_union", f"WITH {UNION} SELECT kind, id, lang, length(text) AS n_chars FROM u")
def _(t: Tables):
    return pool(t).select("kind", "id", "lang", F.length("text").cast("long").alias("n_chars"))


@query("so3_bag_union", f"WITH {UNION} SELECT kind, count(*) AS n FROM u GROUP BY kind")
def _(t: Tables):
    return pool(t).groupBy("kind").agg(F.count("*").alias("n"))


@query("so2_union_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t: Tables):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("src12_record_source", f"SELECT source, count(*) AS n, CAST(sum(len({S.words('text')})) AS BIGINT) AS n_words FROM documents GROUP BY source")
def _(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(T.n_words(x())).alias("n_words"))


@query("jn1_document_lookup", "SELECT c.conv_id, c.turn, d.lang, d.source FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn").join(t.documents.select(F.col("doc_id").alias("conv_id"), "lang", "source"), "conv_id", "left")


@query("src13_document_index", "SELECT d.doc_id, p.url FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def _(t: Tables):
    return t.documents.select("doc_id").join(t.pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")


@query("jn2_result_join", "SELECT a.doc_id, a.quality, a.toxic, d.n_chars FROM labels a JOIN documents d USING (doc_id)")
def _(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", "toxic", "n_chars")


@query("jn5_resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("jn12_label_enrichment", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(t: Tables):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("jn13_lineage", "WITH RECURSIVE e AS (SELECT doc_id AS id, doc_id // 2 AS parent FROM documents WHERE doc_id > 0), r AS (SELECT id, parent, 1 AS depth FROM e UNION ALL SELECT r.id, e.parent, r.depth + 1 FROM r JOIN e ON e.id = r.parent) SELECT id, max(depth) AS depth FROM r GROUP BY id")
def _(t: Tables):
    edges = t.documents.where("doc_id > 0").selectExpr("doc_id AS id", "doc_id div 2 AS parent")
    return depths(edges)


@query("txt5_metadata_defaults", "SELECT lang AS domain, coalesce(nullif(source, 'src0'), 'general') AS topic, count(*) AS n FROM documents GROUP BY ALL")
def _(t: Tables):
    topic = F.coalesce(F.nullif("source", F.lit("src0")), F.lit("general"))
    return t.documents.groupBy(F.col("lang").alias("domain"), topic.alias("topic")).agg(F.count("*").alias("n"))


@query("txt6_source_adapters", "SELECT kind, id, CASE kind WHEN 'doc' THEN 0.9::DOUBLE WHEN 'turn' THEN 0.95::DOUBLE ELSE NULL END AS score FROM (WITH " + UNION + " SELECT * FROM u)")
def _(t: Tables):
    return pool(t).select("kind", "id", F.when(F.col("kind") == "doc", 0.9).when(F.col("kind") == "turn", 0.95).alias("score"))


@query("txt7_enrichment", "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'reviewed' END, source, 'unknown') AS provenance FROM documents LEFT JOIN labels USING (doc_id)")
def _(t: Tables):
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "reviewed"), "source", F.lit("unknown")).alias("provenance"))


@query("snk1_jsonl_round_trip", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def _(t: Tables):
    path = f"{work_folder(t.spark)}/jsonl-{uuid.uuid4().hex}"
    t.documents.select("doc_id", "text").write.json(path)
    return t.spark.read.schema("doc_id long, text string").json(path).select("doc_id", F.md5(x().cast("binary")).alias("text_md5"))


@query("snk4_split_writer", f"WITH {SPLIT} SELECT split, count(*) AS n FROM sp GROUP BY split")
def _(t: Tables):
    path = f"{work_folder(t.spark)}/splits-{uuid.uuid4().hex}"
    by_hash(t).select("doc_id", "split").write.partitionBy("split").parquet(path)
    return t.spark.read.schema("doc_id long, split string").parquet(path).groupBy("split").agg(F.count("*").alias("n"))


FOLD_SQL = f"""pp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, p, greatest(len({S.words('p')}), length(p) // 4) AS n FROM (SELECT doc_id, i, {S.strip('l')} AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE p <> ''),
r AS (SELECT doc_id, i, n AS size, 0 AS c FROM pp WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN r.size + p.n > 256 THEN p.n ELSE r.size + p.n END, CASE WHEN r.size + p.n > 256 THEN r.c + 1 ELSE r.c END FROM r JOIN pp p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
ch AS (SELECT doc_id, c, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM r JOIN pp USING (doc_id, i) GROUP BY doc_id, c)"""


@query("gen1_chunker", f"WITH RECURSIVE {FOLD_SQL} SELECT doc_id, c AS chunk, substr(sha256(doc_id || ':sec_0:' || c || ':' || text), 1, 16) AS chunk_id, CAST(greatest(len({S.words('text')}), length(text) // 4) AS BIGINT) AS tokens FROM ch")
def _(t: Tables):
    c = C.chunks(t.documents, 256)
    return c.select("doc_id", "chunk", C.chunk_id(F.col("doc_id"), F.lit("sec_0"), F.col("chunk"), x()).alias("chunk_id"), T.estimate(x()).alias("tokens"))


LINES = f"ln AS (SELECT doc_id, i - 1 AS place, {S.strip('l')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"
TYPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for p, n in C.HEADINGS) + " ELSE 'section' END"
HEAD_SQL = f"(length(line) BETWEEN 3 AND 120 AND NOT (line LIKE '%.' AND NOT regexp_matches(line, '^\\d+\\.')) AND ({TYPE_SQL} <> 'section' OR (upper(line) = line AND lower(line) <> line AND len({S.words('line')}) <= 8 AND length(line) >= 4)))"


@query("gen3_heading_types", f"WITH {LINES} SELECT kind, count(*) AS n, count(*) FILTER (WHERE head) AS n_headings FROM (SELECT {TYPE_SQL} AS kind, {HEAD_SQL} AS head FROM ln) GROUP BY kind")
def _(t: Tables):
    ln = C.lines(t.documents).select(C.heading_type(F.col("line")).alias("kind"), C.is_heading(F.col("line")).alias("head"))
    return ln.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("head").alias("n_headings"))


@query("gen2_sections", f"WITH {LINES}, m AS (SELECT *, {HEAD_SQL} AS head FROM ln), s AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY place) AS BIGINT) AS section FROM m) SELECT doc_id, section, arg_min(line, place) FILTER (WHERE head) AS heading, count(*) FILTER (WHERE NOT head AND line <> '') AS n_lines, CAST(sum(CASE WHEN head THEN 0 ELSE length(line) END) AS BIGINT) AS n_chars FROM s GROUP BY doc_id, section")
def _(t: Tables):
    return C.sections(t.documents)


@query("gen4_references", f"WITH {LINES} SELECT doc_id, count(*) AS n_references FROM ln WHERE regexp_matches(line, '^(?:\\[(\\d+)\\]|(\\d+)\\.)\\s+(.+)$') GROUP BY doc_id")
def _(t: Tables):
    return C.lines(t.documents).where(F.col("line").rlike(r"^(?:\[(\d+)\]|(\d+)\.)\s+(.+)$")).groupBy("doc_id").agg(F.count("*").alias("n_references"))


@query("gen5_equations", rf"SELECT doc_id, CAST(len(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '(?s)\$\$(.*?)\$\$', 1), regexp_extract_all(regexp_replace(text, '(?s)\$\$.*?\$\$', ' ', 'g'), '\$([^$\n]+)\$', 1)), lambda e: {S.strip('e')}), lambda e: length(e) > 2))) AS BIGINT) AS n_equations FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.size(C.equations(x())).cast("long").alias("n_equations"))


@query("gen6_pipe_tables", f"WITH {LINES}, p AS (SELECT doc_id, place, {S.count('line', '|')} + 1 AS cells, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM ln WHERE {S.count('line', '|')} >= 2) SELECT doc_id, min(place) AS first, count(*) AS n_rows, max(cells) AS n_columns FROM p GROUP BY doc_id, run")
def _(t: Tables):
    return C.pipe_tables(t.documents).withColumn("first", F.col("first").cast("long"))


@query("gen6_table_cells", rf"""
WITH a AS (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || '| a | ' || lang || ' | c |' || chr(10) || '| --- | :-: | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || ' | 3 | 4 | 5 | 6 |' || chr(10)), chr(10)) AS l FROM documents),
b AS (SELECT doc_id, {S.strip("line")} AS line, i FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM a)),
c AS (SELECT doc_id, line, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b WHERE line LIKE '|%|' AND length(line) > 1),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, run) AS n, list_transform(string_split(regexp_replace(line, '^\|+|\|+$', '', 'g'), '|'), lambda c: {S.strip("c")}) AS cells FROM c),
e AS (SELECT *, first_value(cells) OVER (PARTITION BY doc_id, run ORDER BY i) AS h FROM d WHERE n > 1),
f AS (SELECT doc_id, run, k, h, list_transform(range(1, len(h) + 1), lambda j: coalesce(cells[j], '')) AS cells FROM e WHERE NOT (k = 2 AND regexp_matches(line, '^\|?[\s\-:]+(?:\|[\s\-:]+)+\|?$')))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS number, array_to_string(any_value(h), ',') AS headers, count(*) - 1 AS n_rows,
 md5(string_agg('| ' || array_to_string(cells, ' | ') || ' |' || CASE WHEN k = 1 THEN chr(10) || '| ' || array_to_string(list_transform(h, lambda c: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY k)) AS markdown_md5 FROM f GROUP BY doc_id, run""")
def _(t: Tables):
    text = F.replace(x(), F.lit(". "), F.concat(F.lit(".\n| a | "), F.col("lang"), F.lit(" | c |\n| --- | :-: | --- |\n| 1 | 2 |\n | 3 | 4 | 5 | 6 |\n")))
    rows = t.documents.select("doc_id", F.posexplode(C.tables(text)).alias("k", "t"))
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("number"), F.array_join("t.headers", ",").alias("headers"), F.size("t.rows").cast("long").alias("n_rows"), F.md5(C.table_markdown(F.col("t")).cast("binary")).alias("markdown_md5"))


@query("gen9_explode_lines", f"WITH {LINES} SELECT doc_id, place, md5(line) AS line_md5 FROM ln WHERE line <> ''")
def _(t: Tables):
    return C.lines(t.documents).where("line <> ''").select("doc_id", F.col("place").cast("long").alias("place"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("gen8_chunk_analysis", r"SELECT doc_id, regexp_matches(text, '(?i)\b(?:is defined as|refers to|is called)\b') AS has_definition, regexp_matches(text, '(?i)\b(?:law|theorem|principle)\b') AS has_law, regexp_matches(text, '\d') AS has_numbers, regexp_matches(text, '(?i)\b(?:therefore|hence|step)\b') AS has_derivation FROM documents")
def _(t: Tables):
    r = x().rlike
    return t.documents.select("doc_id", r(r"(?i)\b(?:is defined as|refers to|is called)\b").alias("has_definition"), r(r"(?i)\b(?:law|theorem|principle)\b").alias("has_law"), r(r"\d").alias("has_numbers"), r(r"(?i)\b(?:therefore|hence|step)\b").alias("has_derivation"))


MATH = r"[$=+\-*/^_(){}\[\]\d]|\\(?:alpha|beta|gamma|delta|omega|nabla|partial|int|sum|frac|sqrt)"


@query("flt15_unit_density", f"WITH a AS (SELECT doc_id, text, len({S.words('text')}) AS w, len(regexp_extract_all(text, '{MATH}')) AS m FROM documents) SELECT doc_id, w >= 25 AS selected, round(least(1.0, m / greatest(length(text), 1)), 6) AS math_density FROM a")
def _(t: Tables):
    return t.documents.select("doc_id", (T.n_words(x()) >= 25).alias("selected"), F.round(F.least(F.lit(1.0), F.regexp_count("text", F.lit(MATH)) / F.greatest(F.length("text"), F.lit(1))), 6).alias("math_density"))


@query("flt16_difficulty", f"WITH a AS (SELECT doc_id, len({S.words('text')}) AS w, length(text) / greatest(len({S.words('text')}), 1) AS mean FROM documents) SELECT doc_id, CASE WHEN w < 60 THEN 'beginner' WHEN w < 350 AND mean < 6.5 THEN 'intermediate' WHEN mean < 8 THEN 'advanced' ELSE 'expert' END AS difficulty FROM a")
def _(t: Tables):
    w = T.n_words(x())
    mean = F.length("text") / F.greatest(w, F.lit(1))
    return t.documents.select("doc_id", F.when(w < 60, "beginner").when((w < 350) & (mean < 6.5), "intermediate").when(mean < 8, "advanced").otherwise("expert").alias("difficulty"))


@query("flt17_task_eligibility", f"WITH a AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '\\d') THEN 'calculation' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN len({S.words('text')}) > 180 THEN 'summary' END, 'question', 'explanation'], lambda v: v IS NOT NULL) AS l FROM documents) SELECT doc_id, array_to_string(l[1:3], ',') AS tasks FROM a")
def _(t: Tables):
    tasks = F.array_compact(F.array(F.when(x().rlike(r"\d"), "calculation"), F.when(x().contains("|"), "table"), F.when(T.n_words(x()) > 180, "summary"), F.lit("question"), F.lit("explanation")))
    return t.documents.select("doc_id", F.array_join(F.slice(F.array_distinct(tasks), 1, 3), ",").alias("tasks"))


@query("flt18_case_audits", f"SELECT item_id, length(text) < 100 AS short, {S.count('text', '(')} <> {S.count('text', ')')} AS unbalanced, {S.count('text', '```')} % 2 <> 0 AS open_fence FROM benchmark")
def _(t: Tables):
    n = lambda s: T.occurrences(x(), s)
    return t.benchmark.select("item_id", (F.length("text") < 100).alias("short"), (n("(") != n(")")).alias("unbalanced"), (n("```") % 2 != 0).alias("open_fence"))


@query("flt19_case_score", f"WITH s AS (SELECT item_id, (1.0 - CASE WHEN length(text) < 100 THEN 0.3 ELSE 0 END + 1.0 - CASE WHEN len({S.words('text')}) < 20 THEN 0.2 ELSE 0 END) / 2 AS score FROM benchmark) SELECT item_id, round(CAST(score AS DOUBLE), 4) AS score, CASE WHEN score >= 0.9 THEN 'PASS' WHEN score >= 0.75 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM s")
def _(t: Tables):
    score = (F.lit(2.0) - F.when(F.length("text") < 100, 0.3).otherwise(0.0) - F.when(T.n_words(x()) < 20, 0.2).otherwise(0.0)) / 2
    return t.benchmark.select("item_id", F.round(score, 4).alias("score"), F.when(score >= 0.9, "PASS").when(score >= 0.75, "WARN").otherwise("FAIL").alias("verdict"))


@query("flt21_template_lookup", "SELECT p_type, count(*) AS n, max(p_size) AS largest FROM part WHERE p_size >= 10 AND p_brand LIKE '%1%' GROUP BY p_type")
def _(t: Tables):
    return t.part.where("p_size >= 10 and p_brand like '%1%'").groupBy("p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("largest"))


@query("flt22_log_page", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-02 00:00:00' ORDER BY ts, event_id LIMIT 1000")
def _(t: Tables):
    return t.events.where("event_type = 'error' and ts > timestamp'2024-01-02 00:00:00'").orderBy("ts", "event_id").limit(1000).select("event_id", "event_type", "user_id")


@query("tk5_log_paging", "SELECT event_id, user_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 100")
def _(t: Tables):
    return t.events.where("user_id = 7").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id")


@query("flt23_event_replay", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def _(t: Tables):
    return E.replay(t.events, 500).orderBy("event_id").limit(100).select("event_id", "event_type")


@query("flt24_staleness", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, max(ts) AS last_ts, epoch(date_trunc('second', (SELECT now FROM n))) - epoch(date_trunc('second', max(ts))) > 3600 AS offline FROM events GROUP BY user_id")
def _(t: Tables):
    now = t.events.agg(F.max("ts").alias("now"))
    seen = E.last_seen(t.events).join(F.broadcast(now))  # one row
    return seen.select("user_id", "last_ts", (F.unix_timestamp("now") - F.unix_timestamp("last_ts") > 3600).alias("offline"))


@query("ag32_daily_quota", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM events, n WHERE ts > now - INTERVAL 24 HOUR GROUP BY event_type")
def _(t: Tables):
    now = t.events.agg(F.max("ts").alias("now"))
    recent = t.events.join(F.broadcast(now)).where(F.col("ts") > F.col("now") - F.expr("interval 24 hours"))  # one row
    return recent.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query("ag33_best_so_far", "SELECT event_id, min(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def _(t: Tables):
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.min("value").over(w).alias("best"))


@query("tk2_top_per_key", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5")
def _(t: Tables):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("k", F.row_number().over(w)).where("k <= 5").select("user_id", "event_id", "value")


@query("tk3_target_truncation", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def _(t: Tables):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id")


@query("tk4_error_sample", "SELECT doc_id, n_chars FROM documents WHERE n_chars < 200 ORDER BY doc_id LIMIT 50")
def _(t: Tables):
    return t.documents.where("n_chars < 200").select("doc_id", "n_chars").orderBy("doc_id").limit(50)


def drained(t: Tables, df, mode: str, label: str):
    return E.drained(df, mode, work_folder(t.spark), f"{label}-{uuid.uuid4().hex}")


@query("st1_event_replay_stream", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def _(t: Tables):
    return drained(t, E.replay(E.stream(t.spark, t.folder, "events"), 500).select("event_id", "event_type"), "append", "replay")


@query("st2_best_metric_stream", "SELECT event_type, min(value) AS lowest, max(value) AS highest FROM events GROUP BY event_type")
def _(t: Tables):
    return drained(t, E.best_so_far(E.stream(t.spark, t.folder, "events")), "complete", "best")


@query("st3_heartbeat_stream", "SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id")
def _(t: Tables):
    return drained(t, E.last_seen(E.stream(t.spark, t.folder, "events")), "complete", "heartbeat")


@query("st4_dedup_stream", "SELECT DISTINCT event_type, props FROM events")
def _(t: Tables):
    return drained(t, E.unique_payloads(E.stream(t.spark, t.folder, "events")).select("event_type", "props"), "append", "dedup")


QUIET = 21_600


@query("st3_silent_users", f"SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id HAVING epoch_ms(max(ts)) + {QUIET * 1000} <= epoch_ms((SELECT max(ts) FROM events))")
def _(t: Tables):
    with E.rocksdb(t.spark):
        return drained(t, E.silent(E.stream(t.spark, t.folder, "events"), QUIET), "append", "silent")


@query("st3_stale_users", "SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id HAVING epoch_ms((SELECT max(ts) FROM events)) // 1000 - epoch_ms(max(ts)) // 1000 > 21600")
def _(t: Tables):
    now = t.events.agg(F.max("ts").cast("timestamp").alias("now"))
    seen = drained(t, E.last_seen(E.stream(t.spark, t.folder, "events")), "complete", "stale")
    return E.stale(seen.join(F.broadcast(now)), F.col("now"), QUIET).select("user_id", "last_ts")  # one row


@query("st4_recent_dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Tables):
    recent = E.unique_recent(E.stream(t.spark, t.folder, "events"), ["user_id", "event_type"], "60 days")
    return drained(t, recent.select("user_id", "event_type"), "append", "recent")
