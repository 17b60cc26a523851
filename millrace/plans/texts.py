"""Queries of text functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import quality as Q
from millrace.operators import records as R
from millrace.plans import sqltext as S
from millrace.plans.registry import Tables, query



def x():
    return F.col("text")


def sha(x):
    return F.sha2(x.cast("binary"), 256)


@query("txt1_normalize_text", r"""
WITH a AS (SELECT doc_id, text, regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{E000}-\x{F8FF}]', '', 'g') AS t FROM documents)
SELECT doc_id, sha256(t) AS text_sha, t <> text AS changed FROM a""")
def _(t: Tables):
    done = T.no_controls(T.plain_lines(T.nfc(x())))
    return t.documents.withColumn("t", done).select("doc_id", sha(F.col("t")).alias("text_sha"), (F.col("t") != x()).alias("changed"))


@query("txt2_record_text", r"""
SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x0B\f]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g')) AS text_sha FROM conversations""")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", sha(T.trim_lines(T.plain_lines(T.nfc(x())))).alias("text_sha"))


@query("txt3_role_mapping", """
WITH a AS (SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'GPT' WHEN 1 THEN 'human' WHEN 2 THEN '' WHEN 3 THEN 'tool' ELSE role END AS raw FROM conversations)
SELECT raw, CASE lower(raw) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN '' THEN 'user' ELSE lower(raw) END AS role, count(*) AS n FROM a GROUP BY ALL""")
def _(t: Tables):
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    raw = F.when(k == 0, "GPT").when(k == 1, "human").when(k == 2, "").when(k == 3, "tool").otherwise(F.col("role"))
    return t.conversations.select(raw.alias("raw"), T.role(raw).alias("role")).groupBy("raw", "role").agg(F.count("*").alias("n"))


@query("txt8_glyph_map", r"""
WITH a AS (SELECT doc_id, replace(replace(replace(text, ' the ', ' ' || chr(63723) || ' '), ' of ', ' ' || chr(61485) || ' '), ' and ', ' ' || chr(61599) || ' ') AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(replace(replace(t, chr(63723), '('), chr(61485), ' - '), '[\x{E000}-\x{F8FF}\x{FFFD}]', ' ', 'g')) AS text_sha FROM a""")
def _(t: Tables):
    put = x()
    for word, code in ((" the ", 63723), (" of ", 61485), (" and ", 61599)):
        put = F.replace(put, F.lit(word), F.lit(f" {chr(code)} "))
    return t.documents.select("doc_id", sha(T.glyphs(put)).alias("text_sha"))


@query("txt9_nfkc")
def _(t: Tables):
    return t.documents.select("doc_id", sha(T.nfkc(x())).alias("text_sha"))


@query("txt10_dehyphenate", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(text, 'on ', 'on- ' || chr(10)), '([a-zA-Z]{2,})-\s*[\r\n]+\s*([a-zA-Z]{2,})', '\1\2', 'g'), '([a-zA-Z]{3,})-\s+([a-zA-Z]{3,})', '\1-\2', 'g')) AS text_sha FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", sha(T.dehyphenate(F.replace(x(), F.lit("on "), F.lit("on- \n")))).alias("text_sha"))


@query("txt11_page_numbers", r"""
WITH a AS (SELECT doc_id, replace(text, chr(10), chr(10) || 'Page ' || (doc_id % 90) || ' of 90' || chr(10)) AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(t, '(?m)^\s*(?:Page\s+)?\d+(?:\s+of\s+\d+)?\s*$', '', 'g'), '(?m)^\s*\[\d+\]\s*$', '', 'g')) AS text_sha FROM a""")
def _(t: Tables):
    paged = F.replace(x(), F.lit("\n"), F.concat(F.lit("\nPage "), (F.col("doc_id") % 90).cast("string"), F.lit(" of 90\n")))
    return t.documents.select("doc_id", sha(T.no_page_numbers(paged)).alias("text_sha"))


@query("txt12_running_headers", r"""
WITH a AS (SELECT doc_id, 'NPTEL - ' || source || chr(10) || text AS t FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?im)^\s*arXiv:\d{4}\.\d{4,5}(?:v\d+)?\s*\[[a-zA-Z\.\-]+\]\s*.*$', '', 'g'), '(?im)^\s*NPTEL\s*[-–—]\s*.*$', '', 'g'), '(?im)^\s*Joint\s+Initiative\s+of\s+IITs\s+and\s+IISc\s*[-–—]?\s*.*$', '', 'g'), '(?im)^\s*Funded\s+by\s+MHRD\s*[-–—]?\s*.*$', '', 'g')) AS text_sha FROM a""")
def _(t: Tables):
    return t.documents.select("doc_id", sha(T.no_headers(F.concat(F.lit("NPTEL - "), F.col("source"), F.lit("\n"), x()))).alias("text_sha"))


FRAGMENT_LIST = ", ".join(f"'{f}'" for f in T.FRAGMENTS)


@query("txt13_formula_blocks", rf"""
WITH a AS (SELECT doc_id, string_split(replace(replace(text, ', ', ',' || chr(10) || '∂ρ' || chr(10) || '= 0' || chr(10) || '(2.1)' || chr(10)), ' of ', chr(10) || 'x' || chr(10) || chr(10)), chr(10)) AS l FROM documents),
b AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM a),
c AS (SELECT doc_id, i, line, {S.strip("line")} AS bare FROM b),
d AS (SELECT *, bare <> '' AND length(bare) <= 25 AND (bare IN ({FRAGMENT_LIST}) OR regexp_matches(bare, '^([-∂∇+=()\[\]·^/\\\p{{L}}\p{{N}}\p{{M}}_]|{S.WS})+$') OR regexp_matches(bare, '^\(\d+(?:\.\d+)*\)$')) AND NOT (bare LIKE '%.' AND length(bare) > 6) AS short FROM c),
e AS (SELECT *, CASE WHEN short THEN i - row_number() OVER (PARTITION BY doc_id, short ORDER BY i) END AS run FROM d),
f AS (SELECT doc_id, min(i) AS i, string_agg(bare, ' ' ORDER BY i) AS block, string_agg(bare, chr(10) ORDER BY i) AS apart FROM e WHERE short GROUP BY doc_id, run),
g AS (SELECT doc_id, i, CASE WHEN regexp_matches(block, '∂|∇|∫|∑|ρ|σ|λ|θ|vec|hat|alpha|beta|psi') AND (contains(block, '=') OR contains(block, '+') OR contains(block, '-') OR regexp_matches(block, '\(\d+(?:\.\d+)*\)')) THEN chr(10) || '$$' || block || '$$' || chr(10) ELSE apart END AS line FROM f
 UNION ALL SELECT doc_id, i, CASE WHEN bare = '' THEN '' ELSE line END FROM e WHERE NOT short)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS text_md5 FROM g GROUP BY doc_id""")
def _(t: Tables):
    cut = F.replace(F.replace(x(), F.lit(", "), F.lit(",\n∂ρ\n= 0\n(2.1)\n")), F.lit(" of "), F.lit("\nx\n\n"))
    return t.documents.select("doc_id", F.md5(T.join_formulas(cut).cast("binary")).alias("text_md5"))


@query("txt14_whitespace", rf"""
SELECT doc_id, sha256({S.strip(r"regexp_replace(regexp_replace(replace(replace(text, chr(160), ' '), chr(8203), ''), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')")}) AS text_sha FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", sha(T.spaces(x())).alias("text_sha"))


@query("txt15_document_chain")
def _(t: Tables):
    return t.documents.select("doc_id", sha(T.document(x())).alias("text_sha"))


@query("txt16_content_hash", f"""
WITH {S.REC} SELECT conv_id, sha256(array_to_string(list_transform(messages, lambda m: {S.collapse("m.content")} || chr(31) || m.role), chr(30))) AS content_hash FROM rec""")
def _(t: Tables):
    return R.from_turns(t.conversations).select("conv_id", R.content_hash(F.col("messages")).alias("content_hash"))


@query("txt17_prompt_hash", f"""
WITH {S.REC} SELECT conv_id, sha256({S.collapse("array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: m.content), ' ')")}) AS prompt_hash FROM rec""")
def _(t: Tables):
    return R.from_turns(t.conversations).select("conv_id", R.prompt_hash(F.col("messages")).alias("prompt_hash"))


@query("txt18_record_fingerprint", """
SELECT p_partkey, sha256(concat_ws(chr(31), 'p_brand=' || p_brand, 'p_name=' || p_name, 'p_size=' || p_size, 'p_type=' || p_type)) AS fingerprint FROM part""")
def _(t: Tables):
    columns = sorted(("p_name", "p_brand", "p_type", "p_size"))
    return t.part.select("p_partkey", sha(F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])).alias("fingerprint"))


@query("txt19_batch_seed", """
SELECT conv_id, CAST('0x' || substr(sha256('qwen3:production:seed:42:batch:' || conv_id), 1, 8) AS BIGINT) AS seed FROM (SELECT DISTINCT conv_id FROM conversations)""")
def _(t: Tables):
    digest = F.sha2(F.concat(F.lit("qwen3:production:seed:42:batch:"), F.col("conv_id").cast("string")).cast("binary"), 256)
    return t.conversations.select("conv_id").distinct().select("conv_id", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("seed"))


@query("txt20_token_estimates", f"""
WITH a AS (SELECT doc_id, text, len({S.words("text")}) AS n FROM documents)
SELECT doc_id, CAST(greatest(n, floor(length(text) * 0.25)) AS BIGINT) AS chunk_tokens, CAST(ceil(n * CAST(1.3 AS DOUBLE)) AS BIGINT) AS suite_tokens, CAST(floor(n * CAST(1.3 AS DOUBLE)) AS BIGINT) AS audit_tokens FROM a""")
def _(t: Tables):
    return t.documents.select("doc_id", *[T.estimate(x(), k).alias(f"{k}_tokens") for k in ("chunk", "suite", "audit")])


@query("txt21_turn_counts", f"""
SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len({S.words("text")})) AS BIGINT) AS n_words,
  list(role ORDER BY turn) FILTER (WHERE role <> 'system') = ['user', 'assistant'] AS single_turn FROM conversations GROUP BY conv_id""")
def _(t: Tables):
    m = F.col("messages")
    roles = F.transform(F.filter(m, lambda x: x["role"] != "system"), lambda x: x["role"])
    total = lambda f: F.aggregate(m, F.lit(0).cast("long"), lambda n, x: n + f(x["content"]).cast("long"))
    single = roles == F.array(F.lit("user"), F.lit("assistant"))
    return R.from_turns(t.conversations).select("conv_id", F.size(m).cast("long").alias("n_turns"), total(F.length).alias("n_chars"), total(T.n_words).alias("n_words"), F.when(F.size(roles) > 0, single).alias("single_turn"))


@query("txt22_log_redaction", r"""
SELECT doc_id, sha256(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])', '', 'g'), '(?i)(password|secret|token|key|api_key|auth)\s*[:=]\s*["'']?([^"''\s]+)["'']?', '\1: [REDACTED]', 'g'), 'Bearer\s+[A-Za-z0-9\-\._~\+/]+=*', 'Bearer [REDACTED]', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS text_sha FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", sha(T.redact_log(x())).alias("text_sha"))


@query("txt23_payload_redaction", """
SELECT event_id, '[REDACTED]' AS top, '[REDACTED]' AS deep, event_type AS kept, CAST(user_id AS VARCHAR) AS user_id, '[REDACTED]' AS listed FROM events""")
def _(t: Tables):
    inner = F.struct(F.col("event_type").alias("kind"), F.struct(F.col("props").alias("Session_Token")).alias("deeper"))
    payload = F.to_json(F.struct(F.col("value").alias("password"), "user_id", inner.alias("inner"), F.array("event_type", "props").alias("my_cookies")))
    shown = t.events.select("event_id", T.redact_json(payload).alias("j"))
    j = lambda path: F.get_json_object("j", path)
    return shown.select("event_id", j("$.password").alias("top"), j("$.inner.deeper.Session_Token").alias("deep"), j("$.inner.kind").alias("kept"), j("$.user_id").alias("user_id"), j("$.my_cookies").alias("listed"))


# Payloads of four shapes: a secret object with objects inside, a secret list of objects, a telling key inside a list, and none at all.
SECRET_SHAPES = ("""'{"id": ' || event_id || ', "Auth_Info": ' || {secret0} || ', "kind": "' || event_type || '"}'""", """'{"a": {"b": {"my_TOKENS": ' || {secret1} || ', "c": [1, {"d": ' || user_id || '}]}}}'""", """'[{"n": ' || user_id || ', "inner": [{"Cookie": ' || {secret2} || '}, "secret"]}]'""", """'{"sec_ret": {"user": ' || user_id || '}, "text": "password: ' || event_type || '"}'""")
SECRETS = ("""'{"x": {"y": [' || user_id || ', {"z": "}"}]}, "w": null}'""", """'[{"k": "' || event_type || '"}, [2]]'""", """'"a ' || chr(92) || '" b"'""")


def payload_sql(*secrets: str) -> str:
    shapes = list(SECRET_SHAPES)
    for k, secret in enumerate(secrets):
        shapes[k] = shapes[k].replace(f"{{secret{k}}}", secret)
    return f"CASE event_id % 4 WHEN 0 THEN {shapes[0]} WHEN 1 THEN {shapes[1]} WHEN 2 THEN {shapes[2]} ELSE {shapes[3]} END"


@query("txt23_nested_redaction", f"""SELECT event_id, {payload_sql(*["'" + '"[REDACTED]"' + "'"] * 3)} AS shown FROM events""")
def _(t: Tables):
    return t.events.select("event_id", T.redact_json(F.expr(payload_sql(*SECRETS))).alias("shown"))


@query("txt25_chat_template", f"""
WITH {S.REC} SELECT conv_id, sha256(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')) AS text_sha FROM rec""")
def _(t: Tables):
    return R.from_turns(t.conversations).select("conv_id", sha(R.chat_template(F.col("messages"))).alias("text_sha"))


@query("txt26_label_mask", f"""
WITH w AS (SELECT conv_id, turn, role, len({S.words("text")}) AS n FROM conversations)
SELECT conv_id, CAST(sum(n + 2) AS BIGINT) AS n_labels, CAST(coalesce(sum(n + 1) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS n_learned,
 array_to_string(flatten(list(list_concat(['-'], list_transform(range(n + 1), lambda i: CASE WHEN role = 'assistant' THEN '+' ELSE '-' END)) ORDER BY turn)), '') AS mask FROM w GROUP BY conv_id""")
def _(t: Tables):
    labels = R.from_turns(t.conversations).select("conv_id", R.label_array(F.col("messages")).alias("l"))
    signs = F.array_join(F.transform("l", lambda v: F.when(v == -100, "-").otherwise("+")), "")
    return labels.select("conv_id", F.size("l").cast("long").alias("n_labels"), F.size(F.filter("l", lambda v: v != -100)).cast("long").alias("n_learned"), signs.alias("mask"))


@query("txt27_prompt_completion", f"""
WITH {S.REC} SELECT conv_id, sha256(array_to_string(list_transform(messages[1:len(messages) - 1], lambda m: m.role || ': ' || m.content), chr(10))) AS prompt_sha, sha256(messages[len(messages)].content) AS completion_sha
FROM rec WHERE len(messages) > 1 AND messages[len(messages)].role = 'assistant'""")
def _(t: Tables):
    both = R.from_turns(t.conversations).select("conv_id", R.prompt_and_completion(F.col("messages")).alias("p")).where("p is not null")
    return both.select("conv_id", sha(F.col("p.prompt")).alias("prompt_sha"), sha(F.col("p.completion")).alias("completion_sha"))


@query("flt5_text_audit", rf"""
WITH a AS (SELECT doc_id, {S.strip("text")} AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {S.strip("x")}), lambda x: x <> '') AS l FROM a),
c AS (SELECT doc_id, CASE WHEN t = '' THEN 0.0 ELSE round(greatest(0.0, 1.0 - (CASE WHEN length(t) < 100 THEN 0.3 ELSE 0.0 END) - least(0.4, {S.count("t", "�")} * 0.05) - (CASE WHEN len(l) >= 4 AND 1.0 - len(list_distinct(l)) / greatest(len(l), 1) > 0.25 THEN 0.25 ELSE 0.0 END)
 - (CASE WHEN length(t) - length(regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xA0\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2028}}-\x{{202E}}\x{{FEFF}}]', '', 'g')) > 0.05 * length(t) THEN 0.4 ELSE 0.0 END)), 4) END AS score FROM b)
SELECT doc_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.85 THEN 'PASSED' WHEN score >= 0.5 THEN 'WARNING' ELSE 'REJECTED' END AS status FROM c""")
def _(t: Tables):
    return t.documents.select("doc_id", Q.audit(x()).alias("a")).select("doc_id", "a.score", "a.status")


LICENCE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '(?i){p}') THEN '{n}'" for p, n in Q.LICENCES) + " WHEN contains(lower(source), 'nptel') THEN 'CC-BY-NC-SA-4.0' WHEN contains(lower(source), 'arxiv') THEN 'arXiv Non-exclusive License' ELSE 'UNKNOWN' END"
LICENSED = f"lic AS (SELECT doc_id, lang, source, {LICENCE_SQL} AS name FROM (SELECT doc_id, lang, source, text AS s FROM documents))"
RIGHTS_SQL = f"CASE WHEN upper(name) IN {Q.VERIFIED} THEN 'LICENSE_VERIFIED' WHEN upper(name) IN {Q.INTERNAL} THEN 'INTERNAL_ONLY' WHEN upper(name) IN ('UNKNOWN', 'UNSPECIFIED', 'NONE', '') THEN 'LICENSE_UNKNOWN' ELSE 'RIGHTS_REVIEW_REQUIRED' END"


def licensed(t: Tables):
    return t.documents.select("doc_id", "lang", "source", Q.licence(x(), F.lit(None).cast("string"), F.col("source")).alias("l"))


@query("flt6_license", f"WITH {LICENSED} SELECT doc_id, name, name <> 'UNKNOWN' AS known, name NOT IN {Q.PERMISSIVE} AS internal_only FROM lic")
def _(t: Tables):
    return licensed(t).select("doc_id", "l.name", "l.known", "l.internal_only")


@query("flt7_rights", f"WITH {LICENSED} SELECT doc_id, {RIGHTS_SQL} AS status, {RIGHTS_SQL} NOT IN ('LICENSE_UNKNOWN', 'RIGHTS_REVIEW_REQUIRED') AS releasable FROM lic")
def _(t: Tables):
    status = Q.rights(F.col("l.name"))
    return licensed(t).select("doc_id", status.alias("status"), (~status.isin("LICENSE_UNKNOWN", "RIGHTS_REVIEW_REQUIRED")).alias("releasable"))


@query("snk6_quarantine", f"WITH {LICENSED} SELECT doc_id, source, name FROM lic WHERE {RIGHTS_SQL} IN ('LICENSE_UNKNOWN', 'RIGHTS_REVIEW_REQUIRED')")
def _(t: Tables):
    return licensed(t).where(Q.rights(F.col("l.name")).isin("LICENSE_UNKNOWN", "RIGHTS_REVIEW_REQUIRED")).select("doc_id", "source", "l.name")


@query("ag31_rights_rollup", f"WITH {LICENSED} SELECT {RIGHTS_SQL} AS status, name, count(*) AS n FROM lic GROUP BY ALL")
def _(t: Tables):
    return licensed(t).groupBy(Q.rights(F.col("l.name")).alias("status"), F.col("l.name").alias("name")).agg(F.count("*").alias("n"))


TOPIC_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for n, p in (*Q.TOPICS, *Q.FIELDS)) + " ELSE 'general_physics' END"


@query("flt8_topic_classifier", f"""
WITH a AS (SELECT doc_id, lower(concat_ws(' ', source, text)) AS s FROM documents), b AS (SELECT doc_id, {TOPIC_SQL} AS subtopic FROM a)
SELECT doc_id, subtopic, CASE WHEN subtopic IN ('ai_ml', 'linux_systems', 'cybersecurity') THEN subtopic ELSE 'science' END AS domain, CASE WHEN subtopic = 'general_physics' THEN 0.7::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM b""")
def _(t: Tables):
    return t.documents.select("doc_id", Q.topic(F.col("source"), x()).alias("t")).select("doc_id", "t.subtopic", "t.domain", "t.confidence")


# Documents with categories of several kinds: none, one with blanks and capitals, an unknown one first, a finer one, an empty list, two known ones.
GIVEN = ("NULL", "' Quant-PH '", "'xx|cs.lg'", "'astro-ph.GA'", "''", "'math.DG|cs.CR'")
GIVEN_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(GIVEN)) + " END"
BY_CATEGORY = "CASE " + " ".join(f"WHEN starts_with(lower(trim(c)), '{p.lower()}') THEN {{'domain': '{d}', 'topic': '{t}', 'subtopic': '{s}', 'confidence': 0.95::DOUBLE}}" for p, d, t, s in Q.CATEGORIES) + " END"
FIELD_SQL = " ".join(f"WHEN '{f}' THEN {{'domain': '{f}', 'topic': '{t}', 'subtopic': '{s}', 'confidence': 0.85::DOUBLE}}" for f, (t, s) in Q.FIELD_TOPICS.items())


@query("flt8_category_classifier", f"""WITH a AS (SELECT doc_id, string_split({GIVEN_SQL}, '|') AS cs, lower(concat_ws(' ', source, text)) AS s FROM documents), b AS (SELECT doc_id, list_filter(list_transform(cs, lambda c: {BY_CATEGORY}), lambda r: r IS NOT NULL)[1] AS known, {TOPIC_SQL} AS w FROM a),
e AS (SELECT doc_id, coalesce(known, CASE w {FIELD_SQL} ELSE {{'domain': 'science', 'topic': 'physics', 'subtopic': w, 'confidence': CASE WHEN w = 'general_physics' THEN 0.7::DOUBLE ELSE 0.85::DOUBLE END}} END) AS r FROM b) SELECT doc_id, r.domain AS domain, r.topic AS topic, r.subtopic AS subtopic, r.confidence AS confidence FROM e""")
def _(t: Tables):
    categories = F.split(F.expr(GIVEN_SQL), r"\|")
    return t.documents.select("doc_id", Q.classified(categories, F.col("source"), x()).alias("r")).select("doc_id", "r.*")
