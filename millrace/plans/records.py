"""Queries over conversations as records: validity, cleaning, evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import grounding as G
from millrace.operators import quality as Q
from millrace.operators import records as R
from millrace.plans import sqltext as S
from millrace.plans.registry import Tables, query


def m():
    return F.col("messages")


def recs(t: Tables):
    return R.from_turns(t.conversations)


FLOW = """CASE WHEN len(messages) = 0 THEN 'empty' WHEN len(roles) = 0 THEN 'system_only' WHEN roles[1] <> 'user' THEN 'first_not_user'
 WHEN len(list_filter(range(1, len(roles)), lambda i: roles[i] = roles[i + 1])) > 0 THEN 'repeated_role' END"""
FLOWED = f"{S.REC}, ro AS (SELECT conv_id, messages, list_transform(list_filter(messages, lambda x: x.role <> 'system'), lambda x: x.role) AS roles FROM rec), flow AS (SELECT conv_id, messages, {FLOW} AS broken FROM ro)"
BARE = S.strip("text")
PROBLEM = f"CASE WHEN {BARE} = '' THEN 'empty_message' WHEN length({BARE}) < 10 THEN 'excessively_short' WHEN length(text) > 65536 THEN 'excessively_long' WHEN contains(text, '�') THEN 'corrupted_unicode' WHEN regexp_matches(text, '(?i)<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<unk>') OR regexp_matches(text, '\\[INST\\]|\\[/INST\\]|<s>|</s>') THEN 'formatting_artifact' END"
REJECTED = f"{FLOWED}, bad AS (SELECT conv_id, arg_min(p, turn) AS problem FROM (SELECT conv_id, turn, {PROBLEM} AS p FROM conversations) WHERE p IS NOT NULL GROUP BY conv_id), rej AS (SELECT conv_id, coalesce(problem, CASE WHEN broken IS NOT NULL THEN 'schema_error' END) AS reason FROM flow LEFT JOIN bad USING (conv_id))"


@query("flt2_conversation_flow", f"WITH {FLOWED} SELECT conv_id, broken FROM flow")
def _(t: Tables):
    return recs(t).select("conv_id", R.flow_error(m()).alias("broken"))


@query("flt1_cleaner", f"WITH {REJECTED} SELECT conv_id, reason, reason IS NULL AS accepted FROM rej")
def _(t: Tables):
    reason = R.rejection(m())
    return recs(t).select("conv_id", reason.alias("reason"), reason.isNull().alias("accepted"))


@query("ag8_schema_qa", f"WITH {REJECTED} SELECT coalesce(reason, 'valid') AS outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM rej), 6) AS share FROM rej GROUP BY 1")
def _(t: Tables):
    found = recs(t).groupBy(F.coalesce(R.rejection(m()), F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))
    return found.select("outcome", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("flt3_quality_state", f"""
WITH a AS (SELECT conv_id, bool_or({S.count("text", "```")} % 2 <> 0) AS open_fence FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, open_fence, CAST(quality AS DOUBLE) AS q FROM a LEFT JOIN (SELECT doc_id AS conv_id, max(quality) AS quality FROM labels GROUP BY 1) USING (conv_id))
SELECT conv_id, round(greatest(0.0, q - CASE WHEN open_fence THEN 0.15 ELSE 0 END), 4) AS score, CASE WHEN q IS NULL THEN 'UNSCORED' WHEN greatest(0.0, q - CASE WHEN open_fence THEN 0.15 ELSE 0 END) >= 0.85 THEN 'PASSED' ELSE 'FAILED' END AS state FROM b
""".replace("greatest(0.0, q", "if(q IS NULL, NULL, greatest(0.0, q").replace("ELSE 0 END)", "ELSE 0 END))"))
def _(t: Tables):
    fence = F.exists(m(), lambda x: T.occurrences(x["content"], "```") % 2 != 0)
    scores = t.labels.groupBy(F.col("doc_id").alias("conv_id")).agg(F.max("quality").cast("double").alias("q"))
    joined = recs(t).select("conv_id", fence.alias("open")).join(scores, "conv_id", "left")
    state = Q.state(F.col("q"), F.col("open"))
    return joined.select("conv_id", F.when(F.col("q").isNotNull(), state["score"]).alias("score"), state["state"].alias("state"))


@query("flt4_quality_acceptance", """
WITH q AS (SELECT d.doc_id, d.lang, max(l.quality) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL)
SELECT lang, count(*) AS total, count(quality) AS scored, count(*) FILTER (WHERE quality IS NULL) AS unscored, count(*) FILTER (WHERE coalesce(quality, 1) >= 0.85) AS accepted, round(avg(quality), 6) AS mean_score FROM q GROUP BY lang""")
def _(t: Tables):
    q = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = t.documents.select("doc_id", "lang").join(q, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("total"), F.count("quality").alias("scored"), F.count_if(F.col("quality").isNull()).alias("unscored"), F.count_if(F.coalesce(F.col("quality"), F.lit(1)) >= 0.85).alias("accepted"), F.round(F.avg("quality"), 6).alias("mean_score"))


@query("flt4_acceptance_flags", """
WITH q AS (SELECT d.doc_id, max(l.quality) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id)
SELECT enforce, allow_unscored, count(*) FILTER (WHERE quality = 1 OR (quality = 0 AND NOT enforce) OR (quality IS NULL AND allow_unscored)) AS accepted, count(*) FILTER (WHERE quality = 0) AS failed, count(*) FILTER (WHERE quality IS NULL) AS unscored FROM q, (VALUES (true, true), (true, false), (false, true), (false, false)) v(enforce, allow_unscored) GROUP BY enforce, allow_unscored""")
def _(t: Tables):
    best = t.labels.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    scores = t.documents.select("doc_id").join(best, "doc_id", "left")
    flags = [(a, b) for a in (True, False) for b in (True, False)]
    counts = scores.agg(*[F.count_if(Q.accepted(F.col("quality"), enforce=a, allow_unscored=b)).alias(f"{a}|{b}") for a, b in flags], *[F.count_if(Q.score_state(F.col("quality")) == s).alias(s.lower()) for s in ("FAILED", "UNSCORED")])
    row = lambda a, b: F.struct(F.lit(a).alias("enforce"), F.lit(b).alias("allow_unscored"), F.col(f"`{a}|{b}`").alias("accepted"))
    return counts.select(F.explode(F.array(*[row(a, b) for a, b in flags])).alias("r"), "failed", "unscored").select("r.*", "failed", "unscored")


def letters_sql(x: str) -> str:
    return f"list_distinct(list_filter({S.tokens(x)}, lambda w: regexp_matches(w, '^[a-z]{{3,}}$')))"


def nested_sql(rows: str, keys: str, text: str) -> str:
    """Two recursive tables: brackets of ``text`` with inner pairs taken out again and again, and whether nothing is left."""
    pair = r"\(\)|\[\]|\{\}"
    return rf"""bk AS (SELECT {keys}, regexp_replace({text}, '[^(){{}}\[\]]', '', 'g') AS s FROM {rows} UNION ALL SELECT {keys}, regexp_replace(s, '{pair}', '', 'g') FROM bk WHERE regexp_matches(s, '{pair}')),
ne AS (SELECT {keys}, bool_or(s = '') AS nested FROM bk GROUP BY ALL)"""


ANSWERS = "coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') || CASE WHEN conv_id % 4 = 0 THEN ' so $E = m(c^2$ [?]' WHEN conv_id % 4 = 1 THEN ' and $$x = (3)$$ kg' ELSE '' END"


@query("flt9_scientific_qa", rf"""
WITH RECURSIVE a AS (SELECT conv_id, {ANSWERS} AS ans, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS usr FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, ans, usr, {S.count("ans", "$$")} % 2 = 0 AND {S.count("replace(ans, '$$', '')", "$")} % 2 = 0 AS pairs, regexp_extract_all(ans, '(?s)\$\$.*?\$\$|\$[^$]+\$') AS eqs, regexp_matches(usr, '(?i)how (?:much|many)|calculate|compute') AS quant, {letters_sql("usr")} AS su, {letters_sql("ans")} AS sa FROM a),
eq AS (SELECT conv_id, unnest(eqs) AS e FROM b), {nested_sql("eq", "conv_id, e", "e")}, ok AS (SELECT conv_id, bool_and(nested) AS nested FROM ne GROUP BY conv_id),
c AS (SELECT *, pairs AND coalesce(nested, true) AS even, regexp_matches(ans, '(?i)\[(?:citation\s+needed|\?|xx|todo)\]') AS hole, regexp_matches(ans, '\b\d+(?:\.\d+)?(?:e[+-]?\d+)?\b') AS nums FROM b LEFT JOIN ok USING (conv_id))
SELECT conv_id, CAST(len(eqs) AS BIGINT) AS n_equations, even, nums AS has_numbers, hole AS placeholder, CASE WHEN len(su) > 0 AND len(sa) > 0 THEN round(len(list_intersect(su, sa)) / len(su), 6) ELSE 1.0 END AS overlap,
 CASE WHEN NOT even OR hole OR (quant AND NOT nums) THEN 'FAILED' WHEN quant AND len(eqs) = 0 THEN 'VALIDATION_UNCERTAIN' ELSE 'VERIFIED' END AS status FROM c""")
def _(t: Tables):
    k = F.pmod("conv_id", F.lit(4))
    more = F.when(k == 0, " so $E = m(c^2$ [?]").when(k == 1, " and $$x = (3)$$ kg").otherwise("")
    said = recs(t).select("conv_id", F.array_join(R.of_role(m(), "user"), " ").alias("usr"), F.concat(F.array_join(R.of_role(m(), "assistant"), " "), more).alias("ans"))
    quantitative = F.col("usr").rlike("(?i)how (?:much|many)|calculate|compute")
    found = said.select("conv_id", G.scientific(F.col("usr"), F.col("ans"), quantitative).alias("f"))
    return found.select("conv_id", "f.n_equations", "f.even", "f.has_numbers", "f.placeholder", "f.overlap", "f.status")


@query("flt10_balanced_brackets", f"WITH RECURSIVE {nested_sql('documents', 'doc_id', 'text')} SELECT doc_id, nested AS balanced FROM ne")
def _(t: Tables):
    return t.documents.select("doc_id", T.balanced(F.col("text")).alias("balanced"))


PAIRED = f"""pr AS (SELECT a.conv_id, a.turn, u.text AS usr, a.text AS ans FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'),
tk AS (SELECT conv_id, turn, usr, ans, list_distinct({S.tokens("usr")}) AS su, list_distinct({S.tokens("ans")}) AS sa FROM pr), ov AS (SELECT *, len(list_intersect(su, sa)) AS shared FROM tk)"""


def exchanges(t: Tables):
    """Assistant turns with the user turn before them, as word sets."""
    c = t.conversations
    users = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("usr"))
    rows = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("ans")).join(users, ["conv_id", "turn"])
    rows = rows.withColumn("su", F.array_distinct(T.tokens(F.col("usr")))).withColumn("sa", F.array_distinct(T.tokens(F.col("ans"))))
    return rows.withColumn("shared", F.size(F.array_intersect("su", "sa")))


STOP_LIST = "[" + ", ".join(f"'{w}'" for w in G.STOPWORDS) + "]"
# Every third answer gets an equation or a table of its own, so that each rule meets rows on both sides.
SHOWN = "ex AS (SELECT conv_id, turn, usr, ans || CASE (conv_id + turn) % 5 WHEN 0 THEN ' $$zeta + omicron = upsilon + xi$$' WHEN 1 THEN chr(10) || '| a | b |' || chr(10) || '| --- | --- |' WHEN 2 THEN ' (see' ELSE '' END AS ans FROM pr)"
GROUNDED = rf"""{PAIRED}, {SHOWN}, {nested_sql("ex", "conv_id, turn", "usr || ' ' || ans")},
kw AS (SELECT *, list_filter({letters_sql("ans")}, lambda w: NOT list_contains({STOP_LIST}, w)) AS ka, list_filter({letters_sql("usr")}, lambda w: NOT list_contains({STOP_LIST}, w)) AS ku,
 regexp_extract_all(ans, '(?s)\$\$(.*?)\$\$', 1) AS shown, regexp_matches(usr, '(?s)\$\$.{{3,}}\$\$|\$[^$\n]{{3,}}\$') AS src_eq FROM ex JOIN ne USING (conv_id, turn)),
fa AS (SELECT conv_id, turn, usr, ans, nested AND {S.count("usr || ' ' || ans", "```")} % 2 = 0 AND {S.count("usr || ' ' || ans", "$$")} % 2 = 0 AS even,
 CASE WHEN src_eq THEN 0 ELSE len(list_filter(flatten(list_transform(shown, lambda e: regexp_extract_all(e, '[a-zA-Z∂∇∫∑ρσλθ\\]+'))), lambda s: length(s) > 1 AND NOT contains(lower(usr), lower(s)) AND NOT starts_with(s, '\'))) END AS n_unknown,
 (contains(ans, '| --- |') OR contains(ans, '|:---:|')) AND NOT regexp_matches(usr, '(?m)^[ \t]*\|.*\|[ \t]*$') AS made, CASE WHEN len(ka) = 0 THEN 1.0 ELSE len(list_intersect(ka, ku)) / len(ka) END AS overlap FROM kw),
gd AS (SELECT *, CASE WHEN NOT even THEN 'delimiters' WHEN n_unknown > 2 THEN 'symbols' WHEN made THEN 'table' WHEN overlap < 0.2 THEN 'overlap' END AS reason FROM fa)"""


def shown(t: Tables):
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    more = F.when(k == 0, " $$zeta + omicron = upsilon + xi$$").when(k == 1, "\n| a | b |\n| --- | --- |").when(k == 2, " (see").otherwise("")
    rows = exchanges(t).select("conv_id", "turn", "usr", F.concat("ans", more).alias("ans"))
    return rows.withColumn("g", G.evaluate(F.col("usr"), F.col("ans"), F.col("usr")))


@query("flt11_grounding", f"WITH RECURSIVE {GROUNDED} SELECT conv_id, turn, even, CAST(n_unknown AS BIGINT) AS n_unknown, round(overlap, 6) AS overlap, reason, reason IS NULL AS grounded FROM gd")
def _(t: Tables):
    return shown(t).select("conv_id", "turn", "g.even", "g.n_unknown", F.round("g.overlap", 6).alias("overlap"), "g.reason", F.col("g.reason").isNull().alias("grounded"))


@query("flt12_instruction_validator", f"""
WITH {PAIRED} SELECT conv_id, turn, round(shared / greatest(least(len(su), len(sa)), 1), 6) AS containment, shared >= 3 OR shared / greatest(least(len(su), len(sa)), 1) >= 0.2 AS grounded,
 round(0.8 + 0.2 * (shared / greatest(least(len(su), len(sa)), 1)), 4) AS score FROM ov""")
def _(t: Tables):
    c = F.col("shared") / F.greatest(F.least(F.size("su"), F.size("sa")), F.lit(1))
    return exchanges(t).select("conv_id", "turn", F.round(c, 6).alias("containment"), ((F.col("shared") >= 3) | (c >= 0.2)).alias("grounded"), F.round(F.lit(0.8) + c * 0.2, 4).alias("score"))


@query("flt13_composite_six", f"""
WITH RECURSIVE {GROUNDED}, d AS (SELECT conv_id, turn, even, least(1.0, overlap + 0.5) AS g, len({S.words("usr")}) AS uw, len({S.words("ans")}) AS aw, contains(usr || ans, chr(65533)) AS bad,
 list_filter(list_transform(string_split(ans, chr(10)), lambda x: {S.strip("x")}), lambda x: x <> '') AS l FROM gd),
e AS (SELECT *, len(l) > 0 AND 1.0 - len(list_distinct(l)) / len(l) > 0.30 AS rep FROM d)
SELECT conv_id, turn, round(CAST(0.25 * (CASE WHEN even THEN 0.95 ELSE 0.70 END) + 0.25 * g + 0.15 * (CASE WHEN uw < 5 THEN 0.75 ELSE 0.95 END) + 0.1 * (0.94 - CASE WHEN bad THEN 0.3 ELSE 0 END - CASE WHEN rep THEN 0.25 ELSE 0 END)
 + 0.1 * (0.92 - CASE WHEN aw < 20 THEN 0.3 ELSE 0 END - CASE WHEN rep THEN 0.2 ELSE 0 END) + 0.15 * (CASE WHEN bad THEN 0.65 ELSE 0.95 END) AS DOUBLE), 4) AS score FROM e""")
def _(t: Tables):
    score = G.composite_six(F.col("usr"), F.col("ans"), F.least(F.lit(1.0), F.col("g.overlap") + 0.5), F.col("g.even"))
    return shown(t).select("conv_id", "turn", F.round(score, 4).alias("score"))


@query("flt14_composite_nine", f"""
WITH RECURSIVE {GROUNDED}, d AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 0.0 ELSE least(1.0, overlap + 0.35) END AS g, len({S.words("usr")}) AS uw, len({S.words("ans")}) AS aw FROM gd),
s AS (SELECT conv_id, turn, g, reason, CAST(0.2 * (CASE WHEN even AND g >= 0.8 THEN 0.95 ELSE 0.7 END) + 0.25 * g + 0.1 * (CASE WHEN uw >= 8 THEN 0.95 ELSE 0.85 END) + 0.1 * (CASE WHEN contains(ans, '###') OR contains(ans, chr(10) || chr(10)) THEN 0.95 ELSE 0.85 END)
 + 0.1 * (CASE WHEN aw >= 60 THEN 0.95 WHEN aw >= 30 THEN 0.85 ELSE 0.7 END) + 0.1 * (CASE WHEN n_unknown = 0 THEN 0.95 ELSE 0.6 END) + 0.05 * (CASE WHEN regexp_matches(lower(ans), 'because|therefore|thus|hence|leads to|consequently|step') THEN 0.95 ELSE 0.88 END)
 + 0.05 * (CASE WHEN NOT contains(ans, '$$') THEN 1.0 WHEN even THEN 0.98 ELSE 0.4 END) + 0.05 * (CASE WHEN NOT contains(ans, '| --- |') THEN 1.0 WHEN NOT made THEN 0.98 ELSE 0.4 END) AS DOUBLE) AS score FROM d)
SELECT conv_id, turn, round(score, 4) AS score, round(g, 6) AS grounding, score >= 0.85 AND g >= 0.8 AND reason IS NULL AS passed FROM s""")
def _(t: Tables):
    found = shown(t).select("conv_id", "turn", G.composite_nine(F.col("usr"), F.col("ans"), F.col("g")).alias("s"))
    return found.select("conv_id", "turn", F.round("s.score", 4).alias("score"), F.round("s.grounding", 6).alias("grounding"), "s.passed")


METRICS = f"""ev AS (SELECT conv_id, turn, usr AS ref, ans, {S.strip("ans")} AS st FROM pr),
wd AS (SELECT *, {S.words("st")} AS w, list_filter(list_transform(string_split(ans, chr(10)), lambda x: {S.strip("x")}), lambda x: x <> '') AS l FROM ev),
gr AS (SELECT *, {S.grams("w", 2)} AS g2, {S.grams("w", 3)} AS g3, {S.grams("w", 4)} AS g4 FROM wd),
mt AS (SELECT conv_id, turn, length(st) AS n_chars, len(w) AS n_words,
 coalesce((len(g2) - len(list_distinct(g2))) / nullif(len(g2), 0), 0) AS r2, coalesce((len(g3) - len(list_distinct(g3))) / nullif(len(g3), 0), 0) AS r3, coalesce((len(g4) - len(list_distinct(g4))) / nullif(len(g4), 0), 0) AS r4,
 coalesce(round(len(list_distinct(w)) / nullif(len(w), 0), 4), 0) AS unique_words, len(list_filter(range(1, len(l)), lambda i: l[i] = l[i + 1])) > 0 AS repeated_lines,
 NOT regexp_matches(st, '[.!?}}\\])>"'';]$|```$') AS truncated, lower(st) = lower({S.strip("ref")}) AS exact,
 round(CASE WHEN st = '' THEN 0.0 ELSE greatest(0.0, 1.0 - CASE WHEN {S.count("ans", "```")} % 2 <> 0 THEN 0.3 ELSE 0 END - CASE WHEN {S.count("ans", "{")} <> {S.count("ans", "}")} THEN 0.1 ELSE 0 END - CASE WHEN {S.count("ans", "[")} <> {S.count("ans", "]")} THEN 0.1 ELSE 0 END - CASE WHEN {S.count("ans", "(")} <> {S.count("ans", ")")} THEN 0.1 ELSE 0 END) END, 2) AS formatting FROM gr)"""


def sample_metrics(t: Tables):
    """Text metrics of every answer that follows a user turn, which stands for its reference."""
    rows = exchanges(t).withColumn("st", T.strip(F.col("ans")))
    w, lines = T.words(F.col("st")), F.filter(F.transform(F.split("ans", "\n"), T.strip), lambda x: x != "")
    rows = rows.withColumn("w", w).withColumn("l", lines)
    rep = [F.coalesce(T.repetition(F.col("w"), n), F.lit(0.0)).alias(f"r{n}") for n in (2, 3, 4)]
    twice = F.exists(F.zip_with(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)
    union = F.size(F.array_union("su", "sa"))
    return rows.select(
        "conv_id",
        "turn",
        F.length("st").cast("long").alias("n_chars"),
        F.size("w").cast("long").alias("n_words"),
        *rep,
        F.coalesce(F.round(F.size(F.array_distinct("w")) / F.nullif(F.size("w"), F.lit(0)), 4), F.lit(0.0)).alias("unique_words"),
        twice.alias("repeated_lines"),
        (~F.col("st").rlike(r"[.!?}\])>\"';]$|```$")).alias("truncated"),
        (F.lower("st") == F.lower(T.strip(F.col("usr")))).alias("exact"),
        T.formatting(F.col("ans")).alias("formatting"),
        F.round(F.col("shared") / union, 4).alias("keyword_overlap"),
    )


@query("ag20_sample_metrics", f"""
WITH {PAIRED}, {METRICS} SELECT mt.conv_id, mt.turn, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_words AS BIGINT) AS n_words, round(r2, 4) AS r2, round(r3, 4) AS r3, round(r4, 4) AS r4, unique_words, repeated_lines, truncated, exact, formatting,
 round(shared / len(list_distinct(list_concat(su, sa))), 4) AS keyword_overlap FROM mt JOIN ov ON ov.conv_id = mt.conv_id AND ov.turn = mt.turn""")
def _(t: Tables):
    x = sample_metrics(t)
    return x.withColumns({c: F.round(c, 4) for c in ("r2", "r3", "r4")})


AGG = "count(*) AS n, round(avg((r2 + r3 + r4) / 3), 6) AS mean_repetition, round(avg(formatting), 6) AS mean_formatting, round(avg(CAST(truncated AS INT)), 6) AS truncation_rate, round(avg(CAST(repeated_lines AS INT)), 6) AS loop_rate, round(quantile_cont(n_words, 0.5), 6) AS p50_words, round(quantile_cont(n_words, 0.9), 6) AS p90_words, round(quantile_cont(n_words, 0.99), 6) AS p99_words"


def aggregate_metrics(x):
    q = lambda p: F.round(F.percentile("n_words", F.lit(p)), 6).alias(f"p{int(p * 100)}_words")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return x.agg(F.count("*").alias("n"), mean((F.col("r2") + F.col("r3") + F.col("r4")) / 3, "mean_repetition"), mean("formatting", "mean_formatting"), mean(F.col("truncated").cast("int"), "truncation_rate"), mean(F.col("repeated_lines").cast("int"), "loop_rate"), q(0.5), q(0.9), q(0.99))


@query("ag21_aggregated_metrics", f"WITH {PAIRED}, {METRICS} SELECT {AGG} FROM mt")
def _(t: Tables):
    return aggregate_metrics(sample_metrics(t).groupBy())


STRATA = "st AS (SELECT mt.*, coalesce(lang, 'none') AS lang, turn % 4 AS level FROM mt LEFT JOIN (SELECT doc_id AS conv_id, lang FROM documents) d USING (conv_id))"


def stratified_metrics(t: Tables):
    langs = t.documents.select(F.col("doc_id").alias("conv_id"), "lang")
    return sample_metrics(t).join(langs, "conv_id", "left").withColumn("lang", F.coalesce("lang", F.lit("none"))).withColumn("level", F.col("turn") % 4)


@query("ag22_stratified_benchmark", f"WITH {PAIRED}, {METRICS}, {STRATA} SELECT lang, level, {AGG} FROM st GROUP BY GROUPING SETS ((lang), (level), ())")
def _(t: Tables):
    x = stratified_metrics(t)
    sets = x.groupingSets([["lang"], ["level"], []], "lang", "level")
    return aggregate_metrics(sets).select("lang", "level", "n", "mean_repetition", "mean_formatting", "truncation_rate", "loop_rate", "p50_words", "p90_words", "p99_words")


RUNS = f"{PAIRED}, {METRICS}, {STRATA}, base AS (SELECT lang, avg(formatting) AS formatting, avg(n_words) AS n_words, avg((r2 + r3 + r4) / 3) AS repetition FROM st WHERE conv_id % 2 = 0 GROUP BY lang), cand AS (SELECT lang, avg(formatting) AS formatting, avg(n_words) AS n_words, avg((r2 + r3 + r4) / 3) AS repetition FROM st WHERE conv_id % 2 = 1 GROUP BY lang)"


def two_runs(t: Tables):
    x = stratified_metrics(t)
    means = lambda y: y.groupBy("lang").agg(F.avg("formatting").alias("formatting"), F.avg("n_words").alias("n_words"), F.avg((F.col("r2") + F.col("r3") + F.col("r4")) / 3).alias("repetition"))
    return means(x.where("conv_id % 2 = 0")), means(x.where("conv_id % 2 = 1"))


@query("jn3_full_outer_strata", f"WITH {RUNS} SELECT coalesce(b.lang, c.lang) AS lang, round(coalesce(b.formatting, 0), 6) AS base, round(coalesce(c.formatting, 0), 6) AS candidate, round(coalesce(c.formatting, 0) - coalesce(b.formatting, 0), 6) AS delta FROM base b FULL JOIN cand c ON b.lang = c.lang")
def _(t: Tables):
    b, c = (x.select("lang", F.col("formatting").alias(n)) for x, n in zip(two_runs(t), "bc", strict=True))
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    return b.join(c, "lang", "full").select("lang", F.round(zero("b"), 6).alias("base"), F.round(zero("c"), 6).alias("candidate"), F.round(zero("c") - zero("b"), 6).alias("delta"))


@query("ag23_metric_regression", f"""
WITH {RUNS}, u AS (SELECT lang, 'formatting' AS metric, formatting AS v, 1 AS better FROM base UNION ALL SELECT lang, 'n_words', n_words, 1 FROM base UNION ALL SELECT lang, 'repetition', repetition, -1 FROM base),
w AS (SELECT lang, 'formatting' AS metric, formatting AS v FROM cand UNION ALL SELECT lang, 'n_words', n_words FROM cand UNION ALL SELECT lang, 'repetition', repetition FROM cand)
SELECT lang, metric, round(w.v - u.v, 6) AS delta, CASE WHEN better * (w.v - u.v) > 0.01 THEN 'IMPROVED' WHEN better * (w.v - u.v) < -0.01 THEN 'REGRESSED' ELSE 'UNCHANGED' END AS verdict FROM u JOIN w USING (lang, metric)""")
def _(t: Tables):
    names = ["formatting", "n_words", "repetition"]
    b, c = (x.select("lang", *[F.col(n).cast("double").alias(n) for n in names]).unpivot("lang", names, "metric", v) for x, v in zip(two_runs(t), "bc", strict=True))
    delta = F.col("c") - F.col("b")
    gain = F.when(F.col("metric") == "repetition", -delta).otherwise(delta)
    return b.join(c, ["lang", "metric"]).select("lang", "metric", F.round(delta, 6).alias("delta"), F.when(gain > 0.01, "IMPROVED").when(gain < -0.01, "REGRESSED").otherwise("UNCHANGED").alias("verdict"))


@query("ag24_case_comparison", f"""
WITH {PAIRED}, {METRICS}, kw AS (SELECT mt.conv_id, mt.turn, formatting, shared / len(list_distinct(list_concat(su, sa))) AS k FROM mt JOIN ov ON ov.conv_id = mt.conv_id AND ov.turn = mt.turn),
j AS (SELECT a.conv_id, a.turn, 0.7 * (b.k - a.k) + 0.3 * (b.formatting - a.formatting) AS d FROM kw a JOIN kw b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2)
SELECT conv_id, count(*) AS n, round(sum(d), 6) AS net, count(*) FILTER (WHERE round(d, 9) > 0.05) AS better, count(*) FILTER (WHERE round(d, 9) < -0.05) AS worse FROM j GROUP BY conv_id""")
def _(t: Tables):
    rows = exchanges(t).select("conv_id", "turn", T.formatting(F.col("ans")).alias("f"), (F.col("shared") / F.size(F.array_union("su", "sa"))).alias("k"))
    after = rows.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("f").alias("f2"), F.col("k").alias("k2"))
    d = (F.col("k2") - F.col("k")) * 0.7 + (F.col("f2") - F.col("f")) * 0.3
    r = F.round("d", 9)
    return rows.join(after, ["conv_id", "turn"]).withColumn("d", d).groupBy("conv_id").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("net"), F.count_if(r > 0.05).alias("better"), F.count_if(r < -0.05).alias("worse"))


@query("tk6_best_and_worst", f"WITH {PAIRED}, {METRICS}, {STRATA}, a AS (SELECT lang, round(avg(n_words), 6) AS v FROM st GROUP BY lang) SELECT (SELECT lang FROM a ORDER BY v DESC, lang LIMIT 1) AS best, (SELECT lang FROM a ORDER BY v, lang LIMIT 1) AS worst")
def _(t: Tables):
    a = stratified_metrics(t).groupBy("lang").agg(F.round(F.avg("n_words"), 6).alias("v"))
    return a.agg(F.min_by("lang", F.struct(-F.col("v"), "lang")).alias("best"), F.min_by("lang", F.struct("v", "lang")).alias("worst"))


@query("flt20_case_validation", f"""
WITH {S.REC}, c AS (SELECT conv_id, messages[len(messages)].role AS last, {S.collapse("array_to_string(list_transform(list_filter(messages, lambda x: x.role = 'user'), lambda x: x.content), ' ')")} AS prompt FROM rec)
SELECT conv_id, last = 'assistant' AS has_reference, length(prompt) >= 10 AS has_prompt, last = 'assistant' AND length(prompt) >= 10 AS valid FROM c""")
def _(t: Tables):
    reference = F.element_at(m(), -1)["role"] == "assistant"
    prompt = F.length(T.collapse(F.array_join(R.of_role(m(), "user"), " "))) >= 10
    return recs(t).select("conv_id", reference.alias("has_reference"), prompt.alias("has_prompt"), (reference & prompt).alias("valid"))


@query("lk5_suite_duplicates", f"""
WITH {S.REC}, p AS (SELECT conv_id, sha256({S.collapse("array_to_string(list_transform(list_filter(messages, lambda x: x.role = 'user'), lambda x: x.content), ' ')")}) AS h FROM rec)
SELECT conv_id, min(conv_id) OVER (PARTITION BY h) AS first_id, count(*) OVER (PARTITION BY h) > 1 AS duplicated FROM p""")
def _(t: Tables):
    hashed = recs(t).select("conv_id", R.prompt_hash(m()).alias("h"))
    groups = hashed.groupBy("h").agg(F.min("conv_id").alias("first_id"), F.count("*").alias("n"))
    return hashed.join(groups, "h").select("conv_id", "first_id", (F.col("n") > 1).alias("duplicated"))


@query("lk6_answer_leakage", "WITH pr AS (SELECT a.conv_id, a.turn, u.text AS usr, a.text AS ans FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn < a.turn AND u.role = 'user' WHERE a.role = 'assistant') SELECT conv_id, turn, bool_or(length(ans) > 30 AND contains(usr, ans)) AS leaked FROM pr GROUP BY ALL")
def _(t: Tables):
    c = t.conversations
    users = c.where("role = 'user'").select("conv_id", F.col("turn").alias("ut"), F.col("text").alias("usr"))
    both = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("ans")).join(users, "conv_id").where("ut < turn")
    return both.groupBy("conv_id", "turn").agg(F.max((F.length("ans") > 30) & F.col("usr").contains(F.col("ans"))).alias("leaked"))


@query("dd2_conversation_dedup", f"""
WITH {S.REC}, h AS (SELECT conv_id, sha256(array_to_string(list_transform(messages, lambda m: {S.collapse("m.content")} || chr(31) || m.role), chr(30))) AS h FROM rec)
SELECT conv_id, min(conv_id) OVER (PARTITION BY h) AS matched_id, conv_id = min(conv_id) OVER (PARTITION BY h) AS kept FROM h""")
def _(t: Tables):
    hashed = recs(t).select("conv_id", R.content_hash(m()).alias("h"))
    firsts = hashed.groupBy("h").agg(F.min("conv_id").alias("matched_id"))
    return hashed.join(firsts, "h").select("conv_id", "matched_id", (F.col("conv_id") == F.col("matched_id")).alias("kept"))


TRIMMED = r"regexp_replace(regexp_replace(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x0B\f]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g')"


@query("txt4_structure_adapter", rf"""
WITH {PAIRED}, e AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, {TRIMMED.format(c="usr")} AS u, {TRIMMED.format(c="ans")} AS a FROM pr)
SELECT conv_id, turn, CASE k WHEN 5 THEN '' WHEN 2 THEN 'system,user,assistant' ELSE 'user,assistant' END AS roles,
 CASE k WHEN 5 THEN md5('') WHEN 2 THEN md5('Be brief.' || '|' || u || '|' || a) WHEN 3 THEN md5(u || chr(10) || chr(10) || 'en' || '|' || a) ELSE md5(u || '|' || a) END AS content_md5 FROM e""")
def _(t: Tables):
    u, a = F.col("usr"), F.col("ans")
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    said = lambda who, what, one, two: F.array(F.struct(F.lit(one).alias(who), u.alias(what)), F.struct(F.lit(two).alias(who), a.alias(what)))
    # Each shape also carries keys of a later one, which must not win.
    shapes = (
        F.struct(said("role", "content", "user", "assistant").alias("messages"), F.lit("x").alias("question"), F.lit("x").alias("answer")),
        F.struct(said("from", "value", "human", "gpt").alias("conversations"), F.lit("x").alias("prompt"), F.lit("x").alias("response")),
        F.struct(F.lit("Be brief.").alias("system"), u.alias("prompt"), a.alias("response"), F.lit("x").alias("instruction"), F.lit("x").alias("output")),
        F.struct(u.alias("instruction"), F.lit("en").alias("input"), a.alias("output"), F.lit("x").alias("question"), F.lit("x").alias("answer")),
        F.struct(u.alias("question"), a.alias("answer"), F.lit("x").alias("response")),
    )
    raw = F.to_json(shapes[0])
    for i, shape in enumerate(shapes):
        raw = F.when(k == i, F.to_json(shape)).otherwise(raw)
    read = exchanges(t).select("conv_id", "turn", R.adapt(F.when(k == 5, '{"title": "neither"}').otherwise(raw)).alias("m"))
    part = lambda name: F.transform("m", lambda m: m[name])
    return read.select("conv_id", "turn", F.array_join(part("role"), ",").alias("roles"), F.md5(F.array_join(part("content"), "|").cast("binary")).alias("content_md5"))
