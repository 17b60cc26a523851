"""Queries over documents: duplicates, leakage, distributions, splits and quotas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import allocation as A
from millrace.operators import minhash as H
from millrace.operators import release as L
from millrace.operators import similarity as M
from millrace.plans import sqltext as S
from millrace.plans.registry import Tables, query
from millrace.session import written


def x():
    return F.col("text")


def bare_hash():
    return F.sha2(T.strip_ends(x()).cast("binary"), 256)


HASHED = f"h AS (SELECT *, sha256({S.strip('text')}) AS h FROM documents)"


@query("entry_corpus_health", f"""
WITH {HASHED}, f AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY h) <> doc_id AS dup FROM h),
bg AS (SELECT item_id, unnest({S.shingles('text')}) AS g FROM benchmark), dg AS (SELECT doc_id, unnest({S.shingles('text')}) AS g FROM documents),
hit AS (SELECT doc_id, count(DISTINCT g) AS shared FROM dg WHERE g IN (SELECT g FROM bg) GROUP BY doc_id)
SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE dup) AS n_exact_duplicates, count(*) FILTER (WHERE coalesce(shared, 0) >= 8) AS n_touching_benchmark, round(count(*) FILTER (WHERE dup) / count(*), 6) AS duplicate_rate FROM f LEFT JOIN hit USING (doc_id) GROUP BY lang""")
def corpus_health(t: Tables):
    docs = t.documents.select("doc_id", "text")
    digests = written(t.documents.select("doc_id", "lang", F.unhex(bare_hash()).alias("h")), "text-digests")  # read twice
    firsts = digests.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    hashed = lambda: F.explode(T.gram_hashes(x())).alias("g")
    grams = t.benchmark.select(hashed()).distinct()
    shared = docs.select("doc_id", hashed()).join(grams, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))
    flags = digests.select("doc_id", "lang").join(firsts, "doc_id", "left").join(shared, "doc_id", "left")
    dup = F.count_if(F.col("first").isNull())
    return flags.groupBy("lang").agg(F.count("*").alias("n_docs"), dup.alias("n_exact_duplicates"), F.count_if(F.coalesce("shared", F.lit(0)) >= 8).alias("n_touching_benchmark"), F.round(dup / F.count("*"), 6).alias("duplicate_rate"))


@query("dd1_row_dedup", "SELECT count(*) AS total, count(DISTINCT (p_name, p_brand, p_type, p_size)) AS retained, count(*) - count(DISTINCT (p_name, p_brand, p_type, p_size)) AS removed FROM part")
def _(t: Tables):
    kept = t.part.groupBy("p_name", "p_brand", "p_type", "p_size").agg(F.count("*").alias("n"))
    return kept.agg(F.sum("n").alias("total"), F.count("*").alias("retained"), (F.sum("n") - F.count("*")).alias("removed"))


@query("dd5_exact_text_dedup", f"WITH {HASHED} SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS matched_id, min(doc_id) OVER (PARTITION BY h) = doc_id AS kept FROM h")
def _(t: Tables):
    docs = written(t.documents.select("doc_id", F.unhex(bare_hash()).alias("h")), "text-digests")  # read twice
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("matched_id"))
    return docs.join(firsts, "h").select("doc_id", "matched_id", (F.col("doc_id") == F.col("matched_id")).alias("kept"))


@query("dd7_document_dedup", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS kept_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables):
    return t.documents.groupBy(F.sha2(x().cast("binary"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept_id")).where("copies > 1")


def near(t: Tables, grams, percent: int):
    return M.pairs(M.gram_sets(t.documents, "doc_id", grams), None, percent)


def pair_sql(grams: str, percent: int) -> str:
    return f"""g AS (SELECT doc_id AS id, unnest(gs) AS gram, len(gs) AS n FROM (SELECT doc_id, {grams} AS gs FROM documents)),
p AS (SELECT l.id AS a, r.id AS b, count(*) AS shared, any_value(l.n) AS na, any_value(r.n) AS nb FROM g l JOIN g r ON l.gram = r.gram AND l.id < r.id GROUP BY 1, 2), pairs AS (SELECT a, b, shared, round(shared / (na + nb - shared), 6) AS jaccard FROM p WHERE shared * 100 >= {percent} * (na + nb - shared))"""


@query("jn6_near_pairs", f"WITH {pair_sql(S.shingles('text'), 85)} SELECT * FROM pairs")
def _(t: Tables):
    return near(t, T.gram_hashes(x()), 85)


def greedy_sql(links: str) -> str:
    """Rows that greedy keeping drops, one row after the other, from links (a, b)."""
    return f"""nd AS (SELECT id, nb, row_number() OVER (ORDER BY id) AS k FROM (SELECT a AS id, list(b) AS nb FROM {links} GROUP BY a)),
rc AS (SELECT CAST(0 AS BIGINT) AS k, []::BIGINT[] AS lost UNION ALL SELECT rc.k + 1, CASE WHEN list_contains(lost, nd.id) THEN lost ELSE list_concat(lost, nb) END FROM rc JOIN nd ON nd.k = rc.k + 1),
gone AS (SELECT DISTINCT unnest(lost) AS id FROM rc WHERE k = (SELECT max(k) FROM rc))"""


@query("dd3_near_dedup_greedy", f"WITH RECURSIVE {pair_sql(S.shingles('text'), 85)}, {greedy_sql('pairs')} SELECT doc_id, doc_id NOT IN (SELECT id FROM gone) AS kept FROM documents")
def _(t: Tables):
    return M.near_kept(M.gram_sets(t.documents, "doc_id", T.gram_hashes(x())), 85).select(F.col("id").alias("doc_id"), "kept")


FLAT = S.collapse("lower(text)")
CHARS = f"list_transform([{FLAT}], lambda p: list_distinct(list_transform(range(1, greatest(length(p) - 2, 1) + 1), lambda i: substr(p, i, 3))))[1]"


@query("dd4_near_dedup_char_grams", f"WITH RECURSIVE {pair_sql(CHARS, 85).replace('documents', '(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)')}, {greedy_sql('pairs')} SELECT conv_id * 1000 + turn AS id, conv_id * 1000 + turn NOT IN (SELECT id FROM gone) AS kept FROM conversations")
def _(t: Tables):
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.char_grams(x()).alias("g"))
    return M.near_kept(M.gram_sets(turns, "id", F.transform("g", lambda g: F.xxhash64(g))), 85)


SIGN = "list_transform(range(0, 16), lambda s: list_min(list_transform(gs, lambda g: xor(CAST('0x' || substr(md5(g), 25, 8) AS BIGINT), s * 2654435761 % 4294967296))))"


def signatures(t: Tables):
    """16 minima of permuted 32-bit digests over character 3-grams of each turn."""
    seeds = tuple(s * 2654435761 % 4294967296 for s in range(16))
    none = F.array_repeat(F.lit(None).cast("long"), len(seeds))
    return t.conversations.select("conv_id", "turn", F.when(x().isNull(), none).otherwise(H.signature(x(), seeds)).alias("sig"))


SIGNED = f"s AS (SELECT conv_id, turn, {SIGN} AS sig FROM (SELECT conv_id, turn, {CHARS} AS gs FROM conversations))"


@query("dd6_minhash_signature", f"WITH {SIGNED} SELECT conv_id, turn, array_to_string(sig, ',') AS sig FROM s")
def _(t: Tables):
    return signatures(t).select("conv_id", "turn", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@query("jn9_lsh_band_join", f"WITH {SIGNED}, b AS (SELECT conv_id * 1000 + turn AS id, k AS band, array_to_string(sig[k * 4 + 1:k * 4 + 4], ',') AS key FROM s, range(0, 4) r(k)) SELECT band, key, count(*) AS members, min(id) AS first_id FROM b GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables):
    key = lambda k: F.struct(F.lit(k).cast("long").alias("band"), F.array_join(F.slice("sig", k * 4 + 1, 4).cast("array<string>"), ",").alias("key"))
    rows = signatures(t).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.explode(F.array(*[key(k) for k in range(4)])).alias("b"))
    return rows.groupBy("b.band", "b.key").agg(F.count("*").alias("members"), F.min("id").alias("first_id")).where("members > 1")


@query("dd8_duplicate_rate", f"WITH {HASHED}, f AS (SELECT lang, min(doc_id) OVER (PARTITION BY h) <> doc_id AS dup FROM h) SELECT lang, count(*) AS n, count(*) FILTER (WHERE dup) AS duplicates, round(count(*) FILTER (WHERE dup) / count(*), 6) AS rate FROM f GROUP BY lang")
def _(t: Tables):
    docs = t.documents.select("doc_id", "lang", bare_hash().alias("h"))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    dup = F.count_if(F.col("doc_id") != F.col("first_id"))
    return docs.join(firsts, "h").groupBy("lang").agg(F.count("*").alias("n"), dup.alias("duplicates"), F.round(dup / F.count("*"), 6).alias("rate"))


@query("dd9_duplicate_clusters", f"WITH {pair_sql(S.shingles('text'), 90)} SELECT b AS doc_id, min(a) AS star FROM pairs GROUP BY b")
def _(t: Tables):
    return near(t, T.gram_hashes(x()), 90).groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("star"))


@query("dd10_duplicate_sample", f"WITH {HASHED}, f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id FROM h) SELECT doc_id, first_id FROM f WHERE doc_id <> first_id ORDER BY doc_id LIMIT 50")
def _(t: Tables):
    docs = t.documents.select("doc_id", bare_hash().alias("h"))
    firsts = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(firsts, "h").where("doc_id <> first_id").select("doc_id", "first_id").orderBy("doc_id").limit(50)


SPLIT = "sp AS (SELECT *, CASE WHEN CAST('0x' || substr(md5('42:' || doc_id), 1, 2) AS INT) < 230 THEN 'train' WHEN CAST('0x' || substr(md5('42:' || doc_id), 1, 2) AS INT) < 243 THEN 'validation' ELSE 'test' END AS split FROM documents)"


def by_hash(t: Tables):
    """Documents with a split drawn by digest alone, as input of leakage checks."""
    k = F.conv(F.substring(A.shuffled(F.col("doc_id")), 1, 2), 16, 10).cast("int")
    return t.documents.withColumn("split", F.when(k < 230, "train").when(k < 243, "validation").otherwise("test"))


@query("lk1_exact_split_overlap", f"WITH {SPLIT}, h AS (SELECT DISTINCT split, sha256({S.strip('text')}) AS h FROM sp) SELECT a.split AS one, b.split AS two, count(*) AS shared FROM h a JOIN h b ON a.h = b.h AND a.split < b.split GROUP BY ALL")
def _(t: Tables):
    h = by_hash(t).select("split", bare_hash().alias("h")).distinct()
    return h.select(F.col("split").alias("one"), "h").join(h.select(F.col("split").alias("two"), "h"), "h").where("one < two").groupBy("one", "two").agg(F.count("*").alias("shared"))


@query("jn4_overlap_semi", f"WITH {SPLIT}, h AS (SELECT doc_id, split, sha256({S.strip('text')}) AS h FROM sp) SELECT doc_id FROM h WHERE split = 'test' AND h IN (SELECT h FROM h WHERE split = 'train')")
def _(t: Tables):
    h = by_hash(t).select("doc_id", "split", bare_hash().alias("h"))
    return h.where("split = 'test'").join(h.where("split = 'train'").select("h"), "h", "left_semi").select("doc_id")


@query("so1_split_intersect", f"WITH {SPLIT} SELECT sha256({S.strip('text')}) AS h FROM sp WHERE split = 'train' INTERSECT SELECT sha256({S.strip('text')}) FROM sp WHERE split = 'validation'")
def _(t: Tables):
    h = by_hash(t).select("split", bare_hash().alias("h"))
    return h.where("split = 'train'").select("h").intersect(h.where("split = 'validation'").select("h"))


@query("lk2_near_split_leakage", f"WITH {SPLIT}, {pair_sql(S.shingles('text'), 85)} SELECT l.split AS one, r.split AS two, count(*) AS n_pairs FROM pairs JOIN sp l ON l.doc_id = a JOIN sp r ON r.doc_id = b WHERE l.split <> r.split GROUP BY ALL")
def _(t: Tables):
    s = by_hash(t).select("doc_id", "split")
    p = near(t, T.gram_hashes(x()), 85)
    both = p.join(s.toDF("a", "one"), "a").join(s.toDF("b", "two"), "b").where("one <> two")
    return both.groupBy("one", "two").agg(F.count("*").alias("n_pairs"))


@query("ag35_source_groups", f"WITH {SPLIT} SELECT source, count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM sp GROUP BY source HAVING count(DISTINCT split) > 1")
def _(t: Tables):
    g = by_hash(t).groupBy("source").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return g.where("size(s) > 1").select("source", F.size("s").cast("long").alias("n_splits"), F.array_join("s", ",").alias("splits"))


@query("lk3_key_overlap", f"WITH {SPLIT}, k AS (SELECT 'source' AS kind, source AS key, split FROM sp UNION ALL SELECT 'lang', lang, split FROM sp) SELECT kind, count(*) AS n_keys FROM (SELECT kind, key FROM k GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY kind")
def _(t: Tables):
    long = by_hash(t).select("split", "source", "lang").unpivot("split", ["source", "lang"], "kind", "key")
    return long.groupBy("kind", "key").agg(F.count_distinct("split").alias("n")).where("n > 1").groupBy("kind").agg(F.count("*").alias("n_keys"))


@query("lk7_isolation", f"""WITH {SPLIT}, k AS (SELECT sha256(text) AS h, count(DISTINCT split) > 1 AS shared FROM sp GROUP BY 1)
SELECT split, count(*) AS n, count(*) FILTER (WHERE shared) AS n_shared, count(*) FILTER (WHERE shared) = 0 AS isolated, true AS unchanged FROM sp JOIN k ON sha256(text) = h GROUP BY split""")
def _(t: Tables):
    # The digests recorded when the splits were frozen, against those of the splits as they are.
    frozen = written(L.ordered_digest(by_hash(t), "split", "doc_id", x()), "frozen").select("split", F.col("digest").alias("frozen"))
    now = L.ordered_digest(by_hash(t), "split", "doc_id", x())
    h = F.sha2(x().cast("binary"), 256)
    per_text = by_hash(t).groupBy(h.alias("h"), "split").agg(F.count("*").alias("c"))
    shared = per_text.groupBy("h").agg((F.count("*") > 1).alias("shared"))
    counts = per_text.join(shared, "h").groupBy("split").agg(F.coalesce(F.sum(F.when(F.col("shared"), F.col("c"))), F.lit(0)).alias("n_shared"))
    joined = now.join(counts, "split").join(frozen, "split", "left")
    return joined.select("split", "n", "n_shared", (F.col("n_shared") == 0).alias("isolated"), F.col("digest").eqNullSafe(F.col("frozen")).alias("unchanged"))


BENCH = f"bg AS (SELECT item_id AS b, unnest(gs) AS gram, len(gs) AS nb FROM (SELECT item_id, {S.shingles('text', short='none')} AS gs FROM benchmark)), dg AS (SELECT doc_id AS a, unnest(gs) AS gram, len(gs) AS na FROM (SELECT doc_id, {S.shingles('text', short='none')} AS gs FROM documents))"


@query("lk4_benchmark_contamination", f"WITH {BENCH}, c AS (SELECT a, b, count(*) AS shared, any_value(nb) AS nb FROM dg JOIN bg USING (gram) GROUP BY a, b) SELECT a AS doc_id, b AS item_id, shared, round(shared / nb, 6) AS coverage FROM c WHERE shared * 100 >= 85 * nb")
def _(t: Tables):
    b = M.exploded(M.gram_sets(t.benchmark, "item_id", T.gram_hashes(x(), short="none"))).toDF("item_id", "nb", "gram")
    d = M.exploded(M.gram_sets(t.documents, "doc_id", T.gram_hashes(x(), short="none"))).select(F.col("id").alias("doc_id"), "gram")
    c = d.join(b, "gram").groupBy("doc_id", "item_id", "nb").agg(F.count("*").alias("shared"))
    return c.where(F.col("shared") * 100 >= F.col("nb") * 85).select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("nb"), 6).alias("coverage"))


@query("jn7_benchmark_jaccard", f"WITH {BENCH}, c AS (SELECT a, b, count(*) AS shared, any_value(na) AS na, any_value(nb) AS nb FROM dg JOIN bg USING (gram) GROUP BY a, b) SELECT a AS a, b AS b, shared, round(shared / (na + nb - shared), 6) AS jaccard FROM c WHERE shared * 100 >= 50 * (na + nb - shared)")
def _(t: Tables):
    return M.pairs(M.gram_sets(t.documents, "doc_id", T.gram_hashes(x(), short="none")), M.gram_sets(t.benchmark, "item_id", T.gram_hashes(x(), short="none")), 50)


@query("jn8_benchmark_self_similarity", f"WITH g AS (SELECT item_id AS id, unnest(gs) AS gram, len(gs) AS n FROM (SELECT item_id, {S.shingles('text', short='tokens')} AS gs FROM benchmark)), p AS (SELECT l.id AS a, r.id AS b, count(*) AS shared, any_value(l.n) AS na, any_value(r.n) AS nb FROM g l JOIN g r ON l.gram = r.gram AND l.id < r.id GROUP BY 1, 2) SELECT a, b, shared, round(shared / (na + nb - shared), 6) AS jaccard FROM p WHERE shared * 100 >= 10 * (na + nb - shared)")
def _(t: Tables):
    return M.pairs(M.gram_sets(t.benchmark, "item_id", T.gram_hashes(x(), short="tokens")), None, 10)


@query("jn10_theta_residual", f"WITH {pair_sql(S.shingles('text'), 70)} SELECT a, b, CASE WHEN jaccard >= 0.9 AND l.source = r.source THEN 'DUPLICATE' ELSE 'SIMILAR' END AS kind FROM pairs JOIN documents l ON l.doc_id = a JOIN documents r ON r.doc_id = b WHERE l.lang = r.lang")
def _(t: Tables):
    d = t.documents.select("doc_id", "lang", "source")
    p = near(t, T.gram_hashes(x()), 70).join(d.toDF("a", "la", "sa"), "a").join(d.toDF("b", "lb", "sb"), "b").where("la = lb")
    return p.select("a", "b", F.when((F.col("jaccard") >= 0.9) & (F.col("sa") == F.col("sb")), "DUPLICATE").otherwise("SIMILAR").alias("kind"))


@query("gen12_shingle_counts", f"SELECT doc_id, len({S.shingles('text')}) AS word3, len({S.shingles('text', short='tokens')}) AS word3_tokens, len({S.shingles('text', short='none')}) AS word3_none FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", *[F.size(T.shingles(x(), short=s)).cast("long").alias(n) for s, n in (("whole", "word3"), ("tokens", "word3_tokens"), ("none", "word3_none"))])


TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, "it": 0.05}
TARGET_SQL = "tg(category, weight) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TARGETS.items()) + ")"


def targets(t: Tables):
    return t.spark.createDataFrame(list(TARGETS.items()), "category string, weight double")


@query("ag1_distribution", f"WITH {TARGET_SQL}, c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT category, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM documents), 6) AS share, weight AS target, round(coalesce(n, 0) / (SELECT count(*) FROM documents) - weight, 6) AS delta FROM tg LEFT JOIN c ON lang = category")
def _(t: Tables):
    n = t.documents.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    total = t.documents.agg(F.count("*").alias("total"))
    joined = targets(t).join(n, "category", "left").join(F.broadcast(total))  # one row
    c = F.coalesce("n", F.lit(0))
    return joined.select("category", c.alias("n"), F.round(c / F.col("total"), 6).alias("share"), F.col("weight").alias("target"), F.round(c / F.col("total") - F.col("weight"), 6).alias("delta"))


@query("jn11_target_actual", f"WITH {TARGET_SQL}, c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT category, coalesce(n, 0) AS n, n IS NULL AS missing FROM tg LEFT JOIN c ON lang = category")
def _(t: Tables):
    n = t.documents.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    return targets(t).join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("ag9_deviation", f"WITH {TARGET_SQL}, c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), d AS (SELECT category, abs(coalesce(n, 0) / (SELECT count(*) FROM documents) - weight) / weight AS r, n FROM tg LEFT JOIN c ON lang = category) SELECT round(max(r), 6) AS max_relative, round(avg(r), 6) AS mean_relative, count(*) FILTER (WHERE n IS NULL) AS n_missing FROM d")
def _(t: Tables):
    n = t.documents.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    total = t.documents.agg(F.count("*").alias("total"))
    r = F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("weight")) / F.col("weight")
    d = targets(t).join(n, "category", "left").join(F.broadcast(total)).withColumn("r", r)  # one row
    return d.agg(F.round(F.max("r"), 6).alias("max_relative"), F.round(F.avg("r"), 6).alias("mean_relative"), F.count_if(F.col("n").isNull()).alias("n_missing"))


@query("ag2_length_stats", f"SELECT lang, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS mean_chars, round(median(length(text)), 6) AS median_chars, round(avg(len({S.words('text')})), 6) AS mean_words FROM documents GROUP BY lang")
def _(t: Tables):
    n = F.length("text").cast("long")
    return t.documents.groupBy("lang").agg(F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.round(F.median(n), 6).alias("median_chars"), F.round(F.avg(T.n_words(x())), 6).alias("mean_words"))


@query("ag3_quality_summary", "SELECT count(quality) AS evaluated, count(*) FILTER (WHERE quality IS NULL) AS unscored, round(avg(quality), 6) AS mean, min(quality) AS lowest, max(quality) AS highest, count(*) FILTER (WHERE quality >= 0.85) AS at_least_85, count(*) FILTER (WHERE quality >= 0.9) AS at_least_90 FROM documents LEFT JOIN labels USING (doc_id)")
def _(t: Tables):
    q = F.col("quality")
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.agg(F.count(q).alias("evaluated"), F.count_if(q.isNull()).alias("unscored"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("lowest"), F.max(q).alias("highest"), F.count_if(q >= 0.85).alias("at_least_85"), F.count_if(q >= 0.9).alias("at_least_90"))


@query("ag4_provenance", "SELECT lang, source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source, lang) AS place FROM documents GROUP BY lang, source")
def _(t: Tables):
    n = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))  # as many rows as sources and languages
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source", "lang")).cast("long"))


@query("tk1_most_common", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def _(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("ag5_quality_percentiles", "SELECT round(quantile_cont(n_chars, 0.25), 6) AS p25, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents")
def _(t: Tables):
    return t.documents.agg(*[F.round(F.percentile("n_chars", F.lit(p / 100)), 6).alias(f"p{p}") for p in (25, 50, 75, 90, 95)])


TOK = f"tk AS (SELECT doc_id, lang, source, CAST(greatest(len({S.words('text')}), floor(length(text) * 0.25)) AS BIGINT) AS n FROM documents)"


@query("ag6_token_analysis", f"WITH {TOK} SELECT lang, source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS longest, count(*) FILTER (WHERE n > 1024) AS over_1024, count(*) FILTER (WHERE n > 4096) AS over_4096 FROM tk GROUP BY GROUPING SETS ((lang), (source), ())")
def _(t: Tables):
    k = t.documents.select("lang", "source", T.estimate(x()).alias("n"))
    return k.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.count_if(F.col("n") > 1024).alias("over_1024"), F.count_if(F.col("n") > 4096).alias("over_4096"))


@query("ag27_token_lengths", f"WITH {TOK} SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, count(*) FILTER (WHERE n <= 1024) AS up_to_1024, count(*) FILTER (WHERE n <= 2048) AS up_to_2048, round(count(*) FILTER (WHERE n > 2048) / count(*), 6) AS truncation_rate FROM tk")
def _(t: Tables):
    k = t.documents.select(T.estimate(x()).alias("n"))
    n = F.col("n")
    return k.agg(F.round(F.avg(n), 6).alias("mean"), *[F.round(F.percentile(n, F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 90, 95, 99)], F.count_if(n <= 1024).alias("up_to_1024"), F.count_if(n <= 2048).alias("up_to_2048"), F.round(F.count_if(n > 2048) / F.count("*"), 6).alias("truncation_rate"))


@query("ag7_provenance_completeness", "SELECT f AS field, count(*) FILTER (WHERE v IS NULL) AS missing, count(*) AS total FROM (SELECT unnest(['lang', 'source', 'quality', 'toxic']) AS f, unnest([lang, source, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)]) AS v FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY f")
def _(t: Tables):
    names = ["lang", "source", "quality", "toxic"]
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left").select("doc_id", *[F.col(n).cast("string").alias(n) for n in names])
    return rows.unpivot("doc_id", names, "field", "v").groupBy("field").agg(F.count_if(F.col("v").isNull()).alias("missing"), F.count("*").alias("total"))


@query("ag10_diversity", "SELECT lang, count(DISTINCT source) AS n_sources, count(DISTINCT source) FILTER (WHERE source IN ('src0', 'src1', 'src2')) AS n_known FROM documents GROUP BY lang")
def _(t: Tables):
    known = F.when(F.col("source").isin("src0", "src1", "src2"), F.col("source"))
    return t.documents.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct(known).alias("n_known"))


@query("ag11_yield_funnel", f"WITH {HASHED}, s AS (SELECT count(*) AS raw, count(*) FILTER (WHERE length({S.strip('text')}) >= 100) AS clean, count(DISTINCT h) FILTER (WHERE length({S.strip('text')}) >= 100) AS distinct_ FROM h) SELECT raw, clean, distinct_ AS kept, raw - clean AS lost_cleaning, clean - distinct_ AS lost_dedup, round(clean / raw, 6) AS clean_yield, round(distinct_ / raw, 6) AS total_yield FROM s")
def _(t: Tables):
    ok = F.length(T.strip(x())) >= 100
    s = t.documents.select(ok.alias("ok"), bare_hash().alias("h")).agg(F.count("*").alias("raw"), F.count_if("ok").alias("clean"), F.count_distinct(F.when(F.col("ok"), F.col("h"))).alias("kept"))
    r = lambda a, b: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6), F.lit(0.0))
    return s.select("raw", "clean", "kept", (F.col("raw") - F.col("clean")).alias("lost_cleaning"), (F.col("clean") - F.col("kept")).alias("lost_dedup"), r("clean", "raw").alias("clean_yield"), r("kept", "raw").alias("total_yield"))


@query("ag13_split_proportions", f"WITH {SPLIT} SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM sp), 6) AS share, split <> 'train' OR count(*) / (SELECT count(*) FROM sp) BETWEEN 0.75 AND 0.98 AS passes FROM sp GROUP BY split")
def _(t: Tables):
    n = by_hash(t).groupBy("split").agg(F.count("*").alias("n"))  # three rows
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return n.select("split", "n", F.round(share, 6).alias("share"), ((F.col("split") != "train") | share.between(0.75, 0.98)).alias("passes"))


@query("ag12_reconciliation", f"WITH {SPLIT}, {HASHED}, n AS (SELECT (SELECT count(*) FROM documents) AS raw, (SELECT count(DISTINCT h) FROM h) AS kept, (SELECT count(*) FROM sp) AS placed) SELECT raw, kept, raw - kept AS duplicates, placed = raw AS splits_complete, kept <= raw AS dedup_sound FROM n")
def _(t: Tables):
    s = by_hash(t).select("split", bare_hash().alias("h")).agg(F.count("*").alias("raw"), F.count_distinct("h").alias("kept"), F.count("split").alias("placed"))
    return s.select("raw", "kept", (F.col("raw") - F.col("kept")).alias("duplicates"), (F.col("placed") == F.col("raw")).alias("splits_complete"), (F.col("kept") <= F.col("raw")).alias("dedup_sound"))


@query("ag16_diversity_gate", "SELECT count(DISTINCT source) >= 5 AND count(DISTINCT lang) >= 2 AS passes, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs FROM documents")
def _(t: Tables):
    s, n = F.count_distinct("source"), F.count_distinct("lang")
    return t.documents.agg(((s >= 5) & (n >= 2)).alias("passes"), s.alias("n_sources"), n.alias("n_langs"))


@query("ag17_artefacts", f"SELECT count(*) FILTER (WHERE contains(text, '<|im_')) AS markup, count(*) FILTER (WHERE contains(text, '�')) AS broken, count(*) FILTER (WHERE contains(text, '***')) AS starred, CAST(sum({S.count('text', '###')}) AS BIGINT) AS hashes, count(*) FILTER (WHERE length(text) > 65536) AS overlong FROM documents")
def _(t: Tables):
    has = lambda s: F.count_if(x().contains(s))
    return t.documents.agg(has("<|im_").alias("markup"), has("�").alias("broken"), has("***").alias("starred"), F.sum(T.occurrences(x(), "###")).alias("hashes"), F.count_if(F.length("text") > 65536).alias("overlong"))


@query("ag14_dimension_means", "SELECT k AS dimension, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT unnest(['quality', 'toxic', 'length']) AS k, unnest([CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE), least(n_chars / 5000, 1)]) AS v FROM documents JOIN labels USING (doc_id)) GROUP BY k")
def _(t: Tables):
    dims = F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double"), F.lit("length"), F.least(F.col("n_chars") / 5000, F.lit(1.0)))
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(F.explode(dims).alias("dimension", "v"))
    return rows.groupBy("dimension").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


@query("ag15_fidelity", f"SELECT count(*) FILTER (WHERE {S.count('text', '$$')} % 2 <> 0) AS odd_display, count(*) FILTER (WHERE {S.count('text', '(')} <> {S.count('text', ')')}) AS odd_parens, count(*) FILTER (WHERE contains(text, '|')) AS with_pipes, count(*) FILTER (WHERE contains(text, '| --- |')) AS with_separator FROM documents")
def _(t: Tables):
    n = lambda s: T.occurrences(x(), s)
    return t.documents.agg(F.count_if(n("$$") % 2 != 0).alias("odd_display"), F.count_if(n("(") != n(")")).alias("odd_parens"), F.count_if(x().contains("|")).alias("with_pipes"), F.count_if(x().contains("| --- |")).alias("with_separator"))


@query("ag18_ingestion_stats", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (WHERE n_chars >= 1000) AS large, count(*) FILTER (WHERE n_chars < 100) AS small FROM documents GROUP BY source, lang")
def _(t: Tables):
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") >= 1000).alias("large"), F.count_if(F.col("n_chars") < 100).alias("small"))


REASONS = f"CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN {S.count('text', '(')} <> {S.count('text', ')')} THEN 'brackets' END, CASE WHEN contains(text, '***') THEN 'artefact' END"


@query("ag19_reason_histogram", f"SELECT r AS reason, count(*) AS n FROM (SELECT unnest([{REASONS}]) AS r FROM documents) WHERE r IS NOT NULL GROUP BY r")
def _(t: Tables):
    reasons = F.array(F.when(F.length("text") < 100, "short"), F.when(T.occurrences(x(), "(") != T.occurrences(x(), ")"), "brackets"), F.when(x().contains("***"), "artefact"))
    return t.documents.select(F.explode(F.array_compact(reasons)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("ag25_suite_rollup", f"WITH s AS (SELECT item_id, 1.0 - CASE WHEN length(text) < 200 THEN 0.2 ELSE 0 END - CASE WHEN len({S.words('text')}) < 20 THEN 0.2 ELSE 0 END AS score, len({S.words('text')}) // 20 AS level FROM benchmark) SELECT level, count(*) FILTER (WHERE score >= 0.9) AS passed, count(*) FILTER (WHERE score >= 0.75 AND score < 0.9) AS warned, count(*) FILTER (WHERE score < 0.75) AS failed FROM s GROUP BY level")
def _(t: Tables):
    score = F.lit(1.0) - F.when(F.length("text") < 200, 0.2).otherwise(0.0) - F.when(T.n_words(x()) < 20, 0.2).otherwise(0.0)
    s = t.benchmark.select(score.alias("score"), F.floor(T.n_words(x()) / 20).alias("level"))
    c = F.col("score")
    return s.groupBy("level").agg(F.count_if(c >= 0.9).alias("passed"), F.count_if((c >= 0.75) & (c < 0.9)).alias("warned"), F.count_if(c < 0.75).alias("failed"))


@query("ag26_benchmark_stats", f"SELECT count(*) AS n, CAST(sum(ceil(len({S.words('text')}) * 1.3::DOUBLE)) AS BIGINT) AS tokens, min(length(text)) AS shortest, max(length(text)) AS longest FROM benchmark")
def _(t: Tables):
    return t.benchmark.agg(F.count("*").alias("n"), F.sum(T.estimate(x(), "suite")).alias("tokens"), F.min(F.length("text").cast("long")).alias("shortest"), F.max(F.length("text").cast("long")).alias("longest"))


PROFILE = ["doc_id", "text", "lang", "source", "n_chars"]


@query("ag28_profile", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values, count(*) FILTER (WHERE CAST({c} AS VARCHAR) = '') AS empty FROM documents" for c in PROFILE))
def _(t: Tables):
    # Digests go through the explode and the count, not the values.
    fact = lambda v: (F.when(v.isNotNull(), F.xxhash64(v)).alias("v"), F.coalesce(v == "", F.lit(False)).alias("empty"))
    rows = t.documents.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), *fact(F.col(c).cast("string"))) for c in PROFILE])).alias("e")).select("e.*")
    return rows.groupBy("name").agg(F.count_if(F.col("v").isNull()).alias("missing"), F.count_distinct("v").alias("distinct_values"), F.count_if("empty").alias("empty"))


@query("ag29_size_projection", "SELECT n AS records, CAST(round(avg_bytes * n) AS BIGINT) AS bytes FROM (SELECT avg(strlen(text)) AS avg_bytes FROM documents), (VALUES (10000), (25000), (50000), (100000)) v(n)")
def _(t: Tables):
    mean = t.documents.agg(F.avg(F.octet_length("text")).alias("b"))
    return mean.select(F.explode(F.array(*[F.lit(n) for n in (10_000, 25_000, 50_000, 100_000)])).alias("records"), "b").select("records", F.round(F.col("b") * F.col("records")).cast("long").alias("bytes"))


@query("ag30_training_schedule", f"WITH {TOK} SELECT CAST(ceil(count(*) / 16) AS BIGINT) AS steps, CAST(sum(n) * 3 AS BIGINT) AS tokens FROM tk")
def _(t: Tables):
    return t.documents.agg(F.ceil(F.count("*") / 16).alias("steps"), (F.sum(T.estimate(x())) * 3).alias("tokens"))


@query("ag34_template_usage", "SELECT source, count(*) AS requested, count(*) FILTER (WHERE n_chars >= 200) AS generated, count(*) FILTER (WHERE n_chars >= 200 AND coalesce(quality, 1) = 1) AS accepted FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def _(t: Tables):
    j = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    made = F.col("n_chars") >= 200
    return j.groupBy("source").agg(F.count("*").alias("requested"), F.count_if(made).alias("generated"), F.count_if(made & (F.coalesce("quality", F.lit(1)) == 1)).alias("accepted"))


QUOTA = f"{TARGET_SQL}, fl AS (SELECT category, weight, floor(round(weight * 997, 9)) AS f, round(round(weight * 997, 9) - floor(round(weight * 997, 9)), 9) AS rest FROM tg), qt AS (SELECT category, weight, CAST(f + CASE WHEN row_number() OVER (ORDER BY rest DESC, category) <= 997 - (SELECT sum(f) FROM fl) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM fl)"


@query("sp5_quotas", f"WITH {QUOTA}, c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT category, quota, coalesce(n, 0) AS available FROM qt LEFT JOIN c ON lang = category")
def _(t: Tables):
    n = t.documents.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("available"))
    return A.quotas(targets(t), 997).join(n, "category", "left").select("category", "quota", F.coalesce("available", F.lit(0)).alias("available"))


LEVELS = {"easy": 0.25, "expert": 0.10, "hard": 0.25, "medium": 0.40}
LEVEL_SQL = "lv(category, weight) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in LEVELS.items()) + ")"


@query("sp6_quota_matrix", f"WITH {LEVEL_SQL}, c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), x AS (SELECT lang, n, category, floor(round(weight * n, 9)) AS f, round(round(weight * n, 9) - floor(round(weight * n, 9)), 9) AS rest FROM c, lv) SELECT lang, category, CAST(f + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY rest DESC, category) <= n - sum(f) OVER (PARTITION BY lang) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM x")
def _(t: Tables):
    n = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    grid = n.withColumn("lv", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.lit(v).alias("weight")) for k, v in LEVELS.items()]))).select("lang", "n", "lv.category", "lv.weight")
    return A.quotas(grid, F.col("n"), ["lang"]).select("lang", "category", "quota")


@query("gen14_target_grid", f"WITH {TARGET_SQL}, {LEVEL_SQL} SELECT tg.category AS lang, lv.category AS level, round(tg.weight * lv.weight * (SELECT count(*) FROM documents), 6) AS target FROM tg, lv")
def _(t: Tables):
    total = t.documents.agg(F.count("*").alias("n"))
    cells = [(a, b, v * w) for a, v in TARGETS.items() for b, w in LEVELS.items()]
    grid = t.spark.createDataFrame(cells, "lang string, level string, w double")
    return grid.join(F.broadcast(total)).select("lang", "level", F.round(F.col("w") * F.col("n"), 6).alias("target"))  # one row


@query("sp1_ratio_split", "WITH n AS (SELECT count(*) AS n FROM documents) SELECT s AS split, CASE s WHEN 'train' THEN CAST(floor(n * 0.8::DOUBLE) AS BIGINT) WHEN 'validation' THEN CAST(floor(n * 0.1::DOUBLE) AS BIGINT) ELSE CAST(n - floor(n * 0.8::DOUBLE) - floor(n * 0.1::DOUBLE) AS BIGINT) END AS n_docs FROM n, (VALUES ('train'), ('validation'), ('test')) v(s)")
def _(t: Tables):
    return A.ratio_split(t.documents.select("doc_id"), "doc_id", 0.8, 0.1).groupBy("split").agg(F.count("*").alias("n_docs"))


RANKED = "r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


@query("sp2_stratified_split", f"WITH {RANKED}, z AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n < 5 THEN 1 ELSE greatest(1, CAST(round(n * 0.05::DOUBLE) AS INT)) END AS v, CASE WHEN n < 3 THEN 0 WHEN n < 5 THEN 1 ELSE greatest(1, CAST(round(n * 0.05::DOUBLE) AS INT)) END AS s FROM r) SELECT doc_id, CASE WHEN k > n - s THEN 'test' WHEN k > n - s - v THEN 'validation' ELSE 'train' END AS split FROM z")
def _(t: Tables):
    return A.stratified(t.documents.select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "split")


GROUPS = "g AS (SELECT source, count(*) AS size FROM documents GROUP BY source), o AS (SELECT source, sum(size) OVER (ORDER BY md5('42:' || source), source) - size AS start FROM g)"


@query("sp3_source_group_split", f"WITH {GROUPS} SELECT doc_id, CASE WHEN start < 0.9 * (SELECT count(*) FROM documents) THEN 'train' WHEN start < (0.9 + 0.05) * (SELECT count(*) FROM documents) THEN 'validation' ELSE 'test' END AS split FROM documents JOIN o USING (source)")
def _(t: Tables):
    return A.group_split(t.documents.select("doc_id", "source"), "source").select("doc_id", "split")


@query("sp4_source_aware_split", "WITH d AS (SELECT doc_id, source || '::' || lang AS grp FROM documents), g AS (SELECT grp, count(*) AS size FROM d GROUP BY grp), o AS (SELECT grp, sum(size) OVER (ORDER BY md5('42:' || grp), grp) - size AS start FROM g) SELECT doc_id, CASE WHEN start < 0.9 * (SELECT count(*) FROM documents) THEN 'train' WHEN start < (0.9 + 0.05) * (SELECT count(*) FROM documents) THEN 'validation' ELSE 'test' END AS split FROM d JOIN o USING (grp)")
def _(t: Tables):
    return A.group_split(t.documents.select("doc_id", F.concat("source", F.lit("::"), "lang").alias("grp")), "grp").select("doc_id", "split")


@query("sp7_proportional_mix", f"WITH {RANKED}, {QUOTA} SELECT doc_id, lang FROM r JOIN qt ON category = lang WHERE k <= quota")
def _(t: Tables):
    return A.take(t.documents.select("doc_id", "lang"), "doc_id", "lang", A.quotas(targets(t), 997))


@query("sp8_balanced_mix", f"WITH {RANKED}, l AS (SELECT lang, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT lang FROM documents)), q AS (SELECT lang, 101 // m + CASE WHEN i <= 101 % m THEN 1 ELSE 0 END AS quota FROM l) SELECT doc_id, r.lang FROM r JOIN q ON q.lang = r.lang WHERE k <= quota")
def _(t: Tables):
    langs = t.documents.select(F.col("lang").alias("category")).distinct()  # as many rows as languages
    m, i = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.orderBy("category"))
    equal = langs.select("category", (F.floor(F.lit(101) / m) + F.when(i <= F.pmod(F.lit(101), m), 1).otherwise(0)).alias("quota"))
    return A.take(t.documents.select("doc_id", "lang"), "doc_id", "lang", equal)


@query("sp9_release_balance", f"WITH {RANKED}, {QUOTA}, b AS (SELECT category, CAST(round(weight * 100) AS BIGINT) AS quota FROM tg), one AS (SELECT doc_id FROM r JOIN b ON category = lang WHERE k <= quota), rest AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM one) ORDER BY md5('42:' || doc_id), doc_id LIMIT (SELECT greatest(0, 100 - count(*)) FROM one)) SELECT doc_id, 'quota' AS part FROM one UNION ALL SELECT doc_id, 'fill' FROM rest")
def _(t: Tables):
    docs = t.documents.select("doc_id", "lang")
    one = A.take(docs, "doc_id", "lang", targets(t).select("category", F.round(F.col("weight") * 100).cast("long").alias("quota"))).select("doc_id")
    lack = max(0, 100 - one.count())  # the release target is a parameter
    rest = docs.select("doc_id").join(one, "doc_id", "left_anti").orderBy(A.shuffled(F.col("doc_id")), "doc_id").limit(lack)
    return one.withColumn("part", F.lit("quota")).unionByName(rest.withColumn("part", F.lit("fill")))


@query("sp10_batch_plan", f"WITH {QUOTA}, b AS (SELECT category, quota, CAST(ceil(quota * 1.5::DOUBLE) AS BIGINT) AS candidates FROM qt), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT category, i AS batch, least(64, candidates - i * 64) AS size, CAST('0x' || substr(sha256('qwen3:production:seed:42:batch:' || i), 1, 8) AS BIGINT) AS seed FROM b JOIN c ON lang = category, unnest(range(0, CAST(ceil(candidates / 64) AS BIGINT))) u(i)")
def _(t: Tables):
    present = t.documents.groupBy(F.col("lang").alias("category")).count().select("category")
    plan = A.quotas(targets(t), 997).join(present, "category").withColumn("c", F.ceil(F.col("quota") * 1.5))
    rows = plan.select("category", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / 64) - 1)).alias("batch"))
    seed = F.conv(F.substring(F.sha2(F.concat(F.lit("qwen3:production:seed:42:batch:"), F.col("batch").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return rows.select("category", "batch", F.least(F.lit(64), F.col("c") - F.col("batch") * 64).alias("size"), seed.alias("seed"))


@query("sp11_batch_assembly", f"WITH {HASHED}, u AS (SELECT min(doc_id) AS doc_id FROM h GROUP BY h), {QUOTA}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS k FROM u JOIN documents USING (doc_id)), t AS (SELECT lang, count(*) AS n FROM r JOIN qt ON category = lang WHERE k <= quota GROUP BY lang) SELECT category, coalesce(n, 0) AS taken, greatest(0, quota - coalesce(n, 0)) AS deficit FROM qt LEFT JOIN t ON lang = category")
def _(t: Tables):
    docs = t.documents.select("doc_id", "lang", bare_hash().alias("h"))
    kept = docs.groupBy("h").agg(F.min_by(F.struct("doc_id", "lang"), "doc_id").alias("d")).select("d.*")
    goal = A.quotas(targets(t), 997)
    n = A.take(kept, "doc_id", "lang", goal).groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))
    c = F.coalesce("n", F.lit(0))
    return goal.join(n, "category", "left").select("category", c.alias("taken"), F.greatest(F.lit(0), F.col("quota") - c).alias("deficit"))


@query("gen13_oversampling", f"WITH {RANKED}, w AS (SELECT lang, 40 AS need FROM (SELECT DISTINCT lang FROM documents)) SELECT doc_id, lang, c AS copy_index FROM r JOIN w USING (lang), unnest(range(0, CAST(ceil(need / n) AS BIGINT))) u(c) WHERE c * n + k <= need")
def _(t: Tables):
    r = A.ranked(t.documents.select("doc_id", "lang"), "doc_id", "lang").withColumnsRenamed({"_k": "k", "_n": "n"})
    return r.select("doc_id", "lang", "n", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(40) / F.col("n")) - 1)).alias("copy_index")).where("copy_index * n + k <= 40").select("doc_id", "lang", "copy_index")
