"""URL filter: listed rules first, then association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens that go with a bad label;
rules are pruned by support, a least number of pages, confidence, lift and
significance, and a rule goes when part of its tokens makes a rule that is at least as confident, which judges every URL
the same way. All others stay. They match through an inverted index (token to
rules), joined by token. Everything is DataFrame and SQL functions.

Scale. Mining sees labelled pages only, and support bounds the number of rules.
Matching explodes the tokens of each distinct URL against the index, so only
tokens of rules survive; what returns to the pages is one row per blocked URL,
by a join that adaptive execution may split when one URL holds a third of all
rows.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits
no rule and is allowed; a listed rule beats every mined one; repeated rows are
judged alike, and of equally confident rules the greatest in text order is named;
a URL of any length is read whole; ``page_id`` is read as a label's ``doc_id``;
labels that are null or lack a page are skipped; without labelled
pages nothing is mined; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Listed rules: verdict and ``host/path``.
LISTED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BAD = "label=bad"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
#: Labelled pages that a rule is seen on at least, and standard errors by which its confidence passes the share of bad pages.
MIN_PAGES = 10
MIN_ERRORS = 4.0
#: Items in more than this share of the labelled pages say nothing and multiply the item sets.
MAX_SHARE = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path parts and endings, query keys, a fragment. Numbers are left out."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, "://[^/?#]*[^?#]*(.*)", 1)
    query = F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&")
    path = F.lower(path_of(url))
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, "^([^:/?#]*)://", 1))),
        F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host="), x)),
        F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"\.[a-z0-9]{1,5}$", ""))),
        F.array(F.concat(F.lit("ending="), F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1))),
        F.transform(query, lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^([^=]*)", 1))),
        F.array(F.when(F.instr(url, "#") > 0, F.lit("fragment=yes")).otherwise(F.lit("fragment="))),
    )
    return F.array_distinct(F.filter(parts, lambda x: ~x.rlike(r"=\d*$")))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_pages: int = MIN_PAGES, min_errors: float = MIN_ERRORS) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) whose tokens point to a bad label.

    A rule's confidence lies above the share of bad pages by ``min_errors``
    standard errors of that share among as many pages as the rule is seen on.
    """
    bad = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("_bad"))
    seen = pages.select(F.col("page_id").alias("doc_id"), url_tokens(F.col("url")).alias("tokens")).where("size(tokens) > 0").join(bad, "doc_id")
    baskets = seen.select(F.when(F.col("_bad") == 1, F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    n = baskets.count()
    common = baskets.select(F.explode("items").alias("item")).groupBy("item").count().where((F.col("count") > MAX_SHARE * n) & (F.col("item") != BAD))
    # Shares add up to the mean number of items of a page, so fewer than that over MAX_SHARE can be above it.
    drop = [r["item"] for r in common.select("item").collect()]
    kept = baskets.select(F.array_except("items", F.array(*[F.lit(x) for x in drop]).cast("array<string>")).alias("items")).where("size(items) > 0")
    least = min(1.0, max(min_support, min_pages / max(n, 1)))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(kept)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    share = F.col("confidence") / F.col("lift")  # of bad pages
    seen_on = F.col("support") * n / F.col("confidence")
    good = found.where((F.col("confidence") - share) * F.sqrt(seen_on) >= F.lit(min_errors) * F.sqrt(share * (1 - share)))
    rules = good.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rules = rules.withColumn("rule_id", F.sha2(F.array_join("tokens", "\n"), 256))
    return without_redundant(rules).select("rule_id", "tokens", "confidence", "support")


def without_redundant(rules: DataFrame) -> DataFrame:
    """Rules of which no smaller part is a rule of at least their confidence."""
    part = rules.select(F.col("rule_id").alias("part_id"), F.size("tokens").alias("part_size"), F.col("confidence").alias("part_confidence"), F.explode("tokens").alias("token"))
    whole = rules.select("rule_id", F.size("tokens").alias("n"), "confidence", F.explode("tokens").alias("token"))
    met = whole.join(part, "token").where("part_size < n and part_confidence >= confidence").groupBy("rule_id", "part_id", "part_size").agg(F.count("*").alias("shared"))
    return rules.join(met.where("shared = part_size").select("rule_id").distinct(), "rule_id", "left_anti")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct URLs that hold all tokens of a rule: url, mined_rule (the most confident), mined_confidence."""
    index = rules.select("rule_id", "confidence", "tokens", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    urls = pages.select("url").where("url is not null").distinct()
    hits = urls.select("url", F.explode(url_tokens(F.col("url"))).alias("token")).join(index, "token")
    whole = hits.groupBy("url", "rule_id", "need", "confidence", "tokens").agg(F.size(F.collect_set("token")).alias("found")).where("found = need")
    best = F.max(F.struct("confidence", F.array_join("tokens", " ").alias("rule")))
    return whole.groupBy("url").agg(best.alias("best")).select("url", F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def judge(pages: DataFrame, labels: DataFrame, listed=LISTED) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the mined rule with its confidence."""
    mined = matched(pages, mine(pages, labels))
    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = parsed.withColumn("_listed", listed_rule(F.col("host"), F.col("path"), listed)).join(mined, "url", "left")
    verdict = F.coalesce(F.col("_listed.verdict"), F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", F.col("_listed.rule").alias("rule"), verdict.alias("verdict"), "mined_rule", "mined_confidence")
