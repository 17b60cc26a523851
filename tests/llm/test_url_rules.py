import random
from itertools import combinations

from pyspark.sql import functions as F

from millrace.llm import url_rules as U


def judge_one(url):
    """Host, path and listed rule by plain string handling."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for _, r in U.LISTED if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


URLS = [None, "", "nothing", "http://EXAMPLE.com/en/1", "https://www.example.com/en/", "https://a.www.example.com/en/x?y#z", "http://x.net/es/", "http://net/fr/a", "http://xnet/fr/a", "http://b.com", "http://b.com?x=1", "http://b.com/", "://h.net/es/", "http://É.com/en/", "http://a.org/u?r=http://b.com/", "http://notexample.com/en/", "http://a.net/es/\nb"]


def test_hosts_paths_and_listed_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    out = df.select("page_id", "url", U.host_of(F.col("url")).alias("h"), U.path_of(F.col("url")).alias("p")).withColumn("l", U.listed_rule(F.col("h"), F.col("p")))
    for r in out.collect():
        assert (r.h, r.p, r.l.rule if r.l else None) == judge_one(r.url), r.url


def test_mined_rules_match_brute_force(spark):
    urls = [f"http://{'spam' if i % 3 == 0 else 'ok'}{'' if i % 2 else '.sub'}.org/{'buy' if i % 5 < 2 else 'read'}/{i}" for i in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if "spam" in u and "buy" in u else 1, None) for i, u in enumerate(urls) if i % 4], "doc_id long, quality int, toxic int")
    rules = {tuple(r.tokens): (round(r.confidence, 9), round(r.support, 9)) for r in U.mine(pages, labels, 0.05, 0.5, 1.5, 1, 2.0).collect()}
    rows = [(set(t), "spam" in u and "buy" in u) for i, (u, t) in enumerate((r.url, r.t) for r in pages.select("url", U.url_tokens(F.col("url")).alias("t")).collect()) if i % 4]
    base = sum(b for _, b in rows) / len(rows)
    tokens = {t for s, _ in rows for t in s if sum(t in x for x, _ in rows) <= U.MAX_SHARE * len(rows)}
    want = {}
    for k in range(1, 6):
        for c in combinations(sorted(tokens), k):
            has = [b for s, b in rows if s.issuperset(c)]
            if has and sum(has) / len(rows) >= 0.05 and sum(has) / len(has) >= 0.5 and sum(has) / len(has) / base >= 1.5 and (sum(has) / len(has) - base) * len(has) ** 0.5 >= 2 * (base * (1 - base)) ** 0.5:
                want[c] = (round(sum(has) / len(has), 9), round(sum(has) / len(rows), 9))
    assert rules == want and want
    got = {r.url for r in U.matched(pages, U.mine(pages, labels, 0.05, 0.5, 1.5, 1, 2.0)).collect()}
    by_url = {r.url: set(r.t) for r in pages.select("url", U.url_tokens(F.col("url")).alias("t")).collect()}
    assert got == {u for u, s in by_url.items() if any(s.issuperset(c) for c in want)}


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.net/fr/1", "a"), (1, "http://x.net/fr/1", "a"), (None, None, "b"), (3, "zzz", "c")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(None, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, labels).collect())
    assert got == [(0, "", "", None, "allow"), (1, "x.net", "/fr/1", "net/fr/", "block"), (1, "x.net", "/fr/1", "net/fr/", "block"), (3, "", "", None, "allow")]
    assert U.judge(pages.where("false"), labels).count() == 0


def test_redundant_rules_go_and_all_others_stay(spark):
    rows = [("a", ["x"], 0.8), ("b", ["x", "y"], 0.8), ("c", ["x", "z"], 0.9), ("d", ["y", "z"], 0.7), ("e", ["w", "x", "z"], 0.95)] + [(f"r{i}", [f"t{i}"], 0.6) for i in range(1_500)]
    rules = spark.createDataFrame(rows, "rule_id string, tokens array<string>, confidence double").withColumn("support", F.lit(0.1))
    kept = {r.rule_id for r in U.without_redundant(rules).collect()}
    assert kept == {"a", "c", "d", "e"} | {f"r{i}" for i in range(1_500)}
    pages = spark.createDataFrame([(1, "http://t7.org/" + "q" * 100_000), (2, None)], "page_id long, url string")
    index = spark.createDataFrame([("k", ["host=t7"], 0.9), ("l", ["host=org"], 0.9)], "rule_id string, tokens array<string>, confidence double")
    assert [(r.mined_rule, len(r.url) > 100_000) for r in U.matched(pages, index).collect()] == [("host=t7", True)]


def test_rules_hold_on_pages_they_were_not_mined_from(spark):
    """Two thirds teach, a third judges: rules find what they stand for, and none come from labels that say nothing of the URL."""
    urls = [f"http://{'spam' if i % 7 == 0 else 'ok'}{i % 11}.org/{'buy' if i % 5 < 2 else 'read'}/{i}" for i in range(1500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    drawn = random.Random(5)
    telling = [(i, int(drawn.random() < (0.1 if i % 5 < 2 else 0.9)), None) for i in range(1500)]
    blind = [(i, int(drawn.random() < 0.7), None) for i in range(1500)]
    teach = lambda rows: spark.createDataFrame([r for r in rows if r[0] % 3], "doc_id long, quality int, toxic int")
    held = pages.where("page_id % 3 = 0")
    hit = {r.url for r in U.matched(held, U.mine(pages, teach(telling))).collect()}
    judged = [(quality == 0, urls[i] in hit) for i, quality, _ in telling if i % 3 == 0]
    precision = sum(bad for bad, said in judged if said) / sum(said for _, said in judged)
    assert precision >= 0.85 and sum(said for bad, said in judged if bad) / sum(bad for bad, _ in judged) >= 0.8
    assert U.mine(pages, teach(blind)).count() == 0
