import re

from millrace.llm import decontam as D

ITEM = "A train leaves Berlin at 9 with 120 passengers and travels 300 km in 2 hours before Anna boards it again at noon"
OTHER = ITEM.replace("Berlin", "Madrid").replace("120", "75").replace("Anna", "Luis")
TWISTED = "we know that Tom has 5 apples and Tom gives 5 apples away today to nobody"
FREE = "the quick brown fox jumps over the lazy dog while nobody at all is looking at it"


def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, TWISTED), (3, None), (3, "")], "item_id long, text string")


def found(spark, docs, **how):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    return sorted({(r.doc_id, r.item_id, r.verbatim) for r in D.meetings(df, bench(spark), **how).groupBy("doc_id", "item_id").agg({"verbatim": "max"}).toDF("doc_id", "item_id", "verbatim").collect()}), df


DOCS = [(1, f"{FREE}. {ITEM}. {FREE}"), (2, f"{FREE}. {OTHER}"), (3, FREE), (4, None), (5, ""), (6, TWISTED.replace("gives 5", "gives 6")), (7, TWISTED.replace("5", "8").replace("Tom", "Eva")), (8, FREE + " 1 2 3 4 5 6 7 8 9 10")]


def test_copies_and_exchanged_values(spark):
    want = [(1, 1, True), (2, 1, True), (7, 2, False)]
    got, df = found(spark, DOCS)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert dict((g[0], g[2]) for g in got)[1] and not dict((g[0], g[2]) for g in got)[7]
    again, _ = found(spark, DOCS, most=0)
    assert again == got  # the shuffled way
    rows = {r.doc_id: r for r in D.contaminated(df, bench(spark)).collect()}
    assert rows[1].coverage == 1.0 and rows[2].reparameterised and rows[7].reparameterised and not rows[1].reparameterised


def test_clean_keeps_the_rest_and_columns(spark):
    _, df = found(spark, DOCS)
    for most in (D.MAX_BROADCAST_WINDOWS, 0):
        out = D.clean(df, bench(spark), most=most)
        assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 6, 8]


def test_agreement():
    a = [(1, "x"), (2, "5"), (1, "x")]
    assert D.agree(a, [(1, "q"), (2, "6"), (1, "q")]) and not D.agree(a, [(1, "q"), (2, "6"), (1, "r")]) and not D.agree(a, [(2, "q"), (2, "6"), (1, "q")])


def test_empty_sides(spark):
    _, df = found(spark, DOCS)
    assert D.contaminated(df.where("false"), bench(spark)).count() == 0
    assert D.contaminated(df, bench(spark).where("false")).count() == 0


def pairs_found(spark, docs, items, most):
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    kept = {r.doc_id for r in D.clean(df, bench, most=most).collect()}
    got = {(r.doc_id, r.item_id) for r in D.meetings(df, bench, most=most).collect()}
    assert kept == {i for i, _ in docs} - {d for d, _ in got}
    return got


def test_short_items_and_items_with_few_literals(spark):
    dense = "Add 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg 9 kg now"
    items = [(1, "What is 15 % of 240?"), (2, "a short item of seven words indeed"), (3, dense)]
    docs = [(1, f"{FREE}. What is 15 % of 240? {FREE}"), (2, f"{FREE} A short item of seven words, indeed {FREE}"), (3, f"{FREE}. {dense}. {FREE}"), (4, f"{FREE}. What is 16 % of 240? {dense.replace('6', '66')}")]
    docs += [(5, f"{FREE}. What is 15 plus 40 minus 8 ? {FREE}"), (6, f"{FREE}. What is 15 plus 40 minus 15 ? {FREE}"), (7, f"{FREE}. Add 9 {FREE}")]
    items += [(4, "What is 12 plus 34 minus 5 ?"), (5, "Add 3")]
    for most in (D.MAX_BROADCAST_WINDOWS, 0):
        assert pairs_found(spark, docs, items, most) == {(1, 1), (2, 2), (3, 3), (4, 1), (5, 4), (3, 5), (4, 5)}  # "Add 3" stands there as it is


def test_verbatim_windows_count_whatever_the_rest_does(spark):
    item = f"On the first day Berlin sent 40 men. {FREE}. On the last day Berlin sent 40 men over the long road to the sea"
    twisted = item[::-1].replace("04", "05", 1)[::-1]
    loud = "ALL CAPITALS STAND HERE AND SAY NOTHING WHATEVER. " * 20
    named = "we met Anna and then Luis went with Carla to see the old town of Bremen"
    docs = [(1, f"Well. {twisted}"), (2, f"{loud}\n{named}\n{loud}"), (3, f"{loud}\n{named.replace('Anna', 'Maria')}\n{loud}"), (4, loud)]
    for most in (D.MAX_BROADCAST_WINDOWS, 0):
        assert pairs_found(spark, docs, [(1, item), (2, named)], most) == {(1, 1), (2, 2), (3, 2)}


def template(text):
    """(word, kind, capital) of each token but sentence stops, token by token."""
    raw = re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n%$€£°]", text or "")
    number = lambda i: 0 <= i < len(raw) and raw[i][0].isdigit()
    out = []
    for i, t in enumerate(raw):
        if t in ".!?\n":
            continue
        kind = ""
        if t[0].isupper() and i and raw[i - 1] not in ".!?\n":
            kind = "name"
        if number(i):
            kind = "number"
        elif t.lower() in D.UNITS and (number(i - 1) or number(i + 1)):
            kind = "unit"
        out.append((t.lower(), kind, t[0].isupper(), not number(i)))
    return out


def windows(text, width, whole=False):
    tokens = template(text)
    width = min(width, len(tokens)) if whole else width
    for at in range(len(tokens) - width + 1 if width else 0):
        part = tokens[at : at + width]
        loud = sum(w for *_, w in part) < 2 * sum(c for _, _, c, _ in part)
        kinds = ["" if loud and k == "name" else k for _, k, _, _ in part]
        yield at, width, tuple(k and f"<{k}>" or t for (t, *_), k in zip(part, kinds, strict=True)), tuple(t for t, *_ in part), [(k, t.replace(",", "")) for (t, *_), k in zip(part, kinds, strict=True) if k], kinds.count("") >= (6 if width >= 10 else max(2, (width + 1) // 2))


def brute(docs, items):
    """(doc, item) pairs by comparing every window of every document with every window of every item."""
    by_word, by_form, widths, out = {}, {}, set(), set()
    for item, text in items:
        for at, width, form, literal, slots, enough in windows(text, 10, whole=True):
            widths.add(width)
            by_word.setdefault(literal, []).append((item, at, slots, literal))
            if enough and form != literal:
                by_form.setdefault(form, []).append((item, at, slots, literal))
    for doc, text in docs:
        copies = {}
        for width in widths:
            for at, _, form, literal, slots, enough in windows(text, width):
                met = [(i, a, s, s, True) for i, a, s, _ in by_word.get(literal, [])]
                met += [(i, a, s, slots, s == slots) for i, a, s, x in by_form.get(form, []) if x != literal] if enough and form != literal else []
                for item, there, theirs, mine, same in met:
                    copies.setdefault((item, width, at - there), []).append((at, theirs, mine, same))
        fine = lambda hits: len({*zip(sum((h[1] for h in hits), []), sum((h[2] for h in hits), []))}) == len({*sum((h[1] for h in hits), [])}) == len({*sum((h[2] for h in hits), [])})
        for (item, *_), hits in copies.items():
            hits.sort(key=lambda h: h[0])
            stretches = []
            for h in hits:
                if stretches and stretches[-1][0][3] == h[3]:
                    stretches[-1].append(h)
                else:
                    stretches.append([h])
            if fine(hits) or any(s[-1][0] > s[0][0] if s[0][3] else fine(s) for s in stretches):
                out.add((doc, item))
    return out


def test_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = D.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    df = spark.createDataFrame([(1, ITEM, 0), (1, FREE, 1), (None, ITEM, 2), (None, None, 3), (1, ITEM, 4)], "doc_id long, text string, _low int")
    for most in (D.MAX_BROADCAST_WINDOWS, 0):
        assert sorted(r["_low"] for r in D.clean(df, bench(spark), most=most).collect()) == [1, 3]
        assert sorted((r.doc_id or 0) for r in D.meetings(df, bench(spark), most=most).select("doc_id").distinct().collect()) == [0, 1]


def test_long_text(spark):
    docs = [(1, " ".join(f"w{i} 7" for i in range(400_000)) + f". {ITEM}. " + "x" * 100_000), (2, "a " * 700_000)]
    for most in (D.MAX_BROADCAST_WINDOWS, 0)[:1]:
        assert pairs_found(spark, docs, [(1, ITEM)], most) == {(1, 1)}
