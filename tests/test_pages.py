"""Web pages against trees of which every answer is known, and odd markup."""

import html
import random
import time

from millrace.sources import pages as P

SAMPLE = """
<!DOCTYPE html><html><head><title>General Relativity</title><meta name="author" content="A. One"><meta name="citation_author" content=" B. Two ">
<meta property="og:title" content="Other"><meta name="Description" content="first"><meta property="og:description" content="last"><meta name="citation_pdf_url" content="x.pdf">
<link rel="canonical" href=" https://a.example/b "></head><body>
<nav><a href="/home">Home</a><p>Menu</p></nav><header><h1>Banner</h1></header><script>alert("<p>no</p>");</script><style>p{}</style><!-- <p>gone</p> -->
<h1>1. Curvature</h1><p>Spacetime tells matter &amp; light how to move.</p><h2> </h2><h2>1.1 Field equations</h2><p>Energy <math alttext="E"><annotation encoding="application/x-tex"> E = h </annotation></math>.</p>
<table><caption>Constants</caption><tr><th>Name</th><th>Value</th></tr><tr><td>c</td><td>299792458</td></tr><tr><td>G</td><td>6.674e-11</td></tr></table>
<h3>Empty</h3><footer>Copyright</footer></body></html>"""


def test_sample_page():
    page = P.read_page(SAMPLE)
    assert (page["title"], page["authors"], page["abstract"], page["canonical_url"]) == ("General Relativity", ["A. One", "B. Two"], "last", "https://a.example/b")
    assert page["extra"] == [("citation_pdf_url", "x.pdf")] and page["status"] == "SUCCESS" and page["n_tables"] == 1
    one, two = page["sections"]
    assert (one["number"], one["title"], one["paragraphs"]) == (1, "1. Curvature", ["Spacetime tells matter & light how to move."])
    assert (two["number"], two["title"], two["paragraphs"]) == (2, "1.1 Field equations", ["Energy  $E = h$ ."])
    assert two["tables"] == [{"number": 1, "caption": "Constants", "headers": ["Name", "Value"], "rows": [["c", "299792458"], ["G", "6.674e-11"]], "markdown": "| Name | Value |\n| --- | --- |\n| c | 299792458 |\n| G | 6.674e-11 |"}]
    assert page["n_chars"] == sum(len(P.section_text(s)) for s in page["sections"])


def test_pages_without_content():
    for empty in (None, "", "   ", "plain text", "<div>only a div</div>", "<nav><p>x</p></nav>", "<!-- <p>x</p>", "<title>t</title>", "<p> </p><h1>h</h1>"):
        page = P.read_page(empty)
        assert page["sections"] == [] and page["n_chars"] == 0 and page["status"] == "FAILED"


def blocks_of(text):
    return [p for s in P.read_page(text)["sections"] for p in s["paragraphs"]]


def test_missing_end_tags():
    assert blocks_of("<p>a<p>b<div>c</div>d<p>e</body>") == ["a", "b", "e"]
    assert blocks_of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e") == ["abcd", "c", "e"]
    assert blocks_of("<p>a<b>b</p>c</b><p>d</p></p></div>") == ["ab", "d"]
    assert blocks_of("<p>a<br>b<hr>c") == ["ab"]
    table = P.read_page("<table><caption>x<tr><th>a<th>b<tr><td>1<td>2<tbody><tr><td>3</table><p>after")["sections"][0]["tables"][0]
    assert (table["caption"], table["headers"], table["rows"]) == ("x", ["a", "b"], [["1", "2"], ["3"]])
    assert blocks_of("<blockquote><p>a<table><tr><td>b</p>c</table>d</blockquote>")[0] == "abcd"
    assert blocks_of("<h1>t<p>a") == ["a"] and P.read_page("<h1>a<h2>b</h2><p>c")["sections"][0]["title"] == "b"
    assert blocks_of("<p>a &lt;b&gt; &nbsp;&#65;&unknown; < 5 <</p>")[0].startswith("a <b> \xa0A&unknown; < 5 <")
    assert blocks_of('<p title="a>b" class=\'x\'>q</p >') == ["q"]


def test_nested_tables_and_blocks():
    page = P.read_page("<table><tr><td>a<table><tr><th>h</th><td>b</td></tr></table></td><td>c</td></tr></table>")
    outer, inner = page["sections"][0]["tables"]
    assert outer["rows"] == [["ahb", "b", "c"], ["b"]] and outer["headers"] == ["h"]
    assert inner["rows"] == [["b"]] and inner["headers"] == ["h"] and (outer["number"], inner["number"]) == (1, 2)
    assert blocks_of("<blockquote>x<p>y</p>z</blockquote>") == ["xyz", "y"]


def test_formulas():
    assert blocks_of("<p>a<math alttext=' x '><mi>y</mi></math>b</p>") == ["a $x$ b"]
    assert blocks_of("<p><math><mi> y </mi><p>lost</p></math></p>")[0].startswith("$y")
    katex = "<span class='katex-display'><span class='katex'><math><mi>m</mi><annotation encoding='application/x-tex'>q^2</annotation></math><span class='katex-html' aria-label='L'>shown</span></span></span>"
    assert blocks_of(f"<p>a{katex}b</p>") == ["a $L$ b"]
    assert blocks_of("<p>a<span class='MathJax'><annotation>t</annotation>s</span></p>") == ["a $t$"]
    assert blocks_of("<p>a<span class='mathematics'>plain</span></p>") == ["aplain"]
    assert blocks_of("<p>a<span class='other'><i aria-label='L'>s</i></span></p>") == ["as"]


def test_depth_and_size():
    deep = "<blockquote>" * 5000 + "x" + "</blockquote>" * 5000 + "<p>after</p>"
    found = blocks_of(deep)
    assert len(found) == P.DEPTH + 1 and found[-1] == "after"
    began = time.time()
    assert blocks_of("<p>" + "word " * 2_000_000 + "<p>b" * 50_000)[-1] == "b"  # 10 MB
    for hostile in ("<!--", "<p title='", "<", "</", "</p", "<p", "<p a", "<![CDATA[", "&", "<table><tr>", "<title>", "<script>", "<p a='>'", "<b>", "<math>", "<span class=katex>"):
        P.read_page(hostile * (500_000 // len(hostile)))
    assert time.time() - began < 60


def random_tree(rng, depth=0):
    """Content as a list of strings and (tag, content)."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(["text", "text", "p", "ul", "blockquote", "div", "h2", "nav", "pre", "table", "b"]) if depth < 4 else "text"
        if tag == "text":
            out.append(rng.choice(["alpha", "a & b", "<tag>", "é", " "]))
        elif tag in ("p", "h2", "b", "pre"):
            out.append((tag, [rng.choice(["x", "y < z", " "]), ("i", [rng.choice("pq")])]))
        elif tag == "ul":
            out.append((tag, [("li", random_tree(rng, depth + 1)) for _ in range(2)]))
        elif tag == "table":
            row = lambda cell: ("tr", [(cell, random_tree(rng, depth + 2)) for _ in range(2)])
            out.append((tag, [("caption", ["cap"]), row("th"), row("td"), row("td")]))
        else:
            out.append((tag, random_tree(rng, depth + 1)))
    return out


def markup(tree):
    return "".join(html.escape(n, quote=False) if isinstance(n, str) else f"<{n[0]}>{markup(n[1])}</{n[0]}>" for n in tree)


def text_of(tree):
    return "".join(n if isinstance(n, str) else "" if n[0] == "nav" else text_of(n[1]) for n in tree)


def descend(tree, tags):
    for n in tree:
        if not isinstance(n, str) and n[0] != "nav":
            if n[0] in tags:
                yield n
            yield from descend(n[1], tags)


def test_random_trees():
    rng = random.Random(8)
    for _ in range(400):
        tree = random_tree(rng)
        want, current, number = [], None, 0
        for tag, inner in descend(tree, ("h2", "p", "ul", "pre", "blockquote", "table")):
            text = text_of(inner).strip()
            if tag == "h2":
                if text:
                    number += 1
                    current = (number, text, [], [])
                    want.append(current)
                continue
            if tag != "table" and not text:
                continue
            if current is None:
                number += 1
                current = (number, "Content" if tag == "table" else "Introduction", [], [])
                want.append(current)
            if tag == "table":
                rows = [[text_of(c[1]).strip() for c in descend(r[1], ("td",))] for r in descend(inner, ("tr",))]
                current[3].append(([text_of(h[1]).strip() for h in descend(inner, ("th",))], [r for r in rows if r]))
            else:
                current[2].append(text)
        got = [(s["number"], s["title"], s["paragraphs"], [(t["headers"], t["rows"]) for t in s["tables"]]) for s in P.read_page(markup(tree))["sections"]]
        assert got == [w for w in want if w[2] or w[3]], markup(tree)


def test_rows_of_pages(spark):
    rows = [(1, SAMPLE), (None, "<p>x"), (3, None), (1, SAMPLE)] + [(k, "<h1>t</h1><p>" + "w " * 2000) for k in range(50)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    found = P.parsed(df, chars=20_000)
    assert found.count() == 54 and found.where("page.status = 'FAILED'").count() == 1
    assert P.sections(found).count() == 2 + 1 + 2 + 50
    assert {tuple(r.headers) for r in P.tables(found).collect()} == {("Name", "Value")}
    assert P.parsed(df.where("false")).count() == 0
