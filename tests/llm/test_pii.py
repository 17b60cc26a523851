import hashlib
import random
import re

from millrace.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    """The four base kinds by the plain patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    confirmed = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 10 <= len(digits(s)) <= 15,
    }
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in p.finditer(text) if confirmed[k](m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def base_of(text):
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in pii.find_spans(text) if x.kind in BASE)


def test_random_texts_match_plain_patterns():
    rng = random.Random(5)
    parts = ["a@b.co", "@", ".", "-", " ", "+1", "_x", "12", "4111 1111 1111 1111", "10.0.0.256", "1.2.3.4", "(988) 555-2485", "é", "+", "x@y", "%", "000"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert base_of(text) == brute(text), text


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    kinds = lambda t: [x.kind for x in pii.find_spans(t)]
    assert kinds("pay GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("call 030 555 1234") == ["tel"] and kinds("room 030 555 1234") == []
    near, far = pii.find_spans("mail a@b.co")[0], pii.find_spans("x a@b.co")[0]
    assert near.score > far.score


def test_hostile_texts_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 100_000, "0" * 6000 + ".1.2.3"):
        pii.find_spans(text)


def test_query_on_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", None), (3, "q 10.1.2.3 " * 3, "x"), (3, "q 10.1.2.3 " * 3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.spans) for r in pii.digest(df).collect()}
    assert got == {(1, 0, 0, ""), (2, 0, 0, ""), (None, 1, 0, "email:0:6"), (3, 0, 3, "ip:2:10,ip:13:21,ip:24:32")}
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in pii.digest(df.where("doc_id < 3")).collect()} == {empty}
    assert pii.digest(df.where("false")).count() == 0


def test_redaction_keeps_the_rest():
    text = "mail a@b.co or 10.0.0.1."
    assert pii.redact(text, pii.find_spans(text)) == "mail [EMAIL] or [IP]."
    assert pii.redact(None, []) is None


def test_masked_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co", "en", "s", 6), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = pii.masked(df)
    assert out.columns == df.columns
    assert {tuple(r) for r in out.collect()} == {(1, "[EMAIL]", "en", "s", 7), (2, None, "en", "s", 0)}
