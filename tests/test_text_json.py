"""Redaction of JSON payloads at any depth, against a walk over parsed values."""

import json
import random
import time

from millrace.functions import text as T


def walk(value):
    if isinstance(value, dict):
        return {k: T.HIDDEN if any(p in k.lower() for p in T.HIDDEN_KEYS.split("|")) else walk(v) for k, v in value.items()}
    return [walk(v) for v in value] if isinstance(value, list) else value


def made(rng, depth=0):
    kind = rng.randrange(6 if depth < 5 else 4)
    if kind < 4:
        return [rng.randrange(100), "te\"xt: {,}]", None, True][kind]
    if kind == 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    keys = ["a", "Auth", "my_token", "user", "passWORD", "c\\ookie", "cookie\"s", "x:y"]
    return {rng.choice(keys): made(rng, depth + 1) for _ in range(rng.randrange(5))}


def test_hidden_values_match_a_walk():
    rng = random.Random(1)
    for _ in range(3000):
        value = made(rng)
        for text in (json.dumps(value), json.dumps(value, indent=1), json.dumps(value, separators=(",", ":"))):
            assert json.loads(T.hide(text)) == walk(value), text


def test_texts_without_secrets_stay_and_odd_ones_pass():
    for text in ("", "{}", '{"a" : 1 ,\n"b":[1, 2]}', "no json at all", '{"a', '"', '{"token"', '{"token":', '{"token":}', "null", '["token", "auth"]'):
        assert T.hide(text) == text
    assert T.hide(None) is None
    assert T.hide('{"token": tr ue}').startswith('{"token": "[REDACTED]"')


def test_depth_and_length():
    began = time.time()
    deep = '{"a":' * 200_000 + '{"auth":' + "[" * 200_000 + "]" * 200_000 + "}" + "}" * 200_000
    assert T.hide(deep) == '{"a":' * 200_000 + '{"auth":"[REDACTED]"}' + "}" * 200_000
    for hostile in ('"' * 500_001, "\\" * 500_000, '{"auth":' * 100_000, " " * 1_000_000, ":" * 500_000):
        T.hide(hostile)
    assert time.time() - began < 30


def test_column(spark):
    df = spark.createDataFrame([('{"k": {"secret": {"a": {"b": 1}}}}',), (None,)], "j string")
    assert {r.j for r in df.select(T.redact_json("j").alias("j")).collect()} == {'{"k": {"secret": "[REDACTED]"}}', None}
