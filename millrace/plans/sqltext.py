"""Shared fragments of the oracle SQL."""

WS = r"[\s\x{00A0}\x{0085}\x{2028}\x{2029}\x{3000}]"
REC = "rec AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '{WS}+', ' ', 'g')")


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_\p{{M}}]+')"


def count(x: str, part: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, '{part}', ''))) // {len(part)} AS BIGINT)"


def grams(parts: str, n: int) -> str:
    """Lists of runs of n parts."""
    return f"list_transform(range(1, greatest(len({parts}) - {n - 1}, 0) + 1), lambda i: array_to_string({parts}[i:i + {n - 1}], ' '))"


def shingles(x: str, n: int = 3, short: str = "whole") -> str:
    """Distinct word n-grams; the tokens are bound to a lambda, so they are found once."""
    few = {"whole": "CASE WHEN len(p) > 0 THEN [array_to_string(p, ' ')] ELSE []::VARCHAR[] END", "tokens": "p", "none": "[]::VARCHAR[]"}[short]
    return f"list_transform([{tokens(x)}], lambda p: list_distinct(CASE WHEN len(p) >= {n} THEN {grams('p', n)} ELSE {few} END))[1]"


def sha(x: str) -> str:
    return f"sha256({x})"
