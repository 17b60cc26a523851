"""Facts about code points as arrays, for numpy over whole texts."""

from __future__ import annotations

import re

import numpy as np

#: Classes: letters (word signs but digits and the underscore), digits, and signs that stand alone.
LETTER, DIGIT, SIGN = 1, 2, 3
#: Flags.
CAPITAL, FIGURE, STOP = 1, 2, 4
STOPS = ".!?\n"
SIGNS = ".!?\n%$€£°"
_PAGE = 12
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD, _FIGURE = re.compile(r"[^\W\d_]"), re.compile(r"\d")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Characters:
    """Class, capital, digit and lower-case value of code points, made page by page."""

    def __init__(self):
        self.kind, self.flag, self.value = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint64)
        self.made: set[int] = set()

    def need(self, codes: np.ndarray) -> None:
        for page in set(np.flatnonzero(np.bincount(codes >> _PAGE)).tolist()) - self.made:
            signs = [chr(c) for c in range(page << _PAGE, (page + 1) << _PAGE)]
            span = slice(page << _PAGE, (page + 1) << _PAGE)
            self.kind[span] = [LETTER if _WORD.match(c) else DIGIT if _FIGURE.match(c) else SIGN if c in SIGNS else 0 for c in signs]
            self.flag[span] = [CAPITAL * c.isupper() | FIGURE * c.isdigit() | STOP * (c in STOPS) for c in signs]
            self.value[span] = mixed(np.array([ord(c.lower()[0]) + 1 for c in signs], np.uint64) * _MIX)
            self.made.add(page)
