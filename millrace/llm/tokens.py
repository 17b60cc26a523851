"""Token ids of whole texts, computed inside the executors.

The public ``tokenizers`` library does the encoding. Its word-level BPE drops
white space and never merges across the pieces its own pattern cuts, so the ids
of a text are the ids of its pieces in order; each distinct piece is encoded
once per task and remembered in a bounded cache. Pieces are only cut here in
text made of characters whose class is beyond doubt; every other blank-free run
goes to the library as it stands. A vocabulary file whose library output differs
from that on ``PROBES`` gets every text whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Id that ends each document.
END_ID = 2
#: Pieces that a worker remembers before it starts again from the last batch.
CACHE_PIECES = 400_000
PIECES_PER_CALL = 4_000

# The letters and digits of Latin-1, and the cutting pattern of the vocabulary file.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_DIGIT = "0-9²³¹¼-¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^ \t\n\r{_LETTER}{_DIGIT}]+")
_DOUBTFUL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff–—‘’“”…€]|<\|")
_BLANK = re.compile(r"[ \t\n\r]+")

#: Texts on which cut pieces must give the ids of the whole, or nothing is cut.
PROBES = (
    "It's the 1st of May, 2024: we'll pay 3,141.59 (or more) -- don't you THINK so?!\nYes;\tno...  x_y = a/b*c",
    "Àéîõü ÑANDÚ straße ª² ¾ «oui» – “a’b” … 5€ §7 o'clock rock'n'roll ''s 't're",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaa 00001111 !!!???### internationalisation Donaudampfschifffahrt\r\n end",
)


def default_path() -> str:
    """The vocabulary file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceEncoder:
    """Encodes texts to little-endian unsigned ids, two bytes each where the vocabulary allows it."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values(), default=0) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.cache: dict[str, bytes] = {}
        self.whole = False
        self.whole = any(self.encode([t])[0] != self._whole([t])[0] for t in PROBES)
        self.forget()

    def forget(self) -> None:
        """Free the cache; a worker outlives its tasks."""
        self.cache = {}

    def _whole(self, texts: list[str | None]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Ids of unseen pieces; many go in one call, cut again at the word-end tokens."""
        groups = [pieces[i : i + PIECES_PER_CALL] for i in range(0, len(pieces), PIECES_PER_CALL)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                raw, at, width = ids.tobytes(), 0, self.dtype.itemsize
                for piece, cut in zip(group, (cuts * width).tolist(), strict=True):
                    self.cache[piece] = raw[at:cut]
                    at = cut
            else:
                for piece in group:
                    self.cache[piece] = self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, a null counting as empty; the end id is not appended."""
        if self.whole:
            return self._whole(texts)
        cut, whole = [], set()
        for text in texts:
            if not text:
                cut.append(())
            elif _DOUBTFUL.search(text):
                runs = []
                for run in _BLANK.split(text):
                    if _DOUBTFUL.search(run):
                        whole.add(run)
                        runs.append(run)
                    else:
                        runs += _PIECE.findall(run.lower())
                cut.append(runs)
            else:
                cut.append(_PIECE.findall(text.lower()))
        seen = set().union(*cut)
        if unseen := [p for p in seen if p not in self.cache]:
            self._learn([p for p in unseen if p not in whole])
            for run in whole.intersection(unseen):
                self.cache[run] = self._bytes(self.tokenizer.encode(run, add_special_tokens=False).ids)
        get = self.cache.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        if len(self.cache) > CACHE_PIECES:
            self.cache = {p: self.cache[p] for p in seen} if len(seen) <= CACHE_PIECES else {}
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary file; who takes it calls ``forget`` at the end of the task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def blocks(texts, chars: int = 4_000_000):
    """Cut a list of texts into runs of about ``chars`` characters, so that memory follows text and not rows."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
