"""Cut texts where a byte-level tokenizer's pattern certainly cuts, so that its work can be remembered by piece."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import regex

from lodestar.llm.common import Memo


class Pieces:
    """A text's values, from those of its pre-tokens.

    The pattern lets a single space lead a match, and a match that began elsewhere takes no space unless it is a run of
    white space. So each space between two characters that aren't white space begins a match, and what stands between
    two such spaces can be matched, and remembered, on its own. Texts with other runs of white space around spaces are
    matched as a whole.
    """

    def __init__(self, pattern: str, encode: Callable[[str], Sequence]):
        """encode: a pre-token's values."""
        self.find = regex.compile(pattern).findall
        self.encode = encode
        self.token = Memo(encode, limit=100_000)
        self.piece = Memo(self._piece)

    def _piece(self, piece: str) -> Sequence | bool:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return False
        if piece.isalpha() and max(piece) < "\u0500":  # letters alone, in any version of Unicode: one pre-token
            return tuple(self.encode(" " + piece))
        return self._matched(" " + piece)

    def _matched(self, text: str) -> tuple:
        return tuple(chain.from_iterable(map(self.token.__getitem__, self.find(text))))

    def __call__(self, text: str | None) -> Sequence:
        if not text:
            return ()
        first, *inner = text.split(" ")
        if not inner:
            return self._matched(text)
        last = inner.pop()
        if not first or first[-1].isspace() or not last or last[0].isspace():
            return self._matched(text)
        parts = list(map(self.piece.__getitem__, inner))
        if False in parts:
            return self._matched(text)
        return [*self._matched(first), *chain.from_iterable(parts), *self._matched(" " + last)]
