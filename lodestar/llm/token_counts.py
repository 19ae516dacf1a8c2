"""Token counts of whole texts, counting whole-token pre-tokens without merging them."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import Memo, add_columns, claim

#: Fixed: the split of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """How many tokens a byte-level BPE file of the tokenizers library makes of a text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = [a for a in spec["added_tokens"] if a["content"]]
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError(f"{path} has added tokens that take their surroundings")
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in added)) if added else None
        self.find = regex.compile(PATTERN).findall
        # The proof, once: what the pattern leaves whole and merging makes one token of.
        tokens = [self.library.decode([i], skip_special_tokens=False) for i in range(self.library.get_vocab_size())]
        kept = [t for t in dict.fromkeys(tokens) if t and "�" not in t and not (self.special and self.special.search(t)) and self.find(t) == [t]]
        self.whole = {t for t, e in zip(kept, self.library.encode_batch(kept, add_special_tokens=False)) if len(e.ids) == 1}
        self.merged = Memo(self._merge)
        self.piece = Memo(self._piece)

    def _merge(self, token: str) -> int:
        return len(self.library.encode(token, add_special_tokens=False).ids)

    def _matched(self, text: str) -> int:
        found = self.find(text)
        rest = [t for t in found if t not in self.whole]
        return len(found) - len(rest) + sum(map(self.merged.__getitem__, rest))

    def _piece(self, piece: str) -> int:
        """The count of a space and the piece; a huge negative value if the space doesn't begin a pre-token."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return -(1 << 60)
        return self._matched(" " + piece)

    def _plain(self, text: str) -> int:
        first, *inner = text.split(" ")
        if not inner:
            return self._matched(text)
        last = inner.pop()
        if not first or first[-1].isspace() or not last or last[0].isspace():
            return self._matched(text)
        n = sum(map(self.piece.__getitem__, inner))
        return n + self._matched(first) + self._matched(" " + last) if n >= 0 else self._matched(text)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text.

    path: a byte-level BPE file of the tokenizers library that every executor can open. Special strings inside a text
    count as their one token, as the library has it by default; none is added.

    Null and empty texts count 0 and 0. Repeated rows count each. Columns of df with the name of a result are replaced;
    all others stay. An empty df gives an empty result. Texts of any length count whole.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def start():
        claim("token_counts", counter.cache_clear)
        count = counter(path)

        def f(texts: pa.Array) -> list[pa.Array]:
            n = pa.array([count(x.as_py()) for x in texts], pa.int64())
            return [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), n, pc.greater(n, limit)]

        return f

    return add_columns(df, [text], start, fields, keep)
