"""Byte-level BPE by backtracking from longest matches, in time linear in the text."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import add_columns, claim
from lodestar.llm.pretokens import Pieces


class Merges:
    """The tokens that merging by rank makes of bytes, found without merging.

    Bytes are read as Latin-1 so that an Aho-Corasick automaton over strings finds every vocabulary entry in them. From
    each place the longest entry is tried first, then its prefixes. An entry may follow another only if merging would
    not have joined across their border; that answer depends on the two alone and is remembered. A place from which no
    entry leads on is never tried again, hence the linear time.
    """

    def __init__(self, ranks: dict[bytes, int], remembered: int = 1_000_000):
        self.ranks, self.remembered = ranks, remembered
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.find = ahocorasick.Automaton()
        for token, i in ranks.items():
            if (halves := self._halves(token)) is not None:  # else merging never makes it
                self.halves[i] = halves
                self.find.add_word(token.decode("latin-1"), i)
        self.find.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one when its bytes are merged alone; a byte is its own halves."""
        parts = [token[i : i + 1] for i in range(len(token))]
        if len(parts) == 1:
            return (self.ranks[token],) * 2
        while True:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                return None
            _, i = min(ranked)
            if len(parts) == 2:
                return self.ranks[parts[0]], self.ranks[parts[1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _prefix(self, token: int) -> int | None:
        """The longest shorter entry that the token begins with."""
        if token not in self.shorter:
            own = self.bytes_of[token]
            self.shorter[token] = next((i for n in range(len(own) - 1, 0, -1) if (i := self.ranks.get(own[:n])) in self.halves), None)
        return self.shorter[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves these two neighbours apart.

        Undo the merges next to the border, the latest first. Where the two tokens at the border could join before the
        merge that was undone last, merging would have joined them.
        """
        key = (left, right)
        if (known := self.pairs.get(key)) is not None:
            return known
        before, good = 1 << 60, None
        while good is None:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < before:
                good = False
            elif left > right and self.halves[left][0] != left:
                before, left = left, self.halves[left][1]
            elif self.halves[right][0] != right:
                before, right = right + 1, self.halves[right][0]
            elif self.halves[left][0] != left:
                before, left = left, self.halves[left][1]
            else:
                good = True
        if len(self.pairs) >= self.remembered:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token; a whole vocabulary entry is itself."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        read, pairs, sizes, longest = piece.decode("latin-1"), self.pairs, self.sizes, self.find.iter_long
        if not piece:
            return []
        greedy = [token for _, token in longest(read)]
        for k, pair in enumerate(zip(greedy, greedy[1:]), 1):
            known = pairs.get(pair)
            if not (self._compatible(*pair) if known is None else known):
                break
        else:
            return greedy
        at, pos, size = {}, 0, len(piece)
        for token in greedy:
            at[pos] = token
            pos += sizes[token]
        dead: set[int] = set()
        out = greedy[:k]  # these fit; the next is tried again, and shorter
        pos, token = sum(sizes[t] for t in out), greedy[k]
        while True:
            if token is None:  # nothing leads on from here: the token that led here must be shorter
                dead.add(pos)
                token = out.pop()
                pos -= sizes[token]
            else:
                end = pos + sizes[token]
                if end not in dead:
                    known = pairs.get((out[-1], token)) if out else True
                    if self._compatible(out[-1], token) if known is None else known:
                        out.append(token)
                        if end == size:
                            return out
                        pos = end
                        if (token := at.get(pos)) is None:
                            token = at[pos] = next(longest(read, pos))[1]
                        continue
            token = self.shorter[token] if token in self.shorter else self._prefix(token)


@lru_cache(maxsize=4)
def _loaded(path: str, pattern: str) -> tuple[Pieces, list[bytes], list[str]]:
    """Of a rank file, once in each Python worker: text to ids, the bytes and the decimal strings of the ids."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    merges = Merges(ranks)
    top = max(ranks.values()) + 1
    return Pieces(pattern, lambda t: merges.encode(t.encode("utf-8", "surrogatepass"))), [merges.bytes_of.get(i, b"") for i in range(top)], [str(i) for i in range(top)]


def encoder(path: str, pattern: str):
    """encode(text) -> list of ids, decode(ids) -> bytes."""
    pieces, own, _ = _loaded(path, pattern)
    return (lambda text: list(pieces(text))), (lambda ids: b"".join(map(own.__getitem__, ids)))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str | None = "ids", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Add the token ids of each whole text, and digests of the ids and of what they decode to.

    path: a file of ranks (base64 of the bytes, blank, rank) that every executor can open. Columns: n_tokens, then ids
    (array<int>, unless None), then with digests ids_sha256 (of the decimal ids joined by commas) and decoded_sha256.

    Null and empty texts have no ids, and digests of nothing. Repeated rows are encoded each. Columns of df with the
    name of a result are replaced; all others stay, whatever they are named. An empty df gives an empty result. A text of
    any length is held by one task, in memory proportional to it.
    """
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] if ids is not None else []
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests

    def start():
        claim("byte_bpe", _loaded.cache_clear)
        pieces, own, decimal = _loaded(path, pattern)

        def f(texts: pa.Array) -> list[pa.Array]:
            count, lists, a, b = [], [], [], []
            for x in texts:
                found = pieces(x.as_py())
                count.append(len(found))
                if ids is not None:
                    lists.append(pa.array(found, pa.int32()))
                if digests:
                    a.append(hashlib.sha256(",".join(map(decimal.__getitem__, found)).encode()).hexdigest())
                    b.append(hashlib.sha256(b"".join(map(own.__getitem__, found))).hexdigest())
            out = [pa.array(count, pa.int64())]
            if ids is not None:
                flat = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
                ends = [0]
                for n in count:
                    ends.append(ends[-1] + n)
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
            return out + ([pa.array(a, pa.string()), pa.array(b, pa.string())] if digests else [])

        return f

    return add_columns(df, [text], start, fields, keep)
