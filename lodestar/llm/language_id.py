"""Language identification by n-gram filters that answer with a bitmask of languages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import add_columns, claim
from lodestar.llm.words import mixed

#: Lengths of the character n-grams; a word's first and last n-gram hold one blank each.
LENGTHS = (2, 3, 4)
#: Characters handled at a time; a longer text goes in parts that overlap.
PART = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point's lower case, for letters; a blank for all else."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _parts(texts: list[str | None]):
    """(row, part) of texts, parts of at most PART characters."""
    for row, x in enumerate(texts):
        for at in range(0, len(x) if x else 0, PART):
            yield row, x[max(0, at - LENGTHS[-1]) : at + PART]


def _groups(texts: list[str | None]):
    """Rows, starts and letter codes of so many parts that they have about PART characters."""
    rows, parts, size = [], [], 0
    for row, x in _parts(texts):
        rows.append(row)
        parts.append(x)
        size += len(x)
        if size >= PART:
            yield _coded(rows, parts)
            rows, parts, size = [], [], 0
    if rows:
        yield _coded(rows, parts)


def _coded(rows: list[int], parts: list[str]):
    starts = np.zeros(len(parts), dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts[:-1]], out=starts[1:])
    joined = " " + " ".join(parts) + " "
    return rows, starts, _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each n-gram and whether it counts: one blank at most, and that at an end."""
    size = len(codes) - n + 1
    with np.errstate(over="ignore"):
        h = np.full(size, np.uint64(n), dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + size]
        h = mixed(h)
    blank = codes == 32
    good = ~(blank[:size] & blank[n - 1 :])
    for j in range(1, n - 1):
        good &= ~blank[j : j + size]
    return h, good


@dataclass
class LanguageFilters:
    """A Bloom filter for each language, sliced by bit: row h of a table holds bit h of up to 64 of them.

    One look at the rows of an n-gram's hashes, joined by AND, gives the mask of all languages of a table that have it.
    """

    languages: list[str]
    tables: list[np.ndarray]
    hashes: int

    @classmethod
    def of(cls, grams: dict[str, np.ndarray], bits: int, hashes: int) -> LanguageFilters:
        languages = sorted(grams)
        out = cls(languages, [], hashes)
        for at in range(0, len(languages), 64):
            own = languages[at : at + 64]
            kind = next(k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if len(own) <= n)
            out.tables.append(np.zeros(bits, dtype=kind))
            for i, lang in enumerate(own):
                for rows in out._rows(grams[lang], bits):
                    out.tables[-1][rows] |= kind(1 << i)
        return out

    def _rows(self, h: np.ndarray, bits: int):
        with np.errstate(over="ignore"):
            step = (h >> np.uint64(32)) | np.uint64(1)
            for k in range(self.hashes):
                yield ((h + np.uint64(k) * step) % np.uint64(bits)).astype(np.int64)

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        """Of each table, the masks of the languages that have these n-grams."""
        out: list[np.ndarray] = []
        for rows in self._rows(h, len(self.tables[0])) if self.tables else ():
            found = [t[rows] for t in self.tables]
            out = [a & b for a, b in zip(out, found)] if out else found
        return out

    def _flags(self, masks: list[np.ndarray]):
        """By language, which n-grams it has."""
        for mask, at in zip(masks, range(0, len(self.languages), 64)):
            for i in range(min(64, len(self.languages) - at)):
                yield (mask >> mask.dtype.type(i)) & mask.dtype.type(1)

    def false_rates(self) -> np.ndarray:
        """By language, how often the filter has what was never put in."""
        return np.array([np.mean(bit) ** self.hashes for bit in self._flags(self.tables)])

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """By text: how many n-grams each language's filter has, and how many n-grams there are."""
        found, total = np.zeros((len(texts), len(self.languages)), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for rows, starts, codes in _groups(texts):
            for n in LENGTHS:
                h, good = _grams(codes, n)
                masks = self.masks(h)
                for mask in masks:
                    mask[~good] = 0
                at = np.minimum(starts, len(h) - 1)
                np.add.at(total, rows, np.add.reduceat(good.astype(np.int64), at))
                for i, flag in enumerate(self._flags(masks)):
                    np.add.at(found[:, i], rows, np.add.reduceat(flag.astype(np.int64), at))
        return found, total

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language with the most n-grams after the false positives are taken off, and that share of n-grams."""
        found, total = self.hits(texts)
        n, false = np.maximum(total, 1)[:, None], self.false_rates()[None, :]
        share = np.clip((found / n - false) / np.maximum(1 - false, 1e-9), 0, 1)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = share.argmax(axis=1)
        return [self.languages[b] if t else "und" for b, t in zip(best, total)], np.where(total > 0, share.max(axis=1), 0.0)


def fit(
    df: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 2_000, least_share: float = 0.01, bits: int = 1 << 20, hashes: int = 3, most_languages: int = 512
) -> LanguageFilters:
    """Learn each language's n-grams from the rows with a text and a language.

    The bound: about rows_per_language different texts of each language at most, chosen by a hash of the text, are read whole. A language
    has the n-grams that at least least_share of its sampled texts hold (two at least, unless it has fewer than ten), which bounds
    what reaches the driver by the mean number of n-grams of a text over least_share. Of more than most_languages languages those with the most
    rows are learned (then by code point). No rows: no languages.
    """
    known = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    kinds = known.groupBy(F.col(lang).cast("string").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(most_languages)
    counts = {r[0]: r[1] for r in kinds.collect()}
    if not counts:
        return LanguageFilters([], [], hashes)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows_per_language / n))))
    place = F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 20)) / float(1 << 20)
    # The hash takes all copies of a text or none; one of them stays, so that a large group of copies doesn't pass the bound.
    sample = known.where(place < share[F.col(lang).cast("string")]).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).distinct()

    def grams(batches):
        seen: dict[str, list[np.ndarray]] = {}
        rows: dict[str, int] = {}
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = []
                for _, _, codes in _groups([x]):
                    for n in LENGTHS:
                        h, good = _grams(codes, n)
                        own.append(h[good])
                seen.setdefault(name, []).append(np.unique(np.concatenate(own)) if own else np.zeros(0, dtype=np.uint64))
                rows[name] = rows.get(name, 0) + 1
        for name, parts in seen.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(h) + 1), pa.string()), pa.array([None, *h.view(np.int64).tolist()], pa.int64()), pa.array([rows[name], *n.tolist()], pa.int64())], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = counted.where("gram IS NULL").select("lang", F.col("n").alias("rows"))
    kept = counted.where("gram IS NOT NULL").join(F.broadcast(sizes), "lang").where((F.col("n") >= F.col("rows") * least_share) & ((F.col("n") >= 2) | (F.col("rows") < 10)))
    table = kept.select("lang", "gram").toArrow()
    langs, h = table.column("lang").to_numpy(zero_copy_only=False), table.column("gram").to_numpy().view(np.uint64)
    return LanguageFilters.of({k: h[langs == k] for k in sorted(counts)}, bits, hashes)


def identify(df: DataFrame, model: LanguageFilters, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (0 to 1: the share of the text's n-grams that the language has) of each whole text.

    Texts that are null or without letters are `und`, score 0; ties go to the first language by code point. Repeated rows
    are decided each. Columns of df with the name of a result are replaced; all others stay. An empty df gives an empty
    result. A text of any length is read whole, a part of 2^20 characters at a time.
    """

    def start():
        claim("language_id")

        def f(texts: pa.Array) -> list[pa.Array]:
            names, score = model.decide(texts.to_pylist())
            return [pa.array(names, pa.string()), pa.array(score, pa.float64())]

        return f

    return add_columns(df, [text], start, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)


def remainder(col: Column, by: int) -> Column:
    """crc32 of a value as text, mod by; -1 for null."""
    return F.coalesce(F.crc32(col.cast("string")) % by, F.lit(-1))
