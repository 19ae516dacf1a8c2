"""Hashes of words and of word shingles, vectorised; the words are those between the blanks of ``common.BLANK``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from lodestar.llm.common import BLANK

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

#: Each byte with A-Z lower-cased, and whether it belongs to a word.
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_IN_WORD = np.array([chr(i) not in BLANK for i in range(256)])
#: The bytes that are left of a word's last eight, by their number.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 256


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash, of unsigned values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, in order, and where each text's words begin (one number more than texts).

    A-Z are lower-cased, and no other letters. Null texts have no words. Eight bytes of all words are handled at a time.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = int(bounds[-1] - bounds[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    low = np.zeros(size + 8, np.uint8)
    np.take(_LOWER, raw, out=low[:size])
    inside = _IN_WORD[raw]
    # A word ends at a blank or with its text.
    apart = np.zeros(size + 1, bool)
    apart[bounds] = True
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | apart[:-1]))
    length = np.flatnonzero(inside & (~after | apart[1:])) + 1 - starts
    eight = np.ndarray((size + 1,), dtype="<u8", buffer=low, strides=(1,))
    h = length.astype(np.uint64) * _ODD[0]
    h = mixed(h + (eight[starts] & _LEFT[np.minimum(length, 8)]))
    at, done = np.flatnonzero((length > 8) & (length <= _LONG)), 8
    while len(at):
        h[at] = mixed(h[at] * _ODD[1] + (eight[starts[at] + done] & _LEFT[np.minimum(length[at] - done, 8)]))
        done += 8
        at = at[length[at] > done]
    for i in np.flatnonzero(length > _LONG):
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : starts[i] + length[i]])
    return h, np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, in order; of a shorter text one, of all its words; of none, none."""
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = np.full(count, np.uint64(width), dtype=np.uint64)
        for j in range(width):
            h *= _ODD[j % len(_ODD)]
            h += words[j : j + count]
            h ^= h >> np.uint64(29)
        return mixed(h)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    words, at = word_hashes(texts)
    runs = shingles(words, n)
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        own = np.sort(runs[a : z - n + 1] if z - a >= n else shingles(words[a:z], n))
        yield own[np.append(True, own[1:] != own[:-1])] if len(own) > 1 else own


def in_parts(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of text, and one row at least."""
    for b in batches:
        column = b.column(text)
        if not b.num_rows:
            continue
        kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most, side="right")) - 1)
            yield b.slice(at, stop - at)
            at = stop
