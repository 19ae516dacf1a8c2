"""Exact search: filter, score, and the best k in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scoring import doubles, literal, score

class DimensionError(ValueError):
    """A query of another length than the collection's vectors."""


def topk(live: DataFrame, vector, k: int, metric: str = "COSINE", where: Column | None = None, dimension: int | None = None) -> DataFrame:
    """(id, score, payload, sequence): the k best of live (id, sequence, vector, norm, payload), newest first at equal scores, then by id.

    Each partition keeps k rows; payloads are read with the scan but move for survivors only.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    vector = list(vector)
    if not vector or (dimension is not None and len(vector) != dimension):
        raise DimensionError(f"a query of {len(vector)} for vectors of {dimension}")
    rows = live if where is None else live.where(where)
    q = literal(vector)
    q_norm = F.lit(sum(float(x) * float(x) for x in vector) ** 0.5)
    known = F.col("norm").cast("double") if "norm" in live.columns else None
    s = score(metric, q, doubles(F.col("vector")), q_norm, known)
    return rows.select("id", s.alias("score"), "payload", "sequence").orderBy(F.desc("score"), F.desc("sequence"), F.asc("id")).limit(k)


class QueryCache:
    """Answers by (version of the collection, query), the least recently used of size entries goes first; a new version clears it."""

    def __init__(self, size: int = 128):
        self.size, self.version, self.entries = size, None, {}

    def get(self, version, key, make):
        if version != self.version:
            self.version, self.entries = version, {}
        hit = key in self.entries
        value = self.entries.pop(key) if hit else make()
        self.entries[key] = value
        if len(self.entries) > self.size:
            self.entries.pop(next(iter(self.entries)))
        return value, hit


class IndexCache:
    """Loaded index files by path, within a budget of bytes and of entries; the coldest goes first, but never the one just asked for."""

    def __init__(self, budget: int = 512 << 20, most: int = 64):
        self.budget, self.most, self.entries = budget, most, {}

    def get(self, path: str, weight: int, load):
        """(frames, whether they were here); load gives persisted frames."""
        hit = path in self.entries
        self.entries[path] = self.entries.pop(path) if hit else (load(), weight)
        while len(self.entries) > 1 and (len(self.entries) > self.most or sum(w for _, w in self.entries.values()) > self.budget):
            self._free(next(iter(self.entries)))
        return self.entries[path][0], hit

    def _free(self, path: str) -> None:
        for frame in self.entries.pop(path)[0]:
            frame.unpersist()

    def drop(self, prefix: str) -> None:
        for path in [p for p in self.entries if p.startswith(prefix)]:
            self._free(path)
