"""Document quality by compression: which of two dictionaries, of good or of bad texts, shortens a text more."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import add_columns, claim

#: Bytes compressed at a time. Each part meets the dictionary anew, so long texts don't outgrow it.
PART = 1024


@dataclass
class CompressionClassifier:
    """Two zstandard dictionaries and the logistic curve from size difference to probability."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    shift: float = 0.0
    level: int = 3
    _ready: tuple = field(default=(), repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_ready": ()}

    def difference(self, text: str | None) -> float:
        """(bytes under the bad dictionary - bytes under the good one) / bytes, over all parts of the text."""
        if not text or not self.good or not self.bad:
            return 0.0
        if not self._ready:
            self._ready = tuple(
                zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_dict_id=False).compress
                for d in (_digested(self.good, self.level), _digested(self.bad, self.level))
            )
        good, bad = self._ready
        raw = text.encode("utf-8", "surrogatepass")
        parts = [raw[i : i + PART] for i in range(0, len(raw), PART)]
        return sum(len(bad(p)) - len(good(p)) for p in parts) / len(raw)

    def score(self, text: str | None) -> float:
        z = self.slope * self.difference(text) + self.shift
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _digested(raw: bytes, level: int) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=level)
    return d


def _dictionary(texts: list[str], size: int) -> bytes:
    """A dictionary trained on the parts of the texts; where they are too few to train on, as many of their bytes as fit."""
    pieces = [raw[i : i + PART] for x in texts if (raw := x.encode("utf-8", "surrogatepass")) for i in range(0, len(raw), PART)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the curve with the greatest likelihood, by Newton's method with a weak prior on the slope."""
    scale = max(float(np.abs(x).max(initial=0.0)), 1e-9)
    f, w = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        hess = f.T @ (f * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-6])
        w = w + np.clip(np.linalg.solve(hess, f.T @ (y - p) - np.array([1e-2, 1e-6]) * w), -4, 4)
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows_per_class: int = 1_500, dictionary_bytes: int = 112 << 10, sample_bytes: int = 48 << 20) -> CompressionClassifier:
    """Learn from the texts of docs whose id has a label 0 (bad) or 1 (good) in labels.

    The bound: about rows_per_class ids of each label, chosen by a hash of the id, 4 * rows_per_class in all at most, and of these, in the order
    of that hash, as many as have sample_bytes of text together (a longer text is passed over, for learning only). Only they are joined
    with the texts, as a broadcast of that size. Half of them make the dictionaries, the other half the calibration, weighted so that
    both labels count as in the whole of labels. With only one label, or none, every text scores the share of good labels (a half without labels).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    counts = {int(r[0]): r[1] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 0.5) / (total + 1)
    if len(counts) < 2:
        return CompressionClassifier(shift=math.log(prior / (1 - prior)))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("y") == 1, min(1.0, rows_per_class / counts[1])).otherwise(min(1.0, rows_per_class / counts[0]))
    ids = known.where(place < share).distinct().orderBy(F.xxhash64("id"), "id", "y").limit(4 * rows_per_class)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("x")).where("x IS NOT NULL")
    sizes = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.max(F.octet_length("x")).alias("n")).orderBy(F.xxhash64("id"), "id", "y").collect()
    chosen, used = [], 0
    for r in sizes:
        if used + r.n <= sample_bytes:
            chosen.append((r.id, r.y))
            used += r.n
    ids = docs.sparkSession.createDataFrame(chosen, ids.schema)
    own = texts.join(F.broadcast(ids), "id")
    rows = own.groupBy("id", "y").agg(F.min("x").alias("x")).withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).collect()
    rows = sorted(((r.half, r.y, r.x) for r in rows), key=lambda r: (r[0], r[1], r[2]))
    learn = {y: [x for h, own, x in rows if h == 0 and own == y] for y in (0, 1)}
    out = CompressionClassifier(_dictionary(learn[1], dictionary_bytes), _dictionary(learn[0], dictionary_bytes))
    held = [(y, x) for h, y, x in rows if h == 1]
    d, y = np.array([out.difference(x) for _, x in held]), np.array([y for y, _ in held], dtype=float)
    out.slope, out.shift = _logistic(d, y) if len(held) else (0.0, 0.0)
    drawn = (y.mean() if len(y) else 0.5) or 0.5
    drawn = min(max(float(drawn), 1e-3), 1 - 1e-3)
    out.shift += math.log(prior / (1 - prior)) - math.log(drawn / (1 - drawn))
    return out


def classify(df: DataFrame, model: CompressionClassifier, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1, higher: good likelier) and predicted (1 if score >= threshold, else 0) of each whole text.

    Null and empty texts score as a text that both dictionaries shorten alike. Repeated rows score each. Columns of df
    with the name of a result are replaced; all others stay. An empty df gives an empty result.
    """

    def start():
        claim("quality")

        def f(texts: pa.Array) -> list[pa.Array]:
            score = [model.score(x.as_py()) for x in texts]
            return [pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())]

        return f

    return add_columns(df, [text], start, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)
