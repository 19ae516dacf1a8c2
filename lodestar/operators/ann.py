"""Approximate search: product quantization, and a layered neighbour graph for each shard, then exact scores of the survivors."""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scoring import doubles, literal, score
from lodestar.operators.policy import plan_search
from lodestar.operators.state import numbered

#: Subspaces of a code at most. Four give a recall of 0.6 only on 2,000 vectors of 64 components, sixteen 0.93.
SUBSPACES = 16
# Fixed values of the quantizer and of the graph.
CENTROIDS, ROUNDS = 16, 6
LINKS, BASE_LINKS, BUILD_BEAM, LEVELS = 8, 16, 64, 7
SEED = 1
#: Rows of one shard's graph at most.
SHARD_ROWS = 8_000


def subspaces(dimension: int, most: int = SUBSPACES) -> list[tuple[int, int]]:
    """At most so many runs of components, the first ones longer by one where they don't come out even."""
    n = min(most, dimension)
    sizes = [dimension // n + (i < dimension % n) for i in range(n)]
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends[:-1]], ends))


def encode(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The nearest centroid (the lowest at ties) of each row in each subspace."""
    out = np.empty((len(x), len(books)), np.int8)
    for s, ((a, b), book) in enumerate(zip(subspaces(x.shape[1], len(books)), books)):
        out[:, s] = ((x[:, None, a:b] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    return out


def train(rows: DataFrame, dimension: int, most: int = SUBSPACES) -> list[np.ndarray]:
    """Codebooks of (sequence, vector): begun at rows evenly apart in order of sequence, then Lloyd rounds over all rows.

    Ranks come from counts by range, at any size. A round is one pass of partial sums; the codebooks alone reach the driver. An empty cell keeps its centroid. most is the
    number of subspaces: with more, codes are longer and say more.
    """
    n = rows.count()
    if not n:
        return []
    c = min(CENTROIDS, n)
    ranks = numbered(rows.select(F.col("sequence").alias("at")), -1, "at")
    at = [r[0] for r in ranks.where(F.col("sequence").isin([i * n // c for i in range(c)])).select("at").collect()]  # c rows
    first = rows.where(F.col("sequence").isin(at)).orderBy("sequence").select("vector").collect()
    start = np.array([r[0] for r in first], dtype=np.float64)
    books = [start[:, a:b].copy() for a, b in subspaces(dimension, most)]
    for _ in range(ROUNDS):

        def sums(batches, books=tuple(books)):
            total = [np.zeros((len(b), b.shape[1] + 1)) for b in books]
            for batch in batches:
                x = np.array(batch.column(0).to_pylist(), dtype=np.float64)
                if len(x):
                    codes = encode(x, list(books))
                    for s, (a, b) in enumerate(subspaces(x.shape[1], len(books))):
                        np.add.at(total[s], codes[:, s], np.concatenate([x[:, a:b], np.ones((len(x), 1))], axis=1))
            for s, t in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([s] * t.size, pa.int32()), pa.array(np.arange(t.size, dtype=np.int32)), pa.array(t.ravel())], names=["s", "i", "x"])

        got = rows.select("vector").mapInArrow(sums, "s int, i int, x double").groupBy("s", "i").agg(F.sum("x").alias("x")).toPandas()
        for s, book in enumerate(books):
            t = got[got.s == s].sort_values("i").x.to_numpy().reshape(len(book), -1)
            full = t[:, -1] > 0
            book[full] = t[full, :-1] / t[full, -1:]
    return books


def with_codes(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows and codes (array<tinyint>)."""

    @F.pandas_udf(T.ArrayType(T.ByteType()))
    def coded(v: pd.Series) -> pd.Series:
        return pd.Series(list(encode(np.array(v.tolist(), dtype=np.float64), books))) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn("codes", coded("vector"))


def lookup(query: np.ndarray, books: list[np.ndarray], metric: str) -> list[np.ndarray]:
    """What each centroid adds to the score of a query."""
    parts = [(query[a:b], book) for (a, b), book in zip(subspaces(len(query), len(books)), books)]
    return [book @ q if metric == "COSINE" else -((book - q) ** 2).sum(axis=1) for q, book in parts]


def quantized_score(codes, tables, norm_, q_norm: float, metric: str):
    """The score by table lookups, in the JVM: for cosine over the exact norms."""
    luts = F.array(*(F.array(*(F.lit(float(x)) for x in t)) for t in tables))
    total = F.aggregate(F.zip_with(codes, luts, lambda c, t: t[c.cast("int")]), F.lit(0.0), lambda s, x: s + x)
    if metric != "COSINE":
        return total
    n = norm_.cast("double") * F.lit(q_norm)
    return F.when(n == 0, 0.0).otherwise(total / n)


class Graph:
    """A layered graph over the rows of one shard: links go to well scored rows in all directions, greedily down, then a beam on the lowest layer."""

    def __init__(self, x: np.ndarray, metric: str):
        self.x, self.metric = np.asarray(x, dtype=np.float64), metric
        self.norms = np.linalg.norm(self.x, axis=1)
        r = np.random.default_rng(SEED)
        self.top = np.minimum(r.geometric(0.5, len(self.x)) - 1, LEVELS)
        self.links: list[dict[int, list[int]]] = [{} for _ in range(LEVELS + 1)]
        self.entry = -1
        for i in range(len(self.x)):
            self._add(i)

    def scores(self, q: np.ndarray, at) -> np.ndarray:
        c = self.x[at]
        if self.metric == "L2":
            return -((c - q) ** 2).sum(axis=1)
        n = self.norms[at] * np.linalg.norm(q)
        return np.where(n == 0, 0.0, (c @ q) / np.where(n == 0, 1.0, n))

    def _add(self, i: int) -> None:
        q, top = self.x[i], int(self.top[i])
        for level in range(top + 1):
            self.links[level][i] = []
        if self.entry < 0:
            self.entry = i
            return
        at = self.entry
        highest = int(self.top[self.entry])
        for level in range(highest, top, -1):
            at = self._descend(q, at, level)
        for level in range(min(top, highest), -1, -1):
            most = BASE_LINKS if level == 0 else LINKS
            found = self._beam(q, [at], BUILD_BEAM, level, self.scores)[0]
            for j in self._spread(np.array([s for s, _ in found]), [j for _, j in found], most):
                self.links[level][i].append(j)
                own = self.links[level][j]
                own.append(i)
                if len(own) > most:
                    s = self.scores(self.x[j], own)
                    order = np.argsort(-s, kind="stable")
                    self.links[level][j] = self._spread(s[order], [own[k] for k in order], most)
            at = found[0][1]
        if top > highest:
            self.entry = i

    def _spread(self, s: np.ndarray, rows: list[int], most: int) -> list[int]:
        """At most so many of rows (best scored first): first those that no row taken before is closer to than the owner is, then the best of the rest.

        Links to the best alone stay within a cluster, and a search can't leave it.
        """
        if len(rows) <= most:
            return rows
        c = self.x[rows]
        if self.metric == "L2":
            near = -(np.square(c).sum(axis=1)[:, None] + np.square(c).sum(axis=1)[None, :] - 2 * c @ c.T)
        else:
            n = np.maximum(self.norms[rows], 1e-30)
            near = (c @ c.T) / n[:, None] / n[None, :]
        taken: list[int] = []
        closest = np.full(len(rows), -np.inf)
        for k in range(len(rows)):
            if closest[k] < s[k]:
                taken.append(k)
                closest = np.maximum(closest, near[k])
                if len(taken) == most:
                    break
        rest = [k for k in range(len(rows)) if k not in set(taken)]
        return [rows[k] for k in sorted([*taken, *rest[: most - len(taken)]])]

    def _descend(self, q, at: int, level: int) -> int:
        best = float(self.scores(q, [at])[0])
        while near := self.links[level].get(at):
            s = self.scores(q, near)
            k = int(s.argmax())
            if s[k] <= best:
                break
            best, at = float(s[k]), near[k]
        return at

    def _beam(self, q, starts, width: int, level: int, scored) -> tuple[list[tuple[float, int]], int]:
        seen = set(starts)
        s = scored(q, starts)
        open_ = [(-float(a), i) for a, i in zip(s, starts)]
        kept = [(float(a), i) for a, i in zip(s, starts)]
        heapq.heapify(open_), heapq.heapify(kept)
        while open_:
            a, i = heapq.heappop(open_)
            if len(kept) >= width and -a < kept[0][0]:
                break
            near = [j for j in self.links[level].get(i, ()) if j not in seen]
            seen.update(near)
            for b, j in zip(scored(q, near) if near else (), near):
                if len(kept) < width or b > kept[0][0]:
                    heapq.heappush(kept, (float(b), j))
                    heapq.heappush(open_, (-float(b), j))
                    if len(kept) > width:
                        heapq.heappop(kept)
        return sorted(kept, reverse=True), len(seen)

    def quantized(self, q: np.ndarray, codes: np.ndarray, tables: list[np.ndarray]):
        """Scores by table lookups, to stand in for exact ones."""
        length = np.linalg.norm(q)

        def f(_, at):
            total = sum(t[codes[at, s]] for s, t in enumerate(tables))
            if self.metric != "COSINE":
                return total
            n = self.norms[at] * length
            return np.where(n == 0, 0.0, total / np.where(n == 0, 1.0, n))

        return f

    def search(self, q: np.ndarray, width: int, scored=None) -> tuple[list[tuple[float, int]], int]:
        """The beam's rows, best first, and how many were looked at; scored may stand in for exact scores on the lowest layer."""
        if self.entry < 0:
            return [], 0
        at = self.entry
        for level in range(int(self.top[self.entry]), 0, -1):
            at = self._descend(q, at, level)
        return self._beam(q, [at], width, 0, scored or self.scores)


    def to_bytes(self) -> bytes:
        """The graph as it is searched: vectors, levels, and the links of each level as offsets and neighbours."""
        parts = {"x": self.x, "top": self.top, "entry": np.array([self.entry])}
        for level, links in enumerate(self.links):
            own = [links.get(i, []) for i in range(len(self.x))]
            parts[f"ends{level}"] = np.cumsum([0, *map(len, own)])
            parts[f"near{level}"] = np.array([j for near in own for j in near], dtype=np.int32)
        out = io.BytesIO()
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes, metric: str) -> Graph:
        g, parts = cls.__new__(cls), np.load(io.BytesIO(raw))
        g.x, g.top, g.metric, g.entry = parts["x"], parts["top"], metric, int(parts["entry"][0])
        g.norms, g.links = np.linalg.norm(g.x, axis=1), []
        for level in range(LEVELS + 1):
            ends, near = parts[f"ends{level}"], parts[f"near{level}"]
            g.links.append({i: near[a:z].tolist() for i, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if z > a})
        return g


def build_graphs(shards: DataFrame, metric: str, books: list[np.ndarray]) -> DataFrame:
    """(shard, graph, codes, ids as JSON): the graph of each shard of (shard, id, sequence, vector), to be stored. A shard, SHARD_ROWS at most, is one group."""
    kind = shards.schema["id"].dataType

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence")
        x = np.array(pdf["vector"].tolist(), dtype=np.float64)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "graph": [Graph(x, metric).to_bytes()], "codes": [encode(x, books).tobytes()], "ids": [pdf["id"].tolist()]})

    schema = T.StructType([shards.schema["shard"], T.StructField("graph", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("ids", T.ArrayType(kind))])
    return shards.select("shard", "id", "sequence", "vector").groupBy("shard").applyInPandas(one, schema)


def beams(graphs: DataFrame, queries: list[tuple], width: int, books: list[np.ndarray], metric: str, name: T.StructField) -> DataFrame:
    """(query_id, id, approx, visited): what the beams of all stored graphs find for each of (query_id, vector); a block of queries travels to the graphs."""
    block = graphs.sparkSession.sparkContext.broadcast(queries)
    ids = graphs.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", name.dataType), T.StructField("id", ids), T.StructField("approx", T.DoubleType()), T.StructField("visited", T.LongType())])

    def run(frames):
        for f in frames:
            for raw, codes, own in zip(f["graph"], f["codes"], f["ids"]):
                g = Graph.from_bytes(raw, metric)
                coded = np.frombuffer(codes, np.int8).reshape(len(own), len(books))
                out = []
                for query_id, q in block.value:
                    found, seen = g.search(q, width, g.quantized(q, coded, lookup(q, books, metric)))
                    out += [(query_id, own[i], s, seen) for s, i in found]
                yield pd.DataFrame(out, columns=schema.names)

    return graphs.select("graph", "codes", "ids").mapInPandas(run, schema)


def search_graphs(graphs: DataFrame, query, width: int, books: list[np.ndarray], metric: str) -> DataFrame:
    """(id, approx, visited) of the beams of all stored graphs."""
    found = beams(graphs, [(0, np.asarray(query, dtype=np.float64))], width, books, metric, T.StructField("query_id", T.IntegerType()))
    return found.drop("query_id")


def exact_topk(rows: DataFrame, best: DataFrame, query, k: int, metric: str) -> DataFrame:
    """(id, score, payload, sequence): the k best by exact score of the rows whose id best has; best is as long as the plan's rerank."""
    exact = score(metric, literal([float(x) for x in query]), doubles(F.col("vector")))
    survivors = rows.join(F.broadcast(best), "id", "left_semi")
    return survivors.select("id", exact.alias("score"), "payload", "sequence").orderBy(F.desc("score"), F.desc("sequence"), "id").limit(k)


def sharded(rows: DataFrame, n: int) -> DataFrame:
    """rows and shard: so many shards of n rows that each has SHARD_ROWS at most."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-2 * n // SHARD_ROWS)))))


def ann_topk(rows: DataFrame, query, k: int, metric: str, books: list[np.ndarray], n: int, where=None, filtered: int | None = None, graph: bool = False) -> DataFrame:
    """(id, score, payload, sequence): the k best by exact score among the best by quantized score.

    rows: (id, sequence, vector, norm, payload, codes). The filter comes first, so k rows are found wherever k match. With graph,
    the shards' beams give the candidates instead of a scan of the codes.
    """
    plan = plan_search(n, k, filtered)
    q = [float(x) for x in query]
    matching = rows if where is None else rows.where(where)
    size = max(plan.rerank, plan.beam)
    if graph:
        found = search_graphs(build_graphs(sharded(matching.select("id", "sequence", "vector"), n), metric, books), q, plan.beam, books, metric)
        best = found.orderBy(F.desc("approx"), "id").limit(size).select("id")
    else:
        s = quantized_score(F.col("codes"), lookup(np.array(q), books, metric), F.col("norm"), float(np.linalg.norm(q)), metric)
        best = matching.select("id", s.alias("approx")).orderBy(F.desc("approx"), "id").limit(size).select("id")
    return exact_topk(matching, best, q, k, metric)
