"""The best k rows for each of many queries: blocks of queries travel to the rows, and only each task's best move on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.ann import beams, build_graphs, lookup, sharded
from lodestar.operators.search import DimensionError

#: Bytes of the vectors of one block of queries, and scores that a task computes at a time.
QUERY_BLOCK_BYTES, SCORES = 8 << 20, 2_000_000


class Best:
    """The k highest scores of each of n queries with their ids, the lowest ids at ties; -inf is no candidate."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        kind = ids.dtype if self.ids is None else np.promote_types(self.ids.dtype, ids.dtype)
        self.ids = np.zeros(self.scores.shape, kind) if self.ids is None else self.ids.astype(kind, copy=False)
        most = scores.max(axis=1, initial=-np.inf)
        hit = np.flatnonzero((most >= self.scores[:, -1]) & (most > -np.inf))
        s = np.concatenate([self.scores[hit], scores[hit]], axis=1)
        i = np.concatenate([self.ids[hit], np.broadcast_to(ids, (len(hit), len(ids)))], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[hit], self.ids[hit] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of all that was kept."""
        at = self.scores > -np.inf
        return np.nonzero(at)[0], self.ids[at] if self.ids is not None else np.zeros(0, np.int64), self.scores[at]


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of that length without nulls, in double precision, and where they stand."""
    good = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dimension)
    taken = column.take(pa.array(good, pa.int64()))
    flat = taken.flatten()
    if flat.null_count:
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dimension).any(axis=1)
        good = good[whole]
        flat = column.take(pa.array(good, pa.int64())).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), dimension), good


def exact_scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """By query and row; 0 where a cosine has a vector without length."""
    if metric == "L2":
        return np.stack([-((x - row) ** 2).sum(axis=1) for row in q]) + 0.0
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return np.where(n == 0, 0.0, (q @ x.T) / np.where(n == 0, 1.0, n))


def _blocks(queries: DataFrame, on: str | None) -> Iterator[tuple[list, np.ndarray, list]]:
    """Ids, vectors and values of on of the queries, block by block: the driver holds one at a time, of a size that was checked."""
    q = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"), *([on] if on else []))
    n, least, most = q.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not n:
        return
    if least != most:
        raise DimensionError(f"queries of {least} to {most}")
    count = -(-n * most * 8 // QUERY_BLOCK_BYTES)
    for b in range(count):
        t = q.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == b).toArrow()
        if t.num_rows:
            v = t.column("vector").combine_chunks()
            yield t.column("query_id").to_pylist(), v.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, most), t.column(on).to_pylist() if on else []


def _search(queries: DataFrame, rows: DataFrame, columns: list[str], k: int, on: str | None, scorer: Callable, digits: int | None) -> DataFrame:
    """(query_id, id, score, rank) of the k best under scorer(vectors of queries) -> (batch -> scores of the rows that have one, where they are)."""
    kinds = [("query_id", queries.schema["query_id"].dataType), ("id", rows.schema["id"].dataType), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(*x) for x in kinds])
    spark, parts = rows.sparkSession, []
    needed = rows.where("id IS NOT NULL").select("id", *columns, *([on] if on else []))
    for names, vectors, values in _blocks(queries, on):
        block = spark.sparkContext.broadcast((names, vectors, values))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors, values = block.value
            best, score = Best(len(names), k), scorer(vectors)
            step = max(1, SCORES // len(names))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    s, good = score(b)
                    s = np.where(np.isfinite(s), s if digits is None else np.round(s, digits), -np.inf)
                    if on:
                        own = np.array(b.column(on).to_pylist(), dtype=object)[good]
                        s = np.where([[v is not None and v == w for w in own] for v in values], s, -np.inf)
                    if len(good):
                        best.add(s, np.array(b.column(0).take(pa.array(good)).to_pylist()))
            at, ids, s = best.found()
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], kind[0]), pa.array(ids.tolist(), kind[1]), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

        kind = [{T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}[type(schema[i].dataType)] for i in (0, 1)]
        parts.append(needed.mapInArrow(run, schema))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): k rows a query, the highest scores, the lowest ids at ties."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def knn(queries: DataFrame, rows: DataFrame, k: int, metric: str = "COSINE", on: str | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k best rows (id, vector) for each query (query_id, vector), also within equal values of column on.

    Every row meets every query, block by block of queries; a task keeps k rows a query. Scores have six digits. Rows whose vector is
    null, of another length or holds a null, rows without an id, and scores that aren't finite are left out; null values of on are
    equal to nothing. Queries of several lengths raise DimensionError; no queries or no rows: no result.
    """

    def scorer(q: np.ndarray):
        def f(b: pa.RecordBatch):
            x, good = _matrix(b.column("vector"), q.shape[1])
            return exact_scores(q, x, metric), good

        return f

    return _search(queries, rows, ["vector"], k, on, scorer, 6)


def ann_knn(queries: DataFrame, rows: DataFrame, k: int, metric: str, books: list[np.ndarray], rerank: int, graph: bool | DataFrame = False, n: int | None = None) -> DataFrame:
    """knn over the rerank candidates that quantized scores find for each query; rows: (id, sequence, vector, norm, codes).

    With graph, the candidates are those of beams of width rerank through the graphs of all shards of the n rows: stored ones (ann.build_graphs),
    or True to build them for this search. Candidates, rerank of them a query, join their vectors; then exact scores decide.
    """
    dimension = sum(b.shape[1] for b in books)

    def scorer(q: np.ndarray):
        tables = [np.stack(x) for x in zip(*(lookup(row, books, metric) for row in q))]
        norms = np.linalg.norm(q, axis=1)[:, None]

        def f(b: pa.RecordBatch):
            codes = np.array(b.column("codes").to_pylist(), dtype=np.int64).reshape(b.num_rows, len(books))
            s = sum(t[:, codes[:, i]] for i, t in enumerate(tables))
            if metric == "COSINE":
                n = norms * b.column("norm").to_numpy(zero_copy_only=False).astype(np.float64)[None, :]
                s = np.where(n == 0, 0.0, s / np.where(n == 0, 1.0, n))
            return s, np.arange(b.num_rows)

        return f

    if graph is not False:
        if graph is True:
            graph = build_graphs(sharded(rows.select("id", "sequence", "vector"), rows.count() if n is None else n), metric, books)
        kinds = T.StructType([queries.schema["query_id"], rows.schema["id"], T.StructField("approx", T.DoubleType()), T.StructField("visited", T.LongType())])
        parts = [beams(graph, list(zip(names, vectors)), rerank, books, metric, queries.schema["query_id"]) for names, vectors, _ in _blocks(queries, None)]
        found = reduce(DataFrame.unionByName, parts) if parts else rows.sparkSession.createDataFrame([], kinds)
        near = ranked(found.select("query_id", "id", F.col("approx").alias("score")), rerank)
    else:
        near = _search(queries, rows, ["codes", "norm"], rerank, None, scorer, None)
    q = queries.select("query_id", F.col("vector").alias("q"))
    pairs = near.select("query_id", "id").join(rows.select("id", "vector"), "id").join(q, "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, x = (np.array(b.column(c).to_pylist(), dtype=np.float64).reshape(b.num_rows, dimension) for c in ("q", "vector"))
            if metric == "L2":
                s = -((a - x) ** 2).sum(axis=1) + 0.0
            else:
                size = np.linalg.norm(a, axis=1) * np.linalg.norm(x, axis=1)
                s = np.where(size == 0, 0.0, (a * x).sum(axis=1) / np.where(size == 0, 1.0, size))
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(np.round(s, 6))], names=["query_id", "id", "score"])

    schema = T.StructType([pairs.schema["query_id"], pairs.schema["id"], T.StructField("score", T.DoubleType())])
    return ranked(pairs.select("query_id", "id", "q", "vector").mapInArrow(exact, schema), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): which share of exact's rows (query_id, id) found has too."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1.0).alias("hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def tuned_rerank(queries: DataFrame, rows: DataFrame, k: int, metric: str, books: list[np.ndarray], start: int, n: int, least: float = 0.9, graph: bool | DataFrame = False, sample: int = 64) -> int:
    """How many candidates a query needs for that recall: start, doubled until sample queries (the first by a hash) reach it against exact search.

    As many candidates as rows are exact. rows: (id, sequence, vector, norm, codes). The sample is bounded, the rows are all of them.
    """
    few = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    truth = knn(few, rows.select("id", "vector"), k, metric).select("query_id", "id").collect()  # sample * k rows
    if not truth:
        return start
    spark = rows.sparkSession
    exact = spark.createDataFrame(truth, queries.sparkSession.createDataFrame([], few.select("query_id").schema.add(rows.schema["id"])).schema)
    size = max(1, start)
    while size < n:
        if recall(ann_knn(few, rows, k, metric, books, size, graph, n), exact).agg(F.avg("recall")).first()[0] >= least:
            break
        size *= 2
    return min(size, max(n, start))
