"""Near-duplicate vectors: spherical k-means cells, blocked cosine products in each, groups by links."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import claim, small_batches, staged
from lodestar.llm.components import components
from lodestar.llm.tiles import groups

#: Vectors of a cell aimed at, rows of a block, and the bytes of the sample that k-means reads at most.
CELL, BLOCK, SAMPLE_BYTES = 8192, 2048, 10 << 20
MOST_CELLS, ROUNDS = 1024, 10


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centroids of the unit rows of x; begins at rows evenly apart, an empty cell keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(np.int64)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def cells(x: np.ndarray, centroids: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit row, the nearest cell, and which other cells it visits: of two rows linked across cells, one visits the other's cell.

    Rows that link are at most d = sqrt(2 - 2 cosine) apart. If x is nearest to centroid h and y to c, then (h - c).x >= 0 >= (h - c).y,
    and (h - c).(x - y) <= |h - c| d; so one of the two is at most half of that from the plane between, and only such rows visit.
    """
    dots = x @ centroids.T
    home = dots.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T)) * math.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + 1e-9
    visits = dots[np.arange(len(x)), home][:, None] - dots <= apart[home]
    visits[np.arange(len(x)), home] = False
    return home, visits


def dedup_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: vectors with equal labels link at the given cosine or more.

    Equal vectors of a label are one with a count, from before any shuffle. Each other meets the vectors of its own
    cell and of the cells that it visits, so that no link is lost (and none counted twice). A label has as many cells, a power of four up to MOST_CELLS,
    as its number of vectors needs for about CELL in each; one that has no more than that is one cell, without any visits. The centroids come
    from a sample of SAMPLE_BYTES at most. A cell larger than a block is dealt in pairs of blocks, each a matrix
    product in double precision; a block pair reports sums and a spanning forest, not pairs.

    Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or id, link with nothing: n_links
    0, component their own id, kept (null ids: component and kept null). Vectors of different lengths don't link. Repeated
    rows are other vectors to each other. Empty df: empty result. Extra columns are ignored.
    """
    spark = df.sparkSession
    v = F.col(f"`{embedding}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & (most > 0), F.lit(False))
    rows = rows.withColumns({"h1": F.when(good, F.xxhash64("label", "v")), "h2": F.when(good, F.xxhash64(F.lit(1), "v", "label"))})
    unique = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    unique = staged(unique.withColumn("group", F.xxhash64("label", F.size("v"))).select("h1", "h2", "id", "n", "group", "v"), "vectors")
    wide = unique.groupBy("group").agg(F.count("*").alias("k"), F.first(F.size("v")).alias("d")).where(F.col("k") > CELL)
    steps = F.ceil(F.log2(F.col("k") / CELL) / 2).cast("int")
    wide = staged(wide.select("group", "d", F.least(steps, F.lit(int(math.log(MOST_CELLS, 4) + 0.5))).alias("level")), "wide-groups")
    levels = {r[0]: r[1] for r in wide.groupBy("d").agg(F.max("level"), F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(16).collect()}
    counts = {r[0]: r[1] for r in unique.groupBy(F.size("v").alias("d")).count().where(F.col("d").isin(list(levels))).collect()} if levels else {}
    centroids = {}
    for d, most in levels.items():
        take = max(64, SAMPLE_BYTES // (8 * d))
        place = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) / float(1 << 30)
        sample = unique.where((F.size("v") == d) & (place < take / counts[d])).select("v", "h1").orderBy("h1").limit(2 * take).toArrow()
        x = _unit(_matrix(sample.column("v").combine_chunks())) if sample.num_rows else np.zeros((0, d))
        for level in range(1, most + 1) if len(x) else ():
            centroids[d, level] = spherical_kmeans(x, 4**level)
    shared = spark.sparkContext.broadcast(centroids)

    def dealt(batches):
        claim("embedding_dedup")
        for b in batches:
            ids, n, group = b.column("id").to_numpy(), b.column("n").to_numpy(), b.column("group").to_numpy()
            lists = b.column("v")
            length, level = lists.value_lengths().to_numpy(), b.column("level").to_numpy()
            for d, own in np.unique(np.stack([length, level]), axis=1).T.tolist():
                at = np.flatnonzero((length == d) & (level == own))
                x = _unit(_matrix(lists.take(pa.array(at))))
                if (d, own) in shared.value:
                    home, visits = cells(x, shared.value[d, own], cosine)
                else:
                    home, visits = np.zeros(len(x), np.int64), np.zeros((len(x), 1), bool)
                row, cell = np.nonzero(visits)
                row, cell = np.append(np.arange(len(x)), row), np.append(home, cell)
                seen = np.packbits(visits, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group[at][row]), pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), pa.array([seen[r].tobytes() for r in row], pa.binary()), pa.array(ids[at][row]), pa.array(n[at][row]), pa.array([x[r].tobytes() for r in row], pa.binary())],
                    names=["group", "cell", "home", "visits", "id", "n", "v"],
                )

    schema = "group bigint, cell int, home int, visits binary, id bigint, n bigint, v binary"
    levelled = unique.join(wide.select("group", "level"), "group", "left").select("id", "n", "group", "v", F.coalesce("level", F.lit(0)).alias("level"))
    with small_batches(spark, 4_096):
        members = staged(levelled.mapInArrow(dealt, schema), "cells")
    counts = staged(members.groupBy("group", "cell").agg(F.count("*").alias("k")).where(F.col("k") > 1).select("group", "cell", F.ceil(F.col("k") / BLOCK).cast("int").alias("k")), "cell-blocks")
    m = members.join(counts, ["group", "cell"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
    m = m.select("*", other).select(F.xxhash64("group", "cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"), "cell", "home", "visits", "id", "n", "v")

    def linked(batches):
        claim("embedding_dedup")
        for t in groups(batches, "tile"):
            ids, n, home, cell = (t.column(c).to_numpy() for c in ("id", "n", "home", "cell"))
            left, right = (np.array(t.column(c).to_pylist(), dtype=bool) for c in ("left", "right"))
            x = np.frombuffer(b"".join(t.column("v").to_pylist()), dtype=np.float64).reshape(len(ids), -1)
            visits = np.unpackbits(np.frombuffer(b"".join(t.column("visits").to_pylist()), dtype=np.uint8).reshape(len(ids), -1), axis=1).astype(bool)
            mine = home == cell
            found, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
            a, b = np.flatnonzero(left), np.flatnonzero(right)
            same = bool((left & right).any())

            def here(i, j):
                """Whether rows i at home count visitors j here: not where i visits them as well and their cell comes first."""
                return mine[i][:, None] & ~mine[j][None, :] & (~visits[i][:, home[j]] | (cell[i][:, None] < home[j][None, :]))

            for at in range(0, len(a), 512):
                rows_ = a[at : at + 512]
                close = x[rows_] @ x[b].T >= cosine
                if not mine.all():
                    close &= (mine[rows_][:, None] & mine[b][None, :]) | here(rows_, b) | here(b, rows_).T
                close &= rows_[:, None] != b[None, :]
                found[rows_] += close @ n[b]
                if not same:
                    found[b] += n[rows_] @ close
                for i in np.flatnonzero(close.any(axis=1)):
                    own = np.unique(np.append(labels[b[close[i]]], labels[rows_[i]]))
                    if len(own) > 1:
                        labels[np.isin(labels, own)] = own[0]
            away = np.flatnonzero(labels != np.arange(len(ids)))
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[some], ids[away]])), pa.array([None] * len(some) + ids[labels[away]].tolist(), pa.int64()), pa.array(np.concatenate([found[some], np.zeros(len(away), np.int64)]))], names=["a", "b", "n"]
            )

    with small_batches(spark, 4_096):
        links = staged(m.repartition("tile").sortWithinPartitions("tile").mapInArrow(linked, "a bigint, b bigint, n bigint"), "vector-links")
    joined = components(links.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "id"})
    direct = links.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    found = unique.select("h1", "h2", F.col("id"), "n").join(direct, "id", "left").join(joined, "id", "left")
    found = found.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; first over their largest component, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: The contract's query for DuckDB, over all pairs of a label.
SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
direct AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(l.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN direct d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""
