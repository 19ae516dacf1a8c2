"""The latest state of a mutation log (id, sequence, kind, vector, norm, payload)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.payload import dumps, footprint, merge

LIVE, TOMBSTONE, PATCH = "LIVE", "TOMBSTONE", "PAYLOAD_PATCH"


def latest(log: DataFrame, key: str = "id", order: str = "sequence") -> DataFrame:
    """The row of the greatest order of each key. Partial maxima meet after the shuffle, so a hot key stays small."""
    rest = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
    return best.select(key, *(F.col(f"last.{c}").alias(c) for c in rest))


def versions(log: DataFrame, *columns: str) -> DataFrame:
    """(id, sequence, tombstone, columns) of the newest whole record of each id. Only these cross the shuffle, so leave vectors out."""
    whole = log.where(F.col("kind") != PATCH).select("id", "sequence", (F.col("kind") == TOMBSTONE).alias("tombstone"), *columns)
    return latest(whole)


def resolve(log: DataFrame) -> DataFrame:
    """(id, sequence, tombstone, vector, norm, payload) of each id: its newest whole record, under the patches after it in order.

    Patches of an id without a live record, or older than it, have no effect.
    """
    whole = latest(log.where(F.col("kind") != PATCH)).withColumnsRenamed({"sequence": "base"})
    patches = log.where(F.col("kind") == PATCH).select("id", "sequence", "payload")
    bases = whole.where(F.col("kind") == LIVE).select("id", F.col("base").alias("sequence"), "payload").join(patches.select("id").distinct(), "id", "left_semi")
    folded = folded_patches(bases.withColumn("whole", F.lit(True)).unionByName(patches.withColumn("whole", F.lit(False))))
    out = whole.join(folded.withColumnsRenamed({"sequence": "patched", "payload": "merged"}), "id", "left")
    return out.select("id", F.coalesce("patched", "base").alias("sequence"), (F.col("kind") == TOMBSTONE).alias("tombstone"), "vector", "norm", F.coalesce("merged", "payload").alias("payload"))


def folded_patches(rows: DataFrame) -> DataFrame:
    """(id, sequence, payload) of each id whose newest whole payload has patches after it: that payload under them, in order.

    rows: (id, sequence, payload, whole). An id's rows stream through one task in order of sequence, which holds one payload at a time and no
    list of patches; payloads of records without patches aren't parsed.
    """
    kind = rows.schema["id"].dataType

    def run(batches):
        last = base = None
        sequence, patched = 0, False
        for b in batches:
            out: list[tuple] = []
            for i, at, text, whole in zip(*(b.column(c).to_pylist() for c in range(4))):
                if i != last:
                    if patched:
                        out.append((last, sequence, dumps(base)))
                    last, base, patched = i, None, False
                if whole:
                    base, patched = text, False
                elif base is not None and text is not None:
                    base = merge(base if patched else json.loads(base), json.loads(text))
                    sequence, patched = at, True
            if out:
                yield batch(out)
        if patched:
            yield batch([(last, sequence, dumps(base))])

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x) if n else pa.array(x, names_type) for n, x in enumerate(zip(*out))], names=["id", "sequence", "payload"])

    names_type = pa.string() if kind.simpleString() == "string" else pa.int64()
    ordered = rows.select("id", "sequence", "payload", "whole").repartition("id").sortWithinPartitions("id", "sequence")
    return ordered.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("sequence", T.LongType()), T.StructField("payload", T.StringType())]))


def live(state: DataFrame) -> DataFrame:
    """Tombstones hide an id only once its latest state is known, hence after resolve."""
    return state.where(~F.col("tombstone")).drop("tombstone")


def counters(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if(~F.col("tombstone")).alias("live_vector_count"), F.count_if("tombstone").alias("tombstone_count"))


def additional_live(ids: DataFrame, live_rows: DataFrame) -> DataFrame:
    """How many distinct ids aren't live yet."""
    return ids.select("id").distinct().join(live_rows.select("id"), "id", "left_anti").agg(F.count("*").alias("additional_live"))


def sized(rows: DataFrame) -> DataFrame:
    return rows.select("id", footprint(F.col("id"), F.col("payload"), F.coalesce(F.size("vector"), F.lit(0))).alias("bytes"))


#: Rows of a range that numbered aims at, and the most ranges.
RANGE_ROWS, RANGES = 1 << 12, 256


def numbered(batch: DataFrame, base: int, order: str) -> DataFrame:
    """batch with sequences base+1, base+2, ... in the given order (nulls first), without gathering it: counts by range, then places in each.

    A row's range follows from its value and bounds that were drawn once. The partitions of two runs don't do: samples, and what adaptive
    execution joins, differ between a run that counts and one that reads whole rows. batch must come out alike each time, so write it before.
    """
    n, key = batch.count(), F.col(order)
    ranges = min(RANGES, -(-n // RANGE_ROWS))
    part = F.lit(0)
    if ranges > 1:
        drawn = batch.select(order).where(key.isNotNull()).sample(min(1.0, 64 * ranges / n), 0).orderBy(order).collect()
        bounds = list(dict.fromkeys(drawn[len(drawn) * k // ranges][0] for k in range(1, ranges))) if drawn else []
        if bounds:
            part = F.size(F.filter(F.array(*(F.lit(b).cast(batch.schema[order].dataType) for b in bounds)), lambda b: b <= key))
    rows = batch.withColumn("part", part)
    sizes = {r[0]: r[1] for r in rows.groupBy("part").count().collect()} if ranges > 1 else {}
    before = F.array(*(F.lit(sum(c for p, c in sizes.items() if p < k)).cast("long") for k in range(max(sizes, default=0) + 1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return rows.withColumn("sequence", F.lit(base).cast("long") + F.element_at(before, F.col("part") + 1) + place).drop("part")
