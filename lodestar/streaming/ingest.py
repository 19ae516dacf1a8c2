"""Streams of JSON lines into a collection, and the latest state of a stream of mutations."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.codecs import CodecError, parse_lines

#: Records of one commit of a streamed upsert.
CHUNK = 512


def ingest_lines(spark: SparkSession, path: str, collection, checkpoint: str, trigger: dict | None = None):
    """Start a query that upserts each micro-batch of JSON line files under path; a batch is committed as a whole, or not at all.

    The number of the last batch of a checkpoint is committed with its rows, so a batch that is replayed after a failure is not applied twice.
    """
    lines = spark.readStream.text(path)
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            collection.upsert(parse_lines(batch), mark=(name, number))

    return lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upsert_chunks(collection, records, chunk: int = CHUNK) -> int:
    """Upsert an iterable of records (dicts) in commits of chunk each, with the quota checked for each; the number of records.

    It isn't atomic: chunks before a failing one stay. No records at all are an error.
    """
    held, done = [], 0
    for r in records:
        held.append(r)
        if len(held) == chunk:
            done += collection.upsert_records(held)
            held = []
    if held:
        done += collection.upsert_records(held)
    if not done:
        raise CodecError("no records")
    return done


def latest_by_key(stream: DataFrame, key: str = "id", order: str = "sequence") -> DataFrame:
    """The row of the greatest order of each key so far (complete or update mode): a lower sequence never overrides a higher one."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in rest))
