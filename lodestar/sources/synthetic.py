"""Deterministic vectors, payloads and filters for load tests, as expressions of a row's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def vector_for(i: Column, dimension: int) -> Column:
    """1 at i mod d, and three smaller weights at places that follow from i; weights that meet add up."""
    def at(place: Column, weight: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.when(k == place.cast("int"), weight).otherwise(F.lit(0.0)))

    # Fixed values of the generator: places and weights.
    parts = [(i % dimension, F.lit(1.0)), ((i * 7 + 3) % dimension, F.lit(0.35)), ((i * 11 + 5) % dimension, F.lit(0.2)), ((i * 13 + 1) % dimension, (i % 5 + 1) / 20.0)]
    out = at(*parts[0])
    for p in parts[1:]:
        out = F.zip_with(out, at(*p), lambda a, b: a + b)
    return F.transform(out, lambda x: x.cast("float"))


def payload_for(i: Column, groups: int = 64) -> Column:
    """JSON text with bucket, source, path, section and group."""
    g = max(1, groups)
    return F.to_json(F.struct(
        (i % 1024).alias("bucket"), F.concat(F.lit("repo-"), (i % g).cast("string")).alias("source"), F.concat(F.lit("docs/"), i.cast("string"), F.lit(".md")).alias("path"),
        (i % 12).alias("section"), F.concat(F.lit("g-"), (i % g).cast("string")).alias("group"),
    ))


def filter_for(i: int, groups: int = 64) -> dict:
    """The filter that leaves the rows of i's group."""
    return {"group": f"g-{i % max(1, groups)}"}


def vectors(spark: SparkSession, n: int, dimension: int, groups: int = 64) -> DataFrame:
    """(id, vector, payload, pos) of rows 0 to n - 1."""
    i = F.col("pos")
    return spark.range(n).withColumnRenamed("id", "pos").select(F.concat(F.lit("vec-"), i.cast("string")).alias("id"), vector_for(i, dimension).alias("vector"), payload_for(i, groups).alias("payload"), "pos")
