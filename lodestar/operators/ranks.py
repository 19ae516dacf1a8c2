"""Nearest-rank percentiles of large groups, by counts over bands of the values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bands of a group's values, at each of two levels.
BANDS = 4096


def nearest_ranks(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column for each of shares): the value at place ceil(n * share) of each group's values in order; nulls and NaN don't count.

    Counts by band say in which band a place lies, then in which band within that one; only the values there are sorted. So no task holds
    a group, unless a 2^24th of its range does. Groups without values are left out; null is a group.
    """
    rows = df.select(F.struct(F.col(key).alias("k")).alias("key"), F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("share")) for n, p in shares.items()))).alias("w")
    spans = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    banded = rows.join(spans.select("key", "low", "high"), "key")

    def band(low, high):
        width = (F.col(high) - F.col(low)) / BANDS
        return F.when(width > 0, F.least(F.floor((F.col("x") - F.col(low)) / width), F.lit(BANDS - 1))).otherwise(0).cast("int")

    places = spans.select("key", "n", wanted).select("key", F.col("w.name").alias("name"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("w.share"))).cast("long").alias("place"))

    def crossing(counts: DataFrame, places: DataFrame, by: list[str], band_: str) -> DataFrame:
        """places with the band that each lies in, and its place within."""
        upto = F.sum("c").over(Window.partitionBy(*by).orderBy(band_))
        sums = counts.withColumn("upto", upto)
        found = places.join(sums, by).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("c") < F.col("place")))
        return found.withColumn("place", F.col("place") - (F.col("upto") - F.col("c"))).drop("upto", "c")

    banded = banded.withColumn("b1", band("low", "high"))
    first = crossing(banded.groupBy("key", "b1").agg(F.count("*").alias("c")), places, ["key"], "b1")
    needed = first.select("key", "b1").distinct()
    inner = banded.join(needed, ["key", "b1"], "left_semi")
    spans2 = inner.groupBy("key", "b1").agg(F.min("x").alias("low2"), F.max("x").alias("high2"))
    inner = inner.select("key", "b1", "x").join(spans2, ["key", "b1"]).withColumn("b2", band("low2", "high2"))
    second = crossing(inner.groupBy("key", "b1", "b2").agg(F.count("*").alias("c")), first, ["key", "b1"], "b2")
    values = inner.groupBy("key", "b1", "b2", "x").agg(F.count("*").alias("c")).join(second.select("key", "b1", "b2").distinct(), ["key", "b1", "b2"], "left_semi")
    exact = crossing(values, second, ["key", "b1", "b2"], "x")
    out = exact.groupBy("key").agg(*(F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in shares))
    return out.select(F.col("key.k").alias(key), *shares)


def nearest_rank(values, p: float) -> float:
    v = sorted(values)
    return v[max(0, math.ceil(len(v) * p) - 1)]
