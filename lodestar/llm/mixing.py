"""Mix sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import staged

#: Bands of the rank in a source, at each of two levels. Sums by band find where a source's sample ends.
BANDS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII blanks; null has none."""
    blank = r"[\x20\x09-\x0D]"
    cut = F.size(F.split(text, blank + "+")) - text.rlike("^" + blank).cast("int") - text.rlike(blank + r"\z").cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(cut).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(key, source_size, target) of each source of sized (key, source, size).

    Sources in code point order, null last, weigh as weights say, repeating; together their targets are all sizes. A
    target ends at cap times its source's size, and what is over goes to the others by weight. That is filling vessels to
    one level: those full at the level are the first ones when ordered by cap over weight. If all but the first few were open, the level would
    be what is left over their weights; past the true number of full ones that only falls, so the largest that leaves its first open one open is it.
    """
    s = sized.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    w = w.withColumn("most", F.col("source_size") * cap)
    by = Window.orderBy(F.col("most") / F.col("w"), "source", "key")
    everything = Window.partitionBy()
    w = w.withColumns({
        "full": F.sum("most").over(by) - F.col("most"), "open": F.sum("w").over(everything) - F.sum("w").over(by) + F.col("w"), "total": F.sum("source_size").over(everything),
    })
    w = w.withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open"))
    level = F.max(F.when(F.col("most") / F.col("w") > F.col("level"), F.col("level"))).over(everything)
    return w.withColumn("level", level).select("key", "source_size", F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("most").cast("double"))).alias("target"))


def _crossing(rows: DataFrame, band: str, base: Column) -> DataFrame:
    """(key, band, base) where the sum of a source's bands first exceeds what it still takes; one row for a source at most."""
    sums = rows.groupBy("key", band).agg(F.sum("size").alias("size"), F.min("rest").alias("rest"), F.min(base).alias("base"))
    after = F.col("base") + F.sum("size").over(Window.partitionBy("key").orderBy(band))
    return sums.withColumn("after", after).where((F.col("after") > F.col("rest")) & (F.col("after") - F.col("size") <= F.col("rest"))).groupBy("key").agg(F.min(band).alias(band), F.min(F.col("after") - F.col("size")).alias("base"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row: how often the mix takes it, and how many words that is.

    A source's ratio of target to size has a whole part, the copies that every document gets, and a fraction, the
    inclusion probability p of one copy more. For that copy documents are ranked by odds(u) / odds(p) with u a
    fixed random number of the document; the lowest ranks are taken as long as half of a document still fits, so each source is
    within half a document of its target and reruns agree. The end of the sample is found by sums over bands of the
    rank, twice; only documents in one of 2^24 bands are ever sorted, so no source gathers in one task.

    Null texts have size 0. The random number is that of id and text, so null ids and repeated ones are spread as well; rows alike in both share
    one, and which of them are taken is left open (repeated rows may get different copies). Texts are read whole, of any length. Null sources are one source. An empty df gives an empty result. Extra
    columns are ignored. Sources are gathered in one task, one row each, as their weights depend on their order.
    """
    d = F.col(f"`{doc_id}`")
    rows = df.select(d.alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), F.col(f"`{text}`").alias("x"))
    random = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("x", F.lit("")).cast("binary"))).cast("binary")), 1, 13), 16, 10).cast("long")
    rows = rows.select("doc_id", "source", "size", random.alias("random"))
    random = F.col("random")
    rows = rows.withColumns({"key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "u": (random.cast("double") + 0.5) / float(1 << 52)})
    rows = staged(rows, "mixing-sizes")
    plan = targets(rows, weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio).cast("long")).withColumns({"p": ratio - F.col("whole"), "rest": F.col("target") - F.col("whole") * F.col("source_size")})
    plan = staged(plan, "mixing-targets")
    rank = (F.col("u") * (1 - F.col("p"))) / ((1 - F.col("u")) * F.col("p"))
    ranked = rows.join(plan, "key").withColumn("rank", F.when(F.col("p") > 0, rank).otherwise(F.lit(float("inf"))))
    scaled = F.when(F.col("p") > 0, F.col("rank") / (1 + F.col("rank")) * BANDS).otherwise(F.lit(float(BANDS - 1)))
    ranked = ranked.withColumn("scaled", scaled).withColumn("b1", F.least(F.floor("scaled"), F.lit(BANDS - 1)).cast("int"))
    ranked = ranked.withColumn("b2", F.least(F.floor((F.col("scaled") - F.col("b1")) * BANDS), F.lit(BANDS - 1)).cast("int")).drop("scaled")
    one = staged(_crossing(ranked.where("p > 0"), "b1", F.lit(0).cast("long")).select("key", F.col("b1").alias("e1"), F.col("base").alias("base1")), "mixing-first")
    within = ranked.join(one, "key").where("b1 = e1")
    two = staged(_crossing(within, "b2", F.col("base1")).select("key", F.col("b2").alias("e2"), F.col("base").alias("base2")), "mixing-second")
    placed = ranked.join(one.join(two, "key", "left"), "key", "left")
    at_end = (F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2"))
    before = (F.col("p") > 0) & (F.col("e1").isNull() | (F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("e2").isNull() | (F.col("b2") < F.col("e2")))))
    clear = placed.where(~F.coalesce(at_end, F.lit(False))).withColumn("more", before)
    upto = F.col("base2") + F.sum("size").over(Window.partitionBy("key").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0))
    close = placed.where(at_end).withColumn("more", 2 * upto - F.col("size") <= 2 * F.col("rest"))
    copies = (F.col("whole") + F.coalesce(F.col("more"), F.lit(False)).cast("long")).alias("copies")
    out = clear.unionByName(close).select("doc_id", "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("size") * F.col("copies"))


#: The contract's query for DuckDB; the sum over ranks is one window there.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS most FROM sources),
filled AS (
  SELECT *, sum(most) OVER o - most AS full_before, sum(w) OVER () - sum(w) OVER o + w AS open_w, sum(source_size) OVER () AS total
  FROM weighed WINDOW o AS (ORDER BY most::DOUBLE / w, source NULLS FIRST ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, (total - full_before)::BIGINT::DOUBLE / open_w::BIGINT AS own FROM filled),
level AS (SELECT max(own) AS level FROM levels WHERE most::DOUBLE / w > own),
plan AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce(level * w, most::DOUBLE)) AS target,
         CASE WHEN source_size > 0 THEN least(most::DOUBLE, coalesce(level * w, most::DOUBLE)) / source_size ELSE 0.0 END AS ratio
  FROM levels, level),
ranked AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, s.source, floor(ratio)::BIGINT AS whole, ratio - floor(ratio)::BIGINT AS p, u,
         target - floor(ratio)::BIGINT * source_size AS rest
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u * (1 - p)) / ((1 - u) * p) ELSE 0 END, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM ranked)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN p > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed
"""
