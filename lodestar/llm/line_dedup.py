"""Remove multi-line chunks that repeat anywhere in the corpus, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import staged

#: A chunk is one number: its first line times this, plus its number of lines.
_BASE = 1 << 31


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk_codes(text: Column) -> Column:
    """The chunks of a text, in order, each its first line (from 0) times 2^31 plus its number of lines.

    The rolling hash of line i is over the hashes of lines i-1 and i. A chunk begins at line i where the rolling hash is lower than that
    of the line before and not higher than that of the line after. So borders depend on the lines around them alone
    and come again wherever the lines do, and all chunks have two lines at least (a text of one line is one chunk).
    """
    lines = _lines(text)
    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    rolled = F.zip_with(hashes, F.concat(F.array(F.lit(0).cast("long")), hashes), lambda a, b: F.when(a.isNotNull(), F.xxhash64(b, a)))
    # Three neighbours at each line: the rolled hash itself, the one before, the one after (null past the ends).
    after = F.slice(rolled, 2, F.size(lines))
    before = F.concat(F.array(F.lit(None).cast("long")), rolled)
    low = F.zip_with(F.zip_with(rolled, after, lambda r, a: F.coalesce(r <= a, F.lit(False)).cast("long") + F.lit(0) * F.coalesce(r, F.lit(0))), F.zip_with(rolled, before, lambda r, b: F.coalesce(r < b, F.lit(False)).cast("long")), lambda x, y: x * y)
    n = F.size(lines)
    starts = F.filter(F.transform(low, lambda x, i: F.when((x == 1) & (i >= 2) & (i <= n - 2), i.cast("long")).otherwise(F.lit(-1).cast("long"))), lambda i: i >= 0)
    begins = F.concat(F.array(F.lit(0).cast("long")), starts)
    ends = F.concat(starts, F.array(n.cast("long")))
    return F.zip_with(begins, ends, lambda b, e: b * F.lit(_BASE) + e - b)


def _start(code: Column) -> Column:
    return F.floor(code / F.lit(_BASE)).cast("int")


def _length(code: Column) -> Column:
    return (code % F.lit(_BASE)).cast("int")


def _chunk(lines: Column, code: Column) -> Column:
    return F.array_join(F.slice(lines, _start(code) + 1, _length(code)), "\n")


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with each repeated chunk of two lines or more taken out of text wherever it isn't first; adds n_lines and n_removed.

    The first place of a chunk is that of the smallest id (null last), then hash of the text, then line. Chunks meet by a hash of their
    lines' hashes; one goes only if its bytes equal those of the first. Counts meet by the hash alone, in sums that begin before the
    shuffle; a chunk in a third of all documents is a long run of a sort-merge join, which AQE splits. A text crosses the
    network once with the firsts and once with the result.

    Rows alike in id and text are one document: they keep the same chunks. Null and empty texts stay as they are (n_lines
    0); a text of one line has no chunk to remove; of a text whose chunks all go, '' is left. Empty df: empty result. Columns
    of df named n_lines or n_removed are replaced, all others stay whatever they are named. A document's chunks are one
    array of its row.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys(df.columns)))
    rows = df.select(whole.alias("row")).select(
        "row", F.col(f"row.`{doc_id}`").alias("k1"), F.xxhash64(F.col(f"row.`{text}`")).alias("k2")
    )
    texts = rows.select("k1", "k2", F.col(f"row.`{text}`").alias("x")).where(F.col("x").contains("\n"))
    lined = texts.select("k1", "k2", F.transform(_lines(F.col("x")), lambda x: F.xxhash64(x)).alias("h"), chunk_codes(F.col("x")).alias("codes"))
    chunks = lined.select(
        "k1", "k2", F.explode(F.transform("codes", lambda c: F.struct(c.alias("code"), F.xxhash64(F.slice(F.col("h"), _start(c) + 1, _length(c))).alias("hash")))).alias("c")
    ).select("k1", "k2", "c.code", "c.hash")
    chunks = staged(chunks, "line-chunks")
    place = F.struct(F.col("k1").isNull().alias("no_id"), "k1", "k2", "code")
    firsts = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("hash", "first")
    later = chunks.join(firsts, "hash").where(place != F.col("first")).select("hash", "k1", "k2", "code")
    wanted = firsts.groupBy(F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")).agg(F.collect_list(F.struct("hash", "first.code")).alias("wanted"))
    same = (F.col("k1").eqNullSafe(F.col("f1"))) & (F.col("k2") == F.col("f2"))
    found = texts.join(wanted, same).select(F.explode(F.transform("wanted", lambda w: F.struct(w["hash"].alias("hash"), _chunk(_lines(F.col("x")), w["code"]).alias("own")))).alias("w"))
    originals = found.select("w.hash", "w.own").dropDuplicates(["hash"])
    gone = later.join(originals, "hash").groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(F.collect_list(F.struct("code", "own")).alias("gone"))
    x = F.col(f"row.`{text}`")
    lines = _lines(x)
    both = rows.join(gone, same, "left")
    equal = F.transform(F.filter("gone", lambda g: _chunk(lines, g["code"]) == g["own"]), lambda g: g["code"])
    # Rows alike in id and text name their chunks once each.
    out = both.select("row", F.when(F.col("gone").isNotNull(), F.array_distinct(equal)).alias("drop"))
    kept = F.array_join(F.transform(F.array_except(chunk_codes(x), F.col("drop")), lambda c: _chunk(lines, c)), "\n")
    fields = [F.col(f"row.`{c}`") if c != text else F.when(F.size("drop") > 0, kept).otherwise(x).alias(c) for c in dict.fromkeys(df.columns) if c.lower() not in ("n_lines", "n_removed")]
    n = F.when(x.isNull() | (x == ""), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    removed = F.coalesce(F.aggregate("drop", F.lit(0).cast("long"), lambda s, c: s + _length(c)), F.lit(0).cast("long")).alias("n_removed")
    return out.select(*fields, n, removed)


#: Bits of the bitmap that keeps texts without a wanted pair from the shuffle; a full one lets all through.
_BITS = 1 << 23


def _with_lines(text: Column, f) -> Column:
    """f of a text's lines, which are split once however often f reads them in lambdas."""
    return F.transform(F.array(_lines(text)), f)[0]


def _pair(lines: Column, i: Column) -> Column:
    return F.concat(lines[i], F.lit("\n"), lines[i + 1])


def dedup_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without each run of two lines or more that stands earlier in the corpus, wherever it begins; adds n_lines and n_removed.

    Two lines that follow each other are a pair. The first place of a pair is that of the smallest id (null last), then hash of
    the text, then line; a line goes where a pair that it belongs to isn't first (the next place in a text, which shares a line
    with the first, counts as the first). So of every repeated run all lines go, the first place of every line stays, and no
    border has to fall alike. Pairs meet by a hash of their lines' hashes; one goes only if its bytes equal those of the first.
    Counts meet by the hash alone, in sums that begin before the shuffle. What is summed is written before it is joined, so both sides of
    the join come right from a shuffle, and AQE can split the run of a pair that a third of all documents hold. A text crosses the network once with the result, and once more if it may hold a first.

    Rows alike in id and text are one document: they keep the same lines. Null and empty texts and those of one line stay as
    they are (n_lines 0 for null and empty); of a text whose lines all go, '' is left. Empty df: empty result. Columns of df
    named n_lines or n_removed are replaced, all others stay whatever they are named. A document's pairs are one array of its row.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys(df.columns)))
    rows = df.select(whole.alias("row")).select(
        "row", F.col(f"row.`{doc_id}`").alias("k1"), F.xxhash64(F.col(f"row.`{text}`")).alias("k2")
    )
    texts = rows.select("k1", "k2", F.col(f"row.`{text}`").alias("x")).where(F.col("x").contains("\n"))
    hashes = F.transform(_lines(F.col("x")), lambda x: F.xxhash64(x))
    paired = F.transform(F.array(hashes), lambda h: F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))[0]
    pairs = texts.select("k1", "k2", F.posexplode(paired).alias("line", "hash")).where("hash IS NOT NULL")
    pairs = staged(pairs, "line-pairs")
    place = F.struct(F.col("k1").isNull().alias("no_id"), "k1", "k2", "line")
    firsts = pairs.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("hash", "first")
    firsts = staged(firsts, "line-firsts")
    own_text = (F.col("k1").eqNullSafe(F.col("first.k1"))) & (F.col("k2") == F.col("first.k2"))
    wanted = staged(firsts.groupBy(F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")).agg(F.collect_list(F.struct("hash", "first.line")).alias("wanted")), "line-wanted")
    # The texts with a first, by one bit of their hash.
    bit = lambda k: F.pmod(k, F.lit(_BITS))
    word = lambda k: F.floor(bit(k) / 64)
    bits = firsts.groupBy(word(F.col("first.k2")).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(first.k2, {_BITS}) % 64 AS int))")).alias("bits"))
    may = texts.join(F.broadcast(bits), word(F.col("k2")) == F.col("word")).where(F.expr(f"(bits & shiftleft(1L, cast(pmod(k2, {_BITS}) % 64 AS int))) <> 0")).select("k1", "k2", "x")
    same = (F.col("k1").eqNullSafe(F.col("f1"))) & (F.col("k2") == F.col("f2"))
    own = _with_lines(F.col("x"), lambda l: F.transform("wanted", lambda w: F.struct(w["hash"].alias("hash"), _pair(l, w["line"]).alias("own"))))
    originals = may.join(wanted, same).select(F.explode(own).alias("w")).select("w.hash", "w.own").dropDuplicates(["hash"])
    firsts = staged(firsts.join(originals, "hash"), "line-originals")
    later = pairs.join(firsts, "hash").where(~(own_text & F.col("line").isin(F.col("first.line"), F.col("first.line") + 1)))
    # Rows alike in id and text name the same lines: a set holds them once, already before the shuffle.
    gone = staged(later.groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(F.collect_set(F.struct("line", "own")).alias("gone")), "line-gone")
    x = F.col(f"row.`{text}`")
    both = rows.join(gone, same, "left")
    equal = _with_lines(x, lambda l: F.flatten(F.transform(F.filter("gone", lambda g: _pair(l, g["line"]) == g["own"]), lambda g: F.array(g["line"], g["line"] + 1))))
    out = both.select("row", F.when(F.col("gone").isNotNull(), F.array_distinct(equal)).alias("drop"))
    kept = _with_lines(x, lambda l: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), F.col("drop")), lambda i: l[i]), "\n"))
    fields = [F.col(f"row.`{c}`") if c != text else F.when(F.size("drop") > 0, kept).otherwise(x).alias(c) for c in dict.fromkeys(df.columns) if c.lower() not in ("n_lines", "n_removed")]
    n = F.when(x.isNull() | (x == ""), 0).otherwise(F.size(_lines(x))).cast("long").alias("n_lines")
    removed = F.when(F.size("drop") > 0, F.size("drop")).otherwise(0).cast("long").alias("n_removed")
    return out.select(*fields, n, removed)
