import random

from pyspark.sql import functions as F

from lodestar.llm import line_dedup


def brute(rows):
    """Text by (id, text) without the lines of each pair of lines that stands earlier, and not one line before in the same text."""
    first, out = {}, {}
    for i, t in rows:
        if t is None or (i, t) in out:
            continue
        lines, drop = t.split("\n"), set()
        for k in range(len(lines) - 1):
            at = first.setdefault((lines[k], lines[k + 1]), (i, t, k))
            if at[:2] != (i, t) or at[2] not in (k, k - 1):
                drop |= {k, k + 1}
        out[i, t] = "\n".join(x for k, x in enumerate(lines) if k not in drop), len(drop)
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string").repartition(3)
    out = line_dedup.dedup_runs(df)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = {x.doc_id: (x.text, x.n_removed) for x in out.collect()}
    want = brute(rows)
    assert got == {i: (None, 0) if t is None else want[i, t] for i, t in rows}
    return got


def test_every_repeated_run_goes(spark):
    r = random.Random(4)
    pool = [[f"line {r.random()}" for _ in range(r.randint(1, 12))] for _ in range(12)]
    rows = [(i, "\n".join(sum((r.choice(pool) if r.random() < 0.6 else [f"own {r.random()}"] for _ in range(r.randint(0, 9))), []))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "one line"), (903, "same\n" * 500), (904, "\n\n\n"), (905, "a\na\na"), (906, "one line")]
    got = check(spark, rows)
    assert got[903] == ("same\nsame\n", 498) and got[902][0] == got[906][0] == "one line"
    assert line_dedup.dedup_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_and_three_repeated_lines_between_own_ones_go(spark):
    """The borders of chunks fall inside few of such short runs."""
    rows = [(k, f"a{k}\nb{k}\nc{k}\nd{k}") for k in range(40)]
    rows += [(100 + k, f"own {k}\na{k}\nb{k}\n" + (f"c{k}\n" if k % 2 else "") + f"end {k}") for k in range(40)]
    got = check(spark, rows)
    assert all(got[100 + k] == (f"own {k}\nend {k}", 2 + k % 2) for k in range(40))


def test_runs_of_repeated_rows_and_nulls(spark):
    first, tail = "\n".join(f"shared {k}" for k in range(40)), "\nown a\nown b"
    rows = [(1, first), (2, first + tail), (2, first + tail), (2, first + tail), (None, first + tail), (None, None)]
    out = line_dedup.dedup_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    twos = out.where("doc_id = 2").collect()
    assert [(x.text, x.n_removed) for x in twos] == [("own a\nown b", 40)] * 3
    assert out.where("doc_id IS NULL AND text IS NOT NULL").select("text", "n_removed").collect() == [("", 42)]


def test_runs_of_the_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(x) for x in docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()]
    want = brute(rows)
    got = line_dedup.dedup_runs(docs).collect()
    before = dict(rows)
    assert len(got) == len(rows) and all(x.text is None or (x.text, x.n_removed) == want[x.doc_id, before[x.doc_id]] for x in got)


def test_many_alike_rows_without_an_id(spark):
    text = "\n".join(f"line {k}" for k in range(42))
    rows = spark.range(10_000).selectExpr("cast(null as long) doc_id", f"'{text}' text").unionByName(spark.createDataFrame([(1, text + "\nown")], "doc_id long, text string"))
    got = line_dedup.dedup_runs(rows).groupBy("doc_id", "text", "n_removed").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, text + "\nown", 0, 1), (None, "", 42, 10_000)], key=str)


def test_a_hot_pair_is_split(spark):
    """The join of the pairs reads both sides right from a shuffle, which AQE needs to split a run."""
    rows = spark.range(3_000).selectExpr("id doc_id", "concat('own ', id, '\\nshared a\\nshared b\\nshared c\\nend ', id) text")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.enabled")}
    out = line_dedup.dedup_runs(rows).where("doc_id > 0").agg(F.sum("n_removed"), F.max("n_removed"), F.min("n_removed")).first()
    assert tuple(out) == (3 * 2_999, 3, 3) and before
