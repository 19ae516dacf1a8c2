"""Collections of so many rows that a batch is numbered in several ranges."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from lodestar.operators.state import numbered


@pytest.fixture(scope="module")
def embeddings(tmp_path_factory):
    """12,000 vectors, in four files; many row groups, as they come from a cluster."""
    d = tmp_path_factory.mktemp("many")
    r = np.random.default_rng(11)
    (d / "embeddings.parquet").mkdir()
    for k, ids in enumerate(np.array_split(np.arange(12_000), 4)):
        v = pa.array(r.normal(size=(len(ids), 64)).astype(np.float32).tolist(), pa.list_(pa.float32()))
        pq.write_table(pa.table({"vec_id": ids, "embedding": v, "label": pa.array(r.integers(0, 10, len(ids)), pa.int32())}), d / "embeddings.parquet" / f"{k}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["collection_compacted", "collection_filtered_search", "collection_counts", "collection_search"])
def test_collections_of_many_rows_as_by_sql(spark, embeddings, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{embeddings}/embeddings.parquet/*.parquet'")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = Counter(tuple(r) for r in queries()[name](spark, embeddings).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == Counter(con.execute(oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("order", ["id", "text", "some"])
def test_many_rows_are_numbered_once_each(spark, embeddings, order):
    """Long, string, and with nulls and ties: no row goes, and no sequence comes twice or out of order."""
    rows = spark.read.parquet(f"{embeddings}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.md5(F.col("vec_id").cast("string")).alias("text"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 999).alias("some"), "embedding")
    got = [(r.sequence, r[order], r.id, len(r.embedding)) for r in numbered(rows, 40, order).collect()]
    assert sorted(x[0] for x in got) == list(range(41, 12_041)) and {x[2] for x in got} == set(range(12_000)) and {x[3] for x in got} == {64}
    values = [x[1] for x in sorted(got)]
    assert values == sorted(values, key=lambda v: (v is not None, v if v is not None else 0))
