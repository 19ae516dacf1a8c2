import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators.ranks import nearest_rank
from lodestar.operators import ann, batch, policy
from lodestar.operators.filters import FilterBuilder, FilterError, Payload, compile_filter, parse
from lodestar.operators.state import numbered, resolve

ROWS = [
    {"a": 1}, {"a": 1.0}, {"a": "1"}, {"a": None}, {}, {"a": True}, {"a": [1, "hot", None]}, {"a": {"b": 2}}, {"a": "hot stuff"}, {"a": "hot"}, {"a": {"b": {"c": "x"}}}, {"a": 10**20}, {"a": -0.5}, {"a": {}},
]


def run(spark, spec, mode):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(ROWS)], "i int, p string")
    return sorted(r[0] for r in df.where(compile_filter(spec, Payload(F.parse_json("p")), mode)).select("i").collect())


@pytest.mark.parametrize(
    ("spec", "compat", "strict"),
    [
        ({}, list(range(14)), list(range(14))),
        ({"a": 1}, [0], [0]),
        ({"a": 1.0}, [1], [1]),
        ({"a": "1"}, [2], [2]),
        ({"a": True}, [5], [5]),
        ({"a": None}, [3], [3, 4]),
        ({"a": 10**20}, [11], [11]),
        ({"a": {"$in": [1, "hot"]}}, [0, 9], [0, 9]),
        ({"a": {"$in": []}}, [], []),
        ({"a": {"$contains": "hot"}}, [6, 9], [6, 8, 9]),
        ({"a": {"$contains": 1}}, [6], [6]),
        ({"$not": {"a": "hot"}}, [i for i in range(14) if i not in (6, 9)], [i for i in range(14) if i != 9]),
        ({"a": {"b": 2}}, [7], [7]),
        ({"a.b.c": "x"}, [10], [10]),
        ({"a": {"$gt": 0}}, [0, 1, 11], [0, 1, 11]),
        ({"a": {"$gte": "1", "$lt": "i"}}, [2, 8, 9], [2, 8, 9]),
        ({"$or": [{"a": 1}, {"a": {"$lt": 0}}]}, [0, 12], [0, 12]),
        ({"a": [1, "hot", None]}, [], [6]),
    ],
)
def test_filter(spark, spec, compat, strict):
    assert run(spark, spec, "compat") == compat
    assert run(spark, spec, "strict") == strict


def test_malformed_and_built():
    for bad in ({"$and": []}, {"$or": {}}, {"$not": 1}, {"a": {"$near": 1}}, {"a": {"$in": 1}}):
        with pytest.raises(FilterError):
            parse(bad)
    b = FilterBuilder().eq("a", 1).between("b", gte=1, lt=3).is_in("c", ["x"])
    assert b.build() == {"$and": [{"a": 1}, {"b": {"$gte": 1, "$lt": 3}}, {"c": {"$in": ["x"]}}]}
    assert FilterBuilder().build() == {} and FilterBuilder().eq("a", 1).build() == {"a": 1}
    with pytest.raises(FilterError):
        FilterBuilder().between("b")


def test_log_folds_like_a_dict(spark):
    r, rows, want = random.Random(5), [], {}
    for seq in range(1, 300):
        i, kind = f"k{r.randrange(25)}", r.choice(["LIVE", "TOMBSTONE", "PAYLOAD_PATCH"])
        p = {r.choice("abc"): r.choice([1, None, {"x": seq}])}
        if kind == "LIVE":
            want[i] = {k: v for k, v in p.items()}
        elif kind == "TOMBSTONE":
            want[i] = None
        elif want.get(i) is None:
            continue
        else:
            from lodestar.functions.payload import merge

            want[i] = merge(want[i], p)
        rows.append((i, seq, kind, [1.0] if kind == "LIVE" else None, 1.0 if kind == "LIVE" else None, json.dumps(p) if kind != "TOMBSTONE" else None))
    log = spark.createDataFrame(rows, "id string, sequence long, kind string, vector array<float>, norm float, payload string").repartition(3)
    got = {x["id"]: None if x["tombstone"] else json.loads(x["payload"]) for x in resolve(log).collect()}
    assert got == want


def test_sequences_follow_the_order(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("pos")).repartition(5)
    assert [tuple(r) for r in numbered(df, 10, "pos").select("pos", "sequence").orderBy("pos").collect()] == [(i, 11 + i) for i in range(1000)]


def test_planner():
    assert policy.plan_search(700, 10).mode == "APPROXIMATE" and policy.plan_search(401, 10).mode == "EXACT"
    assert policy.plan_search(100000, 10, 9000).mode == "EXACT" and policy.plan_search(100000, 10, 50000).mode == "APPROXIMATE"
    p = policy.plan_search(100000, 10)
    assert (p.beam, p.rerank) == (64 + 8 * 17, 80)
    assert policy.plan_search(100000, 1000).beam == 768 and policy.plan_search(100000, 1000).rerank == 1000
    assert policy.should_compact(4, False, 0, 0, 10, 0) and not policy.should_compact(1, False, 999, 999, 0, 9) and policy.flush_mutations(384) == 512
    assert policy.allowed(["WRITER"], "search") and not policy.allowed(["READER"], "upsert") and nearest_rank([3, 1, 2], 0.5) == 2


def test_recall_of_codes_and_graph(spark):
    r = np.random.default_rng(2)
    x = (r.normal(size=(20, 16))[r.integers(0, 20, 700)] + 0.3 * r.normal(size=(700, 16))).astype(np.float32)
    rows = spark.createDataFrame([(str(i), i, v.tolist(), float(np.linalg.norm(v)), "{}") for i, v in enumerate(x)], "id string, sequence long, vector array<float>, norm float, payload string").cache()
    books = ann.train(rows, 16)
    for metric in ("COSINE", "L2"):
        for graph in (False, True):
            found = 0
            for q in x[:3]:
                s = x @ q / np.linalg.norm(x, axis=1) if metric == "COSINE" else -((x - q) ** 2).sum(axis=1)
                got = ann.ann_topk(ann.with_codes(rows, books), q.tolist(), 10, metric, books, 700, graph=graph).collect()
                found += len({h["id"] for h in got} & {str(i) for i in np.argsort(-s)[:10]})
            assert found >= 27, (metric, graph, found)


@pytest.mark.parametrize("names", [str, int])
def test_batch_search_against_brute_force(spark, monkeypatch, names):
    monkeypatch.setattr(batch, "QUERY_BLOCK_BYTES", 256)
    monkeypatch.setattr(batch, "SCORES", 40)
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(90, 4)), 1)
    x[5] = 0
    x[40:60] = x[30]  # ties
    rows = [(names(i), v.tolist(), i % 3 if i % 7 else None) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 4, 1), (names(900), None, 1), (names(901), [1.0], 1), (names(902), [1.0, None, 1.0, 1.0], 1)]
    kind = f"id {'string' if names is str else 'long'}, vector array<double>, label int"
    df = spark.createDataFrame(rows + odd, kind).repartition(3)
    q = spark.createDataFrame(rows[::10], kind).withColumnRenamed("id", "query_id")
    for metric, on in (("COSINE", None), ("L2", None), ("COSINE", "label")):
        want = []
        for name, v, label in rows[::10]:
            s = []
            for other, w, own in rows:
                a, b = np.array(v), np.array(w)
                size = np.linalg.norm(a) * np.linalg.norm(b)
                if on is None or (label is not None and label == own):
                    s.append((-round(float(-((a - b) ** 2).sum() if metric == "L2" else a @ b / size if size else 0.0), 6), other))
            want += [(name, other, -v + 0.0, k + 1) for k, (v, other) in enumerate(sorted(s)[:6])]
        got = [(h.query_id, h.id, h.score, h["rank"]) for h in batch.knn(q, df, 6, metric, on).collect()]
        assert sorted(got) == sorted(want)
    assert batch.knn(q.where("false"), df, 6).count() == 0 and batch.knn(q, df.where("false"), 6).count() == 0
    with pytest.raises(batch.DimensionError):
        batch.knn(df.where("id IS NOT NULL").withColumnRenamed("id", "query_id"), df, 6)


def test_recall_of_batch_search(spark):
    from lodestar.plans import registry

    rows = registry.queries()["ann_recall"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 20 and sum(r.recall for r in rows) >= 0.9 * len(rows)
    graph = registry.queries()["ann_graph_topk"](spark, "/root/testdata/sf0.01")
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    exact = batch.knn(v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), v, 10)
    assert batch.recall(graph, exact).agg(F.avg("recall")).first()[0] >= 0.9
