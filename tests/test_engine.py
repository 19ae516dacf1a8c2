"""Recovery, concurrent commits, typed payload columns, stored graphs, the client, and the load generator."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import ann, batch, payload_index, state
from lodestar.operators.filters import FilterError, Payload, check_ranges
from lodestar.operators.ranks import nearest_ranks
from lodestar.operators.search import IndexCache
from lodestar.plans.client import CallError, Client, Config
from lodestar.plans.collections import Conflict, Database, DamagedPart
from lodestar.plans.limits import Identity, Keys, Permits, RateLimiter, TooManyRequests
from lodestar.plans.metrics import Histogram, summary
from lodestar.plans.spi import ExactSearcher, Observer
from lodestar.sources import synthetic
from lodestar.sources.codecs import CodecError
from lodestar.streaming.ingest import upsert_chunks


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def rec(i, v, /, **payload):
    return {"id": i, "vector": v, "payload": payload}


def ids(hits):
    return [h["id"] for h in hits]


def axes(i, far, weight):
    v = [0.0] * 16
    v[i % 16] = 1.0
    v[(i + far) % 16] = weight
    return v


def grouped(spark, n, extra):
    """Rows 0 to n - 1 on unit axes with a payload, and the target of the compound filter."""
    rows = [(f"v{i}", axes(i, 5, 0.15), json.dumps(extra(i)), i) for i in range(n)]
    target = [0.0] * 16
    target[7], target[9] = 1.0, 0.5
    rows.append(("target", target, json.dumps({"group": "blue", "bucket": 9, "tags": ["blue", "hot", "featured"], "meta": {"region": "eu", "priority": 9}}), n))
    return spark.createDataFrame(rows, "id string, vector array<float>, payload string, pos long"), target


COMPOUND = {"$and": [
    {"group": {"$in": ["blue", "green"]}}, {"bucket": {"$gte": 8, "$lte": 10}}, {"tags": {"$contains": "featured"}},
    {"$or": [{"meta.region": "eu"}, {"meta.priority": {"$gt": 8}}]}, {"$not": {"meta.priority": {"$lt": 9}}},
]}


def test_compound_filter_over_typed_columns_is_pushed_down(spark, db):
    rows, target = grouped(spark, 320, lambda i: {"group": "red" if i % 2 else "blue", "bucket": i % 12, "tags": ["red" if i % 2 else "blue", "cold" if i % 3 else "hot"], "meta": {"region": "us" if i % 5 else "eu", "priority": i % 10}})
    plain, typed = db.create("plain", 16), db.create("typed", 16, columns=["group", "bucket", "meta.region", "meta.priority"])
    for c in (plain, typed):
        c.upsert(rows)
        c.flush()
        assert ids(db.open(c.name).search(target, 10, COMPOUND)) == ["target"]
        assert ids(c.search(target, 1, {"group": "blue"})) == ["target"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = typed.matching(typed.manifest, COMPOUND)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert "EqualTo(fields.f0.s,blue)" in pushed and "GreaterThanOrEqual(fields.f1.n,8.0)" in pushed, pushed
    assert "Exchange" not in typed.ranked(target, 5, COMPOUND)._jdf.queryExecution().executedPlan().toString()
    plain.promote("bucket")
    assert plain.compact() and plain.manifest["generations"][0]["columns"] == ["bucket"] and ids(plain.search(target, 10, COMPOUND)) == ["target"]
    # A newer version that doesn't match hides an older one that does, and the other way round.
    typed.upsert_records([rec("target", target, group="red", bucket=9), rec("v1", target, group="green", bucket=8, tags=["featured"], meta={"region": "eu", "priority": 9})])
    assert ids(typed.search(target, 10, COMPOUND)) == ["v1"]
    typed.partial_update([("v1", {"bucket": 1}), ("target", {"group": "blue", "tags": ["featured"], "meta": {"region": "eu", "priority": 9}})])
    assert ids(typed.search(target, 10, COMPOUND)) == ["target"]


def test_conditions_on_typed_columns_hold_wherever_the_filter_does(spark):
    values = ["null", "1", "1.0", "2.5", '"a"', '"b"', "true", '["a"]', '{"z":1}', "-3", '"1"']
    rows = spark.createDataFrame([(i, f'{{"a":{v},"b":{{"c":{w}}}}}') for i, (v, w) in enumerate((v, w) for v in values for w in values)] + [(999, "{}")], "id long, payload string")
    rows = rows.withColumn("fields", payload_index.fields(F.col("payload"), ["a", "b.c"])).cache()
    from lodestar.operators.filters import compile_filter

    specs = [{"a": 1}, {"a": 1.0}, {"a": "a"}, {"a": {"$in": [1, "b"]}}, {"a": {"$gt": 0, "$lt": 3}}, {"a": {"$gte": "a"}}, {"$or": [{"a": "a"}, {"b": {"c": 2.5}}]}, {"$and": [{"a": 1}, {"b.c": {"$lte": "b"}}]}]
    for spec in specs:
        first = payload_index.implied(spec, ["a", "b.c"])
        assert first is not None
        for mode in ("compat", "strict"):
            match = compile_filter(spec, Payload(F.parse_json("payload")), mode)
            assert not rows.where(match & ~F.coalesce(first, F.lit(False))).count(), spec
    for spec in ({"$not": {"a": 1}}, {"a": None}, {"a": {"$contains": "a"}}, {"x": 1}, {"$or": [{"a": 1}, {"x": 1}]}, {}):
        assert payload_index.implied(spec, ["a", "b.c"]) is None


def test_postings_answer_equalities(spark, db):
    c = db.create("docs", 2)
    c.upsert_records([rec("a", [1, 0], tags=["hot", "blue"], n=1, meta={"x": None}), rec("b", [0, 1], tags=["cold"], n=1.0), rec("c", [1, 1], n="1")])
    assert {(r.path, r.value, r.id) for r in c.postings().collect()} == {("tags", '"hot"', "a"), ("tags", '"blue"', "a"), ("n", "1", "a"), ("meta.x", "null", "a"), ("tags", '"cold"', "b"), ("n", "1.0", "b"), ("n", '"1"', "c")}
    assert c.candidates({"n": 1}) == 1 and c.candidates({"$or": [{"tags": {"$contains": "hot"}}, {"n": "1"}]}) == 2
    assert c.candidates({"$and": [{"n": 1}, {"tags": "cold"}]}) == 0 and c.candidates({"n": {"$gt": 0}}) is None and c.candidates({"$and": [{"n": 1}, {"n": {"$gt": 0}}]}) == 1


def test_range_over_another_type(spark, db):
    c = db.create("docs", 2)
    c.upsert_records([rec("a", [1, 0], n=1, s="x"), rec("b", [0, 1], n="1")])
    assert ids(c.search([1, 0], 5, {"n": {"$gt": 0}}, check_types=True)) == ["a"] and c.search([1, 0], 5, {"s": {"$gt": 0}}) == []
    with pytest.raises(FilterError, match="s holds no value"):
        c.search([1, 0], 5, {"$not": {"s": {"$gt": 0}}}, check_types=True)
    check_ranges(c.live(), {"none": {"$gt": 0}}, Payload(F.parse_json("payload")))


def parts(c, where):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(f"{c.path}/{where}") for f in fs if f.endswith(".parquet"))


def flip(path):
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 3] ^= 0xFF
    open(path, "wb").write(bytes(raw))
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


def test_recovery_ends_the_log_before_a_damaged_batch(db):
    c = db.create("docs", 3)
    c.upsert_records([rec("alpha", [1, 0, 0])])
    c.upsert_records([rec("beta", [0, 1, 0])])
    assert db.open("docs", recover=True).recovered == {"recovered_tail": False, "quarantined": [], "orphans": []}
    c.upsert_records([rec("gamma", [0, 0, 1])])
    last = c.manifest["batches"][-1]["name"]
    for f in parts(c, last):
        flip(f)
    os.makedirs(f"{c.path}/batches/orphan")
    again = db.open("docs", recover=True)
    assert again.recovered == {"recovered_tail": True, "quarantined": [last], "orphans": ["batches/orphan"]}
    assert sorted(ids(again.search([1, 1, 0], 5))) == ["alpha", "beta"] and db.files.exists(f"{c.path}/quarantine/{last}")
    again.upsert_records([rec("delta", [0, 0, 1])])
    assert len(again.search([1, 1, 0], 5)) == 3


def test_a_damaged_generation_is_made_again_from_its_batches_or_an_error(db):
    c = db.create("docs", 3)
    c.upsert_records([rec("alpha", [1, 0, 0], v=1), rec("beta", [0, 1, 0])])
    c.flush()
    for f in parts(c, "generations"):
        flip(f)
    again = db.open("docs", recover=True)
    assert again.recovered["quarantined"] and sorted(ids(again.search([1, 0, 0], 5))) == ["alpha", "beta"]
    again.flush()
    for k in range(again.KEPT + 1):  # the batches go with the versions that named them
        again.promote(f"p{k}")
    for f in parts(again, again.manifest["generations"][0]["name"]):
        flip(f)
    with pytest.raises(DamagedPart):
        db.open("docs", recover=True)


def test_a_commit_that_comes_second_is_made_again(db, monkeypatch):
    c, other = db.create("docs", 2), db.open("docs")
    seen = []
    write = type(c)._write

    def late(self, *args):
        part = write(self, *args)
        if not seen:
            seen.append(1)
            other.upsert_records([rec("b", [0, 1])])
        return part

    monkeypatch.setattr(type(c), "_write", late)
    c.upsert_records([rec("a", [1, 0])])
    m = c.manifest
    assert m["sequence"] == 2 and len(m["batches"]) == 2 and {r.id: r.sequence for r in c.live().collect()} == {"b": 1, "a": 2}
    monkeypatch.setattr(type(c), "_commit", lambda *_: False)
    with pytest.raises(Conflict):
        c.upsert_records([rec("c", [1, 0])])
    assert len(os.listdir(f"{c.path}/batches")) == 2


def test_point_lookup_and_replaced_parts_stay_for_readers(spark, db):
    c = db.create("docs", 2)
    c.upsert_records([rec("a", [1, 0], v=1), rec("b", [0, 1])])
    before = c.live()
    c.flush()
    c.compact()
    assert before.count() == 2  # a reader that began before
    assert c.get("a", "nobody") == {"a": {"id": "a", "sequence": 1, "vector": [1.0, 0.0], "payload": '{"v":1}'}}
    c.delete(["a"])
    assert c.get("a") == {}


def test_stored_graphs_are_searched_without_building_again(spark, db, monkeypatch):
    c = db.create("many", 16)
    c.upsert(synthetic.vectors(spark, 900, 16))
    q = [float(x) for x in c.get("vec-17")["vec-17"]["vector"]]
    db.trace = True
    first = c.search(q, 10, approximate=True)
    assert c.last_search["mode"] == "APPROXIMATE" and c.last_search["reranked"] >= 10 and c.last_search["scored"] and not c.last_search["index_cache_hit"]
    monkeypatch.setattr(ann, "build_graphs", None)
    again = db.open("many")
    again.cache.size = 0
    assert ids(again.search(q, 10, approximate=True)) == ids(first) and again.last_search["index_cache_hit"]
    assert ids(c.search(q, 1, searcher=ExactSearcher())) == ids(c.search(q, 1))
    c.close()
    assert not db.indexes.entries


def test_index_cache_frees_the_coldest_within_its_budget():
    class Frame:
        freed = 0

        def unpersist(self):
            Frame.freed += 1

    cache = IndexCache(budget=100, most=2)
    hits = [cache.get(path, weight, lambda: [Frame()])[1] for path, weight in (("a", 60), ("b", 60), ("b", 60), ("a", 60), ("c", 500))]
    assert hits == [False, False, True, False, False]
    assert list(cache.entries) == ["c"] and Frame.freed == 3


def test_graph_of_many_rows_keeps_its_recall(spark):
    """Stored graphs of shards against exact search, over rows of the load generator with noise, which has no ties."""
    n, d = 3_000, 32
    noise = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: ((F.pmod(F.xxhash64("pos", k), F.lit(2_000)) / 1_000.0 - 1) * 0.1).cast("float"))
    v = synthetic.vectors(spark, n, d).select(F.col("pos").alias("id"), F.zip_with("vector", noise, lambda a, b: a + b).alias("vector"))
    norm = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)).cast("float")
    rows = v.select("id", F.col("id").alias("sequence"), "vector", norm.alias("norm")).cache()
    queries = rows.where("id % 150 = 0").select(F.col("id").alias("query_id"), "vector")
    books = ann.train(rows, d)
    coded = ann.with_codes(rows, books).cache()
    graphs = ann.build_graphs(ann.sharded(rows, n), "COSINE", books).cache()
    exact = batch.knn(queries, rows, 10)
    for graph in (False, graphs):
        size = batch.tuned_rerank(queries, coded, 10, "COSINE", books, 100, n, 0.92, graph)
        assert size <= n // 4
        found = batch.ann_knn(queries, coded, 10, "COSINE", books, size, graph, n)
        assert batch.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_client_roles_scope_errors_and_metrics(db):
    admin = Client(db, "root", ("ADMIN",), "a")
    admin.create_collection("docs", 2)
    writer, reader = admin.with_principal("w", ("WRITER",)), admin.with_principal("r", ("READER",))
    assert writer.upsert("docs", [rec("x", [1, 0], k=1), rec("y", [0, 1])]) == 2 and writer.partial_update("docs", [("x", {"k": 2})]) == 1
    assert ids(reader.search("docs", [1, 0], 1)) == ["x"] and reader.stats("docs")["live_vector_count"] == 2 and not reader.last_search["cache_hit"]
    for call, status in ((lambda: reader.upsert("docs", []), 403), (lambda: writer.flush("docs"), 403), (lambda: reader.get_collection("none"), 404), (lambda: reader.search("docs", [1], 1), 400), (lambda: admin.get_tenant("b"), 403), (lambda: admin.create_collection("docs", 2), 400), (lambda: admin.with_tenant(None).flush("docs"), 403), (lambda: reader.search("docs", [1, 0], 1, {"a": {"$no": 1}}), 400)):
        with pytest.raises(CallError) as e:
            call()
        assert e.value.status == status and e.value.trace_id
    assert admin.flush("docs") and admin.backup("docs", "one")["backup_id"] == "one" and admin.restore("docs", "one", "copy")["live_vector_count"] == 2
    assert [c["name"] for c in admin.list_collections()] == ["copy", "docs"] and admin.with_tenant(None).list_tenants() == ["a"] and admin.list_tenants() == ["a"]
    text = admin.with_tenant(None).scrape()
    assert 'lodestar_calls_total{route="POST /collections/{name}/search",status="400"} 2' in text and 'searches_total{tenant="a",collection="docs"} 1' in text and "search_seconds_bucket" in text
    assert "lodestar_calls_total" not in admin.scrape()
    assert admin.audit.rows().where("status = 403").count() == 4


def test_keys_rates_permits_and_sizes(db):
    now = [0.0]
    read = []

    def source():
        read.append(1)
        return {"k1": Identity("ann", ("READER",), "a"), "k2": Identity("root", ("ADMIN",))}

    keys = Keys(source=source, clock=lambda: now[0])
    client = Client(db, config=Config(body_bytes=60))
    assert client.with_key(keys, "Bearer k1").tenant == "a" and client.with_key(keys, "k2").tenant is None and len(read) == 1
    now[0] = 2.0
    with pytest.raises(CallError) as e:
        client.with_key(keys, "other")
    assert e.value.status == 401 and len(read) == 2
    limiter = RateLimiter(1.0, 2.0, idle=10.0, clock=lambda: now[0])
    limiter.take("a"), limiter.take("a"), limiter.take("b")
    with pytest.raises(TooManyRequests):
        limiter.take("a")
    now[0] += 1
    limiter.take("a")
    now[0] += 100
    limiter.take("c")
    assert set(limiter.buckets) == {("c",)}
    client.create_collection("docs", 2)
    with pytest.raises(CallError) as e:
        client.upsert("docs", [rec(f"v{i}", [1, 0]) for i in range(9)])
    assert e.value.status == 413
    client.permits = Permits(1)
    with client.permits.held(), pytest.raises(CallError) as e:
        client.stats("docs")
    assert e.value.status == 503 and client.stats("docs")["live_vector_count"] == 0
    client.limiter = RateLimiter(0.001, 1.0)
    client.stats("docs")
    with pytest.raises(CallError) as e:
        client.stats("docs")
    assert e.value.status == 429


def test_observer_chunks_and_quota_of_storage(spark, db):
    class Seen(Observer):
        rows = 0

        def mutated(self, collection, rows):
            Seen.rows += rows

    db.observer = Seen()
    c = db.create("docs", 2)
    assert upsert_chunks(c, (rec(f"v{i}", [i, 1]) for i in range(7)), 3) == 7 and Seen.rows == 7 and len(c.manifest["batches"]) == 3
    with pytest.raises(CodecError):
        upsert_chunks(c, [])
    from lodestar.operators.policy import Quota
    from lodestar.plans.collections import QuotaExceeded

    db.quotas["default"] = Quota(max_storage_bytes=1)
    with pytest.raises(QuotaExceeded):
        c.upsert_records([rec("z", [1, 0])])
    served = Database(spark, f"{db.root}/two").load_for_serving("s", 4, synthetic.vectors(spark, 20, 4), compact=True)
    assert served.stats()["segment_count"] == 1 and served.stats()["live_vector_count"] == 20 and len(served.search([1, 0, 0, 0], 3, synthetic.filter_for(5))) == 1


def test_generator_follows_its_formula(spark):
    for r in synthetic.vectors(spark, 50, 8, 4).collect():
        i, v = r.pos, np.zeros(8)
        v[i % 8] += 1
        v[(7 * i + 3) % 8] += 0.35
        v[(11 * i + 5) % 8] += 0.2
        v[(13 * i + 1) % 8] += (i % 5 + 1) / 20
        assert np.allclose(r.vector, v) and json.loads(r.payload) == {"bucket": i % 1024, "source": f"repo-{i % 4}", "path": f"docs/{i}.md", "section": i % 12, "group": f"g-{i % 4}"}


def test_patches_fold_as_a_stream(spark):
    log = [("a", 1, "LIVE", '{"x":{"y":1},"z":1}'), ("a", 2, "PAYLOAD_PATCH", '{"z":null}'), ("a", 3, "PAYLOAD_PATCH", '{"x":{"w":2}}'), ("b", 4, "PAYLOAD_PATCH", '{"q":1}'), ("b", 5, "LIVE", '{"q":0}'), ("c", 6, "LIVE", "{}"), ("c", 7, "TOMBSTONE", None), ("c", 8, "PAYLOAD_PATCH", '{"q":1}')]
    rows = spark.createDataFrame([(i, s, k, None, None, p) for i, s, k, p in log], "id string, sequence long, kind string, vector array<float>, norm float, payload string")
    got = {r.id: (r.sequence, r.tombstone, r.payload) for r in state.resolve(rows.repartition(3)).collect()}
    assert got == {"a": (3, False, '{"x":{"y":1,"w":2}}'), "b": (5, False, '{"q":0}'), "c": (7, True, None)}


def test_percentiles_of_large_and_odd_groups(spark):
    r = np.random.default_rng(2)
    groups = {"wide": np.exp(r.normal(0, 9, 3000)), "same": np.full(500, 3.0), "one": np.array([7.0]), None: r.integers(0, 5, 400).astype(float)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("empty", None), ("same", float("nan"))]
    got = {x.k: x for x in nearest_ranks(spark.createDataFrame(rows, "k string, x double").repartition(4), "k", "x", {"p50": 0.5, "p99": 0.99, "most": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        v = np.sort(v)
        assert [got[k].p50, got[k].p99, got[k].most] == [v[int(np.ceil(len(v) * p)) - 1] for p in (0.5, 0.99, 1.0)]


def test_histogram_and_summary():
    h = Histogram((1, 2))
    for x in (0.5, 1, 1.5, 9):
        h.add(x)
    assert h.lines("s", 'a="b"') == ['s_bucket{a="b",le="1"} 2', 's_bucket{a="b",le="2"} 3', 's_bucket{a="b",le="+Inf"} 4', 's_sum{a="b"} 12', 's_count{a="b"} 4']
    assert summary([3, 1, 2], [200, 200, 404], 2.0) == {"count": 3, "p50": 2, "p95": 3, "p99": 3, "max": 3, "statuses": {200: 2, 404: 1}, "qps": 1.5}
