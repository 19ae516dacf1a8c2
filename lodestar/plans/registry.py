"""The queries that the driver runs, with their DuckDB equivalents."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions.payload import footprint
from lodestar.functions.scoring import doubles, literal, score
from lodestar.operators import ann, batch, payload_index, policy, state
from lodestar.operators.filters import Columns, FilterBuilder, Payload, compile_filter
from lodestar.operators.ranks import nearest_ranks
from lodestar.sources import codecs, synthetic

QUERIES, SQL = {}, {}

_V = "embedding::DOUBLE[]"
_Q = f"(SELECT {_V} FROM embeddings WHERE vec_id = 0)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query_vector(spark, sf_dir, vec_id=0):
    return [float(x) for x in _t(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def _scored(spark, sf_dir, metric, where=None):
    """Query vector as a literal: its norm folds, and the scan reads the columns of the filter and the score alone."""
    v = _t(spark, sf_dir, "embeddings")
    v = v if where is None else v.where(compile_filter(where, Columns(v.schema), "strict"))
    s = F.round(score(metric, literal(_query_vector(spark, sf_dir)), doubles(F.col("embedding"))), 6)
    return v.select("vec_id", s.alias("score"))


def _best(rows, k=10):
    return rows.orderBy(F.desc("score"), "vec_id").limit(k)


def _topk_sql(where="true", k=10):
    return f"SELECT vec_id, round(list_cosine_similarity({_V}, {_Q}), 6) AS score FROM embeddings WHERE {where} ORDER BY score DESC, vec_id LIMIT {k}"


@query(_topk_sql())
def cosine_topk(spark, sf_dir):
    return _best(_scored(spark, sf_dir, "COSINE"))


@query(f"SELECT vec_id, round(-list_sum(list_transform(list_zip({_V}, {_Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) + 0.0, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def l2_topk(spark, sf_dir):
    return _best(_scored(spark, sf_dir, "L2"))


@query(f"""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE round(list_cosine_similarity({_V}, {_Q}), 6) END AS score FROM embeddings""")
def cosine_zero_norm(spark, sf_dir):
    """Every fifth row is a vector without length, whose score is 0."""
    v = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform(doubles(F.col("embedding")), lambda x: F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(x)).alias("v"))
    return v.select("vec_id", F.round(score("COSINE", literal(_query_vector(spark, sf_dir)), F.col("v")), 6).alias("score"))


FILTERS = {
    "topk_filter_eq": ({"label": 3}, "label = 3"),
    "topk_filter_in": (FilterBuilder().is_in("label", [1, 4, 7]).build(), "label IN (1, 4, 7)"),
    "topk_filter_range": (FilterBuilder().between("label", gte=2, lt=5).build(), "label >= 2 AND label < 5"),
    "topk_filter_and": (FilterBuilder().between("label", gt=1).between("label", lte=6).build(), "label > 1 AND label <= 6"),
    "topk_filter_or": ({"$or": [{"label": 0}, {"label": {"$gte": 7}}]}, "label = 0 OR label >= 7"),
    "topk_filter_not": ({"$not": {"label": {"$in": [0, 1, 2, 3]}}}, "NOT coalesce(label IN (0, 1, 2, 3), false)"),
}
for _name, (_spec, _where) in FILTERS.items():
    QUERIES[_name] = lambda spark, sf_dir, spec=_spec: _best(_scored(spark, sf_dir, "COSINE", spec))
    SQL[_name] = _topk_sql(_where)


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def filter_contains_list(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return d.where(compile_filter({"words": {"$contains": "the"}}, Columns(d.schema))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'Licensed under')")
def filter_substring_strict(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.where(compile_filter({"text": {"$contains": "Licensed under"}}, Columns(d.schema), "strict")).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE lang >= 'en' AND lang < 'fr'")
def filter_string_range(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.where(compile_filter({"lang": {"$gte": "en", "$lt": "fr"}}, Columns(d.schema))).select("doc_id", "lang")


def _props(spark, sf_dir, text="props"):
    return _t(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("v"))


@query("SELECT event_id FROM events WHERE coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE) >= 90, false)")
def filter_json_range(spark, sf_dir):
    return _props(spark, sf_dir).where(compile_filter({"k": {"$gte": 90}}, Payload(F.col("v")))).select("event_id")


@query("SELECT event_id FROM events WHERE coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE) IN (7, 69), false)")
def filter_json_nested(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.parse_json(F.concat(F.lit('{"meta":'), "props", F.lit("}"))).alias("v"))
    return e.where(compile_filter({"meta": {"k": {"$in": [7, 69]}}}, Payload(F.col("v")))).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0")
def filter_json_null(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, '{"k":null}').when(F.col("event_id") % 3 == 1, "{}").otherwise(F.col("props"))
    e = _t(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("v"))
    return e.where(compile_filter({"k": None}, Payload(F.col("v")))).select("event_id")


_ORDERED = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events"


def _mutations(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("sequence"), "event_type", "value", (F.col("event_type") == "error").alias("tombstone"))


@query(f"SELECT user_id AS id, event_id AS sequence, event_type, value, event_type = 'error' AS tombstone FROM ({_ORDERED}) WHERE rn = 1")
def latest_state(spark, sf_dir):
    return state.latest(_mutations(spark, sf_dir))


@query(f"SELECT user_id AS id, event_id AS sequence, event_type, value FROM ({_ORDERED}) WHERE rn = 1 AND event_type <> 'error'")
def live_only(spark, sf_dir):
    return state.live(state.latest(_mutations(spark, sf_dir)))


@query(f"SELECT count(*) FILTER (event_type <> 'error') AS live_vector_count, count(*) FILTER (event_type = 'error') AS tombstone_count FROM ({_ORDERED}) WHERE rn = 1")
def tombstone_count(spark, sf_dir):
    return state.counters(state.latest(_mutations(spark, sf_dir)))


@query(f"SELECT event_id // 2500 AS generation, user_id AS id, event_id AS sequence FROM ({_ORDERED}) WHERE rn = 1 AND event_type <> 'error'")
def compact_live_versions(spark, sf_dir):
    """Entries of four generations whose sequence is the latest live one."""
    log = _mutations(spark, sf_dir)
    alive = state.live(state.latest(log)).select("id", "sequence")
    return log.select(F.floor(F.col("sequence") / 2500).alias("generation"), "id", "sequence").join(alive, ["id", "sequence"], "left_semi").select("generation", "id", "sequence")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)")
def delete_apply(spark, sf_dir):
    gone = _t(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return _t(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey AS id, max(o_orderkey) AS sequence, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey")
def upsert_lastwins(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("sequence"), F.col("o_totalprice").alias("price"))
    return state.latest(o)


@query(f"SELECT count(*) AS additional_live FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT user_id FROM ({_ORDERED}) WHERE rn = 1 AND event_type <> 'error')")
def additional_live(spark, sf_dir):
    return state.additional_live(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), state.live(state.latest(_mutations(spark, sf_dir))))


_KIND = "CASE WHEN event_id % 10 = 3 THEN 'LIVE' WHEN event_id % 50 = 27 THEN 'TOMBSTONE' ELSE 'PAYLOAD_PATCH' END"


def _document_log(spark, sf_dir):
    """The events as a log of documents: whole records, deletes, and patches that set a value, one inside a map, and take a key out."""
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    whole = F.to_json(F.struct(k.alias("k"), F.struct(F.lit("none").alias("kind"), F.lit(1).alias("old")).alias("meta"), F.lit("x").alias("gone")))
    patch = F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"meta":{"kind":"'), F.col("event_type"), F.lit('"},"gone":null}'))
    kind = F.expr(_KIND)
    none = lambda t: F.lit(None).cast(t)
    return e.select(
        F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("sequence"), kind.alias("kind"), none("array<float>").alias("vector"), none("float").alias("norm"),
        F.when(kind == "LIVE", whole).when(kind == "PAYLOAD_PATCH", patch).alias("payload"),
    )


@query(f"""WITH log AS (SELECT *, {_KIND} AS what, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
whole AS (SELECT user_id, max(event_id) AS base, arg_max(what, event_id) AS what, arg_max(k, event_id) AS k FROM log WHERE what <> 'PAYLOAD_PATCH' GROUP BY user_id),
later AS (SELECT w.user_id, max(l.event_id) AS at, arg_max(l.k, l.event_id) AS k, arg_max(l.event_type, l.event_id) AS kind
  FROM whole w JOIN log l ON l.user_id = w.user_id AND l.what = 'PAYLOAD_PATCH' AND l.event_id > w.base AND w.what = 'LIVE' GROUP BY w.user_id)
SELECT w.user_id::VARCHAR AS id, coalesce(l.at, w.base) AS sequence, w.what = 'TOMBSTONE' AS tombstone, CASE WHEN w.what = 'LIVE' THEN coalesce(l.k, w.k) END AS k,
  CASE WHEN w.what = 'LIVE' THEN coalesce(l.kind, 'none') END AS kind, CASE WHEN w.what = 'LIVE' THEN 1 END AS old, CASE WHEN w.what = 'LIVE' AND l.at IS NULL THEN 'x' END AS gone
FROM whole w LEFT JOIN later l USING (user_id)""")
def patch_fold(spark, sf_dir):
    out = state.resolve(_document_log(spark, sf_dir))
    at = lambda path, kind: F.try_variant_get(F.parse_json("payload"), path, kind)
    return out.select("id", "sequence", "tombstone", at("$.k", "bigint").alias("k"), at("$.meta.kind", "string").alias("kind"), at("$.meta.old", "int").alias("old"), at("$.gone", "string").alias("gone"))


def _database(spark):
    """A database in the folder that the cluster shares; in a local session without one, in a temporary folder."""
    from lodestar.plans.collections import Database

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestar-db-")
    return Database(spark, f"{named}/lodestar-db/{uuid.uuid4().hex}")


def _collection(spark, sf_dir, columns=()):
    """The embeddings as a collection: upserted, flushed, ids divisible by 10 deleted, those divisible by 7 put in again with the opposite vector."""
    c = _database(spark).create("vectors", 64, columns=columns)
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label", (F.col("vec_id") % 3).alias("third"))).alias("payload"))
    c.upsert(v)
    c.flush()
    c.delete_rows(v.where("pos % 10 = 0").select("id"))
    c.upsert(v.where("pos % 7 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    return c


_KEPT = f"""(SELECT vec_id, label, vec_id % 3 AS third, CASE WHEN vec_id % 7 = 0 THEN list_transform({_V}, lambda x: -x) ELSE {_V} END AS v FROM embeddings WHERE vec_id % 10 <> 0 OR vec_id % 7 = 0)"""
_BEST = "SELECT vec_id::VARCHAR AS id, round(list_cosine_similarity(v, %s), 4) AS score FROM %s WHERE %s ORDER BY list_cosine_similarity(v, %s) DESC LIMIT 10"


def _found(rows):
    return rows.select("id", F.round("score", 4).alias("score"))


@query(_BEST % (_Q, _KEPT, "true", _Q))
def collection_search(spark, sf_dir):
    return _found(_collection(spark, sf_dir).ranked(_query_vector(spark, sf_dir), 10))


@query(_BEST % (_Q, _KEPT, "label >= 3 AND third = 1", _Q))
def collection_filtered_search(spark, sf_dir):
    """A filter over promoted payload paths, after a compaction: one generation, read by pushed-down comparisons."""
    c = _collection(spark, sf_dir, ["label", "third"])
    c.compact()
    return _found(c.ranked(_query_vector(spark, sf_dir), 10, {"label": {"$gte": 3}, "third": 1}))


@query(f"SELECT vec_id::VARCHAR AS id, label, round(list_sum(v), 4) AS total FROM {_KEPT}")
def collection_compacted(spark, sf_dir):
    c = _collection(spark, sf_dir)
    c.compact()
    total = F.aggregate(doubles(F.col("vector")), F.lit(0.0), lambda s, x: s + x)
    return c.live().select("id", F.get_json_object("payload", "$.label").cast("int").alias("label"), F.round(total, 4).alias("total"))


@query(f"SELECT 'vectors' AS name, count(*) AS live_vector_count, (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0 AND vec_id % 7 <> 0) AS tombstone_count, 2 AS segment_count FROM {_KEPT}")
def collection_counts(spark, sf_dir):
    c = _collection(spark, sf_dir)
    c.flush()
    s = c.stats()
    return spark.createDataFrame([(s["name"], s["live_vector_count"], s["tombstone_count"], s["segment_count"])], "name string, live_vector_count long, tombstone_count long, segment_count int")


@query("""SELECT 'k' AS path, json_extract_string(props, '$.k') AS value, event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def payload_postings(spark, sf_dir):
    return payload_index.postings(_t(spark, sf_dir, "events"), ["event_id"], "props")


@query("SELECT event_id FROM events WHERE coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT) IN (7, 8, 9), false)")
def postings_candidates(spark, sf_dir):
    posted = payload_index.postings(_t(spark, sf_dir, "events"), ["event_id"], "props")
    return payload_index.candidates(posted, {"$or": [{"k": {"$in": [7, 8]}}, {"k": 9}]}, ["event_id"])


def _queries(rows):
    """The stated query set: every row whose id is divisible by 100."""
    return rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")


def _knn(spark, sf_dir, on=None, metric="COSINE"):
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return batch.knn(_queries(v), v, 5, metric, on)


_L2_PAIR = f"-list_sum(list_transform(list_zip(q.{_V}, v.{_V}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) + 0.0"
_KNN = f"""SELECT query_id, id, score, rn AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS id, round(%s, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id %% 100 = 0 AND %s)) WHERE rn <= 5"""
_COS_PAIR = f"list_cosine_similarity(q.{_V}, v.{_V})"


@query(_KNN % (_COS_PAIR, "true"))
def knn_batch(spark, sf_dir):
    return _knn(spark, sf_dir)


@query(_KNN % (_L2_PAIR, "true"))
def knn_l2(spark, sf_dir):
    return _knn(spark, sf_dir, metric="L2")


@query(_KNN % (_COS_PAIR, "q.label = v.label"))
def knn_by_label(spark, sf_dir):
    return _knn(spark, sf_dir, "label")


@query(_topk_sql())
def topk_merge_segments(spark, sf_dir):
    """The best of each of four segments, then of these."""
    s = _scored(spark, sf_dir, "COSINE").withColumn("segment", F.pmod("vec_id", F.lit(4)))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("score"), "vec_id"))
    return _best(s.withColumn("place", place).where("place <= 10").select("vec_id", "score"))


def _log(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    n = F.sqrt(F.aggregate(doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x * x)).cast("float")
    return v.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("sequence"), F.col("embedding").alias("vector"), n.alias("norm"), F.to_json(F.struct("label")).alias("payload"))


@query()
def pq_encode_adc(spark, sf_dir):
    rows = _log(spark, sf_dir)
    books, q = ann.train(rows, 64), np.array(_query_vector(spark, sf_dir))
    s = ann.quantized_score(F.col("codes"), ann.lookup(q, books, "COSINE"), F.col("norm"), float(np.linalg.norm(q)), "COSINE")
    return ann.with_codes(rows, books).select("id", "codes", F.round(s, 6).alias("approx"))


def _ann(spark, sf_dir, graph):
    """The approximate ten of each query; as many candidates as a sample of the queries needs for a recall of 0.95."""
    rows = _log(spark, sf_dir).withColumn("id", F.col("id").cast("long"))
    n, books = rows.count(), ann.train(rows, 64)
    coded, queries_ = ann.with_codes(rows, books), _queries(rows.select("id", "vector"))
    stored = ann.build_graphs(ann.sharded(rows.select("id", "sequence", "vector"), n), "COSINE", books).persist() if graph else False
    size = batch.tuned_rerank(queries_, coded, 10, "COSINE", books, policy.plan_batch(n, 10), n, 0.95, stored)
    return batch.ann_knn(queries_, coded, 10, "COSINE", books, size, stored, n)


@query()
def ann_topk(spark, sf_dir):
    return _ann(spark, sf_dir, graph=False)


@query()
def ann_graph_topk(spark, sf_dir):
    return _ann(spark, sf_dir, graph=True)


@query()
def ann_recall(spark, sf_dir):
    """Each query's share of its exact ten that the codes find."""
    v = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return batch.recall(_ann(spark, sf_dir, graph=False), batch.knn(_queries(v), v, 10))


@query("""SELECT n, k, CASE WHEN n <= greatest(256, 32 * k) OR greatest(n, k) <= greatest(512, 40 * k) OR greatest(n, k) / n <= 0.12 THEN 'EXACT' ELSE 'APPROXIMATE' END AS mode
FROM (VALUES (100), (300), (500), (513), (2000), (100000)) a(n), (VALUES (1), (10), (50), (100)) b(k)""")
def mode_planner(spark, sf_dir):
    grid = [(n, k, policy.plan_search(n, k).mode) for n in (100, 300, 500, 513, 2000, 100000) for k in (1, 10, 50, 100)]
    return spark.createDataFrame(grid, "n int, k int, mode string")


@query(f"""SELECT event_type AS collection, count(*) FILTER (rn = 1) AS live, count(*) AS entries, count(DISTINCT event_id // 2500) AS segments
FROM ({_ORDERED}) GROUP BY event_type""")
def collection_stats(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    newest = e.groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("event_id", F.lit(1).alias("live"))
    e = e.select(F.col("event_type").alias("collection"), "event_id").join(newest, "event_id", "left")
    return e.groupBy("collection").agg(F.count("live").alias("live"), F.count("*").alias("entries"), F.countDistinct(F.floor(F.col("event_id") / 2500)).alias("segments"))


@query("SELECT n_name AS tenant_id, count(*) AS collection_count, sum(c_custkey)::BIGINT AS storage, max(c_custkey) AS last_created FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def tenant_stats(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("tenant_id"))
    c = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("collection_count"), F.sum("c_custkey").alias("storage"), F.max("c_custkey").alias("last_created"))
    return c.join(n, "c_nationkey").drop("c_nationkey")


@query("SELECT n_name AS tenant_id FROM nation UNION SELECT r_name FROM region")
def tenant_listing(spark, sf_dir):
    configured = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("tenant_id"))
    return configured.union(_t(spark, sf_dir, "region").select("r_name")).distinct().orderBy("tenant_id")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return nearest_ranks(_t(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "most": 1.0})


BUCKETS = (5, 10, 25, 50, 100, 250)


@query(f"SELECT event_type, {', '.join(f'count(*) FILTER (value <= {b}) AS le_{b}' for b in BUCKETS)}, count(*) AS n FROM events GROUP BY event_type")
def histogram_buckets(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in BUCKETS), F.count("*").alias("n"))


@query("""SELECT event_type AS status, count(*) AS n, round(count(*) / (SELECT epoch_ms(max(ts)) - epoch_ms(min(ts)) FROM events) * 1000, 6) AS qps FROM events GROUP BY event_type""")
def status_distribution(spark, sf_dir):
    """Calls by status, and how many a second over the time that all calls took."""
    e = _t(spark, sf_dir, "events")
    span = e.agg(((F.unix_millis(F.max(F.col("ts").cast("timestamp"))) - F.unix_millis(F.min(F.col("ts").cast("timestamp")))) / 1000).alias("seconds"))
    n = e.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(span)).select("status", "n", F.round(F.col("n") / F.col("seconds"), 6).alias("qps"))  # one row


@query("SELECT lang, arg_max(doc_id, n_chars * 1000000 - doc_id) AS best, max(n_chars) AS most FROM documents GROUP BY lang")
def best_scenario(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.max_by("doc_id", F.col("n_chars") * 1000000 - F.col("doc_id")).alias("best"), F.max("n_chars").alias("most"))


@query("""SELECT lang AS family, max(n_chars) FILTER (doc_id % 3 = 0) AS unprepared, max(n_chars) FILTER (doc_id % 3 = 1) AS flush, max(n_chars) FILTER (doc_id % 3 = 2) AS flush_compact FROM documents GROUP BY lang""")
def family_comparison(spark, sf_dir):
    """The best figure of each way of preparation, side by side for each family of scenarios."""
    d = _t(spark, sf_dir, "documents").select(F.col("lang").alias("family"), F.element_at(F.array(F.lit("unprepared"), F.lit("flush"), F.lit("flush_compact")), (F.col("doc_id") % 3 + 1).cast("int")).alias("prepared"), "n_chars")
    return d.groupBy("family").pivot("prepared", ["unprepared", "flush", "flush_compact"]).agg(F.max("n_chars"))


@query("SELECT doc_id, octet_length(encode(doc_id::VARCHAR)) + octet_length(encode(text)) + 4 * 64 + 4 AS bytes FROM documents")
def footprint_estimate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", footprint(F.col("doc_id").cast("string"), F.col("text"), F.lit(64)).alias("bytes"))


@query("SELECT o_custkey AS tenant_id, o_orderkey AS backup_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 3")
def retention_prune(spark, sf_dir):
    from lodestar.plans.collections import retained

    b = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant_id"), F.lit("x").alias("name"), F.col("o_orderkey").alias("backup_id"), F.col("o_orderdate").alias("created_at"))
    return retained(b, 3).select("tenant_id", "backup_id")


_ROUNDTRIP = "SELECT vec_id::VARCHAR AS id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total, label FROM embeddings"


def _checked(rows):
    total = F.aggregate(doubles(F.col("vector")), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.size("vector").cast("long").alias("n"), F.round(total, 4).alias("total"), F.get_json_object("payload", "$.label").cast("int").alias("label"))


@query(_ROUNDTRIP)
def ndjson_roundtrip(spark, sf_dir):
    return _checked(codecs.parse_lines(codecs.to_lines(_log(spark, sf_dir))))


@query(_ROUNDTRIP)
def binary_roundtrip(spark, sf_dir):
    return _checked(codecs.decode_rows(codecs.encode_partitions(_log(spark, sf_dir), 64), 64))


@query("""SELECT 'vec-' || i AS id, round(1 + 0.35 + 0.2 + (i % 5 + 1) / 20.0, 4)::DOUBLE AS total, i % 1024 AS bucket, 'g-' || (i % 64) AS "group", i % 12 AS section
FROM (SELECT unnest(range(count(*))) AS i FROM customer)""")
def synthetic_vectors(spark, sf_dir):
    """The load generator's rows, as many as there are customers; the weights of a vector add up to the same wherever they meet."""
    rows = synthetic.vectors(spark, _t(spark, sf_dir, "customer").count(), 64)
    total = F.aggregate(doubles(F.col("vector")), F.lit(0.0), lambda s, x: s + x)
    at = lambda k: F.get_json_object("payload", f"$.{k}")
    return rows.select("id", F.round(total, 4).alias("total"), at("bucket").cast("long").alias("bucket"), at("group").alias("group"), at("section").cast("long").alias("section"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
