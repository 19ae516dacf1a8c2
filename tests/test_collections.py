import json

import pytest

from lodestar.functions.payload import merge
from lodestar.operators.policy import Quota
from lodestar.operators.search import DimensionError
from lodestar.plans.collections import Database, NotFound, QuotaExceeded, ValidationError
from lodestar.sources.codecs import CodecError, decode_batch, decode_json_lines, encode_batch
from lodestar.streaming.ingest import ingest_lines


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def rec(i, v, /, **payload):
    return {"id": i, "vector": v, "payload": payload}


def ids(hits):
    return [h["id"] for h in hits]


def test_search_with_a_filter_and_after_reopening(db):
    c = db.create("docs", 3)
    c.upsert_records([rec("alpha", [1, 0, 0], tenant="blue"), rec("beta", [0, 1, 0], tenant="red"), rec("gamma", [0.9, 0.1, 0], tenant="blue")])
    for again in (c, db.open("docs")):
        hits = again.search([1, 0, 0], 2, {"tenant": "blue"})
        assert ids(hits) == ["alpha", "gamma"] and hits[0]["score"] >= hits[1]["score"]
    with pytest.raises(DimensionError):
        c.search([1, 0], 1)
    with pytest.raises(ValidationError):
        c.upsert_records([rec("x", [1, 0])])
    assert c.stats()["live_vector_count"] == 3


def test_delete_flush_compact(db):
    c = db.create("docs", 3)
    c.upsert_records([rec("alpha", [1, 0, 0], v=1), rec("beta", [0, 1, 0])])
    assert c.stats()["segment_count"] == 0 and c.flush() and c.stats()["segment_count"] == 1
    assert c.delete(["beta", "nobody"]) == 1 and c.delete(["beta"]) == 0
    s = c.stats()
    assert (s["live_vector_count"], s["tombstone_count"]) == (1, 1) and ids(c.search([0, 1, 0], 5)) == ["alpha"]
    c.upsert_records([rec("beta", [0, 1, 0], v=2), rec("alpha", [0.9, 0.1, 0], v=2)])
    c.flush()
    assert c.compact() and c.stats()["segment_count"] == 1
    assert {h["id"]: json.loads(h["payload"])["v"] for h in c.search([0, 1, 0], 5)} == {"alpha": 2, "beta": 2}
    c.delete(["alpha", "beta"])
    c.flush()
    c.compact()
    s = c.stats()
    assert (s["segment_count"], s["live_vector_count"], s["tombstone_count"]) == (0, 0, 0) and c.search([1, 0, 0], 3) == []


def test_last_of_a_batch_wins_and_newer_first_at_ties(db):
    c = db.create("docs", 2, "L2")
    c.upsert_records([rec("a", [1, 0], n=1), rec("b", [1, 0]), rec("a", [1, 0], n=2)])
    hits = c.search([1, 0], 5)
    assert ids(hits) == ["a", "b"] and json.loads(hits[0]["payload"]) == {"n": 2} and hits[0]["score"] == 0.0


def test_patches(db):
    c = db.create("docs", 3)
    c.upsert_records([rec("alpha", [0.125, 1, -0.5], title="Intro", obsolete="legacy", meta={"section": "draft", "priority": 1})])
    c.flush()
    c.partial_update([("alpha", {"title": "Intro v2", "obsolete": None, "meta": {"section": "basics", "published": True}})])
    want = {"title": "Intro v2", "meta": {"section": "basics", "priority": 1, "published": True}}
    for _ in range(2):
        (hit,) = db.open("docs").search([0.125, 1, -0.5], 1, {"title": "Intro v2"})
        assert json.loads(hit["payload"]) == want and hit["score"] > 0.99
        c.flush()
    with pytest.raises(ValidationError):
        c.partial_update([("nobody", {"a": 1})])
    with pytest.raises(ValidationError):  # folds to nothing before it is applied
        c.partial_update([("alpha", {"a": 1}), ("alpha", {"a": None})])
    assert merge({"a": 1}, {"a": {"b": None}}) == {"a": {"b": None}}


def test_backup_restore_tenants_quotas(db):
    c = db.create("docs", 2, tenant="a")
    c.upsert_records([rec("alpha", [1, 0])])
    db.backup("docs", "nightly", "a")
    c.upsert_records([rec("beta", [0, 1])])
    assert ids(db.restore("docs", "nightly", "copy", "a").search([1, 0], 5)) == ["alpha"]
    with pytest.raises(ValidationError):
        db.backup("docs", "nightly", "a")
    with pytest.raises(NotFound):
        db.restore("docs", "missing", "other", "a")
    with pytest.raises(ValueError):
        db.backup("docs", "../up", "a")
    assert [b["backup_id"] for b in db.backups("a")] == ["nightly"]
    assert len(db.snapshot_tenant("a", "all")) == 2 and db.tenant_stats("a")["backup_count"] == 3
    db.create("docs", 2, tenant="b").upsert_records([rec("other", [1, 0])])
    assert ids(db.open("docs", "b").search([1, 0], 5)) == ["other"] and db.tenants() == ["a", "b"]
    db.quotas["b"] = Quota(max_collections=1, max_live_vectors=2)
    with pytest.raises(QuotaExceeded):
        db.create("more", 2, tenant="b")
    with pytest.raises(QuotaExceeded):
        db.open("docs", "b").upsert_records([rec("x", [1, 0]), rec("y", [1, 0])])
    db.open("docs", "b").upsert_records([rec("x", [1, 0]), rec("other", [0, 1])])
    with pytest.raises(ValidationError):
        db.ensure("docs", 3, tenant="b")


def test_synchronize_and_automatic_maintenance(spark, tmp_path):
    db = Database(spark, str(tmp_path / "auto"), auto=True)
    c = db.create("docs", 2, flush_bytes=1)
    done = c.synchronize([rec("a", [1, 0]), rec("b", [0, 1])], [("a", {"x": 1})], ["b"], flush=True)
    assert (done["upserted"], done["patched"], done["deleted"]) == (2, 1, 1)
    s = c.stats()
    assert s["live_vector_count"] == 1 and s["segment_count"] == 1 and s["tombstone_count"] == 0


def test_streamed_lines(spark, db, tmp_path):
    c = db.create("docs", 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","vector":[1,0],"payload":{"k":[1,{"z":null}]}}\n\n{"id":" b ","vector":[0,1]}\n')
    ingest_lines(spark, str(tmp_path / "in"), c, str(tmp_path / "cp")).awaitTermination()
    assert {h["id"]: json.loads(h["payload"]) for h in c.search([1, 0], 5)} == {"a": {"k": [1, {"z": None}]}, "b": {}}


def test_codecs():
    rows = [("alpha", [0.5, 1.0, -2.0], '{"a":1}'), ("beta", [0.0, 0.0, 0.0], None)]
    raw = encode_batch(rows, 3)
    assert decode_batch(raw) == [rows[0], ("beta", [0.0, 0.0, 0.0], "{}")]
    for bad in (raw[:-1], b"", b"x" * 40):
        with pytest.raises(CodecError):
            decode_batch(bad)
    with pytest.raises(CodecError):
        decode_batch(raw, 4)
    assert [r["id"] for r in decode_json_lines('{"id":"a"}\n\n{"id":"b"}')] == ["a", "b"]
    with pytest.raises(CodecError, match="line 2"):
        decode_json_lines('{"id":"a"}\n{')


def test_index_files_are_reused_and_rebuilt(spark, db):
    c = db.create("many", 8)
    rows = spark.range(900).selectExpr("cast(id as string) id", "transform(sequence(0, 7), i -> cast(pmod(hash(id, i), 1000) / 500.0 - 1 as float)) vector", "to_json(named_struct('k', id % 2)) payload")
    c.upsert(rows)
    q = [float(x) for x in rows.where("id = '17'").first().vector]
    assert ids(c.search(q, 1, approximate=True)) == ["17"] and c.last_search["mode"] == "APPROXIMATE" and not c.last_search["cache_hit"]
    made = db.files.names(f"{c.path}/index")
    assert ids(db.open("many").search(q, 1, {"k": 1}, approximate=True)) == ["17"] and db.files.names(f"{c.path}/index") == made
    assert ids(c.search(q, 1, approximate=True)) == ["17"] and c.last_search["cache_hit"]
    c.delete(["17"])
    assert ids(c.search(q, 1, approximate=True)) != ["17"] and len(db.files.names(f"{c.path}/index")) == 1
    c.evict()
    assert not db.files.exists(f"{c.path}/index")


def test_preview_scheduled_snapshots_and_reports(spark, db):
    from lodestar.plans.service import AuditLog, metric_lines, scrape

    c = db.create("docs", 2, tenant="t")
    c.upsert_records([rec("a", [1, 0]), rec("b", [0, 1])])
    (made,) = db.scheduled_snapshot("t", 1)
    c.delete(["a"])
    assert db.preview("docs", made, "t")["live_vector_count"] == 2 and c.stats()["live_vector_count"] == 1
    assert not [b for b in db.backups("t") if b["backup_id"] != made]
    with pytest.raises(NotFound):
        db.preview("docs", "missing", "t")
    db.restore("docs", made, "again", "t")
    text = scrape(db, "t")
    assert 'lodestar_collection_live_vector_count{tenant="t",collection="docs"} 1' in text and len(metric_lines(text, "again")) == 4
    log = AuditLog(db)
    assert log.rows().count() == 0
    log.record("ann", ["READER"], "POST", "/search", 200)
    log.record("bob", ["ADMIN", "WRITER"], "POST", "/flush", 403, "10.0.0.1", "x")
    log.flush()
    log.record("ann", ["READER"], "GET", "/stats", 200)
    assert [(r.principal, r.status, r.roles) for r in log.rows().orderBy("timestamp").collect()][1:] == [("bob", 403, ["ADMIN", "WRITER"]), ("ann", 200, ["READER"])]


def test_unchanged_collections_are_not_backed_up_again(db):
    db.create("docs", 2, tenant="s").upsert_records([rec("a", [1, 0])])
    assert len(db.scheduled_snapshot("s", 2)) == 1 and db.scheduled_snapshot("s", 2) == []
