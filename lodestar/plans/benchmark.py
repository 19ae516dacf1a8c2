"""A load test of one collection: create, ingest, prepare, warm up, measure."""

from __future__ import annotations

import time
from dataclasses import dataclass

from lodestar.plans.collections import Database
from lodestar.plans.metrics import summary
from lodestar.sources import synthetic


@dataclass(frozen=True)
class Scenario:
    """How many vectors of which length, in how many filter groups (0: no filter), and what is asked after which preparation."""

    name: str
    dimension: int
    rows: int
    k: int = 10
    groups: int = 0
    metric: str = "COSINE"
    prepare: str = "none"  # none, flush, flush-compact
    warm_up: int = 3
    measured: int = 20


# Vectors, lengths and groups of the scenarios that load tests of this kind of database use.
SCENARIOS = {
    s.name: s
    for s in (
        Scenario("general-small", 128, 8_000), Scenario("kb-medium-unprepared", 384, 12_000, groups=64), Scenario("kb-medium-flush", 384, 12_000, groups=64, prepare="flush"),
        Scenario("kb-large-flush", 768, 30_000, groups=128, prepare="flush"), Scenario("kb-large-flush-compact", 768, 30_000, groups=128, prepare="flush-compact"),
        Scenario("l2-384-prepared", 384, 15_000, metric="L2", prepare="flush"), Scenario("cosine-384-top50-filter", 384, 15_000, 50, 64, prepare="flush"), Scenario("cosine-1536-highdim", 1536, 12_000, groups=128, prepare="flush"),
    )
}


def run(db: Database, s: Scenario, approximate: bool = False) -> dict:
    """Seconds of each phase, vectors ingested a second, and the summary of the measured searches. Queries are the vectors of rows spread over the table."""
    rows = synthetic.vectors(db.spark, s.rows, s.dimension, s.groups or 1).cache()
    ids = [(i * s.rows // (s.warm_up + s.measured)) for i in range(s.warm_up + s.measured)]
    asked = {r.pos: [float(x) for x in r.vector] for r in rows.where(rows.pos.isin(ids)).select("pos", "vector").collect()}
    began = time.time()
    c = db.create(s.name, s.dimension, s.metric, columns=["group"] if s.groups else ())
    created = time.time()
    c.upsert(rows)
    ingested = time.time()
    if s.prepare != "none":
        c.flush()
    if s.prepare == "flush-compact":
        c.compact()
    if approximate:
        c.warm()
    prepared = time.time()
    took, statuses = [], []
    for n, i in enumerate(ids):
        at = time.time()
        try:
            c.search(asked[i], s.k, synthetic.filter_for(i, s.groups) if s.groups else None, approximate=approximate)
            status = 200
        except Exception:  # noqa: BLE001  a failed request is counted by its status
            status = 500
        if n >= s.warm_up:
            took.append(time.time() - at)
            statuses.append(status)
    rows.unpersist()
    return {"scenario": s.name, "create": created - began, "ingest": ingested - created, "prepare": prepared - ingested, "vectors_per_second": s.rows / (ingested - created)} | summary(took, statuses, sum(took))
