"""What a server would report about a database: gauges in the text format of scrapers, and an audit log."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame

from lodestar.plans.collections import Database

GAUGES = ("live_vector_count", "tombstone_count", "segment_count", "storage_bytes")
AUDIT = "timestamp double, trace_id string, principal string, roles array<string>, method string, route string, status int, remote string"


def scrape(db: Database, tenant: str | None = None) -> str:
    """The gauges of each collection, of one tenant or of all, one line each below its type."""
    stats = [c.stats() for c in db.collections(tenant)]
    lines = []
    for g in GAUGES:
        lines.append(f"# TYPE lodestar_collection_{g} gauge")
        lines += [f'lodestar_collection_{g}{{tenant="{s["tenant_id"]}",collection="{s["name"]}"}} {s[g]}' for s in stats]
    return "\n".join(lines) + "\n"


def metric_lines(text: str, collection: str, prefixes: tuple[str, ...] = ("lodestar_collection_",)) -> list[str]:
    """The samples of a scrape that belong to one collection."""
    return [x for x in text.splitlines() if x.startswith(prefixes) and f'collection="{collection}"' in x]


class AuditLog:
    """Calls as JSON lines under the database's root. Entries wait until size of them, or flush, make a file."""

    def __init__(self, db: Database, size: int = 1_000):
        self.db, self.size, self.held = db, size, []

    def record(self, principal: str, roles, method: str, route: str, status: int, remote: str | None = None, trace_id: str | None = None) -> None:
        self.held.append((time.time(), trace_id or uuid.uuid4().hex, principal, sorted(roles), method, route, status, remote))
        if len(self.held) >= self.size:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.db.spark.createDataFrame(self.held, AUDIT).coalesce(1).write.mode("append").json(f"{self.db.root}/audit")
            self.held = []

    def rows(self) -> DataFrame:
        self.flush()
        path = f"{self.db.root}/audit"
        return self.db.spark.read.schema(AUDIT).json(path) if self.db.files.exists(path) else self.db.spark.createDataFrame([], AUDIT)
