"""One entry for all calls: who may do what to which tenant, what errors mean, and a record of each call."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from lodestar.operators import policy
from lodestar.operators.filters import FilterError
from lodestar.operators.search import DimensionError
from lodestar.plans.collections import Conflict, Database, NotFound, QuotaExceeded, ValidationError
from lodestar.plans.limits import Keys, Overloaded, Permits, RateLimiter, TooLarge, TooManyRequests, Unauthorized, check_size
from lodestar.plans.metrics import Metrics
from lodestar.plans.service import AuditLog, scrape
from lodestar.sources.codecs import CodecError

#: What each error means to a caller; others are 500.
STATUS: tuple[tuple[type[Exception], int], ...] = ((Unauthorized, 401), (TooLarge, 413), (TooManyRequests, 429), (Overloaded, 503), (NotFound, 404), (QuotaExceeded, 409), (Conflict, 409), (ValidationError, 400), (DimensionError, 400), (FilterError, 400), (CodecError, 400), (PermissionError, 403), (ValueError, 400))
#: Calls that may span all tenants; the rest belong to one.
SPANNING = {"list_collections", "list_tenants", "list_backups", "metrics"}


class CallError(RuntimeError):
    """A failed call: its status, its trace id, and the error behind it."""

    def __init__(self, status: int, trace_id: str, cause: Exception):
        super().__init__(f"{status} ({trace_id}): {cause}")
        self.status, self.trace_id, self.cause = status, trace_id, cause


@dataclass(frozen=True)
class Config:
    """Settings of a client."""

    slow_query_ms: float = 250.0
    default_tenant: str = policy.DEFAULT_TENANT
    audit_size: int = 1_000
    body_bytes: int = 256 << 20
    calls_at_a_time: int = 1_024
    calls_a_second: float | None = None
    burst: float = 100.0


@dataclass
class Client:
    """Calls on behalf of a principal. tenant is the scope: None (only for admins of all tenants) spans all."""

    db: Database
    principal: str = "anonymous"
    roles: tuple[str, ...] = ("ADMIN",)
    tenant: str | None = policy.DEFAULT_TENANT
    config: Config = field(default_factory=Config)
    metrics: Metrics = field(default_factory=Metrics)
    audit: AuditLog | None = None
    permits: Permits | None = None
    limiter: RateLimiter | None = None

    def __post_init__(self):
        self.permits = self.permits or Permits(self.config.calls_at_a_time)
        if self.limiter is None and self.config.calls_a_second:
            self.limiter = RateLimiter(self.config.calls_a_second, self.config.burst)
        self.audit = self.audit or AuditLog(self.db, self.config.audit_size)
        if not isinstance(self.db.observer, Metrics):
            self.db.observer = self.metrics
        self.metrics = self.db.observer

    def with_tenant(self, tenant: str | None) -> Client:
        return replace(self, tenant=tenant)

    def with_principal(self, principal: str, roles: tuple[str, ...]) -> Client:
        return replace(self, principal=principal, roles=tuple(roles))

    def with_key(self, keys: Keys, key: str | None) -> Client:
        """On behalf of whom a key belongs to; CallError 401 if to nobody."""
        try:
            who = keys.of(key)
        except Unauthorized as e:
            self.metrics.called("KEY /", 401)
            raise CallError(401, uuid.uuid4().hex, e) from e
        return replace(self, principal=who.principal, roles=who.roles, tenant=who.tenant)

    def _call(self, name: str, route: str, f: Callable, tenant: str | None = None):
        """f(tenant), if the roles and the scope allow the call; every call is recorded with its status."""
        trace, status = uuid.uuid4().hex, 200
        try:
            if not policy.allowed(self.roles, name):
                raise PermissionError(f"{name} needs the role {policy.NEEDS[name]}")
            if self.tenant is not None and tenant not in (None, self.tenant):
                raise PermissionError(f"tenant {tenant} is outside of the scope {self.tenant}")
            own = tenant or self.tenant
            if own is None and name not in SPANNING:
                raise PermissionError(f"{name} needs a tenant")
            if self.limiter:
                self.limiter.take(own, self.principal)
            with self.permits.held():
                return f(own)
        except Exception as e:
            status = next((s for kind, s in STATUS if isinstance(e, kind)), 500)
            raise CallError(status, trace, e) from e
        finally:
            self.metrics.called(route, status)
            self.audit.record(self.principal, self.roles, route.split()[0], route.split()[1], status, trace_id=trace)

    def health(self) -> dict:
        self.metrics.called("GET /health", 200)
        return {"status": "UP", "time": time.time()}

    def scrape(self) -> str:
        return self._call("metrics", "GET /metrics", lambda t: scrape(self.db, t) + "".join(f"{x}\n" for x in self.metrics.lines(t)))

    def list_collections(self) -> list[dict]:
        return self._call("list_collections", "GET /collections", self.db.list_collections)

    def create_collection(self, name: str, dimension: int, metric: str | None = None, flush_bytes: int | None = None, columns=()) -> dict:
        return self._call("create_collection", "POST /collections", lambda t: self.db.create(name, dimension, metric, t, flush_bytes, columns).stats())

    def get_collection(self, name: str) -> dict:
        return self._call("get_collection", "GET /collections/{name}", lambda t: self.db.open(name, t).stats())

    def list_tenants(self) -> list[str]:
        return self._call("list_tenants", "GET /tenants", lambda t: self.db.tenants() if t is None else [t])

    def get_tenant(self, tenant: str | None = None) -> dict:
        return self._call("get_tenant", "GET /tenants/{tenant}", self.db.tenant_stats, tenant)

    def list_backups(self, backup_id: str | None = None) -> list[dict]:
        return self._call("list_backups", "GET /backups", lambda t: self.db.backups(t, backup_id))

    def snapshot_tenant(self, backup_id: str, tenant: str | None = None) -> list[dict]:
        return self._call("snapshot_tenant", "POST /tenants/{tenant}/snapshots", lambda t: self.db.snapshot_tenant(t, backup_id), tenant)

    def upsert(self, name: str, records) -> int:
        """Records of one request, of body_bytes at most as JSON."""

        def put(t):
            check_size(len(json.dumps(records)), self.config.body_bytes)
            return self.db.open(name, t).upsert_records(records)

        return self._call("upsert", "POST /collections/{name}/vectors", put)

    def bulk_load(self, name: str, source: str, mode: str = "JSON", flush: bool = False, compact: bool = False) -> int:
        """Records of files, of any size."""
        return self._call("upsert", "POST /collections/{name}/vectors:stream", lambda t: self.db.open(name, t).bulk_load(source, mode, flush, compact))

    def partial_update(self, name: str, updates) -> int:
        return self._call("partial_update", "PATCH /collections/{name}/vectors", lambda t: self.db.open(name, t).partial_update(updates))

    def delete(self, name: str, ids) -> int:
        return self._call("delete", "DELETE /collections/{name}/vectors", lambda t: self.db.open(name, t).delete(ids))

    def search(self, name: str, vector, k: int, where: dict | None = None, **options) -> list[dict]:
        def found(t):
            c = self.db.open(name, t)
            hits = c.search(vector, k, where, **options)
            self.last_search = c.last_search | {"slow": policy.is_slow(c.last_search["seconds"], self.config.slow_query_ms)}
            return hits

        return self._call("search", "POST /collections/{name}/search", found)

    def stats(self, name: str) -> dict:
        return self._call("stats", "GET /collections/{name}/stats", lambda t: self.db.open(name, t).stats())

    def flush(self, name: str) -> bool:
        return self._call("flush", "POST /collections/{name}/flush", lambda t: self.db.open(name, t).flush())

    def compact(self, name: str) -> bool:
        return self._call("compact", "POST /collections/{name}/compact", lambda t: self.db.open(name, t).compact())

    def backup(self, name: str, backup_id: str) -> dict:
        return self._call("backup", "POST /collections/{name}/backups", lambda t: self.db.backup(name, backup_id, t))

    def restore(self, name: str, backup_id: str, target: str) -> dict:
        return self._call("restore", "POST /collections/{name}/restore", lambda t: self.db.restore(name, backup_id, target, t).stats())
