"""Decisions that need no data: when to flush and compact, how to search, who may do what."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,127}")
DEFAULT_TENANT, DEFAULT_FLUSH_BYTES = "default", 64 << 20

# Fixed values of the search planner.
EXACT_ROWS, ANN_LEAST_ROWS, EF_LEAST, EF_MOST, RERANK_LEAST, RERANK_MOST = 256, 256, 64, 768, 24, 384
# Fixed values of the flush and compaction rules.
FLOOR_BYTES, STALE_FLUSH, SEGMENTS_MOST, DEBT, STALE_LEAST, TOMBSTONE_SHARE = 512 << 10, 256, 4, 256, 512, 0.15


def checked_name(name: str, what: str = "name") -> str:
    name = (name or "").strip()
    if not NAME.fullmatch(name):
        raise ValueError(f"{what} {name!r} isn't a letter or digit and up to 127 letters, digits, - or _")
    return name


def _doublings(n: int) -> int:
    """The least power of two not below n, as its exponent."""
    return max(0, max(1, n) - 1).bit_length()


@dataclass(frozen=True)
class SearchPlan:
    mode: str
    beam: int
    rerank: int


def plan_search(n: int, k: int, filtered: int | None = None, indexed: bool = True) -> SearchPlan:
    """How to search n rows, of which filtered pass the filter: exactly where rows are few beside k or the filter leaves few.

    The beam's ceiling comes last, so an approximate search gives at most EF_MOST rows.
    """
    k = max(1, k)
    offered = n if filtered is None else filtered
    left = max(offered, k)
    share = left / n if n else 0.0
    exact = not indexed or n <= max(EXACT_ROWS, 32 * k) or left <= max(512, 40 * k) or share <= 0.12
    beam = max(EF_LEAST, 6 * k) + 8 * _doublings(n)
    if 0 < offered < n:
        beam = min(beam, max(4 * k, offered))
    rerank = max(RERANK_LEAST, k * min(8, 2 + _doublings(left // k))) + (2 * k if share <= 0.35 else 0)
    return SearchPlan("EXACT" if exact else "APPROXIMATE", min(EF_MOST, max(4 * k, beam)), max(k, min(RERANK_MOST, rerank)))


def plan_batch(n: int, k: int) -> int:
    """Candidates a query of a batch search: what one search would look at, in its beam or to rank again."""
    p = plan_search(n, k)
    return max(p.beam, p.rerank)


def flush_mutations(dimension: int, held: int = 0, tombstones: int = 0, stale: int = 0) -> int:
    """Mutations after which to flush: twice as many for middling dimensions, unless much of what is held is dead or replaced."""
    calm = stale < 64 and not (held and 4 * tombstones >= held)
    return 512 if 384 <= dimension < 1536 and calm else 256


def flush_bytes(base: int, mutations: int, held: int, tombstones: int, stale: int, dimension: int) -> int:
    """Bytes after which to flush: fewer the more of what is held is dead or replaced, at least FLOOR_BYTES, never over base."""
    if not held:
        return base
    share = tombstones / held
    half = mutations >= flush_mutations(dimension, held, tombstones, stale) // 2
    part = 8 if share >= 0.5 else 4 if share >= 0.25 or stale >= STALE_FLUSH else 2 if half else 1
    return min(base, max(FLOOR_BYTES, base // part)) if part > 1 else base


def should_compact(segments: int, busy: bool, tombstone_debt: int, stale: int, live: int, tombstones: int) -> bool:
    if segments < 2 or busy:
        return False
    share = tombstones / (live + tombstones) if live + tombstones else 0.0
    return segments >= SEGMENTS_MOST or tombstone_debt >= DEBT or stale >= max(STALE_LEAST, live // 2) or share >= TOMBSTONE_SHARE


ROLES = {"READER": 0, "WRITER": 1, "ADMIN": 2}
#: The least role of each call.
NEEDS = {
    **dict.fromkeys(("search", "stats", "list_collections", "get_collection", "list_tenants", "get_tenant", "list_backups"), "READER"),
    **dict.fromkeys(("create_collection", "upsert", "partial_update", "delete"), "WRITER"),
    **dict.fromkeys(("metrics", "flush", "compact", "backup", "restore", "snapshot_tenant"), "ADMIN"),
}


def allowed(roles, call: str) -> bool:
    return max((ROLES[r] for r in roles), default=-1) >= ROLES[NEEDS[call]]


@dataclass(frozen=True)
class Quota:
    max_collections: int | None = None
    max_live_vectors: int | None = None
    max_storage_bytes: int | None = None

    def exceeded(self, collections: int, live: int, storage: int) -> str | None:
        for what, used, most in (("collections", collections, self.max_collections), ("live vectors", live, self.max_live_vectors), ("storage bytes", storage, self.max_storage_bytes)):
            if most is not None and used > most:
                return f"{what}: {used} of {most}"
        return None


def source_limit(most: int, foreground: int, throttled: int = 0, quiet: int = 0) -> int:
    """How many sources one search may read at a time."""
    return max(1, min(most, most - foreground // 16 - throttled + quiet // 64))


def is_slow(seconds: float, threshold_ms: float = 250.0) -> bool:
    return threshold_ms > 0 and seconds * 1000 >= threshold_ms
