"""Counters and latency histograms of calls and searches, and their text for scrapers."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from lodestar.plans.spi import Observer

# Bounds of the latency histogram, in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Histogram:
    """How many values were at most each bound, their sum and their number."""

    def __init__(self, bounds: tuple[float, ...] = BOUNDS):
        self.bounds, self.counts, self.total, self.n = bounds, [0] * len(bounds), 0.0, 0

    def add(self, value: float) -> None:
        self.total, self.n = self.total + value, self.n + 1
        for i, b in enumerate(self.bounds):
            self.counts[i] += value <= b

    def lines(self, name: str, labels: str) -> list[str]:
        own = f"{labels}," if labels else ""
        out = [f'{name}_bucket{{{own}le="{b:g}"}} {c}' for b, c in zip(self.bounds, self.counts)]
        return [*out, f'{name}_bucket{{{own}le="+Inf"}} {self.n}', f"{name}_sum{{{labels}}} {self.total:g}", f"{name}_count{{{labels}}} {self.n}"]


class Metrics(Observer):
    """Counts what it observes: calls by route and status, and by collection searches, their modes, cache hits, slow ones, seconds and rows scored."""

    SUMS = ("scored", "reranked", "returned")

    def __init__(self):
        self.calls: Counter = Counter()
        self.events: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.latency: dict[tuple[str, str], Histogram] = defaultdict(Histogram)

    def called(self, route: str, status: int) -> None:
        self.calls[route, status] += 1

    def searched(self, collection, metrics: dict) -> None:
        key = collection.tenant, collection.name
        own = self.events[key]
        own["searches"] += 1
        own[f"searches_{metrics['mode'].lower()}"] += 1
        own["search_cache_hits"] += bool(metrics["cache_hit"])
        own["slow_searches"] += bool(metrics["slow"])
        for k in self.SUMS:
            own[f"rows_{k}"] += metrics.get(k) or 0
        self.latency[key].add(metrics["seconds"])

    def mutated(self, collection, rows: int) -> None:
        self.events[collection.tenant, collection.name]["mutations"] += rows

    def flushed(self, collection) -> None:
        self.events[collection.tenant, collection.name]["flushes"] += 1

    def compacted(self, collection) -> None:
        self.events[collection.tenant, collection.name]["compactions"] += 1

    def lines(self, tenant: str | None = None) -> list[str]:
        """Samples below their types: all calls, and the collections of one tenant or of all."""
        out = []
        if tenant is None and self.calls:
            out.append("# TYPE lodestar_calls_total counter")
            out += [f'lodestar_calls_total{{route="{r}",status="{s}"}} {n}' for (r, s), n in sorted(self.calls.items())]
        shown = [k for k in sorted(self.events) if tenant in (None, k[0])]
        for name in sorted({n for k in shown for n in self.events[k]}):
            out.append(f"# TYPE lodestar_collection_{name}_total counter")
            out += [f'lodestar_collection_{name}_total{{tenant="{t}",collection="{c}"}} {self.events[t, c][name]}' for t, c in shown if name in self.events[t, c]]
        timed = [k for k in sorted(self.latency) if tenant in (None, k[0])]
        if timed:
            out.append("# TYPE lodestar_collection_search_seconds histogram")
        for t, c in timed:
            out += self.latency[t, c].lines("lodestar_collection_search_seconds", f'tenant="{t}",collection="{c}"')
        return out


def summary(seconds: list[float], statuses: list[int], wall: float) -> dict:
    """What a run of timed calls comes to: nearest-rank percentiles, statuses, and calls a second."""
    v = sorted(seconds)
    rank = lambda p: v[max(0, math.ceil(len(v) * p) - 1)] if v else 0.0
    return {"count": len(v), "p50": rank(0.5), "p95": rank(0.95), "p99": rank(0.99), "max": v[-1] if v else 0.0, "statuses": dict(Counter(statuses)), "qps": len(v) / wall if wall > 0 else 0.0}
