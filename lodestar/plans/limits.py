"""Who calls, how often, how much at a time: keys, token buckets, permits and sizes."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field


class Unauthorized(PermissionError):
    """No key, or an unknown one (401)."""


class TooManyRequests(RuntimeError):
    """A caller's bucket is empty (429)."""


class Overloaded(RuntimeError):
    """As many calls as allowed are running (503)."""


class TooLarge(ValueError):
    """More bytes than one call may bring (413)."""


@dataclass(frozen=True)
class Identity:
    principal: str
    roles: tuple[str, ...]
    tenant: str | None = None  # None: all tenants


@dataclass
class Keys:
    """Identities by key. Given a source (a function that reads them), it is asked again when every seconds have passed."""

    by_key: dict[str, Identity] = field(default_factory=dict)
    source: Callable[[], dict[str, Identity]] | None = None
    every: float = 1.0
    clock: Callable[[], float] = time.monotonic
    read_at: float = float("-inf")

    def of(self, key: str | None) -> Identity:
        """The identity of a key, also as "Bearer key"."""
        if self.source and self.clock() - self.read_at >= self.every:
            self.by_key, self.read_at = self.source(), self.clock()
        key = (key or "").strip().removeprefix("Bearer ").strip()
        if key not in self.by_key:
            raise Unauthorized("no such key")
        return self.by_key[key]


@dataclass
class RateLimiter:
    """A token bucket for each caller: rate tokens a second, burst at most. Buckets that nobody has used for idle seconds go."""

    rate: float
    burst: float
    idle: float = 600.0
    clock: Callable[[], float] = time.monotonic
    buckets: dict[tuple, tuple[float, float]] = field(default_factory=dict)
    swept: float = 0.0
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def take(self, *caller) -> None:
        with self.lock:
            now = self.clock()
            if now - self.swept > self.idle:
                self.buckets = {k: v for k, v in self.buckets.items() if now - v[1] <= self.idle}
                self.swept = now
            tokens, at = self.buckets.get(caller, (self.burst, now))
            tokens = min(self.burst, tokens + (now - at) * self.rate)
            if tokens < 1:
                self.buckets[caller] = tokens, now
                raise TooManyRequests(f"{caller}: at most {self.rate:g} a second")
            self.buckets[caller] = tokens - 1, now


class Permits:
    """So many calls at a time; one more is turned away at once."""

    def __init__(self, most: int = 1_024):
        self.free = threading.BoundedSemaphore(most)

    @contextmanager
    def held(self):
        if not self.free.acquire(blocking=False):
            raise Overloaded("too many calls at a time")
        try:
            yield
        finally:
            self.free.release()


def check_size(size: int, most: int = 256 << 20) -> None:
    if size > most:
        raise TooLarge(f"{size} bytes; at most {most} in one call")
