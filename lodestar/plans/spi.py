"""What an embedding program may put in place of the engine's own: a way to search, and an observer of what happens."""

from __future__ import annotations


class Searcher:
    """A way to search a collection. The engine's own are here; another one answers the same call."""

    def search(self, collection, vector, k: int, where: dict | None, mode: str) -> list[dict]:
        raise NotImplementedError


class ExactSearcher(Searcher):
    def search(self, collection, vector, k: int, where: dict | None, mode: str) -> list[dict]:
        return collection.exact(collection.manifest, vector, k, where, mode)


class ApproximateSearcher(Searcher):
    """By index files where the planner finds them worth it, else exactly."""

    def search(self, collection, vector, k: int, where: dict | None, mode: str) -> list[dict]:
        m = collection.manifest
        return collection._approximate(m, vector, k, where, mode) or collection.exact(m, vector, k, where, mode)


class Observer:
    """Called after each event; the base class does nothing."""

    def searched(self, collection, metrics: dict) -> None: ...

    def mutated(self, collection, rows: int) -> None: ...

    def flushed(self, collection) -> None: ...

    def compacted(self, collection) -> None: ...
