"""The payload filter language: parsed once, then compiled to one two-valued Column.

Two modes. "strict" is the documented meaning. "compat" also asks an index of posted values, as the data model has it: a value is posted
under its path if it is a scalar, and each scalar of a list under the list's path. Both answers must be yes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}
OPERATORS = {"$eq", "$in", "$contains", *RANGE}


class FilterError(ValueError):
    """A malformed filter."""


@dataclass(frozen=True)
class Node:
    """kind: and, or, not, or an operator on path with value."""

    kind: str
    children: tuple[Node, ...] = ()
    path: str = ""
    value: object = field(default=None, hash=False)


def parse(spec: dict | None, prefix: str = "") -> Node:
    """The tree of a filter; nothing or an empty map matches all."""
    if not spec:
        return Node("and")
    if not isinstance(spec, dict):
        raise FilterError("a filter must be an object")
    return Node("and", tuple(_entry(k, v, prefix) for k, v in spec.items()))


def _entry(key: str, value, prefix: str) -> Node:
    if key in ("$and", "$or"):
        if not isinstance(value, (list, tuple)) or not value:
            raise FilterError(f"{key} takes an array that isn't empty")
        return Node(key[1:], tuple(parse(_object(v, key), prefix) for v in value))
    if key == "$not":
        return Node("not", (parse(_object(value, key), prefix),))
    path = f"{prefix}.{key}" if prefix else key
    if not isinstance(value, dict) or not value:
        return Node("$eq", path=path, value=value)
    if not any(k.startswith("$") for k in value):
        return parse(value, path)
    if unknown := sorted(set(value) - OPERATORS):
        raise FilterError(f"unknown operator {unknown[0]}")
    if "$in" in value and not isinstance(value["$in"], (list, tuple)):
        raise FilterError("$in takes an array")
    return Node("and", tuple(Node(k, path=path, value=v) for k, v in value.items()))


def _object(value, key: str) -> dict:
    if not isinstance(value, dict):
        raise FilterError(f"{key} takes objects")
    return value


class Payload:
    """Values of a payload kept as a VARIANT column (or parsed from JSON text)."""

    def __init__(self, variant: Column):
        self.variant = variant

    def at(self, path: str) -> Column:
        keys = "".join("[" + json.dumps(k) + "]" for k in path.split("."))
        return F.try_variant_get(self.variant, "$" + keys, "variant")

    @staticmethod
    def kind(x: Column) -> Column:
        return F.schema_of_variant(x)

    def equals(self, x: Column, value) -> Column:
        """By type as well: 1 isn't 1.0, nor "1"."""
        kind = self.kind(x)
        if isinstance(value, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == value)
        if isinstance(value, int):
            if abs(value) < 1 << 63:
                return (kind == "BIGINT") & (F.try_variant_get(x, "$", "bigint") == value)
            return kind.startswith("DECIMAL") & (F.try_variant_get(x, "$", "decimal(38,0)") == F.lit(str(value)).cast("decimal(38,0)"))
        if isinstance(value, float):
            return (kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")) & (F.try_variant_get(x, "$", "double") == value)
        if isinstance(value, str):
            return (kind == "STRING") & (F.try_variant_get(x, "$", "string") == value)
        raise FilterError(f"no comparison with {type(value).__name__}")

    def elements(self, x: Column) -> Column:
        return F.when(self.kind(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>"))

    def is_null(self, x: Column) -> Column:
        return F.coalesce(F.is_variant_null(x), F.lit(False))

    def missing(self, x: Column) -> Column:
        return x.isNull()

    def text(self, x: Column) -> Column:
        return F.when(self.kind(x) == "STRING", F.try_variant_get(x, "$", "string"))

    def number(self, x: Column) -> Column:
        kind = self.kind(x)
        return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(x, "$", "double"))

    def flag(self, x: Column) -> Column:
        return F.when(self.kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))

    def same_json(self, x: Column, value) -> Column:
        return F.to_json(x) == json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Columns(Payload):
    """Values that stand in typed columns, which the Parquet scan can filter by."""

    def __init__(self, schema):
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields}

    def at(self, path: str) -> Column:
        self.now = self.types.get(path, "")
        return F.col(path) if self.now else F.col("`" + "`.`".join(path.split(".")) + "`")

    def equals(self, x: Column, value) -> Column:
        return x == F.lit(value)

    def elements(self, x: Column):
        return x if self.now.startswith("array") else F.lit(None)

    def is_null(self, x: Column) -> Column:
        return x.isNull()

    def text(self, x: Column):
        return x if self.now in ("string", "") else F.lit(None).cast("string")

    def number(self, x: Column):
        return x if self.now not in ("string", "boolean") and not self.now.startswith(("array", "struct", "map")) else F.lit(None).cast("double")

    def flag(self, x: Column):
        return x if self.now == "boolean" else F.lit(None).cast("boolean")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _posted(p: Payload, x: Column, value) -> Column:
    if value is None:
        return _sure(p.is_null(x))
    if isinstance(value, (list, dict)):
        return F.lit(False)
    direct = _sure(p.equals(x, value))
    if isinstance(p, Columns):
        return _sure(F.array_contains(x, value)) if p.now.startswith("array") else direct
    return direct | _sure(F.exists(p.elements(x), lambda e: _sure(p.equals(e, value))))


def _matches(n: Node, p: Payload, compat: bool) -> Column:
    if n.kind in ("and", "or", "not"):
        parts = [_matches(c, p, compat) for c in n.children]
        if n.kind == "not":
            return ~parts[0]
        out = F.lit(n.kind == "and")
        for c in parts:
            out = (out & c) if n.kind == "and" else (out | c)
        return out
    x, v = p.at(n.path), n.value
    if n.kind == "$eq":
        if v is None:
            return _sure(p.is_null(x)) | p.missing(x)
        if isinstance(v, (list, dict)):
            return _sure(p.same_json(x, v))
        if isinstance(p, Columns) and p.now.startswith("array"):
            return F.lit(False)
        return _sure(p.equals(x, v))
    if n.kind == "$in":
        out = F.lit(False)
        for one in v:
            out = out | _matches(Node("$eq", path=n.path, value=one), p, compat)
        return out
    if n.kind == "$contains":
        if isinstance(p, Columns):
            if p.now.startswith("array"):
                return _sure(F.array_contains(x, v))
            return _sure(F.contains(x, F.lit(v))) if isinstance(v, str) else F.lit(False)
        inside = _sure(F.exists(p.elements(x), lambda e: _sure(p.is_null(e) if v is None else p.equals(e, v))))
        return inside | _sure(F.contains(p.text(x), F.lit(v))) if isinstance(v, str) else inside
    compare = RANGE[n.kind]
    if v is None:
        return ~(_sure(p.is_null(x)) | p.missing(x))
    if isinstance(v, bool):
        return _sure(compare(p.flag(x), F.lit(v)))
    if isinstance(v, (int, float)):
        return _sure(compare(p.number(x), F.lit(v if isinstance(p, Columns) else float(v))))
    if isinstance(v, str):
        return _sure(compare(p.text(x), F.lit(v)))
    raise FilterError(f"{n.kind} takes a scalar")


def _candidates(n: Node, p: Payload) -> Column | None:
    """Rows that the index of posted values offers; None for all."""
    if n.kind in ("and", "or", "not"):
        parts = [_candidates(c, p) for c in n.children]
        if n.kind == "not":
            return None if parts[0] is None else ~parts[0]
        if n.kind == "or" and (None in [c if c is None else 0 for c in parts] or not parts):
            return None
        known = [c for c in parts if c is not None]
        out = None
        for c in known:
            out = c if out is None else (out & c if n.kind == "and" else out | c)
        return out
    x, v = p.at(n.path), n.value
    if n.kind in ("$eq", "$contains"):
        return _posted(p, x, v)
    if n.kind == "$in":
        out = F.lit(False)
        for one in v:
            out = out | _posted(p, p.at(n.path), one)
        return out
    return _matches(n, p, True)


def compile_filter(spec: dict | Node | None, payload: Payload, mode: str = "compat") -> Column:
    """A Column that is true or false for every row. A range over another type is false."""
    if mode not in ("compat", "strict"):
        raise ValueError(f"mode {mode!r}")
    tree = spec if isinstance(spec, Node) else parse(spec)
    out = _matches(tree, payload, mode == "compat")
    offered = _candidates(tree, payload) if mode == "compat" else None
    return out if offered is None else out & offered


def _ranges(n: Node):
    if n.children:
        for c in n.children:
            yield from _ranges(c)
    elif n.kind in RANGE and n.value is not None:
        yield n


def check_ranges(rows: DataFrame, spec: dict | Node | None, payload: Payload) -> None:
    """Raise FilterError for a range over a path that holds values in rows, but none of the type of its bound. One pass for all ranges."""
    leaves = list(_ranges(spec if isinstance(spec, Node) else parse(spec)))
    if not leaves:
        return
    counts = []
    for i, n in enumerate(leaves):
        x = payload.at(n.path)
        own = payload.flag(x) if isinstance(n.value, bool) else payload.text(x) if isinstance(n.value, str) else payload.number(x)
        counts += [F.count_if(own.isNotNull()).alias(f"own{i}"), F.count_if(~payload.missing(x) & ~payload.is_null(x)).alias(f"any{i}")]
    seen = rows.agg(*counts).first()
    for i, n in enumerate(leaves):
        if seen[f"any{i}"] and not seen[f"own{i}"]:
            raise FilterError(f"{n.path} holds no value that {n.kind} {n.value!r} can be compared with")


class FilterBuilder:
    """Clauses joined by AND, as the map that ``parse`` takes."""

    def __init__(self):
        self.clauses: list[dict] = []

    def _add(self, clause: dict) -> FilterBuilder:
        self.clauses.append(clause)
        return self

    def eq(self, path: str, value) -> FilterBuilder:
        return self._add({path: value})

    def is_in(self, path: str, values) -> FilterBuilder:
        if not values:
            raise FilterError("in takes a value at least")
        return self._add({path: {"$in": list(values)}})

    def contains(self, path: str, value) -> FilterBuilder:
        return self._add({path: {"$contains": value}})

    def between(self, path: str, **bounds) -> FilterBuilder:
        """gt, gte, lt, lte: one at least."""
        if not bounds or set(bounds) - {"gt", "gte", "lt", "lte"}:
            raise FilterError("a range takes gt, gte, lt or lte")
        return self._add({path: {f"${k}": v for k, v in bounds.items()}})

    def raw(self, clause: dict) -> FilterBuilder:
        return self._add(dict(clause))

    def all_of(self, *parts: FilterBuilder) -> FilterBuilder:
        return self._add({"$and": [p.build() for p in parts]})

    def any_of(self, *parts: FilterBuilder) -> FilterBuilder:
        return self._add({"$or": [p.build() for p in parts]})

    def none_of(self, part: FilterBuilder) -> FilterBuilder:
        return self._add({"$not": part.build()})

    def build(self) -> dict:
        return {} if not self.clauses else self.clauses[0] if len(self.clauses) == 1 else {"$and": list(self.clauses)}
