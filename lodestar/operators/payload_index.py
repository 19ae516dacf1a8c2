"""Indexes of payloads: typed columns that a scan can filter by, and a table of posted values."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.payload import dumps
from lodestar.operators.filters import RANGE, Node, Payload, parse

#: What a promoted path keeps of its value: the text of a string, the double of a number, else nulls.
FIELD = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType())])


def fields_type(paths: list[str]) -> T.StructType:
    """The struct of promoted paths; names are by place, as a path may hold any character."""
    return T.StructType([T.StructField(f"f{i}", FIELD) for i in range(len(paths))])


def fields(payload: Column, paths: list[str]) -> Column:
    """The promoted values of a payload (JSON text); lists, maps, booleans and missing values are null, as no range or equality of a scalar holds for them."""
    p = Payload(F.parse_json(payload))
    own = [F.struct(p.text(p.at(x)).alias("s"), p.number(p.at(x)).alias("n")).alias(f"f{i}") for i, x in enumerate(paths)]
    return F.struct(*own).cast(fields_type(paths))


def implied(spec: dict | Node | None, paths: list[str], column: str = "fields") -> Column | None:
    """A condition on promoted columns that every row which passes the filter meets; None if there is none.

    It is made of comparisons of one column with one literal, so a Parquet scan skips row groups by it; the filter itself decides after.
    """
    n = spec if isinstance(spec, Node) else parse(spec)
    if n.kind in ("and", "or"):
        parts = [implied(c, paths, column) for c in n.children]
        known = [c for c in parts if c is not None]
        if not known or (n.kind == "or" and len(known) < len(parts)):
            return None
        out = known[0]
        for c in known[1:]:
            out = (out & c) if n.kind == "and" else (out | c)
        return out
    if n.kind == "not" or n.path not in paths:
        return None
    at = f"{column}.f{paths.index(n.path)}"

    def compare(value, f) -> Column | None:
        if isinstance(value, bool) or not isinstance(value, (str, int, float)):
            return None
        if isinstance(value, str):
            return f(F.col(f"{at}.s"), F.lit(value))
        return f(F.col(f"{at}.n"), F.lit(float(value))) if abs(value) < 1 << 53 else None

    if n.kind == "$eq":
        return compare(n.value, lambda a, b: a == b)
    if n.kind == "$in":
        parts = [compare(v, lambda a, b: a == b) for v in n.value]
        if not parts or any(c is None for c in parts):
            return None
        out = parts[0]
        for c in parts[1:]:
            out = out | c
        return out
    return compare(n.value, RANGE[n.kind]) if n.kind in RANGE else None


def _posted(value, path: str = ""):
    """(path, JSON of the value) of each scalar of a payload; those of a list stand under the list's path, an empty path is left out."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _posted(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for v in value:
            yield from _posted(v, path)
    elif path:
        yield path, dumps(value)


def postings(rows: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """(path, value, keys): a row for each different scalar of each payload (JSON text), value as JSON. Null payloads have none.

    Written in order of path and value, it answers an equality by the few row groups that hold it.
    """
    kinds = [rows.schema[k] for k in keys]

    def run(batches):
        for b in batches:
            row, path, value = [], [], []
            for i, text in enumerate(b.column(len(keys)).to_pylist()):
                for p, v in dict.fromkeys(_posted(json.loads(text))) if text else ():
                    row.append(i), path.append(p), value.append(v)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(value, pa.string()), *(b.column(i).take(at) for i in range(len(keys)))], names=["path", "value", *keys])

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), *kinds])
    return rows.select(*keys, payload).mapInArrow(run, schema)


def candidates(posted: DataFrame, spec: dict | Node | None, keys: list[str]) -> DataFrame | None:
    """The keys that the postings offer for a filter of equalities, $in and $contains, joined by and / or; None where they can't tell.

    Each leaf is a pushed-down scan of the postings; and is an intersection, or a union.
    """
    n = spec if isinstance(spec, Node) else parse(spec)
    if n.kind in ("and", "or"):
        parts = [candidates(posted, c, keys) for c in n.children]
        known = [c for c in parts if c is not None]
        if not known or (n.kind == "or" and len(known) < len(parts)):
            return None
        out = known[0]
        for c in known[1:]:
            out = out.join(c, keys, "left_semi") if n.kind == "and" else out.unionByName(c)
        return out.distinct() if n.kind == "or" else out
    values = n.value if n.kind == "$in" else [n.value]
    if n.kind not in ("$eq", "$in", "$contains") or any(isinstance(v, (list, dict)) for v in values):
        return None
    return posted.where((F.col("path") == n.path) & F.col("value").isin([dumps(v) for v in values])).select(*keys).distinct()
