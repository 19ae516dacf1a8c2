"""Payloads as JSON text: merging patches, and their size."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge(base, patch):
    """base with patch laid over it: maps merge, null takes a key out, all else replaces.

    A map that meets no map replaces it as it is, with the nulls inside it.
    """
    out = dict(base)
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        elif isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = merge(out[key], value)
        else:
            out[key] = value
    return out


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def merged(base: pd.Series, patches: pd.Series) -> pd.Series:
    """The base payload under its patches (array<string>), in order; null patches leave it as it is."""

    def one(b, ps):
        if b is None or ps is None or not len(ps):
            return b
        out = json.loads(b)
        for p in ps:
            out = merge(out, json.loads(p))
        return dumps(out)

    return pd.Series([one(b, p) for b, p in zip(base, patches)])


def footprint(record_id: Column, payload: Column, dimension: Column) -> Column:
    """Estimated bytes: id and payload as UTF-8, four bytes for each component and for the norm."""
    return F.octet_length(record_id) + F.coalesce(F.octet_length(payload), F.lit(0)) + 4 * dimension + 4
