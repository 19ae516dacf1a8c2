"""Arrow rows that stand together by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which they stand together."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if rest and rest[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        for a, z in zip(cuts, cuts[1:]):
            rest.append(b.slice(a, z - a))
            if z < len(k):
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)
