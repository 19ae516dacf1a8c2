"""Vector batches as JSON bodies, JSON lines, and binary streams."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the binary stream: magic and version, then the dimension, all big-endian.
MAGIC, VERSION = 0x41584231, 1
RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("payload", T.StringType())])


class CodecError(ValueError):
    """Bytes or lines that aren't a batch of vectors."""


def encode_batch(records, dimension: int) -> bytes:
    """Records (id, vector, payload as JSON text or None) as one stream; one record at least."""
    out = [struct.pack(">iii", MAGIC, VERSION, dimension)]
    for record_id, vector, payload in records:
        if len(vector) != dimension:
            raise CodecError(f"{record_id}: {len(vector)} components, not {dimension}")
        name, body = record_id.encode(), (payload or "{}").encode()
        out += [struct.pack(">ii", len(name), len(body)), name, np.asarray(vector, dtype=">f4").tobytes(), body]
    if len(out) == 1:
        raise CodecError("no records")
    return b"".join(out)


def decode_batch(raw: bytes, dimension: int | None = None) -> list[tuple[str, list[float], str]]:
    if len(raw) < 12:
        raise CodecError("no header")
    magic, version, d = struct.unpack(">iii", raw[:12])
    if magic != MAGIC or version != VERSION or d <= 0:
        raise CodecError("not a vector batch")
    if dimension is not None and d != dimension:
        raise CodecError(f"dimension {d}, not {dimension}")
    out, at = [], 12
    while at < len(raw):
        if at + 8 > len(raw):
            raise CodecError("a record is cut off")
        n, m = struct.unpack(">ii", raw[at : at + 8])
        end = at + 8 + n + 4 * d + m
        if n <= 0 or m < 0 or end > len(raw):
            raise CodecError("a record is cut off")
        at += 8
        vector = np.frombuffer(raw[at + n : at + n + 4 * d], dtype=">f4").astype(np.float32).tolist()
        out.append((raw[at : at + n].decode(), vector, raw[at + n + 4 * d : end].decode() or "{}"))
        at = end
    if not out:
        raise CodecError("no records")
    return out


def read_binary(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """(id, vector, payload) of all stream files under path; a file is decoded by one task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(frames):
        import pandas as pd

        for f in frames:
            for raw in f["content"]:
                yield pd.DataFrame(decode_batch(bytes(raw), dimension), columns=["id", "vector", "payload"])

    return files.mapInPandas(run, RECORD)


def encode_partitions(rows: DataFrame, dimension: int) -> DataFrame:
    """(content binary): a stream for each Arrow batch of (id, vector, payload)."""

    def run(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                yield pd.DataFrame({"content": [encode_batch(zip(f["id"], f["vector"], f["payload"]), dimension)]})

    return rows.select("id", "vector", "payload").mapInPandas(run, "content binary")


def decode_rows(streams: DataFrame, dimension: int | None = None) -> DataFrame:
    def run(frames):
        import pandas as pd

        for f in frames:
            for raw in f["content"]:
                yield pd.DataFrame(decode_batch(bytes(raw), dimension), columns=["id", "vector", "payload"])

    return streams.mapInPandas(run, RECORD)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, payload) of JSON lines; blank lines are passed over, a malformed one fails."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame) -> DataFrame:
    """The records of lines (value); payloads of any shape stay JSON text."""
    text = lines.where(F.trim("value") != "")
    v = F.parse_json("value")
    record_id = F.trim(F.try_variant_get(v, "$.id", "string"))
    vector = F.try_variant_get(v, "$.vector", "array<float>")
    payload = F.coalesce(F.to_json(F.try_variant_get(v, "$.payload", "variant")), F.lit("{}"))
    out = text.select("value", record_id.alias("id"), vector.alias("vector"), F.when(payload == "null", "{}").otherwise(payload).alias("payload"))
    bad = F.col("id").isNull() | (F.col("id") == "") | F.col("vector").isNull() | (F.size("vector") == 0)
    return out.select(F.when(bad, F.raise_error(F.concat(F.lit("a record lacks its id or vector: "), F.substring("value", 1, 120)))).otherwise(F.col("id")).alias("id"), "vector", "payload")


def read_body(spark: SparkSession, path: str) -> DataFrame:
    """The records of files that each hold one object {"vectors": [...]}."""
    v = F.try_variant_get(F.parse_json("value"), "$.vectors", "array<variant>")
    return parse_lines(spark.read.text(path, wholetext=True).select(F.explode(v).alias("v")).select(F.to_json("v").alias("value")))


def to_lines(rows: DataFrame) -> DataFrame:
    """(value): one JSON object for each of (id, vector, payload)."""
    payload = F.parse_json(F.coalesce("payload", F.lit("{}")))
    return rows.select(F.to_json(F.struct("id", "vector", payload.alias("payload"))).alias("value"))


def decode_json_lines(text: str) -> list[dict]:
    """The objects of a small request's lines; errors carry the line's number."""
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                out.append(json.loads(line))
            except ValueError as e:
                raise CodecError(f"line {i}: {e}") from e
    return out
