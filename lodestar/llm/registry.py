"""The queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import byte_bpe, chroma, embedding_dedup, language_id, license_scan, line_dedup, mixing, ngram_join, quality, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The quartiles of each chroma filter over the bytes of prose, so that each bit of a code is set as often as not.
# With the bounds for music most bits of a text's codes are the same in all texts, and unrelated ones look alike.
TEXT_LEVELS = (
    (0.122, 0.291, 0.407), (-0.062, 0.069, 0.188), (-0.077, 0.0, 0.078), (-0.071, 0.0, 0.071), (-0.026, -0.001, 0.024), (-0.766, -0.613, -0.504), (0.228, 0.364, 0.471), (0.043, 0.131, 0.225),
    (-0.029, 0.0, 0.029), (-0.079, 0.0, 0.079), (-0.554, -0.535, -0.515), (0.327, 0.655, 0.789), (0.282, 0.371, 0.453), (-0.06, 0.044, 0.147), (-0.012, 0.0, 0.012), (-0.018, 0.0, 0.018),
)
#: Frames for samples as few as a text has: a text of 832 bytes has a code, one of 1,024 the four that aligning takes.
TEXT_FRAMES = {"frame": 128, "hop": 64, "span": 8}


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio, so the bytes of each text are read as 8-bit samples, in short frames for short texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = chroma.fingerprints(docs, "text", levels=TEXT_LEVELS, keep=["doc_id"], **TEXT_FRAMES)
    return chroma.align(prints, "doc_id", overlap=4, levels=TEXT_LEVELS, span=TEXT_FRAMES["span"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(language_id.remainder(F.col("doc_id"), 4) != 2))
    out = language_id.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (language_id.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=None, keep=["doc_id"], digests=True)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_vectors(_table(spark, sf_dir, "embeddings"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.group_similar(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    learn = labels.where(language_id.remainder(F.col("doc_id"), 5) != 0)
    out = quality.classify(docs, quality.fit(docs, learn), keep=["doc_id"])
    return out.select("doc_id", (language_id.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_chroma, op2_language_id, op3_source_mixing, op4_byte_bpe, op5_license_scan, op6_line_dedup, op7_embedding_dedup, op8_ngram_join, op9_quality, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": mixing.SQL, "op7_embedding_dedup": embedding_dedup.SQL, "op8_ngram_join": ngram_join.SQL}
