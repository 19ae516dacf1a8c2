"""From raw documents to a tokenised training mix: five operators in turn, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import byte_bpe, language_id, line_dedup, mixing, ngram_join, quality
from lodestar.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject; it learns from labels whose crc32 mod 5 isn't 0.

    Null and empty texts score as texts that both dictionaries shorten alike; without labels, or with one kind, all texts score the share of good
    labels. Repeated rows score alike. Empty documents: none kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    learn = labels.where(language_id.remainder(F.col("doc_id"), 5) != 0)
    return _columns(quality.classify(docs, quality.fit(docs, learn)).where("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of two lines or more that stand elsewhere before; n_chars follows the text.

    Null, empty and one-line texts stay; a text of which all lines go is ''. "Before" is by id, null last, then hash of the text; rows
    alike in both keep the same lines.
    """
    out = line_dedup.dedup_runs(_columns(docs))
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group joined by shingle sets alike to 0.75.

    Null, empty and blank texts and null ids link with nothing and stay; of repeated rows with the kept id all stay.
    """
    return _columns(ngram_join.keep_one(_columns(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null texts have no words and come as often as their source's whole copies, null sources are one source. Rows with one id, also null, come as
    often as the one of them that is taken most.
    """
    docs = _columns(docs)  # an extra column may have the name of the plan's
    plan = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    taken = docs.join(plan, docs.doc_id.eqNullSafe(plan.doc_id)).select(*(docs[c] for c in COLUMNS), "copies")
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids of each document, and a digest of what the ids decode to. Null texts are empty; repeated rows each have theirs."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN, ids="token_ids", keep=["doc_id", "source"], digests=True)
    return out.select("doc_id", "source", "n_tokens", "token_ids", "decoded_sha256")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokenize),
]

#: The quality scores and the rolling hashes of lines aren't in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
