"""From raw documents to a clean, mixed and tokenised corpus: five stages over the documents table.

Each stage takes what its predecessor kept, with the columns of documents, and its decisions
take effect: rejected documents, later copies and repeated passages are gone for all that
follow.  The last stage returns tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.bpe import round_trip
from rollcall.llm.minhash import with_classes
from rollcall.llm.mixing import mix_sources
from rollcall.llm.quality import score_quality, train_quality
from rollcall.llm.suffixes import remove_repeats
from rollcall.session import settle

#: documents that score less are rejected
LEAST_QUALITY = 0.5
#: bytes of a repeated passage; nearly all passages of 51 words are longer, but such of very short words (from 101 bytes on) are not found
PASSAGE_BYTES = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Each row is judged by its text alone, so repeated rows, rows without an id and ties fare alike; NULL and empty texts get a
    score as well.  All columns go on, whatever their names; an empty table stays empty.
    """
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate documents the one with the smallest id.

    Rows that repeat that id, and rows of a class without any id, all stay.  NULL and empty texts are nobody's copies.
    """
    return with_classes(docs).where(F.col("row.doc_id").eqNullSafe(F.col("class_id"))).select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``PASSAGE_BYTES`` that start earlier; a document of which nothing is left goes."""
    others = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(docs, keep=others, length=PASSAGE_BYTES, first=True)
    cut = cut.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("n_removed") > 0
    values = {"text": F.col("kept"), "n_chars": F.when(changed, F.char_length("kept")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[(values[c] if c in values else F.col(f"row.{c}")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Rows that share an id, or have none, are taken or left together; documents without words add nothing and count for nothing.
    """
    mixed = mix_sources(docs)
    return mixed.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their digest, and the digest of the decoded bytes; NULL is an empty text without ids.

    Other columns go on, but for such that are named like a result.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    others = [c for c in docs.columns if c != "text"]
    return round_trip(docs, ranks, public_tokenizers.PATTERN, others, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing to target weights", mix),
    ("byte-level BPE", tokenise),
]

#: fitting and merging have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
