"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.bpe import round_trip
from rollcall.llm.common import load
from rollcall.llm.compact import passage_classes
from rollcall.llm.covertree import LINKS_SQL, embedding_links
from rollcall.llm.fim import FIM_SQL, fill_in_middle, restore
from rollcall.llm.html_text import extract_text
from rollcall.llm.kdtree import TOP_K_SQL, top_k
from rollcall.llm.lexical import SEARCH_SQL, build_index, rank_documents
from rollcall.llm.minhash import with_classes
from rollcall.llm.mixing import MIX_SQL, mix_sources
from rollcall.llm.packing import pack_documents
from rollcall.llm.quality import held_out, score_quality, train_quality
from rollcall.llm.suffixes import remove_repeats
from rollcall.llm.warc import WARC_SQL, archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@_query("op6_mix_sources", MIX_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix_sources(load(spark, sf, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


@_query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(load(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, ["doc_id"])


@_query("op8_quality_attention")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    model = train_quality(docs, load(spark, sf, "labels"))
    scored = score_quality(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_query("op10_html_text")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(load(spark, sf, "pages"))


@_query("op2_minhash_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = with_classes(load(spark, sf, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "class_id", F.col("row.doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


@_query("op7_suffix_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    found = remove_repeats(load(spark, sf, "documents"), first=False)
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"))


@_query("op9_warc_round_trip", WARC_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return archive_round_trip(load(spark, sf, "pages"))


@_query("op3_cover_tree_links", LINKS_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_links(load(spark, sf, "embeddings"))


@_query("op5_kd_tree_top_k", TOP_K_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(load(spark, sf, "embeddings"), F.col("id") % 100 == 0)


@_query("op4_compact_windows")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = passage_classes(load(spark, sf, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "class_id", "n_links", F.size("passages").alias("n_passages"), "passages")


@_query("op11_fill_in_middle", FIM_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    made = restore(fill_in_middle(load(spark, sf, "documents").select("doc_id", "text")))
    return made.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


@_query("op12_ranked_search", SEARCH_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return rank_documents(build_index(load(spark, sf, "documents")), load(spark, sf, "benchmark"))


@_query("op13_best_fit_packing")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = pack_documents(load(spark, sf, "documents"), path, public_tokenizers.PATTERN, ["doc_id"])
    return packed.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
