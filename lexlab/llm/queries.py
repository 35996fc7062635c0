"""Queries of the subpackage: one ``opN_<name>`` per operator, plus ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_tool_call_linking")
def op1_tool_call_linking(spark, sf_dir):
    from lexlab.llm import chat
    calls, results = chat.events(table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(calls, results, chat.SCHEMAS)


@query("op2_pu_quality")
def op2_pu_quality(spark, sf_dir):
    from lexlab.llm import quality
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    from lexlab.llm import packing
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark, sf_dir):
    from lexlab.llm import jaccard
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


@query("op5_piecewise_fingerprints")
def op5_piecewise_fingerprints(spark, sf_dir):
    from lexlab.llm import fingerprints
    found = fingerprints.against_next(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                        "next_fingerprint")


@query("op7_url_filters")
def op7_url_filters(spark, sf_dir):
    from lexlab.llm import urlfilter
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


@query("op6_ring_shards")
def op6_ring_shards(spark, sf_dir):
    from pyspark.sql import functions as F

    from lexlab.llm import sharding
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op9_decontaminate")
def op9_decontaminate(spark, sf_dir):
    from lexlab.llm import decontaminate as d
    return d.digest(d.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from lexlab.llm import secrets
    found = secrets.scan_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
                        "spans", "n_layers", "n_refused")


@query("op10_line_dedup")
def op10_line_dedup(spark, sf_dir):
    from lexlab.llm import linededup
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark, sf_dir):
    from lexlab.llm import alignment
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                     tokenizer_path("piece_bpe_32k.model"))


@query("op12_source_divergence")
def op12_source_divergence(spark, sf_dir):
    from lexlab.llm import divergence
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


@query("op13_cutting_stock_packing")
def op13_cutting_stock_packing(spark, sf_dir):
    from pyspark.sql import functions as F

    from lexlab.llm import cuttingstock
    packed = cuttingstock.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _oracles() -> None:
    from lexlab.llm import decontaminate, divergence, urlfilter
    ORACLE["op12_source_divergence"] = divergence.oracle_sql()
    ORACLE["op9_decontaminate"] = decontaminate.oracle_sql()
    ORACLE["op7_url_filters"] = urlfilter.oracle_sql()


_oracles()
