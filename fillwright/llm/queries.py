"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwright.session import scratch_dir, write_through

from .byte_bpe import round_trip
from .decontam import benchmark_windows, is_contaminated, mark_hits, name_items
from .html_extract import extract_text
from .importance import ORACLE as RESAMPLING_SQL
from .importance import resample
from .lexical import ORACLE as SEARCH_SQL
from .lexical import search_items
from .line_dedup import ORACLE as LINES_SQL
from .line_dedup import drop_boilerplate
from .minhash import near_duplicates
from .packing import pack_documents
from .quality import fit_quality, held_out, score_quality
from .secret_scan import scan_secrets, spans_text
from .sharding import HEAVY, SLOTS, assign_shards, first_map, load_map, rebalanced, sized_records, slot_totals, spread_heavy, store_map
from .substring_dedup import cut_repeats
from .vectors import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("secrets")).alias("spans"),
        count("entropy"),
    )


@query()
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = fit_quality(docs, _table(spark, sf_dir, "labels"), eligible=~held_out())
    return score_quality(docs, ranker).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query(LINES_SQL)
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query()
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@query()
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    checksum = F.crc32(F.coalesce("text", F.lit("")))
    records = sized_records(docs, ["doc_id", checksum]).select("doc_id", "size", checksum.alias("text_crc32"), "virtual_slot")
    # stored without the texts: slots are dealt and ranked by what stays the same
    records = write_through(records.withColumn("row", F.monotonically_increasing_id()))
    records = spread_heavy(records, "row")
    totals = write_through(slot_totals(records))
    maps = f"{scratch_dir(spark)}/shard-maps-{uuid.uuid4().hex}"
    store_map(first_map(spark, slots=SLOTS + 2 * HEAVY), maps)
    store_map(rebalanced(load_map(spark, maps), totals), maps)
    placed = assign_shards(records, load_map(spark, maps), totals, ["doc_id", "text_crc32", "size", "row"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


@query()
def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


@query()
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    windows = write_through(benchmark_windows(_table(spark, sf_dir, "benchmark")))
    # stored without the texts, so that the documents are marked once
    marked = write_through(mark_hits(docs, windows).drop("text"))
    hits = name_items(marked, windows, "doc_id")
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


@query(SEARCH_SQL)
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return search_items(docs, _table(spark, sf_dir, "benchmark"))


@query(RESAMPLING_SQL)
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resample(docs, _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
