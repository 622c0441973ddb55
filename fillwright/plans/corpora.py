"""Queries over order, samples, subsets and mixes of corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwright.operators.ordering import (
    chunk,
    dedupe_last,
    exact_rank,
    first_batches,
    limit_batches,
    seeded_shuffle,
    with_file_ordinal,
    with_key_ordinal,
)
from fillwright.operators.sampling import (
    RATIOS,
    mix_merged,
    mix_sequential,
    nested_subsets,
    percent_of,
    sample_ratio,
    train_eval_split,
)
from fillwright.plans.catalogue import query
from fillwright.plans.views import PAIR_SQL, sft_pairs, table, with_sql

RANKED_SQL = """
v_rank AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rank,
         count(*) OVER () AS n FROM documents)"""


def _documents(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select(*(columns or ["doc_id"]))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents")
def q_file_ordinal(spark, sf_dir):
    return with_file_ordinal(_documents(spark, sf_dir))


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS ord FROM documents")
def q_key_ordinal(spark, sf_dir):
    return with_key_ordinal(_documents(spark, sf_dir, "doc_id", "lang"), ["lang", "doc_id"])


@query(with_sql(RANKED_SQL) + "SELECT doc_id, rank FROM v_rank")
def q_exact_rank(spark, sf_dir):
    return exact_rank(_documents(spark, sf_dir), "doc_id")


@query(
    """SELECT l_orderkey, l_linenumber, row_number() OVER (
    ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber), l_orderkey, l_linenumber) - 1 AS ord
    FROM lineitem"""
)
def q_seeded_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    # the table repeats some of these keys
    return seeded_shuffle(rows, ["l_orderkey", "l_linenumber"], seed=7, unique=False)


@query(
    with_sql(RANKED_SQL)
    + """SELECT doc_id, md5(text) AS md5_text FROM documents JOIN v_rank USING (doc_id)
    WHERE rank <= floor(n * CAST(0.29 AS DOUBLE))"""
)
def q_sample_ratio(spark, sf_dir):
    sample = sample_ratio(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", 0.29)
    return sample.select("doc_id", F.md5("text").alias("md5_text"))


@query(
    with_sql(RANKED_SQL)
    + " UNION ALL ".join(
        f"SELECT {percent_of(r)} AS pct, doc_id FROM v_rank WHERE rank <= floor(n * CAST({r} AS DOUBLE))"
        for r in RATIOS
    )
)
def q_nested_subsets(spark, sf_dir):
    return nested_subsets(_documents(spark, sf_dir), "doc_id").select("pct", "doc_id")


@query(
    with_sql(RANKED_SQL)
    + """SELECT CASE WHEN rank <= ceil(n * CAST(0.05 AS DOUBLE)) THEN 'eval' ELSE 'train' END AS split,
    count(*) AS n FROM v_rank GROUP BY 1"""
)
def q_train_eval_split(spark, sf_dir):
    parts = train_eval_split(_documents(spark, sf_dir), "doc_id")
    return parts.groupBy("split").agg(F.count("*").alias("n"))


_SOURCES = with_sql(PAIR_SQL) + """, v_mix AS (
  SELECT id, md5(problem) AS md5_problem, 'chat' AS source, 0 AS pos FROM v_sft UNION ALL
  SELECT doc_id, md5(text), 'docs', 1 FROM documents)
"""


def _sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.md5("text").alias("md5_problem")
    )
    chat = sft_pairs(spark, sf_dir).select("id", F.md5("problem").alias("md5_problem"))
    return {"chat": chat, "docs": docs}


@query(
    _SOURCES
    + """SELECT id, md5_problem, source, pos AS source_ord, row_number() OVER (
    ORDER BY md5('42:' || pos || ':' || id), pos, id) - 1 AS ord FROM v_mix"""
)
def q_mix_merged(spark, sf_dir):
    return mix_merged(_sources(spark, sf_dir), "id", seed=42)


@query(
    _SOURCES
    + """SELECT id, md5_problem, source, pos AS stage, row_number() OVER (
    PARTITION BY pos ORDER BY md5('42:' || id), id) - 1 AS ord FROM v_mix"""
)
def q_mix_sequential(spark, sf_dir):
    shuffled = {k: seeded_shuffle(v, "id") for k, v in _sources(spark, sf_dir).items()}
    return mix_sequential(shuffled)


_BATCHES = """SELECT batch_id, count(*) AS n, min(doc_id) AS first_id FROM (
  SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id FROM documents)"""


def _batches(spark, sf_dir):
    return chunk(with_key_ordinal(_documents(spark, sf_dir), "doc_id"), 32)


def _summary(batches):
    return batches.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_id")
    )


@query(_BATCHES + " GROUP BY batch_id")
def q_chunk(spark, sf_dir):
    return _summary(_batches(spark, sf_dir))


@query(_BATCHES + " WHERE batch_id < 5 GROUP BY batch_id")
def q_limit_batches(spark, sf_dir):
    # the cut to a number of batches is the operator; the second cut finds it done
    batches = first_batches(_documents(spark, sf_dir), "doc_id", 32, 5)
    return _summary(limit_batches(batches, 5))


@query(
    """SELECT user_id, arg_max(event_type, event_id) AS event_type,
    arg_max(event_id, event_id) AS last_id, min(event_id) AS ord FROM events GROUP BY user_id"""
)
def q_dedupe_last(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.col("event_id").alias("last_id"), F.col("event_id").alias("ord")
    )
    return dedupe_last(events, key="user_id")
