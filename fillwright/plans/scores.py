"""Queries over truths and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwright.functions.text import normalise_answer
from fillwright.operators.ordering import with_key_ordinal
from fillwright.operators.scoring import (
    answer_digest,
    exact_match,
    pair_by_key,
    pair_by_position,
    score_pairs,
    unpaired_predictions,
)
from fillwright.plans.catalogue import query
from fillwright.plans.views import (
    INFILL_SQL,
    PREDICTION_SQL,
    SAMPLED_SQL,
    WS_SQL,
    infill_tasks,
    predictions,
    sampled_predictions,
    with_sql,
)

_SAME = f"trim(ground_truth, {WS_SQL}) = trim(completion, {WS_SQL})"
COUNTS_SQL = f"""count(*) AS n, CAST(sum(CASE WHEN {_SAME} THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  CAST(sum(CASE WHEN {_SAME} THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS em"""
PAIRED_SQL = "FROM v_infill LEFT JOIN v_pred USING (task_id)"
_SAMPLED = "FROM v_infill LEFT JOIN v_samples USING (task_id)"


@query(with_sql(INFILL_SQL, PREDICTION_SQL) + f"SELECT {COUNTS_SQL} {PAIRED_SQL}")
def q_exact_match(spark, sf_dir):
    tasks = infill_tasks(spark, sf_dir)
    return exact_match(tasks, predictions(tasks))


@query(with_sql(INFILL_SQL, PREDICTION_SQL) + f"SELECT lang, {COUNTS_SQL} {PAIRED_SQL} GROUP BY lang")
def q_exact_match_by_lang(spark, sf_dir):
    tasks = infill_tasks(spark, sf_dir)
    return exact_match(tasks, predictions(tasks), by=["lang"])


@query(with_sql(INFILL_SQL, PREDICTION_SQL, SAMPLED_SQL) + f"SELECT {COUNTS_SQL} {_SAMPLED}")
def q_exact_match_samples(spark, sf_dir):
    tasks = infill_tasks(spark, sf_dir)
    return exact_match(tasks, sampled_predictions(tasks))


@query(
    with_sql(INFILL_SQL, PREDICTION_SQL, SAMPLED_SQL)
    + f"SELECT task_id, sample_idx, CASE WHEN {_SAME} THEN 1 ELSE 0 END AS correct {_SAMPLED}"
)
def q_pair_by_key(spark, sf_dir):
    tasks = infill_tasks(spark, sf_dir)
    pairs = pair_by_key(tasks.select("task_id", "ground_truth"), sampled_predictions(tasks))
    return pairs.select("task_id", "sample_idx", F.col("correct").cast("int"))


@query(
    with_sql(INFILL_SQL, PREDICTION_SQL, SAMPLED_SQL)
    + """SELECT task_id, sample_idx, 'no such task' AS reject_reason FROM v_samples
    WHERE task_id NOT IN (SELECT task_id FROM v_infill)"""
)
def q_unpaired_predictions(spark, sf_dir):
    tasks = infill_tasks(spark, sf_dir)
    return unpaired_predictions(tasks, sampled_predictions(tasks)).select(
        "task_id", "sample_idx", "reject_reason"
    )


@query(
    with_sql(INFILL_SQL, PREDICTION_SQL)
    + f""", t AS (SELECT ground_truth, row_number() OVER (ORDER BY doc_id) AS i FROM v_infill),
    p AS (SELECT completion, row_number() OVER (ORDER BY doc_id) AS i FROM v_pred)
    SELECT {COUNTS_SQL} FROM t JOIN p USING (i)"""
)
def q_pair_position(spark, sf_dir):
    tasks = infill_tasks(spark, sf_dir)
    truths = tasks.select("doc_id", answer_digest("ground_truth"))
    preds = predictions(tasks).select("doc_id", answer_digest("completion"))
    truth, pred = with_key_ordinal(truths, "doc_id"), with_key_ordinal(preds, "doc_id")
    return score_pairs(pair_by_position(truth, pred))


@query(
    with_sql(INFILL_SQL, PREDICTION_SQL)
    + f"""SELECT task_id, length(completion) AS n_raw,
    md5(trim(completion, {WS_SQL})) AS md5_answer FROM v_pred"""
)
def q_normalise_answer(spark, sf_dir):
    pred = predictions(infill_tasks(spark, sf_dir))
    return pred.select(
        "task_id",
        F.char_length("completion").cast("bigint").alias("n_raw"),
        F.md5(normalise_answer("completion")).alias("md5_answer"),
    )
