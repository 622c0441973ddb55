"""Exact match of completions against ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwright.functions.text import normalise_answer
from fillwright.operators.contracts import REASON, checked


def answer_digest(answer: str) -> Column:
    """What exact match compares, in 16 bytes: equal for equal answers, null for null.

    Numbering rows for pairing by position sorts and stores them; with the digest
    in place of the answer no text is moved for that.
    """
    return F.md5(normalise_answer(answer)).alias(answer)


def _matches(truth: str, pred: str):
    same = normalise_answer(truth) == normalise_answer(pred)
    return F.coalesce(same, F.lit(False)).alias("correct")


def pair_by_key(
    truth: DataFrame,
    pred: DataFrame,
    key: str = "task_id",
    truth_col: str = "ground_truth",
    pred_col: str = "completion",
) -> DataFrame:
    """Truth and completion side by side, one row per completion.

    A truth without completion stays, as a miss. The completions are the left
    side of the inner join, so adaptive execution can split a task that holds
    many of them; the tasks without any are found from distinct keys.
    """
    paired = pred.join(truth, key)
    answered = pred.select(key).distinct()
    missing = truth.join(answered, key, "left_anti")
    both = paired.unionByName(missing, allowMissingColumns=True)
    return both.withColumn("correct", _matches(truth_col, pred_col))


def unpaired_predictions(truth: DataFrame, pred: DataFrame, key: str = "task_id") -> DataFrame:
    """Completions of no known task, with a ``reject_reason``."""
    known = truth.select(key).distinct()
    return pred.join(known, key, "left_anti").withColumn(REASON, F.lit("no such task"))


def pair_by_position(
    truth: DataFrame,
    pred: DataFrame,
    order: str = "ord",
    truth_col: str = "ground_truth",
    pred_col: str = "completion",
) -> DataFrame:
    """Row i of the truth with row i of the completions; ids are not looked at.

    The two must have the same positions: a row without a partner fails the job
    that reads ``correct``, so a short file never gives a score.
    """
    left = truth.select(order, truth_col, F.lit(True).alias("_has_truth"))
    right = pred.select(order, pred_col, F.lit(True).alias("_has_pred"))
    both = F.col("_has_truth").isNotNull() & F.col("_has_pred").isNotNull()
    correct = checked(_matches(truth_col, pred_col), both, "truth and completions differ in length")
    paired = left.join(right, order, "full").withColumn("correct", correct)
    return paired.drop("_has_truth", "_has_pred")


def score_pairs(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of correct pairs; no pairs give a null share."""
    return _ratio(
        pairs.groupBy(*by).agg(
            F.count("*").alias("n"), F.sum(F.col("correct").cast("bigint")).alias("correct")
        )
    )


def exact_match(
    truth: DataFrame,
    pred: DataFrame,
    key: str = "task_id",
    truth_col: str = "ground_truth",
    pred_col: str = "completion",
    by: Sequence[str] = (),
) -> DataFrame:
    """Score of the pairs by key, over all or by columns of the truth.

    The pairs are counted where they are joined: over a truth small enough for
    Spark to broadcast, no completion is moved at all, and over a large one a
    task with very many completions is split like any skewed join.
    """
    truths = truth.select(key, truth_col, *by)
    pairs = pair_by_key(truths, pred.select(key, pred_col), key, truth_col, pred_col)
    return score_pairs(pairs, by)


def _ratio(counts: DataFrame) -> DataFrame:
    n, correct = F.col("n"), F.coalesce("correct", F.lit(0))
    share = F.try_divide(correct.cast("double"), n.cast("double"))
    return counts.withColumn("correct", correct).withColumn("em", share)
