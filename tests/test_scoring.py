"""Scores on edge rows, on skewed inputs, and against a brute-force join."""

import random

import pytest
from pyspark.sql import functions as F

from fillwright.operators import scoring
from fillwright.operators.contracts import (
    check_padding_bounds,
    check_parallel_lengths,
    check_same_count,
    checked,
)


def tables(spark, truth, pred):
    return (
        spark.createDataFrame(truth, "task_id string, ground_truth string"),
        spark.createDataFrame(pred, "task_id string, completion string"),
    )


def brute(truth, pred):
    n = correct = 0
    for task, answer in truth:
        mine = [c for t, c in pred if t == task] or [None]
        n += len(mine)
        for c in mine:
            correct += answer is not None and c is not None and answer.strip() == c.strip()
    return n, correct


def score(df):
    row = df.first()
    return row.n, row.correct


def test_edge_rows(spark):
    truth = [("a", "007"), ("b", None), ("c", ""), ("d", "None"), ("e", " x　"), ("f", "y")]
    pred = [("a", "7"), ("b", None), ("c", " \n"), ("d", "None"), ("e", "x\n"), ("z", "y")]
    t, p = tables(spark, truth, pred)
    assert score(scoring.exact_match(t, p)) == brute(truth, pred) == (6, 3)
    assert scoring.exact_match(t, p).first().em == 0.5
    assert score(scoring.score_pairs(scoring.pair_by_key(t, p))) == (6, 3)
    assert [r.task_id for r in scoring.unpaired_predictions(t, p).collect()] == ["z"]


def test_empty_truth_gives_null(spark):
    t, p = tables(spark, [], [("a", "x")])
    row = scoring.exact_match(t, p).first()
    assert (row.n, row.correct, row.em) == (0, 0, None)


@pytest.mark.parametrize("seed", range(3))
def test_random_samples_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    answers = ["x", " x", "y", "", None, "x "]
    truth = [(f"t{i}", rng.choice(answers)) for i in range(20)]
    # one task holds a third of all completions
    names = [f"t{rng.randrange(24)}" for _ in range(80)] + ["t3"] * 40
    pred = [(name, rng.choice(answers)) for name in names]
    t, p = tables(spark, truth, pred)
    want = brute(truth, pred)
    assert score(scoring.exact_match(t, p)) == want
    assert score(scoring.score_pairs(scoring.pair_by_key(t, p))) == want


def test_groups(spark):
    truth = spark.createDataFrame(
        [("a", "x", "py"), ("b", "y", "py"), ("c", "z", None)],
        "task_id string, ground_truth string, lang string",
    )
    pred = spark.createDataFrame([("a", "x"), ("b", "n"), ("c", "z")], "task_id string, completion string")
    got = {r.lang: (r.n, r.correct) for r in scoring.exact_match(truth, pred, by=["lang"]).collect()}
    assert got == {"py": (2, 1), None: (1, 1)}


def test_small_truth_moves_no_completion(spark, tmp_path):
    spark.range(9).selectExpr("string(id) task_id", "'x' ground_truth").write.parquet(f"{tmp_path}/t")
    spark.range(99).selectExpr("string(id) task_id", "'x' completion").write.parquet(f"{tmp_path}/p")
    truth, pred = (spark.read.parquet(f"{tmp_path}/{n}") for n in "tp")
    plan = scoring.exact_match(truth, pred)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # the one shuffle is of the distinct task ids
    assert len(shuffles) == 1


def test_hot_task_is_split(spark, tmp_path):
    # every second completion belongs to one task, and the truth is too big to broadcast
    hot = "if(id % 2 = 0, '7', string(id))"
    answer = "sha2(string(id), 512)"
    truths = spark.range(0, 20000, 1, 4).selectExpr("string(id) task_id", f"{answer} ground_truth")
    truths.write.parquet(f"{tmp_path}/t")
    answers = spark.range(0, 40000, 1, 8).selectExpr(f"{hot} task_id", f"{answer} completion")
    answers.write.parquet(f"{tmp_path}/p")
    truth, pred = (spark.read.parquet(f"{tmp_path}/{n}") for n in "tp")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        scored = scoring.exact_match(truth, pred)
        row = scored.collect()[0]
        plan = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan
    # odd tasks match their own completion, task 7 has 20,000 more, and the
    # 10,000 even tasks have none
    assert (row.n, row.correct) == (30000 + 10000, 10000)


def test_by_position_ignores_ids(spark):
    t = spark.createDataFrame([(0, "x"), (1, "y"), (2, None)], "ord int, ground_truth string")
    p = spark.createDataFrame([(1, " y"), (0, "n"), (2, None)], "ord int, completion string")
    assert score(scoring.score_pairs(scoring.pair_by_position(t, p))) == (3, 1)


def test_checks(spark):
    two, three = spark.range(2), spark.range(3)
    assert check_same_count(two, spark.range(2)) == 2
    with pytest.raises(ValueError):
        check_same_count(two, three)
    good = spark.createDataFrame([([1], [2]), ([], [])], "a array<int>, b array<int>")
    bad = good.union(spark.createDataFrame([([1], None)], good.schema))
    check_parallel_lengths(good, "a", "b")
    with pytest.raises(ValueError):
        check_parallel_lengths(bad, "a", "b")
    check_padding_bounds(good, "a", 1)
    with pytest.raises(ValueError):
        check_padding_bounds(good, "a", 0)
    with pytest.raises(ValueError):
        check_padding_bounds(good, "a", 1, pad_to_max=True)
    with pytest.raises(Exception, match="too big"):
        three.select(checked(F.col("id"), F.col("id") < 2, "too big")).collect()


def test_positions_without_partner_fail(spark):
    truth = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord long, ground_truth string")
    pred = truth.withColumnRenamed("ground_truth", "completion")
    assert scoring.score_pairs(scoring.pair_by_position(truth, pred)).first().em == 1.0
    for left, right in ((truth, pred.where("ord < 2")), (truth.where("ord > 0"), pred)):
        with pytest.raises(Exception, match="differ in length"):
            scoring.score_pairs(scoring.pair_by_position(left, right)).collect()


def test_digests_compare_as_answers(spark):
    df = spark.createDataFrame([(0, " a\n"), (1, None), (2, "b")], "ord long, ground_truth string")
    other = spark.createDataFrame([(0, "a"), (1, None), (2, "c")], "ord long, completion string")
    plain = scoring.score_pairs(scoring.pair_by_position(df, other)).first()
    short = scoring.pair_by_position(
        df.select("ord", scoring.answer_digest("ground_truth")), other.select("ord", scoring.answer_digest("completion"))
    )
    assert tuple(scoring.score_pairs(short).first()) == tuple(plain) == (3, 1, 1 / 3)
