"""Ranks, ordinals, subsets, splits and mixes against single-process results."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fillwright.operators import ordering as od
from fillwright.operators import sampling as sm


def permutation(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 3000, 1, 7).withColumn("text", F.concat(F.lit("t"), "id"))


def test_exact_rank_is_the_sorted_order(rows):
    got = {r.id: r.rank for r in od.exact_rank(rows, "id", seed=9).collect()}
    assert got == {i: n + 1 for n, i in enumerate(permutation(range(3000), 9))}


def test_rank_does_not_depend_on_partitions(rows):
    once = od.seeded_shuffle(rows.coalesce(1), "id").select("id", "ord")
    many = od.seeded_shuffle(rows.repartition(13), "id").select("id", "ord")
    assert once.exceptAll(many).isEmpty()
    assert sorted(r.ord for r in once.collect()) == list(range(3000))


def test_rank_window_is_partitioned(rows):
    plan = od.exact_rank(rows, "id")._jdf.queryExecution().executedPlan().toString()
    row_number = plan[plan.index("row_number") :]
    assert "hashpartitioning(_bucket" in row_number


@pytest.mark.parametrize("ratio", [0.0, 0.29, 0.57, 1.0])
def test_sample_is_an_exact_prefix(rows, ratio):
    got = {r.id for r in sm.sample_ratio(rows, "id", ratio).collect()}
    assert got == set(permutation(range(3000), 42)[: int(3000 * ratio)])


def test_sample_of_nothing(rows):
    assert sm.sample_ratio(rows.limit(0), "id", 0.5).count() == 0


def test_subsets_are_nested_and_exact(rows):
    got = {}
    for r in sm.nested_subsets(rows, "id").collect():
        got.setdefault(r.pct, set()).add(r.id)
    order = permutation(range(3000), 42)
    for ratio in sm.RATIOS:
        assert got[sm.percent_of(ratio)] == set(order[: int(3000 * ratio)])


def test_percent_is_truncated():
    assert [sm.percent_of(r) for r in (0.29, 0.57, 0.2, 1.0)] == [28, 56, 20, 100]


def test_repeated_keys(spark):
    # a third of the rows are copies of one row, and the cut falls into them
    df = spark.range(0, 3000, 1, 5).select(F.greatest("id", F.lit(1000)).alias("k"))
    hot = permutation({1000}, 42)[0]
    before = permutation(range(1000, 3000), 42).index(hot)
    ratio = (before + 400) / 3000
    with pytest.raises(Exception, match="unique=False"):
        sm.sample_ratio(df, "k", ratio).collect()
    got = [r.k for r in sm.sample_ratio(df, "k", ratio, unique=False).collect()]
    assert len(got) == int(3000 * ratio)
    assert set(got) == set(permutation(range(1000, 3000), 42)[: before + 1])
    assert sorted(r.rank for r in od.exact_rank(df, "k", unique=False).collect()) == list(range(1, 3001))
    sizes = sm.nested_subsets(df, "k", (0.1, ratio, 1.0), unique=False).groupBy("pct").count()
    assert sorted(r["count"] for r in sizes.collect()) == sorted([300, int(3000 * ratio), 3000])
    parts = sm.train_eval_split(df, "k", 50, unique=False).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in parts} == {"eval": 50, "train": 2950}


def test_repeated_key_is_cut_into_partitions(spark):
    # one value in every row: the sort still uses all partitions
    df = spark.range(0, 40000, 1, 8).select(F.lit("hot").alias("k"), "id")
    plan = df.withColumn("_input", F.monotonically_increasing_id()).repartitionByRange(4, "k", "_input")
    sizes = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 20000
    got = od.with_key_ordinal(df, "k", unique=False).collect()
    assert all(r.ord == r.id for r in got)


def test_split_sizes(rows):
    def sizes(size):
        return {r.split: r["count"] for r in sm.train_eval_split(rows, "id", size).groupBy("split").count().collect()}

    assert sizes(0.05) == {"eval": 150, "train": 2850}
    assert sizes(0.0001) == {"eval": 1, "train": 2999}
    assert sizes(77) == {"eval": 77, "train": 2923}
    assert sizes(99999) == {"eval": 3000}


def test_key_ordinal(spark):
    # one key in a third of the rows
    df = spark.range(0, 900, 1, 5).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    got = od.with_key_ordinal(df, ["k", "id"]).collect()
    order = sorted(got, key=lambda r: (r.k, r.id))
    assert [r.ord for r in order] == list(range(900))
    # equal keys keep their input order
    by_k = od.with_key_ordinal(df, "k", unique=False).collect()
    assert [r.id for r in sorted(by_k, key=lambda r: r.ord)] == [r.id for r in order]


@pytest.mark.parametrize("size", ["20000", "3000"])
def test_file_ordinal_is_the_line_number(spark, tmp_path, monkeypatch, size):
    # two files, the first cut into several splits; no row is written for it
    monkeypatch.setattr(od, "write_through", None)
    lines = [json.dumps({"n": i, "pad": "x" * 50}) for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n\n".join(lines[:2500]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[2500:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        scan = spark.read.schema("n int, pad string").json(str(tmp_path))
        assert scan.rdd.getNumPartitions() > 4
        got = od.with_file_ordinal(scan).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4000
    assert all(r.n == r.ord for r in got)


def test_parquet_ordinal_needs_no_write(spark, tmp_path, monkeypatch):
    def refuse(df):
        raise AssertionError("wrote rows")

    monkeypatch.setattr(od, "write_through", refuse)
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 3).write.parquet(path)
    # a filter after the scan does not change the numbers
    got = od.with_file_ordinal(spark.read.parquet(path)).filter("id % 7 = 0").collect()
    assert all(r.id == r.ord for r in got) and len(got) == 143


def test_dedupe_last(spark):
    df = spark.createDataFrame(
        [("a", 1, 0), ("b", 2, 1), ("a", 3, 2), ("c", None, 3), ("a", None, 4)],
        "task_id string, v int, ord int",
    )
    got = {tuple(r) for r in od.dedupe_last(df).collect()}
    assert got == {("a", None, 0), ("b", 2, 1), ("c", None, 3)}


def test_chunks(spark):
    df = spark.range(10).withColumnRenamed("id", "ord")
    batches = od.chunk(df, 4)
    assert [r.batch_id for r in batches.orderBy("ord").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    assert od.limit_batches(batches, 2).count() == 8
    assert od.limit_batches(batches, 0).count() == 10
    with pytest.raises(ValueError):
        od.chunk(df, 0)


def test_mixing(spark):
    a, b = spark.range(5), spark.range(3)
    merged = sm.mix_merged({"x": a, "y": b}, "id", seed=1).collect()
    assert sorted(r.ord for r in merged) == list(range(8))
    assert [(r.source, r.source_ord) for r in merged].count(("x", 0)) == 5
    plain = sm.mix_merged({"x": a, "y": b}, "id")
    assert "ord" not in plain.columns and plain.count() == 8
    staged = sm.mix_sequential({"y": b, "x": a}).collect()
    assert {(r.source, r.stage) for r in staged} == {("y", 0), ("x", 1)}
    with pytest.raises(ValueError):
        sm.mix_sequential({})


def test_repeated_keys_fail_or_are_ranked(spark):
    df = spark.range(90).select((F.col("id") / 3).cast("int").alias("k"), "id").withColumn("k", F.when(F.col("id") < 30, -1).otherwise(F.col("k")))
    with pytest.raises(Exception, match="a key repeats"):
        od.exact_rank(df, "k").collect()
    ranked = od.exact_rank(df, "k", unique=False)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 91))
    ordered = [r.k for r in ranked.orderBy("rank").collect()]
    assert ordered.count(-1) == 30 and ordered.index(-1) + 29 == 89 - ordered[::-1].index(-1)


def test_line_numbers_of_a_filtered_scan_are_refused(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r.ord for r in od.with_file_ordinal(scan.select("id")).collect()) == list(range(10))
    with pytest.raises(ValueError, match="direct file scan"):
        od.with_file_ordinal(scan.where("id >= 3"))


def test_dedupe_last_sorts_no_row_to_aggregate(spark):
    df = spark.createDataFrame([("a", "1", 0), ("b", "2", 1), ("a", "3", 2)], "task_id string, v string, ord long")
    got = od.dedupe_last(df)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "3", 0), ("b", "2", 1)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_percents_are_refused(spark):
    with pytest.raises(ValueError, match="whole percent"):
        sm.nested_subsets(spark.range(5), "id", ratios=(0.285, 0.29))


def test_first_batches(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k")).repartition(4)
    got = sorted((r.k, r.ord, r.batch_id) for r in od.first_batches(df, "k", 7, 3).collect())
    assert got == [(i, i, i // 7) for i in range(21)]
    assert od.first_batches(df, "k", 7, 0).count() == 100


def test_ranks_refuse_rows_that_may_change(spark):
    df = spark.range(5).withColumn("k", F.rand())
    with pytest.raises(ValueError, match="store"):
        od.exact_rank(df, "k")
    assert od.exact_rank(df, "k", unique=False).count() == 5


def test_keys_that_read_alike_when_joined(spark):
    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), (None, "x"), ("x", None), ("", "x")], "a string, b string")
    assert sorted(r["rank"] for r in od.exact_rank(df, ["a", "b"]).collect()) == [1, 2, 3, 4, 5]
    assert sm.sample_ratio(df, ["a", "b"], 0.6).count() == 3
    twice = df.union(df.limit(1))
    with pytest.raises(Exception, match="a key repeats"):
        od.exact_rank(twice, ["a", "b"]).collect()


def test_key_ordinal_refuses_repeated_keys(spark):
    df = spark.range(100).select((F.col("id") / 2).cast("int").alias("k"), "id").repartition(5)
    with pytest.raises(Exception, match="unique=False"):
        od.with_key_ordinal(df, "k")
    got = od.with_key_ordinal(df, ["k", "id"]).collect()
    assert all(r.ord == r.id for r in got)


def test_first_batches_are_found_without_one_task(spark):
    df = spark.range(0, 1000, 1, 6).select((999 - F.col("id")).alias("k"), F.lit("t").alias("text"))
    for rows, n in ((7, 3), (100, 10), (100, 11), (1, 1)):
        got = sorted((r.k, r.ord, r.batch_id) for r in od.first_batches(df, "k", rows, n).collect())
        assert got == [(i, i, i // rows) for i in range(min(1000, rows * n))]
    plan = od.first_batches(df, "k", 7, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan
    holes = spark.createDataFrame([(None,), (2,), (1,)], "k int")
    assert sorted((r.k or 0, r.ord) for r in od.first_batches(holes, "k", 1, 2).collect()) == [(0, 0), (1, 1)]


def test_rings_hold_each_row_once(rows):
    ringed = sm.subset_rings(rows, "id", ratios=(0.8, 0.2, 0.5))
    order = permutation(range(3000), 42)
    want = {i: 20 if n < 600 else 50 if n < 1500 else 80 for n, i in enumerate(order[:2400])}
    assert {r.id: r.ring for r in ringed.collect()} == want
    with pytest.raises(ValueError, match="whole percent"):
        sm.subset_rings(rows, "id", ratios=(0.285, 0.29))


@pytest.mark.parametrize("size", [1, 64, 100, 1 << 16])
def test_batches_form_where_the_permutation_is_laid(rows, monkeypatch, size):
    monkeypatch.setattr(od, "SLICE_ROWS", size)
    df = rows.withColumn("text", F.repeat(F.lit("x"), (F.col("id") * 7919 % 97).cast("int")))
    place = {i: n for n, i in enumerate(permutation(range(3000), 5))}
    for n in (1, 33, 64, 5000):
        got = od.shuffled_batches(df, "id", n, 5, F.length("text")).collect()
        wide = {}
        for r in got:
            wide[r.batch_id] = max(wide.get(r.batch_id, 0), len(r.text))
        assert len(got) == 3000
        assert all((r.ord, r.batch_id, r.width) == (place[r.id], place[r.id] // n, wide[r.batch_id]) for r in got)


def test_laid_batches_shuffle_the_rows_once(rows, spark):
    got = od.shuffled_batches(rows, "id", 64, length=F.length("text"))
    plan = got._jdf.queryExecution().executedPlan()
    exchanges = [line for line in plan.toString().splitlines() if "Exchange hashpartitioning(_slice" in line]
    assert len(exchanges) == 1
    # only one scan of what was stored reads the texts
    scans = [line for line in plan.toString().splitlines() if "FileScan parquet" in line]
    assert sum("text:string" in line for line in scans) == 1
    assert od.shuffled_batches(rows.limit(0), "id", 3, length=F.length("text")).count() == 0
    assert "width" not in od.shuffled_batches(rows, "id", 3).columns
    with pytest.raises(Exception, match="a key repeats"):
        od.shuffled_batches(rows.union(rows), "id", 3).collect()
