"""Readers and writers on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from fillwright import session
from fillwright.sources import csv_ranges, readers, writers

PROMPT = 'def f(x):\n    """Doc, "quoted"."""\n    {{completion}}\n\treturn x'


def write_csv(path, header, rows):
    def cell(v):
        return "" if v is None else '"' + v.replace('"', '""') + '"'

    lines = [",".join(header)] + [",".join(cell(v) for v in row) for row in rows]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_csv_by_column_name(spark, tmp_path):
    path = write_csv(
        tmp_path / "api.csv",
        ["ground_truth", "lang", "task_id", "eval_prompt"],
        [["007", "py", "a", PROMPT], [None, "py", "b", "x{{completion}}"]],
    )
    tasks = readers.read_infill_csv(spark, path).collect()
    assert [tuple(r) for r in tasks] == [("a", PROMPT), ("b", "x{{completion}}")]
    truth = readers.read_ground_truth(spark, path).collect()
    assert [tuple(r) for r in truth] == [("a", "007"), ("b", None)]
    with pytest.raises(ValueError, match="lacks"):
        readers.read_ds_csv(spark, path)


def test_infill_jsonl_last_value_first_place(spark, tmp_path):
    tasks = [("t1", "a"), ("t2", "b"), ("t1", "c"), ("t3", "d")]
    path = tmp_path / "tasks.jsonl.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        for task, prompt in tasks:
            f.write(json.dumps({"task_id": task, "prompt": prompt, "suffix": "s", "extra": 1}) + "\n")
    rows = readers.read_infill_jsonl(spark, str(path)).orderBy("ord").collect()
    assert [(r.task_id, r.prompt) for r in rows] == [("t1", "c"), ("t2", "b"), ("t3", "d")]
    with pytest.raises(ValueError):
        readers.read_infill_jsonl(spark, str(path), "other")


def test_fewshots(spark, tmp_path):
    path = tmp_path / "shots.json"
    shots = [{"problem": "p\n1", "solution": "s1"}, {"problem": "p2", "solution": "s2"}]
    path.write_text(json.dumps(shots, indent=2))
    rows = readers.read_fewshots(spark, str(path)).orderBy("ord").collect()
    assert [(r.problem, r.solution, r.ord) for r in rows] == [("p\n1", "s1", 0), ("p2", "s2", 1)]
    inline = readers.inline_fewshots(spark, [("p", "s")]).first()
    assert tuple(inline) == ("p", "s", 0)


def test_predictions_with_ordinal(spark, tmp_path):
    path = tmp_path / "pred.jsonl"
    path.write_text("".join(json.dumps({"task_id": f"t{i}", "completion": str(i)}) + "\n" for i in range(9)))
    rows = readers.read_predictions(spark, str(path), with_ordinal=True).collect()
    assert {r.completion: r.ord for r in rows} == {str(i): i for i in range(9)}


def test_broken_line_fails(spark, tmp_path):
    path = tmp_path / "pred.jsonl"
    path.write_text('{"task_id": "a", "completion": "x"}\n{"task_id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_predictions(spark, str(path)).collect()


def test_numbers_stay_text(spark, tmp_path):
    path = tmp_path / "pred.jsonl"
    path.write_text('{"task_id": 7, "completion": 1.50}\n{"task_id": "b"}\n')
    rows = readers.read_predictions(spark, str(path)).collect()
    assert [tuple(r) for r in rows] == [("7", "1.50"), ("b", None)]


def test_sft_files_keep_list_order(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"problem": name, "solution": "s"}) + "\n")
    rows = readers.read_sft_jsonl(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")]).collect()
    assert {(r.problem, r.source_ord) for r in rows} == {("b", 0), ("a", 1)}
    with pytest.raises(ValueError):
        readers.read_sft_jsonl(spark, [])


def test_splits(spark, tmp_path):
    paths = {"v1": f"{tmp_path}/v1", "test": f"{tmp_path}/t.jsonl"}
    spark.range(2).write.parquet(paths["v1"])
    spark.range(3).write.json(paths["test"])
    assert readers.read_table_split(spark, paths).count() == 2
    assert readers.read_table_split(spark, paths, "test").count() == 3
    with pytest.raises(ValueError):
        readers.read_table_split(spark, paths, "dev")
    assert readers.open_text2code(spark, "humaneval", paths["v1"]).count() == 2
    assert readers.open_text2code(spark, "bigcodebench", paths).count() == 2
    assert readers.open_text2code(spark, "ds1000", paths).count() == 3
    with pytest.raises(ValueError):
        readers.open_text2code(spark, "other", paths)


def test_open_benchmark(spark, tmp_path):
    infill = write_csv(tmp_path / "API.CSV", ["task_id", "eval_prompt"], [["a", PROMPT]])
    science = write_csv(tmp_path / "ds-1000.csv", ["prompt", "metadata"], [["p", "{}"]])
    assert readers.open_benchmark(spark, infill)[0] == "safim"
    kind, tasks = readers.open_benchmark(spark, science)
    assert kind == "ds1000" and tasks.first().prompt == "p"
    path = tmp_path / "h.jsonl"
    path.write_text(json.dumps({"task_id": "a", "prompt": "p", "suffix": "s"}) + "\n")
    assert readers.open_benchmark(spark, "HEI", str(path))[0] == "hei"
    for name, where in (("other", None), ("hei", None)):
        with pytest.raises(ValueError):
            readers.open_benchmark(spark, name, where)


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "é\n", None)], "task_id string, completion string, note string")
    path = writers.write_completions(df, str(tmp_path), "qwen", "api.csv")
    assert path.endswith("/qwen_api.jsonl")
    assert [json.loads(v) for v in lines(spark, path)] == [{"task_id": "a", "completion": "é\n"}]
    # a second write replaces the first
    writers.write_completions(df, str(tmp_path), "qwen", "api.csv")
    assert len(lines(spark, path)) == 1

    meta = F.parse_json(F.lit('{"k": [1, null]}'))
    answers = df.select(F.lit("x").alias("code"), meta.alias("metadata"), F.lit("7").alias("id"))
    path = writers.write_answers(answers, str(tmp_path), "qwen", "ds-1000.csv")
    assert path.endswith("/qwen_ds-1000_instruct.jsonl")
    assert [json.loads(v) for v in lines(spark, path)] == [{"code": "x", "metadata": {"k": [1, None]}}]
    out = writers.write_solutions(answers, f"{tmp_path}/s1.jsonl", "ds1000")
    assert "metadata" in json.loads(lines(spark, out)[0])
    out = writers.write_solutions(answers, f"{tmp_path}/s2.jsonl", "mbpp")
    assert [json.loads(v) for v in lines(spark, out)] == [{"task_id": "7", "code": "x"}]
    # a null field keeps its key
    empty = answers.withColumn("metadata", F.lit(None).cast("variant"))
    out = writers.write_solutions(empty, f"{tmp_path}/s3.jsonl", "ds1000")
    assert json.loads(lines(spark, out)[0]) == {"code": "x", "metadata": None}


def test_subset_files(spark, tmp_path):
    df = spark.range(100)
    paths = [writers.write_subset(df, f"{tmp_path}/oss", "id", r) for r in (0.29, 1.0)]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["oss_28pct.jsonl", "oss_100pct.jsonl"]
    assert [len(lines(spark, p)) for p in paths] == [int(100 * 0.29), 100]
    folder = writers.write_subsets(df, f"{tmp_path}/all", "id")
    sizes = {r.pct: r["count"] for r in spark.read.json(folder).groupBy("pct").count().collect()}
    assert sizes == {20: 20, 40: 40, 60: 60, 80: 80, 100: 100}


def test_scratch_follows_the_session(spark):
    assert session.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    back = session.write_through(spark.range(3))
    assert sorted(r.id for r in back.collect()) == [0, 1, 2]




def _failing(df):
    with pytest.raises(Exception) as caught:
        df.collect()
    return str(caught.value)


def test_csv_lines_with_other_cells_fail(spark, tmp_path):
    for name, line in (("short", "2"), ("long", "2,b,c")):
        path = tmp_path / f"{name}.csv"
        path.write_text(f"task_id,eval_prompt\n1,a\n{line}\n")
        _failing(readers.read_infill_csv(spark, str(path)))
    good = tmp_path / "good.csv"
    good.write_text('task_id,eval_prompt,more\n1,"a\nb",x\n')
    assert [tuple(r) for r in readers.read_infill_csv(spark, str(good)).collect()] == [("1", "a\nb")]


def test_broken_fewshots_fail(spark, tmp_path):
    for i, text in enumerate(('[{"problem": "p", "sol', '[{"problem": "p"}]', "{}", "")):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        _failing(readers.read_fewshots(spark, str(path)))
    path = tmp_path / "good.json"
    path.write_text('[{"problem": "p", "solution": "s"}, {"problem": "q", "solution": ""}]')
    rows = [tuple(r) for r in readers.read_fewshots(spark, str(path)).collect()]
    assert rows == [("p", "s", 0), ("q", "", 1)]


def _with_conf(spark, settings, run):
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


CELLS = ["", "plain", "a,b", 'q "x" y', "two\nlines", "crlf\r\nhere", "\n\n", "é日本", "  sp ", '"', "tail\r", None, "x" * 300]
CELLS.append("\n".join(f"line {i}" for i in range(80)))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["128m", "1500"])
def test_split_csv_is_the_whole_csv(spark, tmp_path, end, size):
    import random

    r = random.Random(4)
    rows = [[f"t{i}", r.choice(CELLS), r.choice(CELLS)] for i in range(240)]

    def cell(v):
        bare = v is not None and v != "" and not any(c in v for c in ',"\n\r') and r.random() < 0.7
        return "" if v is None else v if bare else '"' + v.replace('"', '""') + '"'

    folder = tmp_path / "in two.csv"
    folder.mkdir()
    for name, part in (("a b", rows[:150]), ("c", rows[150:])):
        with open(folder / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            f.write(f"task_id,eval_prompt,more{end}")
            f.write("".join(",".join(map(cell, row)) + end + (end if r.random() < 0.1 else "") for row in part))

    def read():
        lines = csv_ranges._lines(spark, str(folder))
        assert (lines.rdd.getNumPartitions() > 10) == (size == "1500")
        return readers.read_infill_csv(spark, str(folder), with_ordinal=True).orderBy("ord").collect()

    got = _with_conf(spark, {"spark.sql.files.maxPartitionBytes": size}, read)
    # the parser reads an empty cell as null, with quotes or without
    assert [(x.task_id, x.eval_prompt) for x in got] == [(row[0], row[1] or None) for row in rows]
    assert [x.ord for x in got] == list(range(240))
    if end == "\n":
        # with other line ends Spark's own reader changes the breaks inside cells as well
        whole = spark.read.csv(str(folder), header=True, multiLine=True, escape='"').select("task_id", "eval_prompt")
        assert sorted(map(tuple, whole.collect()), key=str) == sorted(((x.task_id, x.eval_prompt) for x in got), key=str)


def test_csv_that_can_not_be_split(spark, tmp_path):
    (tmp_path / "open.csv").write_text('task_id,eval_prompt\n1,"a\nb\n')
    assert "never closed" in _failing(readers.read_infill_csv(spark, str(tmp_path / "open.csv")))
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("task_id,eval_prompt\n1,a\n")
    (folder / "b.csv").write_text("eval_prompt,task_id\nb,2\n")
    assert "another has" in _failing(readers.read_infill_csv(spark, str(folder)))
    (tmp_path / "head.csv").write_text("﻿task_id,eval_prompt\r\n")
    assert readers.read_infill_csv(spark, str(tmp_path / "head.csv")).count() == 0
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write('task_id,eval_prompt\n1,"a\nb"\n')
    assert [tuple(r) for r in readers.read_infill_csv(spark, str(tmp_path / "z.csv.gz")).collect()] == [("1", "a\nb")]


@pytest.mark.parametrize("shuffles", ["4", "211"])
def test_lines_in_order(spark, tmp_path, monkeypatch, shuffles):
    monkeypatch.setattr(writers, "RANGE_POSITIONS", 37)
    tasks = spark.range(0, 500, 1, 7).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("task_id"))
    rows = tasks.withColumn("sample_idx", F.explode(F.array(F.lit(1), F.lit(0)))).orderBy(F.rand(3))
    done = rows.withColumn("completion", F.concat_ws("\n", "task_id", "sample_idx"))
    path = _with_conf(spark, {"spark.sql.shuffle.partitions": shuffles}, lambda: writers.write_completions(done, str(tmp_path), "m", "d", order=("ord", "sample_idx")))
    got = readers.read_predictions(spark, path, with_ordinal=True).orderBy("ord").collect()
    assert [(r.ord, r.task_id, r.completion) for r in got] == [(2 * i + s, str(i), f"{i}\n{s}") for i in range(500) for s in (0, 1)]
    assert writers.check_ranges(spark, path) == 14
    assert readers.read_predictions(spark, path).columns == ["task_id", "completion"]
    # a second file of a range, as two commits of one task would leave
    extra = next((tmp_path / "m_d.jsonl").glob("range=*/*.json"))
    (extra.parent / f"x-{extra.name}").write_bytes(extra.read_bytes())
    with pytest.raises(ValueError, match="overlap"):
        writers.check_ranges(spark, path)
    for bad in (F.lit(-1), F.lit(None).cast("long")):
        with pytest.raises(Exception, match="no position"):
            writers.write_completions(done.withColumn("ord", bad), f"{tmp_path}/bad", "m", "d", order=("ord",))
    assert writers.check_ranges(spark, writers.write_completions(done.limit(0), f"{tmp_path}/none", "m", "d", order=("ord",))) == 0


def test_rows_are_made_once_for_an_ordered_file(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def answer(i):
        made.add(1)
        return str(i)

    rows = spark.range(300).select(F.col("id").alias("ord"), F.col("id").alias("task_id"), answer.asNondeterministic()("id").alias("completion"))
    writers.write_completions(rows, str(tmp_path), "m", "d", order=("ord",))
    assert made.value == 300


def test_rings_are_the_subsets(spark, tmp_path):
    df = spark.range(0, 1000, 1, 3).withColumn("text", F.concat(F.lit("t"), "id"))
    folder = writers.write_rings(df, f"{tmp_path}/rings", "id")
    # stored once
    assert len(lines(spark, folder)) == 1000
    whole = writers.write_subsets(df, f"{tmp_path}/all", "id")
    for pct in (20, 40, 60, 80, 100):
        got = readers.read_subset(spark, folder, pct, "id long, text string")
        want = spark.read.schema("id long, text string, pct int").json(whole).where(F.col("pct") == pct).drop("pct")
        assert got.columns == ["id", "text"] and sorted(got.collect()) == sorted(want.collect())
    plan = readers.read_subset(spark, folder, 20, "id long")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ring" in plan


def test_batches_are_checked_by_the_pass_that_writes_them(spark, tmp_path):
    rows = [([1, 2], [1, 2], False), ([1, 2, 3], [1, 2, 3], True)]
    schema = "input_ids array<int>, labels array<int>, exceeding_length boolean"
    df = spark.createDataFrame(rows, schema)
    assert writers.write_batches(df, f"{tmp_path}/b", max_length=3) == {"total": 2, "truncated": 1}
    assert writers.write_batches(df.limit(0), f"{tmp_path}/n") == {"total": 0, "truncated": 0}
    for bad, limit, exact in ((([1], [1, 2], False), 3, False), (([1], None, False), 3, False), (([1] * 4, [1] * 4, False), 3, False), (([1], [1], False), 3, True)):
        with pytest.raises(ValueError, match="1 rows|1 beyond|2 beyond"):
            writers.write_batches(spark.createDataFrame([rows[1], bad], schema), f"{tmp_path}/b", limit, exact)


def test_stored_tables_are_dropped_with_their_block(spark, tmp_path):
    from pathlib import Path

    shared = Path(session.scratch_dir(spark))

    def held():
        return {p.name for p in shared.glob("stage-*")}

    before = held()
    with session.stored_tables_dropped(spark):
        kept = session.write_through(spark.range(5))
        with session.stored_tables_dropped(spark):
            session.write_through(spark.range(3))
            assert len(held() - before) == 2
        assert len(held() - before) == 1
        kept.write.parquet(f"{tmp_path}/out")
    assert held() == before and spark.read.parquet(f"{tmp_path}/out").count() == 5
    with pytest.raises(RuntimeError), session.stored_tables_dropped(spark):
        session.write_through(spark.range(3))
        raise RuntimeError
    assert held() == before
    session.write_through(spark.range(3))
    assert len(held() - before) == 1
    with pytest.raises(ValueError, match="not below"):
        session.drop_folder(spark, str(tmp_path))
