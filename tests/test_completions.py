"""Completion jobs and their post-processing."""

import ast
import json

import pytest
from pyspark.sql import functions as F

from fillwright.functions import literals
from fillwright.functions import tokens as tk
from fillwright.operators import completions as cp
from fillwright.operators.contracts import REASON, accepted, rejected


def test_expand_samples(spark):
    df = spark.range(2)
    assert cp.expand_samples(df, 3).count() == 6
    none = cp.expand_samples(df, 0)
    assert none.count() == 0 and "sample_idx" in none.columns


def test_complete_isolates_failing_rows(spark):
    texts = ["a", "b", "bad", "c", "bad", "d", "e"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, prompt string").coalesce(1)

    def make_upper():
        calls = []

        def run(prompts):
            calls.append(len(prompts))
            if any(p == "bad" for p in prompts):
                raise RuntimeError("boom")
            return [f"{p}!{len(calls)}" for p in prompts]

        return run

    done = cp.complete(df, make_upper, batch_rows=3, on_error="keep")
    assert done.columns == ["i", "prompt", "completion", "error"]
    good = {r.i: r.completion for r in cp.drop_failed_rows(done).collect()}
    assert {i: v.split("!")[0] for i, v in good.items()} == {0: "a", 1: "b", 3: "c", 5: "d", 6: "e"}
    failed = cp.failed_rows(done).collect()
    assert [(r.i, r[REASON]) for r in failed] == [(2, "RuntimeError: boom"), (4, "RuntimeError: boom")]


def test_complete_spreads_rows(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("prompt")).coalesce(1)
    done = cp.complete(df, lambda: lambda prompts: [p + "." for p in prompts], partitions=4)
    assert done.rdd.getNumPartitions() == 4
    assert {r.completion for r in done.collect()} == {f"{i}." for i in range(40)}


def test_wrong_number_of_texts_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    rows = cp.complete(df, lambda: lambda prompts: ["only"] * 3, on_error="keep").collect()
    assert all(r.completion is None and "number of rows" in r.error for r in rows)


def test_other_values_than_text_are_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    fn = lambda: lambda prompts: [1 if p == "a" else p for p in prompts]
    rows = cp.complete(df, fn, on_error="keep").collect()
    assert rows[0].completion is None and rows[0].error.startswith("TypeError")
    assert (rows[1].completion, rows[1].error) == ("b", None)


def test_filter_on_outcome_runs_the_function_once(spark):
    df = spark.createDataFrame([("a",)], "prompt string")
    done = cp.complete(df, lambda: lambda prompts: prompts)
    plan = cp.drop_failed_rows(done)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_lookup(spark):
    tasks = cp.expand_samples(spark.createDataFrame([("a",), ("b",)], "task_id string"), 2)
    stored = spark.createDataFrame([("a", 0, "x")], "task_id string, sample_idx int, completion string")
    got = {(r.task_id, r.sample_idx): r.completion for r in cp.lookup_completions(tasks, stored).collect()}
    assert got == {("a", 0): "x", ("a", 1): None, ("b", 0): None, ("b", 1): None}


def test_strip_prompt_and_completion(spark):
    df = spark.createDataFrame([("é🙂", "é🙂 out ")], "p string, o string")
    cut = cp.strip_prompt_text("o", "p")
    assert df.select(cut).first()[0] == " out "
    assert df.select(cp.strip_completion(cut, F.lit("Qwen"))).first()[0] == "out"
    assert df.select(cp.strip_completion(cut, F.lit("dscoder"))).first()[0] == " out "


def test_answers(spark):
    df = spark.createDataFrame([("x```y",)], "completion string")
    assert cp.code_solutions(df).first().code == "x"
    assert cp.code_answers(df).first().code == "x```y\n"


def test_parse_metadata(spark):
    good = [
        "{'library': 'Pandas', 'n': None, 'ok': True, 'deep': {'k': [1, 2.5, 'é']}}",
        "{'a': (1, 2)}",
        "[]",
    ]
    bad = ["{'a': ", "call()", None, "{1, 2}"]
    df = spark.createDataFrame(list(enumerate(good + bad)), "i int, metadata string")
    out = cp.parse_metadata(df)
    rows = {r.i: json.loads(r.j) for r in accepted(out).withColumn("j", F.to_json("metadata")).collect()}
    for i, text in enumerate(good):
        assert rows[i] == json.loads(json.dumps(ast.literal_eval(text)))
    assert sorted(r.i for r in rejected(out).collect()) == [3, 4, 5, 6]


def test_kept_outcome_is_of_one_run(spark):
    def make_random():
        import random

        def run(prompts):
            if random.random() < 0.5:
                raise ValueError("now and then")
            return prompts

        return run

    df = spark.range(200).select(F.col("id").cast("string").alias("prompt"))
    done = cp.complete(df, make_random, batch_rows=1, keep=True, on_error="keep")
    good, failed = cp.drop_failed_rows(done), cp.failed_rows(done)
    assert {r.prompt for r in good.collect()}.isdisjoint({r.prompt for r in failed.collect()})
    assert good.count() + failed.count() == 200


def test_a_failing_function_fails_the_job(spark):
    df = spark.createDataFrame([("a",)], "prompt string")

    def broken():
        def run(prompts):
            raise RuntimeError("no memory")

        return run

    with pytest.raises(Exception, match="no memory"):
        cp.complete(df, broken).collect()
    assert cp.complete(df, lambda: lambda prompts: prompts).first().completion == "a"
    with pytest.raises(ValueError, match="on_error"):
        cp.complete(df, broken, on_error="skip")


def test_metadata_with_keys_that_collide_is_rejected(spark):
    df = spark.createDataFrame([("{1: 'a', '1': 'b'}",), ("{1: 'a'}",), ("{",)], "metadata string")
    reasons = [r[REASON] for r in cp.parse_metadata(df).collect()]
    assert [r is None for r in reasons] == [False, True, False]


def test_resumed_run_asks_for_open_parts_only(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    tasks = spark.range(120).select(F.col("id").cast("string").alias("task_id"), F.lit(0).alias("sample_idx"), F.concat(F.lit("p"), "id").alias("prompt"))
    folder = str(tmp_path / "run")

    def maker(dies_at):
        def make():
            def answer(prompts):
                if dies_at in prompts:
                    raise RuntimeError("dies")
                calls.add(len(prompts))
                return [p.upper() for p in prompts]

            return answer

        return make

    with pytest.raises(Exception, match="dies"):
        cp.complete_resumable(tasks, maker("p77"), folder, parts=6)
    first = cp.stored_answers(spark, folder)
    kept = first.count() if first is not None else 0
    assert 0 < kept < 120
    before = calls.value
    done = cp.complete_resumable(tasks, maker(None), folder, parts=6)
    assert {r.task_id: r.completion for r in done.collect()} == {str(i): f"P{i}" for i in range(120)} and done.count() == 120
    assert calls.value - before == 120 - kept
    # nothing is open; then two more tasks are
    assert cp.complete_resumable(tasks, maker("p1"), folder, parts=6).count() == 120
    more = spark.range(122).select(F.col("id").cast("string").alias("task_id"), F.lit(0).alias("sample_idx"), F.concat(F.lit("p"), "id").alias("prompt"))
    assert cp.complete_resumable(more, maker("p1"), folder, parts=6).count() == 122
    assert calls.value - before == 122 - kept


def test_answers_outside_the_manifest_do_not_count(spark, tmp_path):
    tasks = spark.createDataFrame([("a", 0, "x")], "task_id string, sample_idx int, prompt string")
    make = lambda: lambda prompts: [p + "!" for p in prompts]
    folder = str(tmp_path / "run")
    cp.complete(tasks, make).write.parquet(f"{folder}/answers-0-left")
    assert cp.stored_answers(spark, folder) is None
    assert [r.completion for r in cp.complete_resumable(tasks, make, folder).collect()] == ["x!"]
    none = cp.complete_resumable(tasks.limit(0), make, str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == ["task_id", "sample_idx", "prompt", "completion", "error"]
    with pytest.raises(Exception, match="key of a task is null"):
        cp.complete_resumable(tasks.withColumn("task_id", F.lit(None).cast("string")), make, str(tmp_path / "null"))


LITERALS = [
    "{'library': 'Pandas', 'n': 3, 'ok': True, 'none': None, 'deep': {'k': [1, 'b']}}",
    "[]", "{}", "()", "(1,)", "(1, 2)", "(1)", "[(1, 2), ()]", "((1, 2), 3)", "[1, 2,]", "{'a': 1,}", "[,]", "[1,,]", "(,)",
    "'it''s'", "'a' 'b'", "\"it's\"", "'say \"x\"'", r"'it\'s'", r'"a \"b\" \\"', r"'\\'", r"'\\\''", r"'\\\"'", r"'tab\tline\nendé\f\b'", r"'\x41'", r"'\101'", r"'\q'", r"'\N{DASH}'",
    "'''three'''", "b'x'", "r'x'", "u'x'", "f'x'", "1 2", "1 -2", "- 1", "-1", "-0", "0", "00", "007", "1_000", "+1", "1.5", "1.50", "-0.0", "0.0001", "0.00001", ".5", "1.", "1e5", "1e400", "nan",
    "123456789012345678", "12345678901234567890123", "1234567890123.5", "True", "Trueish", "true", "null", "{1: 'a'}", "{1: 'a', '1': 'b'}", "{'a': 1, 'a': 2}", "{1, 2}", "{'a'}", "{'a': }", "{'a' 1}", "[1 2]", "[1]]", "[1", "]", "{'a': 1} {'b': 2}", "[1] [2]", "[1][0]",
    " 1", "\t[1]", "\n[1]", "\n  [1]", "[1]\n", "[\n1,\n 2]", "{'a':\r\n1}", "1\n", "'a\nb'", "[1] # note", "", " ", "x", "é", "'é日本'", "['" + "x" * 5000 + "']", "['" + "\\n" * 400 + "']", "['" + "\\n" * 3000 + "']",
    "{'a': [1, (2, 'b', None), {'c': -4.25}], 'd': ()}", "lambda: 1", "1 if 1 else 2", "[*[1]]", "{**{}}", "1+2j", "-'a'", "'\x00'", "'\t'", "'\x7f'",
]


def test_literals_without_python_are_those_of_python(spark):
    def plain(text):
        try:
            return json.dumps(ast.literal_eval(text), allow_nan=False)
        except Exception:
            return None

    rows = [(i, t, plain(t)) for i, t in enumerate([*LITERALS, None])]
    df = spark.createDataFrame(rows, "i int, metadata string, want string").repartition(3)
    want = df.select("i", F.to_json(F.try_parse_json("want")).alias("w"))
    got = cp.parse_metadata(df.drop("want")).select("i", F.to_json("metadata").alias("g"), REASON)
    for r in got.join(want, "i").collect():
        assert (r.g, r[REASON]) == (r.w, None if r.w is not None else "metadata is no literal"), rows[r.i][1]
    # what the expressions settle alone is never wrong, and covers the usual
    alone = literals.with_literal_json(df, "metadata", "j").select("i", F.to_json(F.try_parse_json("j")).alias("g"))
    settled = {r.i: (r.g, r.w) for r in alone.join(want, "i").collect() if r.g is not None}
    assert all(g == w for g, w in settled.values())
    usual = [0, 1, 2, 3, 4, 5, 7, 9, 10, LITERALS.index("[\n1,\n 2]"), LITERALS.index(r"'\\\''"), LITERALS.index("-1"), LITERALS.index("1.5"), len(LITERALS) - 9]
    assert set(usual[:-1]) <= set(settled) and len(settled) > 30


def test_usual_literals_do_not_go_to_python(spark):
    df = spark.createDataFrame([(LITERALS[0],)] * 20 + [(r"'\x41'",)], "metadata string")
    plan = literals.with_literal_json(df, "metadata", "j")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert cp.parse_metadata(df).where(F.col(REASON).isNull()).count() == 21


def _texts(spark, lengths):
    return spark.createDataFrame([(i, "x" * n) for i, n in enumerate(lengths)], "id long, text string").repartition(3)


def test_budget_batches_keep_their_budget(spark, monkeypatch):
    lengths = [i * 37 % 90 for i in range(400)] + [500, 500, 7000]
    df = _texts(spark, lengths)
    length = F.octet_length("text") + 1
    for group in (1 << 16, 16):
        monkeypatch.setattr(cp, "GROUP_ROWS", group)
        got = cp.budget_batches(df, length, "id", 400, max_rows=9).collect()
        assert sorted(r.id for r in got) == list(range(len(lengths)))
        batches = {}
        for r in got:
            batches.setdefault(r.batch_id, []).append(r)
        for held in batches.values():
            longest = max(len(r.text) + 1 for r in held)
            assert all(r.width == longest for r in held) and len(held) <= 9
            assert len(held) * longest <= 400 or len(held) == 1
        assert group == 16 or len(batches) < 75
    assert cp.batch_widths(400)[0] == 16 and cp.batch_widths(400)[-1] == 400 and cp.batch_widths(5) == [5]
    share = cp.padding_share(cp.budget_batches(df, length, "id", 400), length).first()
    assert share.n == 403 and 0 < share.padding < 0.25
    assert cp.budget_batches(df.limit(0), length, "id", 400).count() == 0


def test_no_batch_is_cut_at_an_arrow_border(spark):
    df = _texts(spark, [i % 50 for i in range(300)]).withColumn("max_context_size", F.lit(60))
    tokens = tk.byte_tokenizer()
    batches = cp.budget_batches(df, F.octet_length("text") + 1, "id", 300)
    counted = {r.batch_id: r["count"] for r in batches.groupBy("batch_id").count().collect()}

    def make():
        return lambda rows, limits: [[*ids, *str(len(rows)).encode()] for ids in rows]

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = cp.complete_tokens(batches, "text", tokens, make).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        assert len(got) == 300 and all(r.completion == str(counted[r.batch_id]) for r in got)


def test_texts_of_a_batch_become_python_texts_part_by_part(spark):
    def make():
        import tracemalloc

        tracemalloc.start()
        return lambda prompts: [str(tracemalloc.get_traced_memory()[1])] * len(prompts)

    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 5000).alias("prompt"))
    done = cp.complete(rows, make).select("id", F.col("completion").cast("long").alias("held")).collect()
    assert sorted(r.id for r in done) == list(range(4000))
    # the batch is 20 MB as it arrives, and 64 of its texts are 0.3 MB
    assert max(r.held for r in done) < 30_000_000
