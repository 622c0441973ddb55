"""Prompt operators on hand-written edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from fillwright.functions import chat_templates
from fillwright.functions import text as tx
from fillwright.operators import infill, instruct, models
from fillwright.operators.contracts import REASON, accepted, rejected


def one(df):
    return df.collect()


def test_strip_equals_python(spark):
    rng = random.Random(5)
    alphabet = list(tx.WHITESPACE) + ["a", "é", "​", "🙂"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, stripped, right in df.select("t", tx.strip_py("t"), tx.rstrip_py("t")).collect():
        assert stripped == t.strip()
        assert right == t.rstrip()
    assert len(tx.WHITESPACE) == 29


@pytest.mark.parametrize("needle", ['"""', "assert", "ab"])
def test_positions_equal_python(spark, needle):
    rng = random.Random(len(needle))
    pieces = [needle, needle[:1], needle[:2], "é", "🙂", " ", "\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 7))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, first, last in df.select(
        "t", tx.index_of("t", needle), tx.rindex_of("t", needle)
    ).collect():
        assert first == t.find(needle)
        assert last == t.rfind(needle)


def test_template_values_stay_literal(spark):
    df = spark.createDataFrame([("{response} {x}", "{instruction}")], "a string, b string")
    template = "<{instruction}> {{kept}} <{response}>{instruction}"
    got = df.select(tx.render_template(template, instruction=F.col("a"), response=F.col("b")))
    assert got.first()[0] == template.format(instruction="{response} {x}", response="{instruction}")
    with pytest.raises(KeyError):
        tx.render_template("{other}", instruction="x")
    with pytest.raises(ValueError):
        tx.render_template("{instruction!r}", instruction="x")


def test_code_block(spark):
    texts = ["x = 1", "```x```", "a\n```b```c", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.extract_code_block("t")).collect()]
    assert got == [t.split("```")[0] for t in texts]


def test_id_as_string(spark):
    assert spark.range(7, 8).select(tx.id_as_string("id")).first()[0] == "7"


def test_split_infill(spark):
    m = tx.MARKER
    texts = [f"a{m}b", f"a{m}b{m}c", f"{m}b", f"a{m}", "none", None, f'l1\n"q",{m}\n\'', "{{x}}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, eval_prompt string")
    out = infill.split_infill(df)
    good = {r.i: (r.prompt, r.suffix) for r in accepted(out).collect()}
    for i, t in enumerate(texts):
        if t is not None and m in t:
            assert good.pop(i) == tuple(t.split(m)[:2])
    assert not good
    assert sorted(r.i for r in rejected(out).collect()) == [4, 5, 7]


def test_fim_formats(spark):
    df = spark.createDataFrame([("P", "S")], "prompt string, suffix string")
    got = df.select(
        infill.fim_qwen(), infill.fim_dscoder(), infill.fim_starcoder(), infill.fim_codellama()
    ).first()
    assert list(got) == [
        "<|fim_prefix|>P<|fim_suffix|>S<|fim_middle|>",
        "<｜fim▁begin｜>P<｜fim▁hole｜>S<｜fim▁end｜>",
        "<fim_prefix>P<fim_suffix>S<fim_middle>",
        "▁<PRE>P▁<SUF>S▁<MID>",
    ]
    assert df.select(infill.infill_by_short_name("QWEN")).first()[0] == got[0]
    with pytest.raises(ValueError):
        infill.infill_by_short_name("other")


def test_fim_by_token_ids(spark):
    df = spark.createDataFrame([("P", "S")], "prompt string, suffix string")
    rows = [(32016, "<begin>"), (32015, "<hole>"), (32017, "<end>"), (1, "x")]
    vocabulary = spark.createDataFrame(rows, "id int, token string")
    assert df.select(infill.fim_by_token_ids(vocabulary)).first()[0] == "<begin>P<hole>S<end>"
    for bad in (rows[:2], [(32016, "<x>"), *rows[1:]]):
        with pytest.raises(Exception, match="infill markers"):
            df.select(
                infill.fim_by_token_ids(spark.createDataFrame(bad, "id int, token string"))
            ).collect()


def test_infill_for_model(spark):
    keys = [m[0] for m in models.MODELS] + ["nobody/x"]
    df = spark.createDataFrame([(k, "P", "S") for k in keys], "model_key string, prompt string, suffix string")
    out = infill.infill_for_model(df)
    good = {r.model_key: r.infill_prompt for r in accepted(out).collect()}
    assert good["bigcode/starcoder"].startswith("<fim_prefix>")
    assert good["Qwen/Qwen2.5-Coder-7B"].startswith("<|fim_prefix|>")
    assert good["deepseek-ai/deepseek-coder-33b-base"].startswith("<｜fim▁begin｜>")
    assert len(good) == 6
    bad = {r.model_key for r in rejected(out).collect()}
    assert bad == {k for k in keys if "Python" in k} | {"nobody/x"}
    rows = [(32016, "<begin>"), (32015, "<hole>"), (32017, "<end>")]
    vocabulary = spark.createDataFrame(rows, "id int, token string")
    by_id = accepted(infill.infill_for_model(df, vocabulary=vocabulary)).collect()
    by_id = {r.model_key: r.infill_prompt for r in by_id}
    assert by_id["deepseek-ai/deepseek-coder-1.3b-base"] == "<begin>P<hole>S<end>"
    assert by_id["Qwen/Qwen2.5-Coder-7B"] == good["Qwen/Qwen2.5-Coder-7B"]


def test_models(spark):
    df = spark.createDataFrame(
        [("bigcode/starcoder",), ("codellama/CodeLlama-7b-Python-hf",), ("/path",), ("no",)],
        "model_key string",
    )
    ctx = {r.model_key: r.max_context_size for r in models.attach_model(df).collect()}
    assert ctx == {
        "bigcode/starcoder": 8192,
        "codellama/CodeLlama-7b-Python-hf": 16384,
        "/path": 16384,
        "no": 16384,
    }
    assert {r[0] for r in models.require_known_model(df).collect()} == {"/path", "no"}
    assert {r[0] for r in models.require_known_model(df, local_paths=["/path"]).collect()} == {"no"}
    odd = df.unionAll(df.sparkSession.sql("SELECT CAST(NULL AS STRING)"))
    assert [r[0] for r in models.require_known_model(odd, local_paths=["/path", "no"]).collect()] == [None]


def test_token_budget_and_context(spark):
    df = spark.createDataFrame([(10, 100), (99, 100), (100, 100), (101, 100)], "used int, ctx int")
    got = df.select(models.token_budget("used", "ctx", max_new_tokens=50, max_length=95)).collect()
    assert [r[0] for r in got] == [min(c - u, 50, 95 - u) for u, c in [(10, 100), (99, 100), (100, 100), (101, 100)]]
    assert df.select(models.token_budget("used", "ctx")).first()[0] == 90
    marked = models.reject_over_context(df, "used", "ctx")
    assert [r.used for r in rejected(marked).collect()] == [100, 101]
    assert [r.used for r in accepted(marked).collect()] == [10, 99]


def test_decoding_mode(spark):
    df = spark.createDataFrame([(0.0,), (0.7,)], "temperature double")
    assert [tuple(r)[1:] for r in models.decoding_mode(df).collect()] == [(False, None), (True, 0.7)]


SHOTS = [(" \n p1 \n", "\ts1　"), ("p2", " s2\n")]


@pytest.mark.parametrize("as_table", [False, True])
def test_fewshot_blocks(spark, as_table):
    shots = SHOTS
    if as_table:
        rows = [(p, s, i) for i, (p, s) in enumerate(SHOTS)][::-1]
        shots = spark.createDataFrame(rows, "problem string, solution string, ord int")
    df = spark.range(1)
    compact = "".join(p.rstrip() + s.strip() for p, s in SHOTS)
    block = "".join(p.strip() + "\n" + s.strip() + "\n\n" for p, s in SHOTS)
    assert df.select(instruct.fewshot_prefix_compact(shots)).first()[0] == compact
    assert df.select(instruct.fewshot_prefix_block(shots)).first()[0] == block
    empty = shots.limit(0) if as_table else []
    assert df.select(instruct.fewshot_prefix_compact(empty)).first()[0] == ""
    assert df.select(instruct.fewshot_prefix_block(None)).first()[0] == ""
    attached = instruct.attach_fewshots(df, instruct.fewshot_prefix_compact(shots))
    assert attached.first().shots == compact


def test_chat_messages(spark):
    df = spark.createDataFrame([("q",)], "prompt string")
    row = df.select(instruct.chat_messages("prompt", F.lit("ab")).alias("m")).first()
    assert [m.asDict() for m in row.m] == [{"role": "user", "content": "abq"}]


def test_map_docstring_assert(spark):
    q = '"""'
    texts = {
        "plain": f"{q}\nAdd. \nassert f(1) == 1\n{q}",
        "no dot": f"def f():\n  {q} Add　 assert a\nassert b {q} tail",
        "inner": f"{q}Use {q} as quotes assert x{q}",
        "four": f"{q}\" Do assert y{q}",
        "no doc": "assert f(1)",
        "one quote": f"{q} text assert x",
        "no assert": f"{q} text {q} assert later",
    }
    df = spark.createDataFrame(list(texts.items()), "task_id string, prompt string")
    out = instruct.map_docstring_assert(df)

    def expected(prompt):
        doc = prompt[prompt.index(q) + 3 : prompt.rindex(q)]
        at = doc.index("assert")
        head = doc[:at].strip()
        dot = "" if head.endswith(".") else "."
        return (
            f"{head}{dot} Your code should satisfy the following assertion:\n\n"
            f"```python\n{doc[at:].strip()}\n```"
        )

    good = {r.id: r for r in accepted(out).collect()}
    assert set(good) == {"plain", "no dot", "inner", "four"}
    for name, row in good.items():
        assert row.instruction == expected(texts[name])
        assert row.response_prefix == "```python"
    why = {r.id: r[REASON] for r in rejected(out).collect()}
    assert why == {
        "no doc": "no docstring",
        "one quote": "no assert in the docstring",
        "no assert": "no assert in the docstring",
    }


def test_map_function_prompt(spark):
    df = spark.createDataFrame([(1, "\n def f(): \t")], "task_id int, prompt string")
    row = instruct.map_function_prompt(df).first()
    assert row.id == "1"
    assert row.instruction == (
        "Write a solution to the following problem:\n```python\ndef f():\n```"
    )
    assert row.response_prefix == "```python\ndef f():"


def test_map_two_mode(spark):
    df = spark.createDataFrame(
        [("a", " def f(): ", "Say"), ("b", "x def ", "\ndef g()")],
        "task_id string, complete_prompt string, instruct_prompt string",
    )
    lead = "Write a correct and efficient solution for the following problem:\n```python\n"
    full = {r.id: r for r in instruct.map_two_mode(df, "complete").collect()}
    assert full["a"].instruction == f"{lead} def f(): \n```"
    assert full["a"].response_prefix == "```python\ndef f():"
    assert full["b"].response_prefix == "```python"
    said = {r.id: r for r in instruct.map_two_mode(df, "instruct").collect()}
    assert said["b"].response_prefix == "```python\ndef g()"
    assert said["a"].instruction == f"{lead}Say\n```"
    with pytest.raises(ValueError):
        instruct.map_two_mode(df, "other")


def test_map_ds_fewshot_defaults(spark):
    block = "".join(p.strip() + "\n" + s.strip() + "\n\n" for p, s in SHOTS)
    df = spark.createDataFrame([(None,), ("def f",), (" def g() ",)], "prompt string")
    rows = instruct.map_ds_fewshot(df, SHOTS).withColumn("m", F.to_json("metadata")).collect()
    assert [r.id for r in rows] == ["", "", ""]
    assert [r.m for r in rows] == ["{}"] * 3
    assert [r.response_prefix for r in rows] == [
        "```python",
        "```python\ndef f",
        "```python\ndef g()",
    ]
    lead = instruct.DATA_SCIENCE_SENTENCE + "\n" + block + "\n```python\n"
    assert [r.instruction for r in rows] == [lead + (p or "") + "\n```" for p in (None, "def f", " def g() ")]


def test_problems_of_all_benchmarks_stack(spark):
    tasks = spark.createDataFrame(
        [("a", '"""Do assert x"""', "c", "i")],
        "task_id string, prompt string, complete_prompt string, instruct_prompt string",
    )
    columns = ["id", "instruction", "response_prefix", "metadata"]
    stacked = None
    for name in ("humaneval", "mbpp", "bigcodebench", "ds1000"):
        part = instruct.mapper_for(name)(tasks).select(*columns)
        stacked = part if stacked is None else stacked.unionByName(part)
    rows = stacked.withColumn("metadata", F.to_json("metadata")).collect()
    assert [r.id for r in rows] == ["a"] * 4
    assert [r.metadata for r in rows] == [None, None, None, "{}"]


def test_mapper_dispatch():
    for name in ("humaneval", "mbpp", "bigcodebench", "ds1000"):
        assert callable(instruct.mapper_for(name))
    with pytest.raises(ValueError):
        instruct.mapper_for("other")


# Fixed values, written out here so that a wrong literal in the library shows.


def test_fixed_values():
    assert models.MODELS == [
        ("bigcode/starcoder", "starcoder", "starcoder", 8192),
        ("WizardLM/WizardCoder-15B-V1.0", "starcoder", "starcoder", 8192),
        ("WizardLM/WizardCoder-Python-7B-V1.0", "codellama", None, 16384),
        ("WizardLM/WizardCoder-Python-13B-V1.0", "codellama", None, 16384),
        ("WizardLM/WizardCoder-Python-34B-V1.0", "codellama", None, 16384),
        ("codellama/CodeLlama-7b-Python-hf", "codellama", None, 16384),
        ("codellama/CodeLlama-13b-Python-hf", "codellama", None, 16384),
        ("codellama/CodeLlama-34b-Python-hf", "codellama", None, 16384),
        ("deepseek-ai/deepseek-coder-1.3b-base", "deepseek", "dscoder", 16384),
        ("deepseek-ai/deepseek-coder-6.7b-base", "deepseek", "dscoder", 16384),
        ("deepseek-ai/deepseek-coder-33b-base", "deepseek", "dscoder", 16384),
        ("Qwen/Qwen2.5-Coder-7B", "deepseek", "qwen", 16384),
    ]
    assert instruct.DATA_SCIENCE_SENTENCE == (
        "You will be given Prompt: (It may include Problem: and A: in the prompt) and you "
        "must output only the  codes to be continued after the BEGIN SOLUTION or SOLUTION "
        "START."
    )


def test_a_missing_text_is_not_left_out_of_a_prompt(spark):
    shots = spark.createDataFrame([("p1", "s1", 0), ("p2", None, 1)], "problem string, solution string, ord int")
    for block in (instruct.fewshot_prefix_block, instruct.fewshot_prefix_compact):
        with pytest.raises(Exception, match="lacks one of its texts"):
            spark.range(1).select(block(shots)).collect()
        assert "p1" in spark.range(1).select(block(shots.where("ord = 0"))).first()[0]
    around = {"user": ("<u>", "\n"), "assistant": ("<a>", "\n")}
    chats = [([("user", "x"), ("assistant", None)],), ([("user", "x"), ("assistant", "")],), (None,), ([],)]
    df = spark.createDataFrame(chats, "m array<struct<role: string, content: string>>")
    assert [r[0] for r in df.select(instruct.render_chat("m", around, "<a>")).collect()] == [None, "<u>x\n<a>\n<a>", None, "<a>"]


CHAT = "array<struct<role: string, content: string>>"


def rendered(spark, template, messages, **options):
    df = spark.createDataFrame([(messages,)], f"m {CHAT}")
    return df.select(chat_templates.render_template_chat("m", template, **options)).first()[0]


def test_chat_template_language(spark):
    talk = [("system", " s "), ("user", "u1"), ("assistant", "a'1"), ("user", "u2")]
    one = lambda t, **o: rendered(spark, t, talk, **o)
    assert one("plain") == "plain"
    assert one("{% for message in messages %}{{ message.role + ':' + message['content']|trim }};{% endfor %}") == "system:s;user:u1;assistant:a'1;user:u2;"
    assert one("{{ bos_token }}{% if add_generation_prompt %}go{% else %}stop{% endif %}", bos_token="<s>") == "<s>go"
    assert one("{% if not add_generation_prompt %}a{% elif true and false %}b{% else %}c{% endif %}", add_generation_prompt=True) == "c"
    places = "{% for message in messages %}{% if loop.first %}[{% endif %}{{ loop.index0 }}{% if loop.index0 % 2 == 1 %}!{% endif %}{% if loop.last %}]{% endif %}{% endfor %}"
    assert one(places) == "[01!23!]"
    assert one("{# note #}x{{- ' y ' -}}  z") == "x y z"
    # as the tokenizers render: a statement takes its line's indent and line break
    assert one("a\n  {% if true %}\nb\n  {% endif %}\nc") == "a\nb\nc"
    assert one("a {% if true %} b {% endif %} c") == "a  b  c"
    assert one("{{ 'it\\'s' + \"\\n\" }}") == "it's\n"
    assert one("{% if messages[0]['role'] == 'system' or messages[1].role == 'x' %}yes{% endif %}") == "yes"
    with pytest.raises(Exception, match="no such turn"):
        one("{% for message in messages %}{% if message.role == 'assistant' %}{{ raise_exception('no such turn') }}{% endif %}{% endfor %}")


def test_chats_that_lack_a_text(spark):
    template = "{% for message in messages %}<{{ message['content'] }}>{% endfor %}"
    assert rendered(spark, template, [("user", "x"), ("user", None)]) is None
    assert rendered(spark, template, None) is None
    assert rendered(spark, template, []) == ""
    assert rendered(spark, "{% for message in messages %}{% if message.role == 'user' %}{{ message.content }}{% endif %}{% endfor %}", [("user", "x"), (None, "y"), ("tool", None)]) == "x"


def test_unknown_templates_are_refused():
    for bad in ("{% for m in messages %}{% endfor %}", "{% set x = 1 %}", "{{ tools }}", "{% if true %}", "{% for message in messages %}", "{{ message.role }}", "{{ 'a' 'b' }}", "{{ 'a' | upper }}", "{{ }}", "{{ (true }}", "{{ a ~ b }}", "{{ loop.length }}"):
        with pytest.raises((ValueError, IndexError), match="chat template|index"):
            chat_templates.render_template_chat("m", bad)
