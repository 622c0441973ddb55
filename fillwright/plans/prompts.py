"""Queries over infill and instruction prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fillwright.functions.text import answer_newline, extract_code_block, render_template
from fillwright.operators.contracts import accepted
from fillwright.operators.infill import (
    CODELLAMA,
    DSCODER,
    FORMATS,
    QWEN,
    STARCODER,
    fim_by_token_ids,
    infill_for_model,
    split_infill,
)
from fillwright.operators.instruct import (
    ASSERTION_SENTENCE,
    DATA_SCIENCE_SENTENCE,
    FUNCTION_SENTENCE,
    TWO_MODE_SENTENCE,
    chat_messages,
    fewshot_prefix_block,
    fewshot_prefix_compact,
    map_docstring_assert,
    map_ds_fewshot,
    map_function_prompt,
    map_two_mode,
)
from fillwright.operators.models import require_known_model
from fillwright.plans.catalogue import query
from fillwright.plans.views import (
    EXAMPLES,
    INFILL_SQL,
    MODEL_KEY_SQL,
    MODEL_SQL,
    TEMPLATE,
    WS_SQL,
    documents,
    infill_tasks,
    model_key,
    sql_text,
    table,
    with_sql,
)
from fillwright.sources.readers import inline_fewshots

_MARKERS = {"qwen": QWEN, "dscoder": DSCODER, "starcoder": STARCODER, "codellama": CODELLAMA}


def _around_sql(markers: tuple[str, str, str]) -> str:
    before, between, after = (sql_text(m) for m in markers)
    return f"{before} || prompt || {between} || suffix || {after}"


def _fence_sql(sentence: str, body: str) -> str:
    return f"{sentence} || {sql_text(chr(10) + '```python' + chr(10))} || {body} || {sql_text(chr(10) + '```')}"


def _prefix_sql(prompt: str) -> str:
    body = f"trim({prompt}, {WS_SQL})"
    return (
        f"CASE WHEN starts_with({body}, 'def ') THEN '```python' || chr(10) || {body} "
        "ELSE '```python' END"
    )


def _stacked(columns: dict, name: str, value: str):
    """One row per entry, with its name: a projection, no join."""
    entries = [F.struct(F.lit(k).alias(name), c.alias(value)) for k, c in columns.items()]
    return F.inline(F.array(*entries))


@query(
    with_sql(INFILL_SQL)
    + """SELECT task_id, split_part(eval_prompt, '{{completion}}', 1) AS prompt,
    split_part(eval_prompt, '{{completion}}', 2) AS suffix FROM v_infill"""
)
def q_split_infill(spark, sf_dir):
    return accepted(split_infill(infill_tasks(spark, sf_dir))).select("task_id", "prompt", "suffix")


@query(
    with_sql(INFILL_SQL)
    + " UNION ALL ".join(
        f"SELECT task_id, '{fmt}' AS fmt, md5({_around_sql(m)}) AS md5_prompt FROM v_infill"
        for fmt, m in _MARKERS.items()
    )
)
def q_fim_formats(spark, sf_dir):
    tasks = accepted(split_infill(infill_tasks(spark, sf_dir)))
    prompts = {fmt: F.md5(build()) for fmt, build in FORMATS.items()}
    return tasks.select("task_id", _stacked(prompts, "fmt", "md5_prompt"))


_MODEL_PROMPT_SQL = (
    "CASE fim_format "
    + " ".join(f"WHEN '{fmt}' THEN {_around_sql(m)}" for fmt, m in _MARKERS.items())
    + " END"
)


@query(
    with_sql(INFILL_SQL, MODEL_SQL)
    + f""", d AS (SELECT *, {MODEL_KEY_SQL} AS model_key FROM v_infill),
    j AS (SELECT model_key, {_MODEL_PROMPT_SQL} AS p FROM d LEFT JOIN v_models USING (model_key))
    SELECT model_key, p IS NOT NULL AS supported, count(*) AS n,
    CAST(coalesce(sum(length(p)), 0) AS BIGINT) AS chars FROM j GROUP BY ALL"""
)
def q_infill_for_model(spark, sf_dir):
    tasks = accepted(split_infill(infill_tasks(spark, sf_dir))).withColumn("model_key", model_key())
    prompt = F.col("infill_prompt")
    return (
        infill_for_model(tasks)
        .groupBy("model_key", prompt.isNotNull().alias("supported"))
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum(F.char_length(prompt)), F.lit(0)).alias("chars"),
        )
    )


@query(
    with_sql(MODEL_SQL)
    + f""", d AS (SELECT {MODEL_KEY_SQL} AS model_key FROM documents)
    SELECT model_key, count(*) AS n FROM d
    WHERE model_key NOT IN (SELECT model_key FROM v_models) GROUP BY model_key"""
)
def q_unknown_models(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(model_key().alias("model_key"))
    return require_known_model(docs).groupBy("model_key").agg(F.count("*").alias("n"))


# Vocabulary rows in which the marker words stand at the expected ids.
_VOCABULARY = [
    (32014, "<|end of text|>"),
    (32015, "<fim hole>"),
    (32016, "<fim begin>"),
    (32017, "<fim end>"),
    (32018, "<pad>"),
]


@query(
    with_sql(INFILL_SQL)
    + "SELECT task_id, md5('<fim begin>' || prompt || '<fim hole>' || suffix || '<fim end>') "
    "AS md5_prompt FROM v_infill"
)
def q_fim_by_token_ids(spark, sf_dir):
    tasks = accepted(split_infill(infill_tasks(spark, sf_dir)))
    vocabulary = spark.createDataFrame(_VOCABULARY, "id int, token string")
    return tasks.select("task_id", F.md5(fim_by_token_ids(vocabulary)).alias("md5_prompt"))


_COMPACT = sql_text("".join(p.rstrip() + s.strip() for p, s in EXAMPLES))
_BLOCK = sql_text("".join(f"{p.strip()}\n{s.strip()}\n\n" for p, s in EXAMPLES))


@query(
    f"""SELECT doc_id AS id, 'user' AS role, md5({_COMPACT} || text) AS md5_text FROM documents"""
)
def q_fewshot_compact(spark, sf_dir):
    shots = fewshot_prefix_compact(inline_fewshots(spark, EXAMPLES))
    messages = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.explode(chat_messages("text", shots)).alias("m")
    )
    return messages.select("id", "m.role", F.md5("m.content").alias("md5_text"))


@query(f"SELECT doc_id AS id, md5({_BLOCK} || text) AS md5_text FROM documents")
def q_fewshot_block(spark, sf_dir):
    shots = fewshot_prefix_block(inline_fewshots(spark, EXAMPLES))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.md5(F.concat(shots, F.col("text"))).alias("md5_text")
    )


# Docstring tasks: every tenth document has no docstring, the one after no assert.
_ASSERT = "concat('assert f(', doc_id, ') == ', doc_id)"


def _assert_prompt(spark, sf_dir):
    prompt = F.expr(
        rf"""CASE doc_id % 10 WHEN 0 THEN text
        WHEN 1 THEN concat('\"\"\"', text, '\"\"\"')
        WHEN 2 THEN concat('head \"\"\"\n', text, '.\n', {_ASSERT}, '\n\"\"\" tail')
        ELSE concat('\"\"\"\n', text, '\n', {_ASSERT}, '\n\"\"\"') END"""
    )
    docs = documents(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("task_id"), prompt.alias("prompt"))


_STRIPPED = f"trim(text || CASE WHEN doc_id % 10 = 2 THEN '.' ELSE '' END, {WS_SQL})"
_SENTENCE = f"CASE WHEN ends_with({_STRIPPED}, '.') THEN {_STRIPPED} ELSE {_STRIPPED} || '.' END"
_ASSERT_INSTRUCTION = _fence_sql(f"({_SENTENCE}) || '{ASSERTION_SENTENCE}' || chr(10)", _ASSERT)


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN doc_id % 10 > 1 THEN md5({_ASSERT_INSTRUCTION}) END AS md5_instruction,
    CASE WHEN doc_id % 10 > 1 THEN '```python' END AS response_prefix,
    CASE doc_id % 10 WHEN 0 THEN 'no docstring' WHEN 1 THEN 'no assert in the docstring' END
    AS reject_reason FROM documents"""
)
def q_map_docstring_assert(spark, sf_dir):
    return map_docstring_assert(_assert_prompt(spark, sf_dir)).select(
        "id", F.md5("instruction").alias("md5_instruction"), "response_prefix", "reject_reason"
    )


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS id,
    md5({_fence_sql(sql_text(FUNCTION_SENTENCE), f"trim(chr(10) || text || ' ', {WS_SQL})")}) AS md5_instruction,
    md5('```python' || chr(10) || trim(chr(10) || text || ' ', {WS_SQL})) AS md5_prefix
    FROM documents"""
)
def q_map_function(spark, sf_dir):
    prompt = F.concat(F.lit("\n"), "text", F.lit(" "))
    tasks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("task_id"), prompt.alias("prompt")
    )
    return map_function_prompt(tasks).select(
        "id",
        F.md5("instruction").alias("md5_instruction"),
        F.md5("response_prefix").alias("md5_prefix"),
    )


_COMPLETE = "(CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'def f():' || chr(10) || text ELSE text END)"
_INSTRUCT = "('Explain. ' || text || ' ')"


@query(
    " UNION ALL ".join(
        f"""SELECT CAST(doc_id AS VARCHAR) AS id, '{mode}' AS mode,
        md5({_fence_sql(sql_text(TWO_MODE_SENTENCE), prompt)}) AS md5_instruction,
        md5({_prefix_sql(prompt)}) AS md5_prefix FROM documents"""
        for mode, prompt in (("complete", _COMPLETE), ("instruct", _INSTRUCT))
    )
)
def q_map_two_mode(spark, sf_dir):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\ndef f():\n"), "text"))
    tasks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("task_id"),
        head.otherwise(F.col("text")).alias("complete_prompt"),
        F.concat(F.lit("Explain. "), "text", F.lit(" ")).alias("instruct_prompt"),
    )
    both = [map_two_mode(tasks, m).withColumn("mode", F.lit(m)) for m in ("complete", "instruct")]
    return both[0].unionByName(both[1]).select(
        "id",
        "mode",
        F.md5("instruction").alias("md5_instruction"),
        F.md5("response_prefix").alias("md5_prefix"),
    )


_DS_LEAD = f"{sql_text(DATA_SCIENCE_SENTENCE + chr(10))} || {_BLOCK}"


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, md5({_fence_sql(_DS_LEAD, _COMPLETE)}) AS md5_instruction,
    md5({_prefix_sql(_COMPLETE)}) AS md5_prefix, '{{}}' AS metadata FROM documents"""
)
def q_map_ds_fewshot(spark, sf_dir):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\ndef f():\n"), "text"))
    tasks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("task_id"), head.otherwise(F.col("text")).alias("prompt")
    )
    return map_ds_fewshot(tasks, EXAMPLES).select(
        "id",
        F.md5("instruction").alias("md5_instruction"),
        F.md5("response_prefix").alias("md5_prefix"),
        F.to_json("metadata").alias("metadata"),
    )


@query(
    """SELECT doc_id AS id, md5('Task: ' || '{response} ' || text || ' {kept}' || chr(10) || chr(10)
    || 'Answer: ' || lang || ' {instruction}') AS md5_prompt FROM documents"""
)
def q_render_template(spark, sf_dir):
    prompt = render_template(
        TEMPLATE,
        instruction=F.concat(F.lit("{response} "), "text"),
        response=F.concat("lang", F.lit(" {instruction}")),
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.md5(prompt).alias("md5_prompt"))


_FENCED = """CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN concat('```', text)
    ELSE concat(text, '```', lang, '```') END"""


@query(
    f"""SELECT doc_id AS id, md5(split_part({_FENCED}, '```', 1) || chr(10)) AS md5_code
    FROM documents"""
)
def q_extract_code(spark, sf_dir):
    code = answer_newline(extract_code_block(F.expr(_FENCED)))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.md5(code).alias("md5_code"))
