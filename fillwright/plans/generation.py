"""Queries over completion jobs and their output."""

from __future__ import annotations

import uuid

from pyspark.errors import PythonException
from pyspark.sql import functions as F

from fillwright.functions.tokens import byte_tokenizer, decode, encode, strip_prompt_ids
from fillwright.operators.completions import (
    code_solutions,
    complete,
    complete_resumable,
    drop_failed_rows,
    expand_samples,
    failed_rows,
    lookup_completions,
    parse_metadata,
    strip_completion,
    strip_prompt_text,
)
from fillwright.plans.catalogue import query
from fillwright.plans.views import (
    INFILL_SQL,
    PREDICTION_SQL,
    WS_SQL,
    infill_tasks,
    prediction_of,
    predictions,
    table,
    with_sql,
)
from fillwright.session import scratch_dir
from fillwright.sources.readers import read_predictions
from fillwright.sources.writers import write_completions

TOKENS = byte_tokenizer()


def _stub():
    """A stand-in for a model: the answer tells the prompt's length, and prompts
    of some lengths fail."""

    # a local function reaches the workers by value, wherever the package is
    def make():
        def run(prompts, samples):
            for prompt in prompts:
                if len(prompt) % 11 == 0:
                    raise ValueError(f"length {len(prompt)}")
            return [f"return {len(p) + i}\n```\ndone" for p, i in zip(prompts, samples)]

        return run

    return make


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("prompt")
    )


_SAMPLES = """WITH t AS (
  SELECT CAST(doc_id AS VARCHAR) AS task_id, text AS prompt, doc_id, lang, sample_idx
  FROM documents, (VALUES (0), (1)) AS s(sample_idx))
"""


@query(_SAMPLES + "SELECT task_id, sample_idx FROM t")
def q_expand_samples(spark, sf_dir):
    return expand_samples(_tasks(spark, sf_dir), 2).select("task_id", "sample_idx")


@query(
    _SAMPLES
    + """SELECT task_id, sample_idx, 'return ' || (length(prompt) + sample_idx) || chr(10) AS code
    FROM t WHERE length(prompt) % 11 <> 0"""
)
def q_complete_stub(spark, sf_dir):
    samples = expand_samples(_tasks(spark, sf_dir), 2)
    done = complete(samples, _stub(), inputs=("prompt", "sample_idx"), on_error="keep")
    return code_solutions(drop_failed_rows(done)).select("task_id", "sample_idx", "code")


@query(
    _SAMPLES
    + """SELECT task_id, sample_idx, 'ValueError: length ' || length(prompt) AS reject_reason
    FROM t WHERE length(prompt) % 11 = 0"""
)
def q_failed_rows(spark, sf_dir):
    samples = expand_samples(_tasks(spark, sf_dir), 2)
    done = complete(samples, _stub(), inputs=("prompt", "sample_idx"), on_error="keep")
    return failed_rows(done).select("task_id", "sample_idx", "reject_reason")


def _dying(run: str, last: int):
    """Answers tell the run that made them; a part beyond ``last`` ends the run."""

    def make():
        def answer(prompts, parts):
            if max(parts) > last:
                raise RuntimeError(f"{run} run: part {max(parts)}")
            return [f"{run} {len(p)}" for p in prompts]

        return answer

    return make


@query(
    _SAMPLES
    + """, p AS (SELECT *, CAST('0x' || left(md5('0:' || task_id || ':' || sample_idx), 7) AS INT) % 4 AS part FROM t)
    SELECT task_id, sample_idx, CASE WHEN part < 2 THEN 'first ' ELSE 'second ' END || length(prompt) AS completion FROM p"""
)
def q_complete_resumed(spark, sf_dir):
    """A completion job that dies half way, and the run that does the rest of it."""
    folder = f"{scratch_dir(spark)}/answers-{uuid.uuid4().hex}"
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("0"), "task_id", "sample_idx")), 1, 7), 16, 10)
    tasks = expand_samples(_tasks(spark, sf_dir), 2).withColumn("part", number.cast("int") % 4)
    given = {"folder": folder, "parts": 4, "inputs": ("prompt", "part")}
    try:
        complete_resumable(tasks, _dying("first", 1), **given)
    except PythonException as e:
        if "first run: part" not in str(e):
            raise
    done = complete_resumable(tasks, _dying("second", 3), **given)
    return done.select("task_id", "sample_idx", "completion")


@query(
    _SAMPLES
    + """SELECT task_id, sample_idx, CASE WHEN sample_idx = 0 THEN lang || ':0' END AS completion
    FROM t"""
)
def q_lookup_completions(spark, sf_dir):
    tasks = expand_samples(_tasks(spark, sf_dir), 2).drop("prompt")
    # one sample of every task is stored, so the second finds none
    stored = expand_samples(table(spark, sf_dir, "documents").select("doc_id", "lang"), 1)
    stored = stored.select(
        F.col("doc_id").cast("string").alias("task_id"),
        "sample_idx",
        F.concat_ws(":", "lang", "sample_idx").alias("completion"),
    )
    return lookup_completions(tasks, stored)


@query(
    with_sql(INFILL_SQL, PREDICTION_SQL)
    + f""", j AS (SELECT *, CASE doc_id % 2 WHEN 0 THEN 'qwen' ELSE 'dscoder' END AS model
      FROM v_infill JOIN v_pred USING (task_id, doc_id))
    SELECT task_id, model, completion AS from_text, completion AS from_ids,
    CASE WHEN model = 'qwen' THEN trim(completion, {WS_SQL}) ELSE completion END AS stripped FROM j"""
)
def q_strip_prompt(spark, sf_dir):
    tasks = infill_tasks(spark, sf_dir)
    # the answer column is built next to its prompt, so no join is needed
    both = tasks.withColumn("completion", prediction_of())
    prompt = F.col("eval_prompt")
    output = F.concat(prompt, F.col("completion"))
    model = F.when(F.col("doc_id") % 2 == 0, "qwen").otherwise("dscoder")
    rows = both.select(
        "task_id",
        model.alias("model"),
        strip_prompt_text(output, prompt).alias("from_text"),
        strip_prompt_ids(encode(output, TOKENS), F.octet_length(prompt)).alias("ids"),
    )
    return rows.select(
        "task_id",
        "model",
        "from_text",
        decode("ids", TOKENS).alias("from_ids"),
        strip_completion("from_text", "model").alias("stripped"),
    )


_METADATA = r"""CASE WHEN doc_id % 7 = 0 THEN concat('{\'library\': ', lang)
    ELSE concat('{\'library\': \'', lang, '\', \'cnt\': ', doc_id,
                ', \'ok\': True, \'none\': None, \'deep\': {\'k\': [1, \'b\']}}') END"""


@query(
    """SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS library,
    CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS cnt, CASE WHEN doc_id % 7 <> 0 THEN true END AS ok,
    CASE WHEN doc_id % 7 <> 0 THEN 'b' END AS deep,
    CASE WHEN doc_id % 7 = 0 THEN 'metadata is no literal' END AS reject_reason FROM documents"""
)
def q_parse_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.expr(_METADATA).alias("metadata")
    )
    return parse_metadata(docs).select(
        "id",
        F.try_variant_get("metadata", "$.library", "string").alias("library"),
        F.try_variant_get("metadata", "$.cnt", "bigint").alias("cnt"),
        F.try_variant_get("metadata", "$.ok", "boolean").alias("ok"),
        F.try_variant_get("metadata", "$.deep.k[1]", "string").alias("deep"),
        "reject_reason",
    )


@query(with_sql(INFILL_SQL, PREDICTION_SQL) + "SELECT task_id, completion FROM v_pred")
def q_jsonl_roundtrip(spark, sf_dir):
    pred = predictions(infill_tasks(spark, sf_dir))
    folder = f"{scratch_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    return read_predictions(spark, write_completions(pred, folder, "qwen", "documents.csv"))
