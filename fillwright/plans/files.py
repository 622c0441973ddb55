"""Queries that pass the tables through files, and whole runs over them.

Each writes to a folder of its own below the shared one and reads it back.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwright.functions.text import render_template
from fillwright.functions.tokens import byte_tokenizer
from fillwright.operators.completions import (
    code_answers,
    code_solutions,
    complete,
    drop_failed_rows,
    expand_samples,
    parse_metadata,
    strip_completion,
)
from fillwright.operators.contracts import (
    accepted,
    check_padding_bounds,
    check_parallel_lengths,
    check_same_count,
    checked,
    parallel,
    within_bound,
)
from fillwright.operators.infill import QWEN, infill_by_short_name, split_infill
from fillwright.operators.instruct import mapper_for
from fillwright.operators.ordering import with_file_ordinal
from fillwright.operators.sampling import RATIOS, percent_of
from fillwright.operators.scoring import answer_digest, exact_match, pair_by_position, score_pairs
from fillwright.operators.sft import sft_map
from fillwright.plans.catalogue import query
from fillwright.plans.corpora import RANKED_SQL
from fillwright.plans.scores import COUNTS_SQL, PAIRED_SQL
from fillwright.plans.views import (
    DOCUMENT_PAIR_SQL,
    INFILL_SQL,
    PAIR_SQL,
    PREDICTION_SQL,
    WS_SQL,
    document_pairs,
    documents,
    infill_tasks,
    predictions,
    sft_pairs,
    table,
    with_sql,
)
from fillwright.session import scratch_dir
from fillwright.sources.readers import (
    open_benchmark,
    read_ground_truth,
    read_infill_csv,
    read_infill_jsonl,
    read_predictions,
    read_sft_jsonl,
    read_subset,
    read_table_split,
)
from fillwright.sources.writers import (
    write_answers,
    write_completions,
    write_rings,
    write_solutions,
    write_subset,
    write_subsets,
)

TOKENS = byte_tokenizer()


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"


def _task_csv(spark, sf_dir) -> str:
    path = f"{_folder(spark)}/tasks.csv"
    tasks = infill_tasks(spark, sf_dir).select("task_id", "ground_truth", "eval_prompt")
    tasks.write.csv(path, header=True, escape='"', quoteAll=True)
    return path


@query(with_sql(INFILL_SQL) + "SELECT task_id, md5(eval_prompt) AS md5_prompt FROM v_infill")
def q_read_infill_csv(spark, sf_dir):
    kind, tasks = open_benchmark(spark, _task_csv(spark, sf_dir))
    return tasks.select("task_id", F.md5("eval_prompt").alias("md5_prompt"))


@query(
    "SELECT md5(text) AS md5_prompt, CAST(doc_id AS INT) AS n, lang AS library FROM documents"
)
def q_read_ds_csv(spark, sf_dir):
    path = f"{_folder(spark)}/ds-1000.csv"
    literal = F.format_string("{'n': %d, 'library': '%s', 'extra': None}", "doc_id", "lang")
    docs = table(spark, sf_dir, "documents").select(
        F.col("text").alias("prompt"), literal.alias("metadata")
    )
    docs.write.csv(path, header=True, escape='"', quoteAll=True)
    kind, tasks = open_benchmark(spark, path)
    return accepted(parse_metadata(tasks)).select(
        F.md5("prompt").alias("md5_prompt"),
        F.variant_get("metadata", "$.n", "int").alias("n"),
        F.variant_get("metadata", "$.library", "string").alias("library"),
    )


@query(
    """SELECT lang AS task_id, arg_max(md5(text), doc_id) AS md5_prompt,
    CAST(max(doc_id) AS VARCHAR) AS suffix,
    (SELECT count(*) FROM documents b WHERE b.doc_id < min(a.doc_id)) AS ord
    FROM documents a GROUP BY lang"""
)
def q_read_infill_jsonl(spark, sf_dir):
    # few ids, each repeated in a large share of the lines; the last line wins
    path = f"{_folder(spark)}/tasks.jsonl.gz"
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("task_id"),
        F.col("text").alias("prompt"),
        F.col("doc_id").cast("string").alias("suffix"),
        "doc_id",
    )
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").drop("doc_id")
    ordered.write.json(path, compression="gzip")
    tasks = read_infill_jsonl(spark, path)
    return tasks.select("task_id", F.md5("prompt").alias("md5_prompt"), "suffix", "ord")


@query(
    with_sql(INFILL_SQL, PREDICTION_SQL)
    + f"SELECT {COUNTS_SQL}, 'files' AS source {PAIRED_SQL}"
)
def q_score_files(spark, sf_dir):
    """Truth from CSV, completions from JSONL, paired by key."""
    tasks = infill_tasks(spark, sf_dir)
    written = write_completions(predictions(tasks), _folder(spark), "qwen", "tasks.csv")
    truth = read_ground_truth(spark, _task_csv(spark, sf_dir))
    return exact_match(truth, read_predictions(spark, written)).withColumn("source", F.lit("files"))


@query(with_sql(INFILL_SQL, PREDICTION_SQL) + f"SELECT {COUNTS_SQL} {PAIRED_SQL}")
def q_score_files_by_position(spark, sf_dir):
    """The same two files paired line by line, once they have the same length."""
    folder = _folder(spark)
    tasks = infill_tasks(spark, sf_dir).select("doc_id", "task_id", "ground_truth")
    lines = tasks.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    lines.select("task_id", "ground_truth").write.json(f"{folder}/truth.jsonl")
    answers = predictions(tasks).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    written = write_completions(answers, folder, "qwen", "tasks.csv")
    truth = spark.read.schema("task_id string, ground_truth string").json(f"{folder}/truth.jsonl")
    check_same_count(truth, read_predictions(spark, written))
    truths = with_file_ordinal(truth.select(answer_digest("ground_truth")))
    preds = with_file_ordinal(read_predictions(spark, written).select(answer_digest("completion")))
    return score_pairs(pair_by_position(truths, preds))


_IN_ORDER_SQL = with_sql(INFILL_SQL, PREDICTION_SQL) + """, v_lines AS (
  SELECT row_number() OVER (ORDER BY doc_id, s.i) - 1 AS ord, task_id, ground_truth,
         CASE WHEN (doc_id + s.i) % 5 = 0 THEN NULL ELSE completion END AS completion
  FROM v_pred JOIN v_infill USING (doc_id, task_id), (VALUES (0), (1), (2)) AS s(i))
"""


def _samples_in_order(spark, sf_dir):
    """Three samples a task, some null; ``doc_id`` is the place of the task."""
    rows = expand_samples(predictions(infill_tasks(spark, sf_dir)), 3)
    lost = (F.col("doc_id") + F.col("sample_idx")) % 5 == 0
    return rows.withColumn("completion", F.when(~lost, F.col("completion")))


@query(_IN_ORDER_SQL + "SELECT ord, task_id, md5(completion) AS md5_answer FROM v_lines")
def q_write_in_order(spark, sf_dir):
    """Completions in the order of their tasks, samples side by side, by line."""
    rows = _samples_in_order(spark, sf_dir)
    written = write_completions(rows, _folder(spark), "qwen", "tasks.csv", order=("doc_id", "sample_idx"))
    lines = read_predictions(spark, written, with_ordinal=True)
    return lines.select("ord", "task_id", F.md5("completion").alias("md5_answer"))


@query(
    _IN_ORDER_SQL
    + f"""SELECT count(*) AS n, CAST(sum(CASE WHEN trim(ground_truth, {WS_SQL}) = trim(completion, {WS_SQL})
    THEN 1 ELSE 0 END) AS BIGINT) AS correct, sum(CASE WHEN trim(ground_truth, {WS_SQL}) =
    trim(completion, {WS_SQL}) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS em FROM v_lines"""
)
def q_score_lines(spark, sf_dir):
    """A CSV of truths, a line for each sample, against completions by line number."""
    folder = _folder(spark)
    truths = expand_samples(infill_tasks(spark, sf_dir), 3)
    lines = truths.repartitionByRange("doc_id", "sample_idx").sortWithinPartitions("doc_id", "sample_idx")
    lines.select("task_id", "ground_truth").write.csv(f"{folder}/truth.csv", header=True, escape='"', quoteAll=True)
    answers = _samples_in_order(spark, sf_dir)
    written = write_completions(answers, folder, "qwen", "tasks.csv", order=("doc_id", "sample_idx"))
    truth = read_ground_truth(spark, f"{folder}/truth.csv", with_ordinal=True)
    # what is moved to be paired is 16 bytes an answer
    truth = truth.select("ord", answer_digest("ground_truth"))
    made = read_predictions(spark, written, with_ordinal=True).select("ord", answer_digest("completion"))
    return score_pairs(pair_by_position(truth, made))


@query(with_sql(INFILL_SQL) + "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, task_id, md5(eval_prompt) AS md5_prompt FROM v_infill")
def q_csv_ordinals(spark, sf_dir):
    """The place of every task in its CSV file, whose cells hold line breaks."""
    tasks = infill_tasks(spark, sf_dir)
    path = f"{_folder(spark)}/tasks.csv"
    ordered = tasks.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.select("task_id", "ground_truth", "eval_prompt").write.csv(path, header=True, escape='"', quoteAll=True)
    return read_infill_csv(spark, path, with_ordinal=True).select("ord", "task_id", F.md5("eval_prompt").alias("md5_prompt"))


@query(
    with_sql(PAIR_SQL, DOCUMENT_PAIR_SQL)
    + """SELECT 0 AS source_ord, md5(problem) AS md5_problem, md5(solution) AS md5_solution FROM v_sft
    UNION ALL SELECT 1, md5(problem), md5(solution) FROM v_docpair"""
)
def q_read_sft_jsonl(spark, sf_dir):
    folder = _folder(spark)
    paths = [f"{folder}/chat.jsonl", f"{folder}/docs.jsonl"]
    for df, path in zip((sft_pairs(spark, sf_dir), document_pairs(spark, sf_dir)), paths):
        df.select("problem", "solution").write.json(path)
    return read_sft_jsonl(spark, paths).select(
        "source_ord", F.md5("problem").alias("md5_problem"), F.md5("solution").alias("md5_solution")
    )


@query("SELECT doc_id, lang, md5(text) AS md5_text FROM documents")
def q_read_table_split(spark, sf_dir):
    # no split is named, so the first is read
    splits = {name: f"{sf_dir}/{name}.parquet" for name in ("documents", "benchmark")}
    rows = read_table_split(spark, splits)
    return rows.select("doc_id", "lang", F.md5("text").alias("md5_text"))


@query(
    """SELECT 'len ' || length(text) || chr(10) AS code,
    '{"lang":"' || lang || '","n":' || doc_id || ',"none":null}' AS metadata
    FROM documents"""
)
def q_write_answers(spark, sf_dir):
    """Data-science answers with their metadata as nested JSON."""
    meta = F.format_string("{'lang': '%s', 'n': %d, 'none': None}", "lang", "doc_id")
    docs = documents(spark, sf_dir).select(
        F.col("text").alias("prompt"), meta.alias("metadata")
    )
    tasks = accepted(parse_metadata(docs))
    done = drop_failed_rows(complete(tasks, _answer_length(), keep=True, on_error="keep"))
    path = write_answers(code_answers(done), _folder(spark), "dscoder", "ds-1000.csv")
    answers = spark.read.schema("code string, metadata variant").json(path)
    return answers.select("code", F.to_json("metadata").alias("metadata"))


def _answer_length():
    def make():
        return lambda prompts: [f"len {len(p)}" for p in prompts]

    return make


_BODY = f"trim(text, {WS_SQL})"
_FUNCTION_PROMPT = (
    "'Write a solution to the following problem:' || chr(10) || '```python' || chr(10) || "
    f"{_BODY} || chr(10) || '```' || chr(10) || chr(10) || '```python' || chr(10) || {_BODY}"
)


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS task_id, chr(10) || 'pass ' || length({_FUNCTION_PROMPT})
    AS code, 2 AS n FROM documents"""
)
def q_write_solutions(spark, sf_dir):
    """Text-to-code: map, render, sample, complete, cut at the fence, write."""
    tasks = documents(spark, sf_dir).select(
        F.col("doc_id").alias("task_id"), F.col("text").alias("prompt")
    )
    problems = mapper_for("humaneval")(tasks)
    template = "{instruction}\n\n{response}"
    prompts = problems.select(
        "id",
        render_template(
            template, instruction=F.col("instruction"), response=F.col("response_prefix")
        ).alias("prompt"),
    )
    done = complete(expand_samples(prompts, 2), _fenced_pass())
    solutions = code_solutions(done)
    path = write_solutions(solutions, f"{_folder(spark)}/solutions.jsonl", "humaneval")
    rows = spark.read.schema("task_id string, code string").json(path)
    return rows.groupBy("task_id", "code").agg(F.count("*").alias("n"))


def _fenced_pass():
    def make():
        return lambda prompts: [f"\npass {len(p)}```\nmore" for p in prompts]

    return make


@query(
    with_sql(INFILL_SQL)
    + f"""SELECT task_id, 'n' || (length(prompt) + length(suffix) + length('{"".join(QWEN)}'))
    AS completion FROM v_infill"""
)
def q_generate_infill(spark, sf_dir):
    """Infill run: tasks from CSV, split, format, complete, strip, write."""
    kind, tasks = open_benchmark(spark, _task_csv(spark, sf_dir))
    split = accepted(split_infill(tasks))
    prompts = split.select("task_id", infill_by_short_name("qwen").alias("prompt"))
    # one multi-line file is one task until the prompts are dealt out
    slots = spark.sparkContext.defaultParallelism
    done = complete(expand_samples(prompts, 1), _padded_length(), partitions=slots)
    stripped = done.withColumn("completion", strip_completion("completion", F.lit("qwen")))
    return read_predictions(spark, write_completions(stripped, _folder(spark), "qwen", "tasks.csv"))


def _padded_length():
    def make():
        return lambda prompts: [f"  n{len(p)}\n" for p in prompts]

    return make


@query(
    with_sql(RANKED_SQL)
    + """SELECT doc_id, lang, md5(text) AS md5_text FROM documents JOIN v_rank USING (doc_id)
    WHERE rank <= floor(n * CAST(0.57 AS DOUBLE))"""
)
def q_write_subset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = write_subset(docs, f"{_folder(spark)}/corpus", "doc_id", 0.57)
    rows = spark.read.schema("doc_id bigint, lang string, text string").json(path)
    return rows.select("doc_id", "lang", F.md5("text").alias("md5_text"))


@query(
    with_sql(RANKED_SQL)
    + " UNION ALL ".join(
        f"SELECT {pct} AS pct, count(*) AS n, min(doc_id) AS first_id, min(md5(text)) AS first_text "
        f"FROM v_rank JOIN documents USING (doc_id) WHERE rank <= floor(n * CAST({ratio} AS DOUBLE))"
        for pct, ratio in ((20, 0.2), (40, 0.4), (60, 0.6), (80, 0.8), (100, 1.0))
    )
)
def q_write_subsets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    folder = write_subsets(docs, f"{_folder(spark)}/corpus", "doc_id")
    rows = spark.read.schema("doc_id bigint, lang string, text string, pct int").json(folder)
    return rows.groupBy("pct").agg(
        F.count("*").alias("n"),
        F.min("doc_id").alias("first_id"),
        F.min(F.md5("text")).alias("first_text"),
    )


@query(
    with_sql(RANKED_SQL)
    + " UNION ALL ".join(
        f"SELECT {pct} AS pct, doc_id, md5(text) AS md5_text FROM v_rank JOIN documents USING (doc_id) "
        f"WHERE rank <= floor(n * CAST({ratio} AS DOUBLE))"
        for pct, ratio in ((20, 0.2), (40, 0.4), (60, 0.6), (80, 0.8), (100, 1.0))
    )
)
def q_subset_rings(spark, sf_dir):
    """The five nested subsets, stored once and read back as unions of rings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = write_rings(docs, f"{_folder(spark)}/corpus", "doc_id")
    subsets = [
        read_subset(spark, folder, percent_of(ratio), "doc_id bigint, text string").select(
            F.lit(percent_of(ratio)).alias("pct"), "doc_id", F.md5("text").alias("md5_text")
        )
        for ratio in RATIOS
    ]
    return reduce(DataFrame.unionAll, subsets)


@query(
    with_sql(DOCUMENT_PAIR_SQL)
    + """SELECT id, CAST(least(1216, octet_length(encode(problem)) + octet_length(encode(solution)) + 9)
    AS INT) AS n_ids FROM v_docpair"""
)
def q_checked_examples(spark, sf_dir):
    """Training examples that passed the length and bound checks."""
    examples = sft_map(
        document_pairs(spark, sf_dir), "Q: {instruction}\nA: {response}", TOKENS, keep=("id",)
    )
    check_parallel_lengths(examples, "input_ids", "labels")
    check_padding_bounds(examples, "input_ids", 1216)
    ids = F.size("input_ids")
    sound = parallel("input_ids", "labels") & within_bound("input_ids", 1216)
    return examples.select("id", checked(ids, sound, "an example breaks its bounds").alias("n_ids"))
