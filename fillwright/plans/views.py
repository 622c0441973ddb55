"""Inputs of the query catalogue, derived from the given tables.

Each view exists twice, as a DataFrame and as the text of a SQL common table
expression, so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwright.functions.text import MARKER, WHITESPACE
from fillwright.operators.models import MODELS

WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"

# Examples for the few-shot queries, with white space at both ends.
EXAMPLES = [
    ("  Return the larger of two numbers.\n", "\tmax(a, b)\n"),
    ("\nReverse a list.  \n", " items[::-1]"),
    ("Count the words of a text.　", "len(text.split())\n\n"),
]

TEMPLATE = "Task: {instruction} {{kept}}\n\nAnswer: {response}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def csv_text(ids: str | Column) -> Column:
    """An array as comma-joined text, for comparing results."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat_ws(",", c.cast("array<string>"))


def sql_text(value: str) -> str:
    """A text as a SQL literal of printable ASCII parts and chr() calls."""
    parts, run = [], ""
    for ch in value:
        if " " <= ch <= "~":
            run += ch.replace("'", "''")
            continue
        if run:
            parts.append(f"'{run}'")
            run = ""
        parts.append(f"chr({ord(ch)})")
    if run or not parts:
        parts.append(f"'{run}'")
    return "(" + " || ".join(parts) + ")"


# --- infill tasks: a gap of up to 40 characters after the first third ---------


def infill_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, cut, k = F.col("text"), F.col("_cut"), F.col("_k")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang", "text")
        .withColumn("_cut", F.expr("cast(char_length(text) div 3 as int)"))
        .withColumn("_k", F.least(F.lit(40), F.char_length(text) - cut))
        .select(
            "doc_id",
            F.col("doc_id").cast("string").alias("task_id"),
            "lang",
            F.substr(text, cut + 1, k).alias("ground_truth"),
            F.concat(
                F.substr(text, F.lit(1), cut), F.lit(MARKER), F.substr(text, cut + k + 1)
            ).alias("eval_prompt"),
        )
    )


INFILL_SQL = f"""
v_cut AS (
  SELECT doc_id, lang, text, length(text) // 3 AS cut,
         least(40, length(text) - length(text) // 3) AS k FROM documents),
v_infill AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS task_id, lang,
         substr(text, cut + 1, k) AS ground_truth,
         substr(text, 1, cut) || '{MARKER}' || substr(text, cut + k + 1) AS eval_prompt,
         substr(text, 1, cut) AS prompt, substr(text, cut + k + 1) AS suffix
  FROM v_cut)"""


def prediction_of() -> Column:
    """A third as the truth, a third with white space around, a third wrong."""
    truth, kind = F.col("ground_truth"), F.col("doc_id") % 3
    padded = F.concat(F.lit("  "), truth, F.lit("\n　"))
    return F.when(kind == 0, truth).when(kind == 1, padded).otherwise(F.concat(truth, F.lit("x")))


def predictions(tasks: DataFrame) -> DataFrame:
    return tasks.select("doc_id", "task_id", prediction_of().alias("completion"))


PREDICTION_SQL = """
v_pred AS (
  SELECT doc_id, task_id, CASE doc_id % 3 WHEN 0 THEN ground_truth
         WHEN 1 THEN '  ' || ground_truth || chr(10) || chr(12288)
         ELSE ground_truth || 'x' END AS completion FROM v_infill)"""


def sampled_predictions(tasks: DataFrame) -> DataFrame:
    """Two samples a task, some null, those of every seventh under an unknown id."""
    twice = predictions(tasks).withColumn("sample_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    lost = (F.col("sample_idx") == 1) & (F.col("doc_id") % 2 == 0)
    answer = F.when(lost, F.lit(None).cast("string")).otherwise(F.col("completion"))
    unknown = F.concat(F.lit("x"), "task_id")
    key = F.when(F.col("doc_id") % 7 == 0, unknown).otherwise(F.col("task_id"))
    return twice.select(key.alias("task_id"), "sample_idx", answer.alias("completion"))


SAMPLED_SQL = """
v_samples AS (
  SELECT CASE WHEN doc_id % 7 = 0 THEN 'x' || task_id ELSE task_id END AS task_id, sample_idx,
         CASE WHEN sample_idx = 1 AND doc_id % 2 = 0 THEN NULL ELSE completion END AS completion
  FROM v_pred, (VALUES (0), (1)) AS s(sample_idx))"""


# --- training pairs: a user turn and the assistant turn that follows -----------


def sft_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined on (conversation, turn), so a long conversation is not one group."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("problem")
    )
    replied = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("solution")
    )
    # a turn is a 32-bit number, so the pair is one number without collisions
    ident = (F.col("conv_id") * F.lit(1 << 32) + F.col("turn")).alias("id")
    return asked.join(replied, ["conv_id", "turn"]).select(ident, "problem", "solution")


PAIR_SQL = """
v_turn AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations),
v_sft AS (
  SELECT conv_id * 4294967296 + turn AS id, text AS problem, next_text AS solution
  FROM v_turn WHERE role = 'user' AND next_role = 'assistant')"""


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first third of a document and the rest of it."""
    cut = F.expr("cast(char_length(text) div 3 as int)")
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.substr("text", F.lit(1), cut).alias("problem"),
        F.substr("text", cut + 1).alias("solution"),
    )


DOCUMENT_PAIR_SQL = """
v_docpair AS (
  SELECT doc_id AS id, substr(text, 1, length(text) // 3) AS problem,
         substr(text, length(text) // 3 + 1) AS solution FROM documents)"""


# --- models: every known key, a path and an unknown key, by document id -------

MODEL_KEYS = [m[0] for m in MODELS] + ["/models/local", "nobody/unknown"]


def model_key() -> Column:
    keys = F.array(*[F.lit(k) for k in MODEL_KEYS])
    at = (F.col("doc_id") % len(MODEL_KEYS)).cast("int") + 1
    return F.element_at(keys, at)


_KEY_LIST = ", ".join(f"'{k}'" for k in MODEL_KEYS)
MODEL_KEY_SQL = f"([{_KEY_LIST}])[CAST(doc_id % {len(MODEL_KEYS)} AS INT) + 1]"
MODEL_SQL = "v_models(model_key, family, fim_format, max_context_size) AS (VALUES " + ", ".join(
    f"('{k}', '{fam}', {'NULL' if fmt is None else repr(fmt)}, {ctx})" for k, fam, fmt, ctx in MODELS
) + ")"


# --- bytes --------------------------------------------------------------------


def bytes_sql(text: str) -> str:
    """The UTF-8 bytes of a SQL text as a list of integers."""
    return (
        f"list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda h: CAST('0x' || h AS INT))"
    )


def with_sql(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"
