"""Model keys, context sizes, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillwright.functions.text import _col
from fillwright.operators.contracts import REASON, reason_when

# Model key, family, infill format (None: no format), context size.
MODELS = [
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

# Context of a model given by path, and default generation settings.
LOCAL_CONTEXT = 16384
MAX_NEW_TOKENS = 200
TOP_P = 1.0
TEMPERATURE = 1.0
MAX_LENGTH = 99999999999999999

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("model_key", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("fim_format", T.StringType()),
        T.StructField("max_context_size", T.IntegerType()),
    ]
)


def models(spark: SparkSession) -> DataFrame:
    """The twelve known models, the fixed side of every model join."""
    return spark.createDataFrame(MODELS, MODEL_SCHEMA)


def attach_model(df: DataFrame, model_col: str = "model_key") -> DataFrame:
    """Add family, infill format and context size by model key.

    Broadcasts the twelve-row table, so a key that holds most rows costs no
    shuffle. A key outside the table is a local path with the default context.
    """
    dim = models(df.sparkSession).withColumnRenamed("model_key", "_key")
    return (
        df.join(F.broadcast(dim), df[model_col] == F.col("_key"), "left")
        .drop("_key")
        .withColumn("max_context_size", F.coalesce("max_context_size", F.lit(LOCAL_CONTEXT)))
    )


def require_known_model(
    df: DataFrame, model_col: str = "model_key", local_paths: list[str] | None = None
) -> DataFrame:
    """The rows whose key is neither known nor one of the caller's paths."""
    dim = models(df.sparkSession).select(F.col("model_key").alias("_key"))
    unknown = df.join(F.broadcast(dim), df[model_col] == F.col("_key"), "left_anti")
    if not local_paths:
        return unknown
    # a null key is in no list
    return unknown.filter(~F.coalesce(F.col(model_col).isin(local_paths), F.lit(False)))


def token_budget(
    input_len: Column | str,
    context: Column | str = "max_context_size",
    max_new_tokens: int = MAX_NEW_TOKENS,
    max_length: int = MAX_LENGTH,
) -> Column:
    """How many tokens may be generated after ``input_len``."""
    used = _col(input_len).cast("bigint")
    return F.least(
        _col(context).cast("bigint") - used,
        F.lit(max_new_tokens).cast("bigint"),
        F.lit(max_length).cast("bigint") - used,
    )


def reject_over_context(
    df: DataFrame, input_len: Column | str, context: Column | str = "max_context_size"
) -> DataFrame:
    """Mark rows whose input fills the context."""
    over = _col(input_len) >= _col(context)
    return df.withColumn(REASON, reason_when((over, "input fills the context")))


def decoding_mode(df: DataFrame, temperature: str = "temperature") -> DataFrame:
    """Add ``do_sample`` and the temperature to pass on, null when not sampling."""
    sampling = F.col(temperature) != 0.0
    return df.withColumn("do_sample", sampling).withColumn(
        "sampling_temperature", F.when(sampling, F.col(temperature))
    )
