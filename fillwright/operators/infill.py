"""Infill tasks and their prompt formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwright.functions.text import MARKER, _col
from fillwright.operators.contracts import REASON, reason_when
from fillwright.operators.models import attach_model

# The markers each model family was trained with.
QWEN = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
DSCODER = ("<｜fim▁begin｜>", "<｜fim▁hole｜>", "<｜fim▁end｜>")
STARCODER = ("<fim_prefix>", "<fim_suffix>", "<fim_middle>")
CODELLAMA = ("▁<PRE>", "▁<SUF>", "▁<MID>")

# Vocabulary ids of the markers before the prefix, between and
# after the suffix, and the word each must contain.
MARKER_IDS = (32016, 32015, 32017)
MARKER_WORDS = ("begin", "hole", "end")

# Short model names and their formats.
SHORT_NAMES = {"qwen": "qwen", "dscoder": "dscoder"}


def split_infill(df: DataFrame, prompt_col: str = "eval_prompt") -> DataFrame:
    """Cut the text at the completion marker: piece 0 is the prompt, piece 1 the
    suffix, later pieces are not used. Without a marker the row is rejected."""
    text, marker = F.col(prompt_col), F.lit(MARKER)
    found = F.contains(text, marker)
    return (
        df.withColumn("prompt", F.when(found, F.split_part(text, marker, F.lit(1))))
        .withColumn("suffix", F.when(found, F.split_part(text, marker, F.lit(2))))
        .withColumn(REASON, reason_when((~F.coalesce(found, F.lit(False)), "no completion marker")))
    )


def _around(markers: tuple, prefix: Column | str, suffix: Column | str) -> Column:
    before, between, after = (F.lit(m) if isinstance(m, str) else m for m in markers)
    return F.concat(before, _col(prefix), between, _col(suffix), after)


def fim_qwen(prefix: Column | str = "prompt", suffix: Column | str = "suffix") -> Column:
    return _around(QWEN, prefix, suffix)


def fim_dscoder(prefix: Column | str = "prompt", suffix: Column | str = "suffix") -> Column:
    return _around(DSCODER, prefix, suffix)


def fim_starcoder(prefix: Column | str = "prompt", suffix: Column | str = "suffix") -> Column:
    return _around(STARCODER, prefix, suffix)


def fim_codellama(prefix: Column | str = "prompt", suffix: Column | str = "suffix") -> Column:
    return _around(CODELLAMA, prefix, suffix)


FORMATS = {
    "qwen": fim_qwen,
    "dscoder": fim_dscoder,
    "starcoder": fim_starcoder,
    "codellama": fim_codellama,
}


def fim_by_token_ids(
    vocabulary: DataFrame, prefix: Column | str = "prompt", suffix: Column | str = "suffix"
) -> Column:
    """Markers looked up by id in the caller's ``(id, token)`` vocabulary.

    The three rows become one scalar subquery, read once per query. A missing
    id, or a token without the expected word, fails the query.
    """

    def token(i: int) -> Column:
        return F.max(F.when(F.col("id") == MARKER_IDS[i], F.col("token")))

    found = vocabulary.filter(F.col("id").isin(*MARKER_IDS)).agg(
        F.struct(*[token(i).alias(w) for i, w in enumerate(MARKER_WORDS)]).alias("m")
    )
    right = F.lit(True)
    for word in MARKER_WORDS:
        right = right & F.coalesce(F.contains(F.col("m")[word], F.lit(word)), F.lit(False))
    message = F.lit("the vocabulary lacks the infill markers")
    # tested inside the subquery, once, not once per task row
    markers = found.select(F.when(right, F.col("m")).otherwise(F.raise_error(message))).scalar()
    return _around(tuple(markers[w] for w in MARKER_WORDS), prefix, suffix)


def infill_by_short_name(
    name: str, prefix: Column | str = "prompt", suffix: Column | str = "suffix"
) -> Column:
    """The format of a short model name; an unknown one raises."""
    key = name.lower()
    if key not in SHORT_NAMES:
        raise ValueError(f"unknown model: {name}")
    return FORMATS[SHORT_NAMES[key]](prefix, suffix)


def infill_for_model(
    df: DataFrame, model_col: str = "model_key", vocabulary: DataFrame | None = None
) -> DataFrame:
    """Add ``infill_prompt`` in the format of the row's model.

    Rows whose model has no format are rejected. With a ``vocabulary`` the
    token-id family takes its markers from there.
    """
    joined = attach_model(df, model_col)
    fmt = F.col("fim_format")
    expr = None
    for name, build in FORMATS.items():
        by_id = vocabulary is not None and name == "dscoder"
        prompt = fim_by_token_ids(vocabulary) if by_id else build()
        expr = F.when(fmt == name, prompt) if expr is None else expr.when(fmt == name, prompt)
    return joined.withColumn("infill_prompt", expr).withColumn(
        REASON, reason_when((fmt.isNull(), "model has no infill format"))
    )
