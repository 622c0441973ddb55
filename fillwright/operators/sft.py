"""Problem/solution pairs into label-masked, truncated, padded batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwright.functions.text import _col, render_template
from fillwright.functions.tokens import (
    IGNORED_INDEX,
    Tokenizer,
    attention_mask,
    encode,
    encoded_length,
    pad_left,
    pad_right,
)
from fillwright.operators.contracts import checked
from fillwright.operators.ordering import chunk, shuffled_batches

MAX_TRAINING_SEQ_LENGTH = 1216  # fixed value: default sequence limit


def sft_prompt_ids(prompt: Column | str, tokenizer: Tokenizer, limit: int | None = None) -> Column:
    return encode(prompt, tokenizer, add_bos=True, truncation=limit)


def sft_completion_ids(
    completion: Column | str, tokenizer: Tokenizer, limit: int | None = None
) -> Column:
    return encode(completion, tokenizer, add_eos=True, truncation=limit)


def sft_concat(prompt_ids: Column | str, completion_ids: Column | str) -> Column:
    return F.concat(_col(prompt_ids), _col(completion_ids))


def sft_labels(prompt_ids: Column | str, completion_ids: Column | str) -> Column:
    """The ignored label for every prompt position, then the completion."""
    masked = F.array_repeat(F.lit(IGNORED_INDEX), F.size(_col(prompt_ids)))
    return F.concat(masked, _col(completion_ids))


def sft_truncate(ids: Column | str, max_length: int) -> Column:
    return F.slice(_col(ids), 1, max_length)


def _prompt(template: str) -> Column:
    return render_template(template, instruction=F.col("problem"), response=F.lit(""))


def _pair_length(prompt: Column | str, tokenizer: Tokenizer) -> Column:
    """Ids of prompt and completion together, before the cut."""
    return encoded_length(prompt, tokenizer, add_bos=True) + encoded_length(
        "solution", tokenizer, add_eos=True
    )


def sft_map(
    pairs: DataFrame,
    template: str,
    tokenizer: Tokenizer,
    max_length: int = MAX_TRAINING_SEQ_LENGTH,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``input_ids``, ``labels`` and ``exceeding_length`` of every pair.

    One projection, no shuffle. The flag comes from the full lengths; the ids
    are then built only as far as the limit keeps them.
    """
    # nothing past the limit survives the cut, so no text is expanded past it;
    # an end id that moves forward by this still lies beyond the limit
    prompt_ids = sft_prompt_ids("_prompt", tokenizer, max_length)
    completion_ids = sft_completion_ids("solution", tokenizer, max_length)
    return (
        pairs.select(*keep, "solution", _prompt(template).alias("_prompt"))
        .select(
            *keep,
            prompt_ids.alias("_p"),
            completion_ids.alias("_c"),
            (_pair_length("_prompt", tokenizer) > max_length).alias("exceeding_length"),
        )
        .select(
            *keep,
            sft_truncate(sft_concat("_p", "_c"), max_length).alias("input_ids"),
            sft_truncate(sft_labels("_p", "_c"), max_length).alias("labels"),
            "exceeding_length",
        )
    )


def count_truncated(examples: DataFrame) -> DataFrame:
    """How many examples were over the limit, of how many."""
    return examples.agg(
        F.coalesce(F.sum(F.col("exceeding_length").cast("bigint")), F.lit(0)).alias("truncated"),
        F.count("*").alias("total"),
    )


def batch_max_length(df: DataFrame, length: Column, width_col: str = "width") -> DataFrame:
    """Add the largest ``length`` of the row's batch.

    A batch has as many rows as its chunk size, so the window stays small; it
    costs one shuffle, where an aggregate joined back would compute the rows
    twice.
    """
    batch = Window.partitionBy("batch_id")
    return df.withColumn(width_col, F.max(length).over(batch))


def collate(
    df: DataFrame,
    pad_id: int,
    max_length: int = MAX_TRAINING_SEQ_LENGTH,
    pad_to_max_length: bool = False,
) -> DataFrame:
    """Pad ids and labels of every batch to one width and add the mask.

    Takes ``batch_id`` from ``chunk``, and ``width`` where it is known already.
    Padding to the limit needs no shuffle.
    """
    if pad_to_max_length:
        wide = df.withColumn("width", F.lit(max_length))
    elif "width" in df.columns:
        wide = df
    else:
        wide = batch_max_length(df, F.size("input_ids"))
    width = checked(F.col("width"), F.col("width") <= max_length, "a batch is wider than the limit")
    return (
        wide.withColumn("width", width)
        .withColumn("input_ids", pad_right("input_ids", F.col("width"), pad_id))
        .withColumn("labels", pad_right("labels", F.col("width"), IGNORED_INDEX))
        .withColumn("attention_mask", attention_mask("input_ids", pad_id))
    )


def sft_batches(
    pairs: DataFrame,
    template: str,
    tokenizer: Tokenizer,
    rows: int,
    max_length: int = MAX_TRAINING_SEQ_LENGTH,
    pad_to_max_length: bool = False,
    order: str = "ord",
    keep: tuple[str, ...] = (),
    shuffle_by: Sequence[str] | str = (),
    seed: int = 42,
) -> DataFrame:
    """Ordered pairs to padded batches of ``rows``: chunk, tokenize, collate.

    With ``shuffle_by``, columns that identify a row, the order is the seeded
    permutation and is made here, by the same shuffle that gathers the batches.

    Where the tokenizer tells lengths without tokenizing, the batch width follows
    from the texts, so the shuffle that gathers a batch carries text; ids and
    labels, eight times its size, are built after. Else each text is tokenized
    once, before the shuffle, and the cut ids travel.
    """
    known = ("batch_id",)
    length = None
    if not pad_to_max_length and tokenizer.cheap_length:
        length = F.least(_pair_length(_prompt(template), tokenizer), F.lit(max_length))
        known = ("batch_id", "width")
    if shuffle_by:
        batches = shuffled_batches(pairs, shuffle_by, rows, seed, length, order)
    else:
        batches = chunk(pairs, rows, order)
        if length is not None:
            batches = batch_max_length(batches, length)
    examples = sft_map(batches, template, tokenizer, max_length, keep=(*keep, *known))
    return collate(examples, tokenizer.pad_token_or_eos, max_length, pad_to_max_length)


def encode_with_padding(
    df: DataFrame,
    text: str,
    tokenizer: Tokenizer,
    side: str = "left",
    add_bos: bool = False,
    add_eos: bool = False,
    ids_col: str = "input_ids",
) -> DataFrame:
    """Encode a text and pad it to the longest of its batch; padding on the left
    is what batched generation needs. The batch is gathered as text, or as ids
    where only tokenizing tells their number. A ``width`` that is known already,
    as from ``shuffled_batches``, is taken and nothing is gathered."""
    if side not in ("left", "right"):
        raise ValueError(f"unknown padding side: {side}")
    pad = pad_left if side == "left" else pad_right
    ids = encode(text, tokenizer, add_bos, add_eos)
    if "width" in df.columns:
        return df.withColumn(ids_col, ids).withColumn(
            ids_col, pad(ids_col, F.col("width"), tokenizer.pad_token_or_eos)
        )
    if not tokenizer.cheap_length:
        wide = batch_max_length(df.withColumn(ids_col, ids), F.size(ids_col))
        return wide.withColumn(
            ids_col, pad(ids_col, F.col("width"), tokenizer.pad_token_or_eos)
        )
    wide = batch_max_length(df, encoded_length(text, tokenizer, add_bos, add_eos))
    return wide.withColumn(ids_col, ids).withColumn(
        ids_col, pad(ids_col, F.col("width"), tokenizer.pad_token_or_eos)
    )
