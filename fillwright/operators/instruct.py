"""Instruction prompts: few-shot blocks, chat messages, benchmark mappers.

Every mapper adds ``id``, ``instruction``, ``response_prefix`` and a ``metadata``
VARIANT, null except for data-science tasks, so problems of several benchmarks
can be stacked. Rows a mapper cannot take carry a ``reject_reason``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillwright.functions.text import (
    FENCE,
    _col,
    id_as_string,
    index_of,
    rindex_of,
    rstrip_py,
    slice_text,
    strip_py,
)
from fillwright.operators.contracts import REASON, checked, reason_when

FewShots = DataFrame | Sequence[tuple[str, str]]

PY_FENCE = FENCE + "python"

# Instruction sentences of the benchmarks.
ASSERTION_SENTENCE = " Your code should satisfy the following assertion:"
FUNCTION_SENTENCE = "Write a solution to the following problem:"
TWO_MODE_SENTENCE = "Write a correct and efficient solution for the following problem:"
DATA_SCIENCE_SENTENCE = (
    "You will be given Prompt: (It may include Problem: and A: in the prompt) and you must "
    "output only the  codes to be continued after the BEGIN SOLUTION or SOLUTION START."
)


def ordered_concat(df: DataFrame, value: Column, order: str = "ord") -> Column:
    """All values in order as one text: a scalar subquery, run once per query.

    A null value fails the query: a prompt must not lose a part unseen.
    """
    whole = checked(value, value.isNotNull(), "an example lacks one of its texts")
    named = df.select(whole.alias("_value"), F.col(order).alias("_order"))
    text = F.coalesce(
        F.expr("listagg(_value, '') within group (order by _order)"), F.lit("")
    )
    return named.agg(text.alias("_text")).scalar()


def _block(shots: FewShots | None, in_rows: Callable, in_python: Callable) -> Column:
    if shots is None:
        return F.lit("")
    if isinstance(shots, DataFrame):
        return ordered_concat(shots, in_rows())
    return F.lit("".join(in_python(p, s) for p, s in shots))


def fewshot_prefix_compact(shots: FewShots | None) -> Column:
    """Examples in order, problem right-stripped and solution stripped, joined."""
    return _block(
        shots,
        lambda: F.concat(rstrip_py("problem"), strip_py("solution")),
        lambda problem, solution: problem.rstrip() + solution.strip(),
    )


def fewshot_prefix_block(shots: FewShots | None) -> Column:
    """Examples in order, each followed by a blank line."""
    return _block(
        shots,
        lambda: F.concat(strip_py("problem"), F.lit("\n"), strip_py("solution"), F.lit("\n\n")),
        lambda problem, solution: f"{problem.strip()}\n{solution.strip()}\n\n",
    )


def attach_fewshots(df: DataFrame, block: Column, name: str = "shots") -> DataFrame:
    """Give every row the same few-shot text; no join, the block is one value."""
    return df.withColumn(name, block)


def chat_messages(prompt: Column | str, shots: Column | None = None) -> Column:
    """One user message holding the few-shot text and the prompt."""
    content = F.concat(shots, _col(prompt)) if shots is not None else _col(prompt)
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def render_chat(
    messages: Column | str,
    around: dict[str, tuple[str, str]],
    generation: str = "",
) -> Column:
    """Chat messages as one text: each content between the two texts of its
    role, then the text that asks for an answer. A role without texts fails, and
    a chat with a message that has no content is null as a whole."""
    entries = [F.lit(x) for role, texts in around.items() for x in (role, F.array(*map(F.lit, texts)))]
    texts_of = F.create_map(*entries)

    def one(message: Column) -> Column:
        texts = texts_of[message["role"]]
        return F.when(
            texts.isNotNull(), F.concat(texts[0], message["content"], texts[1])
        ).otherwise(F.raise_error(F.concat(F.lit("no texts for the role "), message["role"])))

    texts = F.transform(_col(messages), one)
    # joining would leave a null out
    whole = F.forall(_col(messages), lambda m: m["content"].isNotNull())
    return F.concat(F.when(whole, F.array_join(texts, "")), F.lit(generation))


def _fenced(sentence: Column, body: Column) -> Column:
    return F.concat(sentence, F.lit(f"\n{PY_FENCE}\n"), body, F.lit(f"\n{FENCE}"))


def _prefix_for(prompt: Column) -> Column:
    """The open fence, continued with the prompt when that is a function head."""
    body = strip_py(prompt)
    start = F.lit(PY_FENCE)
    return F.when(F.startswith(body, F.lit("def ")), F.concat(start, F.lit("\n"), body)).otherwise(start)


def _no_metadata() -> Column:
    return F.lit(None).cast("variant")


def map_docstring_assert(
    df: DataFrame, id_col: str = "task_id", prompt_col: str = "prompt"
) -> DataFrame:
    """Instruction and first assertion out of a docstring prompt.

    Rejects rows with no docstring or no ``assert`` inside it.
    """
    quotes = '"""'
    first = index_of(prompt_col, quotes)
    inner = slice_text(prompt_col, first + 3, rindex_of(prompt_col, quotes))
    staged = df.withColumn("_inner", F.when(first >= 0, inner)).withColumn(
        "_at", index_of("_inner", "assert")
    )
    head = strip_py(slice_text("_inner", F.lit(0), F.col("_at")))
    sentence = F.when(F.endswith(F.col("_head"), F.lit(".")), F.col("_head")).otherwise(
        F.concat("_head", F.lit("."))
    )
    assertion = strip_py(F.substr("_inner", F.col("_at") + 1))
    usable = F.coalesce(F.col("_at") >= 0, F.lit(False))
    instruction = _fenced(F.concat(sentence, F.lit(ASSERTION_SENTENCE + "\n")), assertion)
    return (
        staged.withColumn("_head", head)
        .withColumn("id", id_as_string(id_col))
        .withColumn("instruction", F.when(usable, instruction))
        .withColumn("response_prefix", F.when(usable, F.lit(PY_FENCE)))
        .withColumn("metadata", _no_metadata())
        .withColumn(
            REASON,
            reason_when(
                (F.col("_inner").isNull(), "no docstring"),
                (~usable, "no assert in the docstring"),
            ),
        )
        .drop("_inner", "_at", "_head")
    )


def map_function_prompt(
    df: DataFrame, id_col: str = "task_id", prompt_col: str = "prompt"
) -> DataFrame:
    """The stripped prompt as the instruction and as the start of the answer."""
    body = strip_py(prompt_col)
    return (
        df.withColumn("instruction", _fenced(F.lit(FUNCTION_SENTENCE), body))
        .withColumn("response_prefix", F.concat(F.lit(PY_FENCE + "\n"), body))
        .withColumn("id", id_as_string(id_col))
        .withColumn("metadata", _no_metadata())
    )


# The column each mode of the two-mode benchmark reads.
MODES = {"complete": "complete_prompt", "instruct": "instruct_prompt"}


def map_two_mode(df: DataFrame, mode: str, id_col: str = "task_id") -> DataFrame:
    """The prompt of the chosen mode, unstripped inside the fence."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    prompt = F.col(MODES[mode])
    return (
        df.withColumn("instruction", _fenced(F.lit(TWO_MODE_SENTENCE), prompt))
        .withColumn("response_prefix", _prefix_for(prompt))
        .withColumn("id", id_as_string(id_col))
        .withColumn("metadata", _no_metadata())
    )


def map_ds_fewshot(
    df: DataFrame,
    shots: FewShots | None,
    id_col: str = "task_id",
    prompt_col: str = "prompt",
    metadata_col: str = "metadata",
) -> DataFrame:
    """Fixed sentence, few-shot block and the fenced prompt; a missing id or
    prompt reads as empty text and missing metadata as an empty object."""
    present = set(df.columns)
    prompt = F.coalesce(F.col(prompt_col), F.lit("")) if prompt_col in present else F.lit("")
    ident = F.coalesce(id_as_string(id_col), F.lit("")) if id_col in present else F.lit("")
    lead = F.concat(F.lit(DATA_SCIENCE_SENTENCE + "\n"), fewshot_prefix_block(shots))
    out = (
        df.withColumn("instruction", _fenced(lead, prompt))
        .withColumn("response_prefix", _prefix_for(prompt))
        .withColumn("id", ident)
    )
    empty = F.parse_json(F.lit("{}"))
    if metadata_col not in present:
        return out.withColumn("metadata", empty)
    if df.schema[metadata_col].dataType.typeName() == "variant":
        return out.withColumn("metadata", F.coalesce(F.col(metadata_col), empty))
    return out.withColumn("metadata", F.col(metadata_col))


def mapper_for(dataset: str, mode: str = "complete", shots: FewShots | None = None) -> Callable:
    """The row mapper of a text-to-code benchmark; an unknown name raises."""
    mappers = {
        "humaneval": map_function_prompt,
        "mbpp": map_docstring_assert,
        "bigcodebench": lambda df: map_two_mode(df, mode),
        "ds1000": lambda df: map_ds_fewshot(df, shots),
    }
    if dataset not in mappers:
        raise ValueError(f"unknown dataset: {dataset}")
    return mappers[dataset]
