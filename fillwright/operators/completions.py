"""Batch completion jobs and what happens to their output."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwright.functions.literals import with_literal_json
from fillwright.functions.text import (
    _col,
    answer_newline,
    extract_code_block,
    strip_py,
)
from fillwright.functions.tokens import Tokenizer, decode, strip_prompt_ids
from fillwright.operators.contracts import REASON, checked, reason_when
from fillwright.operators.models import MAX_NEW_TOKENS, reject_over_context, token_budget
from fillwright.operators.ordering import shuffle_hash
from fillwright.operators.sft import encode_with_padding
from fillwright.session import write_through


def expand_samples(df: DataFrame, n: int) -> DataFrame:
    """Every task ``n`` times, numbered by ``sample_idx``."""
    if n < 1:
        return df.withColumn("sample_idx", F.lit(0)).filter(F.lit(False))
    return df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def complete(
    df: DataFrame,
    make_fn: Callable[[], Callable[..., list[str]]],
    inputs: Sequence[str] = ("prompt",),
    batch_rows: int = 64,
    partitions: int | None = None,
    keep: bool = False,
    on_error: str = "fail",
) -> DataFrame:
    """Add ``completion`` and ``error`` from the caller's batch function.

    ``make_fn`` runs once per task, where a model would be loaded, and returns a
    function from input columns, as lists, to texts. Only the inputs travel to
    Python. An error of the function fails the job. With ``on_error="keep"`` all
    rows of a failing batch are tried once more, one by one, and an error stays
    with the row that caused it; this is for tasks that may go without an answer.
    ``partitions`` spreads rows over tasks first; use it where the input is a few
    files that do not split.

    A plan that uses the result twice runs the function twice, and a model may
    then answer differently. ``keep=True`` runs it now and writes the outcome to
    the shared folder, so that the accepted and the failed rows are of one run.
    """

    if on_error not in ("fail", "keep"):
        raise ValueError(f"on_error is fail or keep, not {on_error}")

    @F.arrow_udf("struct<completion: string, error: string>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fn = make_fn()

        def call(columns):
            texts = list(fn(*columns))
            if len(texts) != len(columns[0]):
                raise ValueError("the completion function changed the number of rows")
            if not all(isinstance(t, str) for t in texts):
                raise TypeError("the completion function returned something other than text")
            return texts

        def one_by_one(columns):
            for row in zip(*columns):
                try:
                    yield call([[v] for v in row])[0], None
                except Exception as e:
                    yield None, f"{type(e).__name__}: {e}"

        for batch in batches:
            # a single column comes bare, several as a tuple
            arrays = batch if isinstance(batch, tuple) else (batch,)
            # texts become Python's one part at a time, and its answers leave with it
            for at in range(0, len(arrays[0]), batch_rows):
                part = [a.slice(at, batch_rows).to_pylist() for a in arrays]
                try:
                    out = [(text, None) for text in call(part)]
                except Exception:
                    if on_error == "fail":
                        raise
                    out = list(one_by_one(part))
                texts = pa.array([text for text, _ in out], pa.string())
                errors = pa.array([error for _, error in out], pa.string())
                yield pa.StructArray.from_arrays([texts, errors], ["completion", "error"])

    # marked so that a filter on the outcome does not run the function again
    job = run.asNondeterministic()
    source = df.repartition(partitions) if partitions else df
    done = source.withColumn("_out", job(*[F.col(c) for c in inputs]))
    done = done.select(*df.columns, "_out.completion", "_out.error")
    return write_through(done) if keep else done


_MANIFEST = "path string, n long"


def stored_answers(spark: SparkSession, folder: str) -> DataFrame | None:
    """All committed answers below ``folder``; None where there are none yet.

    A folder of answers counts once the manifest names it, so what a dying run
    left behind is not read.
    """
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{folder}/manifest", mode="FAILFAST").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    paths = [f"{folder}/{row.path}" for row in rows]  # one a finished part
    return spark.read.parquet(*paths) if paths else None


def complete_resumable(
    df: DataFrame,
    make_fn: Callable[[], Callable[..., list[str]]],
    folder: str,
    keys: Sequence[str] = ("task_id", "sample_idx"),
    parts: int = 16,
    **options,
) -> DataFrame:
    """``complete`` that keeps what is finished when the job dies, and goes on from there.

    Rows are dealt to ``parts`` by a hash of their ``keys``, which identify a row
    and may not be null. Each part is a job of its own over the whole cluster; its
    answers are written below ``folder`` and then named in a manifest, in this
    order, so a part is either whole or open. A run asks for the rows without a
    stored answer only, also for tasks that were added since, and does nothing if
    there are none. Rows whose ``error`` was kept have an answer, the error.

    ``df`` is read once for each open part: give a table, not an expensive plan.
    Returns the stored answers of all runs.
    """
    spark = df.sparkSession
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    place = F.conv(F.substring(shuffle_hash(0, *keys), 1, 7), 16, 10).cast("int") % parts
    todo = df.withColumn("_part", checked(place, present, "a key of a task is null"))
    stored = stored_answers(spark, folder)
    if stored is not None:
        todo = todo.join(stored.select(*keys), list(keys), "left_anti")
    # at most one row a part
    counts = {r["_part"]: r["n"] for r in todo.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    for part in sorted(counts):
        name = f"answers-{part}-{uuid.uuid4().hex}"
        open_rows = todo.where(F.col("_part") == part).select(*[f"`{c}`" for c in df.columns])
        complete(open_rows, make_fn, **options).write.parquet(f"{folder}/{name}")
        entry = spark.createDataFrame([(name, counts[part])], _MANIFEST).coalesce(1)
        entry.write.mode("append").json(f"{folder}/manifest")
    answers = stored_answers(spark, folder)
    if answers is None:
        return complete(df.limit(0), make_fn, **{**options, "keep": False})
    return answers


# Rows that are put into batches by one task, about.
GROUP_ROWS = 1 << 16


def batch_widths(max_tokens: int, growth: float = 1.25, least: int = 16) -> list[int]:
    """Upper ends of the length classes, each a quarter wider than the one before."""
    widths = [min(least, max_tokens)]
    while widths[-1] < max_tokens:
        widths.append(min(max_tokens, math.ceil(widths[-1] * growth)))
    return widths


def budget_batches(
    df: DataFrame,
    length: Column,
    keys: Sequence[str] | str,
    max_tokens: int,
    max_rows: int = 64,
    growth: float = 1.25,
) -> DataFrame:
    """Add ``batch_id`` and ``width``: batches of rows alike in ``length``, of at most
    ``max_tokens`` tokens when padded to ``width``, the longest of the batch.

    A row belongs to a length class, and the class tells how many of its rows fit.
    A class of many rows is dealt to several tasks by a hash of ``keys``, each with
    one batch at most that is not full. A row beyond ``max_tokens`` is a batch of
    its own. Rows stay next to those of their batch.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    sized = df.withColumn("_length", length.cast("bigint"))
    wider = F.filter(F.array(*map(F.lit, batch_widths(max_tokens, growth))), lambda w: w >= F.col("_length"))
    sized = sized.withColumn("_class", F.coalesce(F.get(wider, F.lit(0)), F.col("_length")))
    # one row a class: those up to the limit, and as many beyond as there are such lengths
    counts = sized.groupBy("_class").agg(F.count("*").alias("_count"))
    deals = counts.select("_class", F.expr(f"(_count + {GROUP_ROWS - 1}) div {GROUP_ROWS}").alias("_deals"))
    dealt = sized.join(deals, "_class").withColumn("_deal", F.pmod(F.xxhash64(*keys), "_deals"))
    fit = F.greatest(F.lit(1), F.least(F.lit(max_rows), F.expr(f"{int(max_tokens)} div _class")))
    place = F.row_number().over(Window.partitionBy("_class", "_deal").orderBy(*keys)) - 1
    placed = dealt.withColumn("_fit", fit).withColumn("_place", place).withColumn("_nth", F.expr("_place div _fit"))
    number = F.shiftleft("_class", 40) + F.shiftleft("_deal", 20) + F.col("_nth")
    among = Window.partitionBy("_class", "_deal", "_nth")
    wide = placed.withColumn("width", F.max("_length").over(among).cast("int"))
    own = ["_length", "_class", "_deals", "_deal", "_fit", "_place", "_nth"]
    return wide.withColumn("batch_id", number).drop(*own)


def padding_share(batches: DataFrame, length: Column) -> DataFrame:
    """Rows, batches, tokens after padding, and the share of them that is padding."""
    tokens = F.sum(F.col("width").cast("bigint"))
    return batches.agg(
        F.count("*").alias("n"),
        F.countDistinct("batch_id").alias("batches"),
        tokens.alias("tokens"),
        (1 - F.try_divide(F.sum(length.cast("bigint")), tokens)).alias("padding"),
    )


def complete_tokens(
    df: DataFrame,
    prompt: str,
    tokenizer: Tokenizer,
    make_fn: Callable[[], Callable[[list[list[int]], list[int]], list[list[int]]]],
    context: str = "max_context_size",
    max_new_tokens: int = MAX_NEW_TOKENS,
) -> DataFrame:
    """Add ``completion`` from a function over token ids; takes ``batch_id``.

    Prompts are encoded with a begin id and padded on the left to the longest
    of their batch. A batch that fills the context is rejected, all others may
    generate as many tokens as context and limits leave. The function gets the
    rows of one whole batch and the new tokens each may have, and returns input
    and new ids; the input is cut off and the rest decoded without special ids.
    An error of the function fails the job. The rows of a batch have to be next
    to each other, as ``chunk`` with padding and ``budget_batches`` leave them.
    """
    padded = encode_with_padding(df, prompt, tokenizer, "left", add_bos=True, ids_col="_ids")
    judged = reject_over_context(padded, "width", context)
    budget = token_budget("width", context, max_new_tokens).cast("int")

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fn = make_fn()

        def answers(rows: list, limits: list, groups: list) -> pa.Array:
            out: list[list[int] | None] = [None] * len(rows)
            at = 0
            while at < len(rows):
                end = at + 1
                while end < len(rows) and groups[end] == groups[at]:
                    end += 1
                if rows[at] is not None:
                    made = fn(rows[at:end], limits[at:end])
                    if len(made) != end - at:
                        raise ValueError("the completion function changed the number of rows")
                    out[at:end] = made
                at = end
            return pa.array(out, pa.list_(pa.int32()))

        # the last batch of what came together may go on in what comes next
        held: list[list] = [[], [], []]
        for arrays in batches:
            held = [h + a.to_pylist() for h, a in zip(held, arrays)]
            groups = held[2]
            whole = len(groups)
            while whole and groups[whole - 1] == groups[-1]:
                whole -= 1
            if whole:
                yield answers(*[h[:whole] for h in held])
                held = [h[whole:] for h in held]
        yield answers(*held)

    # rejected batches reach the function as nulls, which it is not called for
    taken = F.when(F.col(REASON).isNull(), F.col("_ids"))
    output = run.asNondeterministic()(taken, budget, F.col("batch_id"))
    done = judged.withColumn("_out", output)
    text = decode(strip_prompt_ids("_out", "width"), tokenizer)
    return done.withColumn("completion", text).drop("_ids", "_out", "width")


def drop_failed_rows(df: DataFrame) -> DataFrame:
    """The rows whose completion worked; the others are in :func:`failed_rows`."""
    return df.filter(F.col("error").isNull()).drop("error")


def failed_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error").isNotNull()).withColumnRenamed("error", REASON)


def lookup_completions(
    tasks: DataFrame, completions: DataFrame, keys: Sequence[str] = ("task_id", "sample_idx")
) -> DataFrame:
    """Completions made earlier, by task and sample; null where there is none."""
    return tasks.join(completions.select(*keys, "completion"), list(keys), "left")


def strip_prompt_text(decoded: Column | str, prompt: Column | str) -> Column:
    """The decoded text after as many characters as the prompt has."""
    return F.substr(_col(decoded), F.char_length(_col(prompt)) + 1)


def strip_completion(completion: Column | str, model: Column | str) -> Column:
    """Strip the completions of the short-named model ``qwen`` and no others."""
    text = _col(completion)
    return F.when(F.lower(_col(model)) == "qwen", strip_py(text)).otherwise(text)


def code_solutions(df: DataFrame) -> DataFrame:
    """Keep the code of every completion, under the name ``code``."""
    return df.withColumn("code", extract_code_block("completion"))


def code_answers(df: DataFrame) -> DataFrame:
    """Data-science answers: the completion and a line end, as ``code``."""
    return df.withColumn("code", answer_newline("completion"))


def parse_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Python-literal text into a VARIANT; text that is no literal is rejected.

    Common literals are translated by expressions. What these leave open passes
    through ``ast.literal_eval`` in Arrow batches; no other text goes to Python.
    """

    @F.arrow_udf("string")
    def to_json(texts: pa.Array) -> pa.Array:
        import ast
        import json

        def convert(text):
            try:
                return json.dumps(ast.literal_eval(text), allow_nan=False)
            except Exception:
                return None

        return pa.array([convert(t) for t in texts.to_pylist()], pa.string())

    # keys that are one text in JSON, as 1 and '1', also make a literal unusable
    known = with_literal_json(df, column, "_json").withColumn("_known", F.try_parse_json("_json"))
    left = F.when(F.col("_known").isNull(), F.col(column))
    return (
        known.withColumn("_left", to_json(left))
        .withColumn(column, F.coalesce("_known", F.try_parse_json("_left")))
        .withColumn(REASON, reason_when((F.col(column).isNull(), "metadata is no literal")))
        .drop("_json", "_known", "_left")
    )
