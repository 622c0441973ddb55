"""JSON-lines outputs. Each name is a folder that Spark fills in parallel; null
fields keep their key.

Lines come in no order unless one is asked for: then every range of positions is
one file, sorted inside, under a name that sorts as the positions do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from fillwright.operators.contracts import checked, parallel, within_bound
from fillwright.operators.sampling import (
    RATIOS,
    SEED,
    nested_subsets,
    percent_of,
    sample_ratio,
    subset_rings,
)
from fillwright.operators.sft import MAX_TRAINING_SEQ_LENGTH


# Positions of a file written in order.
RANGE_POSITIONS = 100_000
_DIGITS = 18


def _write(df: DataFrame, path: str, columns: Sequence[str] = ("*",), order: Sequence[str] = ()) -> str:
    if order:
        return _write_in_order(df, path, columns, order)
    df.select(*columns).write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def _write_in_order(
    df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], positions: int | None = None
) -> str:
    """One file per range of ``order[0]``, a 0-based position, sorted by all of ``order``.

    The ranges are fixed by the position, so the rows, which may come from a
    model, are computed once and no sample of them is needed. The rows of a
    range meet in one task: as many as it has positions, times their samples.
    """
    size = positions or RANGE_POSITIONS
    position = F.col(order[0]).cast("bigint")
    placed = checked(position, position >= 0, f"{order[0]} is no position of a row")
    first = F.expr(f"_position div {size} * {size}")
    name = F.concat_ws("-", *[F.lpad(v.cast("string"), _DIGITS, "0") for v in (first, first + (size - 1))])
    by = [F.col(c) for c in order]
    ranged = df.withColumn("_position", placed).withColumn("range", name).repartition("range")
    lines = ranged.sortWithinPartitions("range", *by).select("range", *columns)
    lines.write.mode("overwrite").partitionBy("range").json(path, ignoreNullFields=False)
    check_ranges(df.sparkSession, path)
    return path


def check_ranges(spark: SparkSession, path: str) -> int:
    """The files of a folder written in order hold one range each and no two overlap.

    Looks at names only; returns the number of files, and raises where reading
    them by name would not give the lines in order.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(path)
    if "range" not in files.columns:
        return 0
    ends = F.split(F.col("range").cast("string"), "-")
    ranges = files.select("path", ends[0].cast("bigint").alias("first"), ends[1].cast("bigint").alias("last"))
    last_before = F.lag("last").over(Window.orderBy("path"))
    bad = F.col("first").isNull() | (F.col("first") <= last_before)
    found = ranges.select(bad.alias("bad")).agg(F.count("*").alias("n"), F.max("bad").alias("bad")).first()
    if found.bad:
        raise ValueError(f"files of {path} overlap in their ranges")
    return found.n


def output_name(model: str, dataset: str, instruct: bool = False) -> str:
    stem = f"{model}_{dataset.replace('.csv', '')}"
    return f"{stem}_instruct.jsonl" if instruct else f"{stem}.jsonl"


def write_completions(
    df: DataFrame, folder: str, model: str, dataset: str, order: Sequence[str] = ()
) -> str:
    """``task_id`` and ``completion``; with ``order``, as (``ord``, ``sample_idx``),
    the lines stand in that order, which scoring by position needs."""
    return _write(df, f"{folder}/{output_name(model, dataset)}", ("task_id", "completion"), order)


def write_answers(
    df: DataFrame, folder: str, model: str, dataset: str, order: Sequence[str] = ()
) -> str:
    """``code`` and ``metadata`` of data-science answers."""
    name = output_name(model, dataset, instruct=True)
    return _write(df, f"{folder}/{name}", ("code", "metadata"), order)


def write_solutions(df: DataFrame, path: str, dataset: str, order: Sequence[str] = ()) -> str:
    """``code`` and ``metadata`` for data-science tasks, else the id and ``code``."""
    if dataset == "ds1000":
        return _write(df, path, ("code", "metadata"), order)
    return _write(df, path, (F.col("id").alias("task_id"), "code"), order)


def write_subset(
    df: DataFrame,
    prefix: str,
    keys: Sequence[str] | str,
    ratio: float,
    seed: int = SEED,
    unique: bool = True,
) -> str:
    """The sample of one ratio, named by its whole percent: a filtered scan,
    without a shuffle of the rows."""
    sample = sample_ratio(df, keys, ratio, seed, unique)
    return _write(sample, f"{prefix}_{percent_of(ratio)}pct.jsonl")


def write_subsets(
    df: DataFrame,
    folder: str,
    keys: Sequence[str] | str,
    ratios: Sequence[float] = RATIOS,
    seed: int = SEED,
    unique: bool = True,
) -> str:
    """All nested subsets from one scan, a ``pct=...`` folder for each."""
    tagged = nested_subsets(df, keys, ratios, seed, unique)
    tagged.write.mode("overwrite").partitionBy("pct").json(folder, ignoreNullFields=False)
    return folder


def write_rings(
    df: DataFrame,
    folder: str,
    keys: Sequence[str] | str,
    ratios: Sequence[float] = RATIOS,
    seed: int = SEED,
    unique: bool = True,
) -> str:
    """All nested subsets with each row stored once, a ``ring=...`` folder for what
    a subset adds to the next smaller one; ``read_subset`` puts them together."""
    rings = subset_rings(df, keys, ratios, seed, unique)
    rings.write.mode("overwrite").partitionBy("ring").json(folder, ignoreNullFields=False)
    return folder


def write_batches(
    batches: DataFrame,
    path: str,
    max_length: int = MAX_TRAINING_SEQ_LENGTH,
    pad_to_max_length: bool = False,
) -> dict[str, int]:
    """Padded batches as parquet, with a report from the same pass.

    Gives ``total`` and ``truncated`` rows. Rows whose ids and labels differ in
    length, or that break the padding bound, are counted as well while they are
    written, and fail the job afterwards; the folder is then not to be used.
    """
    report = Observation()

    def count(bad: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("bigint")), F.lit(0)).alias(name)

    seen = batches.observe(
        report,
        F.count("*").alias("total"),
        count(F.col("exceeding_length"), "truncated"),
        count(~parallel("input_ids", "labels"), "uneven"),
        count(~within_bound("input_ids", max_length, pad_to_max_length), "unbound"),
    )
    seen.write.mode("overwrite").parquet(path)
    found = report.get
    if found["uneven"] or found["unbound"]:
        raise ValueError(
            f"{path}: {found['uneven']} rows with other labels than ids, "
            f"{found['unbound']} beyond the padding bound {max_length}"
        )
    return {name: found[name] for name in ("total", "truncated")}
