"""Readers for task files, predictions and training pairs.

A line that is no JSON fails the job rather than reading as nulls. CSV files are
split also where cells hold line breaks; gz files do not split, so one file is
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwright.operators.contracts import checked
from fillwright.operators.ordering import dedupe_last, with_file_ordinal
from fillwright.sources.csv_ranges import DIALECT, csv_records, parsed

INFILL_SCHEMA = "task_id string, prompt string, suffix string"
PREDICTION_SCHEMA = "task_id string, completion string"
PAIR_SCHEMA = "problem string, solution string"


def _read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def _read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    optional: Sequence[str] = (),
    with_ordinal: bool = False,
) -> DataFrame:
    # columns are found by header name, every value stays text; whole records are
    # parsed, so that one with too few or too many cells fails the job
    names = spark.read.csv(path, header=True, inferSchema=False, **DIALECT).columns
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    rows = csv_records(spark, path, names).select("ord", parsed("record", names).alias("_row"))
    chosen = [F.col("_row")[c].alias(c) for c in (*optional, *columns) if c in names]
    return rows.select(*chosen, *(["ord"] if with_ordinal else []))


def read_infill_csv(spark: SparkSession, path: str, with_ordinal: bool = False) -> DataFrame:
    """``task_id`` and ``eval_prompt`` of an infill task file; ``ord`` is the place
    of a task in the file, on request, here and in the two readers below."""
    return _read_csv(spark, path, ["task_id", "eval_prompt"], with_ordinal=with_ordinal)


def read_ground_truth(spark: SparkSession, path: str, with_ordinal: bool = False) -> DataFrame:
    """``ground_truth`` of a task file, with ``task_id`` where it has one."""
    return _read_csv(spark, path, ["ground_truth"], ["task_id"], with_ordinal)


def read_ds_csv(spark: SparkSession, path: str, with_ordinal: bool = False) -> DataFrame:
    """``prompt`` and ``metadata`` of a data-science task file."""
    return _read_csv(spark, path, ["prompt", "metadata"], with_ordinal=with_ordinal)


def read_infill_jsonl(spark: SparkSession, path: str, name: str = "hei") -> DataFrame:
    """Infill tasks from (gz) JSONL; the last line of a repeated id wins and
    keeps the place of the first."""
    if name.lower() != "hei":
        raise ValueError(f"unknown infill dataset: {name}")
    scan = _read_jsonl(spark, path, INFILL_SCHEMA)
    return dedupe_last(with_file_ordinal(scan))


def read_fewshots(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of examples, with their place in it as ``ord``.

    A file that is no such array, or an example without one of its two texts,
    fails the job: a prompt must not lose its examples unseen.
    """
    # an aggregate, so that an empty file is a row to be checked as well
    scan = spark.read.text(path, wholetext=True).agg(F.first("value").alias("value"))
    examples = F.from_json(
        "value", "array<struct<problem: string, solution: string>>", {"mode": "FAILFAST"}
    )
    whole = F.forall(examples, lambda e: e["problem"].isNotNull() & e["solution"].isNotNull())
    known = checked(examples, F.coalesce(whole, F.lit(False)), f"{path} is no list of examples")
    return scan.select(F.posexplode(known).alias("ord", "e")).select(
        "e.problem", "e.solution", "ord"
    )


def inline_fewshots(spark: SparkSession, examples: Sequence[tuple[str, str]]) -> DataFrame:
    """Examples given in code, in order."""
    rows = [(p, s, i) for i, (p, s) in enumerate(examples)]
    return spark.createDataFrame(rows, f"{PAIR_SCHEMA}, ord int")


def read_predictions(spark: SparkSession, path: str, with_ordinal: bool = False) -> DataFrame:
    """JSONL completions; with line numbers for pairing by position."""
    # a folder written in order has the range of its files as one more column
    scan = _read_jsonl(spark, path, PREDICTION_SCHEMA).select("task_id", "completion")
    return with_file_ordinal(scan) if with_ordinal else scan


def read_sft_jsonl(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Training pairs of several corpora as one table; ``source_ord`` is the
    place of the corpus in the list. A path may be a folder of many files."""
    if not paths:
        raise ValueError("no data files")
    parts = [
        _read_jsonl(spark, p, PAIR_SCHEMA).withColumn("source_ord", F.lit(i))
        for i, p in enumerate(paths)
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def read_subset(spark: SparkSession, folder: str, pct: int, schema: str) -> DataFrame:
    """The subset of a whole percent from a folder of rings; other rings are not opened."""
    rings = spark.read.schema(f"{schema}, ring int").json(folder, mode="FAILFAST")
    return rings.where(F.col("ring") <= pct).drop("ring")


def _read_table(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    plain = path.rstrip("/").removesuffix(".gz")
    if not plain.endswith((".jsonl", ".json")):
        return spark.read.parquet(path)
    # without a schema the whole file is read once more to infer one
    return _read_jsonl(spark, path, schema) if schema else spark.read.json(path, mode="FAILFAST")


def read_table_split(
    spark: SparkSession,
    splits: dict[str, str],
    split: str | None = None,
    schema: str | None = None,
) -> DataFrame:
    """One split of a table kept as ``{split: path}``; the first when not named."""
    name = next(iter(splits)) if split is None else split
    if name not in splits:
        raise ValueError(f"unknown split: {name}")
    return _read_table(spark, splits[name], schema)


def read_problem_map(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The values of a task map kept as a table, one row per task."""
    return _read_table(spark, path, schema)


def open_benchmark(spark: SparkSession, name: str, path: str | None = None) -> tuple[str, DataFrame]:
    """Kind and table of a benchmark named on a command line.

    ``hei`` needs the path of its file; a name that ends in ``.csv`` is a path,
    of data-science tasks when it says ``ds-1000`` and else of infill tasks.
    """
    low = name.lower()
    if low == "hei":
        if path is None:
            raise ValueError("hei needs the path of its task file")
        return "hei", read_infill_jsonl(spark, path, name)
    if low.endswith(".csv"):
        if "ds-1000" in low:
            return "ds1000", read_ds_csv(spark, path or name)
        return "safim", read_infill_csv(spark, path or name)
    raise ValueError(f"unknown dataset: {name}")


# Text-to-code benchmarks and the split each is read from
# (None: the first split, "": a task map without splits).
TEXT2CODE_SPLITS = {"humaneval": "", "mbpp": "", "bigcodebench": None, "ds1000": "test"}


def open_text2code(
    spark: SparkSession, dataset: str, source: str | dict[str, str]
) -> DataFrame:
    """Raw problems of a text-to-code benchmark, from its path or its splits."""
    if dataset not in TEXT2CODE_SPLITS:
        raise ValueError(f"unknown dataset: {dataset}")
    split = TEXT2CODE_SPLITS[dataset]
    if split == "":
        return read_problem_map(spark, source)
    splits = {split or "first": source} if isinstance(source, str) else source
    return read_table_split(spark, splits, split)
