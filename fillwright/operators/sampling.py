"""Exact-size seeded samples, nested subsets, splits and corpus mixing.

A subset is a prefix of the seeded permutation. Deciding who is in a prefix
needs the hash at its end, not a rank for every row: buckets are counted, only
the bucket that holds the end is ranked, and the rows are then picked by one
comparison while they are scanned. The table itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwright.operators.ordering import (
    BUCKET_DIGITS,
    bucket_table,
    exact_rank,
    seeded_shuffle,
    shuffle_hash,
)

# Ratios and seed of the published subsets, eval share of a split.
RATIOS = (0.2, 0.4, 0.6, 0.8, 1.0)
SEED = 42
EVAL_SIZE = 0.05


def percent_of(ratio: float) -> int:
    """Whole percent of a ratio, truncated: 0.29 gives 28."""
    return int(ratio * 100)


def _as_list(keys: Sequence[str] | str) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _place(keys: Sequence[str], seed: int) -> Column:
    return F.struct(shuffle_hash(seed, *keys).alias("hash"), *[F.col(k) for k in keys])


def _prefix_ends(df: DataFrame, keys: list[str], seed: int, sizes: dict[str, Column]) -> Column:
    """Scalar map from a prefix name to the place of its last row.

    ``sizes`` gives prefix lengths in terms of ``_n``, the number of rows.
    An empty prefix has no entry.
    """
    buckets = bucket_table(df, keys, seed)
    total = Window.partitionBy()
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), size.cast("bigint").alias("size")) for name, size in sizes.items()]
    )
    # one row per prefix: the bucket its end falls into and how far inside
    ends = (
        buckets.withColumn("_n", F.sum("_count").over(total))
        .withColumn("_want", F.explode(wanted))
        .filter(F.col("_want.size") > F.col("_before"))
        .filter(F.col("_want.size") <= F.col("_before") + F.col("_count"))
        .select("_bucket", "_want.name", (F.col("_want.size") - F.col("_before")).alias("_need"))
    )
    near = df.select(*keys).withColumn("_place", _place(keys, seed))
    near = near.withColumn("_bucket", F.substring("_place.hash", 1, BUCKET_DIGITS))
    # copies of a key are counted before they meet, so they are one row each
    places = (
        near.join(F.broadcast(ends), "_bucket")
        .groupBy("name", "_need", "_place")
        .agg(F.count("*").alias("_copies"))
    )
    ahead = Window.partitionBy("name").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    up_to = F.col("_ahead") + F.col("_copies")
    last_rows = places.withColumn(
        "_ahead", F.coalesce(F.sum("_copies").over(ahead), F.lit(0))
    ).filter((F.col("_ahead") < F.col("_need")) & (F.col("_need") <= up_to))
    # a cut between copies can not be told by comparing places
    message = F.lit("keys repeat at the cut of a subset; pass unique=False")
    place = F.when(F.col("_need") == up_to, F.col("_place")).otherwise(F.raise_error(message))
    entries = F.collect_list(F.struct(F.col("name"), place))
    return last_rows.agg(F.map_from_entries(entries)).scalar()


def _with_members(
    df: DataFrame, keys: list[str], seed: int, sizes: dict[str, Column], unique: bool
) -> DataFrame:
    """Add ``_in``, a struct that tells for each prefix whether the row is in it."""
    if unique:
        ends = _prefix_ends(df, keys, seed, sizes)
        placed = df.withColumn("_place", _place(keys, seed)).withColumn("_ends", ends)
        tests = {
            name: F.coalesce(F.col("_place") <= F.try_element_at("_ends", F.lit(name)), F.lit(False))
            for name in sizes
        }
    else:
        ranked = exact_rank(df, keys, seed, "_place", unique=False)
        placed = ranked.withColumn("_n", ranked.agg(F.count("*")).scalar())
        tests = {name: F.col("_place") <= size for name, size in sizes.items()}
    members = F.struct(*[test.alias(name) for name, test in tests.items()])
    return placed.withColumn("_in", members).select(*[f"`{c}`" for c in df.columns], "_in")


def sample_ratio(
    df: DataFrame,
    keys: Sequence[str] | str,
    ratio: float,
    seed: int = SEED,
    unique: bool = True,
) -> DataFrame:
    """The first ``int(n * ratio)`` rows of the permutation, exactly that many.

    ``unique=False`` allows keys that repeat, at the cost of ranking all rows.
    """
    sizes = {"sample": F.floor(F.col("_n") * F.lit(float(ratio)))}
    marked = _with_members(df, _as_list(keys), seed, sizes, unique)
    return marked.filter(F.col("_in.sample")).drop("_in")


def nested_subsets(
    df: DataFrame,
    keys: Sequence[str] | str,
    ratios: Sequence[float] = RATIOS,
    seed: int = SEED,
    unique: bool = True,
) -> DataFrame:
    """Every row once per subset it belongs to, tagged with ``pct``.

    All ratios share one permutation, so a smaller subset lies inside a larger.
    """
    if len({percent_of(r) for r in ratios}) < len(ratios):
        raise ValueError("two ratios have the same whole percent, which names a subset")
    names = {f"r{i}": float(r) for i, r in enumerate(ratios)}
    sizes = {name: F.floor(F.col("_n") * F.lit(r)) for name, r in names.items()}
    tags = [F.when(F.col("_in")[name], F.lit(percent_of(r))) for name, r in names.items()]
    marked = _with_members(df, _as_list(keys), seed, sizes, unique)
    return marked.withColumn("pct", F.explode(F.array_compact(F.array(*tags)))).drop("_in")


def subset_rings(
    df: DataFrame,
    keys: Sequence[str] | str,
    ratios: Sequence[float] = RATIOS,
    seed: int = SEED,
    unique: bool = True,
) -> DataFrame:
    """Every row of the largest subset once, with ``ring``: the whole percent of the
    smallest subset it is in. A subset is the union of the rings up to its own."""
    if len({percent_of(r) for r in ratios}) < len(ratios):
        raise ValueError("two ratios have the same whole percent, which names a subset")
    ordered = sorted(float(r) for r in ratios)
    names = {f"r{i}": r for i, r in enumerate(ordered)}
    sizes = {name: F.floor(F.col("_n") * F.lit(r)) for name, r in names.items()}
    marked = _with_members(df, _as_list(keys), seed, sizes, unique)
    tags = [F.when(F.col("_in")[name], F.lit(percent_of(r))) for name, r in names.items()]
    ringed = marked.withColumn("ring", F.coalesce(*tags)).drop("_in")
    return ringed.where(F.col("ring").isNotNull())


def train_eval_split(
    df: DataFrame,
    keys: Sequence[str] | str,
    eval_size: float = EVAL_SIZE,
    seed: int = SEED,
    unique: bool = True,
) -> DataFrame:
    """Tag rows ``eval`` or ``train``; a size up to 1 is a ratio, above a count."""
    if eval_size <= 1:
        size = F.ceil(F.col("_n") * F.lit(float(eval_size)))
    else:
        size = F.least(F.lit(int(eval_size)), F.col("_n"))
    marked = _with_members(df, _as_list(keys), seed, {"eval": size}, unique)
    side = F.when(F.col("_in.eval"), "eval").otherwise("train")
    return marked.withColumn("split", side).drop("_in")


def mix_merged(
    sources: dict[str, DataFrame],
    key: str,
    seed: int | None = None,
    unique: bool = True,
) -> DataFrame:
    """Several corpora as one table, with ``source`` and ``source_ord``.

    With a seed the merged rows also get ``ord``, one permutation over all; the
    key has to identify a row inside its corpus only.
    """
    merged = _tagged(sources, "source_ord")
    if seed is None:
        return merged
    return seeded_shuffle(merged, ["source_ord", key], seed, "ord", unique)


def mix_sequential(sources: dict[str, DataFrame]) -> DataFrame:
    """Several corpora one after the other: ``stage`` counts them in order, and
    the order of training is (``stage``, order inside the corpus)."""
    return _tagged(sources, "stage")


def _tagged(sources: dict[str, DataFrame], position: str) -> DataFrame:
    merged = None
    for i, (name, df) in enumerate(sources.items()):
        part = df.withColumn("source", F.lit(name)).withColumn(position, F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        raise ValueError("nothing to mix")
    return merged
