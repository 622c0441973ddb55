"""Positions and ranks without a single-task sort.

A DataFrame has no row order, so every operator that needs one states it: the
position in a file, the order of a key, or a seeded hash of a key. None of them
sorts the table in one task: rows are counted per bucket, the running sum runs
over that small table, and rows are numbered inside their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwright.operators.contracts import checked
from fillwright.session import write_through

# Hash buckets: 16 ** 5, about a million at most, so the table of bucket offsets
# is bounded whatever the number of rows (some 40 MB), and a trillion rows still
# leave only a million to a bucket. Rows spread evenly because keys are unique.
BUCKET_DIGITS = 5

# Largest offset table that is broadcast, about 150 MB with long file names;
# beyond it Spark chooses the join.
BROADCAST_ROWS = 1 << 20


def shuffle_hash(seed: int, *keys: str) -> Column:
    """The sort value of the seeded permutation: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _running_total(table: DataFrame, order: Sequence[str], count: str) -> DataFrame:
    """Add ``_before``, the rows ahead of each entry of a small count table."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumn("_before", F.coalesce(F.sum(count).over(before), F.lit(0)))


def bucket_table(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Rows per hash bucket and the rows ahead of it; reads the keys only.

    The rows are read again when they are numbered, so a plan that may give
    others then, as a completion job may, has to be stored first.
    """
    if not df._jdf.queryExecution().analyzed().deterministic():
        raise ValueError("ranks need the same rows twice: store the result of this plan first")
    bucket = F.substring(shuffle_hash(seed, *keys), 1, BUCKET_DIGITS)
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_count"))
    return _running_total(counts, ["_bucket"], "_count")


def exact_rank(
    df: DataFrame,
    keys: Sequence[str] | str,
    seed: int = 42,
    rank_col: str = "rank",
    unique: bool = True,
) -> DataFrame:
    """1-based position of every row in the seeded permutation.

    Where ``keys`` identify a row, this costs one shuffle of the rows, by hash
    bucket, and a broadcast of at most a million offsets; a key that repeats
    fails the job. With ``unique=False`` keys may repeat in any number of rows:
    the rows are then written and sorted by range of the hash and the input
    position, which cuts a repeated key into many partitions and keeps the
    texts of the keys out of the sort.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    hashed = df.withColumn("_hash", shuffle_hash(seed, *keys))
    if not unique:
        numbered = with_key_ordinal(hashed, "_hash", "_ord", unique=False)
        return numbered.withColumn(rank_col, F.col("_ord") + 1).drop("_hash", "_ord")
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    inside = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    # the keys, as different keys may read alike when they are joined to be hashed
    key = F.struct(*[F.col(k) for k in keys])
    repeated = F.lag(key).over(inside).eqNullSafe(key)
    place = checked(F.row_number().over(inside), ~repeated, "a key repeats: rank with unique=False")
    numbered = hashed.withColumn("_inside", place)
    offsets = bucket_table(df, keys, seed).select("_bucket", "_before")
    return (
        numbered.join(F.broadcast(offsets), "_bucket")
        .withColumn(rank_col, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_hash", "_inside", "_before")
    )


def seeded_shuffle(
    df: DataFrame,
    keys: Sequence[str] | str,
    seed: int = 42,
    ord_col: str = "ord",
    unique: bool = True,
) -> DataFrame:
    """The permutation as a 0-based order column, the same for the same seed."""
    ranked = exact_rank(df, keys, seed, "_rank", unique)
    return ranked.withColumn(ord_col, F.col("_rank") - 1).drop("_rank")


def _number_blocks(
    tagged: DataFrame, blocks: Sequence[str], order: Sequence[str], ord_col: str
) -> DataFrame:
    """0-based dense number: rows ahead of the block plus the place inside it.

    ``tagged`` is a written table with the increasing ``_row`` of every row, so
    both passes see the same values; the count pass reads the block columns only.
    """
    counts = tagged.groupBy(*blocks).agg(
        F.count("*").alias("_count"), F.min("_row").alias("_first")
    )
    counts = write_through(counts)  # read twice: to see how many, and to add up
    offsets = _running_total(counts, order, "_count").drop("_count")
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    joined = tagged.join(offsets, list(blocks))
    position = F.col("_before") + F.col("_row") - F.col("_first")
    return joined.withColumn(ord_col, position.cast("bigint")).drop(
        *blocks, "_row", "_first", "_before"
    )


def _is_direct_scan(df: DataFrame) -> bool:
    """Nothing but columns chosen from one file scan: no row is missing."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() in ("LogicalRelation", "Relation")


def with_file_ordinal(scan: DataFrame, ord_col: str = "ord") -> DataFrame:
    """0-based line number over the files of a direct file scan, in path order.

    Parquet rows carry their place in the file, so only the rows of each file
    are counted. In other formats the scan is read twice: rows are counted for
    each block a file is split into, and a row's number is its place in the block
    and the rows ahead. Both passes split files alike, as one query has one set
    of settings; a row beyond the count of its block fails the job.
    """
    if not _is_direct_scan(scan):
        raise ValueError("line numbers need a direct file scan: filter after numbering")
    path = F.col("_metadata.file_path").alias("_file")
    known = scan.select("_metadata").schema["_metadata"].dataType.names
    if "row_index" in known:
        counts = scan.select(path).groupBy("_file").agg(F.count("*").alias("_count"))
        offsets = _running_total(counts, ["_file"], "_count").drop("_count")
        # counted in the JVM, the names stay there
        if len(scan._jdf.inputFiles()) <= BROADCAST_ROWS:
            offsets = F.broadcast(offsets)
        placed = scan.select("*", path, F.col("_metadata.row_index").alias("_row"))
        ordinal = (F.col("_before") + F.col("_row")).cast("bigint")
        return placed.join(offsets, "_file").withColumn(ord_col, ordinal).drop(
            "_file", "_row", "_before"
        )
    start = F.col("_metadata.file_block_start").alias("_start")
    tagged = scan.select("*", path, start, F.monotonically_increasing_id().alias("_row"))
    # a column that is read keeps the count from seeing other rows than the scan gives
    read = F.max(F.col(f"`{scan.columns[0]}`").isNull()).alias("_read")
    counts = tagged.groupBy("_file", "_start").agg(
        F.count("*").alias("_count"), F.min("_row").alias("_first"), read
    )
    offsets = _running_total(counts.where("_read IS NOT NULL"), ["_file", "_start"], "_count")
    if scan.rdd.getNumPartitions() + len(scan._jdf.inputFiles()) <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    inside = F.col("_row") - F.col("_first")
    agreed = (inside >= 0) & (inside < F.col("_count"))
    place = checked(inside, F.coalesce(agreed, F.lit(False)), "a file was split in another way when it was counted")
    joined = tagged.join(offsets, ["_file", "_start"], "left")
    return joined.withColumn(ord_col, (F.col("_before") + place).cast("bigint")).drop(
        "_file", "_start", "_row", "_count", "_first", "_before", "_read"
    )


def with_key_ordinal(
    df: DataFrame, keys: Sequence[str] | str, ord_col: str = "ord", unique: bool = True
) -> DataFrame:
    """0-based dense number in key order.

    A range-partitioned sort, written and then numbered from its partition
    sizes; a key that repeats fails the job. With ``unique=False`` rows of equal keys keep their input order, and
    since that is part of the sort value, a key that holds a third of the rows
    is cut into many partitions; the input is written first, so that a repeated
    task can not change that order.
    """
    by = [keys] if isinstance(keys, str) else list(keys)
    if not unique:
        df = write_through(df.withColumn("_input", F.monotonically_increasing_id()))
        by = [*by, "_input"]
    ordered = df.repartitionByRange(*by).sortWithinPartitions(*by)
    if unique:
        # rows of one key are in one range, next to each other: nothing is moved for this
        among = F.row_number().over(Window.partitionBy(*by).orderBy(*by))
        ordered = ordered.withColumn("_among", among)
    numbered = ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "_part", F.spark_partition_id()
    )
    if unique:
        row = checked(F.col("_row"), F.col("_among") == 1, "a key repeats: number with unique=False")
        numbered = numbered.withColumn("_row", row).drop("_among")
    return _number_blocks(write_through(numbered.drop("_input")), ["_part"], ["_part"], ord_col)


def dedupe_last(df: DataFrame, key: str = "task_id", order: str = "ord") -> DataFrame:
    """Last value of every key, at the position where the key came first.

    ``order`` identifies a row. Its first and last value per key are one hash
    aggregate of two numbers, combined before the shuffle; the rows are then
    picked by the last value, a join on a unique number, so no row is sorted to
    be aggregated and a key repeated in a third of the rows makes no hot task.
    """
    ends = df.groupBy(key).agg(F.max(order).alias("_last"), F.min(order).alias("_first"))
    picked = df.join(ends.select("_last", "_first"), F.col(order) == F.col("_last"))
    return picked.select(*[c for c in df.columns if c != order], F.col("_first").alias(order))


def chunk(df: DataFrame, rows: int, order: str = "ord") -> DataFrame:
    """Add ``batch_id``: consecutive chunks of ``rows`` by a dense 0-based order."""
    if rows < 1:
        raise ValueError("a chunk holds at least one row")
    return df.withColumn("batch_id", F.expr(f"`{order}` div {int(rows)}"))


def _last_key(df: DataFrame, by: list[str], n: int) -> Column:
    """The ``n``-th key in order as a scalar struct, null where there are fewer rows.

    The keys alone are cut into ranges and counted; only the range that holds
    the n-th is sorted.
    """
    ranges = df.select(*by).repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    ranges = write_through(ranges)
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_count"))
    counts = _running_total(counts, ["_part"], "_count")
    holds = (F.col("_before") < n) & (F.lit(n) <= F.col("_before") + F.col("_count"))
    near = ranges.join(F.broadcast(counts.where(holds)), "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    last = near.withColumn("_place", place + F.col("_before")).where(F.col("_place") == n)
    return last.select(F.struct(*by)).scalar()


def first_batches(
    df: DataFrame, keys: Sequence[str] | str, rows: int, n_batches: int, order: str = "ord"
) -> DataFrame:
    """The first ``n_batches`` chunks of ``rows`` in key order, numbered; all when not positive.

    The last key asked for is found from the keys; the rows up to it are then
    filtered while they are scanned, and only those are sorted, stored and
    numbered, in as many tasks as there are ranges of them.
    """
    by = [keys] if isinstance(keys, str) else list(keys)
    head = df
    if n_batches > 0:
        wanted = F.struct(*by) <= _last_key(df, by, rows * n_batches)
        head = df.where(F.coalesce(wanted, F.lit(True)))
    return chunk(with_key_ordinal(head, by, order), rows, order)


# Rows that one task lays next to each other in the permutation, at least, and
# how many such slices there are at most, a few of whose rows are broadcast.
SLICE_ROWS = 1 << 10
MOST_SLICES = 1 << 18


def shuffled_batches(
    df: DataFrame,
    keys: Sequence[str] | str,
    rows: int,
    seed: int = 42,
    length: Column | None = None,
    order: str = "ord",
) -> DataFrame:
    """``chunk`` of the seeded permutation, with one shuffle of the rows.

    The same ``ord`` and ``batch_id`` as ``chunk(seeded_shuffle(...))``, and with
    ``length`` the ``width`` of the batch, the largest length in it. The input is
    computed once and stored with its hash. Hash buckets, counted from that
    column, are put together to slices; a slice is sorted by one task, which
    gives the ranks in it and the widths of the batches inside. Only a batch that
    lies in two slices gets its width from a pass over the lengths at the edges.
    ``keys`` identify a row; a key that repeats fails the job.
    """
    if rows < 1:
        raise ValueError("a chunk holds at least one row")
    keys = [keys] if isinstance(keys, str) else list(keys)
    hashed = df.withColumn("_hash", shuffle_hash(seed, *keys))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    sized = F.lit(None).cast("int") if length is None else length.cast("int")
    stored = write_through(hashed.withColumn("_length", sized))

    counts = stored.groupBy("_bucket").agg(F.count("*").alias("_count"))
    total = F.sum("_count").over(Window.partitionBy())
    buckets = _running_total(counts, ["_bucket"], "_count").withColumn("_total", total)
    buckets = buckets.withColumn("_slice", F.expr(f"_before div greatest({SLICE_ROWS}, _total div {MOST_SLICES})"))
    among = Window.partitionBy("_slice")
    buckets = buckets.withColumn("_first", F.min("_before").over(among)).withColumn("_size", F.sum("_count").over(among))
    buckets = write_through(buckets.drop("_total"))  # at most a million rows, read for each use

    inside = Window.partitionBy("_slice").orderBy("_hash", *keys)
    key = F.struct(*[F.col(k) for k in keys])
    repeated = F.lag(key).over(inside).eqNullSafe(key)
    place = checked(F.row_number().over(inside), ~repeated, "a key repeats: rank with unique=False")
    laid = stored.join(F.broadcast(buckets.select("_bucket", "_slice", "_first")), "_bucket")
    laid = laid.withColumn("_place", place)
    laid = laid.withColumn(order, (F.col("_first") + F.col("_place") - 1).cast("bigint"))
    batches = chunk(laid, rows, order)
    own = ["_hash", "_bucket", "_length", "_slice", "_first", "_place"]
    if length is None:
        return batches.drop(*own)

    # the first and the last batch of a slice, where they go on in another one
    head, tail = F.expr(f"_first div {rows}"), F.expr(f"(_first + _size) div {rows}")
    in_head = (F.col("_first") % rows > 0) & (F.col("_before") < (head + 1) * rows)
    in_tail = F.col("_before") + F.col("_count") > tail * rows
    near = buckets.where(in_head | in_tail).select("_bucket", "_before", head.alias("_head"), tail.alias("_tail"))
    within = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    edge = stored.select("_bucket", "_hash", *keys, "_length").join(F.broadcast(near), "_bucket")
    edge = edge.withColumn("_at", F.col("_before") + F.row_number().over(within) - 1)
    edge = edge.withColumn("_edge", F.expr(f"_at div {rows}"))
    edge = edge.where((F.col("_edge") == F.col("_head")) | (F.col("_edge") == F.col("_tail")))
    wide = edge.groupBy("_edge").agg(F.max("_length").alias("_wide"))
    part = F.max("_length").over(Window.partitionBy("_slice", "batch_id"))
    joined = batches.withColumn("_part", part).join(F.broadcast(wide), F.col("batch_id") == F.col("_edge"), "left")
    return joined.withColumn("width", F.greatest("_part", "_wide")).drop(*own, "_part", "_edge", "_wide")


def limit_batches(df: DataFrame, n_batches: int) -> DataFrame:
    """The first ``n_batches`` chunks, or all of them when not positive."""
    return df.filter(F.col("batch_id") < n_batches) if n_batches > 0 else df
