"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by random signs and fast Hadamard transforms; its hash is
the axis it then lies closest to. ``_hashes`` such hashes make a bucket in each
of ``TABLES`` tables, as many as keep unlike vectors apart in the largest group
of rows. Multiprobe: a vector is posted under its own bucket and under those
with one hash replaced by the next axis, so two vectors meet even if two of
their hashes differ. Pairs that meet are verified by their cosine.

Pairs are written out only under buckets of few vectors. A larger bucket that is
not one component yet, as vectors make it which are alike but below the
threshold, is compared in blocks: a vector travels once for each block of its
bucket, and a task gives back which of its vectors links join, not the pairs.

Links join vectors to components, and every link lies inside a component. Links
are therefore counted inside components, over all pairs of members in blocks of
bounded size, which also counts a link that no bucket showed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwright.session import write_through

from .components import least_joined, linked_components
from .words import mix, signed

COSINE = 0.98
TABLES = 8
TURNS = 3
# Vectors of a block; a task compares two blocks, some rows at a time.
BLOCK = 8192
_ROWS = 512
# Rows turned at once.
_SLICE = 2048


def hadamard(values: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = values.shape
    step = 1
    while step < width:
        parts = values.reshape(n, width // (2 * step), 2, step)
        values = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return values


def _signs(table: int, part: int, turn: int, width: int) -> np.ndarray:
    seed = np.uint64(((table * 64 + part) * TURNS + turn + 1) * 0x100000)
    return np.where(mix(np.arange(width, dtype=np.uint64) + seed) & np.uint64(1), 1.0, -1.0)


def polytope_codes(vectors: np.ndarray, hashes: int, tables: int = TABLES) -> np.ndarray:
    """The buckets of each row: an array (rows, tables * (hashes + 1)) of 64-bit codes."""
    n, dim = vectors.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dim] = vectors
    out = []
    for table in range(tables):
        best, following = [], []
        for part in range(hashes):
            turned = padded
            for turn in range(TURNS):
                turned = hadamard(turned * _signs(table, part, turn, width))
            size = np.abs(turned)
            top = np.argpartition(-size, 1, axis=1)[:, :2] if width > 1 else np.zeros((n, 2), int)
            rows = np.arange(n)
            swap = size[rows, top[:, 1]] > size[rows, top[:, 0]]
            first, second = np.where(swap, top[:, 1], top[:, 0]), np.where(swap, top[:, 0], top[:, 1])
            best.append(2 * first + (turned[rows, first] < 0))
            following.append(2 * second + (turned[rows, second] < 0))
        for probe in range(-1, hashes):
            code = np.full(n, mix(np.array([table + 1], np.uint64))[0])
            for part in range(hashes):
                code = mix(code ^ (following if part == probe else best)[part].astype(np.uint64))
            out.append(code)
    return np.stack(out, axis=1)


def _by_width(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of list, a bounded number of rows at a time."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for at in range(0, len(rows), _SLICE):
            held = rows[at : at + _SLICE]
            yield held, flat[starts[held][:, None] + np.arange(length)]


def _unit(matrix: np.ndarray) -> np.ndarray:
    # The largest part first, so that no square overflows or vanishes.
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def bucket_postings(classes: DataFrame, hashes: int, tables: int = TABLES) -> DataFrame:
    """(value, id): the buckets of each class, apart for each label and length."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("group").to_numpy().view(np.uint64)
            for rows, matrix in _by_width(batch.column("vector")):
                codes = mix(polytope_codes(_unit(matrix), hashes, tables) ^ group[rows][:, None])
                ids = batch.column("id").take(pa.array(np.repeat(rows, codes.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(signed(codes.reshape(-1))), ids], names=["value", "id"])

    kind = classes.schema["id"].dataType.simpleString()
    group = F.xxhash64("label", F.size("vector")).alias("group")
    posted = classes.select("id", group, "vector").mapInArrow(post, f"value long, id {kind}").distinct()
    shared = posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    return posted.join(shared, "value", "left_semi")


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) of one label and length with at least this cosine."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = _by_width(batch.column("va")), _by_width(batch.column("vb"))
            for (rows, a), (_, b) in zip(left, right, strict=True):  # equal lengths, so equal slices
                keep[rows] = (_unit(a) * _unit(b)).sum(axis=1) >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    kind = classes.schema["id"].dataType.simpleString()
    a = classes.select(F.col("id").alias("a"), F.col("label").alias("la"), F.col("vector").alias("va"))
    b = classes.select(F.col("id").alias("b"), F.col("label").alias("lb"), F.col("vector").alias("vb"))
    joined = pairs.join(a, "a").join(b, "b").where((F.col("la") == F.col("lb")) & (F.size("va") == F.size("vb")))
    return joined.select("a", "b", "va", "vb").mapInArrow(check, f"a {kind}, b {kind}").distinct()


def _in_blocks(rows: DataFrame, group: str, order: str, block: int) -> DataFrame:
    """``rows`` once for each pair of blocks of their group that they are in: ``low`` and
    ``high`` name the pair and ``own`` the block of the row."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(order), "blocks").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = dealt.select("*", others).drop("blocks")
    spread = spread.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other")
    # A fixed number of partitions: two blocks are few bytes but much work, so
    # they must not be put together by size.
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(slots, group, "low", "high")


def _least_linked(unit: np.ndarray, cosine: float) -> np.ndarray:
    """For each row, the least row that links join it to."""
    n = len(unit)
    near = []
    for at in range(0, n, _ROWS):
        row, other = np.nonzero(unit[at : at + _ROWS] @ unit.T >= cosine)
        upper = other > row + at
        near.append(np.stack([row[upper] + at, other[upper]]))
    return least_joined(n, *np.concatenate(near, axis=1))


def joined_in_blocks(postings: DataFrame, classes: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs that join the ids which links join under a value, a tree for each
    two blocks of a value. ``postings`` are (value, id)."""
    kind = classes.schema["id"].dataType.simpleString()
    rows = postings.join(classes.select("id", "label", "vector"), "id")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        ids = frame["id"].to_numpy()
        for rows in frame.groupby([frame["label"], frame["vector"].map(len)]).indices.values():
            root = _least_linked(_unit(np.stack(frame["vector"].to_numpy()[rows]).astype(np.float64)), cosine)
            tied = np.flatnonzero(root != np.arange(len(root)))
            found.append(np.stack([ids[rows[root[tied]]], ids[rows[tied]]]))
        a, b = np.concatenate(found, axis=1) if found else (ids[:0], ids[:0])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    spread = _in_blocks(rows, "value", "id", block).select("value", "low", "high", "id", "label", "vector")
    return spread.groupBy("value", "low", "high").applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def link_counts(members: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """(hash_a, hash_b, n): for each member, the rows it links with in its component, itself included.

    A component is dealt into blocks; a task compares two blocks.
    """
    spread = _in_blocks(members, "component", "hash_a", block)
    spread = spread.select("component", "low", "high", "own", "label", "hash_a", "hash_b", "weight", "vector")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(frame), np.int64)
        low, high = frame["low"].iat[0], frame["high"].iat[0]
        own, weight = frame["own"].to_numpy(), frame["weight"].to_numpy()
        kinds = frame.groupby([frame["label"], frame["vector"].map(len)]).indices
        for rows in kinds.values():
            unit = _unit(np.stack(frame["vector"].to_numpy()[rows]).astype(np.float64))
            one, two = np.flatnonzero(own[rows] == low), np.flatnonzero(own[rows] == high)
            for at in range(0, len(one), _ROWS):
                part = one[at : at + _ROWS]
                linked = unit[part] @ unit[two].T >= cosine
                if low == high:
                    linked[np.arange(len(part)), at + np.arange(len(part))] = True
                n[rows[part]] += linked @ weight[rows[two]]
                if low != high:
                    n[rows[two]] += linked.T @ weight[rows[part]]
        return pd.DataFrame({"hash_a": frame["hash_a"], "hash_b": frame["hash_b"], "n": n})

    counted = spread.groupBy("component", "low", "high").applyInPandas(compare, "hash_a long, hash_b long, n long")
    return counted.groupBy("hash_a", "hash_b").agg(F.sum("n").alias("n"))


def hashes_for(rows: int, width: int) -> int:
    """Hashes in a bucket, so that a group of ``rows`` unlike vectors has far fewer rows than buckets."""
    return max(2, math.ceil(math.log(100 * max(rows, 1)) / math.log(2 * max(width, 2))))


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``.

    Two rows are linked if their labels are equal and not null, their lengths
    are equal and their cosine is at least ``cosine``. ``n_links`` counts the
    other rows a row is linked with, copies included; ``component_id`` is the
    least id that links reach. Vectors that are null, empty or zero or hold null
    or non-finite parts are linked with nothing, and so are rows without an id
    (component null, kept). Rows that repeat an id are one node of the links.
    """
    part = F.col("vector")
    finite = F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(part, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    hashed = rows.withColumns({"good": good, "hash_a": F.xxhash64("label", "vector"), "hash_b": F.xxhash64("vector", F.lit(1), "label")})
    same = hashed.where("good").groupBy("hash_a", "hash_b").agg(F.min_by(F.struct("id", "label", "vector"), "id").alias("c"), F.count("*").alias("weight"))
    classes = write_through(same.select("hash_a", "hash_b", "weight", "c.*"))
    largest = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("w")).agg(F.max("n"), F.max("w")).first()
    postings = write_through(bucket_postings(classes, hashes_for(largest[0] or 1, largest[1] or 2), tables))
    known = linked_components(
        postings,
        lambda pairs: verified(pairs, classes, cosine),
        lambda rows: joined_in_blocks(rows, classes, cosine),
    )
    plain = classes.select("hash_a", "hash_b", F.col("id").alias("class_id"), "weight")
    if known is None:
        found = plain.select("hash_a", "hash_b", "class_id", (F.col("weight") - 1).alias("n"))
    else:
        members = classes.join(known, classes["id"] == known["node"])
        counts = link_counts(members.select("component", "label", "hash_a", "hash_b", "weight", "vector"), cosine)
        with_counts = plain.join(counts, ["hash_a", "hash_b"], "left").join(known, plain["class_id"] == known["node"], "left")
        found = with_counts.select("hash_a", "hash_b", F.coalesce("component", "class_id").alias("class_id"), (F.coalesce("n", "weight") - 1).alias("n"))
    narrow = hashed.select("id", "good", "hash_a", "hash_b")
    placed = narrow.join(found, ["hash_a", "hash_b"], "left")
    component = F.when(F.col("good"), F.col("class_id")).otherwise(F.col("id"))
    result = placed.select(F.col("id").alias(id_column), F.when(F.col("good"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
