"""Near duplicates by an inverted join over MinHash signature coordinates.

Documents with one and the same shingle set are one class. The class's
signature posts it under each (coordinate, value) pair. Two classes that are
similar enough share at least ``least_matches`` coordinates but for a chance of
``MISS``, so:

* a value that only one class has can match nothing and is skipped;
* a class left with fewer than ``least_matches`` values has no partner;
* of the values that are left, the prefix of the rarest ``n - least_matches + 1``
  must meet the partner's prefix, so only these are posted, and a value that
  very many documents share is skipped unless nearly all of a class's values
  are of that kind.

Pairs are confirmed on the full sets. A group of thousands of near copies would
give millions of pairs that say nothing new, so what is posted under a value is
first tied to one centre of it, and values whose classes all turn out to be in
one component are done. Classes under the other values are joined once more, by
the rarest shingles of their full sets, which is exact: for each pair the
position of a shared shingle bounds what else the sets can share, so classes
that were edited too much to have a partner meet none. Pairs are written out
only under shingles of few classes. The classes of the other shingles, which are
alike and mostly not linked, are compared in blocks: a set travels once for each
block of its crowd, and a task gives back which of its classes links join, not
the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillwright.session import write_through

from .components import FEW, centre_pairs, components, least_joined, open_postings
from .words import WHITE_SPACE, Sequences, Words, chunks, mix, signed

SHINGLE = 5
PERCENT = 75
COORDINATES = 64
MISS = 1e-7
# Shingles that are hashed for all coordinates at once.
_BLOCK = 16_384
# Parts a class is dealt to by id, so that its copies do not meet in one task.
PARTS = 1024
# Shingles of a block of sets, which counts as this many for each set at least;
# a task compares two blocks, some shingles at a time.
BLOCK = 1 << 17
_LEAST = 128
_COLUMNS = 4096

_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_SIGNATURE_SCHEMA = "n_shingles long, set_a long, set_b long, signature array<long>"


def least_matches(coordinates: int = COORDINATES, percent: int = PERCENT, miss: float = MISS) -> int:
    """The matches that a pair at the threshold reaches but for a chance of ``miss``."""
    p, below = percent / 100, 0.0
    for n in range(coordinates + 1):
        below += math.comb(coordinates, n) * p**n * (1 - p) ** (coordinates - n)
        if below > miss:
            return max(1, n)
    return coordinates


def _row_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a short row is one shingle."""
    words = Words(column, WHITE_SPACE, lower=True)
    runs = Sequences(words.hashes())
    every = runs.every(shingle)
    for low, n in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if n >= shingle:
            yield np.unique(every[low : low + n - shingle + 1])
        elif n:
            yield runs.at(np.array([low]), n)
        else:
            yield np.zeros(0, np.uint64)


def signatures(docs: DataFrame, id_column: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """Per document: the size of its shingle set, a 128-bit hash of the set, its MinHash signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(COORDINATES, dtype=np.uint64)
        for whole in batches:
            for batch in chunks(whole, "text"):
                sizes, first, second, signs = [], [], [], []
                for held in _row_sets(batch.column("text"), shingle):
                    sizes.append(len(held))
                    first.append(held.sum(dtype=np.uint64))
                    second.append(mix(held).sum(dtype=np.uint64))
                    if len(held):
                        least = np.full(COORDINATES, np.uint64(2**64 - 1))
                        for at in range(0, len(held), _BLOCK):
                            least = np.minimum(least, (_FACTORS[:, None] * held[None, at : at + _BLOCK]).min(axis=1))
                        # The low bits name the coordinate, so a value is one number.
                        signs.append(signed((least & ~np.uint64(COORDINATES - 1)) | salt))
                places = np.cumsum([0, *(COORDINATES if n else 0 for n in sizes)]).astype(np.int32)
                flat = np.concatenate(signs) if signs else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(signed(np.array(first, np.uint64))), pa.array(signed(np.array(second, np.uint64))), pa.ListArray.from_arrays(pa.array(places), pa.array(flat))],
                    names=["id", "n_shingles", "set_a", "set_b", "signature"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(sign, f"id {kind}, {_SIGNATURE_SCHEMA}")


def shingle_sets(docs: DataFrame, id_column: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, size, shingles): the full set of each document, as hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                held = list(_row_sets(batch.column("text"), shingle))
                places = np.cumsum([0, *map(len, held)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(s) for s in held], pa.int32()), pa.ListArray.from_arrays(pa.array(places), pa.array(signed(np.concatenate(held))))],
                    names=["id", "size", "shingles"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(cut, f"id {kind}, size int, shingles array<long>")


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(value, id): the rarest shared values of each class that can have a partner."""
    posted = classes.select("id", F.explode("signature").alias("value"))
    # stored, so that the join can be split at a value of very many classes
    shared = write_through(posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"))
    found = posted.join(shared, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("shared"))  # at most COORDINATES
    prefix = F.slice("shared", 1, F.greatest(F.size("shared") - matches + 1, F.lit(0)))
    return found.select("id", F.explode(prefix).alias("p")).select(F.col("p.value").alias("value"), "id")


def _similar(a: Column, b: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= F.lit(percent) * (size_a + size_b - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets are similar enough. Each set travels once, and once for each of its pairs."""
    left = sets.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("shingles").alias("set_b"))
    # The size of the smaller bounds the similarity, so sizes alone drop many pairs.
    sizes = pairs.join(left.select("a", "size_a"), "a").join(right.select("b", "size_b"), "b")
    near = sizes.where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent).select("a", "b")
    joined = near.join(left, "a").join(right, "b")
    return joined.where(_similar(F.col("set_a"), F.col("set_b"), F.col("size_a"), F.col("size_b"), percent)).select("a", "b").distinct()


def rare_postings(open_classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, id, component, size, place): the shingles under which a class can meet a similar one.

    ``open_classes`` (id, component). Shingles are ordered by how many of these
    classes have them. Sets that must share ``need`` shingles share one among
    the first ``size - need + 1`` of either, so a pair meets only there.
    """
    held = sets.join(open_classes, "id").select("id", "component", "size", "shingles")
    single = held.select("id", F.explode("shingles").alias("shingle"))
    counts = single.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    shared = single.join(counts, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("shared"))  # within one set
    # Shingles of one class alone come first in the order and meet nothing.
    alone = F.col("size") - F.size("shared")
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - alone
    prefix = F.slice("shared", 1, F.greatest(first.cast("int"), F.lit(0)))
    narrow = held.select("id", "component", "size").join(shared, "id")
    posted = narrow.select("id", "component", "size", alone.alias("alone"), F.posexplode(prefix).alias("place", "p"))
    return posted.select(F.col("p.shingle").alias("shingle"), "id", "component", "size", (F.col("alone") + F.col("place")).alias("place"))


def rare_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: classes of two components that meet and can be similar enough."""
    a, b = posted.alias("a"), posted.alias("b")
    need = F.ceil((F.col("a.size") + F.col("b.size")) * percent / (100 + percent))
    met = (
        (F.col("a.shingle") == F.col("b.shingle"))
        & (F.col("a.id") < F.col("b.id"))
        & (F.col("a.component") != F.col("b.component"))
        & (F.col("a.place") <= F.col("a.size") - need)
        & (F.col("b.place") <= F.col("b.size") - need)
    )
    return a.join(b, met).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _links(own: np.ndarray, component: np.ndarray, size: np.ndarray, flat: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of different components and blocks, or of one block, that are similar enough.

    ``own`` is the block of a row: of two blocks, only pairs across them are compared.
    """
    row = np.repeat(np.arange(len(size)), size)
    _, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.cumsum(shared) - 1
    kept = shared[code]
    row, code = row[kept], column[code[kept]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    left = np.flatnonzero(own == own.min())
    right = np.flatnonzero(own == own.max())
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), _COLUMNS):
        low, high = np.searchsorted(code, [at, at + _COLUMNS])
        has = np.zeros((len(size), _COLUMNS), np.float32)  # sums stay below 2**24, so they are exact
        has[row[low:high], code[low:high] - at] = 1
        both += has[left] @ has[right].T
    sizes = size[left][:, None] + size[right][None, :]
    near = (both * 100 >= percent * (sizes - both.astype(np.int64))) & (component[left][:, None] != component[right][None, :])
    one, two = np.nonzero(near)
    return left[one], right[two]


def joined_in_blocks(posted: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs that join the classes which links across components join under a
    shingle, a tree for each two blocks.

    The shingles that have the same least class are one crowd, so that classes which
    share many shingles are compared in few crowds.
    """
    kind = sets.schema["id"].dataType.simpleString()
    least = write_through(posted.groupBy("shingle").agg(F.min("id").alias("crowd")))
    rows = write_through(posted.join(least, "shingle").select("crowd", "id", "component", "size").distinct())
    share = F.sum(F.greatest("size", F.lit(_LEAST)))
    sizes = write_through(rows.groupBy("crowd").agg(F.ceil(share / block).cast("int").alias("blocks")))
    dealt = rows.select("crowd", "id", "component").distinct().join(sizes, "crowd").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    spread = dealt.select("crowd", "id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("crowd", "id", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, component = table["own"].to_numpy(), np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        size = table["size"].to_numpy().astype(np.int64)
        flat = np.concatenate([chunk.flatten().to_numpy() for chunk in table["shingles"].chunks])
        root = least_joined(len(size), *_links(own, component, size, flat, percent))
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": table["id"].take(pa.array(root[tied])), "b": table["id"].take(pa.array(tied))})

    # A fixed number of partitions: two blocks are few bytes but much work, so
    # they must not be put together by size.
    slots = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = spread.join(sets, "id").select("crowd", "low", "high", "own", "id", "component", "size", "shingles")
    compared = held.repartition(slots, "crowd", "low", "high").groupBy("crowd", "low", "high")
    return compared.applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _part() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part")


def set_classes(real: DataFrame) -> DataFrame:
    """(set_a, set_b, part, least, class_id): the documents of one set are a class,
    named by its least id and dealt to parts with a least id each."""
    parts = real.groupBy("set_a", "set_b", _part()).agg(F.min("id").alias("least"))
    whole = Window.partitionBy("set_a", "set_b")  # at most PARTS rows
    return parts.withColumn("class_id", F.min("least").over(whole))


def linked_classes(postings: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that have a link."""
    tied = write_through(confirmed(centre_pairs(postings.withColumn("component", F.col("id"))), sets, percent))
    known = write_through(components(tied, "a", "b"))
    open_classes = write_through(open_postings(postings, known).select("id", "component").distinct())
    posted = write_through(rare_postings(open_classes, sets, percent))
    met = posted.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("first"), F.max("component").alias("last")).where("first < last")
    met = write_through(met.select("shingle", "n"))
    few = write_through(posted.join(met.where(F.col("n") <= FEW), "shingle").drop("n"))
    crowded = write_through(posted.join(met.where(F.col("n") > FEW), "shingle").drop("n"))
    tied = tied.union(write_through(confirmed(rare_pairs(few, percent), sets, percent)))
    if not crowded.isEmpty():
        tied = tied.union(write_through(joined_in_blocks(crowded, sets, percent)))
    return write_through(components(tied, "a", "b"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    A document's set holds its distinct ``shingle``-word sequences, A-Z
    lower-cased; fewer words are one sequence. Documents are linked when
    100 * shared >= ``percent`` * union, and ``component_id`` is the least id
    that links reach. Null, empty and blank texts have no set and are alone, as
    are rows without an id (component null, kept). Rows that repeat an id are
    one document of several texts. Other columns are left.
    """
    signed_docs = write_through(signatures(docs, id_column, text, shingle))
    real = signed_docs.where("n_shingles > 0 AND id IS NOT NULL")
    classes = write_through(set_classes(real))
    named = classes.where("least = class_id").select(F.col("class_id").alias("id"), "set_a", "set_b")
    chosen = real.join(named, ["id", "set_a", "set_b"], "left_semi")
    postings = write_through(prefix_postings(chosen.dropDuplicates(["id", "set_a", "set_b"]).select("id", "signature"), least_matches(COORDINATES, percent)))
    wanted = write_through(postings.select("id").distinct())
    sets = write_through(shingle_sets(docs.join(wanted, docs[id_column] == wanted["id"], "left_semi"), id_column, text, shingle))
    known = linked_classes(postings, sets, percent)
    # looked up once for each part of a class, then by the documents of the part
    found = classes.join(known, classes["class_id"] == known["node"], "left")
    found = found.select("set_a", "set_b", "part", F.coalesce("component", "class_id").alias("component"))
    placed = signed_docs.select("id", "n_shingles", "set_a", "set_b", _part()).join(found, ["set_a", "set_b", "part"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return placed.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each group of near duplicates: a row with the group's least id.

    Rows without an id stay; rows that repeat an id stay or go together.
    """
    groups = near_duplicates(docs, id_column, text, **options)
    lost = groups.where(~F.col("kept")).select(id_column).distinct()
    return docs.join(lost, id_column, "left_anti").select(*docs.columns)
