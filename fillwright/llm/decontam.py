"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of item words (a whole item if it is shorter) and is taken as
the set of its word shingles. A document holds the window only if it holds all
its shingles, so the required overlap is the whole set and the necessary prefix
is one token: the shingle that is rarest in the corpus. The join is on that
token. A match fixes where the window would start, so the positional bound (it
starts inside the document) and the length bound (enough words are left) are
checked next, and what passes is verified as a whole run of words.

Equal windows are one window, however many items have it. They go to the
workers in blocks of about ``BLOCK_WINDOWS``; a larger benchmark takes more
blocks, each adding to what the last one found, so no broadcast grows with the
input. A document is marked with the windows in it, and only then are the items
of these windows looked up, once for each distinct set of windows, by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from fillwright.session import write_through

from .frames import kept_columns, set_aside, with_fields
from .words import NOT_ALPHANUMERIC, Sequences, Words, chunks, ragged, signed

WINDOW = 13
SHINGLE = 3
# Distinct windows of the benchmark that are broadcast at once, about 2 MB.
BLOCK_WINDOWS = 50_000
# Distinct shingles whose rarity one pass over the documents counts, 16 MB.
COUNTED_SHINGLES = 1 << 21
# A document is contaminated from one hit word in so many.
ONE_IN = 20

SPAN = StructType([StructField("start", LongType(), False), StructField("end", LongType(), False)])
HASHES = StructType([StructField("key", LongType(), False), StructField("second", LongType(), False)])
MARKS = (
    StructField("n_words", LongType(), False),
    StructField("n_hit", LongType(), False),
    StructField("hit_spans", ArrayType(SPAN, False), False),
    StructField("hit_windows", ArrayType(HASHES, False), False),
)
ITEMS = StructField("hit_items", ArrayType(StringType(), False), False)
_WINDOW_SCHEMA = "item string, n int, key long, second long, shingles array<long>"


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per item and window: its length, two hashes and its shingles in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = Words(batch.column("text"), NOT_ALPHANUMERIC, lower=True)
                first, hashes = words.first, words.hashes()
                runs, second = Sequences(hashes), Sequences(hashes, second=True)
                items = batch.column("item").to_pylist()
                out: list[list] = [[], [], [], [], []]
                for row in range(words.rows):
                    n = min(window, int(words.counts[row]))
                    if not n:
                        continue
                    size = min(shingle, n)
                    for at in range(int(first[row]), int(first[row + 1]) - n + 1):
                        places = np.arange(at, at + n - size + 1)
                        values = (items[row], n, int(signed(runs.at(np.array([at]), n))[0]), int(signed(second.at(np.array([at]), n))[0]), signed(runs.at(places, size)).tolist())
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.int64()))],
                    names=["item", "n", "key", "second", "shingles"],
                )

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, _WINDOW_SCHEMA)


def shingle_counts(docs: DataFrame, text: str, wanted: np.ndarray, sizes: list[int]) -> DataFrame:
    """How often each of the ``wanted`` shingle hashes (sorted) stands in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, _sieve(wanted)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sieve = shared.value
        total = np.zeros(len(hashes), np.int64)
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = Words(batch.column("text"), NOT_ALPHANUMERIC, lower=True)
                runs, left = Sequences(words.hashes()), words.left()
                for size in sizes:
                    found = signed(runs.every(size))
                    place = np.flatnonzero(sieve[found & 0xFFFF])
                    place = place[left[place] >= size]
                    spot = np.searchsorted(hashes, found[place])
                    spot[spot == len(hashes)] = 0
                    total += np.bincount(spot[hashes[spot] == found[place]], minlength=len(hashes))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[seen]), pa.array(total[seen])], names=["shingle", "n"])

    counts = docs.select(F.col(text).alias("text")).mapInArrow(count, "shingle long, n long")
    return counts.groupBy("shingle").agg(F.sum("n").alias("n"))


def _sieve(hashes: np.ndarray) -> np.ndarray:
    """Which low 16 bits any of the hashes has: most places need no search."""
    flags = np.zeros(1 << 16, bool)
    flags[hashes & 0xFFFF] = True
    return flags


def rarest_shingles(docs: DataFrame, windows: DataFrame, text: str = "text", shingle: int = SHINGLE, at_once: int = COUNTED_SHINGLES) -> DataFrame:
    """(n, key, second, token, place): each distinct window the corpus may hold, by its rarest shingle.

    A window with a shingle that no document has is left out.
    """
    distinct = windows.select("n", "key", "second", "shingles").dropDuplicates(["n", "key", "second"])
    each = distinct.select("n", "key", "second", F.size("shingles").alias("size"), F.posexplode("shingles").alias("place", "shingle"))
    wanted = write_through(each.select("shingle").distinct())
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect())  # 1 to ``shingle``
    passes = -(-wanted.count() // at_once)
    counts = docs.sparkSession.createDataFrame([], "shingle long, n long")
    for number in range(passes):
        part = wanted.where(F.pmod(F.xxhash64("shingle"), F.lit(passes)) == number)
        hashes = np.sort(part.toArrow().column(0).to_numpy())  # about ``at_once``
        counts = counts.union(shingle_counts(docs, text, hashes, sizes))
    seen = each.join(counts.withColumnRenamed("n", "seen"), "shingle")
    best = F.min(F.struct("seen", F.col("shingle").alias("token"), "place")).alias("best")
    held = seen.groupBy("n", "key", "second", "size").agg(best, F.countDistinct("place").alias("held")).where("held = size")
    return write_through(held.select("n", "key", "second", "best.token", "best.place"))


class _Block:
    """Distinct windows sorted by their prefix token."""

    def __init__(self, rows: pa.Table, shingle: int):
        rows = rows.sort_by([("token", "ascending"), ("key", "ascending"), ("second", "ascending")])
        self.token, self.place, self.n, self.key, self.second = (rows.column(c).to_numpy().astype(np.int64) for c in ("token", "place", "n", "key", "second"))
        self.size = np.minimum(self.n, shingle)
        self.sieve = _sieve(self.token)


def _mark_block(docs: DataFrame, text: str, block: _Block, earlier: bool) -> DataFrame:
    """``docs`` with the hits of one block, added to those of earlier blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = with_fields(docs, *MARKS)
    names = schema.fieldNames()
    passed = names[: -len(MARKS)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        sizes = sorted(set(held.size.tolist()))
        for whole in batches:
            for batch in chunks(whole, text):
                words = Words(batch.column(text), NOT_ALPHANUMERIC, lower=True)
                n_words = len(words.start)
                hashes, left, row = words.hashes(), words.left(), words.row()
                runs, second = Sequences(hashes), None
                change = np.zeros(n_words + 1, np.int64)
                pairs = [np.zeros((2, 0), np.int64)]
                for size in sizes:
                    found = signed(runs.every(size))
                    spot = np.flatnonzero(held.sieve[found & 0xFFFF])
                    low = np.searchsorted(held.token, found[spot], "left")
                    many = np.searchsorted(held.token, found[spot], "right") - low
                    entry, spot = ragged(low, many), np.repeat(spot, many)
                    start = spot - held.place[entry]
                    fits = (held.size[entry] == size) & (start >= 0)
                    entry, spot, start = entry[fits], spot[fits], start[fits]
                    fits = (row[start] == row[spot]) & (left[start] >= held.n[entry])
                    entry, start = entry[fits], start[fits]
                    if not len(entry):
                        continue
                    second = second or Sequences(hashes, second=True)
                    same = (signed(runs.at(start, held.n[entry])) == held.key[entry]) & (signed(second.at(start, held.n[entry])) == held.second[entry])
                    entry, start = entry[same], start[same]
                    np.add.at(change, start, 1)
                    np.add.at(change, start + held.n[entry], -1)
                    pairs.append(np.stack([row[start], entry]))
                of, entry = np.unique(np.concatenate(pairs, axis=1), axis=1)
                marks = [of, held.key[entry], held.second[entry]]
                if earlier:
                    old, spans = _flat(batch.column("hit_spans"), "start", "end")
                    np.add.at(change, words.first[old] + spans[0], 1)
                    np.add.at(change, words.first[old] + spans[1], -1)
                    old, both = _flat(batch.column("hit_windows"), "key", "second")
                    marks = [np.concatenate(pair) for pair in zip([old, *both], marks, strict=True)]
                yield _marked(batch, passed, names, words, np.cumsum(change[:-1]) > 0, row, *marks)

    return docs.mapInArrow(scan, schema)


def _flat(lists: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of every struct in a column of lists, and its fields."""
    held = lists.flatten()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), [held.field(f).to_numpy() for f in fields]


def _lists(counts: np.ndarray, **fields: np.ndarray) -> pa.Array:
    """Lists of structs, ``counts[i]`` in row ``i``."""
    kinds = [pa.field(name, pa.int64(), False) for name in fields]
    structs = pa.StructArray.from_arrays([pa.array(values) for values in fields.values()], fields=kinds)
    places = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(places, structs, type=pa.list_(pa.field("element", structs.type, False)))


def _marked(batch, passed, names, words, hit, row, of, key, second) -> pa.RecordBatch:
    """The batch with its marks; spans are word places, end exclusive."""
    total = np.bincount(row[hit], minlength=words.rows)
    begins = hit.copy()
    begins[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
    ends = hit.copy()
    ends[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
    low, high = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    base = words.first[row[low]]
    order = np.lexsort((second, key, of))
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in passed]
        + [
            pa.array(words.counts.astype(np.int64)),
            pa.array(total.astype(np.int64)),
            _lists(np.bincount(row[low], minlength=words.rows), start=low - base, end=high - base),
            _lists(np.bincount(of, minlength=words.rows), key=key[order], second=second[order]),
        ],
        names=names,
    )


def mark_hits(docs: DataFrame, windows: DataFrame, text: str = "text", shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` and ``hit_windows`` (two hashes of each window, in order)."""
    rarest = rarest_shingles(docs, windows, text, shingle)
    blocks = max(1, -(-rarest.count() // block_windows))
    numbered = rarest.withColumn("block", F.pmod(F.xxhash64("key", "second"), F.lit(blocks)))
    result = docs.select(*[f"`{c}`" for c in kept_columns(docs, *MARKS)])
    for number in range(blocks):
        rows = numbered.where(F.col("block") == number).drop("block").toArrow()  # about ``block_windows``
        result = _mark_block(result, text, _Block(rows, shingle), number > 0)
    return result


def name_items(marked: DataFrame, windows: DataFrame, *spread: str) -> DataFrame:
    """``marked`` with ``hit_items``: the items of each row's windows, as strings in order.

    Rows with the same windows share one list. Rows without any are spread over the
    join by the columns in ``spread``.
    """
    text_of = F.transform("hit_windows", lambda w: F.concat_ws(":", w["key"], w["second"]))
    marks = F.when(F.size("hit_windows") > 0, F.sha2(F.array_join(text_of, ","), 256))
    sets = marked.where("n_hit > 0").select(marks.alias("_marks"), "hit_windows").dropDuplicates(["_marks"])
    held = sets.select("_marks", F.explode("hit_windows").alias("w")).select("_marks", "w.key", "w.second")
    owners = windows.where("item is not null").select("key", "second", "item").distinct()
    lists = held.join(owners, ["key", "second"]).groupBy("_marks").agg(F.sort_array(F.collect_set("item")).alias("hit_items"))  # at most a document's items
    passed = [f"`{c}`" for c in kept_columns(marked, ITEMS)]
    keyed = marked.select(*passed, F.coalesce(marks, F.xxhash64("n_words", *spread).cast("string")).alias("_marks"))
    items = F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items")
    return keyed.join(lists, "_marks", "left").select(*passed, items)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` and ``hit_items``.

    Words are maximal runs of letters, digits and non-ASCII characters, A-Z
    lower-cased. ``hit_spans`` are merged word spans of occurring windows and
    ``hit_items`` the items they belong to, as strings in order. Null and empty texts have no words; so do items
    without text, which match nothing. An item without an id marks words but is
    not listed. Repeated items and rows are each handled alone. Input columns
    named like a result column give way; all others are passed on as they are.

    The documents are marked twice, for the sets of windows and for the result;
    ``mark_hits``, a stored table and ``name_items`` mark them once.
    """
    windows = write_through(benchmark_windows(benchmark, item, item_text, window, shingle))
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() == "hit_windows"}
    marked = mark_hits(docs.withColumnsRenamed(own), windows, text, shingle, block_windows)
    return name_items(marked, windows, text).drop("hit_windows").withColumnsRenamed({name: c for c, name in own.items()})


def is_contaminated(one_in: int = ONE_IN) -> Column:
    """At least one word in ``one_in`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, one_in: int = ONE_IN, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns and no others."""
    windows = write_through(benchmark_windows(benchmark, item, item_text, window, shingle))
    aside, back = set_aside(docs, *MARKS)
    return back(mark_hits(aside, windows, text, shingle, block_windows).where(~is_contaminated(one_in)))
