"""Repeated spans of words, by a compacted De Bruijn graph.

Token k-mers are the edges of the graph. Every window of ``WINDOW`` words holds
the same k-mers wherever it stands, so one of them, the least by hash, can
stand for all: only these edges are stored, about one in sixteen. The windows
that one occurrence of an edge stands for are neighbours, and the words they
cover are the path through the edge at that place.

* An edge that only one document has repeats nothing and is dropped.
* A repeated edge with a single path through it does not branch: its windows
  are one compact unit with one first document, however many copies there are.
* A branching edge is opened up: one document for each of its paths, at its
  source coordinates, gives the windows of the path, and the first document of
  each window is found over all paths.

What is removed follows from a comparison of document ids, so a hot passage is
never paired with itself. Edges, paths and windows are told apart by hashes of
128 bits together (an edge's and its path's, or two of a window).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from fillwright.session import write_through

from .frames import with_fields
from .words import WHITE_SPACE, Sequences, Words, chunks, mix, ragged, signed

WINDOW = 50
EDGE = 20

SPAN = StructType([StructField("start", LongType(), False), StructField("end", LongType(), False)])
FIELDS = (
    StructField("n_words", LongType(), False),
    StructField("n_removed", LongType(), False),
    StructField("removed", ArrayType(SPAN, False), False),
    StructField("kept_text", StringType(), False),
)


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values, the place of the least, the first of equals."""
    places, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = places[:-step], places[step:]
        places = np.where(values[right] < values[left], right, left)
        size += step
    return places


def _edges_of(words: Words, window: int, edge: int) -> tuple[np.ndarray, ...]:
    """(row, first window in the row, windows, edge hash, path hash) of a chunk's occurrences."""
    runs = Sequences(words.hashes())
    kmers = runs.every(edge)
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    width = window - edge + 1
    if len(kmers) < width:
        return nothing
    least = _least_places(kmers, width)
    starts = np.flatnonzero(words.left()[: len(least)] >= window)
    if not len(starts):
        return nothing
    place, row = least[starts], words.row()[starts]
    fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    low = starts[fresh]
    many = np.diff(np.concatenate([fresh, [len(starts)]]))
    path = runs.at(low, many + window - 1)
    # The edge's place tells paths of equal words apart.
    path = mix(path + (place[fresh] - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row[fresh], low - words.first[row[fresh]], many, kmers[place[fresh]], path


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Id, a hash of the text (rows may repeat an id) and the text."""
    rows = docs.where(F.col(id_column).isNotNull())
    return rows.select(F.col(id_column).alias("id"), F.hash(text).alias("tag"), F.col(text).alias("text"))


def graph_edges(docs: DataFrame, id_column: str, text: str, window: int, edge: int) -> DataFrame:
    """(id, tag, low, many, edge, path): each stored edge of each document."""
    kind = docs.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                row, low, many, edges, path = _edges_of(Words(batch.column("text"), WHITE_SPACE), window, edge)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("tag").take(rows), pa.array(low.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(signed(edges)), pa.array(signed(path))],
                    names=["id", "tag", "low", "many", "edge", "path"],
                )

    return _keyed(docs, id_column, text).mapInArrow(cut, f"id {kind}, tag int, low int, many int, edge long, path long")


def path_windows(docs: DataFrame, paths: DataFrame, id_column: str, text: str, window: int) -> DataFrame:
    """(first, second, edge, path, place, id): the windows of each path, read at its source coordinates."""
    kind = docs.schema[id_column].dataType.simpleString()
    wanted = paths.groupBy("id", "tag").agg(F.collect_list(F.struct("low", "many", "edge", "path")).alias("paths"))
    source = _keyed(docs, id_column, text).join(wanted, ["id", "tag"]).select("id", "text", "paths")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = Words(batch.column("text"), WHITE_SPACE)
                hashes = words.hashes()
                runs, second = Sequences(hashes), Sequences(hashes, second=True)
                lists = batch.column("paths")
                held = lists.flatten()
                of = np.repeat(np.arange(words.rows), lists.value_lengths().to_numpy())
                low, many, edge, path = (held.field(c).to_numpy() for c in ("low", "many", "edge", "path"))
                many = many.astype(np.int64)
                start = ragged(words.first[of] + low, many)
                place = ragged(np.zeros(len(many), np.int64), many)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(runs.at(start, window))),
                        pa.array(signed(second.at(start, window))),
                        pa.array(np.repeat(edge, many)),
                        pa.array(np.repeat(path, many)),
                        pa.array(place.astype(np.int32)),
                        batch.column("id").take(pa.array(np.repeat(of, many))),
                    ],
                    names=["first", "second", "edge", "path", "place", "id"],
                )

    return source.mapInArrow(cut, f"first long, second long, edge long, path long, place int, id {kind}")


def repeated_spans(docs: DataFrame, id_column: str, text: str, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """(id, tag, spans): per document, ranges [start, end) of window starts that repeat an earlier document."""
    occurrences = write_through(graph_edges(docs, id_column, text, window, edge))
    repeated = occurrences.groupBy("edge").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    # aggregates are stored before they are joined back, so that the join can be split at a hot edge
    repeated = write_through(repeated.select("edge", "first_id"))
    held = write_through(occurrences.join(repeated, "edge"))
    fork = held.groupBy("edge").agg(F.min("path").alias("p"), F.max("path").alias("q")).where("p <> q")
    fork = write_through(fork.select("edge"))
    # An edge without a fork: all its windows have the same first document.
    span = F.struct(F.col("low").alias("start"), (F.col("low") + F.col("many")).alias("end"))
    compact = held.where("id > first_id").join(fork, "edge", "left_anti").select("id", "tag", F.array(span).alias("spans"))
    # A fork: the first document of each window, over the paths through it.
    branching = held.join(fork, "edge", "left_semi")
    chosen = F.min(F.struct("id", "tag", "low", "many")).alias("c")
    paths = write_through(branching.groupBy("edge", "path").agg(chosen).select("edge", "path", "c.*"))
    windows = write_through(path_windows(docs, paths, id_column, text, window))
    first = windows.groupBy("first", "second").agg(F.min("id").alias("first_id"))
    opened = windows.join(first, ["first", "second"]).groupBy("edge", "path").agg(F.collect_list(F.struct("place", "first_id")).alias("opened"))  # at most WINDOW - EDGE + 1
    earlier = F.filter("opened", lambda w: w["first_id"] < F.col("id"))
    spans = F.transform(earlier, lambda w: F.struct((F.col("low") + w["place"]).alias("start"), (F.col("low") + w["place"] + 1).alias("end")))
    open_spans = branching.join(write_through(opened), ["edge", "path"]).select("id", "tag", spans.alias("spans")).where(F.size("spans") > 0)
    both = compact.union(open_spans)
    return both.groupBy("id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most a document's windows


def cut_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``removed`` and ``kept_text``.

    A word (parted by ASCII white space) is removed if it is in a window of
    ``window`` words of its document that also starts in a document with a
    smaller id, as the texts are given. ``removed`` are spans of word places,
    end exclusive; ``kept_text`` is the other words joined by one space. Null
    and empty texts have no words. Rows without an id lose nothing and take
    nothing from others; rows that repeat an id never count as earlier than
    each other. Input columns named like a result column give way; all others
    are passed on.
    """
    found = repeated_spans(docs, id_column, text, window, edge)
    found = found.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), F.col("spans").alias("_spans"))
    schema = with_fields(docs, *FIELDS)
    names = schema.fieldNames()
    passed = names[: -len(FIELDS)]
    joined = docs.join(found, (docs[id_column] == found["_id"]) & (F.hash(docs[text]) == found["_tag"]), "left").select(*passed, "_spans")
    span = pa.struct([pa.field("start", pa.int64(), False), pa.field("end", pa.int64(), False)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                total, lost, ranges, kept = [], [], [], []
                for value, spans in zip(batch.column(text), batch.column("_spans"), strict=True):
                    words = (value.as_py() or "").encode().split()  # at ASCII white space only
                    gone: list[tuple[int, int]] = []
                    if spans.is_valid:
                        change = np.zeros(len(words) + 1, np.int64)
                        starts = spans.values
                        low, high = (starts.field(c).to_numpy() for c in ("start", "end"))
                        np.add.at(change, low, 1)
                        np.add.at(change, high + window - 1, -1)
                        hit = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
                        turns = np.flatnonzero(np.diff(hit)).tolist()
                        gone = list(zip(turns[::2], turns[1::2], strict=True))
                    total.append(len(words))
                    lost.append(sum(high - low for low, high in gone))
                    ranges.append([{"start": low, "end": high} for low, high in gone])
                    for low, high in reversed(gone):
                        del words[low:high]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in passed] + [pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(ranges, pa.list_(pa.field("element", span, False))), pa.array(kept, pa.string())],
                    names=names,
                )

    return joined.mapInArrow(cut, schema)
