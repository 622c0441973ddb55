"""Quoted CSV files with line breaks inside cells, read by many tasks.

A line break ends a record only outside quotes, and whether a line starts inside
quotes depends on all quotes before it, so a file is read twice. The first pass
counts quotes and records in each block a file is split into, records once for a
block that starts outside quotes and once for one that starts inside. Running
sums over that small table tell how each block starts and how many records are
ahead. The second pass then cuts each block into records on its own. A record
that goes on in later blocks is put together from its pieces, at most two a
block; nothing else is moved. The records are parsed by Spark.

A quote that is neither around a cell nor doubled inside one is not CSV by this
rule; a file with a quote that is never closed fails the job.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillwright.operators.contracts import checked

# How cells are quoted, for Spark's own reader and for single records.
DIALECT = {"escape": '"', "multiLine": "true", "mode": "FAILFAST"}

_BLOCK = "file long, start long, quotes long, if_outside long, if_inside long"
_PIECE = "file long, start long, kind int, ord long, record string"
_WHOLE, _OPEN, _REST = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # only \n parts lines, so that a \r inside a cell stays where it is
    scan = spark.read.option("lineSep", "\n").text(path)
    return scan.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"),
    )


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """The rows of each block, in order, and whether they are its first."""
    current = None
    for batch in batches:
        file, start = (batch.column(c).to_numpy() for c in ("file", "start"))
        edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if high > low:
                block = (int(file[low]), int(start[low]))
                yield block, block != current, batch.slice(low, high - low)
                current = block


def _quotes_before(lines: pa.Array, carried: int) -> tuple[np.ndarray, int]:
    quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
    sums = carried + np.cumsum(quotes)
    return sums - quotes, int(sums[-1])


def _filled(lines: pa.Array) -> np.ndarray:
    """The lines that are not empty; outside quotes the others are no records."""
    blank = pc.is_in(lines, pa.array(["", "\r"]))
    return ~blank.to_numpy(zero_copy_only=False)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list[int]] = []
    for (file, start), first, batch in _by_block(batches):
        if first:
            # the header of a file is no record
            out.append([file, start, 0, -(start == 0), 0])
        lines = batch.column("line")
        before, total = _quotes_before(lines, out[-1][2])
        filled = _filled(lines)
        out[-1][2] = total
        out[-1][3] += int(np.count_nonzero(filled & (before % 2 == 0)))
        out[-1][4] += int(np.count_nonzero(filled & (before % 2 == 1)))
    columns = list(zip(*out, strict=True)) or [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["file", "start", "quotes", "if_outside", "if_inside"])


def _blocks(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """One row a block: whether it starts inside quotes and the records ahead of it."""
    # the names of the files, which no task opens for that
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("name"))
    names = names.select(F.xxhash64("name").alias("file"), "name")
    in_file = Window.partitionBy("file").orderBy("start")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.mapInArrow(_count, _BLOCK)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    closed = F.sum("quotes").over(Window.partitionBy("file")) % 2 == 0
    known = counted.withColumn("inside", checked(inside, closed, "a quote of a CSV file is never closed"))
    known = known.withColumn("records", F.when(F.col("inside"), F.col("if_inside")).otherwise(F.col("if_outside")))
    # ahead in the file, and in the files before it: one sum a file, then over the files
    files = known.groupBy("file").agg(F.sum("records").alias("_all")).join(F.broadcast(names), "file", "left")
    name = checked(F.col("name"), F.col("name").isNotNull(), "a file is not among those listed")
    before = Window.orderBy("_name").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_name", name).select("file", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_files"))
    ahead = F.coalesce(F.sum("records").over(earlier), F.lit(0)) + F.col("_files")
    return known.join(F.broadcast(files), "file").select("file", "start", "inside", ahead.alias("ahead"))


def _cutter(columns: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "kind", "ord", "record"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
        out: list[tuple] = []
        block, quotes, held, kind, place = None, 0, [], _WHOLE, 0

        def settle(whole: bool) -> None:
            nonlocal held, place
            if not held:
                return
            text = "\n".join(held)
            held = []
            if kind == _REST:
                out.append((*block, _REST, None, text))
                return
            if block[1] == 0 and place == header:
                _same_header(text, columns)
            elif whole:
                out.append((*block, _WHOLE, place, text.removesuffix("\r")))
            else:
                out.append((*block, _OPEN, place, text))
            place += 1

        header = -1
        for found, first, batch in _by_block(batches):
            if first:
                settle(quotes % 2 == 0)
                block = found
                quotes = int(batch.column("inside")[0].as_py())
                kind = _REST
                place = batch.column("ahead")[0].as_py() - (block[1] == 0)
                header = place
            lines = batch.column("line")
            before, quotes = _quotes_before(lines, quotes)
            begins = (_filled(lines) & (before % 2 == 0)).tolist()
            inside = (before % 2 == 1).tolist()
            for line, begin, within in zip(lines.to_pylist(), begins, inside, strict=True):
                if begin:
                    settle(True)
                    kind = _WHOLE
                    held = [line]
                elif within:
                    held.append(line)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        settle(quotes % 2 == 0)
        columns_out = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns_out, types, strict=True)], names=names)

    return cut


def _same_header(text: str, columns: list[str]) -> None:
    cells = next(csv.reader([text.removeprefix("﻿").removesuffix("\r")]))
    if cells != columns:
        raise ValueError(f"a CSV file has the columns {cells}, another has {columns}")


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that go over a block's end, put together."""
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    number = F.sum((F.col("kind") == _OPEN).cast("int")).over(order)
    part = F.struct("start", F.col("record").alias("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["text"]), "\n")
    whole = pieces.withColumn("_number", number).groupBy("file", "_number").agg(F.max("ord").alias("ord"), text.alias("record"))
    return whole.select("ord", F.regexp_replace("record", r"\r\z", "").alias("record"))


def csv_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``ord``, the 0-based place of each record over the files in path order, and its text."""
    lines = _lines(spark, path)
    # one row a block, of 128 MB as Spark splits files by default
    blocks = F.broadcast(_blocks(spark, path, lines))
    known = lines.join(blocks, ["file", "start"], "left")
    state = checked(F.col("inside"), F.col("inside").isNotNull(), "the blocks of a file have changed")
    pieces = known.select("file", "start", state.alias("inside"), "ahead", "line").mapInArrow(_cutter(columns), _PIECE)
    whole = pieces.where(F.col("kind") == _WHOLE).select("ord", "record")
    return whole.unionByName(_joined(pieces.where(F.col("kind") != _WHOLE)))


def parsed(record: Column | str, columns: list[str]) -> Column:
    """A record as a struct of texts; other cells than columns fail the job."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return F.from_csv(record, schema, DIALECT)
