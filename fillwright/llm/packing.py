"""Best-fit packing of token pieces by minimum bin slack.

A bin is filled by the combination of the available lengths that leaves the
least slack, found by subset-sum over a bit set; the combination is then
removed. Pieces of one length are alike, so the search runs on the counts per
length: at most ``capacity`` of them, whatever the corpus. A combination is
taken as often as its counts allow, which uses up a length each time, so there
are about as many patterns as lengths. Spark then ranks the pieces of each
length and maps (length, rank) to a bin by the pattern table. Only the counts
come to the driver.

Tokenizing is by words: a vocabulary of words already seen is kept in each
worker as sorted hashes with their ids, and only new words reach the tokenizer.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwright.session import write_through

from .words import WHITE_SPACE, Words, byte_set, chunks, ragged, signed

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
# Words a worker remembers, about 40 MB; beyond it starts anew.
KNOWN_WORDS = 2_000_000

_APOSTROPHE = byte_set((0x27, 0x27))
_ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_PUNCT = byte_set((0x21, 0x7E)) & ~_ALNUM & ~_APOSTROPHE
# Parts words of a batch that is encoded as one text; a text that has it is encoded alone.
_MARK = "\x00"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts, for a tokenizer that never joins what white space parts.

    The tokenizer lower-cases and splits letters, digits and other signs, so a
    word may also be cut between an ASCII letter or digit and an ASCII sign
    (apostrophes apart), and words that differ in ASCII case are the same.
    Texts that hold a special token's string, or the mark, are encoded whole.
    """

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = known_words
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.whole(_MARK)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.parts = []  # of (sorted hashes, first id, number of ids, ids), the largest first

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> tuple:
        """Encode new words (by ascending hash) and remember them."""
        ids = self.whole(f" {_MARK} ".join(words))
        cut = np.flatnonzero(ids == self.mark[0])
        begin = np.concatenate([[0], cut + 1])
        count = np.concatenate([cut, [len(ids)]]) - begin
        part = (hashes, begin.astype(np.int32), count.astype(np.int32), ids.astype(self.kind))
        self.parts.append(part)
        while len(self.parts) > 1 and 2 * len(self.parts[-1][0]) >= len(self.parts[-2][0]):
            self.parts.append(_merged(self.parts.pop(), self.parts.pop()))
        if sum(len(p[0]) for p in self.parts) > self.limit:
            self._clear()
        return part

    def batch(self, words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and how many each row has."""
        data = words.data
        kinds, places = np.unique(words.hashes(), return_inverse=True)
        begin, count = np.zeros(len(kinds), np.int64), np.full(len(kinds), -1)
        pools, base = [], 0

        def take(of: np.ndarray, first: np.ndarray, many: np.ndarray, ids: np.ndarray) -> None:
            """Copy the ids of the kinds ``of``, and note where they lie."""
            nonlocal base
            many = many.astype(np.int64)
            begin[of], count[of] = base + np.cumsum(many) - many, many
            pools.append(ids[ragged(first.astype(np.int64), many)])
            base += len(pools[-1])

        for hashes, first, many, ids in self.parts:
            spot = np.minimum(np.searchsorted(hashes, kinds), len(hashes) - 1)
            known = np.flatnonzero((hashes[spot] == kinds) & (count < 0))
            take(known, first[spot[known]], many[spot[known]], ids)
        new = np.flatnonzero(count < 0)
        if len(new):
            sample = np.empty(len(kinds), np.int64)
            sample[places] = np.arange(len(places))
            strings = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(words.start[sample[new]], words.end[sample[new]], strict=True)]
            odd = [i for i, s in enumerate(strings) if _MARK in s]
            for i in odd:
                strings[i] = ""
            _, first, many, ids = self._learn(kinds[new], strings) if not odd else self._once(strings)
            take(new, first, many, ids)
        row_ids = count[places]
        pool = np.concatenate(pools) if pools else np.zeros(0, np.uint32)
        ids = pool[ragged(begin[places], row_ids)].astype(np.uint32)
        per_row = np.zeros(words.rows, np.int64)
        np.add.at(per_row, words.row(), row_ids)
        alone = self._whole_rows(data, words)
        if alone:
            ends = np.cumsum(per_row)
            rows = np.split(ids, ends[:-1])
            for i in alone:
                rows[i] = self.whole(texts[i].as_py())
                per_row[i] = len(rows[i])
            ids = np.concatenate(rows)
        return ids, per_row

    def _once(self, strings: list[str]) -> tuple:
        held, self.parts = self.parts, []
        part = self._learn(np.arange(len(strings), dtype=np.uint64), strings)
        self.parts = held
        return part

    def _whole_rows(self, data: np.ndarray, words: Words) -> list[int]:
        text = data.tobytes()
        found = set()
        for wanted in [*self.special, _MARK.encode()]:
            at = text.find(wanted)
            while at >= 0:
                found.add(int(np.searchsorted(words.offsets, at, "right")) - 1)
                at = text.find(wanted, at + 1)
        return sorted(found)


def _merged(a: tuple, b: tuple) -> tuple:
    hashes = np.concatenate([a[0], b[0]])
    order = np.argsort(hashes, kind="stable")
    begin = np.concatenate([a[1], b[1] + np.int32(len(a[3]))])[order]
    count = np.concatenate([a[2], b[2]])[order]
    return hashes[order], begin, count, np.concatenate([a[3], b[3]])


class _Units(Words):
    """Words, also cut between ASCII letters or digits and ASCII signs."""

    def __init__(self, column: pa.Array):
        super().__init__(column, WHITE_SPACE, lower=True)
        data = self.data
        if len(data):
            alnum, punct = _ALNUM[data], _PUNCT[data]
            cut = np.flatnonzero((alnum[:-1] & punct[1:]) | (punct[:-1] & alnum[1:])) + 1
            cut = cut[~np.isin(cut, self.offsets, assume_unique=False)]
            self.start = np.sort(np.concatenate([self.start, cut]))
            self.end = np.sort(np.concatenate([self.end, cut]))
            self.first = np.searchsorted(self.start, self.offsets)
            self.counts = np.diff(self.first)


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most ``capacity``.

    One row per piece: the id column, ``piece``, ``start``, ``length``,
    ``ids_crc32`` (of little-endian 32-bit ids) and, on request, ``ids``.
    Null and empty texts are the end id alone. Repeated rows and null ids stay
    as they are.
    """
    path = path or vocabulary_path()
    source = docs.select(F.col(id_column), F.col(text).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for batch in chunks(whole, "text"):
                texts = batch.column("text").fill_null("")
                ids, per_row = encoder.batch(_Units(texts), texts)
                bounds = np.cumsum(per_row)
                ids = np.insert(ids, bounds, end) if len(ids) else np.repeat(end, len(per_row))
                sizes = per_row + 1
                first = np.cumsum(sizes) - sizes
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                number = ragged(np.zeros(len(sizes), np.int64), pieces)
                begin = number * capacity
                length = np.minimum(sizes[row] - begin, capacity)
                low = first[row] + begin
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(low.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(begin), pa.array(length), pa.array(crc, pa.int64())]
                names = [id_column, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([low, low[-1:] + length[-1:]]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(cut, schema)


def fullest(room: int, counts: np.ndarray) -> list[tuple[int, int]]:
    """The (length, times) of available lengths with the largest sum within ``room``.

    ``counts[n]`` pieces have length ``n``. Bit ``s`` of the set tells that a
    sum ``s`` can be reached; lengths are tried from long to short, so among
    equal sums the longer pieces go first.
    """
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left = min(int(counts[length]), room // length)
        times = 1
        while left:  # 1, 2, 4, ... of the length at once
            times = min(times, left)
            before = reach
            reach |= (reach << (length * times)) & mask
            if reach != before:
                steps.append((before, length, times))
            left -= times
            times *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for before, length, times in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + times
            at -= length * times
    return list(taken.items())


def bin_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces in each bin)]) that use up all ``counts``.

    Each pattern starts from the longest piece left and adds the fullest
    combination of the others, and fills as many bins as the counts allow.
    """
    held = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        held[length] = n
    patterns = []
    while (left := np.flatnonzero(held)).size:
        longest = int(left[-1])
        held[longest] -= 1
        taken = dict(fullest(capacity - longest, held))
        held[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        bins = min(int(held[length]) // times for length, times in taken.items())
        for length, times in taken.items():
            held[length] -= bins * times
        patterns.append((bins, sorted(taken.items(), reverse=True)))
    return patterns


def _places(patterns: list, capacity: int) -> np.ndarray:
    """Rows (length, first rank, times, first bin, offset), sorted; ranks of a length are gapless."""
    ranks = np.zeros(capacity + 1, np.int64)
    rows, bins_before = [], 0
    for bins, taken in patterns:
        offset = 0
        for length, times in taken:
            rows.append((length, ranks[length], times, bins_before, offset))
            ranks[length] += bins * times
            offset += length * times
        bins_before += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, key: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    ``pieces`` must give the same rows each time it is read: pass a stored
    table. Sequences are numbered from 0 and each is filled without a gap from
    offset 0. Which of several alike pieces goes where depends on ``key``;
    repeated keys are placed one by one.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(_places(bin_patterns(counts, capacity), capacity))
    # Ranks in two levels, of about as many buckets as there are pieces in each.
    buckets = 1 + math.isqrt(max(counts.values(), default=0))
    bucketed = pieces.drop("sequence_id", "offset").withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    firsts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_bucket").orderBy(*key)
    ranked = bucketed.withColumn("_place", F.row_number().over(inside)).join(firsts, ["length", "_bucket"])
    ranked = ranked.select(*[c for c in bucketed.columns if c != "_bucket"], (F.col("_first") + F.col("_place") - 1).alias("_rank"))
    schema = ranked.drop("_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    names = schema.fieldNames()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, times, base, offset = places.value.T
        joint = length * (1 << 50) + first
        for batch in batches:
            size, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            spot = np.searchsorted(joint, size * (1 << 50) + rank, "right") - 1
            turn = rank - first[spot]
            columns = [batch.column(c) for c in names[:-2]]
            columns += [pa.array(base[spot] + turn // times[spot]), pa.array(offset[spot] + turn % times[spot] * size)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with the sequence and the offset each is placed at.

    An empty table gives no rows; columns but the id and the text are left.
    The pieces are stored in the shared folder, so each text is tokenized once.
    """
    pieces = write_through(token_pieces(docs, id_column, text, path, capacity, with_ids=with_ids))
    return pack(pieces, (id_column, "piece"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from ``pack_documents(..., with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # capacity bounds the group
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
