"""Byte-level BPE by recursive queries of DuckDB inside each partition.

A text is cut into words by the tokenizer's pattern. A word that is no token
itself becomes one row per byte, (word, place, token). A recursive query joins
neighbouring rows with the merge table, contracts each word's leftmost pair of
the least rank, and goes on until no pair of the word can be merged. Words met
before keep their ids, so a worker contracts each word once; texts are put
together from the ids of their words. Decoding joins (place, id) rows with the
vocabulary and aggregates the bytes in order.

A merge is any pair of tokens whose joined bytes are a token, and its rank is
that token's. Documents never move: there is no shuffle, and a lost task is run
again from its rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField

from .frames import kept_columns, with_fields
from .words import chunks, ragged

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Words a worker remembers, about 200 MB; beyond it starts anew.
KNOWN_WORDS = 1_000_000
# Bytes of text handled at once.
CHUNK_BYTES = 1 << 22
# Words and ids handled at once; longer texts are taken in slices of so many.
SLICE = 1 << 19
# Longer words are contracted at all places of their least pair in one round.
LONG_WORD = 64
DATABASE = {"threads": 1, "memory_limit": "512MB", "temp_directory": ""}

IDS = StructField("ids", ArrayType(IntegerType(), False), False)
DECODED = StructField("decoded", BinaryType(), False)

_LEFTMOST = """
WITH RECURSIVE parts AS (
    SELECT word, place, place + 1 AS following, token, false AS done FROM bytes
    UNION ALL
    SELECT word, place, following, token, done FROM (
        WITH live AS (SELECT * FROM parts WHERE NOT done),
        least AS (
            SELECT a.word, min({'id': m.id, 'place': a.place, 'gone': b.place, 'following': b.following}) AS pair
            FROM live a
            JOIN live b ON b.place = a.following
            JOIN merges m ON m.pair = (a.token::BIGINT << 32) | b.token
            GROUP BY a.word
        )
        SELECT l.word, l.place,
            CASE WHEN l.place = pair.place THEN pair.following ELSE l.following END AS following,
            CASE WHEN l.place = pair.place THEN pair.id ELSE l.token END AS token,
            pair IS NULL AS done
        FROM live l LEFT JOIN least USING (word)
        WHERE l.place IS DISTINCT FROM pair.gone
    )
)
SELECT word, list(token ORDER BY place) AS ids FROM parts WHERE done GROUP BY word ORDER BY word
"""

# Equal to contracting the leftmost pair again and again: no pair that a
# contraction makes has a rank as low as its own where every token is the
# encoding of its bytes. In a run of overlapping pairs every second one stays.
_EVERY_LEAST = """
WITH RECURSIVE parts AS (
    SELECT word, place, token, false AS done FROM bytes
    UNION ALL
    SELECT word, place, CASE WHEN taken THEN best ELSE token END, best IS NULL FROM (
        SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY place) AS gone FROM (
            SELECT *, least AND (number - coalesce(max(CASE WHEN NOT least THEN number END)
                OVER (PARTITION BY word ORDER BY place), 0)) % 2 = 1 AS taken
            FROM (
                SELECT p.*, coalesce(m.id = min(m.id) OVER (PARTITION BY word), false) AS least,
                    min(m.id) OVER (PARTITION BY word) AS best
                FROM (
                    SELECT word, place, token,
                        lead(token) OVER (PARTITION BY word ORDER BY place) AS beside,
                        row_number() OVER (PARTITION BY word ORDER BY place) AS number
                    FROM parts WHERE NOT done
                ) p
                LEFT JOIN merges m ON m.pair = (p.token::BIGINT << 32) | p.beside
            )
        )
    ) WHERE NOT gone
)
SELECT word, list(token ORDER BY place) AS ids FROM parts WHERE done GROUP BY word ORDER BY word
"""

_DECODE = """
SELECT part, string_agg(text, '' ORDER BY place) AS text
FROM tokens JOIN vocabulary USING (id) GROUP BY part
"""


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of every token of a rank file."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{path} has no token for the bytes {missing}")
    return ranks


def _joined(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    column = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32), lengths


class _Numbers(dict):
    """Words by number, in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Words to ids and ids to bytes, for one rank file and one pattern."""

    def __init__(self, path: str, pattern: str | None = None, known_words: int = KNOWN_WORDS):
        import duckdb
        import public_tokenizers
        import regex

        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.ranks = ranks = read_ranks(path)
        self.limit = known_words
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        self.db = duckdb.connect(config=DATABASE)
        self._store("merges", {"pair": pa.array([m[0] for m in merges], pa.int64()), "id": pa.array([m[1] for m in merges], pa.int32())})
        # bytes as characters of the same number, since text can be joined in SQL
        texts = [token.decode("latin-1") for token in ranks]
        self._store("vocabulary", {"id": pa.array(list(ranks.values()), pa.int32()), "text": pa.array(texts)})
        self._clear()

    def _store(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _clear(self) -> None:
        self.known = _Numbers()
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def contract(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), lengths)
        # one place is left free between two words, so they are no neighbours
        place = np.arange(len(raw)) + word
        self.db.register("bytes", pa.table({"word": word, "place": place, "token": self.byte_ids[raw]}))
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("bytes")
        return _joined(found.column("ids"))

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of words that have just been numbered, in that order."""
        ids: list[np.ndarray | None] = []
        short, long = [], []
        for place, word in enumerate(words):
            data = word.encode()
            rank = self.ranks.get(data)
            ids.append(None if rank is None else np.array([rank], np.int32))
            if rank is None:
                (short if len(data) <= LONG_WORD else long).append((place, data))
        for group, query in ((short, _LEFTMOST), (long, _EVERY_LEAST)):
            if group:
                values, counts = self.contract([data for _, data in group], query)
                ends = np.cumsum(counts)
                for (place, _), low, high in zip(group, ends - counts, ends, strict=True):
                    ids[place] = values[low:high]
        counts = np.array([len(part) for part in ids], np.int64)
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.pool = np.concatenate([self.pool, *ids])

    def _slice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        if len(self.known) > self.limit:
            self._clear()
        before = len(self.count)
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > before:
            try:
                self._learn(list(islice(self.known, before, None)))
            except BaseException:
                self._clear()  # the next task may have this worker
                raise
        counts = self.count[number]
        return self.pool[ragged(self.first[number], counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        totals = np.zeros(len(texts), np.int64)
        values = [np.zeros(0, np.int32)]

        def add(words: list[str], rows: list[int], sizes: list[int]) -> None:
            ids, counts = self._slice(words)
            values.append(ids)
            sums = np.concatenate([[0], np.cumsum(counts)])
            ends = np.cumsum(sizes)
            np.add.at(totals, rows, sums[ends] - sums[ends - np.array(sizes)])

        words, rows, sizes = [], [], []
        for row, text in enumerate(texts):
            if len(text) > SLICE:
                # a text without end may hold more words than memory: one slice after another
                found = (match[0] for match in self.pattern.finditer(text))
                parts = iter(lambda: list(islice(found, SLICE)), [])
            else:
                parts = [self.pattern.findall(text)]
            for part in parts:
                words += part
                rows.append(row)
                sizes.append(len(part))
                if len(words) >= SLICE:
                    add(words, rows, sizes)
                    words, rows, sizes = [], [], []
        if words:
            add(words, rows, sizes)
        return np.concatenate(values), totals

    def decode(self, values: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each row's ids, at most ``SLICE`` ids at a time."""
        row = np.repeat(np.arange(len(counts)), counts)
        out = [b""] * len(counts)
        for low in range(0, len(values), SLICE):
            part = row[low : low + SLICE]
            tokens = {"part": part, "place": np.arange(len(part)), "id": values[low : low + SLICE]}
            self.db.register("tokens", pa.table(tokens))
            for number, text in self.db.sql(_DECODE).fetchall():
                out[number] += text.encode("latin-1")
            self.db.unregister("tokens")
        return out


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str | None) -> Encoder:
    """One for all tasks of a worker, so that its words stay known."""
    return Encoder(path, pattern)


def _texts(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in column.cast(pa.large_binary()).fill_null(b"").to_pylist()]


def _encoded(batches: Iterator[pa.RecordBatch], text: str, kept: list[str], path: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, pattern)
    for whole in batches:
        for batch in chunks(whole, text, CHUNK_BYTES):
            values, counts = encoder.encode(_texts(batch.column(text)))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            field = pa.list_(pa.field("element", pa.int32(), False))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=field)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], names=[*kept, "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], ids: str, kept: list[str], path: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, pattern)
    for batch in batches:
        lists = batch.column(ids)
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().cast(pa.int32()).fill_null(-1).to_numpy(zero_copy_only=False)
        decoded = pa.array(encoder.decode(values, counts), pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), decoded], names=[*kept, "decoded"])


def encode_texts(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the tokens of each whole text.

    Null and empty texts have no ids; bytes that are no UTF-8 are read as the
    replacement character. Each row is handled alone, so repeated rows and ids
    and empty tables need no rule. An input column named ``ids`` gives way.
    """
    path = path or vocabulary_path()
    kept = kept_columns(docs, IDS)
    return docs.mapInArrow(lambda batches: _encoded(batches, text, kept, path, pattern), with_fields(docs, IDS))


def decode_ids(df: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the bytes of each row's ids.

    Null and empty lists have none, and neither has an id that is null or no
    token. An input column named ``decoded`` gives way.
    """
    path = path or vocabulary_path()
    kept = kept_columns(df, DECODED)
    return df.mapInArrow(lambda batches: _decoded(batches, ids, kept, path, pattern), with_fields(df, DECODED))


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` without the text but with ``ids`` and ``decoded``, by the two steps
    above in one task: the ids are decoded where they were made. Input columns
    named like these give way."""
    path = path or vocabulary_path()
    rest = docs.drop(text)
    kept = kept_columns(rest, IDS, DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_encoded(batches, text, kept, path, pattern), "ids", [*kept, "ids"], path, pattern)

    return docs.mapInArrow(run, with_fields(rest, IDS, DECODED))
