"""Importance resampling towards a target, ranked by a distributed radix sort.

Word runs of one to three words fall into a fixed number of hash buckets. Both
sides are counted per bucket, which gives one gain a bucket: a bounded array
that every task holds, so a document is scored by adding up array entries. A
draw without replacement is then the highest scores after a Gumbel term seeded
by the document's id.

The rank is made by an LSD radix sort over a composite key. Each pass takes one
digit, from the least to the most significant one: rows are counted per slice
and digit, prefix sums over (digit, slice) give where each count begins, and a
row's destination is that plus its place among the rows of its slice with the
same digit, so the pass is stable. Rows then belong to the slice of their
destination. The sums run over digits first (at most 2 ** DIGIT_BITS of them),
then over the slices of each digit, so no task sees more than one of the two.
Every pass is stored in the shared folder; only keys and scores travel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from fillwright.session import write_through

from .frames import kept_columns, with_fields
from .words import NOT_ALPHANUMERIC, Words, chunks

BUCKETS = 10_000
LONGEST = 3  # words of a feature
MIN_WORDS = 20
SEED = 42
PERCENT = 5
DIGIT_BITS = 11
# Rows of a slice, the unit of a counting pass: few enough that a digit all rows
# share is spread over many tasks, and four times the counts a slice can have.
SLICE_ROWS = 1 << 13
# Bytes of a word that are hashed together with those of other words; the rest alone.
_TOGETHER = 48

N_WORDS = StructField("n_words", LongType(), False)
N_FEATURES = StructField("n_features", LongType(), False)
WEIGHT = StructField("weight", LongType(), False)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))


def _extended(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes ``start`` to ``end`` of ``data``."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    state, start, length = state[order], start[order], length[order]
    longest = int(length[0]) if len(length) else 0
    for at in range(min(longest, _TOGETHER)):
        many = int(np.searchsorted(-length, -at, "left"))
        state[:many] = _step(state[:many], data[start[:many] + at])
    for i in range(int(np.searchsorted(-length, -_TOGETHER, "left"))):
        rest = data[start[i] + _TOGETHER : start[i] + length[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def feature_buckets(words: Words, data: np.ndarray, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all runs of one word, then of two, and so on.

    A run goes on from the state of the run one word shorter, so each word's
    bytes are read once per run length.
    """
    row, left = words.row(), words.left()
    place = np.arange(len(words.start))
    state = np.full(len(place), 0xFFFFFFFF, np.uint32)
    for size in range(1, longest + 1):
        if size > 1:
            go_on = left[place] >= size
            place = place[go_on]
            state = _step(state[go_on], 0x20)
        last = place + size - 1
        state = _extended(state, data, words.start[last], words.end[last])
        yield row[place], (~state).astype(np.int64) % buckets


def _lowered(words: Words) -> np.ndarray:
    data = words.data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 0x20
    return data


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, the features of all texts in it, for buckets with any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = Words(batch.column("text"), NOT_ALPHANUMERIC, lower=True)
                for _, bucket in feature_buckets(words, _lowered(words), longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counts = texts.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """One gain a bucket from the two tables of ``bucket_counts``."""
    held = []
    for counts in (corpus, target):
        array = np.zeros(buckets)
        for r in counts.collect():  # at most one row a bucket
            array[r.bucket] = r.n
        held.append(array)
    s, t = held
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def with_weights(docs: DataFrame, gains: np.ndarray, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, the sum of the features' gains."""
    added = (N_WORDS, N_FEATURES, WEIGHT)
    schema = with_fields(docs, *added)
    kept = kept_columns(docs, *added)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                words = Words(batch.column(text), NOT_ALPHANUMERIC, lower=True)
                n_features = np.zeros(words.rows, np.int64)
                weight = np.zeros(words.rows, np.int64)
                for row, bucket in feature_buckets(words, _lowered(words), longest, len(gains)):
                    n_features += np.bincount(row, minlength=words.rows)
                    sums = np.concatenate([[0], np.cumsum(gains[bucket])])
                    ends = np.searchsorted(row, np.arange(words.rows + 1))
                    weight += np.diff(sums[ends])
                columns = [words.counts.astype(np.int64), n_features, weight]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, columns)], names=schema.fieldNames())

    return docs.mapInArrow(score, schema)


def gumbel_term(id_column: str = "doc_id", seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, fixed by the seed and the id (null: as empty)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _unsigned(column: str, low: int | None, high: int | None, descending: bool) -> tuple[Column, int]:
    """The key as a number from 0 on, nulls last, and how many bits it has."""
    if low is None:
        return F.lit(0).cast("long"), 0
    key = F.col(column)
    if high - low < (1 << 63) - 2:
        value = F.lit(high) - key if descending else key - F.lit(low)
        return F.coalesce(value.cast("long"), F.lit(high - low + 1)), (high - low + 1).bit_length()
    # too wide to subtract: the sign bit turned, read as unsigned; a null follows
    # the other end of the range in a digit of its own
    value = F.bitwise_not(key) if descending else key
    return F.coalesce(value.bitwiseXOR(F.lit(-(1 << 63))), F.lit(-1)), 65


def _digit(key: Column, column: str, bits: int, at: int, digit_bits: int) -> Column:
    if bits == 65 and at >= 64:
        return F.col(column).isNull().cast("long")
    shifted = F.shiftrightunsigned(key, at) if at else key
    return shifted.bitwiseAND(F.lit((1 << min(digit_bits, max(1, 64 - at))) - 1))


def radix_rank(rows: DataFrame, keys: Sequence[tuple[str, bool]], rank_col: str = "rank", digit_bits: int = DIGIT_BITS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` with their 1-based rank by ``keys``: (column, descending) pairs of
    whole numbers, the most significant first.

    Nulls rank last in a key. Rows alike in all keys get different ranks, in the
    order the rows are first stored. An empty table stays empty. A column named
    like the rank gives way.
    """
    columns = [c for c in rows.columns if c.lower() != rank_col.lower()]
    at, part, digit = "_radix_at", "_radix_slice", "_radix_digit"
    slices = F.expr(f"`{at}` div {int(slice_rows)}")
    table = write_through(rows.select(*columns).withColumn(at, F.monotonically_increasing_id()).withColumn(part, slices))
    ends = table.agg(*[f(c).alias(f"{f.__name__}_{i}") for i, (c, _) in enumerate(keys) for f in (F.min, F.max)]).first()
    passes = []
    for i, (column, descending) in reversed(list(enumerate(keys))):
        low, high = ends[f"min_{i}"], ends[f"max_{i}"]
        key, bits = _unsigned(column, low, high, descending)
        # digits of one width, so that the highest has as many values as the others
        width = -(-bits // max(1, -(-bits // digit_bits))) if bits < 65 else digit_bits
        places = list(range(0, min(bits, 64), width or 1)) + ([64] if bits == 65 else [])
        passes += [_digit(key, column, bits, place, width) for place in places]
    same = Window.partitionBy(part, digit).orderBy(at)
    for value in passes or [F.lit(0).cast("long")]:
        marked = table.withColumn(digit, value)
        counts = write_through(marked.groupBy(part, digit).agg(F.count("*").alias("_n")))
        # offsets of the digits: one small table whatever the number of rows
        digits = counts.groupBy(digit).agg(F.sum("_n").alias("_all"))
        earlier = Window.orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        digits = digits.select(digit, F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_digits_before"))
        ahead = Window.partitionBy(digit).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("_slices_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
        before = before.join(F.broadcast(digits), digit)
        before = before.select(part, digit, (F.col("_digits_before") + F.col("_slices_before")).alias("_before"))
        numbered = marked.withColumn("_place", F.row_number().over(same)).join(before, [part, digit])
        moved = numbered.select(*columns, (F.col("_before") + F.col("_place") - 1).alias(at))
        table = write_through(moved.withColumn(part, slices))
    return table.select(*columns, (F.col(at) + 1).alias(rank_col))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
) -> DataFrame:
    """Every document's id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the documents with ``min_words`` words, the given percent with the
    highest scores are drawn, ties to the smaller id; others have a null rank.
    Null and empty texts have no words and weight 0. A null id is hashed as an
    empty one and comes last among ties; repeated rows are rows of their own.
    An empty target is like any other: all its counts are 0. Columns other than
    the id are not passed on.
    """
    gains = bucket_gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    weighed = with_weights(docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")), gains, "_text", longest)
    scored = weighed.select("_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel_term("_id", seed)).alias("score"))
    # read by the counts of every pass: the texts are scored once
    stored = write_through(scored)
    eligible = F.col("n_words") >= min_words
    ranked = radix_rank(stored.where(eligible), [("score", True), ("_id", False)])
    drawn = stored.where(eligible).count() * percent // 100
    both = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        stored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    )
    return both.withColumnRenamed("_id", id_column)


def _oracle() -> str:
    """The draw in SQL: CRC-32 by its polynomial, byte after byte."""
    return f"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS steps
), texts AS (
    SELECT 'd' AS side, doc_id, row_number() OVER () AS row, text FROM documents
    UNION ALL SELECT 't', NULL, row_number() OVER (), text FROM benchmark
), cut AS (
    SELECT side, doc_id, row, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts
), features AS (
    SELECT side, row, unnest(list_concat(words, list_concat(
        list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
        list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])))) AS feature
    FROM cut
), kinds AS (
    SELECT feature, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM features GROUP BY feature
), bucketed AS (
    SELECT feature, s, t, xor(list_reduce(
        list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
        lambda c, b: xor(c // 256, steps[1 + xor(c % 256, b)]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
    FROM kinds, crc
), sums AS (
    SELECT bucket, sum(s) AS s, sum(t) AS t, sum(sum(s)) OVER () AS all_s, sum(sum(t)) OVER () AS all_t
    FROM bucketed GROUP BY bucket
), gains AS (
    SELECT feature, CAST(floor(1000 * ln((sums.t + 1)::DOUBLE * (all_s + {BUCKETS})::DOUBLE
        / ((sums.s + 1)::DOUBLE * (all_t + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
    FROM bucketed JOIN sums USING (bucket)
), weights AS (
    SELECT row, count(*) AS n_features, sum(gain) AS weight
    FROM features JOIN gains USING (feature) WHERE side = 'd' GROUP BY row
), scored AS (
    SELECT doc_id, len(words) >= {MIN_WORDS} AS eligible, coalesce(n_features, 0) AS n_features,
        CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || doc_id), 8) AS BIGINT) + 0.5::DOUBLE)
            / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM cut LEFT JOIN weights USING (row) WHERE side = 'd'
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, sum(eligible::INT) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM ranked
"""


ORACLE = _oracle()
