"""Text quality by pairwise ranking after Bradley and Terry.

Each text has a latent score, linear in its features, and the chance that a
good text is preferred to a bad one is the logistic function of the difference
of their scores. The weights are learned from preference pairs, by logistic
loss on feature differences. A quantile of the scores is then the threshold,
the one that tells the training rows apart best; scores are put on the scale of
0 to 1 around it.

Features are what a text is made of: the shares of neighbouring character
classes, sizes of words and lines, and repetition. All are taken from the whole
text by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from .frames import set_aside, with_fields
from .words import WHITE_SPACE, Words, chunks

# Labelled rows that are learned from, half of them of either label. A bounded
# sample, drawn by a hash of the id; all other counts and scores cover all rows.
TRAINING_ROWS = 20_000
PAIRS = 40_000
STEPS = 300

FIELDS = (StructField("score", DoubleType(), False), StructField("predicted", IntegerType(), False))

# Character classes: every sign of ASCII that is no letter or digit is its own.
_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS = np.zeros(256, np.int32)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 3
_CLASS[0x20] = 4
_CLASS[0x0A] = 5
_CLASS[0x80:] = 6
_CLASS[_SIGNS] = 7
_KINDS = 8
_SIGN = np.full(256, len(_SIGNS))
_SIGN[_SIGNS] = np.arange(len(_SIGNS))
WIDTH = _KINDS * _KINDS + len(_SIGNS) + 10


def features(column: pa.Array) -> np.ndarray:
    """One row of ``WIDTH`` numbers for each text; null is the empty text."""
    words = Words(column, WHITE_SPACE)
    data, offsets, rows = words.data, words.offsets, words.rows
    n_bytes = np.diff(offsets)
    total = np.maximum(n_bytes, 1)
    row = np.repeat(np.arange(rows, dtype=np.int32), n_bytes)
    kind = _CLASS[data]
    joint = row * np.int32(_KINDS * _KINDS) + kind * np.int32(_KINDS)
    same = row[1:] == row[:-1]
    pairs = np.bincount((joint[:-1] + kind[1:])[same], minlength=rows * _KINDS * _KINDS).reshape(rows, -1)
    at = np.flatnonzero(kind == 7)
    signs = np.bincount(row[at] * len(_SIGNS) + _SIGN[data[at]], minlength=rows * len(_SIGNS)).reshape(rows, -1)
    size = (words.end - words.start).astype(float)
    of = words.row()
    count = np.maximum(words.counts, 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=rows) / count

    mean = per_word(size)
    hashes = words.hashes()
    kinds = np.unique(np.stack([of.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64) if len(of) else of
    lines = np.bincount(row[data == 0x0A], minlength=rows) + 1
    first = np.zeros(len(of), bool)
    if len(of):
        first[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    last = data[words.end - 1] if len(of) else data
    rest = np.stack(
        [
            np.log1p(n_bytes),
            np.log1p(words.counts),
            mean,
            np.sqrt(np.maximum(per_word(size * size) - mean * mean, 0)),
            per_word(size >= 12),
            per_word(size <= 3),
            per_word((_CLASS[last] == 7)) if len(of) else np.zeros(rows),
            np.bincount(kinds, minlength=rows) / count,
            per_word(first),
            np.log1p(words.counts / lines),
        ],
        axis=1,
    )
    # Roots of shares: a rare sign is told from none.
    return np.concatenate([np.sqrt(pairs / total[:, None]), np.sqrt(signs / total[:, None]), rest], axis=1).astype(np.float32)


@dataclass
class Ranker:
    """A linear score with its threshold and scale."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def latent(self, values: np.ndarray) -> np.ndarray:
        return np.clip((values - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.latent(values) - self.threshold), -30, 30)))


def fit_pairs(values: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = STEPS, decay: float = 1e-3) -> Ranker:
    """Learn from all rows: each of ``pairs`` prefers a good row to a bad one.

    Without rows of both labels there is nothing to prefer: every text then has
    the score of the one label, or 0.5 without any row.
    """
    n_features = values.shape[1]
    if good.all() or not good.any():
        only = np.zeros(n_features, np.float64)
        return Ranker(only, only + 1, only, 0.0 if not len(good) else -1.0 if good[0] else 1.0, 1.0)
    values = values.astype(np.float64)
    mean, spread = values.mean(axis=0), values.std(axis=0) + 1e-3
    scaled = np.clip((values - mean) / spread, -8, 8)
    draw = np.random.default_rng(0)
    more, less = np.flatnonzero(good), np.flatnonzero(~good)
    # Every row takes part equally often.
    one = np.concatenate([draw.permutation(more) for _ in range(-(-pairs // len(more)))])[:pairs]
    two = np.concatenate([draw.permutation(less) for _ in range(-(-pairs // len(less)))])[:pairs]
    weights, first, second = np.zeros(n_features), np.zeros(n_features), np.zeros(n_features)
    batch = 4096
    for step in range(1, steps + 1):
        take = draw.integers(0, pairs, batch)
        difference = scaled[one[take]] - scaled[two[take]]
        chance = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
        slope = difference.T @ (chance - 1) / batch + decay * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        weights = weights - 0.03 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    latent = scaled @ weights
    # Of all quantiles of the scores, the one with the best balanced accuracy (of
    # equals, the middle one), and there halfway to the next lower score.
    order = np.argsort(latent, kind="stable")
    ranked, label = latent[order], good[order]
    below = np.concatenate([[0], np.cumsum(label)])[:-1] / label.sum()
    right = np.concatenate([[0], np.cumsum(~label)])[:-1] / (~label).sum() - below
    right[1:][ranked[1:] == ranked[:-1]] = -1  # a cut parts no equal scores
    best = np.flatnonzero(right >= right.max() - 1e-12)
    cut = int(best[len(best) // 2])
    threshold = float((ranked[cut] + ranked[max(cut - 1, 0)]) / 2)
    # The slope of a logistic curve through the threshold.
    scale, centred = 1.0, latent - threshold
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(scale * centred, -30, 30)))
        bend = (p * (1 - p) * centred * centred).mean() + 1e-3
        scale = float(np.clip(scale - ((p - good) * centred).mean() / bend, 0.05, 5.0))
    return Ranker(mean, spread, weights, threshold, scale)


def training_rows(labels: DataFrame, id_column: str, label: str, eligible: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, half of either label, chosen by a hash of the id.

    An id that repeats is one; if its labels differ, it has the lower one.
    """
    known = labels.where(eligible & F.col(label).isin(0, 1)).groupBy(id_column).agg(F.min(label).alias("label"))
    order = F.xxhash64(F.col(id_column).cast("string"))
    return known.where("label = 1").orderBy(order).limit(rows // 2).union(known.where("label = 0").orderBy(order).limit(rows // 2))


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", eligible: Column | None = None, rows: int = TRAINING_ROWS) -> Ranker:
    """Fit on a bounded sample of the labelled documents for which ``eligible`` holds.

    ``eligible`` is an expression over the columns of ``labels``. Labels other
    than 0 and 1, null ids and null texts are not learned from. Of the rows that
    repeat an id one is, chosen by its text, so the sample has ``rows`` rows at most.
    """
    sample = training_rows(labels, id_column, label, F.lit(True) if eligible is None else eligible, rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                values = features(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * WIDTH), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("label"), lists], names=["label", "features"])

    # The sample has at most ``rows`` rows, so the documents need not move.
    known = docs.where(F.col(text).isNotNull()).join(F.broadcast(sample), id_column).select(id_column, "label", F.col(text).alias("text"))
    known = known.groupBy(id_column, "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    table = known.withColumn("label", F.col("label").cast("int")).mapInArrow(measure, "label int, features array<float>").toArrow()
    good = table.column("label").to_numpy() == 1
    values = table.column("features").combine_chunks().flatten().to_numpy().reshape(len(good), WIDTH)
    # The rows come in no fixed order; the fit should not depend on it.
    order = np.lexsort(np.concatenate([values.T, good[None, :].astype(np.float32)]))
    return fit_pairs(values[order], good[order])


def score_quality(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Only the text counts, so equal texts score alike; null and empty texts
    score alike too. Input columns so named give way, others are passed on.
    """
    schema = with_fields(docs, *FIELDS)
    names = schema.fieldNames()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text):
                values = ranker.score(features(batch.column(text)))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names[:-2]] + [pa.array(values), pa.array((values >= 0.5).astype(np.int32))], names=names)

    return docs.mapInArrow(score, schema)


def held_out(id_column: str = "doc_id") -> Column:
    """The rows whose labels are never learned from: a third, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents predicted good, by a ranker fitted on the labels that are not held out.

    All columns of ``docs`` are passed on, also those named like a result column.
    """
    ranker = fit_quality(docs, labels, id_column, text, label, ~held_out(id_column))
    aside, back = set_aside(docs, *FIELDS)
    return back(score_quality(aside, ranker, text).where("predicted = 1"))
