"""Ranked lexical search for many items at once, sharing common subexpressions.

The score of a document for an item is a sum over the item's terms, so items
with terms in common have partial sums in common. These are mined before the
search. Terms (a repeated term once per repeat) that stand in the same set of
items are one leaf: a shared term set. Each item is then a sequence of leaves,
those of many items first, and neighbours that stand together in several items
are paired, round after round, each pair a new node with two edges. What is left
is a graph in which items share nodes.

A task keeps one accumulator per node and document. Leaves are filled from the
terms of the documents, every other node is the sum of its two, computed once
for all items above it, and an item is the sum of its last nodes. Each task
keeps the best documents of each item; only these are shuffled.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, which bounds what is
sent to the tasks; each block is a pass over the documents. Documents never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fillwright.session import write_through

from .words import NOT_ALPHANUMERIC, Words, chunks, ragged, signed

TOP = 10
# Terms of items that are searched in one pass, some 2 MB with their graph.
BLOCK_TERMS = 1 << 16
# Accumulators held at once by a task: 8 bytes each.
ACCUMULATORS = 1 << 22


@dataclass
class SharedTerms:
    """Terms, nodes and items of a block.

    ``term`` is sorted. Term ``i`` adds ``times`` of its value to the leaves
    ``leaf[first[i]:first[i + 1]]``. ``rounds`` has the nodes made in each round
    as (left, right); they are numbered on from the leaves. The nodes of item
    ``items[i]`` are ``nodes[begin[i]:begin[i + 1]]``.
    """

    term: np.ndarray
    first: np.ndarray
    leaf: np.ndarray
    times: np.ndarray
    leaves: int
    rounds: list[np.ndarray]
    items: np.ndarray
    nodes: np.ndarray
    begin: np.ndarray

    @property
    def size(self) -> int:
        return self.leaves + sum(len(pairs) for pairs in self.rounds)


def share_terms(item: np.ndarray, term: np.ndarray, count: np.ndarray) -> SharedTerms:
    """Mine the nodes of a block from its (item, term, repeats) rows."""
    order = np.lexsort((item, -count, term))
    item, term, count = item[order], term[order], count[order]
    terms, begin = np.unique(term, return_index=True)
    ends = np.append(begin[1:], len(term))
    classes: dict[tuple, int] = {}
    leaf_of: list[list[tuple[int, int]]] = []
    for low, high in zip(begin, ends, strict=True):
        entries: dict[int, int] = {}
        repeats = count[low:high]
        # repeat r of the term stands in the items that have it r times or more
        for upto in sorted({int(n) for n in repeats}):
            members = tuple(sorted(item[low:high][repeats >= upto].tolist()))
            entries[classes.setdefault(members, len(classes))] = upto
        held, before = [], 0
        for number, upto in entries.items():
            held.append((number, upto - before))
            before = upto
        leaf_of.append(held)
    # items as sequences of leaves, those of many items first
    members = sorted(classes.items(), key=lambda c: (-len(c[0]), c[1]))
    owner = np.array([i for group, _ in members for i in group], np.int64)
    node = np.array([number for group, number in members for _ in group], np.int64)
    order = np.argsort(owner, kind="stable")
    owner, node = owner[order], node[order]
    rounds, known = [], len(classes)
    while True:
        owner, node, pairs = _paired(owner, node, known)
        if not len(pairs):
            break
        rounds.append(pairs)
        known += len(pairs)
    items, starts = np.unique(owner, return_index=True)
    sizes = np.array([len(held) for held in leaf_of], np.int64)
    flat = np.array([entry for held in leaf_of for entry in held], np.int64).reshape(-1, 2)
    return SharedTerms(
        terms,
        np.concatenate([[0], np.cumsum(sizes)]),
        flat[:, 0],
        flat[:, 1],
        len(classes),
        rounds,
        items,
        node,
        np.append(starts, len(node)),
    )


def _paired(owner: np.ndarray, node: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: neighbours that stand together most often become one node.

    A pair is taken where it is more frequent than the pairs it overlaps, and
    becomes a node if it is so taken in two items.
    """
    none = np.zeros((0, 2), np.int64)
    beside = np.flatnonzero(owner[1:] == owner[:-1])
    if not len(beside):
        return owner, node, none
    kinds, kind, many = np.unique(node[beside] * known + node[beside + 1], return_inverse=True, return_counts=True)
    strength = np.full(len(node) + 1, -1, np.int64)
    strength[beside + 1] = many[kind] * len(kinds) + kind
    best = (strength[1:-1] > strength[:-2]) & (strength[1:-1] > strength[2:]) if len(node) > 1 else np.zeros(0, bool)
    taken = beside[best[beside]]
    picked = kind[np.searchsorted(beside, taken)]
    uses = np.bincount(picked, minlength=len(kinds))
    taken = taken[uses[picked] >= 2]
    picked = picked[uses[picked] >= 2]
    made, number = np.unique(picked, return_inverse=True)
    if not len(made):
        return owner, node, none
    node = node.copy()
    node[taken] = known + number
    stays = np.ones(len(node), bool)
    stays[taken + 1] = False
    return owner[stays], node[stays], np.stack([kinds[made] // known, kinds[made] % known], axis=1)


def item_terms(items: DataFrame, number: str = "item", text: str = "text") -> DataFrame:
    """``item``, ``term`` (a 64-bit hash) and ``n``, its repeats in the item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = Words(batch.column("text"), NOT_ALPHANUMERIC, lower=True)
                rows = np.stack([batch.column("item").to_numpy()[words.row()], signed(words.hashes())])
                kinds, n = np.unique(rows, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[0]), pa.array(kinds[1]), pa.array(n.astype(np.int64))], names=["item", "term", "n"])

    rows = items.select(F.col(number).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item long, term long, n long")


def _found(words: Words, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``wanted``, occurrences) of the wanted terms in each text."""
    hashes = signed(words.hashes())
    spot = np.searchsorted(wanted, hashes)
    spot[spot == len(wanted)] = 0
    hit = np.flatnonzero(wanted[spot] == hashes)
    codes, tf = np.unique(words.row()[hit] * len(wanted) + spot[hit], return_counts=True)
    return codes // len(wanted), codes % len(wanted), tf.astype(np.int64)


def corpus_counts(docs: DataFrame, text: str, wanted: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents per wanted term."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        df = np.zeros(len(terms), np.int64)
        filled = total = 0
        for whole in batches:
            for batch in chunks(whole, "text"):
                words = Words(batch.column("text"), NOT_ALPHANUMERIC, lower=True)
                df += np.bincount(_found(words, terms)[1], minlength=len(terms))
                filled += int(np.count_nonzero(words.counts))
                total += len(words.start)
        seen = np.flatnonzero(df)
        place = pa.array([None, *seen.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([place, pa.array([filled, *df[seen]], pa.int64()), pa.array([total, *np.zeros_like(seen)], pa.int64())], names=["place", "n", "total"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "place long, n long, total long")
    df = np.zeros(len(wanted), np.int64)
    filled = total = 0
    # one row a wanted term, at most as many as the block has
    for r in rows.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        if r.place is None:
            filled, total = r.n, r.total
        else:
            df[r.place] = r.n
    return filled, total, df


def term_weights(filled: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * filled + 2) / (2 * df + 1))).astype(np.int64)


def _length_factors(n: np.ndarray, filled: int, total: int) -> np.ndarray:
    if len(n) and 75 * int(n.max()) * filled >= 1 << 63:
        return np.array([25 + 75 * int(x) * filled // total for x in n], np.int64)
    return 25 + 75 * n * filled // total


class _Best:
    """The best documents of each item so far: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, np.int64)  # a score has to be above 0
        self.rows = np.zeros((4, 0), np.int64)  # item, score, id is null, id
        self.waiting: list[np.ndarray] = []

    def add(self, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.waiting.append(np.stack([item, scores[item, doc], missing[doc], ids[doc]]))
        if sum(part.shape[1] for part in self.waiting) > 4 * self.top * len(self.least):
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.waiting], axis=1)
        self.waiting = []
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], np.arange(len(self.least) + 1))
        place = np.arange(rows.shape[1]) - first[rows[0]]
        self.rows = rows[:, place < self.top]
        full = np.flatnonzero(np.diff(first) >= self.top)
        self.least[full] = rows[1, first[full] + self.top - 1]
        return self.rows


def _accumulated(graph: SharedTerms, row: np.ndarray, place: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The score of each item (rows) for each document (columns)."""
    sums = np.zeros((graph.size, rows), np.int64)
    many = graph.first[place + 1] - graph.first[place]
    entry = ragged(graph.first[place], many)
    np.add.at(sums, (graph.leaf[entry], np.repeat(row, many)), np.repeat(value, many) * graph.times[entry])
    at = graph.leaves
    for pairs in graph.rounds:
        sums[at : at + len(pairs)] = sums[pairs[:, 0]] + sums[pairs[:, 1]]
        at += len(pairs)
    return np.add.reduceat(sums[graph.nodes], graph.begin[:-1], axis=0)


def _search_block(docs: DataFrame, id_column: str, text: str, graph: SharedTerms, weights: np.ndarray, filled: int, total: int, top: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((graph, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights = shared.value
        best = _Best(len(graph.items), top)
        at_once = max(1, ACCUMULATORS // graph.size)
        for whole in batches:
            for part in chunks(whole, "text"):
                for low in range(0, part.num_rows, at_once):
                    batch = part.slice(low, at_once)
                    words = Words(batch.column("text"), NOT_ALPHANUMERIC, lower=True)
                    row, place, tf = _found(words, graph.term)
                    m = _length_factors(words.counts.astype(np.int64), filled, total)
                    value = weights[place] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                    ids = batch.column("id")
                    missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                    best.add(_accumulated(graph, row, place, value, words.rows), missing, ids.fill_null(0).to_numpy())
        item, score, missing, ids = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(graph.items[item]), pa.array(ids, mask=missing.astype(bool)), pa.array(score)], names=["item", "id", "score"]
        )

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(search, "item long, id long, score long")


def search_items(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_column: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``top`` documents of each item: the item's id, ``rank``, the document's id and ``score``.

    Only scores above 0 count; equal scores are ranked by id, null ids last.
    Null and empty texts have no terms and are neither found nor counted. Each
    row of ``items`` is searched on its own, also where ids repeat or are null,
    and so is each row of ``docs``; rows alike in id and score get different
    ranks. Document ids are whole numbers. Other columns are not passed on.
    """
    numbered = items.select(F.col(item).alias("_id"), F.col(item_text).alias("text"))
    numbered = write_through(numbered.withColumn("item", F.monotonically_increasing_id()))
    terms = write_through(item_terms(numbered))
    blocks = -(-terms.count() // block_terms)
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))))
    found = docs.sparkSession.createDataFrame([], "item long, id long, score long")
    for number in range(blocks):
        rows = terms.where(F.col("block") == number).drop("block").toArrow()  # about block_terms rows
        if not rows.num_rows:
            continue
        graph = share_terms(*(rows.column(c).to_numpy() for c in ("item", "term", "n")))
        filled, total, df = corpus_counts(docs, text, graph.term)
        if total:
            part = _search_block(docs, id_column, text, graph, term_weights(filled, df), filled, total, top)
            found = part if blocks == 1 else found.unionByName(write_through(part))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = best.join(numbered.select("item", "_id"), "item")
    return named.select(F.col("_id").alias(item), "rank", F.col("id").alias(id_column), "score")


ORACLE = f"""
WITH terms AS (
    SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
    UNION ALL
    SELECT 'i', item_id, row_number() OVER (), unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) FROM benchmark
), lengths AS (
    SELECT row, count(*) AS n FROM terms WHERE side = 'd' GROUP BY row
), corpus AS (
    SELECT count(*) AS filled, sum(n)::BIGINT AS total FROM lengths
), postings AS (
    SELECT row, id, term, count(*) AS tf FROM terms WHERE side = 'd' GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(filled) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
    FROM postings, corpus GROUP BY term
), wanted AS (
    SELECT row AS item, id AS item_id, term, count(*) AS repeats FROM terms WHERE side = 'i' GROUP BY ALL
), scores AS (
    SELECT item, item_id, row, postings.id AS doc_id,
        sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * filled) // total))))::BIGINT AS score
    FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (row), corpus
    GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
