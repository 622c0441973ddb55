"""Connected components: of an edge table, and of candidates that are yet to be confirmed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwright.session import write_through

# Where an aggregate is joined back to its rows, it is stored first: both sides of
# the join are then plain shuffles, which the skew rule can split at a hot key.


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = write_through(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = write_through(down.groupBy("u").agg(F.min("v").alias("m")))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, one: str, other: str) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    Large-star and small-star steps alternate, for a number of rounds that grows with the
    logarithm of the longest path.
    A node with very many edges is one row per edge in a join that can be split,
    and one partial minimum per task. Each round is stored, which cuts the lineage.
    """
    links = edges.select(F.col(one).alias("u"), F.col(other).alias("v")).where("u <> v")
    now, before = write_through(_small_star(links).distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if mark == before:
            break
        before = mark
        now = write_through(_small_star(_large_star(now)).distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def least_joined(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows, the least row that the pairs join it to."""
    label = np.arange(n)
    while len(one):
        # the roots are tied, so that all rows below them follow
        first, second = label[one], label[two]
        np.minimum.at(label, np.maximum(first, second), np.minimum(first, second))
        while (label[label] != label).any():
            label = label[label]
        apart = label[one] != label[two]
        one, two = one[apart], two[apart]
    return label


def _labelled(postings: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return postings.withColumn("component", F.col("id"))
    return postings.join(known, postings["id"] == known["node"], "left").select("value", "id", F.coalesce("component", "id").alias("component"))


def open_postings(postings: DataFrame, known: DataFrame | None) -> DataFrame:
    """(value, id, component) under the values whose ids are not all in one component."""
    labelled = _labelled(postings, known)
    spread = labelled.groupBy("value").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    return labelled.join(write_through(spread.select("value")), "value", "left_semi")


def centre_pairs(labelled: DataFrame, turn: int = 0) -> DataFrame:
    """(a, b), a < b: each id with one centre of each of its values, another centre in each turn."""
    order = F.xxhash64(F.lit(turn), "id") if turn else F.col("id")
    centres = labelled.groupBy("value").agg(F.min_by(F.struct("id", "component"), order).alias("centre"))
    tied = labelled.join(write_through(centres), "value").where(F.col("component") != F.col("centre.component"))
    return tied.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b")).distinct()


# Ids under a value whose pairs are written out, at most 16 pairs an id.
FEW = 32


def linked_components(postings: DataFrame, confirm: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame], rounds: int = 6) -> DataFrame | None:
    """(node, component) of the ids that links join, or None if there are no links.

    ``postings`` (value, id) name the candidates: two ids under one value.
    ``confirm`` takes pairs (a, b), a < b, and returns those that are links;
    ``compare`` takes (value, id) rows and returns pairs that join all ids which
    links join under a value.

    Each round ties what is posted under a value to one centre of it, another
    in each round, and drops the values whose ids are in one component. It goes
    on while that merges components and more pairs are open than there are
    postings. Then the pairs of values with up to ``FEW`` ids are confirmed, and
    the ids of larger values, which are alike and yet not linked, are compared
    in blocks without writing a pair. So rows grow with the postings, and no
    candidate pair across components is left.
    """
    edges, known, open_before = None, None, None
    for number in range(rounds + 1):
        labelled = write_through(open_postings(postings, known))
        parts = labelled.groupBy("value", "component").agg(F.count("*").alias("n"))
        whole = parts.groupBy("value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inner"))
        total, pairs_open = whole.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("inner")) / 2)).first()
        if not total:
            return known
        last = number == rounds or pairs_open <= 2 * total or pairs_open == open_before
        open_before = pairs_open
        if last:
            sizes = write_through(labelled.groupBy("value").agg(F.count("*").alias("n")))
            sized = write_through(labelled.join(sizes, "value"))
            few = sized.where(F.col("n") <= FEW).drop("n")
            a, b = few.alias("a"), few.alias("b")
            met = (F.col("a.value") == F.col("b.value")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component"))
            pairs = a.join(b, met).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
        else:
            pairs = centre_pairs(labelled, number)
        found = confirm(pairs)
        if last:
            found = found.union(compare(sized.where(F.col("n") > FEW).select("value", "id")))
        found = write_through(found)
        edges = found if edges is None else edges.union(found)
        if last or not found.isEmpty():
            known = write_through(components(edges, "a", "b"))
        if last:
            return known
        postings = labelled.select("value", "id")
    return known
