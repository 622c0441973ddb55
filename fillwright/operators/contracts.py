"""Accepted and rejected rows, and checks that raise.

Row operators that can refuse a row add a ``reject_reason`` column instead of
failing the job; :func:`accepted` and :func:`rejected` are its two sides. The
``check_*`` functions run a small job and raise; ``checked`` tests inside the
plan and costs no extra pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASON = "reject_reason"


def accepted(df: DataFrame, reason: str = REASON) -> DataFrame:
    return df.filter(F.col(reason).isNull()).drop(reason)


def rejected(df: DataFrame, reason: str = REASON) -> DataFrame:
    return df.filter(F.col(reason).isNotNull())


def reason_when(*cases: tuple[Column, str]) -> Column:
    """The text of the first case that holds, else null."""
    expr = None
    for cond, text in cases:
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return expr.otherwise(F.lit(None).cast("string"))


def checked(value: Column, cond: Column, message: str) -> Column:
    """``value``, or an error when ``cond`` is not true for the row."""
    return F.when(cond, value).otherwise(F.raise_error(F.lit(message)))


def _raise_if_any(df: DataFrame, bad: Column, message: str) -> None:
    # one aggregate over all partitions at once; looking for a first row would
    # go through a table without any in rounds
    if df.agg(F.max(F.coalesce(bad, F.lit(True)))).first()[0]:
        raise ValueError(message)


def check_same_count(a: DataFrame, b: DataFrame) -> int:
    """Both tables have as many rows; returns that number."""
    left, right = a.agg(F.count("*")).first()[0], b.agg(F.count("*")).first()[0]
    if left != right:
        raise ValueError(f"row counts differ: {left} and {right}")
    return left


def parallel(a: str, b: str) -> Column:
    """Arrays ``a`` and ``b`` are there and have the same length."""
    return F.size(a).eqNullSafe(F.size(b)) & F.col(a).isNotNull() & F.col(b).isNotNull()


def within_bound(ids: str, max_length: int, pad_to_max: bool = False) -> Column:
    """A padded row is no wider than ``max_length``, or exactly that wide if asked."""
    width = F.size(ids)
    return width == max_length if pad_to_max else width <= max_length


def check_parallel_lengths(df: DataFrame, a: str, b: str) -> None:
    """Arrays ``a`` and ``b`` have the same length in every row."""
    _raise_if_any(df, ~parallel(a, b), f"{a} and {b} differ in length")


def check_padding_bounds(
    df: DataFrame, ids: str, max_length: int, pad_to_max: bool = False
) -> None:
    """No padded row is wider than ``max_length``; all are that wide if asked."""
    bad = ~within_bound(ids, max_length, pad_to_max)
    _raise_if_any(df, bad, f"{ids} breaks the padding bound {max_length}")
