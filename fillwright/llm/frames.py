"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def with_fields(df: DataFrame, *fields: StructField) -> StructType:
    """The columns of ``df`` followed by ``fields``; an input column named like a field gives way."""
    new = {field.name.lower() for field in fields}
    return StructType([f for f in df.schema.fields if f.name.lower() not in new] + list(fields))


def kept_columns(df: DataFrame, *fields: StructField) -> list[str]:
    new = {field.name.lower() for field in fields}
    return [c for c in df.columns if c.lower() not in new]


def set_aside(df: DataFrame, *fields: StructField) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns named like a field under other names, and what brings
    its columns back, as they were and without the fields, once those are used."""
    new = {field.name.lower() for field in fields}
    other = {c: f"_aside_{i}" for i, c in enumerate(df.columns) if c.lower() in new}
    columns = df.columns

    def back(result: DataFrame) -> DataFrame:
        return result.drop(*new).withColumnsRenamed({name: c for c, name in other.items()}).select(*[f"`{c}`" for c in columns])

    return df.withColumnsRenamed(other), back
