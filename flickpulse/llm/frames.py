"""Columns of operators that hand on their input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def without(docs: DataFrame, names: str) -> DataFrame:
    """``docs`` without columns that have the name of a result or working column, in whatever case: those are replaced."""
    return docs.drop(*names.split())


def extended(docs: DataFrame, more: str) -> StructType:
    """The schema of ``docs`` with the columns of a DDL string after it."""
    return StructType(docs.schema.fields + StructType.fromDDL(more).fields)


def own(docs: DataFrame) -> list[str]:
    """The columns of ``docs``, quoted: names may hold dots."""
    return ["`" + name.replace("`", "``") + "`" for name in docs.columns]


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names; those with dots or quotes have others on the way."""
    odd = {name: f"odd{i}_" for i, name in enumerate(df.columns) if "." in name or "`" in name}
    plain = StructType([StructField(odd.get(f.name, f.name), f.dataType, f.nullable) for f in schema.fields])
    return df.toDF(*[odd.get(name, name) for name in df.columns]).mapInArrow(run, plain).toDF(*schema.names)
