"""Registry of named queries: a Spark callable over a data folder and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flickpulse.plans.casts import with_casts
from flickpulse.plans.views import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as bigint, floats rounded, dates as text: one spelling of values on both engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(key: str, sql: str | None = None, recursive: bool = False, digits: int = 6):
    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Tables(spark, sf_dir)), digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        assert key not in QUERIES, key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_casts(key, oracle(sql, recursive))
        return fn

    return wrap
