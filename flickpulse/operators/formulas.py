"""Named formulas over any numeric columns. Cells that are null or not numeric are ignored; where a formula has no
finite value the row carries a note instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import scale


def number(c: str) -> Column:
    v = F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return F.when(~F.isnan(v), v)


def _long(one: DataFrame, values: dict[str, Column], empty: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("formula"), v.cast("double").alias("value")) for n, v in values.items()])
    rows = one.select(F.explode(cells).alias("c")).select("c.formula", "c.value")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return rows.select("formula", F.when(~bad, F.col("value")).alias("value"), F.when(bad, F.lit(empty)).alias("issue"))


def statistics(df: DataFrame, column: str, percentiles: dict[str, float] | None = None) -> DataFrame:
    """count, sum, mean, min, max, std_dev, variance (sample), median and percentiles by the (n+1)p rule."""
    v = df.select(number(column).alias("v")).filter("v IS NOT NULL")
    one = v.agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.avg("v").alias("m"), F.min("v").alias("lo"),
                F.max("v").alias("hi"), F.coalesce(F.stddev_samp("v"), F.when(F.count("v") == 1, 0.0)).alias("sd"),
                F.coalesce(F.var_samp("v"), F.when(F.count("v") == 1, 0.0)).alias("var"))
    some = {n: F.when(F.col("n") > 0, F.col(c)) for n, c in (
        ("count", "n"), ("sum", "s"), ("mean", "m"), ("min", "lo"), ("max", "hi"), ("std_dev", "sd"), ("variance", "var"))}
    wanted = {"median": 0.5, **(percentiles or {})}
    q = scale.exact_quantiles(v, "v", wanted, rule="n_plus_1")
    return _long(one, some, "no numeric values").unionByName(_long(q, {n: F.col(n) for n in wanted}, "no numeric values"))


def weighted_average(df: DataFrame, value: str, weight: str) -> DataFrame:
    v, w = number(value), number(weight)
    both = df.select(v.alias("v"), w.alias("w")).filter("v IS NOT NULL AND w IS NOT NULL")
    one = both.agg(F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum("w").alias("w"))
    return _long(one, {"weighted_average": F.when(F.col("w") != 0, F.col("vw") / F.col("w"))}, "weights sum to zero")


def growth(df: DataFrame, value: str, order: list[str], periods: float | None = None) -> DataFrame:
    """growth_rate (last - first) / first and cagr (last / first)^(1/periods) - 1 in the given order."""
    v = df.select(number(value).alias("v"), F.struct(*order).alias("o")).filter("v IS NOT NULL")
    one = v.agg(F.min_by("v", "o").alias("a"), F.max_by("v", "o").alias("b"), F.count("v").alias("n"))
    p = F.lit(float(periods)) if periods is not None else (F.col("n") - 1).cast("double")
    ok = (F.col("n") >= 2) & (F.col("a") != 0)
    return _long(one, {"growth_rate": F.when(ok, (F.col("b") - F.col("a")) / F.col("a")),
                       "cagr": F.when(ok & (p > 0) & (F.col("b") / F.col("a") > 0),
                                      F.pow(F.col("b") / F.col("a"), 1 / p) - 1)}, "needs two values and a non-zero first")


def paired(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.select(number(x).alias("x"), number(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    one = both.agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.corr("x", "y").alias("c"))
    return _long(one, {"regression_slope": F.col("s"), "regression_intercept": F.col("i"), "correlation": F.col("c")},
                 "not enough spread")


def expression(results: DataFrame, name: str, text: str) -> DataFrame:
    """Arithmetic over earlier results (formula, value); names and functions are checked first."""
    names = [r["formula"] for r in results.select("formula").collect()]  # a few named results
    wide = results.groupBy().pivot("formula", names).agg(F.first("value"))
    return _long(wide, {name: C.checked_expression(text, names)}, "no finite value")
