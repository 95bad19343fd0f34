"""Helpers that keep jobs whole and skew-safe: checkpoints, distributed ranks, exact quantiles, split timelines."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets its own folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="flickpulse-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, later steps survive lost executors
    and read only the columns they need. Shuffle files of the write are removed as soon as it is done."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def value_ranks(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact ranks of every distinct non-null value: ``by..., value, n_before, n_equal, n_total``.

    Equal values are counted first. The distinct values are then range-partitioned by (group, value), so a group that
    holds a third of the data is spread over many tasks; running counts inside a range are shifted by the sum of the
    earlier ranges of the group, of which there are at most as many as partitions.
    """
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_equal"))
    ranged = stage(counted.repartitionByRange(*[F.col(c) for c in by], F.col(value))
                   .withColumn("range_id", F.spark_partition_id()))
    keys = [F.col(c) for c in by] or [F.lit(0)]
    inside = W.partitionBy(*by, "range_id").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "range_id").agg(F.sum("n_equal").alias("range_n"))
    per_group = W.partitionBy(*keys)
    shifts = totals.select(
        *by, "range_id",
        F.coalesce(F.sum("range_n").over(per_group.orderBy("range_id").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("shift"),
        F.sum("range_n").over(per_group).alias("n_total"))
    return (ranged.withColumn("inside", F.coalesce(F.sum("n_equal").over(inside), F.lit(0)))
            .join(shifts, [*by, "range_id"])
            .select(*by, value, (F.col("inside") + F.col("shift")).alias("n_before"), "n_equal", "n_total"))


def mid_percentile() -> Column:
    """Ties at the midpoint of their group, in (0, 1)."""
    return (F.col("n_before") + F.col("n_equal") / 2) / F.col("n_total")


def average_percentile() -> Column:
    """Average rank of ties divided by n, in (0, 1]."""
    return (F.col("n_before") + (F.col("n_equal") + 1) / 2) / F.col("n_total")


def lower_percentile() -> Column:
    """Share of values strictly below."""
    return F.col("n_before") / F.col("n_total")


def with_percentile(df: DataFrame, value: str, out: str, rank: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Add the percentile ``rank`` of ``value`` (null stays null) as column ``out``."""
    ranks = value_ranks(df, value, by).select(*by, value, rank.alias(out))
    return df.join(ranks, [*by, value], "left")


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: tuple[str, ...] = (),
                    rule: str = "linear") -> DataFrame:
    """Exact quantiles per group, one column per entry of ``probabilities``.

    ``linear`` interpolates at (n-1)p, as ``percentile_cont`` does; ``n_plus_1`` at (n+1)p clipped to the extremes.
    """
    ranks = value_ranks(df, value, by)
    aggs = []
    for name, p in probabilities.items():
        if rule == "linear":
            pos = (F.col("n_total") - 1) * F.lit(float(p))
        else:
            raw = (F.col("n_total") + 1) * F.lit(float(p)) - 1
            pos = F.greatest(F.lit(0.0), F.least(raw, (F.col("n_total") - 1).cast("double")))
        low, high = F.floor(pos), F.ceil(pos)

        def at(index):
            hit = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n_equal"))
            return F.max(F.when(hit, F.col(value)))

        low_v, high_v, frac = at(low), at(high), F.max(pos - low)
        aggs.append((low_v + (high_v - low_v) * frac).alias(name))
    return ranks.groupBy(*by).agg(*aggs)


def scalar(df: DataFrame, column: str) -> Column:
    """The only row's value as a scalar subquery: no join, no broadcast of a relation."""
    return df.select(column).scalar()


def bucket_of(us: str, width_us: int) -> Column:
    return F.floor(F.col(us) / F.lit(width_us)).cast("long")


def lag_split(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """``lag(value)`` per key in ``order``, with the key's timeline split into ``bucket`` pieces.

    Only the last value of a piece travels to the next piece, so one busy key never becomes one task.
    """
    piece = W.partitionBy(*keys, bucket)
    last = (df.groupBy(*keys, bucket).agg(F.max_by(F.col(value), F.struct(*order)).alias("last_value"))
            .withColumn("carried", F.lag("last_value").over(W.partitionBy(*keys).orderBy(bucket)))
            .select(*keys, bucket, "carried"))
    rn = F.row_number().over(piece.orderBy(*order))
    return (df.withColumn("in_piece", F.lag(value).over(piece.orderBy(*order))).withColumn("rn_", rn)
            .join(last, [*keys, bucket], "left")
            .withColumn(out, F.when(F.col("rn_") == 1, F.col("carried")).otherwise(F.col("in_piece")))
            .drop("in_piece", "rn_", "carried"))


def asof_prior(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: Column,
               out: str, width: float, tie: str | None = None, strict: bool = False) -> DataFrame:
    """For each left row, ``value`` of the latest right row of the same key at or before (``strict``: before) its time.

    Backward as-of join without an inequality join: time is cut into pieces of ``width``; inside a piece both sides are
    merged and the last right value is carried down; between pieces only one row per (key, piece) is carried.
    """
    order_tie = [tie] if tie else []
    piece_of = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    r = right.select(*keys, F.col(right_time).alias("t_"), piece_of(right_time).alias("piece_"),
                     F.struct(F.col(right_time), *order_tie, value.alias("v")).alias("best_"))
    l = left.withColumn("t_", F.col(left_time)).withColumn("piece_", piece_of(left_time))
    carry = (r.groupBy(*keys, "piece_").agg(F.max("best_").alias("best_"))
             .unionByName(l.select(*keys, "piece_").distinct(), allowMissingColumns=True)
             .groupBy(*keys, "piece_").agg(F.max("best_").alias("best_"))
             .withColumn("carried_", F.last("best_", True).over(
                 W.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("piece_")
                 .rowsBetween(W.unboundedPreceding, -1)))
             .select(*keys, "piece_", "carried_"))
    # left rows sort after right rows of the same time, or before them when only strictly earlier ones count
    merged = (l.withColumn("side_", F.lit(0 if strict else 2))
              .unionByName(r.withColumn("side_", F.lit(1)), allowMissingColumns=True)
              .withColumn("seen_", F.max("best_").over(
                  W.partitionBy(*keys, "piece_").orderBy("t_", "side_")
                  .rowsBetween(W.unboundedPreceding, W.currentRow)))
              .filter(F.col("side_") != 1))
    return (merged.join(carry, [*keys, "piece_"], "left")
            .withColumn(out, F.coalesce("seen_", "carried_")["v"])
            .drop("t_", "piece_", "side_", "best_", "seen_", "carried_"))


def steps_within(span: float, width: float) -> int:
    return int(math.ceil(span / width)) + 1
