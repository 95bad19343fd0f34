"""Structured Streaming forms of the refresh jobs. Each takes a streaming posts DataFrame with event time ``ts``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import engagement as E
from flickpulse.operators import timeline as TL
from flickpulse.sources import files


def daily_reach(posts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Keyword reach per day; rows later than the watermark are dropped, closed days are emitted once."""
    return (posts.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), F.lower("keyword").alias("keyword"), "platform")
            .agg(F.sum(E.reach()).alias("total_reach"), F.count(F.lit(1)).alias("post_count"))
            .select(F.unix_micros("window.start").alias("day_us"), "keyword", "platform", "total_reach", "post_count"))


def sliding_tone(posts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Seven-day tone counts, moved day by day."""
    t = C.tone("sentiment_score")
    return (posts.filter(F.col("sentiment_score") != 0).withWatermark("ts", delay)
            .groupBy(F.window("ts", "7 days", "1 day"), "platform")
            .agg(F.count(F.when(t == "positive", 1)).alias("positive"), F.count(F.when(t == "negative", 1)).alias("negative"))
            .select(F.unix_micros("window.start").alias("start_us"), "platform", "positive", "negative"))


def burst_sessions(posts: DataFrame, gap: str = "10 minutes", at_least: int = 3, delay: str = "1 day") -> DataFrame:
    """Sessions of posts less than ``gap`` apart. A session follows the gap rule, so it is not the burst of the batch
    operator, which follows a span rule."""
    return (posts.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "author")
            .agg(F.count(F.lit(1)).alias("n_posts")).filter(F.col("n_posts") >= at_least)
            .select("author", F.unix_micros("session_window.start").alias("start_us"), "n_posts"))


def dedupe(posts: DataFrame, delay: str = "1 day") -> DataFrame:
    return posts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["platform", "post_id"])


def excitation(posts: DataFrame, kernel: TL.Kernel) -> DataFrame:
    """Running excitation per author, carried from batch to batch as (last time, value).

    Rows of one author in one micro-batch are put in time order; a row older than the carried time counts from that
    time on, since the state cannot be taken back.
    """
    rate = kernel.beta / kernel.unit_us

    def step(key, frames: Iterator[pd.DataFrame], state):
        last, level = state.get if state.exists else (None, 0.0)
        batch = pd.concat(list(frames)).sort_values(["us", "post_id"])
        out = []
        for t in batch["us"]:
            level = level * math.exp(-rate * max(t - last, 0)) if last is not None else 0.0
            out.append(level)
            level, last = level + 1.0, t if last is None else max(t, last)
        state.update((int(last), float(level)))
        yield pd.DataFrame({"author": key[0], "post_id": batch["post_id"].to_numpy(), "excite": out})

    return (posts.select("author", "us", "post_id").groupBy("author").applyInPandasWithState(
        step, "author string, post_id long, excite double", "last long, level double", "append", "NoTimeout"))


def upsert_totals(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch: add the batch's per-author totals to the published table. A repeated batch id changes nothing."""
    spark = batch.sparkSession
    new = batch.groupBy("author").agg(F.count(F.lit(1)).alias("n_posts"), F.sum(E.reach()).alias("total_reach"))
    if files._exists(spark, path):
        old = files.read_published(spark, path)
        done = old.agg(F.max("batch_id").alias("b")).first()["b"]
        if done is not None and done >= batch_id:
            return
        new = old.select("author", "n_posts", "total_reach").unionByName(new).groupBy("author").agg(
            F.sum("n_posts").alias("n_posts"), F.sum("total_reach").alias("total_reach"))
    files.publish(new.withColumn("batch_id", F.lit(batch_id)), path)


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run a stream over all available data into files in the shared folder, and read the result."""
    path = files.shared_folder(spark)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", path + "/out")
         .option("checkpointLocation", path + "/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out")


def run_for_each_batch(stream: DataFrame, spark: SparkSession, handle) -> str:
    """Run a stream over all available data through a batch function ``handle(batch, id, path)``; returns the path."""
    path = files.shared_folder(spark)
    q = (stream.writeStream.foreachBatch(lambda df, i: handle(df, i, path + "/out"))
         .option("checkpointLocation", path + "/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return path + "/out"
