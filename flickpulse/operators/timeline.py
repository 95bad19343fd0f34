"""Posting timelines: excitation, self-exciting fits, bursts, regions.

A timeline is cut into fixed pieces of time. All row-level windows run inside (key, piece), so an author with a third
of all posts is spread over as many tasks as there are pieces; what crosses a border is one summary row per piece.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.operators import scale


@dataclass(frozen=True)
class Kernel:
    """Exponential kernel: decay per time unit, the unit in microseconds, and the clock resolution."""

    beta: float
    unit_us: int
    resolution_us: int = 1

    @property
    def piece_us(self) -> int:
        return int(6.0 / self.beta * self.unit_us)  # decay over a piece is e^-6, so nothing overflows inside it


HOURLY = Kernel(beta=3.0, unit_us=3_600_000_000, resolution_us=1_000_000)
PER_MINUTE = Kernel(beta=0.1, unit_us=60_000_000)


def excitation(posts: DataFrame, keys: list[str], kernel: Kernel) -> DataFrame:
    """Add ``excite``: the sum over earlier posts j of exp(-beta * (t - t_j)), rows ordered by (us, post_id)."""
    piece = kernel.piece_us
    rate = kernel.beta / kernel.unit_us
    p = (posts.filter(F.col("us").isNotNull())
         .withColumn("us", F.col("us") - F.col("us") % kernel.resolution_us)
         .withColumn("piece", scale.bucket_of("us", piece))
         .withColumn("offset", F.col("us") - F.col("piece") * piece))
    reach = scale.steps_within(745.0, kernel.beta * piece / kernel.unit_us)  # e^-745 is the smallest double
    sums = p.groupBy(*keys, "piece").agg(
        F.sum(F.exp((F.col("offset") - F.lit(piece)) * F.lit(rate))).alias("at_end"))
    near = F.collect_list(F.struct("piece", "at_end")).over(
        W.partitionBy(*keys).orderBy("piece").rangeBetween(-reach, -1))  # at most `reach` elements
    carried = sums.withColumn("near", near).select(*keys, "piece", F.aggregate(
        "near", F.lit(0.0), lambda acc, e: acc + e["at_end"] * F.exp(
            (e["piece"] + 1 - F.col("piece")) * F.lit(piece * rate))).alias("carried"))
    before = F.coalesce(F.sum(F.exp(F.col("offset") * F.lit(rate))).over(
        W.partitionBy(*keys, "piece").orderBy("us", "post_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return (p.withColumn("before", before).join(carried, [*keys, "piece"])
            .withColumn("excite", F.exp(-F.col("offset") * F.lit(rate)) * (F.col("carried") + F.col("before")))
            .drop("piece", "offset", "before", "carried"))


def _pull(line: dict[str, Column], x: Column, a: Column) -> Column:
    """One post's term of the log-likelihood slope along mu = m0 + m1*x, alpha = a0 + a1*x."""
    return (line["m1"] + line["a1"] * a) / (line["m0"] + line["m1"] * x + (line["a0"] + line["a1"] * x) * a)


def _level(line: dict[str, Column]) -> Column:
    return line["m1"] * F.col("span") + line["a1"] * F.col("mass")


def _root_by_passes(rows: DataFrame, state: DataFrame, keys: list[str], line: dict[str, Column], low: Column,
                    high: Column, name: str, reciprocal: bool = False, together: int = 6, most: int = 64) -> DataFrame:
    """Zero of the falling slope in [low, high], or the end it lies beyond: Newton's steps kept inside a bracket.

    Each pass sums the slope and its derivative at every key's point over all its rows, so only sums are shuffled.
    ``together`` passes make one job; jobs follow until every key has settled (a bracket halves at least, so ``most``
    passes always do). Where all terms are positive (``reciprocal``), the steps are those of the equation 1/sum = 1/level,
    which is nearly a straight line.
    """
    excites = rows.select(*keys, "excite")
    s = state.withColumn("low", low.cast("double")).withColumn("high", high.cast("double"))
    carried = [c for c in s.columns if c not in keys]
    a, point = F.col("excite"), F.col("x")
    derivative = -F.pow(_pull(line, point, a), 2)

    def met(s):  # the small side is hashed, so the posts are not sorted again in every pass
        return excites.join(s.hint("shuffle_hash"), keys).groupBy(*keys)

    ends = met(s).agg(
        *[F.max(c).alias(c) for c in carried],
        F.sum(_pull(line, F.col("low"), a)).alias("at_low"), F.sum(_pull(line, F.col("high"), a)).alias("at_high"))
    s = ends.select(*keys, *carried, ((F.col("at_low") <= _level(line)) | (F.col("at_high") >= _level(line))).alias("settled"),
                    F.when(F.col("at_low") <= _level(line), F.col("low")).when(F.col("at_high") >= _level(line), F.col("high"))
                    .otherwise((F.col("low") + F.col("high")) / 2).alias("x"))
    s = scale.stage(s)
    found, s = s.filter("settled"), s.filter("not settled")
    for done in range(most):
        if done % together == 0 and s.isEmpty():  # only keys that have not settled meet their posts again
            break
        sums = met(s).agg(
            *[F.max(c).alias(c) for c in [*carried, "settled", "x"]], F.sum(_pull(line, point, a)).alias("f"), F.sum(derivative).alias("d"))
        slope = F.col("f") - _level(line)
        step = F.col("slope") / F.col("d") * (F.col("f") / _level(line) if reciprocal else F.lit(1.0))
        s = (sums.withColumn("slope", slope).withColumn("low", F.when(F.col("slope") > 0, point).otherwise(F.col("low")))
             .withColumn("high", F.when(F.col("slope") > 0, F.col("high")).otherwise(point))
             .withColumn("newton", point - step))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        moved = F.when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        # at the root a step is lost in rounding and ends on the bracket's border: that is no reason to bisect again
        still = F.least(F.abs(moved - point), F.abs(F.col("newton") - point)) <= 1e-10 * F.abs(point) + 1e-12
        s = s.select(*keys, *carried, (F.col("settled") | still).alias("settled"), F.when(F.col("settled") | (still & ~inside), point).otherwise(moved).alias("x"))
        if (done + 1) % together == 0:
            s = scale.stage(s)
            found, s = found.unionByName(s.filter("settled")), s.filter("not settled")
    return found.unionByName(s).withColumn(name, point).drop(*{"low", "high", "settled", "x"} - {name})


def hawkes_fit(posts: DataFrame, keys: list[str], kernel: Kernel, bounded_mu: bool = True) -> DataFrame:
    """Maximum-likelihood background rate ``mu`` and excitation ``alpha`` of every key at once, decay fixed.

    With the decay fixed the likelihood is concave. At its maximum mu*span + alpha*mass equals the number of posts, so
    a search on alpha alone is enough: mu = (n - alpha*mass) / span. If that leaves the allowed box
    (0 <= alpha < beta, 1e-9 <= mu <= 10n/max(span, 1)), the maximum lies on the face that was crossed, and is again a
    search in one variable. All keys are solved alike, by passes of grouped sums over all rows. Posts that already have
    their ``excite`` of this kernel are not excited again.
    """
    rows = (posts if "excite" in posts.columns else scale.stage(
        excitation(posts.select(*keys, "us", "post_id"), keys, kernel))).select(*keys, "us", "post_id", "excite")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ((F.max("us") - F.min("us")) / F.lit(kernel.unit_us)).alias("span"),
        F.max_by("excite", F.struct("us", "post_id")).alias("last_excite"))
    stats = scale.stage(stats.withColumn("mass", (F.col("n") - F.col("last_excite") - 1) / kernel.beta))
    cap = kernel.beta - 1e-9
    mu_top = (10.0 * F.col("n") / F.greatest("span", F.lit(1.0))) if bounded_mu else F.lit(float("inf"))
    fit = stats.filter((F.col("n") >= 2) & (F.col("span") > 1e-9))

    profile = {"m0": F.col("n") / F.col("span"), "m1": -F.col("mass") / F.col("span"), "a0": F.lit(0.0),
               "a1": F.lit(1.0)}
    top = F.least(F.lit(cap), (F.col("n") - 1e-9 * F.col("span")) / F.col("mass"))
    x = _root_by_passes(rows, fit, keys, profile, F.lit(0.0), top, "x")
    mu_of = F.greatest((F.col("n") - F.col("x") * F.col("mass")) / F.col("span"), F.lit(1e-9))
    x = x.withColumn("mu_x", mu_of).withColumn("mu_top", mu_top)
    x = scale.stage(x.withColumn("face", F.when(F.col("x") >= F.lit(cap * (1 - 1e-12)), "cap")
                                 .when(F.col("mu_x") > F.col("mu_top"), "top").otherwise("none")))
    solved = x.filter("face = 'none'").select(*keys, "n", "span", F.col("mu_x").alias("mu"), F.col("x").alias("alpha"))
    # the search has a point x of its own, and sums of a text column would be made by sorting
    edge = x.filter("face <> 'none'").withColumn("on_cap", F.col("face") == "cap").drop("x", "face")
    if not edge.isEmpty():
        # on the cap of alpha the search is for mu, on the top of mu for alpha
        on_cap = F.col("on_cap")
        face = {"m0": F.when(on_cap, 0.0).otherwise(F.col("mu_top")), "m1": F.when(on_cap, 1.0).otherwise(0.0),
                "a0": F.when(on_cap, F.lit(cap)).otherwise(0.0), "a1": F.when(on_cap, 0.0).otherwise(1.0)}
        mu_high = F.when(F.col("mu_top") < float("inf"), F.col("mu_top")).otherwise(F.col("n") / F.col("span"))
        found = _root_by_passes(rows, edge, keys, face, F.when(on_cap, 1e-9).otherwise(0.0),
                                F.when(on_cap, mu_high).otherwise(F.lit(cap)), "y", reciprocal=True)
        solved = solved.unionByName(found.select(*keys, "n", "span", F.when(on_cap, F.col("y")).otherwise(F.col("mu_top")).alias("mu"),
                                                 F.when(on_cap, F.lit(cap)).otherwise(F.col("y")).alias("alpha")))
    # too few posts or no spread: alpha is not identifiable
    flat = stats.filter(~((F.col("n") >= 2) & (F.col("span") > 1e-9))).select(
        *keys, "n", "span", F.when(F.col("n") >= 2, F.col("n") / F.greatest("span", F.lit(1.0))).otherwise(0.0)
        .alias("mu"), F.lit(0.0).alias("alpha"))
    return solved.unionByName(flat).withColumn("branching_ratio", F.col("alpha") / kernel.beta)


def spikes(posts: DataFrame, keys: list[str], fits: DataFrame, kernel: Kernel) -> DataFrame:
    """Per post: spike = alpha * excitation, intensity = mu + spike, and its level. An ``excite`` of this kernel is used again."""
    e = (posts if "excite" in posts.columns else excitation(posts, keys, kernel)).join(fits.select(*keys, "mu", "alpha"), keys)
    spike = F.col("alpha") * F.col("excite")
    level = (F.when(spike >= 0.7 * F.col("alpha"), F.lit("HIGH")).when(spike >= 0.3 * F.col("alpha"), F.lit("MEDIUM"))
             .when(spike > 0, F.lit("LOW")).otherwise(F.lit("NONE")))
    return (e.withColumn("spike", spike).withColumn("intensity", F.col("mu") + F.col("spike"))
            .withColumn("level", F.when(F.col("alpha") > 0, level).otherwise(F.lit("NONE"))))


def interarrival(posts: DataFrame, keys: list[str], piece_us: int = 86_400_000_000) -> DataFrame:
    """Minutes since the key's previous post."""
    p = posts.filter(F.col("us").isNotNull()).withColumn("piece", scale.bucket_of("us", piece_us))
    return (scale.lag_split(p, keys, ["us", "post_id"], "piece", "us", "previous_us")
            .withColumn("gap_minutes", (F.col("us") - F.col("previous_us")) / 60_000_000.0).drop("piece"))


def bursts(posts: DataFrame, keys: list[str], window_us: int = 600_000_000, at_least: int = 3) -> DataFrame:
    """``burst``: the largest 10-minute count (3 or more) of which the post is part, else 0.

    A window opens at each post that has a keyword. Time is cut into blocks of one window's length, so a window ends in
    the block after the one it opens in. Each post therefore also stands in the next block, one window later, and both
    the posts ahead and the largest window still open are running values there: no post looks at all posts near it.
    """
    columns, up_to = [c for c in posts.columns if c not in keys], (W.unboundedPreceding, W.currentRow)
    own, us = scale.bucket_of("us", window_us), F.col("us")
    at = lambda block, time, side: F.struct(block.alias("block_"), time.alias("time_"), F.lit(side).alias("side_"))
    post = F.col("side_") == 1
    only = lambda cond, c: F.when(cond, F.col(c)).alias(c)

    # side 0 marks a post in its own block, side 1 is the post where its window ends
    ends = posts.filter(us.isNotNull()).withColumn("at_", F.explode(F.array(at(own, us, 0), at(own + 1, us + window_us, 1))))
    ends = ends.select(*keys, "at_.*", *columns).select(*keys, "block_", "time_", "side_", *[only(post, c) for c in columns])
    block = W.partitionBy("block_", *keys)
    in_time = block.orderBy("time_", "side_", "post_id").rowsBetween(*up_to)
    opens = F.coalesce(F.length("keyword"), F.lit(0)) > 0
    counted = (ends.withColumn("place_", F.count(F.when(post, 1)).over(in_time))
               .withColumn("seen_", F.count(F.when(~post, 1)).over(in_time))
               .withColumn("ahead_", F.count(F.when(post, 1)).over(block) - F.col("place_") + 1 + F.col("seen_")).filter(post)
               .withColumn("ahead_", F.when(opens & (F.col("ahead_") >= at_least), F.col("ahead_")))
               .select(*keys, *columns, "place_", "ahead_"))

    # side 0 is a window of the block before where it ends, side 1 the post in its own block
    open_ = counted.withColumn("at_", F.explode(F.array_compact(F.array(
        at(own, us, 1), F.when(F.col("ahead_").isNotNull(), at(own + 1, us + window_us, 0))))))
    open_ = open_.select(*keys, "at_.*", *columns, "place_", "ahead_").select(
        *keys, "block_", "time_", "side_", "place_", "ahead_", *[only(post, c) for c in columns])
    backwards = block.orderBy(F.desc("time_"), "side_").rowsBetween(*up_to)
    forwards = block.orderBy("time_", "side_", "place_").rowsBetween(*up_to)
    before = F.max(F.when(~post, F.col("ahead_"))).over(backwards)
    # equal-time rows: a window covers only rows from its own position on
    inside = F.max(F.when(post, F.col("ahead_"))).over(forwards)
    return (open_.withColumn("before_", before).withColumn("inside_", inside).filter(post)
            .withColumn("burst", F.coalesce(F.greatest("before_", "inside_"), F.lit(0))).select(*posts.columns, "burst"))


def burst_regions(marked: DataFrame, keys: list[str], piece_us: int = 3_600_000_000) -> DataFrame:
    """Runs of consecutive in-burst posts: start, end, minutes, posts, largest burst, first keyword.

    Runs are found inside each piece; the first and last run of neighbouring non-empty pieces are then chained when the
    posts on both sides of the border are in a burst.
    """
    m = (marked.withColumn("piece", scale.bucket_of("us", piece_us)).withColumn("inside", F.col("burst") > 0))
    order = W.partitionBy(*keys, "piece").orderBy("us", "post_id")
    starts = F.col("inside") & ~F.coalesce(F.lag("inside").over(order), F.lit(False))
    runs = m.withColumn("starts", starts.cast("int")).withColumn(
        "run", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    at = F.struct("us", "post_id")
    edges = runs.groupBy(*keys, "piece").agg(
        F.min_by("inside", at).alias("first_in"), F.max_by("inside", at).alias("last_in"),
        F.max("run").alias("last_run"), F.min("inside").alias("all_in"))
    along = W.partitionBy(*keys).orderBy("piece")
    links = F.col("first_in") & F.coalesce(F.lag("last_in").over(along), F.lit(False))
    # breaks passed up to the first run of each piece number the chains
    cut_inside = F.when(F.col("all_in"), 0).otherwise(1)
    chained = (edges.withColumn("cut_before", F.when(links, 0).otherwise(1)).withColumn("cut_inside", cut_inside)
               .withColumn("first_chain", F.sum("cut_before").over(along.rowsBetween(W.unboundedPreceding, 0))
                           + F.coalesce(F.sum("cut_inside").over(along.rowsBetween(W.unboundedPreceding, -1)),
                                        F.lit(0)))
               .withColumn("last_chain", F.col("first_chain") + F.col("cut_inside"))
               .select(*keys, "piece", "first_in", "last_in", "last_run", "first_chain", "last_chain"))
    chain = (F.when(F.col("first_in") & (F.col("run") == 1), F.struct(F.col("first_chain").alias("c"), F.lit(0).alias("r"),
                                                                     F.lit(None).cast("bigint").alias("p")))
             .when(F.col("last_in") & (F.col("run") == F.col("last_run")),
                   F.struct(F.col("last_chain").alias("c"), F.lit(0).alias("r"), F.lit(None).cast("bigint").alias("p")))
             .otherwise(F.struct(F.lit(-1).cast("bigint").alias("c"), F.col("run").cast("int").alias("r"),
                                 F.col("piece").alias("p"))))
    first_kw = F.min_by("keyword", F.when(F.col("keyword").isNotNull(), at))
    return (runs.filter("inside").join(chained, [*keys, "piece"]).withColumn("chain", chain)
            .groupBy(*keys, "chain").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n_posts"),
        F.max("burst").alias("peak"), *([F.max("spike").alias("peak_spike")] if "spike" in marked.columns else []),
        first_kw.alias("keyword"))
            .withColumn("minutes", (F.col("end_us") - F.col("start_us")) / 60_000_000.0).drop("chain"))


def weibull_fit(gaps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rank regression of a Weibull: ranks count all rows, only positive values enter the line."""
    ranks = scale.value_ranks(gaps, value, tuple(keys))
    # all members of a tie, in order: positions n_before+1 .. n_before+n_equal
    # (large ties are cut into chunks that spread over the cluster)
    chunk = 10_000
    first, last = F.col("n_before") + 1, F.col("n_before") + F.col("n_equal")
    rows = (ranks.filter(F.col(value) > 0).withColumn("from_i", F.explode(F.sequence(first, last, F.lit(chunk))))
            .repartition(*keys, value, "from_i")
            .withColumn("i", F.explode(F.sequence(F.col("from_i"), F.least(F.col("from_i") + chunk - 1, last)))))
    x = F.log(value)
    y = F.log(-F.log(1 - (F.col("i") - 0.3) / (F.col("n_total") + 0.4)))
    fit = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("shape"), F.regr_intercept(y, x).alias("level"),
                                  F.max("n_total").alias("n"))
    return fit.filter(F.col("shape").isNotNull()).withColumn("scale", F.exp(-F.col("level") / F.col("shape"))).drop(
        "level")


def shelf_life(fits: DataFrame, share: float = 0.10) -> DataFrame:
    """First grid time after the mode where the density is at most ``share`` of its peak; step max(0.1, scale/1000).

    Infinite when shape <= 1 or when not reached within 100 scales. Density falls after the mode, so the crossing is
    bisected and then snapped up to the grid.
    """
    k, lam = F.col("shape"), F.col("scale")

    def density(t):  # in units of the scale
        return k * F.pow(t, k - 1) * F.exp(-F.pow(t, k))

    mode = F.pow((k - 1) / k, 1 / k)
    goal = density(mode) * share

    def halve(s, _):
        mid = (s["low"] + s["high"]) / 2
        return F.when(density(mid) > goal, F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), mid.alias("high")))

    cross = F.aggregate(F.sequence(F.lit(1), F.lit(60)),
                        F.struct(mode.alias("low"), F.lit(100.0).alias("high")), halve)["high"]
    step = F.greatest(F.lit(0.1), lam / 1000) / lam
    snapped = mode + F.ceil((cross - mode) / step - 1e-9) * step
    return fits.withColumn("shelf_life", F.when((k <= 1) | (snapped > 100), F.lit(float("inf")))
                           .otherwise(snapped * lam))


def super_spreader(fits: DataFrame, threshold: float) -> DataFrame:
    return fits.withColumn("super_spreader", F.col("alpha") > threshold)


def half_life(kernel: Kernel) -> float:
    return math.log(2.0) / kernel.beta
