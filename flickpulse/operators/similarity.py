"""Similarity joins: trigram matching with exact blocking, nearest vectors, look-alikes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import scale


def trigram_pairs(left: DataFrame, right: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """All pairs of distinct texts (``text`` / ``other``) of a block with trigram similarity >= ``threshold``.

    Two sets with Jaccard >= t must share one of the first n - ceil(t*n) + 1 grams in any common order. Grams are
    ordered from rare to frequent, and texts meet only on such a rare gram: no pair is lost, and texts that share
    frequent grams only are never compared. Copies of a text are one text here.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(df):
        texts = df.select(*block, "text").distinct().filter(F.size(C.trigrams("text")) > 0)
        return scale.stage(texts.withColumn("id", F.monotonically_increasing_id()))  # staged, so the ids stay

    a, b = side(left), side(right)
    each = lambda df: df.select(F.explode(C.trigrams("text")).alias("gram"))
    counts = each(a).unionAll(each(b)).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # the place of each gram in the order: from here on a gram is a small number
    order = scale.stage(scale.value_ranks(counts.select(F.struct("df", "gram").alias("v")), "v").select(
        "v.gram", F.col("n_before").cast("int").alias("g")))

    def ordered(df):
        # a text's grams stay where its row was put, so that grouping them again shuffles nothing
        rows = (df.repartition(parts, "id").select("id", *block, "text", F.explode(C.trigrams("text")).alias("gram"))
                .join(order, "gram"))
        return scale.stage(rows.groupBy("id", *block, "text").agg(F.sort_array(F.collect_list("g")).alias("o")))

    def prefixes(df, key, n, at, before):
        size = (F.size("o") - F.ceil(F.size("o") * threshold - 1e-9) + 1).cast("int")
        return (df.select(F.col("id").alias(key), *block, F.size("o").alias(n), F.slice("o", F.lit(1), size).alias("p"))
                .select(key, *block, n, "p", F.posexplode("p").alias(at, "g"))
                .select(key, *block, n, at, "g", F.slice("p", F.lit(1), F.col(at)).alias(before)))

    # sizes of files say little of rows that are exploded from them, so nothing here is broadcast by them
    x, y = ordered(a), ordered(b)
    met = prefixes(x, "id", "n", "i", "p").hint("merge").join(prefixes(y, "other_id", "m", "j", "q"), [*block, "g"])
    n, m, i, j = F.col("n"), F.col("m"), F.col("i"), F.col("j")
    near_size = (n >= m * threshold - 1e-9) & (m >= n * threshold - 1e-9)
    # with the first shared gram at positions i and j, at most this many grams can be shared
    enough = F.least(n - i, m - j) >= (n + m) * (threshold / (1 + threshold)) - 1e-9
    # a pair meets on every shared prefix gram and is kept on the first one only, so nothing is left to deduplicate
    once = met.filter(near_size & enough).filter(~F.arrays_overlap("p", "q")).select("id", "other_id")
    texts = x.select("id", *block, "text", "o")
    others = y.select(F.col("id").alias("other_id"), F.col("text").alias("other"), F.col("o").alias("other_o"))
    return (once.hint("merge").join(texts, "id").hint("merge").join(others, "other_id")
            .withColumn("similarity", C.trigram_similarity("o", "other_o"))
            .filter(F.col("similarity") >= threshold).select(*block, "text", "other", "similarity"))


def retweet_match(posts: DataFrame, threshold: float = 0.6, compared: int = 40,
                  piece_us: int = 86_400_000_000) -> DataFrame:
    """Each retweet with its most similar earlier original by the quoted handle (latest, then smallest id, on ties).

    The platform cuts quoted texts, so the definition compares the first ``compared`` characters of both sides.
    """
    quoted = C.retweet_handle("text")
    cut = F.when(quoted.isNotNull(), F.substring(C.retweet_body("text"), 1, compared)).otherwise(
        F.substring("text", 1, compared))
    # one scan of the texts; everything after works on the short narrow rows
    narrow = scale.stage(posts.select("post_id", "us", quoted.isNotNull().alias("is_rt"), cut.alias("text"), F.when(
        quoted.isNotNull(), C.normalize_author(quoted)).otherwise(C.normalize_author("author")).alias("handle"))
        .filter(F.col("handle").isNotNull()))
    rts = (narrow.filter("is_rt").filter(F.trim("text") != "")
           .select(F.col("post_id").alias("rt_id"), F.col("us").alias("rt_us"), "handle", "text"))
    originals = narrow.filter("NOT is_rt").select("post_id", "us", "handle", "text")
    pairs = trigram_pairs(rts, originals, ["handle"], threshold)
    wanted = rts.join(pairs, ["handle", "text"]).drop("text")
    found = scale.asof_prior(
        wanted.withColumnRenamed("other", "text"),
        originals.select("handle", "text", "us", (-F.col("post_id")).alias("tie"), "post_id"),
        ["handle", "text"], "rt_us", "us", F.struct("us", "post_id"), "original", piece_us, tie="tie", strict=True)
    order = W.partitionBy("rt_id").orderBy(F.desc("similarity"), F.desc("original.us"), F.col("original.post_id"))
    return (found.filter(F.col("original").isNotNull()).withColumn("rn", F.row_number().over(order))
            .filter(F.col("rn") == 1).select("rt_id", F.col("original.post_id").alias("original_id"), "similarity"))


def share_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.col("original_id").alias("post_id")).agg(F.count(F.lit(1)).alias("shares"))


def fuzzy_title_join(external: DataFrame, catalog: DataFrame, threshold: float = 0.35) -> DataFrame:
    """External title -> best catalogue title; years must agree when the external year is known.

    external: ext_id, name, year; catalog: cat_id, name, year. Ties go to the smallest (name, cat_id).
    """
    ext = external.filter(F.trim("name") != "").withColumnRenamed("name", "text")
    cat = catalog.select("cat_id", F.col("name").alias("text"), "year")
    # files of names that repeat are far smaller than their rows, so Spark would broadcast too much by their size
    copies = scale.stage(cat.groupBy("text", "year").agg(F.min("cat_id").alias("cat_id")))
    dated = (trigram_pairs(ext.filter("year IS NOT NULL").select("year", "text"), copies.select("year", "text"),
                           ["year"], threshold)
             .hint("merge").join(copies.withColumnRenamed("text", "other"), ["other", "year"]))
    undated = (trigram_pairs(ext.filter("year IS NULL").select("text"), copies.select("text"), [], threshold)
               .hint("merge").join(copies.groupBy(F.col("text").alias("other")).agg(F.min("cat_id").alias("cat_id")), "other"))
    best = F.min_by(F.struct("similarity", "other", "cat_id"), F.struct(-F.col("similarity"), "other", "cat_id"))
    with_year = dated.groupBy("year", "text").agg(best.alias("m"))
    without = undated.groupBy("text").agg(best.alias("m"))
    out = (ext.filter("year IS NOT NULL").hint("merge").join(with_year, ["year", "text"]).select("ext_id", "m.*")
           .unionByName(ext.filter("year IS NULL").hint("merge").join(without, "text").select("ext_id", "m.*")))
    return out.withColumnRenamed("other", "matched_name")


# ---- vectors -------------------------------------------------------------------------------------------------------
def nearest_neighbors(queries: DataFrame, pool: DataFrame, k: int, block_rows: int = 2048,
                      skip_self: bool = True) -> DataFrame:
    """Exact top-``k`` cosine neighbours of every query inside its group: id, neighbor_id, similarity.

    queries, pool: id, grp, vec. A group is cut into blocks of about ``block_rows`` vectors; a task multiplies one
    query block with one pool block and emits only the k best of each query, and the k best over the blocks remain.
    """
    def cut(df, n_name, b_name):
        sizes = df.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias(n_name))
        return (df.join(sizes, "grp").withColumn(b_name, F.pmod(F.xxhash64("id"), F.col(n_name)))), sizes

    q, q_sizes = cut(queries.select("id", "grp", "vec"), "nq", "qb")
    p, p_sizes = cut(pool.select("id", "grp", "vec"), "np", "pb")
    q = q.join(p_sizes, "grp").withColumn("pb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("np") - 1)))
    p = p.join(q_sizes, "grp").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    keys = ["grp", "qb", "pb"]
    p = p.select(*keys, "id", "vec").toDF("p_grp", "p_qb", "p_pb", "p_id", "p_vec")

    def unit(vectors):
        m = np.array(vectors.tolist(), dtype=np.float64)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1.0)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "neighbor_id": [], "similarity": []})
        lid, rid = left["id"].to_numpy(), right["p_id"].to_numpy()
        sims = unit(left["vec"]) @ unit(right["p_vec"]).T
        if skip_self:
            sims[lid[:, None] == rid[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(rid, sims.shape), -sims), axis=1)[:, :k]
        top = np.take_along_axis(sims, order, axis=1)
        ok = np.isfinite(top)
        return pd.DataFrame({"id": np.repeat(lid, ok.sum(axis=1)), "neighbor_id": rid[order[ok]], "similarity": top[ok]})

    parts = (q.select(*keys, "id", "vec").groupBy(*keys).cogroup(p.groupBy("p_grp", "p_qb", "p_pb"))
             .applyInPandas(best, "id long, neighbor_id long, similarity double"))
    w = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbor_id")
    return parts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def franchise_flag(names: DataFrame) -> DataFrame:
    """Distinct titles with whether their stem or prefix is shared by another title."""
    d = names.select("name").distinct().withColumn("stem", C.franchise_stem("name")).withColumn(
        "prefix", C.title_prefix("name"))
    stems = d.groupBy("stem").agg(F.count(F.lit(1)).alias("n_stem"))
    prefixes = d.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_prefix"))
    return (d.join(stems, "stem").join(prefixes, "prefix")
            .select("name", "stem", "prefix", ((F.col("n_stem") >= 2) | (F.col("n_prefix") >= 2)).alias("franchise")))


def raw_novelty(queries: DataFrame, pool: DataFrame, k: int, min_others: int = 5, skip_self: bool = True) -> DataFrame:
    """1 - mean cosine to the k nearest of the same genre, or of the whole corpus when the genre is too small."""
    sizes = pool.groupBy(F.col("genre").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    q = queries.select("id", F.col("genre").alias("grp"), "vec").join(sizes, "grp", "left")
    others = F.coalesce(F.col("n"), F.lit(0)) - (1 if skip_self else 0)
    own, wide = q.filter(others >= min_others).drop("n"), q.filter(others < min_others).drop("n")
    by_genre = pool.select("id", F.col("genre").alias("grp"), "vec")
    near = nearest_neighbors(own, by_genre, k, skip_self=skip_self)
    if not wide.isEmpty():
        near = near.unionByName(nearest_neighbors(wide.withColumn("grp", F.lit("*")),
                                                  by_genre.withColumn("grp", F.lit("*")), k, skip_self=skip_self))
    mean = near.groupBy("id").agg((1 - F.avg("similarity")).alias("raw"))
    return queries.join(mean, "id", "left").withColumn("raw", F.coalesce("raw", F.lit(1.0)))


def narrative_novelty(corpus: DataFrame, k: int = 10, penalty: float = 0.7, own_pool: int = 20,
                      band=(0.30, 0.45)) -> DataFrame:
    """corpus: id, name, genre, vec -> raw novelty (x0.7 in a franchise) and its percentile in the genre's pool."""
    flags = franchise_flag(corpus)
    sizes = corpus.groupBy("genre").agg(F.count(F.lit(1)).alias("n_genre"))
    scored = (raw_novelty(corpus, corpus, k).drop("vec").join(flags.select("name", "franchise"), "name")
              .join(sizes, "genre").withColumn("raw", F.col("raw") * F.when(F.col("franchise"), penalty).otherwise(1.0))
              .withColumn("pool", F.when(F.col("n_genre") >= own_pool, F.col("genre")).otherwise(F.lit("*small*"))))
    scored = scale.stage(scored)
    out = scale.with_percentile(scored, "raw", "pct", scale.lower_percentile(), ("pool",))
    return out.withColumn("novelty", F.lit(band[0]) + F.col("pct") * (band[1] - band[0]))


# ---- look-alikes ---------------------------------------------------------------------------------------------------
def tfidf(aspects: DataFrame, n_profiles) -> DataFrame:
    """aspects: user, aspect, value (non-zero) -> weight = value * (ln((n+1)/(df+1)) + 1)."""
    df = aspects.groupBy("aspect").agg(F.count(F.lit(1)).alias("df"))
    return aspects.join(df, "aspect").withColumn(
        "weight", F.col("value") * (F.log((n_profiles + 1) / (F.col("df") + 1)) + 1.0))


def lookalikes(seeds: DataFrame, profiles: DataFrame, aspects: DataFrame, sentiment: DataFrame, min_posts: int = 5,
               weights=(0.5, 0.3, 0.2)) -> DataFrame:
    """Score all same-tribe candidates of each seed; blocks without data drop out of the weighted mean.

    seeds: user; profiles: user, tribe_label, moi_score, total_posts; aspects: user, aspect, value;
    sentiment: user, platform, sentiment_category, share. The seed list is small; its rows meet the candidates on
    tribe, on aspect, and on (platform, category).
    """
    stats = scale.stage(profiles.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("moi_score").alias("sd")))
    n, sd = stats.select("n").scalar(), stats.select("sd").scalar()
    w = scale.stage(tfidf(aspects.filter(F.col("value") != 0), n))
    norms = w.groupBy("user").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    s = profiles.join(seeds, "user", "left_semi").select(F.col("user").alias("seed"), "tribe_label",
                                                         F.col("moi_score").alias("seed_moi"))
    pairs = (profiles.filter(F.col("total_posts") >= min_posts).join(s, "tribe_label").filter("user <> seed")
             .select("seed", "user", "tribe_label", "moi_score", "seed_moi"))
    seed_w = w.join(seeds, "user", "left_semi").select(F.col("user").alias("seed"), "aspect",
                                                       F.col("weight").alias("seed_weight"))
    dots = w.join(seed_w, "aspect").groupBy("seed", "user").agg(F.sum(F.col("weight") * F.col("seed_weight")).alias("dot"))
    topic = (pairs.select("seed", "user").join(norms, "user")
             .join(norms.withColumnRenamed("user", "seed").withColumnRenamed("norm", "seed_norm"), "seed")
             .join(dots, ["seed", "user"], "left").filter((F.col("norm") > 0) & (F.col("seed_norm") > 0))
             .select("seed", "user", (F.coalesce("dot", F.lit(0.0)) / (F.col("norm") * F.col("seed_norm"))).alias("topic_sim")))
    # Hellinger: sum((sqrt p - sqrt q)^2) = 2 - 2 * sum(sqrt(p*q)) for distributions that sum to 1
    seed_s = sentiment.join(seeds, "user", "left_semi").withColumnRenamed("user", "seed").withColumnRenamed("share", "q")
    has = sentiment.select("user", "platform").distinct()
    seed_has = seed_s.select("seed", "platform").distinct()
    overlap = sentiment.join(seed_s, ["platform", "sentiment_category"]).groupBy("seed", "user", "platform").agg(
        F.sum(F.sqrt(F.col("share") * F.col("q"))).alias("bc"))
    both = pairs.select("seed", "user").join(has, "user").join(seed_has, ["seed", "platform"])
    hell = 1 - F.sqrt(F.greatest(1 - F.coalesce("bc", F.lit(0.0)), F.lit(0.0)))
    mood = both.join(overlap, ["seed", "user", "platform"], "left").groupBy("seed", "user").agg(
        F.avg(hell).alias("sentiment_sim"))
    sigma = F.when(sd > 1e-9, sd).otherwise(1.0)
    j = (pairs.join(topic, ["seed", "user"], "left").join(mood, ["seed", "user"], "left")
         .withColumn("moi_sim", C.gaussian_kernel(F.col("seed_moi") - F.col("moi_score"), sigma)))
    wt, ws, wm = weights
    has_t, has_s = F.col("topic_sim").isNotNull(), F.col("sentiment_sim").isNotNull()
    total = F.when(has_t, wt).otherwise(0.0) + F.when(has_s, ws).otherwise(0.0) + wm
    acc = (F.coalesce(F.col("topic_sim") * wt, F.lit(0.0)) + F.coalesce(F.col("sentiment_sim") * ws, F.lit(0.0))
           + F.col("moi_sim") * wm)
    return j.withColumn("similarity", acc / total).drop("seed_moi")


def lookalikes_l2(seeds: DataFrame, profiles: DataFrame, aspects: DataFrame, sentiment: DataFrame,
                  n_aspects: int = 500) -> DataFrame:
    """1 / (1 + L2) between z-scored vectors of (MOI, top aspects, platform sentiment shares); missing cells are 0.

    Kept sparse: with z = (v - m) / s, the squared distance is a sum over the few dimensions where either side is
    non-zero; a pair's cells meet on the dimension name.
    """
    top = (aspects.groupBy("aspect").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "aspect").limit(n_aspects))
    cells = (profiles.select("user", F.lit("moi").alias("dim"), F.col("moi_score").alias("v"))
             .unionByName(aspects.join(top.select("aspect"), "aspect", "left_semi").select(
                 "user", F.concat(F.lit("a:"), "aspect").alias("dim"), F.col("value").alias("v")))
             .unionByName(sentiment.select("user", F.concat_ws(":", F.lit("s"), "platform", "sentiment_category").alias(
                 "dim"), F.col("share").alias("v")))).filter("v <> 0")
    cells = scale.stage(cells.join(profiles.select("user"), "user", "left_semi"))
    n = scale.stage(profiles.agg(F.count(F.lit(1)).alias("n"))).scalar()
    mean, mean_sq = F.sum("v") / n, F.sum(F.col("v") * F.col("v")) / n
    dims = (cells.groupBy("dim").agg(mean.alias("m"), mean_sq.alias("m2"))
            .withColumn("sd", F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0))))
            .filter("sd > 1e-9").select("dim", "sd"))
    z = scale.stage(cells.join(dims, "dim").select("user", "dim", (F.col("v") / F.col("sd")).alias("z")))
    # the mean cancels in a difference: |a - b|^2 = |a|^2 + |b|^2 - 2ab over v / sd
    squares = z.groupBy("user").agg(F.sum(F.col("z") * F.col("z")).alias("sq"))
    s = z.join(seeds, "user", "left_semi").select(F.col("user").alias("seed"), "dim", F.col("z").alias("zs"))
    dots = z.join(s, "dim").groupBy("seed", "user").agg(F.sum(F.col("z") * F.col("zs")).alias("dot"))
    base = (profiles.select("user", "tribe_label")
            .join(profiles.join(seeds, "user", "left_semi").select(F.col("user").alias("seed"), "tribe_label"),
                  "tribe_label").filter("user <> seed"))
    seed_sq = squares.withColumnRenamed("user", "seed").withColumnRenamed("sq", "seed_sq")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    dist = F.sqrt(F.greatest(zero("sq") + zero("seed_sq") - 2 * zero("dot"), F.lit(0.0)))
    return (base.join(squares, "user", "left").join(seed_sq, "seed", "left").join(dots, ["seed", "user"], "left")
            .select("seed", "user", (1 / (1 + dist)).alias("similarity")))


def rank_movement(current: DataFrame, other: DataFrame, n: int) -> DataFrame:
    """Two rankings per seed side by side: users in both top-``n`` lists, places, and the move."""
    w = W.partitionBy("seed").orderBy(F.desc("similarity"), "user")
    top = lambda df, name: (df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
                            .select("seed", "user", name, F.col("similarity").alias(name + "_score")))
    return top(current, "place_a").join(top(other, "place_b"), ["seed", "user"]).withColumn(
        "moved", F.col("place_a") - F.col("place_b"))


