"""Revenue and disclosure models, audience clusters and recommendations on pyspark.ml."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import boosting, scale
from flickpulse.operators import titles as T

LABEL = "ln_revenue"
AT_ONCE = 8


def fold_of(key: str, folds: int) -> Column:
    """Fold from the row's key alone: the same on every run, executor and retry."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(folds)).cast("int")


def regressor(name: str, seed: int = 42):
    return {"ridge": LinearRegression(labelCol=LABEL, regParam=0.02, elasticNetParam=0.0),
            "gbt": GBTRegressor(labelCol=LABEL, maxIter=300, maxDepth=3, stepSize=0.05, checkpointInterval=20, seed=seed),
            "gbt_band": GBTRegressor(labelCol=LABEL, maxIter=150, maxDepth=3, stepSize=0.05, checkpointInterval=20, seed=seed),
            "gbt_band_fast": GBTRegressor(labelCol=LABEL, maxIter=50, maxDepth=3, stepSize=0.15, checkpointInterval=20, seed=seed),
            "forest": RandomForestRegressor(labelCol=LABEL, numTrees=20, maxDepth=7, seed=seed)}[name]


def standardise(features: list[str]) -> list:
    return [VectorAssembler(inputCols=features, outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]


def pipeline(features: list[str], stage, weight: str | None = None) -> Pipeline:
    """Assemble, standardise, fit. The scaler is fitted inside, so a fold never sees its own test rows."""
    if weight is not None:
        stage = stage.setWeightCol(weight)
    return Pipeline(stages=[*standardise(features), stage])


def fit_all(tasks: list[tuple[Pipeline, DataFrame]], at_once: int = AT_ONCE) -> list[PipelineModel]:
    """The fitted models in the order of ``tasks``, ``at_once`` of them at a time.

    A boosted model is hundreds of short jobs in a row, which leave executors idle; jobs of several models share them.
    """
    with ThreadPoolExecutor(at_once) as pool:
        spark = tasks[0][1].sparkSession
        return list(pool.map(inheritable_thread_target(spark)(lambda task: task[0].fit(task[1])), tasks))


def side_by_side(spark, calls: list) -> list:
    """The results of ``calls``, run at the same time: their jobs are short and would leave executors idle."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def boost(frame: DataFrame, features: list[str], weights: list[Column], stage) -> DataFrame:
    """``pipeline`` with the boosted ``stage`` for each of ``weights``, all fitted together: predictions ``p0``, ``p1``, ..."""
    scalers = fit_all([(Pipeline(stages=standardise(features)), frame.filter(w > 0)) for w in weights])
    return boosting.boosted(frame, features, LABEL, weights, stage,
                            standard=[(m.stages[-1].mean.toArray(), m.stages[-1].std.toArray()) for m in scalers])


def model_frame(titles: DataFrame, min_year: int = 1900) -> DataFrame:
    """Deduplicated titles with the plain numeric features, disclosed or not; unknown numbers become 0."""
    c = T.clean(titles)
    full = F.col("release_year") > min_year
    d = T.dedupe(c.filter(full & (F.col("budget") > 10_000)))
    zero = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n)
    disclosed = F.col("has_financials") & (F.col("revenue") >= 10_000)
    return d.select("title_id", "movie_key", "release_year", "market_is_home", "primary_genre", "language", "directors",
                    disclosed.cast("int").alias("disclosed"), F.when(disclosed, F.col("revenue")).alias("revenue"),
                    F.when(disclosed, F.log("revenue")).alias(LABEL), F.log("budget").alias("ln_budget"),
                    zero("runtime_mins"), zero("imdb_rating"), zero("trailer_days_to_release"),
                    F.log1p(F.coalesce("trailer_views", F.lit(0.0))).alias("ln_views"),
                    (F.col("release_year") - 1990).cast("double").alias("age"),
                    F.col("market_is_home").cast("double").alias("home"))


FEATURES = ["ln_budget", "runtime_mins", "imdb_rating", "trailer_days_to_release", "ln_views", "age", "home"]


# ---- accuracy ------------------------------------------------------------------------------------------------------
def error_share() -> Column:
    return F.abs(F.exp("prediction") - F.col("revenue")) / F.col("revenue")


def run_accuracy(predicted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n, shares within 20/30/50 % and the exact median absolute percentage error."""
    e = predicted.withColumn("err", error_share())
    within = [(100 * F.avg((F.col("err") <= p / 100).cast("double"))).alias(f"within_{p}") for p in (20, 30, 50)]
    shares = e.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *within)
    middle = scale.exact_quantiles(e, "err", {"median_error": 0.5}, by)
    if by:
        return shares.join(middle, list(by)).withColumn("median_error", 100 * F.col("median_error"))
    return shares.withColumn("median_error", 100 * scale.stage(middle).scalar())


def regression_metrics(predicted: DataFrame) -> DataFrame:
    """R2 and MAE on the log scale, MAPE on the original scale."""
    y, p = F.col(LABEL), F.col("prediction")
    return predicted.agg((1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2"),
                         F.avg(F.abs(y - p)).alias("mae"), (100 * F.avg(error_share())).alias("mape"))


# ---- out of fold ---------------------------------------------------------------------------------------------------
def oof_predict(frame: DataFrame, features: list[str], name: str = "ridge", folds: int = 5, weight: str | None = None):
    """Each row predicted by a model that never saw its fold."""
    f = frame.withColumn("fold", fold_of("title_id", folds))
    if isinstance(regressor(name), GBTRegressor):
        given = F.col(weight) if weight is not None else F.lit(1)
        said = boost(f, features, [F.when(F.col("fold") != k, given).otherwise(0) for k in range(folds)], regressor(name))
        return said.select(*f.columns, boosting.of_fold(folds).alias("prediction"))
    out = None
    models = fit_all([(pipeline(features, regressor(name), weight), f.filter(F.col("fold") != k)) for k in range(folds)])
    for k, model in enumerate(models):
        part = model.transform(f.filter(F.col("fold") == k)).drop("raw_features", "features")
        out = part if out is None else out.unionByName(part)
    return out


def compare_models(frame: DataFrame, features: list[str], names=("ridge", "forest", "gbt"), folds: int = 5,
                   keep: int = 3) -> DataFrame:
    """Candidates by median error, and a linear stack of the best ``keep`` fitted on their out-of-fold predictions."""
    preds = {n: scale.stage(oof_predict(frame, features, n, folds).select("title_id", "revenue", LABEL, "prediction"))
             for n in names}
    long = None
    for n, p in preds.items():
        part = p.withColumn("model", F.lit(n))
        long = part if long is None else long.unionByName(part)
    table = scale.stage(run_accuracy(long, ("model",)))
    best = [r["model"] for r in table.orderBy("median_error", "model").limit(keep).collect()]  # a few model rows
    wide = None
    for n in best:
        part = preds[n].select("title_id", F.col("prediction").alias("p_" + n))
        wide = part if wide is None else wide.join(part, "title_id")
    stacked = oof_predict(preds[best[0]].drop("prediction").join(wide, "title_id"), ["p_" + n for n in best], "ridge", folds)
    combined = run_accuracy(stacked.withColumn("model", F.lit("stack")), ("model",))
    both = table.unionByName(combined)
    return both.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("median_error", "model")))


def market_comparison(frame: DataFrame, features: list[str], folds: int = 5) -> DataFrame:
    """Home-only model, pooled model on all, and pooled model seen per market."""
    pooled = scale.stage(oof_predict(frame, features, "ridge", folds).select("market_is_home", "revenue", "prediction"))
    home = oof_predict(frame.filter("market_is_home = 1"), features, "ridge", folds).select("market_is_home", "revenue",
                                                                                           "prediction")
    label = lambda df, c: df.withColumn("setting", c).select("setting", "revenue", "prediction")
    rows = (label(home, F.lit("home only")).unionByName(label(pooled, F.lit("pooled"))).unionByName(
        label(pooled, F.concat(F.lit("pooled, market "), F.col("market_is_home").cast("string")))))
    return run_accuracy(rows, ("setting",))


# ---- disclosure ----------------------------------------------------------------------------------------------------
def disclosure_frame(titles: DataFrame) -> DataFrame:
    """Every deduplicated title with what is known before its release, and whether its financials were disclosed.

    Budget and revenue make the label and ratings come after release, so neither is a feature.
    """
    d = scale.stage(T.dedupe(T.clean(titles).filter(F.col("release_year").isNotNull())))
    stem = C.franchise_stem("movie_name")
    stems = d.groupBy(stem.alias("stem")).agg((F.count(F.lit(1)) >= 2).cast("double").alias("franchise_flag"))
    prior = T.director_prior_releases(d).select("title_id", F.log1p(F.col("director_prior_releases").cast("double")).alias("ln_director_prior"))
    return (d.withColumn("stem", stem).join(stems, "stem").join(prior, "title_id", "left")
            .select("title_id", "primary_genre", "language", "country", "franchise_flag",
                    (F.col("release_year") - 1990).cast("double").alias("age"),
                    F.coalesce("ln_director_prior", F.lit(0.0)).alias("ln_director_prior"),
                    (F.col("has_financials") & (F.col("revenue") >= 10_000)).cast("int").alias("disclosed")))


def disclosure_model(frame: DataFrame, folds: int = 5, buckets: int = 20):
    """P(financials disclosed) for the full corpus, out of fold; AUC picks logistic regression or boosted trees."""
    f = frame
    cats = {"primary_genre": "genre_bucket", "language": "language_bucket", "country": "country_bucket"}
    for c, out in cats.items():
        f = T.top_k_bucket(f, c, buckets, out)
    f = scale.stage(f.withColumn("label", F.col("disclosed").cast("double")).withColumn("fold", fold_of("title_id", folds)))
    numbers = ["age", "franchise_flag", "ln_director_prior"]
    stages = {"logistic": LogisticRegression(regParam=0.01, maxIter=50), "boosted": GBTClassifier(maxIter=200, maxDepth=3, stepSize=0.05, checkpointInterval=20, seed=42)}

    encode = [StringIndexer(inputCols=list(cats.values()), outputCols=[c + "_i" for c in cats.values()], handleInvalid="keep"),
              OneHotEncoder(inputCols=[c + "_i" for c in cats.values()], outputCols=[c + "_v" for c in cats.values()]),
              VectorAssembler(inputCols=numbers + [c + "_v" for c in cats.values()], outputCol="features")]

    def oof(stage):
        out = None
        models = fit_all([(Pipeline(stages=encode + [stage]), f.filter(F.col("fold") != k)) for k in range(folds)])
        for k, m in enumerate(models):
            part = m.transform(f.filter(F.col("fold") == k)).select(
                "title_id", "label", "rawPrediction", vector_to_array("probability")[1].alias("p_disclosed"))
            out = part if out is None else out.unionByName(part)
        return out

    def oof_boosted(stage):
        values = {c: [r[0] for r in f.filter(F.col(c).isNotNull()).groupBy(c).count()  # at most buckets + 1 names
                      .orderBy(F.desc("count"), c).collect()] for c in cats.values()}
        said = boosting.boosted(f.select("title_id", "label", "fold", *numbers, *cats.values()), numbers, "label",
                                [(F.col("fold") != k).cast("int") for k in range(folds)], stage, True, values)
        margin = boosting.of_fold(folds)
        return said.select("title_id", "label", margin.alias("rawPrediction"),
                           (1 / (1 + F.exp(-2 * margin))).alias("p_disclosed"))

    found = side_by_side(f.sparkSession, [lambda: oof(stages["logistic"]), lambda: oof_boosted(stages["boosted"])])
    tried = {n: scale.stage(p) for n, p in zip(stages, found)}
    auc = {n: BinaryClassificationEvaluator().evaluate(p) for n, p in tried.items()}
    best = max(sorted(auc), key=auc.get)
    return tried[best].select("title_id", "label", "p_disclosed").withColumn("model", F.lit(best)).withColumn(
        "auc", F.lit(float(auc[best])))


def ipw_weights(scored: DataFrame, low: float = 1.0, high: float = 20.0) -> DataFrame:
    """clip(1/p); an unknown probability takes the median."""
    middle = scale.stage(scale.exact_quantiles(scored, "p_disclosed", {"m": 0.5})).scalar()
    p = C.clamp(F.coalesce("p_disclosed", "m"), 1e-3, 1.0)
    return scored.withColumn("m", middle).withColumn("weight", C.clamp(1 / p, low, high)).drop("m")


def compare_weighting(frame: DataFrame, weights: DataFrame, features: list[str], folds: int = 5) -> DataFrame:
    """Accuracy with and without the weights; the winner has more rows within 30 %, then the lower median error."""
    f = scale.stage(frame.join(weights.select("title_id", "weight"), "title_id"))
    plain = run_accuracy(oof_predict(f, features, "ridge", folds).withColumn("setting", F.lit("unweighted")), ("setting",))
    weighted = run_accuracy(oof_predict(f, features, "ridge", folds, "weight").withColumn("setting", F.lit("weighted")),
                            ("setting",))
    both = plain.unionByName(weighted)
    return both.withColumn("winner", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(
        F.desc("within_30"), "median_error", F.desc("setting"))) == 1)


# ---- bootstrap -----------------------------------------------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit mixing, so that the random weight of (row, replicate) depends on nothing else."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


POISSON_STEPS = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def bootstrap_coefficients(frame: DataFrame, features: list[str], replicates: int = 400, alpha: float = 2.0) -> DataFrame:
    """p10, p50, p90 of the standardised ridge coefficients over Poisson(1) resamples, and clipped multipliers.

    A task turns its rows into the sums X'WX and X'Wy of all replicates; only those sums are shuffled, and each
    replicate is a small linear system. The weights come from the row key, so a retried task repeats them.
    """
    d = len(features) + 1
    cells = d * d + d
    stats = frame.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    cols = [((F.col(c) - float(stats["m_" + c])) / float(stats["s_" + c] or 1.0)).alias(c) for c in features]
    rows = frame.select(F.xxhash64("title_id").alias("h"), F.col(LABEL).alias("y"), *cols)

    def sums(frames):
        total = np.zeros((replicates, cells))
        steps = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for pdf in frames:
            x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(float)])
            with np.errstate(over="ignore"):
                u = _mix(pdf["h"].to_numpy().astype(np.int64).view(np.uint64)[:, None] + steps)
            w = np.searchsorted(POISSON_STEPS, (u >> np.uint64(11)).astype(float) / 2.0 ** 53, side="right")
            outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)
            total += w.T.astype(float) @ np.hstack([outer, x * pdf["y"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"replicate": np.repeat(np.arange(replicates), cells), "cell": np.tile(np.arange(cells), replicates),
                            "v": total.ravel()})

    cell_sums = (rows.mapInPandas(sums, "replicate int, cell int, v double").groupBy("replicate", "cell")
                 .agg(F.sum("v").alias("v")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:  # one replicate: d*d + d sums
        v = pdf.sort_values("cell")["v"].to_numpy()
        penalty = np.eye(d) * alpha
        penalty[0, 0] = 0.0
        beta = np.linalg.solve(v[:d * d].reshape(d, d) + penalty, v[d * d:])
        return pd.DataFrame({"feature": features, "coefficient": beta[1:]})

    fits = cell_sums.groupBy("replicate").applyInPandas(solve, "feature string, coefficient double")
    q = fits.groupBy("feature").agg(*[F.percentile("coefficient", p).alias(n) for n, p in (  # one value per replicate
        ("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])
    return q.withColumn("multiplier", C.clamp("p50", 0.3, 1.6))


def poisson_weight(key: str, replicate: int) -> Column:
    """A Poisson(1) number from the row's key: the inverse of the distribution at a hashed uniform number."""
    u = F.pmod(F.xxhash64(key, F.lit(replicate)), F.lit(1 << 52)) / float(1 << 52)
    return sum((u >= float(step)).cast("double") for step in POISSON_STEPS)


def confidence_band(frame: DataFrame, disclosure: DataFrame, features: list[str], replicates: int = 30, name: str = "gbt",
                    folds: int = 5, resampled: str = "gbt_band") -> DataFrame:
    """The out-of-fold prediction with half the p90-p10 spread of resampled models, widened for titles unlikely to be
    disclosed; an unknown probability takes the median."""
    base = scale.stage(frame.select("title_id", LABEL, *features))

    def resample():
        if isinstance(regressor(resampled), GBTRegressor):
            weights = [poisson_weight("title_id", i).cast("tinyint") for i in range(replicates)]
            return boost(base, features, weights, regressor(resampled))
        out = base
        models = fit_all([(pipeline(features, regressor(resampled), "w"),
                           base.withColumn("w", poisson_weight("title_id", i)).filter("w > 0")) for i in range(replicates)])
        for i, model in enumerate(models):
            out = model.transform(out).withColumnRenamed("prediction", f"p{i}").drop("raw_features", "features")
        return out

    centre, out = side_by_side(base.sparkSession, [
        lambda: oof_predict(base, features, name, folds).select("title_id", "prediction"), resample])
    spread = F.array_sort(F.array(*[F.col(f"p{i}") for i in range(replicates)]))
    at = lambda q: F.element_at(spread, int(round(q * (replicates - 1))) + 1)
    known = disclosure.select("title_id", "p_disclosed")
    middle = scale.stage(scale.exact_quantiles(known, "p_disclosed", {"m": 0.5})).scalar()
    j = (out.select("title_id", ((at(0.9) - at(0.1)) / 2).alias("half")).join(centre, "title_id").join(known, "title_id", "left")
         .withColumn("p", F.coalesce("p_disclosed", middle, F.lit(0.5))))
    wide = F.col("half") * (1.6 - 0.9 * F.col("p"))
    return j.select("title_id", "prediction", "half", (F.col("prediction") - wide).alias("low"),
                    (F.col("prediction") + wide).alias("high"))


def partial_dependence(frame: DataFrame, model: PipelineModel, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Mean prediction with a factor at its maximum minus at its minimum, per unit of the band."""
    settings = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.lit(float(v)).alias("set_to"), F.lit(e).alias("end"))
                                   for n, (lo, hi) in bands.items() for v, e in ((lo, 0), (hi, 1))])).alias("s")
    grid = frame.select(*[F.col(c) for c in frame.columns], settings)
    for n in bands:
        grid = grid.withColumn(n, F.when(F.col("s.factor") == n, F.col("s.set_to")).otherwise(F.col(n)))
    p = model.transform(grid).groupBy(F.col("s.factor").alias("factor")).agg(
        (F.avg(F.when(F.col("s.end") == 1, F.col("prediction"))) - F.avg(F.when(F.col("s.end") == 0, F.col("prediction"))))
        .alias("effect"))
    width = F.element_at(F.create_map(*[x for n, (lo, hi) in bands.items() for x in (F.lit(n), F.lit(float(hi - lo)))]),
                         F.col("factor"))
    return p.withColumn("per_unit", F.col("effect") / width)


def formula_reconstruct(banded: DataFrame, bands: dict[str, tuple[float, float]], multipliers: dict[str, float],
                        key: str = "title_id", baseline: str = "baseline") -> DataFrame:
    """ln Y = baseline + sum of ln(1 + delta), each delta moved into its band scaled by the clipped multiplier."""
    total = F.col(baseline)
    for n, (lo, hi) in bands.items():
        m = min(max(multipliers.get(n, 1.0), 0.3), 1.6)
        new_lo, new_hi = min(lo * m, hi * m), max(lo * m, hi * m)
        share = C.clamp((F.col(n) - lo) / (hi - lo)) if abs(hi - lo) >= 1e-9 else F.lit(0.0)
        total = total + F.log1p(new_lo + share * (new_hi - new_lo))
    return banded.select(key, total.alias("ln_prediction"))


def predict_upcoming(history: DataFrame, upcoming: DataFrame, features: list[str], path: str) -> DataFrame:
    """Fit on the disclosed history, save, load, and score new rows whose revenue is treated as unknown."""
    pipeline(features, regressor("ridge")).fit(history.filter(F.col(LABEL).isNotNull())).write().overwrite().save(path)
    return PipelineModel.load(path).transform(upcoming.withColumn("revenue", F.lit(None).cast("double"))).select(
        "title_id", "movie_key", "release_year", F.exp("prediction").alias("predicted_revenue"))


def backtest_page(predictions: DataFrame, page: int, size: int) -> DataFrame:
    """Predicted against actual, newest first, one page."""
    return predictions.orderBy(F.desc("release_year"), "title_id").offset(page * size).limit(size)


# ---- clusters and recommendations ----------------------------------------------------------------------------------
def tribes(persona: DataFrame, aspects: DataFrame, n_tribes: int = 12, top_k: int = 100, seed: int = 42) -> DataFrame:
    """K-means of authors on z-scored MOI, excitation and the most common aspects (0 when not mentioned)."""
    aspects = scale.stage(aspects)  # read twice: for the names and for the values
    top = (aspects.groupBy("aspect").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "aspect").limit(top_k).collect())
    names = [r["aspect"] for r in top]  # at most top_k feature names
    wide = aspects.filter(F.col("aspect").isin(*names)).groupBy("author").pivot("aspect", names).agg(F.max("score"))
    cols = {f"a{i}": F.coalesce(F.col(f"`{n}`"), F.lit(0.0)) for i, n in enumerate(names)}
    base = persona.join(wide, "author", "left").select(
        "author", F.coalesce("moi", F.lit(0.0)).alias("moi"), F.coalesce("alpha", F.lit(0.0)).alias("alpha"),
        *[c.alias(n) for n, c in cols.items()])
    base = scale.stage(base)
    dims = ["moi", "alpha", *cols]
    st = base.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{p}_{c}") for c in dims
                                                 for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [((F.col(c) - float(st["m_" + c])) / float(st["s_" + c]) if st["s_" + c] else F.lit(0.0)).alias("z_" + c) for c in dims]
    zed = VectorAssembler(inputCols=["z_" + c for c in dims], outputCol="features").transform(base.select("author", *dims, *z))
    model = KMeans(k=max(1, min(n_tribes, st["n"])), seed=seed, maxIter=50).fit(zed)
    return model.transform(zed).select("author", F.col("prediction").alias("tribe"), *dims)


def tribe_summary(tribed: DataFrame) -> DataFrame:
    dims = [c for c in tribed.columns if c not in ("author", "tribe")]
    return tribed.groupBy("tribe").agg(F.count(F.lit(1)).alias("n_authors"), *[F.avg(c).alias(c) for c in dims])


def preferences(posts: DataFrame, link: DataFrame):
    """Implicit preferences of resolved users for keywords, with the numeric ids ALS needs."""
    from flickpulse.operators import graph as G
    pairs = (G.resolve_authors(posts.filter(F.trim("keyword") != ""), link)
             .groupBy("global_user_id", F.lower("keyword").alias("keyword")).agg(F.count(F.lit(1)).alias("n")))
    for column, ix in (("global_user_id", "user_ix"), ("keyword", "item_ix")):
        ids = scale.value_ranks(pairs.select(column).distinct(), column).select(column, F.col("n_before").cast("int").alias(ix))
        pairs = pairs.join(ids, column)
    return scale.stage(pairs.select("global_user_id", "keyword", "n", "user_ix", "item_ix"))


def factorize(prefs: DataFrame, rank: int = 10, seed: int = 42):
    return ALS(userCol="user_ix", itemCol="item_ix", ratingCol="n", implicitPrefs=True, rank=rank, regParam=0.02,
               maxIter=10, seed=seed).fit(prefs)


def recommend_items(prefs: DataFrame, n: int) -> DataFrame:
    model = factorize(prefs)
    users, items = prefs.select("user_ix", "global_user_id").distinct(), prefs.select("item_ix", "keyword").distinct()
    recs = model.recommendForAllUsers(n).select("user_ix", F.posexplode("recommendations").alias("place", "r"))
    return (recs.select("user_ix", (F.col("place") + 1).alias("place"), F.col("r.item_ix").alias("item_ix"),
                        F.col("r.rating").alias("score")).join(users, "user_ix").join(items, "item_ix")
            .select("global_user_id", "keyword", "place", "score"))


def untapped_audience(prefs: DataFrame, seeds: DataFrame, reach: DataFrame, activity: DataFrame, n: int = 50) -> DataFrame:
    """Users whose taste is near the seeds' centroid and whose reach is below the seeds' median (if above 0).

    reach: global_user_id, views; activity: global_user_id, platform, n.
    """
    factors = factorize(prefs).userFactors.withColumnRenamed("id", "user_ix")
    users = prefs.select("user_ix", "global_user_id").distinct()
    f = scale.stage(factors.join(users, "user_ix").select("global_user_id", "features"))
    own = f.join(seeds, "global_user_id", "left_semi")
    centroid = own.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v"))
    vector = centroid.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("c"))  # rank values
    seed_reach = seeds.join(reach, "global_user_id", "left").select(F.coalesce("views", F.lit(0)).cast("double").alias("views"))
    cutoff = scale.exact_quantiles(seed_reach, "views", {"m": 0.5}).select(F.floor("m").alias("m"))
    main = activity.groupBy("global_user_id").agg(
        F.min_by("platform", F.struct(-F.col("n"), "platform")).alias("most_active"), F.sum("n").alias("total_posts"))
    j = (f.join(seeds, "global_user_id", "left_anti").join(reach, "global_user_id", "left")
         .withColumn("views", F.coalesce("views", F.lit(0))).withColumn("c", scale.stage(vector).scalar())
         .withColumn("cut", scale.stage(cutoff).scalar())
         .filter((C.l2_norm("features") > 0) & ((F.col("cut") <= 0) | (F.col("views") < F.col("cut"))))
         .withColumn("similarity", C.cosine("features", "c")))
    return (j.join(main, "global_user_id", "left").select("global_user_id", "most_active", "similarity", "views", "total_posts")
            .orderBy(F.desc("similarity"), "global_user_id").limit(n))
