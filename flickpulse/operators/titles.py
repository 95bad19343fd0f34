"""Film titles and credits: cleaning, strictly-prior track records, macro joins, timing and banded factors.

History is first summed to (person or group, year); windows then run over years, whose number is bounded, so a person
with a third of all credits costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.functions import vocab
from flickpulse.operators import scale


def _key(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def clean(titles: DataFrame) -> DataFrame:
    """Release year and full day from text, the (name, year) key, primary genre, market tag, disclosed flag."""
    return (titles.withColumn("release_year", C.release_year("release_date"))
            .withColumn("release_day", C.release_day("release_date"))
            .withColumn("movie_key", F.concat_ws("|", _key("movie_name"), F.col("release_year").cast("string")))
            .withColumn("primary_genre", C.primary_genre("genre"))
            .withColumn("market_is_home", C.is_home_market("language", "country").cast("int"))
            .withColumn("has_financials", F.coalesce((F.col("budget") > 0) & (F.col("revenue") > 0), F.lit(False))))


def row_filter(cleaned: DataFrame, min_year: int = 2000, min_budget: float = 10_000, min_revenue: float = 10_000,
               home_only: bool | None = None) -> DataFrame:
    out = cleaned.filter((F.col("release_year") > min_year) & (F.col("budget") > min_budget)
                         & (F.col("revenue") >= min_revenue))
    return out if home_only is None else out.filter(F.col("market_is_home") == int(home_only))


def dubbing_breadth(cleaned: DataFrame) -> DataFrame:
    """Distinct languages per (name, release date)."""
    keys = [_key("movie_name").alias("name_key"), F.col("release_date")]
    per = cleaned.groupBy(*keys).agg(F.countDistinct("language").alias("dubbing_breadth"))
    return cleaned.withColumn("name_key", _key("movie_name")).join(per, ["name_key", "release_date"]).drop("name_key")


def dedupe(cleaned: DataFrame) -> DataFrame:
    """One row per (title, year): the most complete, then highest revenue, then smallest id."""
    full = F.col("release_day").isNotNull().cast("int")
    novelty = (F.col("narrative_novelty_score").isNotNull().cast("int") if "narrative_novelty_score" in cleaned.columns
               else F.lit(0))
    complete = (F.col("conflict_balance_score").isNotNull().cast("int") + novelty + full
                + (F.length(F.coalesce("directors", F.lit(""))) > 0).cast("int"))
    order = F.struct(complete, F.coalesce("revenue", F.lit(float("-inf"))), -F.col("title_id"))
    row = F.struct(*cleaned.columns)
    return (cleaned.filter(F.col("release_year").isNotNull()).groupBy(F.col("movie_key").alias("k"))
            .agg(F.max_by(row, order).alias("r")).select("r.*"))


def prior_financials(cleaned: DataFrame) -> DataFrame:
    """First disclosed (budget, revenue) per title-year."""
    return (cleaned.filter(F.col("has_financials") & F.col("release_year").isNotNull()).groupBy("movie_key")
            .agg(F.min_by(F.struct("budget", "revenue"), "title_id").alias("f"))
            .select("movie_key", F.col("f.budget").alias("own_budget"), F.col("f.revenue").alias("own_revenue")))


def foreign_production_filter(cleaned: DataFrame, credits: DataFrame) -> DataFrame:
    """Keep home-language titles and titles one of whose directors has a home-language credit."""
    names = lambda c: F.filter(F.transform(F.split(F.col(c), ","), lambda n: F.lower(F.trim(n))),
                               lambda n: n != "")
    known = (credits.filter(C.is_home_language("language")).select(F.explode(names("director")).alias("name")).distinct())
    by_director = (cleaned.select("title_id", F.explode(names("directors")).alias("name"))
                   .join(known, "name", "left_semi").select("title_id").distinct().withColumn("known", F.lit(True)))
    return (cleaned.join(by_director, "title_id", "left")
            .filter(C.is_home_language("language") | F.coalesce("known", F.lit(False))).drop("known"))


# ---- strictly prior history ----------------------------------------------------------------------------------------
def prior_sums(history: DataFrame, wanted: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """For each wanted (key, year): the sums over strictly earlier years as ``prior_*``."""
    total = history.groupBy(key, "year").agg(*[F.sum(c).alias(c) for c in sums])
    both = total.unionByName(wanted.select(key, "year").distinct(), allowMissingColumns=True)
    yearly = both.groupBy(key, "year").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    w = W.partitionBy(key).orderBy("year").rowsBetween(W.unboundedPreceding, -1)
    return yearly.select(key, "year", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias("prior_" + c) for c in sums])


def role_weight(c: str = "role_position") -> Column:
    return F.when(F.col(c) == 1, 1.0).when(F.col(c) == 2, 0.4).otherwise(0.15)


def clean_credits(credits: DataFrame, financials: DataFrame | None = None, hit_ratio: float = 1.5) -> DataFrame:
    c = (credits.withColumn("year", C.release_year("release_date")).filter(F.col("year").isNotNull())
         .withColumn("actor_key", _key("actor_name"))
         .withColumn("director_key", F.when(F.trim("director") != "", _key("director")))
         .withColumn("movie_key", F.concat_ws("|", _key("movie_name"), F.col("year").cast("string")))
         .withColumn("role_wt", role_weight()))
    if financials is None:
        return c
    ratio = F.when((F.col("own_budget") > 0) & (F.col("own_revenue") > 0), F.col("own_revenue") / F.col("own_budget"))
    return (c.join(financials, "movie_key", "left").withColumn("ratio", ratio)
            .withColumn("hit", F.when(F.col("ratio").isNotNull(), (F.col("ratio") >= hit_ratio).cast("double"))))


def films_before(credits: DataFrame, tie: str) -> DataFrame:
    """Place of each credit in the actor's career by year; ``tie`` (numeric, unique) orders one year's credits."""
    credits = scale.stage(credits)  # read four times; callers pass the columns that they need
    wanted = credits.select("actor_key", "year")
    earlier = prior_sums(wanted.withColumn("n", F.lit(1)), wanted, "actor_key", ["n"])
    inside = scale.value_ranks(credits, tie, ("actor_key", "year")).select("actor_key", "year", tie, "n_before")
    return (credits.join(earlier, ["actor_key", "year"]).join(inside, ["actor_key", "year", tie])
            .withColumn("films_before", F.col("prior_n") + F.col("n_before")).drop("prior_n", "n_before"))


def star_strength(credits: DataFrame, tie: str) -> DataFrame:
    """Per title: role-weighted mean popularity of the cast."""
    rows = credits.select("movie_key", "actor_key", "year", "role_wt", tie)
    c = films_before(rows, tie).withColumn("popularity", C.interpolate(F.col("films_before").cast("double"),
                                                                          vocab.POPULARITY_KNOTS))
    return c.groupBy("movie_key").agg((F.sum(F.col("role_wt") * F.col("popularity")) / F.sum("role_wt")).alias("r_star"),
                                      F.count(F.lit(1)).alias("n_cast"))


def overexposure(credits: DataFrame) -> DataFrame:
    """Per title: mean over its leads of their other credits in this and the previous year."""
    per_year = credits.groupBy("actor_key", "year").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("actor_key").orderBy("year").rangeBetween(-1, 0)
    recent = per_year.withColumn("recent", F.sum("n").over(w)).drop("n")
    own = credits.groupBy("actor_key", "year", "movie_key").agg(
        F.count(F.lit(1)).alias("own"), F.count(F.when(F.col("role_wt") >= 0.4, 1)).alias("lead_rows"))
    j = own.join(recent, ["actor_key", "year"]).withColumn("others", F.col("recent") - F.col("own"))
    leads = F.sum("lead_rows")
    return j.groupBy("movie_key").agg(
        F.when(leads > 0, F.sum(F.col("others") * F.col("lead_rows")) / leads)
        .otherwise(F.sum(F.col("others") * F.col("own")) / F.sum("own")).alias("overexposure"))


def lead_actor(credits: DataFrame) -> DataFrame:
    """Credit with the lowest role position; smallest name on ties."""
    return (credits.filter(F.col("role_position").isNotNull()).groupBy("movie_key")
            .agg(F.min_by("actor_key", F.struct("role_position", "actor_key")).alias("lead_key"),
                 F.max("year").alias("year")))


def track_record(titles: DataFrame, credits: DataFrame) -> DataFrame:
    """Strictly-prior record of each title's lead, director and cast; undisclosed history stays null, never 0.

    titles: movie_key, release_year, directors; credits: as from :func:`clean_credits` with financials.
    """
    credits = scale.stage(credits.select("movie_key", "actor_key", "director_key", "year", "role_position", "role_wt",
                                         "ratio", "hit"))
    known = F.col("hit").isNotNull().cast("int")
    history = credits.select("actor_key", "year", F.lit(1).alias("n"), F.coalesce("hit", F.lit(0.0)).alias("hits"),
                             known.alias("known"), F.coalesce("ratio", F.lit(0.0)).alias("ratios"))
    yearly = history.groupBy("actor_key", "year").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "known", "ratios")])
    by_year = W.partitionBy("actor_key").orderBy("year")
    before = by_year.rowsBetween(W.unboundedPreceding, -1)
    last = lambda c: F.lag(F.when(F.col("known") > 0, F.col(c) / F.col("known"))).over(by_year)
    actor = scale.stage(yearly.select(
        "actor_key", "year", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("prior_n"),
        F.sum("hits").over(before).alias("prior_hits"), F.sum("known").over(before).alias("prior_known"),
        last("hits").alias("last_hit"), last("ratios").alias("last_ratio")))
    lead = (lead_actor(credits).join(actor.withColumnRenamed("actor_key", "lead_key"), ["lead_key", "year"])
            .select("movie_key", F.col("prior_n").alias("lead_prior_films"), F.col("last_hit").alias("lead_last_hit"),
                    F.col("last_ratio").alias("lead_last_ratio")))
    rate = F.when(F.col("prior_known") > 0, F.col("prior_hits") / F.col("prior_known"))
    cast = credits.join(actor, ["actor_key", "year"]).withColumn("rate", rate).filter(F.col("rate").isNotNull())
    ensemble = cast.groupBy("movie_key").agg((F.sum(F.col("role_wt") * F.col("rate")) / F.sum("role_wt"))
                                             .alias("ensemble_hit_rate"))
    films = credits.filter(F.col("director_key").isNotNull()).groupBy("director_key", "movie_key", "year").agg(
        F.max("hit").alias("hit")).select(
        "director_key", "year", F.lit(1).alias("n"), F.coalesce("hit", F.lit(0.0)).alias("hits"), known.alias("known"))
    t = titles.select("movie_key", F.col("release_year").alias("year"),
                      F.when(F.trim("directors") != "", _key("directors")).alias("director_key"))
    director = prior_sums(films, t.filter(F.col("director_key").isNotNull()), "director_key", ["n", "hits", "known"])
    return (t.join(director, ["director_key", "year"], "left").join(lead, "movie_key", "left")
            .join(ensemble, "movie_key", "left")
            .select("movie_key", "lead_prior_films", "lead_last_hit", "lead_last_ratio",
                    F.col("prior_n").alias("director_prior_films"),
                    F.when(F.col("prior_known") > 0, F.col("prior_hits") / F.col("prior_known")).alias("director_hit_rate"),
                    "ensemble_hit_rate"))


def director_prior_releases(deduped: DataFrame) -> DataFrame:
    """Strictly earlier titles of the same first-listed director."""
    d = deduped.select("title_id", F.col("release_year").alias("year"),
                       F.lower(F.trim(F.split("directors", ",")[0])).alias("director_key")).filter("director_key <> ''")
    prior = prior_sums(d.withColumn("n", F.lit(1)), d, "director_key", ["n"])
    return d.join(prior, ["director_key", "year"]).select("title_id", "director_key",
                                                          F.col("prior_n").alias("director_prior_releases"))


def historical_anchor(deduped: DataFrame, group: str, out: str) -> DataFrame:
    """Percentile of the group's mean ln(revenue) over strictly earlier years; unknown history -> median, < 5 -> 0.5."""
    rows = deduped.select("title_id", F.col(group).alias("g"), F.col("release_year").alias("year"),
                          F.log("revenue").alias("ln")).filter(F.col("g").isNotNull())
    prior = prior_sums(rows.select("g", "year", F.lit(1).alias("n"), "ln"), rows, "g", ["n", "ln"])
    mean = scale.stage(rows.join(prior, ["g", "year"]).select(
        "title_id", F.when(F.col("prior_n") > 0, F.col("prior_ln") / F.col("prior_n")).alias("mean")))
    ranked = scale.stage(scale.with_percentile(mean, "mean", "pct", scale.average_percentile()))
    middle = scale.exact_quantiles(ranked, "pct", {"m": 0.5})
    many = ranked.agg((F.count("mean") >= 5).alias("many"))
    return ranked.withColumn("m", scale.stage(middle).scalar()).withColumn("many", scale.stage(many).scalar()).select(
        "title_id", F.when(F.col("many"), F.coalesce("pct", "m", F.lit(0.5))).otherwise(0.5).alias(out))


# ---- macro, calendar, timing ---------------------------------------------------------------------------------------
def budget_effective(deduped: DataFrame, haircut: float = 0.775) -> DataFrame:
    """Budget compounded to the newest year, scaled by GDP, cut when no marketing telemetry exists."""
    ref = deduped.agg(F.max("release_year").alias("y"))
    d = deduped.withColumn("ref_year", scale.stage(ref).scalar())
    recent = d.filter((F.col("release_year") >= F.col("ref_year") - 2) & (F.col("gdp_usd_billions") > 0))
    gdp_ref = scale.stage(scale.exact_quantiles(recent, "gdp_usd_billions", {"g": 0.5})).scalar()
    years = F.greatest(F.col("ref_year") - F.col("release_year"), F.lit(0))
    inflation = C.clamp(F.coalesce("inflation_rate_pct", F.lit(0.0)), -20, 50) / 100
    g = F.col("gdp_usd_billions")
    norm = F.when(F.col("g_ref").isNotNull() & (g > 0), F.col("g_ref") / g).otherwise(1.0)
    telemetry = F.col("trailer_days_to_release").isNotNull()
    if "teaser_days_to_release" in deduped.columns:
        telemetry |= F.col("teaser_days_to_release").isNotNull()
    return (d.withColumn("g_ref", gdp_ref)
            .withColumn("budget_effective", F.col("budget") * F.pow(1 + inflation, years) * norm
                        * F.when(telemetry, 1.0).otherwise(haircut)).drop("ref_year", "g_ref"))


def trailer_curve(days: Column) -> Column:
    within = days <= vocab.TRAILER_KNOTS[-1][0]
    return F.when(within, C.interpolate(days, vocab.TRAILER_KNOTS)).when(~within, vocab.TRAILER_BEYOND)


def song_curve(days: Column) -> Column:
    return C.interpolate(days, vocab.SONG_KNOTS)


def timing_scores(deduped: DataFrame) -> DataFrame:
    """Trailer lead time (boosted by the view percentile), song lead time, and runtime above 160 minutes."""
    d = deduped.withColumn("views_", F.log1p(F.coalesce("trailer_views", F.lit(0.0))))
    d = scale.with_percentile(d, "views_", "views_pct", scale.average_percentile())
    return (d.withColumn("trailer_timing", trailer_curve(F.col("trailer_days_to_release")) + (F.col("views_pct") - 0.5) * 0.5)
            .withColumn("song_timing", song_curve(F.col("song_days_to_release")))
            .withColumn("excess_runtime", C.clamp(F.coalesce("runtime_mins", F.lit(0.0)) - 160, 0, 60))
            .drop("views_", "views_pct"))


def calendar_flags(cleaned: DataFrame) -> DataFrame:
    """Festive, exam, league and summer flags; home market only, null without a full date."""
    home = F.col("market_is_home") == 1
    flags = {"festive": C.in_windows("release_day"), "exam_season": C.in_months("release_day", vocab.EXAM_MONTHS),
             "league_season": C.in_months("release_day", vocab.LEAGUE_MONTHS),
             "summer": C.in_months("release_day", vocab.SUMMER_MONTHS)}
    for name, c in flags.items():
        cleaned = cleaned.withColumn(name, F.when(home, c))
    return cleaned


def release_clashes(cleaned: DataFrame, days: int = 3) -> DataFrame:
    """Other titles of the language within +-``days``; counted on (language, day) totals, not on pairs of titles."""
    d = cleaned.filter(F.col("release_day").isNotNull()).withColumn("day_no", F.unix_date("release_day"))
    per_day = d.groupBy("language", "day_no").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("language").orderBy("day_no").rangeBetween(-days, days)
    near = per_day.select("language", "day_no", (F.sum("n").over(w) - 1).alias("clashes"))
    return d.join(near, ["language", "day_no"]).select("title_id", "language", "release_day", "clashes")


def prior_close(rows: DataFrame, index: DataFrame, day: str, out: str) -> DataFrame:
    """Last close on or before ``day``, per index name."""
    r = index.select("index_name", F.unix_date("trade_date").alias("close_day"), "close")
    l = rows.filter(F.col(day).isNotNull()).withColumn("day_", F.unix_date(day))
    return scale.asof_prior(l, r, ["index_name"], "day_", "close_day", F.col("close"), out, width=366).drop("day_")


def index_momentum(cleaned: DataFrame, index: DataFrame, index_name: str, days: int = 90) -> DataFrame:
    """Close at release and its change over the 90 days before, home market only."""
    t = (cleaned.filter((F.col("market_is_home") == 1) & F.col("release_day").isNotNull())
         .select("title_id", F.lit(index_name).alias("index_name"), "release_day",
                 F.date_sub("release_day", days).alias("earlier_day")))
    both = prior_close(prior_close(t, index, "release_day", "close_now"), index, "earlier_day", "close_then")
    change = F.when(F.col("close_then") != 0, 100.0 * (F.col("close_now") - F.col("close_then")) / F.col("close_then"))
    return both.select("title_id", "close_now", change.alias("change_pct"))


def city_tier(language: str = "language", home: str = "market_is_home") -> Column:
    lang = F.lower(F.trim(F.col(language)))
    return F.when(F.col(home) == 1, F.when(lang.isin("hindi", "english"), "tier_1")
                  .when(C.is_home_language(language), "tier_2_3").otherwise("national_average"))


def price_interval_join(cleaned: DataFrame, prices: DataFrame) -> DataFrame:
    """Ticket price whose period covers the release day for the inferred tier; the earliest period wins.

    Intervals are spread over the months they touch, so the join is an equi-join on (tier, month).
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    p = prices.withColumn("month", F.explode(F.sequence(month(F.col("period_start")), month(F.col("period_end")))))
    t = (cleaned.filter(F.col("release_day").isNotNull()).withColumn("city_tier", city_tier())
         .select("title_id", "city_tier", "release_day", month(F.col("release_day")).alias("month")))
    hits = t.join(p, ["city_tier", "month"]).filter(F.col("release_day").between(F.col("period_start"), F.col("period_end")))
    return hits.groupBy("title_id", "city_tier").agg(
        F.min_by("atp_usd", F.struct("period_start", "period_end", "atp_usd")).alias("atp_usd"))


def macro_fill(cleaned: DataFrame, macro: DataFrame, iso3: dict[str, str] | None = None) -> DataFrame:
    """Fill missing GDP and inflation by (first country, year); ``macro_status`` tells what happened."""
    codes = iso3 or vocab.COUNTRY_ISO3
    code = F.element_at(F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]),
                        C.first_country("country"))
    m = macro.select("iso3", F.col("year").alias("release_year"), F.col("gdp_usd_billions").alias("m_gdp"),
                     F.col("inflation_rate_pct").alias("m_infl"))
    need = F.col("gdp_usd_billions").isNull() | F.col("inflation_rate_pct").isNull()
    j = cleaned.withColumn("iso3", code).join(m, ["iso3", "release_year"], "left")
    status = (F.when(~need, "complete").when(F.col("iso3").isNull(), "unmapped country")
              .when(F.col("m_gdp").isNull() & F.col("m_infl").isNull(), "no data").otherwise("filled"))
    return (j.withColumn("macro_status", status)
            .withColumn("gdp_usd_billions", F.coalesce("gdp_usd_billions", "m_gdp"))
            .withColumn("inflation_rate_pct", F.coalesce("inflation_rate_pct", "m_infl")).drop("m_gdp", "m_infl"))


def news_event_flags(cleaned: DataFrame, articles: DataFrame, window_days: int = 45,
                     phrases: dict[str, list[str]] | None = None) -> DataFrame:
    """Per title and event class, 1 if an article in the window holds the title and any phrase of the class, else 0.

    Names and articles meet on (rarest token of the name, date bucket); only then is the whole text searched for the
    whole name, once for all titles of that name. A name can only occur where its rarest token occurs, so nothing is
    lost. Titles then meet their name's articles by date.
    """
    phrases = phrases or vocab.EVENT_PHRASES
    classes = F.filter(F.array(*[F.when(F.lower("text").rlike("|".join(p.replace("-", "\\-") for p in ps)), F.lit(name))
                                 for name, ps in phrases.items()]), lambda c: c.isNotNull())
    words = lambda c: F.array_remove(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+"), "")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    bucket = lambda c: F.floor(F.unix_date(c) / window_days)
    a = scale.stage(articles.withColumn("classes", classes).filter(F.size("classes") > 0).select(
        "doc_id", "pub_date", bucket("pub_date").alias("bucket"), "classes", padded(words("text")).alias("body")))
    t = scale.stage(cleaned.filter(F.col("release_day").isNotNull()).withColumn("title_words", words("movie_name"))
                    .filter(F.size("title_words") > 0).select("title_id", "release_day", padded("title_words").alias("name")))
    tokens = lambda c: F.array_distinct(F.split(F.trim(F.col(c)), " "))
    names = t.select("name", F.explode(F.sequence(bucket("release_day") - 1, bucket("release_day") + 1)).alias(
        "bucket")).distinct()
    of_name = scale.stage(t.select("name").distinct().select("name", F.explode(tokens("name")).alias("token")))
    seen = scale.stage(a.select("doc_id", "bucket", F.explode(tokens("body")).alias("token")).join(
        of_name.select("token").distinct(), "token", "left_semi"))
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rare = (of_name.join(counts, "token", "left").groupBy("name")
            .agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token")))
    pairs = names.join(rare, "name").join(seen, ["token", "bucket"]).select("name", "doc_id").distinct()
    told = (pairs.join(a, "doc_id").filter(F.contains("body", "name"))
            .select("name", "pub_date", F.explode("classes").alias("event_class")).distinct())
    near = told.withColumn("bucket", F.explode(F.sequence(bucket("pub_date") - 1, bucket("pub_date") + 1)))
    days = t.select("name", "release_day").distinct().withColumn("bucket", bucket("release_day"))
    dated = (days.join(near, ["name", "bucket"]).filter(F.abs(F.datediff("pub_date", "release_day")) <= window_days)
             .select("name", "release_day", "event_class").distinct())
    hit = t.join(dated, ["name", "release_day"])
    found = hit.select("title_id", "event_class").distinct().withColumn("flag", F.lit(1))
    every = cleaned.select("title_id", F.explode(F.array(*[F.lit(name) for name in phrases])).alias("event_class"))
    return every.join(found, ["title_id", "event_class"], "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


# ---- banded factors ------------------------------------------------------------------------------------------------
def peer_budget_rank(deduped: DataFrame) -> DataFrame:
    """1 - percentile of the budget inside (genre, year), average ties."""
    out = scale.with_percentile(deduped, "budget", "pct", scale.average_percentile(), ("primary_genre", "release_year"))
    return out.withColumn("peer_budget_efficiency", 1 - F.col("pct")).drop("pct")


def long_factors(df: DataFrame, key: str, factors: dict[str, Column]) -> DataFrame:
    """Wide -> (key, factor, value), all factors in one pass."""
    cells = F.array(*[F.struct(F.lit(n).alias("factor"), c.cast("double").alias("value")) for n, c in factors.items()])
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.factor", "c.value")


def band_rescale(long: DataFrame, key: str, bands: dict[str, tuple[float, float]], negative: set[str] = frozenset()):
    """(key, factor, value) -> banded: average-tie percentile mapped to [lo, hi]; null gives the midpoint.

    One distributed ranking serves all factors. A factor listed in ``negative`` has its sign flipped first.
    """
    v = long.withColumn("value", F.when(F.col("factor").isin(*negative), -F.col("value")).otherwise(F.col("value"))
                        if negative else F.col("value"))
    pct = scale.with_percentile(v, "value", "pct", scale.average_percentile(), ("factor",))
    lo = F.create_map(*[x for n, (a, _) in bands.items() for x in (F.lit(n), F.lit(float(a)))])
    hi = F.create_map(*[x for n, (_, b) in bands.items() for x in (F.lit(n), F.lit(float(b)))])
    low, high = F.element_at(lo, F.col("factor")), F.element_at(hi, F.col("factor"))
    return pct.select(key, "factor", (low + F.coalesce("pct", F.lit(0.5)) * (high - low)).alias("banded"))


def coverage_report(long: DataFrame, outcome: DataFrame, key: str) -> DataFrame:
    """Per factor: non-null count, coverage and correlation with ln(revenue); ``outcome``: key, ln_revenue."""
    return long.join(outcome, key).groupBy("factor").agg(
        F.count("value").alias("n_known"), (100.0 * F.count("value") / F.count(F.lit(1))).alias("coverage_pct"),
        F.corr("value", "ln_revenue").alias("corr_ln_revenue"))


def registry_features(df: DataFrame, key: str, registry: list[dict], values: DataFrame | None = None,
                      min_coverage: float = 0.05) -> DataFrame:
    """One banded column per registered factor that is known for at least ``min_coverage`` of the rows.

    Registry rows: factor_key, computation ('column', 'derived' or 'value_table'), source (column name, Column, or
    factor key in ``values``), lo, hi, direction ('Positive' or 'Negative').
    """
    direct = {r["factor_key"]: (F.col(r["source"]) if isinstance(r["source"], str) else r["source"])
              for r in registry if r["computation"] in ("column", "derived")}
    long = long_factors(df, key, direct)
    tabled = {r["source"]: r["factor_key"] for r in registry if r["computation"] == "value_table"}
    if tabled and values is not None:
        wide = values.groupBy(key).pivot("factor_key", list(tabled)).agg(F.max("value_numeric"))
        long = long.unionByName(long_factors(df.select(key).join(wide, key, "left"), key,
                                             {n: F.col(s) for s, n in tabled.items()}))
    long = scale.stage(long)
    known = {r["factor"] for r in long.groupBy("factor").agg(  # one row per registered factor
        (F.count("value") / F.count(F.lit(1))).alias("share")).filter(F.col("share") >= min_coverage).collect()}
    use = [r for r in registry if r["factor_key"] in known]
    banded = band_rescale(long.filter(F.col("factor").isin(*known)), key,
                          {r["factor_key"]: (r["lo"], r["hi"]) for r in use},
                          {r["factor_key"] for r in use if r.get("direction") == "Negative"})
    return banded.groupBy(key).pivot("factor", [r["factor_key"] for r in use]).agg(F.max("banded"))


def top_k_bucket(df: DataFrame, column: str, k: int, out: str) -> DataFrame:
    """Keep the ``k`` most frequent values, rest 'other'; value order breaks ties."""
    top = (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), column).limit(k).select(column, F.col(column).alias("kept")))
    return df.join(top, column, "left").withColumn(out, F.coalesce("kept", F.lit("other"))).drop("kept")


def time_split(df: DataFrame, share: float = 0.18, key: str = "title_id", min_train: int = 30, min_test: int = 10):
    """Mark the last ``share`` of the distinct years as test; a small corpus is cut by row order instead."""
    years = [(r["release_year"], r["n"]) for r in df.groupBy("release_year").agg(  # one row per year
        F.count(F.lit(1)).alias("n")).orderBy("release_year").collect()]
    cutoff = years[int(len(years) * (1 - share))][0] if years else None
    n_test = sum(n for y, n in years if y >= cutoff)
    n = sum(n for _, n in years)
    if n - n_test >= min_train and n_test >= min_test:
        return df.withColumn("is_test", F.col("release_year") >= F.lit(cutoff))
    before = prior_counts = 0
    first_test = int(n * (1 - share))
    for y, count in years:  # the year in which the row-order cut falls
        if prior_counts + count > first_test:
            cutoff, before = y, prior_counts
            break
        prior_counts += count
    inside = scale.value_ranks(df.filter(F.col("release_year") == cutoff), key).select(key, "n_before")
    late = (F.col("release_year") > cutoff) | ((F.col("release_year") == cutoff)
                                               & (F.col("n_before") + before >= first_test))
    return df.join(inside, key, "left").withColumn("is_test", late).drop("n_before")


def registry_of_titles() -> list[dict]:
    """The factors this package can compute from the title columns themselves."""
    row = lambda key, source, lo, hi, direction="Positive": {
        "factor_key": key, "computation": "column" if isinstance(source, str) else "derived", "source": source,
        "lo": lo, "hi": hi, "direction": direction}
    return [row("joint_production_partnerships", C.company_count("production_companies"), 0.0, 0.2),
            row("certificate", C.certificate_ordinal("cbfc_rating"), -0.3, 0.3),
            row("remake_rights", C.remake_detected("overview"), -0.2, 0.1),
            row("excess_runtime", "excess_runtime", -0.3, 0.0, "Negative"),
            row("trailer_timing", "trailer_timing", -0.2, 0.3), row("song_timing", "song_timing", -0.1, 0.2),
            row("rating", "imdb_rating", 0.0, 0.4)]


def feature_frame(titles: DataFrame, credits: DataFrame, values: DataFrame | None = None, min_year: int = 1900,
                  tie: str = "credit_order") -> DataFrame:
    """The assembled model table: one row per title-year with financials."""
    cleaned = scale.stage(clean(titles))
    d = scale.stage(dedupe(row_filter(cleaned, min_year=min_year)))
    c = clean_credits(credits, prior_financials(cleaned))
    star = star_strength(c, tie).select("movie_key", "r_star")
    names = d.select(F.col("movie_name").alias("name"))
    stem = C.franchise_stem("movie_name")
    stems = names.groupBy(C.franchise_stem("name").alias("stem")).agg(F.count(F.lit(1)).alias("n_stem"))
    base = (timing_scores(budget_effective(d)).withColumn("stem", stem).join(stems, "stem")
            .withColumn("franchise_flag", (F.col("n_stem") >= 2).cast("int"))
            .withColumn("director_key", _key("directors")).withColumn("ln_revenue", F.log("revenue"))
            .withColumn("ln_budget_effective", F.log(F.greatest("budget_effective", F.lit(1.0)))))
    base = scale.stage(base)
    registry = registry_of_titles()
    if values is not None:
        registry += [{"factor_key": k, "computation": "value_table", "source": k, "lo": 0.0, "hi": 0.2,
                      "direction": "Positive"} for k in ("shipping_pace", "priority_level")]
    banded = registry_features(base, "title_id", registry, values)
    with_star = scale.stage(base.select("title_id", "movie_key").join(star, "movie_key", "left"))
    middle = scale.stage(scale.exact_quantiles(with_star, "r_star", {"m": 0.5})).scalar()
    return (base.select("title_id", "movie_key", "release_year", "market_is_home", "primary_genre", "franchise_flag",
                        "ln_budget_effective", "ln_revenue", "revenue")
            .join(with_star.withColumn("m", middle).select("title_id", F.coalesce("r_star", "m").alias("r_star")), "title_id")
            .join(historical_anchor(base, "director_key", "r_director"), "title_id", "left")
            .join(historical_anchor(base, "primary_genre", "r_concept"), "title_id", "left")
            .join(banded, "title_id"))
