"""Hand-checked cases, brute-force checks on small skewed data, and invariance."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.operators import audience as A
from flickpulse.operators import daily as D
from flickpulse.operators import engagement as E
from flickpulse.operators import entities as N
from flickpulse.operators import graph as G
from flickpulse.operators import scale
from flickpulse.operators import similarity as S
from flickpulse.operators import text as X
from flickpulse.operators import timeline as TL
from flickpulse.operators import titles as T
from flickpulse.sources import files

MIN = 60_000_000


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# ---- ranks and quantiles -------------------------------------------------------------------------------------------
def skewed(n=300):
    rng = random.Random(7)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(5)}", 5.0 if i % 3 == 1 else float(rng.randrange(40)))
            for i in range(n)]


def test_value_ranks_match_brute_force(spark):
    data = skewed()
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {(r.k, r.v): (r.n_before, r.n_equal, r.n_total) for r in scale.value_ranks(df, "v", ("k",)).collect()}
    for k, v in set(data):
        vs = [b for a, b in data if a == k]
        assert got[(k, v)] == (sum(x < v for x in vs), vs.count(v), len(vs))
    all_v = [v for _, v in data]
    for r in scale.value_ranks(df, "v").collect():
        assert (r.n_before, r.n_equal) == (sum(x < r.v for x in all_v), all_v.count(r.v))


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantiles(spark, p):
    data = skewed()
    df = spark.createDataFrame(data, "k string, v double")
    assert one(scale.exact_quantiles(df, "v", {"q": p})).q == pytest.approx(np.quantile([v for _, v in data], p))
    xs = sorted(v for _, v in data)
    pos = p * (len(xs) + 1)
    want = xs[0] if pos < 1 else xs[-1] if pos >= len(xs) else xs[int(pos) - 1] + (pos - int(pos)) * (xs[int(pos)] - xs[int(pos) - 1])
    assert one(scale.exact_quantiles(df, "v", {"q": p}, rule="n_plus_1")).q == pytest.approx(want)


def test_asof(spark):
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 400, 2.0), ("b", 5, 9.0)], "k string, t long, v double")
    left = spark.createDataFrame([("a", 9), ("a", 10), ("a", 399), ("a", 5000), ("b", 4)], "k string, at long")
    got = {(r.k, r.at): r.x for r in scale.asof_prior(left, right, ["k"], "at", "t", F.col("v"), "x", 100).collect()}
    assert got == {("a", 9): None, ("a", 10): 1.0, ("a", 399): 1.0, ("a", 5000): 2.0, ("b", 4): None}
    strict = scale.asof_prior(left, right, ["k"], "at", "t", F.col("v"), "x", 100, strict=True)
    assert {(r.k, r.at): r.x for r in strict.collect()}[("a", 10)] is None


# ---- engagement, daily series, lift --------------------------------------------------------------------------------
def post(**k):
    base = dict(post_id=1, platform="x", author="User_1", us=0, comments=0, shares=0, likes=0, views=0,
                content_intent="praise", keyword="kw", sentiment_score=50.0)
    return {**base, **k}


def posts(spark, rows):
    return spark.createDataFrame([tuple(post(**r).values()) for r in rows],
                                 "post_id long, platform string, author string, us long, comments long, shares long, "
                                 "likes long, views long, content_intent string, keyword string, sentiment_score double")


def test_engagement_score(spark):
    p = posts(spark, [dict(comments=2, shares=0, likes=3, views=10), dict(platform="reddit", comments=1, views=99, shares=9),
                      dict(comments=None, shares=None, likes=None, views=None)])
    assert [r[0] for r in p.select(E.score()).collect()] == [20.5, 3.0, 0.0]


def test_vmi_gaps_are_not_filled(spark):
    vol = spark.createDataFrame([(1, 100, 6.0), (1, 100, 4.0), (1, 102, 4.0)], "entity_id long, day_no long, score double")
    ents = spark.createDataFrame([(1, "EU", "L0")], "entity_id long, industry string, language string")
    v = D.vmi_daily(vol.groupBy("entity_id", "day_no").agg(F.sum("score").alias("volume")), ents)
    assert [(r.day_index, r.volume, r.cumulative, r.cohort_zscore) for r in v.orderBy("day_index").collect()] == [
        (0, 10.0, 10.0, None), (2, 4.0, 14.0, None)]


@pytest.mark.parametrize("n,want", [(3, None), (4, [-1.3416407864998738, -0.4472135954999579, 0.4472135954999579,
                                                    1.3416407864998738])])
def test_cohort_zscore(spark, n, want):
    vol = spark.createDataFrame([(i, 5, 10.0 * i) for i in range(n)], "entity_id long, day_no long, volume double")
    ents = spark.createDataFrame([(i, None, "L0") for i in range(n)], "entity_id long, industry string, language string")
    z = [r.cohort_zscore for r in D.vmi_daily(vol, ents).orderBy("entity_id").collect()]
    assert z == [None] * n if want is None else z == pytest.approx(want)


def test_net_sentiment(spark):
    df = spark.createDataFrame([(8, 4), (5, 0), (0, 0)], "p long, n long")
    assert [r[0] for r in df.select(D.net_sentiment(F.col("p"), F.col("n"))).collect()] == [2.0, 0.0, 0.0]


def test_inverse_variance_lift(spark):
    events = spark.createDataFrame([(1, 1, 1.0, 0.01), (2, 1, -1.0, 1.0)],
                                   "entity_id long, day_no long, lift double, variance double")
    who = spark.createDataFrame([(1, 1, "User_1"), (1, 1, "user 1"), (2, 1, "User_1"), (2, 1, "User_9")],
                                "entity_id long, day_no long, author string")
    link = spark.createDataFrame([("g1", "user1")], "global_user_id string, normalized_author string")
    r = one(D.causal_lift(events, who, link))
    assert (r.n_events, r.confidence) == (2, "LOW") and r.causal_lift_score == pytest.approx(99 / 101)


def test_lift_floor(spark):
    vmi = spark.createDataFrame([(1, d, d, 0.0, None, 0.2 if d < 10 else 5.0) for d in range(14)],
                                "entity_id long, day_no long, day_index long, volume double, cohort_zscore double, cumulative double")
    fit = {r.day_index: r for r in D.trend_fit(vmi).collect()}
    f = fit[8]
    projected = f.intercept + f.slope * 11
    assert (f.actual_plus_3 - projected) / max(projected, 1.0) == pytest.approx(4.8)
    assert 0 not in fit and 1 not in fit


# ---- timelines -----------------------------------------------------------------------------------------------------
def random_posts(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000_000_000
    for i in range(n):
        t += rng.choice([0, 0, 20, 90, 400, 7200]) * 1_000_000
        rows.append(dict(post_id=i, author="hot" if i % 3 else f"u{rng.randrange(4)}", us=t,
                         keyword=rng.choice(["a", "b", None, ""])))
    return rows, posts(spark, rows)


def test_excitation_brute_force(spark):
    rows, p = random_posts(spark)
    got = {r.post_id: r.excite for r in TL.excitation(p.repartition(7), ["author"], TL.PER_MINUTE).collect()}
    for r in rows:
        want = sum(math.exp(-0.1 * (r["us"] - q["us"]) / MIN) for q in rows
                   if q["author"] == r["author"] and (q["us"], q["post_id"]) < (r["us"], r["post_id"]))
        assert got[r["post_id"]] == pytest.approx(want, abs=1e-12)


def test_bursts_and_regions_brute_force(spark):
    rows, p = random_posts(spark)
    marked = TL.bursts(p.repartition(5), ["author"])
    got = {r.post_id: r.burst for r in marked.collect()}
    regions = {(r.author, r.start_us, r.end_us, r.n_posts) for r in TL.burst_regions(marked, ["author"]).collect()}
    want_regions = set()
    for a in {r["author"] for r in rows}:
        mine = sorted((r for r in rows if r["author"] == a), key=lambda r: (r["us"], r["post_id"]))
        b = [0] * len(mine)
        for i, r in enumerate(mine):
            if r["keyword"]:
                inside = [j for j in range(i, len(mine)) if mine[j]["us"] - r["us"] <= 10 * MIN]
                if len(inside) >= 3:
                    for j in inside:
                        b[j] = max(b[j], len(inside))
        run = []
        for r, c in [*zip(mine, b), (None, 0)]:
            if r:
                assert got[r["post_id"]] == c
            if c:
                run.append(r)
            elif run:
                want_regions.add((a, run[0]["us"], run[-1]["us"], len(run)))
                run = []
    assert regions == want_regions and want_regions


def test_hawkes_edges(spark):
    rows, p = random_posts(spark)
    extra = posts(spark, [dict(post_id=900, author="single"), dict(post_id=901, author="same"), dict(post_id=902, author="same")])
    p = p.unionByName(extra)
    short = {r.author: r for r in TL.hawkes_fit(p, ["author"], TL.PER_MINUTE).collect()}
    assert (short["single"].mu, short["single"].alpha) == (0.0, 0.0) and short["same"].alpha == 0.0
    for a, s in short.items():
        assert 0 <= s.alpha < 0.1
    # no better point on a grid around the fit of the busiest author
    xs = [r.excite for r in TL.excitation(p, ["author"], TL.PER_MINUTE).filter("author = 'hot'").collect()]
    s = short["hot"]
    mass = (len(xs) - xs_last(rows) - 1) / 0.1

    def ll(mu, alpha):
        return sum(math.log(mu + alpha * x) for x in xs) - mu * s.span - alpha * mass

    best = ll(s.mu, s.alpha)
    for i in range(-5, 6):
        for j in range(-5, 6):
            mu, alpha = s.mu * (1 + i * 0.05), s.alpha * (1 + j * 0.05)
            if mu > 0 and 0 <= alpha < 0.1:
                assert ll(mu, alpha) <= best + 1e-9


def xs_last(rows):
    mine = sorted((r for r in rows if r["author"] == "hot"), key=lambda r: (r["us"], r["post_id"]))
    last = mine[-1]
    return sum(math.exp(-0.1 * (last["us"] - q["us"]) / MIN) for q in mine[:-1])


def box_maximum(times, kernel, bounded_mu):
    """Brute force: excitation by all pairs, then (mu, alpha) by a grid over the allowed box that is narrowed again and again."""
    t = np.sort(np.array(times, float))
    a = np.array([sum(math.exp(-kernel.beta * (x - y)) for y in t[:i]) for i, x in enumerate(t)])
    span, n = t[-1] - t[0], len(t)
    mass = (n - a[-1] - 1) / kernel.beta
    low, high = np.array([1e-9, 0.0]), np.array([10 * n / max(span, 1.0) if bounded_mu else 10 * n / span, kernel.beta - 1e-9])
    ends = low.copy(), high.copy()
    for _ in range(60):
        mu, alpha = (np.linspace(x, y, 21) for x, y in zip(low, high))
        ll = np.array([[np.log(m + z * a).sum() - m * span - z * mass for z in alpha] for m in mu])
        i, j = np.unravel_index(ll.argmax(), ll.shape)
        best, width = np.array([mu[i], alpha[j]]), (high - low) / 5
        low, high = np.maximum(best - width, ends[0]), np.minimum(best + width, ends[1])
    return best, ll.max()


@pytest.mark.parametrize("bounded_mu", [True, False])
def test_hawkes_fit_on_the_faces_of_the_box(spark, bounded_mu):
    """Maxima on the top of mu, on the cap of alpha and inside, together in one fit of two keys a row."""
    hour = 60 * MIN
    times = {"close": [0, 60], "pair": [0, 344], "late": [0, *range(72_000, 72_020)], "calm": [0, 3600, 3900, 7200, 36_000, 36_300]}
    rows = [dict(post_id=i, author=a, genre=g, us=g * 1000 * hour + s * 1_000_000)
            for i, (a, g, s) in enumerate((a, g, s) for a, ts in times.items() for g in (1, 2) for s in ts)]
    p = spark.createDataFrame([tuple(r.values()) for r in rows], "post_id long, author string, genre int, us long")
    got = TL.hawkes_fit(p, ["genre", "author"], TL.HOURLY, bounded_mu=bounded_mu).collect()
    assert sorted((r.genre, r.author) for r in got) == sorted((g, a) for a in times for g in (1, 2))
    faces = set()
    for r in got:
        (mu, alpha), _ = box_maximum([s / 3600 for s in times[r.author]], TL.HOURLY, bounded_mu)
        assert (r.mu, r.alpha) == (pytest.approx(mu, rel=1e-5, abs=1e-8), pytest.approx(alpha, rel=1e-5, abs=1e-6)), r.author
        faces |= {"cap"} if r.alpha > 2.999999 else {"top"} if bounded_mu and r.mu == 10 * r.n / max(r.span, 1.0) else {"inside"}
    assert faces >= ({"cap", "top", "inside"} if bounded_mu else {"cap", "inside"})


def test_hawkes_fit_settles_in_few_jobs(spark, monkeypatch):
    """A root that Newton's steps have reached is not bisected away again: the ends of the brackets and two jobs of passes."""
    rng = random.Random(5)
    rows = [(i, f"a{i % 60}", int(rng.choice([rng.uniform(0, 700), 20 * (i % 7) + rng.uniform(0, 1)]) * 3_600_000_000)) for i in range(1500)]
    p = spark.createDataFrame(rows, "post_id long, author string, us long")
    made, stage = [], scale.stage
    monkeypatch.setattr(scale, "stage", lambda df: made.append(df.columns) or stage(df))
    assert TL.hawkes_fit(p, ["author"], TL.HOURLY).filter("alpha > 0").count() > 10
    assert sum("settled" in c for c in made) <= 3


def test_bursts_in_a_crowd(spark):
    """Dense posts with ties and posts on borders of blocks, against all pairs; no row reads all rows near it."""
    rng, window = random.Random(11), 10 * MIN
    rows = [(i, "hot" if i % 4 else "cool", rng.choice([rng.randrange(4 * window), window * rng.randrange(5), 30 * MIN + rng.randrange(9)]) - window,
             rng.choice(["a", "b", "", None])) for i in range(600)]
    marked = TL.bursts(spark.createDataFrame(rows, "post_id long, author string, us long, keyword string").repartition(5), ["author"])
    assert marked.columns == ["post_id", "author", "us", "keyword", "burst"]
    assert "rangeframe" not in marked._jdf.queryExecution().executedPlan().toString().lower()
    got = {r.post_id: r.burst for r in marked.collect()}
    for author in ("hot", "cool"):
        mine = sorted(((us, i, k) for i, a, us, k in rows if a == author))
        want = dict.fromkeys((i for _, i, _ in mine), 0)
        for p, (us, _, k) in enumerate(mine):
            inside = [i for t, i, _ in mine[p:] if t <= us + window]
            if k and len(inside) >= 3:
                want |= {i: max(want[i], len(inside)) for i in inside}
        assert {i: got[i] for i in want} == want


def test_audit_excites_posts_once(spark, monkeypatch):
    """Fit and spikes rest on the same excitation, which is made once; a key on the cap of alpha settles in few jobs."""
    rows = [(i, "e", "u", "k", "x", 60.0, (i // 50 * 1440 + i % 50) * MIN // 2) for i in range(400)]
    p = spark.createDataFrame(rows, "post_id long, entity string, author string, keyword string, platform string, sentiment_score double, us long")
    calls, made, excitation, stage = [], [], TL.excitation, scale.stage
    monkeypatch.setattr(TL, "excitation", lambda *a: calls.append(a) or excitation(*a))
    monkeypatch.setattr(scale, "stage", lambda df: made.append(df.columns) or stage(df))
    fits, marked, _ = A.author_audit(p, "entity")
    assert len(calls) == 1 and sum("settled" in c for c in made) <= 6
    assert one(fits).alpha == pytest.approx(one(marked.select("alpha").distinct()).alpha) and marked.count() == 400


# ---- text and similarity -------------------------------------------------------------------------------------------
def test_genre_weights(spark):
    rows = [("a1", "x", "A ghost, the GHOST and a robot", "war", None, None), ("a2", "reddit", "nothing", None, "love love", None),
            ("a3", "instagram", "a goal", None, None, "REEL"), ("a4", "x", "warrior", None, None, None)]
    df = spark.createDataFrame(rows, "post_id string, platform string, text string, keyword string, title string, media_type string")
    got = {(r.post_id, r.genre): r.weight for r in X.label_posts(df).collect()}
    assert got == {("a1", "Horror"): 2.0, ("a1", "Sci-Fi"): 1.0, ("a1", "Action"): 2.0, ("a2", "Romance"): 5.0,
                   ("a3", "Sports"): 1.5, ("a4", "Action"): 1.0}


def test_trigram_similarity_value(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    assert df.select(C.trigram_similarity(C.trigrams("a"), C.trigrams("b"))).first()[0] == pytest.approx(4 / 11)


@pytest.mark.parametrize("threshold", [0.35, 0.6])
def test_trigram_pairs_lose_nothing(spark, threshold):
    rng = random.Random(1)
    words = ["red", "blue", "ring", "rings", "wing", "king", "bread", "thread"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.text, r.other) for r in S.trigram_pairs(df, df, [], threshold).collect()}

    def grams(s):
        return {f"  {w} "[i:i + 3] for w in s.split() for i in range(len(w) + 1)}

    want = {(a, b) for a in texts for b in texts if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= threshold}
    assert got == want


def test_neighbors_over_blocks(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, "g" if i % 3 else "h", [float(x) for x in v]) for i, v in enumerate(vecs)],
                               "id long, grp string, vec array<double>")
    got = {(r.id, r.neighbor_id) for r in S.nearest_neighbors(df, df, 3, block_rows=7).collect()}
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = set()
    for i in range(60):
        pool = [j for j in range(60) if j != i and bool(j % 3) == bool(i % 3)]
        want |= {(i, j) for j in sorted(pool, key=lambda j: -(u[i] @ u[j]))[:3]}
    assert got == want


# ---- graph, titles, policies, files --------------------------------------------------------------------------------
def test_unresolved_retweeter_makes_no_edge(spark):
    about = spark.createDataFrame([("g1", 1, 20.5, 5), ("g2", 1, 1.0, 6)], "global_user_id string, entity_id long, weight double, us long")
    link = spark.createDataFrame([("g1", "user1"), ("g2", "user2")], "global_user_id string, normalized_author string")
    shared = spark.createDataFrame([("User_1", "RT @User_2: hi", 7), ("ghost", "RT @User_2: hi", 8)], "author string, text string, us long")
    rows = {(r.from_id, r.to_id, r.relation, r.weight) for r in G.edges(about, shared, link).collect()}
    assert ("USER:g1", "USER:g2", "RETWEETED", 1.0) in rows and len(rows) == 3


def test_prior_close_weekend_and_before_start(spark):
    idx = spark.createDataFrame([("I", dt.date(2024, 1, 4), 1.0), ("I", dt.date(2024, 1, 5), 2.0)], "index_name string, trade_date date, close double")
    t = spark.createDataFrame([(1, "I", dt.date(2024, 1, 7)), (2, "I", dt.date(2024, 1, 3))], "title_id long, index_name string, day date")
    assert {r.title_id: r.c for r in T.prior_close(t, idx, "day", "c").collect()} == {1: 2.0, 2: None}


def test_tied_prior_year_is_averaged(spark):
    rows = [("A", f"M{i}", y, "D", 1) for i, y in enumerate(["2000", "2001", "2001", "2002"])]
    credits = spark.createDataFrame(rows, "actor_name string, movie_name string, release_date string, director string, role_position int")
    fin = spark.createDataFrame([("m1|2001", 10.0, 20.0), ("m2|2001", 10.0, 5.0)], "movie_key string, own_budget double, own_revenue double")
    titles = spark.createDataFrame([("m3|2002", 2002, "D"), ("m0|2000", 2000, "D")], "movie_key string, release_year int, directors string")
    got = {r.movie_key: r for r in T.track_record(titles, T.clean_credits(credits, fin)).collect()}
    r = got["m3|2002"]
    assert (r.lead_prior_films, r.lead_last_hit, r.lead_last_ratio, r.director_prior_films, r.director_hit_rate) == (3, 0.5, 1.25, 3, 0.5)
    assert (got["m0|2000"].lead_prior_films, got["m0|2000"].director_hit_rate) == (0, None)


def test_time_split_falls_back_to_row_order(spark):
    df = spark.createDataFrame([(i, 2000 + i // 10) for i in range(20)], "title_id long, release_year int")
    assert {r.title_id for r in T.time_split(df).filter("is_test").collect()} == set(range(16, 20))


def test_mask_and_policy(spark):
    df = spark.createDataFrame([("ab", "abcd", "abcdef", None)], "a string, b string, c string, d string")
    assert tuple(df.select(*[C.mask_value(c) for c in df.columns]).first()) == ("**", "a***", "a***f", None)
    out = N.column_policy(df, "s.t", skip=["t.a"], mask=["a", "c"], patterns=["d"])
    assert out.columns == ["b", "c"] and out.first().c == "a***f"


def test_expression_whitelist():
    for bad in ("system(1)", "a; b", "mean + other"):
        with pytest.raises(ValueError):
            C.checked_expression(bad, ["mean"])


def test_activity_hole(spark):
    df = spark.createDataFrame([(10, 99), (10, 100), (10, 101), (20_000, 0)], "v long, c long")
    assert [r[0] for r in df.select(C.activity_class("v", "c")).collect()] == ["LOW_ACTIVITY", "UNKNOWN", "NOISE_MAKER", "LURKER"]


def test_files(spark):
    path = files.shared_folder(spark)
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    files.append_checked(a, path + "/t")
    with pytest.raises(ValueError):
        files.append_checked(a.withColumn("w", F.lit(1)), path + "/t")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    once = files.upsert(a, new, ["k"])
    assert sorted(map(tuple, files.upsert(once, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    files.publish(a, path + "/p")
    files.publish(once, path + "/p")
    assert files.read_published(spark, path + "/p").count() == 3


def test_audience_size(spark):
    p = posts(spark, [dict(author="a"), dict(author="a"), dict(author="b"), dict(author=" ")])
    assert one(A.audience_size(p)).audience_size == 2


# ---- texts and pairs at scale --------------------------------------------------------------------------------------
ODD = ["action\u00e9comedy", "\u00c9action comedy", "#music music", "\u201cmusic\u201d\u2014action", "a\x00music\x00b", "",
       "a real story about time travel", "ACTION \u0130action \u212a", None, "\U0001f600music\U0001f600fight", "\u015bmusic fight",
       "#plot\u2014acting plot", "##plot @music#plot", "time travel-time travel", "\u00e9real story", "music\x00music fight",
       "The plot is good. #plot is bad!\nNo acting? weak\u00e9 plot."]


@pytest.mark.parametrize("words", [["music", "fight", "comedy", "real story", "time travel"], ["plot", "acting", "music"]])
def test_condensed_text_has_the_same_hits(spark, words):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    short = df.select("id", "text", X.condensed(F.col("text"), words).alias("c"))
    for rule in (lambda c: X.word_hits(F.col(c), words), lambda c: X.word_hits(X.untagged(c), words)):
        for r in short.select("text", F.coalesce(rule("text"), F.array()).alias("whole"), rule("c").alias("short")).collect():
            assert r.whole == r.short, r.text
    long = spark.createDataFrame([("word " * 20_000 + "music",)], "text string")
    assert len(long.select(X.condensed(F.col("text"), words)).first()[0]) <= len(" music")


def test_sentences_with_loses_no_sentence(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    has = lambda c: F.filter(c, lambda s: F.size(X.word_hits(s, ["plot", "acting"])) > 0)
    every = F.coalesce(has(F.split(F.lower("text"), X.SENTENCE_BREAK)), F.array())
    for r in df.select(every.alias("every"), has(X.sentences_with(F.col("text"), ["plot", "acting"])).alias("kept")).collect():
        assert r.every == r.kept


def test_joined_texts_keep_their_partitions(spark, tmp_path):
    from flickpulse.plans.views import Tables
    spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    rows = [(i, dt.datetime(2024, 1, 1), i % 3, "click", 1.0, '{"k": 7}') for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
                          ).write.parquet(str(tmp_path / "events.parquet"))
    posts = Tables(spark, str(tmp_path)).posts
    assert posts.count() == 40
    plan = posts._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan  # texts by a fixed number, not by their file


def test_trigram_rows_carry_no_gram_texts(spark, monkeypatch):
    kept, real = [], scale.stage
    monkeypatch.setattr(scale, "stage", lambda df: kept.append(df.dtypes) or real(df))
    df = spark.createDataFrame([("h", "red ring"), ("h", "red rings"), ("k", "red ring"), (None, "red ring")], "h string, text string")
    got = S.trigram_pairs(df, df, ["h"], 0.6)
    assert {(r.h, r.text, r.other) for r in got.collect()} == {
        (h, a, b) for h in "h" for a in ("red ring", "red rings") for b in ("red ring", "red rings")} | {("k", "red ring", "red ring")}
    assert not any(kind == "array<string>" for types in kept for _, kind in types)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan  # rows exploded from small files are not collected by the driver


def test_fuzzy_title_join_collects_no_side(spark):
    ext = spark.createDataFrame([(1, "red ring", 2000), (2, "red ring", None), (3, "blue", 2000)], "ext_id long, name string, year int")
    cat = spark.createDataFrame([(7, "red rings", 2000), (8, "red ring", 2001)], "cat_id long, name string, year int")
    got = S.fuzzy_title_join(ext, cat)
    assert {(r.ext_id, r.cat_id) for r in got.collect()} == {(1, 7), (2, 8)}
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_news_of_a_name_is_searched_once(spark):
    day = dt.date(2020, 1, 10)
    cleaned = spark.createDataFrame([(i, "Odd Name", day + dt.timedelta(40 * i)) for i in range(4)] + [(9, "Name Odd", day), (10, "Odd Name", None)],
                                    "title_id long, movie_name string, release_day date")
    articles = spark.createDataFrame([(1, "odd, name: a boycott call", day), (2, "odd name again", day), (3, None, day)],
                                     "doc_id long, text string, pub_date date")
    got = {(r.title_id, r.event_class): r.flag for r in T.news_event_flags(cleaned, articles, phrases={"b": ["boycott"], "c": ["strike"]}).collect()}
    assert got == {(i, c): int(c == "b" and i in (0, 1)) for i in (0, 1, 2, 3, 9, 10) for c in "bc"}


def test_films_before_reads_its_credits_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    rows = [("a", 2000, 1), ("a", 2000, 2), ("a", 2001, 3), ("b", 2001, 4)]
    credits = spark.createDataFrame(rows, "actor_key string, year int, credit_order long").mapInPandas(
        count, "actor_key string, year int, credit_order long")
    got = {r.credit_order: r.films_before for r in T.films_before(credits, "credit_order").collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0} and seen.value == 4
