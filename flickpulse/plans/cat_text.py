"""Queries over texts, genres, aspects, similarity and the user graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from flickpulse.functions import vocab
from flickpulse.operators import graph as G
from flickpulse.operators import reach as R
from flickpulse.operators import similarity as S
from flickpulse.operators import text as X
from flickpulse.plans.cat_daily import LINKED
from flickpulse.plans.cat_posts import REACH, SCORE
from flickpulse.plans.cat_timeline import excite_sql, fit_sql
from flickpulse.plans.registry import query
from flickpulse.sources import posts as P

_q = lambda s: "'" + s.replace("'", "''") + "'"
VOCAB = "vocab(genre, w) AS (VALUES " + ", ".join(f"({_q(g)}, {_q(w)})" for g, ws in vocab.GENRE_WORDS.items()
                                                  for w in ws) + ")"
GENRE = VOCAB + r""",
    fields AS (SELECT post_id, platform, media_type,
                      CASE WHEN platform='reddit' THEN trim(title || ' ' || text) ELSE text END AS c, 1.0 AS k FROM posts
               UNION ALL SELECT post_id, platform, media_type, keyword, 2.0 FROM posts
               UNION ALL SELECT post_id, platform, media_type, title, 1.5 FROM posts WHERE platform='reddit'),
    toks AS (SELECT post_id, platform, media_type, k, regexp_split_to_array(lower(c), '[^\p{L}\p{N}_]+') AS ws FROM fields),
    one AS (SELECT post_id, platform, media_type, k, unnest(ws) AS w FROM toks),
    hits AS (SELECT post_id, platform, media_type, genre, k FROM one JOIN vocab USING (w)
             UNION ALL
             SELECT post_id, platform, media_type, genre, k*(length(s)-length(replace(s, ' ' || w || ' ', '')))
                    / (length(w)+2) FROM (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS s FROM toks) q
             JOIN vocab ON contains(w, ' ') AND contains(s, ' ' || w || ' ')),
    labels_ AS (SELECT post_id, genre, sum(k) * CASE
                    WHEN any_value(platform)='instagram' AND any_value(media_type)='VIDEO' AND genre IN ('Action','Sports','Music')
                    THEN 1.5 WHEN any_value(platform)='instagram' AND any_value(media_type)='CAROUSEL_ALBUM' THEN 1.1
                    ELSE 1.0 END AS weight FROM hits GROUP BY post_id, genre HAVING sum(k) >= 1.0)"""


def labelled(t):
    return X.label_posts(t.posts)


@query("genre_labels", GENRE + "SELECT post_id, genre, round(weight,6) AS weight FROM labels_")
def genre_labels(t):
    return labelled(t).select("post_id", "genre", "weight")


@query("genre_catalog", GENRE + """
    SELECT v.genre, n_words, coalesce(n_posts, 0) AS n_posts
    FROM (SELECT genre, count(*) AS n_words FROM vocab GROUP BY 1) v
    LEFT JOIN (SELECT genre, count(*) AS n_posts FROM labels_ GROUP BY 1) l USING (genre)""")
def genre_catalog(t):
    n = labelled(t).groupBy("genre").agg(F.count(F.lit(1)).alias("n_posts"))
    return X.genre_catalog(t.spark).join(n, "genre", "left").na.fill(0, ["n_posts"])


@query("posts_for_genre", GENRE + """,
    newest AS (SELECT * FROM posts_lean QUALIFY row_number() OVER (PARTITION BY platform
               ORDER BY us DESC NULLS LAST, post_id) <= 500)
    SELECT n.post_id, n.platform, n.us, round(weight,6) AS weight FROM newest n JOIN labels_ l USING (post_id)
    WHERE genre = 'Music' ORDER BY us DESC, post_id LIMIT 25""")
def posts_for_genre(t):
    newest = P.newest_per(t.posts, ["platform"], 500).drop("rn")
    hits = X.label_posts(newest).filter(F.lower("genre") == "music")
    return P.newest_page(hits, 0, 25).select("post_id", "platform", "us", "weight")


@query("genre_reach", GENRE + f"""
    SELECT genre, platform, sum({REACH}) AS total_reach, count(*) AS post_count
    FROM labels_ JOIN posts_lean USING (post_id) GROUP BY 1, 2""")
def genre_reach(t):
    return R.genre_reach(labelled(t))


INTEREST = ("(sentiment_score-50)/50 * ln(greatest(CASE platform WHEN 'x' THEN views WHEN 'reddit' THEN comments"
            " ELSE likes END, 0) + 1.0) * CASE WHEN platform='reddit' THEN greatest(likes,0) ELSE 1 END")
GI = GENRE + f""",
    gi AS (SELECT l.global_user_id, g.genre, sum({INTEREST} * weight) AS interest
           FROM labels_ g JOIN posts_lean p USING (post_id)
           JOIN identity_link l ON l.normalized_author = regexp_replace(lower(p.author), '[^a-z0-9]', '', 'g')
           WHERE sentiment_score <> 0 GROUP BY 1, 2)"""


@query("genre_interest", GI + "SELECT global_user_id, genre, round(interest,5)+0.0 AS interest FROM gi", digits=5)
def genre_interest(t):
    return X.genre_interest(labelled(t), t.identity_link)


@query("top_n_genres", GI + """
    SELECT global_user_id, genre, rn FROM (SELECT *, row_number() OVER (PARTITION BY global_user_id
           ORDER BY interest DESC, genre) AS rn FROM gi) q WHERE rn <= 3""")
def top_n_genres(t):
    from pyspark.sql import Window as W
    gi = X.genre_interest(labelled(t), t.identity_link)
    w = W.partitionBy("global_user_id").orderBy(F.desc("interest"), "genre")
    return gi.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("global_user_id", "genre", "rn")


@query("identity_join", """
    SELECT l.global_user_id, count(*) AS n_posts, count(DISTINCT platform) AS n_platforms FROM posts_lean p
    JOIN identity_link l ON l.normalized_author = regexp_replace(lower(p.author), '[^a-z0-9]', '', 'g') GROUP BY 1""")
def identity_join(t):
    return G.resolve_authors(t.posts_lean, t.identity_link).groupBy("global_user_id").agg(
        F.count(F.lit(1)).alias("n_posts"), F.countDistinct("platform").alias("n_platforms"))


EG = """
    eg AS (SELECT DISTINCT entity_id, trim(g) AS genre FROM (
             SELECT entity_id, unnest(string_split(genre, ',')) AS g FROM entities
             UNION ALL SELECT entity_id, unnest(string_split(genre, ',')) FROM entity_keywords
             WHERE category = 'media.movie') q)"""
MG = EG + """,
    mg AS (SELECT author, genre, sum(greatest(0, (sentiment_score-50)/50)) AS genre_score FROM (
             SELECT DISTINCT m.mention_id, m.author, m.sentiment_score, eg.genre FROM mentions m
             JOIN mention_entities me ON me.mention_id = m.mention_id JOIN eg ON eg.entity_id = me.managed_entity_id
             WHERE sentiment_score BETWEEN 1 AND 100) q GROUP BY 1, 2)"""


@query("entity_genre_explode", EG + "SELECT entity_id, genre FROM eg")
def entity_genre_explode(t):
    return X.entity_genres(t.entities, t.entity_keywords)


def mention_scores(t):
    return X.mention_genre_scores(t.mention_entities, t.mentions, X.entity_genres(t.entities, t.entity_keywords))


@query("viewer_affinity", MG + """
    SELECT s.author, s.genre, round(genre_score,6) AS genre_score, round(ln(genre_score/total),6)+0.0 AS ln_affinity,
           round(1/(1+exp(-genre_score/total*influence_rank)),6) AS p_conv
    FROM mg s JOIN (SELECT author, sum(genre_score) AS total FROM mg WHERE genre_score > 0 GROUP BY 1) t USING (author)
    JOIN profiles p ON p.global_user_id = s.author WHERE genre_score > 1.0""")
def viewer_affinity(t):
    return X.viewer_affinity(mention_scores(t), t.profiles).select("author", "genre", "genre_score", F.log("genre_affinity").alias("ln_affinity"),
                                                                   "p_conv")


@query("top_movie_genres", GENRE + "," + MG + f""",
    kg AS (SELECT keyword, min(genre) AS genre FROM (SELECT lower(keyword) AS keyword, trim(split_part(genre, ',', 1)) AS genre
           FROM entity_keywords WHERE category = 'media.movie') q GROUP BY 1),
    sw AS (SELECT *, greatest({INTEREST}, 0) AS w FROM posts_lean WHERE sentiment_score <> 0),
    u AS (SELECT author, genre, sum(w*weight) AS s FROM sw JOIN labels_ USING (post_id) GROUP BY 1, 2
          UNION ALL SELECT author, genre, 2*sum(w) FROM sw JOIN kg ON kg.keyword = lower(sw.keyword) GROUP BY 1, 2
          UNION ALL SELECT author, genre, genre_score FROM mg)
    SELECT author, genre, round(sum(s),5) AS score FROM u WHERE s > 0 GROUP BY 1, 2""", digits=5)
def top_movie_genres(t):
    kg = (t.entity_keywords.filter("category = 'media.movie'")
          .select(F.lower("keyword").alias("keyword"), F.trim(F.split("genre", ",")[0]).alias("genre"))
          .groupBy("keyword").agg(F.min("genre").alias("genre")))
    return X.top_movie_genres(labelled(t), t.posts_lean, kg, mention_scores(t))


@query("genre_spreaders", GENRE + """,
    gp AS (SELECT genre || '|' || author AS author, post_id, us FROM labels_ JOIN posts_lean USING (post_id)
           WHERE sentiment_score BETWEEN 1 AND 100),""" + excite_sql("gp", 3.0, "3600000000.0", "us - us % 1000000") + ","
       + fit_sql(3.0, "3600000000.0") + """,
    ga AS (SELECT split_part(author, '|', 1) AS genre, split_part(author, '|', 2) AS author, n, round(alpha,6)+0.0 AS alpha FROM fit),
    cu AS (SELECT genre, quantile_cont(alpha, 0.95) AS cutoff FROM ga GROUP BY 1)
    SELECT genre, author, n, round(alpha,4) AS alpha FROM ga JOIN cu USING (genre) WHERE alpha >= cutoff""",
       recursive=True)
def genre_spreaders(t):
    from flickpulse.operators import scale
    from flickpulse.operators import timeline as TL
    # the fit reads its rows several times; staged, the texts are read once
    hits = scale.stage(P.valid_sentiment(labelled(t)).select("genre", "author", "us", "post_id"))
    fits = TL.hawkes_fit(hits, ["genre", "author"], TL.HOURLY).filter("n >= 2")
    fits = scale.stage(fits.withColumn("alpha", F.round("alpha", 6) + 0.0))
    cut = scale.exact_quantiles(fits, "alpha", {"cutoff": 0.95}, ("genre",))
    return fits.join(cut, "genre").filter("alpha >= cutoff").select("genre", "author", "n", F.round("alpha", 4).alias("alpha"))


# ---- aspects -------------------------------------------------------------------------------------------------------
NOUNS = vocab.ASPECT_NOUNS + ["song", "album", "team", "magic", "robot", "love", "war"]
LIST = ", ".join(_q(n) for n in NOUNS)
TERMS = rf"""
    terms AS (SELECT author, aspect, avg(sentiment_score) AS score, count(*) AS n FROM (
                SELECT DISTINCT post_id, author, sentiment_score, w AS aspect FROM (
                  SELECT post_id, author, sentiment_score,
                         unnest(regexp_split_to_array(lower(regexp_replace(text, '[#@][\p{{L}}\p{{N}}_]+', ' ', 'g')),
                                                      '[^\p{{L}}\p{{N}}_]+')) AS w FROM posts) q
                WHERE w IN ({LIST})) r GROUP BY 1, 2)"""


@query("aspect_terms", TERMS + "SELECT author, aspect, n, round(score,6) AS score FROM terms")
def aspect_terms(t):
    return X.aspect_terms(t.posts, NOUNS)


@query("top_aspects", TERMS + """
    SELECT aspect, count(*) AS n_authors FROM terms GROUP BY 1 ORDER BY n_authors DESC, aspect LIMIT 5""")
def top_aspects(t):
    return X.top_aspects(X.aspect_terms(t.posts, NOUNS), 5)


LEX = "lex(w, v) AS (VALUES " + ", ".join(f"({_q(w)}, {v})" for w, v in vocab.POLARITY.items()) + ")"
_N = ", ".join(_q(n) for n in vocab.ASPECT_NOUNS)


def sentence_sql(source: str, key: str) -> str:
    return LEX + rf""",
    sent AS (SELECT {key}, generate_subscripts(ss, 1) - 1 AS sentence_no, unnest(ss) AS s
             FROM (SELECT {key}, regexp_split_to_array(lower(text), '[.!?\n]+') AS ss FROM {source}) q),
    stok AS (SELECT {key}, sentence_no, unnest(regexp_split_to_array(s, '[^\p{{L}}\p{{N}}_]+')) AS w FROM sent),
    pol AS (SELECT {key}, sentence_no, least(greatest(sum(coalesce(v, 0)), -2), 2) AS polarity
            FROM stok LEFT JOIN lex USING (w) GROUP BY 1, 2)"""


@query("sentence_polarity", sentence_sql("synopses", "doc_id") + """
    SELECT doc_id, sentence_no, polarity FROM pol""")
def sentence_polarity(t):
    return X.sentence_polarity(t.synopses, ["doc_id"]).select("doc_id", "sentence_no", "polarity")


ASPECT = sentence_sql("posts", "post_id") + rf""",
    atok AS (SELECT post_id, sentence_no,
                    unnest(regexp_split_to_array(regexp_replace(s, '[#@][\p{{L}}\p{{N}}_]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_]+')) AS w FROM sent),
    asp AS (SELECT post_id, w AS aspect, avg(25.0*(polarity+2)) AS score FROM atok JOIN pol USING (post_id, sentence_no)
            WHERE w IN ({_N}) GROUP BY 1, 2),
    ag AS (SELECT keyword, platform, aspect, sum(score) AS sentiment_sum, count(*) AS mention_count,
                  count(DISTINCT author) AS distinct_authors FROM asp JOIN posts_lean USING (post_id) GROUP BY 1, 2, 3)"""


def per_post_aspects(t):
    return X.aspect_sentence_sentiment(t.posts, ["post_id", "author", "keyword", "platform"])


@query("aspect_sentence_sentiment", ASPECT + "SELECT post_id, aspect, round(score,6) AS score FROM asp")
def aspect_sentence_sentiment(t):
    return per_post_aspects(t).select("post_id", "aspect", "score")


@query("aspect_agg", ASPECT + """
    SELECT keyword, platform, aspect, round(sentiment_sum,4) AS sentiment_sum, mention_count, distinct_authors FROM ag""",
       digits=4)
def aspect_agg(t):
    return X.aspect_agg(per_post_aspects(t))


ROLL = ASPECT + """,
    ro AS (SELECT coalesce(platform, 'all') AS platform, aspect, sum(sentiment_sum) AS sentiment_sum,
                  sum(mention_count) AS mention_count, sum(distinct_authors) AS distinct_authors
           FROM ag GROUP BY GROUPING SETS ((aspect), (platform, aspect)))"""


@query("rollup_platform", ROLL + """
    SELECT platform, aspect, round(sentiment_sum,4) AS sentiment_sum, mention_count, distinct_authors FROM ro""", digits=4)
def rollup_platform(t):
    return X.rollup_platforms(X.aspect_agg(per_post_aspects(t)))


@query("aspect_drivers", ROLL + """
    SELECT platform, aspect, CASE WHEN a > 50 THEN 'strength' ELSE 'weakness' END AS kind,
           floor(a*1000+0.5)/1000 AS average_sentiment, mention_count, distinct_authors,
           floor((50 + (a-50)*distinct_authors/(distinct_authors+3))*1000+0.5)/1000 AS impact
    FROM (SELECT *, sentiment_sum/mention_count AS a FROM ro WHERE mention_count >= 3 AND distinct_authors >= 3) q
    WHERE a <> 50 AND a <> 0""")
def aspect_drivers(t):
    return X.aspect_drivers(X.rollup_platforms(X.aspect_agg(per_post_aspects(t))))


@query("conflict_balance", sentence_sql("synopses", "doc_id") + """,
    ms AS (SELECT doc_id, sum(greatest(polarity,0)) AS p, sum(greatest(-polarity,0)) AS n FROM pol GROUP BY 1),
    rw AS (SELECT doc_id, p, n, CASE WHEN p+n>0 THEN 1-abs(p-n)/(p+n) ELSE 0 END
                  * CASE WHEN k>0 THEN (p+n)/((p+n)+k) ELSE 0 END AS raw
           FROM ms, (SELECT median(p+n) AS k FROM ms) q)
    SELECT doc_id, p, n, round(raw,6) AS raw,
           round(0.25 + (rank() OVER (ORDER BY raw) - 1)/count(*) OVER () * 0.1, 6) AS conflict_balance_score FROM rw""")
def conflict_balance(t):
    return X.conflict_balance(t.synopses).select("doc_id", "p", "n", "raw", "conflict_balance_score")


# ---- similarity ----------------------------------------------------------------------------------------------------
NEAR = """
    nn AS (SELECT a.id, b.id AS neighbor_id, a.genre,
                  list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) AS similarity
           FROM corpus a JOIN corpus b ON a.genre = b.genre AND a.id <> b.id),
    top AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbor_id) <= 10)"""


@query("nearest_neighbors", NEAR + "SELECT id, neighbor_id, round(similarity,6)+0.0 AS similarity FROM top")
def nearest_neighbors(t):
    v = t.corpus.select("id", F.col("genre").alias("grp"), "vec")
    return S.nearest_neighbors(v, v, 10).select("id", "neighbor_id", "similarity")


FR = r"""
    nm AS (SELECT DISTINCT name FROM corpus),
    st AS (SELECT name, lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(name),
               '(?i)\s*[:\-–]?\s*(part|chapter|vol\.?|volume|book)\s+[ivxlcdm0-9]+\s*$', ''),
               '(?i)\s+[ivxlcdm]{1,6}\s*$', ''), '\s+[0-9]{1,2}\s*$', ''))) AS stem,
               lower(trim(CASE WHEN instr(name, ':') > 4 THEN substr(name, 1, instr(name, ':') - 1) ELSE name END)) AS prefix
           FROM nm),
    fr AS (SELECT name, stem, prefix, count(*) OVER (PARTITION BY stem) >= 2
                  OR count(*) OVER (PARTITION BY prefix) >= 2 AS franchise FROM st)"""


@query("franchise_flag", FR + "SELECT name, stem, prefix, franchise FROM fr")
def franchise_flag(t):
    return S.franchise_flag(t.corpus)


@query("narrative_novelty", NEAR + "," + FR + """,
    raw_ AS (SELECT id, 1 - avg(similarity) AS r FROM top GROUP BY 1),
    sz AS (SELECT genre, count(*) AS n FROM corpus GROUP BY 1),
    sc AS (SELECT c.id, franchise, r * CASE WHEN franchise THEN 0.7 ELSE 1 END AS raw,
                  CASE WHEN n >= 20 THEN c.genre ELSE '*small*' END AS pool
           FROM corpus c JOIN raw_ USING (id) JOIN fr USING (name) JOIN sz USING (genre))
    SELECT id, franchise, round(raw,6) AS raw,
           round(0.30 + (rank() OVER (PARTITION BY pool ORDER BY raw) - 1)/count(*) OVER (PARTITION BY pool)*0.15, 6) AS novelty
    FROM sc""")
def narrative_novelty(t):
    return S.narrative_novelty(t.corpus).select("id", "franchise", "raw", "novelty")


@query("novelty_score_new", """
    nn AS (SELECT a.id, list_cosine_similarity(list_reverse(a.vec)::DOUBLE[], b.vec::DOUBLE[]) AS s, b.id AS nid
           FROM corpus a JOIN corpus b ON a.genre = b.genre),
    top AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, nid) <= 5)
    SELECT id, round(1 - avg(s),6) AS raw FROM top GROUP BY 1""")
def novelty_score_new(t):
    new = t.corpus.withColumn("vec", F.reverse("vec"))
    return S.raw_novelty(new, t.corpus, 5, skip_self=False).select("id", "raw")


def trgm_sql(c: str) -> str:
    return (rf"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), "
            "lambda w: w <> ''), lambda w: list_transform(range(1, length(w)+2), lambda i: substr('  ' || w || ' ', i, 3)))))")


RT = rf"""
    rt AS (SELECT post_id AS rt_id, us, regexp_replace(lower(regexp_extract(text, '^RT @(\w+):', 1)), '[^a-z0-9]', '', 'g') AS h,
                  substr(regexp_replace(text, '^RT @\w+:\s*', ''), 1, 40) AS b FROM shared_posts
           WHERE regexp_matches(text, '^RT @\w+:')),
    og AS (SELECT post_id, us, regexp_replace(lower(author), '[^a-z0-9]', '', 'g') AS h, substr(text, 1, 40) AS b
           FROM shared_posts WHERE NOT regexp_matches(text, '^RT @\w+:')),
    rg AS (SELECT *, {trgm_sql('b')} AS g FROM rt), oo AS (SELECT *, {trgm_sql('b')} AS g FROM og),
    pr AS (SELECT rt_id, o.post_id AS original_id, o.us AS ous,
                  len(list_intersect(r.g, o.g)) / (len(r.g) + len(o.g) - len(list_intersect(r.g, o.g))) AS similarity
           FROM rg r JOIN oo o ON o.h = r.h AND o.us < r.us WHERE len(r.g) > 0),
    bm AS (SELECT * FROM pr WHERE similarity >= 0.6
           QUALIFY row_number() OVER (PARTITION BY rt_id ORDER BY similarity DESC, ous DESC, original_id) = 1)"""


@query("retweet_match", RT + "SELECT rt_id, original_id, round(similarity,6) AS similarity FROM bm")
def retweet_match(t):
    return S.retweet_match(t.shared_posts)


@query("retweet_share_counts", RT + "SELECT original_id AS post_id, count(*) AS shares FROM bm GROUP BY 1")
def retweet_share_counts(t):
    return S.share_counts(S.retweet_match(t.shared_posts))


@query("edge_counts", r"""
    SELECT author, regexp_extract(text, '^RT @(\w+):', 1) AS handle, count(*) AS n FROM shared_posts
    WHERE regexp_matches(text, '^RT @\w+:') GROUP BY 1, 2""")
def edge_counts(t):
    return G.retweet_counts(t.shared_posts)


@query("fuzzy_title_join", f"""
    e AS (SELECT *, {trgm_sql('name')} AS g FROM external_names), c AS (SELECT name, year, min(p_partkey) AS cat_id,
          {trgm_sql('name')} AS g FROM catalog_names GROUP BY name, year),
    du AS (SELECT DISTINCT name, year, g FROM e),
    p AS (SELECT d.name AS ename, d.year AS eyear, c.cat_id, c.name AS matched_name,
                 len(list_intersect(d.g, c.g)) / (len(d.g) + len(c.g) - len(list_intersect(d.g, c.g))) AS similarity
          FROM du d JOIN c ON d.year IS NULL OR c.year = d.year),
    b AS (SELECT * FROM p WHERE similarity >= 0.35 QUALIFY row_number() OVER (PARTITION BY ename, eyear
          ORDER BY similarity DESC, matched_name, cat_id) = 1)
    SELECT ext_id, cat_id, matched_name, round(similarity,6) AS similarity FROM e
    JOIN b ON b.ename = e.name AND b.eyear IS NOT DISTINCT FROM e.year""")
def fuzzy_title_join(t):
    cat = t.catalog_names.withColumnRenamed("p_partkey", "cat_id")
    return S.fuzzy_title_join(t.external_names, cat).select("ext_id", "cat_id", "matched_name", "similarity")


ASP = TERMS + """,
    av AS (SELECT author AS u, aspect, score AS v FROM terms WHERE score <> 0),
    sh AS (SELECT author AS u, platform, sentiment_category AS cat, count(*)/sum(count(*)) OVER (PARTITION BY author, platform) AS q
           FROM posts_lean WHERE sentiment_score <> 0 GROUP BY author, platform, sentiment_category),
    pf AS (SELECT global_user_id AS u, tribe_label, moi_score, total_posts FROM profiles),
    seeds_ AS (SELECT u AS seed, tribe_label, moi_score AS sm FROM pf QUALIFY row_number() OVER (ORDER BY total_posts DESC, u) <= 5)"""
LOOK = ASP + """,
    dfq AS (SELECT aspect, count(*) AS df FROM av GROUP BY 1), nn AS (SELECT count(*) AS n, stddev_pop(moi_score) AS sd FROM pf),
    wv AS (SELECT u, aspect, v*(ln((n+1)/(df+1))+1) AS w FROM av JOIN dfq USING (aspect), nn),
    nr AS (SELECT u, sqrt(sum(w*w)) AS norm FROM wv GROUP BY 1),
    pa AS (SELECT seed, p.u, p.moi_score, sm FROM pf p JOIN seeds_ s ON s.tribe_label = p.tribe_label AND s.seed <> p.u
           WHERE total_posts >= 5),
    tp AS (SELECT seed, pa.u, coalesce(sum(a.w*b.w),0)/(max(n1.norm)*max(n2.norm)) AS topic_sim FROM pa
           JOIN nr n1 ON n1.u = pa.u JOIN nr n2 ON n2.u = pa.seed LEFT JOIN wv a ON a.u = pa.u
           LEFT JOIN wv b ON b.u = pa.seed AND b.aspect = a.aspect GROUP BY 1, 2),
    pl AS (SELECT DISTINCT u, platform FROM sh),
    hs AS (SELECT seed, pa.u, pl.platform, (SELECT sqrt(sum(pow(sqrt(coalesce(x.q,0))-sqrt(coalesce(y.q,0)),2))/2) FROM
             (SELECT cat, q FROM sh WHERE sh.u = pa.u AND sh.platform = pl.platform) x FULL JOIN
             (SELECT cat, q FROM sh WHERE sh.u = pa.seed AND sh.platform = pl.platform) y USING (cat)) AS h
           FROM pa JOIN pl ON pl.u = pa.u JOIN pl p2 ON p2.u = pa.seed AND p2.platform = pl.platform),
    se AS (SELECT seed, u, avg(1-h) AS sentiment_sim FROM hs GROUP BY 1, 2),
    look AS (SELECT pa.seed, pa.u, topic_sim, sentiment_sim, exp(-(sm-moi_score)*(sm-moi_score)/(2*sd*sd)) AS moi_sim
             FROM pa LEFT JOIN tp USING (seed, u) LEFT JOIN se USING (seed, u), nn),
    lk AS (SELECT *, (coalesce(.5*topic_sim,0)+coalesce(.3*sentiment_sim,0)+.2*moi_sim)
              / (CASE WHEN topic_sim IS NULL THEN 0 ELSE .5 END + CASE WHEN sentiment_sim IS NULL THEN 0 ELSE .3 END + .2) AS similarity
           FROM look)"""


def look_inputs(t):
    from flickpulse.operators import audience as A
    from flickpulse.operators import scale
    # one row per user, seed, (user, aspect) and (user, platform, tone): each is read many times, the posts only once
    prof = scale.stage(t.profiles.withColumnRenamed("global_user_id", "user"))
    seeds = scale.stage(prof.orderBy(F.desc("total_posts"), "user").limit(5).select("user"))
    aspects = X.aspect_terms(t.posts, NOUNS).select(F.col("author").alias("user"), "aspect", F.col("score").alias("value"))
    mood = A.sentiment_distribution(t.posts_lean, ["author", "platform"]).select(
        F.col("author").alias("user"), "platform", "sentiment_category", "share")
    return seeds, prof, scale.stage(aspects), scale.stage(mood)


@query("lookalikes", LOOK + """
    SELECT seed, u AS user, round(topic_sim,6) AS topic_sim, round(sentiment_sim,6) AS sentiment_sim,
           round(moi_sim,6) AS moi_sim, round(similarity,6) AS similarity FROM lk""")
def lookalikes(t):
    return S.lookalikes(*look_inputs(t)).select("seed", "user", "topic_sim", "sentiment_sim", "moi_sim", "similarity")


L2 = ASP + """,
    cell AS (SELECT u, 'moi' AS dim, moi_score AS v FROM pf WHERE moi_score <> 0
             UNION ALL SELECT u, 'a:' || aspect, v FROM av
             UNION ALL SELECT u, 's:' || platform || ':' || cat, q FROM sh),
    dense AS (SELECT p.u, d.dim, coalesce(c.v, 0) AS v FROM pf p CROSS JOIN (SELECT DISTINCT dim FROM cell) d
              LEFT JOIN cell c ON c.u = p.u AND c.dim = d.dim),
    zz AS (SELECT u, dim, CASE WHEN stddev_pop(v) OVER (PARTITION BY dim) > 1e-9 THEN
                  (v - avg(v) OVER (PARTITION BY dim)) / stddev_pop(v) OVER (PARTITION BY dim) ELSE 0 END AS z FROM dense),
    l2 AS (SELECT s.seed, p.u, 1/(1+sqrt(sum((a.z-b.z)*(a.z-b.z)))) AS similarity
           FROM seeds_ s JOIN pf p ON p.tribe_label = s.tribe_label AND p.u <> s.seed
           JOIN zz a ON a.u = p.u JOIN zz b ON b.u = s.seed AND b.dim = a.dim GROUP BY 1, 2)"""


@query("lookalikes_l2", L2 + "SELECT seed, u AS user, round(similarity,5) AS similarity FROM l2", digits=5)
def lookalikes_l2(t):
    return S.lookalikes_l2(*look_inputs(t))


MOVE = LOOK + "," + L2[len(ASP) + 1:] + """,
    pa1 AS (SELECT seed, u, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, u) AS place_a FROM l2),
    pb1 AS (SELECT seed, u, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, u) AS place_b FROM lk)"""


@query("rank_movement", MOVE + """
    SELECT seed, u AS user, place_a, place_b, place_a - place_b AS moved FROM pa1 JOIN pb1 USING (seed, u)
    WHERE place_a <= 20 AND place_b <= 20""")
def rank_movement(t):
    args = look_inputs(t)
    return S.rank_movement(S.lookalikes_l2(*args), S.lookalikes(*args), 20).select("seed", "user", "place_a", "place_b",
                                                                                   "moved")


@query("ranking_overlap", MOVE + """
    SELECT seed, u AS user FROM pa1 WHERE place_a <= 20 INTERSECT SELECT seed, u FROM pb1 WHERE place_b <= 20""")
def ranking_overlap(t):
    args = look_inputs(t)
    from pyspark.sql import Window as W
    w = W.partitionBy("seed").orderBy(F.desc("similarity"), "user")
    top = lambda df: (df.withColumn("rn", F.row_number().over(w)).filter("rn <= 20")
                      .select("seed", "user"))
    return top(S.lookalikes_l2(*args)).intersect(top(S.lookalikes(*args)))


@query("exclude_seeds", """
    s AS (SELECT global_user_id FROM profiles ORDER BY total_posts DESC, global_user_id LIMIT 5)
    SELECT global_user_id FROM profiles WHERE global_user_id NOT IN (SELECT global_user_id FROM s)""")
def exclude_seeds(t):
    seeds = t.profiles.orderBy(F.desc("total_posts"), "global_user_id").limit(5).select("global_user_id")
    return t.profiles.select("global_user_id").exceptAll(seeds)


# ---- graph ---------------------------------------------------------------------------------------------------------
ABOUT = LINKED + f""",
    about AS (SELECT i.global_user_id, l.entity_id, sum({SCORE.replace('platform', 'p.platform')}) AS weight, max(m.us) AS us
              FROM links l JOIN mentions m ON m.mention_id = l.mention_id
              JOIN posts_lean p ON p.platform = m.platform AND p.post_id = m.post_id
              JOIN identity_link i ON i.normalized_author = regexp_replace(lower(m.author), '[^a-z0-9]', '', 'g') GROUP BY 1, 2),
    nodes AS (SELECT 'MOVIE:' || entity_id AS id, 'MOVIE' AS type, name, language FROM entities WHERE type = 'MOVIE'
              UNION ALL SELECT DISTINCT 'USER:' || global_user_id, 'USER', global_user_id, NULL FROM about),
    rtw AS (SELECT a.global_user_id AS fu, b.global_user_id AS tu, count(*) AS weight, max(us) AS us FROM shared_posts s
            JOIN identity_link a ON a.normalized_author = regexp_replace(lower(s.author), '[^a-z0-9]', '', 'g')
            JOIN identity_link b ON b.normalized_author = regexp_replace(lower(regexp_extract(s.text, '^RT @(\\w+):', 1)), '[^a-z0-9]', '', 'g')
            WHERE regexp_matches(s.text, '^RT @\\w+:') GROUP BY 1, 2),
    edges AS (SELECT 'USER:' || global_user_id AS from_id, 'MOVIE:' || entity_id AS to_id, 'POSTED_ABOUT' AS relation,
                     weight, us FROM about
              UNION ALL SELECT 'USER:' || fu, 'USER:' || tu, 'RETWEETED', weight, us FROM rtw
              WHERE fu IN (SELECT global_user_id FROM about) AND tu IN (SELECT global_user_id FROM about))"""


def graph(t):
    about = G.posted_about(t.mention_entities, t.mentions, t.entities, t.posts_lean, t.identity_link)
    return G.nodes(t.entities, about), G.edges(about, t.shared_posts, t.identity_link)


@query("graph_nodes", ABOUT + "SELECT id, type, name, language FROM nodes")
def graph_nodes(t):
    return graph(t)[0]


@query("graph_edges", ABOUT + "SELECT from_id, to_id, relation, weight, us FROM edges")
def graph_edges(t):
    return graph(t)[1]


@query("graph_filter", ABOUT + """,
    tt AS (SELECT id FROM nodes WHERE type = 'MOVIE' AND lower(language) = 'l1'),
    kk AS (SELECT id FROM tt UNION SELECT from_id FROM edges WHERE relation = 'POSTED_ABOUT' AND to_id IN (SELECT id FROM tt))
    SELECT relation, count(*) AS n_edges, sum(weight) AS weight, count(DISTINCT from_id) AS n_from FROM edges
    WHERE from_id IN (SELECT id FROM kk) AND to_id IN (SELECT id FROM kk) GROUP BY 1""")
def graph_filter(t):
    _, among = G.graph_filter(*graph(t), "L1")
    return among.groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight"),
                                         F.countDistinct("from_id").alias("n_from"))

