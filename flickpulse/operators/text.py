"""Genres, aspects, sentence polarity and conflict balance: built-in string functions over whole texts."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flickpulse.functions import columns as C
from flickpulse.functions import vocab
from flickpulse.operators import engagement as E
from flickpulse.operators import scale

WORD_BREAK = r"[^\p{L}\p{N}_]+"
SENTENCE_BREAK = r"[.!?\n]+"


def _literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_hits(text: Column, words) -> Column:
    """Every whole-word hit of the vocabulary in the lower-cased text: tokens by hash lookup, phrases by pattern."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    single = [w for w in words if " " not in w]
    hits = F.filter(F.split(lowered, WORD_BREAK), lambda w: w.isin(*single))
    phrases = [w for w in words if " " in w]
    if not phrases:
        return hits
    pattern = r"(?<![\p{L}\p{N}_])(" + "|".join(phrases) + r")(?![\p{L}\p{N}_])"
    possible = reduce(lambda x, y: x | y, [F.contains(lowered, F.lit(p)) for p in phrases])  # cheap test first
    return F.when(possible, F.concat(hits, F.regexp_extract_all(lowered, F.lit(pattern), F.lit(1)))).otherwise(hits)


def _plain(words) -> bool:
    """Lower-case ASCII words and phrases of such words, none of which can overlap another phrase."""
    phrases = [w.split(" ") for w in words if " " in w]
    overlap = any(a[-n:] == b[:n] for a in phrases for b in phrases for n in range(1, min(len(a), len(b)) + (a != b)))
    return not overlap and all(re.fullmatch(r"[a-z0-9_]+( [a-z0-9_]+)*", w) for w in words)


def condensed(text: Column, words) -> Column:
    """The lower-cased text with everything but the places of ``words`` shrunk to one blank.

    A place is kept with the mark or the character beyond ASCII beside it, so whole-word rules, hashtags and handles
    decide the same on the short text as on the whole one. One linear pass over the text replaces the splitting of all
    of it into words.
    """
    lowered = F.lower(F.coalesce(text, F.lit("")))
    # words that are no tokens are left to the caller's rule, which never finds them either
    words = sorted({w for w in words if re.fullmatch(r"[\w ]+", w)}, key=lambda w: (-len(w), w))
    if not words or not _plain(words):
        return lowered
    pattern = r"(?:[#@]|[^\x00-\x7F])?\b(?:" + "|".join(words) + r")\b[^\x00-\x7F]?"

    def shrink(texts: pa.Array) -> pa.Array:
        # \x00 marks where a place begins and ends; a text's own one is no letter and becomes a blank
        plain = pc.replace_substring(texts, "\x00", " ")
        pieces = pc.split_pattern(pc.replace_substring_regex(plain, pattern, "\x00\\0\x00"), "\x00")
        flat, offsets = pc.list_flatten(pieces), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        between = (np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))) % 2 == 0  # every other piece
        blank = pc.if_else(pc.equal(pc.binary_length(flat), 0), "", " ")
        kept = pc.if_else(pa.array(between), blank, flat)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kept), "")

    return F.arrow_udf(shrink, "string")(lowered)


def sentences_with(text: Column, words) -> Column:
    """The lower-cased sentences of a text that hold one of ``words``, or more of them: the caller's rule decides."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    if not words or not _plain(words):
        return F.split(lowered, SENTENCE_BREAK)
    pattern = r"\b(?:" + "|".join(words) + r")\b"

    def pick(texts: pa.Array) -> pa.Array:
        split = pc.split_pattern_regex(texts, SENTENCE_BREAK)
        flat, parents = pc.list_flatten(split), pc.list_parent_indices(split)
        found = pc.match_substring_regex(flat, pattern)
        counts = np.bincount(pc.filter(parents, found).to_numpy(), minlength=len(texts))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pc.filter(flat, found))

    return F.arrow_udf(pick, "array<string>")(lowered)


def weighted_hits(content: Column, keyword: Column, title: Column | None = None,
                  platform: Column | None = None, genres: dict | None = None) -> Column:
    """Array of (word, weight) per vocabulary hit: content x1, keyword x2, Reddit title x1.5."""
    genres = genres or vocab.GENRE_WORDS
    words = sorted({w for ws in genres.values() for w in ws})
    fields = [(word_hits(content, words), 1.0), (word_hits(keyword, words), 2.0)]
    if title is not None:
        fields.append((word_hits(F.when(platform == "reddit", title), words), 1.5))

    def weighted(hits, weight):
        return F.transform(hits, lambda w: F.struct(w.alias("w"), F.lit(weight).alias("k")))

    return F.concat(*[weighted(h, k) for h, k in fields])


def genre_scores(hits: Column, platform: Column, media_type: Column, genres: dict | None = None) -> Column:
    """Array of (genre, weight) with weight >= 1, after the Instagram media boosts."""
    m = F.when(platform == "instagram", F.upper(media_type))
    carousel = F.when(m.isin("CAROUSEL_ALBUM", "CAROUSEL"), 1.1).otherwise(1.0)
    video = F.when(m.isin("VIDEO", "REEL", "REELS"), 1.5).otherwise(carousel)

    def pair(g, words):  # a map from word to genre would be built anew for every hit
        total = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + F.when(h["w"].isin(*words), h["k"]).otherwise(0.0))
        boost = video if g in ("Action", "Sports", "Music") else carousel
        return F.struct(F.lit(g).alias("genre"), (total * boost).alias("weight"))

    return F.filter(F.array(*[pair(g, ws) for g, ws in (genres or vocab.GENRE_WORDS).items()]),
                    lambda p: p["weight"] >= 1.0)


def label_posts(posts: DataFrame, title_weight: bool = True, keep: list[str] | None = None) -> DataFrame:
    """One row per (post, genre); the text itself is dropped so that later shuffles stay narrow."""
    content = F.when(F.col("platform") == "reddit", F.trim(F.concat_ws(" ", "title", "text"))).otherwise(F.col("text"))
    keep = keep or [c for c in posts.columns if c not in ("text", "title")]
    words = {w for ws in vocab.GENRE_WORDS.values() for w in ws}
    used = dict.fromkeys([*keep, "keyword", "platform", "media_type", "title"])
    short = posts.select(*used, condensed(content, words).alias("content_"))
    hits = weighted_hits(F.col("content_"), F.col("keyword"), F.col("title") if title_weight else None, F.col("platform"))
    scores = genre_scores(F.col("hits_"), F.col("platform"), F.col("media_type"))
    return (short.select(*keep, hits.alias("hits_"))  # a filter on the hits would make Spark compute them twice
            .select(*keep, F.explode(scores).alias("label_")).select(*keep, "label_.genre", "label_.weight"))


def genre_catalog(spark) -> DataFrame:
    return spark.createDataFrame([(g, len(ws)) for g, ws in vocab.GENRE_WORDS.items()],
                                 "genre string, n_words long")


def signed_sentiment() -> Column:
    return (F.col("sentiment_score") - 50.0) / 50.0


def interest_weight() -> Column:
    """Signed sentiment x ln(engagement + 1); Reddit uses comments, times the post score when positive."""
    views = F.when(F.col("platform") == "x", F.col("views")).when(F.col("platform") == "reddit", F.col("comments")
                                                                  ).otherwise(F.col("likes"))
    base = signed_sentiment() * F.log(F.greatest(F.coalesce(views, F.lit(0)), F.lit(0)) + 1.0)
    return base * F.when(F.col("platform") == "reddit", F.greatest(F.col("likes"), F.lit(0))).otherwise(1)


def genre_interest(labelled: DataFrame, link: DataFrame) -> DataFrame:
    """Sum of interest x label weight per resolved user and genre, over posts with a valid sentiment."""
    per = (labelled.filter(F.col("sentiment_score") != 0).groupBy("author", "genre")
           .agg(F.sum(interest_weight() * F.col("weight")).alias("interest")))
    return (per.withColumn("normalized_author", C.normalize_author("author")).join(link, "normalized_author")
            .groupBy("global_user_id", "genre").agg(F.sum("interest").alias("interest")))


def entity_genres(entities: DataFrame, entity_keywords: DataFrame) -> DataFrame:
    """Distinct (entity, genre) from the comma lists of entities and of their movie keywords."""
    parts = [entities.select("entity_id", "genre"),
             entity_keywords.filter(F.col("category") == "media.movie").select("entity_id", "genre")]
    rows = [p.filter(F.trim("genre") != "").select("entity_id", F.explode(F.split("genre", ",")).alias("g"))
            .select("entity_id", F.trim("g").alias("genre")) for p in parts]
    return rows[0].union(rows[1]).distinct()


def mention_genre_scores(mention_entities: DataFrame, mentions: DataFrame, genres: DataFrame) -> DataFrame:
    """Sum of max(0, (s-50)/50) per (author, genre) over distinct (mention, genre)."""
    pairs = (mention_entities.join(genres.withColumnRenamed("entity_id", "managed_entity_id"), "managed_entity_id")
             .select("mention_id", "genre").distinct())
    valid = mentions.filter(F.col("author").isNotNull() & F.col("sentiment_score").between(1, 100))
    return (pairs.join(valid.select("mention_id", "author", "sentiment_score"), "mention_id")
            .groupBy("author", "genre").agg(F.sum(F.greatest(signed_sentiment(), F.lit(0.0))).alias("genre_score")))


def viewer_affinity(scores: DataFrame, profiles: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Share of each genre in the author's positive total, above a threshold, with predicted conversion."""
    totals = scores.filter(F.col("genre_score") > 0).groupBy("author").agg(F.sum("genre_score").alias("total"))
    return (scores.filter(F.col("genre_score") > threshold).join(totals, "author")
            .withColumn("genre_affinity", F.col("genre_score") / F.col("total"))
            .join(profiles.withColumnRenamed("global_user_id", "author"), "author")
            .withColumn("p_conv", C.sigmoid(F.col("genre_affinity") * F.coalesce("influence_rank", F.lit(0.0)))))


def canonical_genre(c: Column) -> Column:
    out = F.when(F.lower(c) == vocab.GENRES[0].lower(), F.lit(vocab.GENRES[0]))
    for g in vocab.GENRES[1:]:
        out = out.when(F.lower(c) == g.lower(), F.lit(g))
    return out.otherwise(c)


def top_movie_genres(labelled: DataFrame, posts: DataFrame, keyword_genre: DataFrame, mention_scores: DataFrame,
                     keyword_weight: float = 2.0) -> DataFrame:
    """Three positive signals per (author, genre): text labels, the keyword's movie genre x2, mention scores."""
    w = F.greatest(interest_weight(), F.lit(0.0))
    valid = F.col("sentiment_score") != 0
    text = (labelled.filter(valid).groupBy("author", "genre").agg(F.sum(w * F.col("weight")).alias("score")))
    by_kw = (posts.filter(valid).groupBy("author", F.lower(F.trim("keyword")).alias("keyword"))
             .agg(F.sum(w).alias("w")).join(keyword_genre, "keyword")
             .select("author", canonical_genre(F.col("genre")).alias("genre"), (keyword_weight * F.col("w")).alias("score")))
    mention = mention_scores.select("author", canonical_genre(F.col("genre")).alias("genre"),
                                    F.col("genre_score").alias("score"))
    return (text.unionByName(by_kw).unionByName(mention).filter(F.col("score") > 0)
            .groupBy("author", "genre").agg(F.sum("score").alias("score")))


# ---- aspects -------------------------------------------------------------------------------------------------------
def untagged(text: str) -> Column:
    """A text without its hashtags and handles."""
    return F.regexp_replace(F.col(text), r"[#@][\p{L}\p{N}_]+", " ")


def aspect_terms(posts: DataFrame, nouns: list[str] | None = None, min_len: int = 3, max_len: int = 100,
                 stop_words: list[str] = ()) -> DataFrame:
    """(author, aspect) -> mean post score; each post gives its score to each distinct term once.

    Terms are whole tokens of the length rule, outside the stop list and, if given, inside the noun list. Hashtags and
    handles are no terms.
    """
    if nouns:
        posts = posts.select("author", "sentiment_score", condensed(F.col("text"), nouns).alias("text"))
    tokens = F.array_distinct(F.split(F.lower(untagged("text")), WORD_BREAK))
    if nouns:
        tokens = F.array_intersect(tokens, _literal_array(nouns))
    terms = F.filter(tokens, lambda w: F.length(w).between(min_len, max_len))
    if stop_words:
        terms = F.array_except(terms, _literal_array(stop_words))
    return (posts.select("author", "sentiment_score", F.explode(terms).alias("aspect"))
            .groupBy("author", "aspect").agg(F.avg("sentiment_score").alias("score"), F.count(F.lit(1)).alias("n")))


def _polarity(sentence: Column, lexicon: dict[str, int]) -> Column:
    hits = word_hits(sentence, list(lexicon))
    by_value = {v: [w for w in lexicon if lexicon[w] == v] for v in sorted(set(lexicon.values()))}
    value = lambda w: reduce(lambda c, v: c.when(w.isin(*by_value[v]), float(v)), by_value, F)
    return F.aggregate(hits, F.lit(0.0), lambda acc, w: acc + value(w))


def sentences(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per sentence, numbered; whole texts."""
    return df.select(*keep, F.posexplode(F.split(F.lower(F.col(text)), SENTENCE_BREAK)).alias("sentence_no", "sentence"))


def sentence_polarity(df: DataFrame, keep: list[str], lexicon: dict[str, int] | None = None) -> DataFrame:
    """Signed polarity in [-2, 2] of every sentence that holds a lexicon word; other sentences are 0."""
    lexicon = lexicon or vocab.POLARITY
    return sentences(df, keep).withColumn("polarity", C.clamp(_polarity(F.col("sentence"), lexicon), -2, 2))


def aspect_sentence_sentiment(posts: DataFrame, keep: list[str], nouns: list[str] | None = None,
                              lexicon: dict[str, int] | None = None) -> DataFrame:
    """(post, aspect) -> mean over its sentences of 0/25/50/75/100, from the sentence the aspect stands in. Hashtags and
    handles are no aspects, but count for the sentence's polarity."""
    nouns, lexicon = nouns or vocab.ASPECT_NOUNS, lexicon or vocab.POLARITY
    found = word_hits(untagged("sentence"), nouns)
    rows = (posts.select(*keep, F.explode(sentences_with(F.col("text"), nouns)).alias("sentence")).filter(F.size(found) > 0)
            .select(*keep, (25.0 * (C.clamp(_polarity(F.col("sentence"), lexicon), -2, 2) + 2)).alias("score"),
                    F.explode(found).alias("aspect")))
    return rows.groupBy(*keep, "aspect").agg(F.avg("score").alias("score"))


def aspect_agg(per_post: DataFrame) -> DataFrame:
    """(keyword, platform, aspect) -> sentiment sum, mentions, distinct authors."""
    return per_post.groupBy(F.lower("keyword").alias("keyword"), "platform", "aspect").agg(
        F.sum("score").alias("sentiment_sum"), F.count(F.lit(1)).alias("mention_count"),
        F.countDistinct("author").alias("distinct_authors"))


def rollup_platforms(agg: DataFrame) -> DataFrame:
    """Per (platform, aspect) and over all platforms together (platform 'all')."""
    sets = agg.groupingSets([["aspect"], ["platform", "aspect"]], "platform", "aspect").agg(
        F.sum("sentiment_sum").alias("sentiment_sum"), F.sum("mention_count").alias("mention_count"),
        F.sum("distinct_authors").alias("distinct_authors"), F.grouping("platform").alias("g"))
    return sets.select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("platform")).alias("platform"), "aspect",
                       "sentiment_sum", "mention_count", "distinct_authors")


def aspect_drivers(rolled: DataFrame, min_mentions: int = 3, min_authors: int = 3) -> DataFrame:
    """Strengths (> 50) and weaknesses (< 50), shrunk to neutral by the number of authors."""
    a, avg = F.col("distinct_authors"), F.col("sentiment_sum") / F.col("mention_count")
    return (rolled.filter((F.col("mention_count") >= min_mentions) & (a >= min_authors)).withColumn("avg", avg)
            .filter((F.col("avg") != 0) & (F.col("avg") != 50))
            .select("platform", "aspect", F.when(F.col("avg") > 50, F.lit("strength")).otherwise(F.lit("weakness"))
                    .alias("kind"), C.round_half_up("avg", 3).alias("average_sentiment"), "mention_count",
                    "distinct_authors", C.round_half_up(50 + (F.col("avg") - 50) * a / (a + min_authors), 3)
                    .alias("impact")))


def top_aspects(terms: DataFrame, k: int) -> DataFrame:
    """The k aspects that most authors mention."""
    return (terms.groupBy("aspect").agg(F.count(F.lit(1)).alias("n_authors")).orderBy(F.desc("n_authors"), "aspect")
            .limit(k))


def conflict_balance(docs: DataFrame, key: str = "doc_id", band=(0.25, 0.35)) -> DataFrame:
    """Balance 1-|P-N|/M times engagement M/(M+median M), as percentile (share strictly below) inside the band."""
    x = F.col("polarity")
    mass = scale.stage(sentence_polarity(docs, [key]).groupBy(key).agg(
        F.sum(F.greatest(x, F.lit(0.0))).alias("p"), F.sum(F.greatest(-x, F.lit(0.0))).alias("n"))
        .withColumn("m", F.col("p") + F.col("n")))
    mid = scale.exact_quantiles(mass, "m", {"median": 0.5}).scalar()
    balance = F.when(F.col("m") > 0, 1 - F.abs(F.col("p") - F.col("n")) / F.col("m")).otherwise(0.0)
    raw = scale.stage(mass.withColumn("k", mid).withColumn("raw", balance * F.when(
        F.col("k") > 0, F.col("m") / (F.col("m") + F.col("k"))).otherwise(0.0)))
    pct = scale.with_percentile(raw, "raw", "pct", scale.lower_percentile())
    return pct.withColumn("conflict_balance_score", F.lit(band[0]) + F.col("pct") * (band[1] - band[0]))

