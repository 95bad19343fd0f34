"""The social and title input tables, derived from the generated test tables.

Each view is one SQL text that Spark and DuckDB both accept; the few spellings that differ are ``{tokens}``. Spark
resolves the names through :class:`Tables`; the oracle prepends the same texts as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from flickpulse.functions.vocab import EVENT_PHRASES, GENRE_WORDS, GENRES

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()

SPARK = {"us": "unix_micros", "mkts": "timestamp_micros", "at": "element_at", "lb": "array(", "rb": ")"}
DUCK = {"us": "epoch_us", "mkts": "make_timestamp", "at": "list_extract", "lb": "[", "rb": "]"}


def _arr(values) -> str:
    return "{lb}" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "{rb}"


WORDS = [w for ws in GENRE_WORDS.values() for w in ws]
CLAUSES = ["the music was amazing", "the runtime was terrible", "the plot is good", "the acting was weak",
           "superb visuals and a dull climax", "nothing to add", "the dialogue was great but the plot was boring"]
PHRASES = [p for ps in EVENT_PHRASES.values() for p in ps]
DAY_US = 86_400_000_000

VIEWS: dict[str, str] = {
    "ev": """
        SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, {us}(CAST(ts AS TIMESTAMP)) AS us, user_id, event_type, value,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
               event_id * 7919 + user_id * 31 AS mix
        FROM events""",
    "ndocs": "SELECT count(*) AS n FROM documents",
    "nents": "SELECT count(*) AS n FROM supplier",
    # ev with platform and the engagement columns; no text, so it never touches `documents`
    "posts_lean": """
        SELECT event_id AS post_id, 'User_' || CAST(user_id AS STRING) AS author, user_id, ts, us,
               CASE event_type WHEN 'view' THEN 'youtube' WHEN 'purchase' THEN 'reddit'
                               WHEN 'signup' THEN 'instagram' ELSE 'x' END AS platform,
               CAST(k AS DOUBLE) AS sentiment_score,
               CASE WHEN k > 75 THEN 'POSITIVE' WHEN k < 50 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_category,
               CAST(floor(value) AS BIGINT) AS likes, CAST(k % 10 AS BIGINT) AS comments,
               CASE WHEN event_type IN ('click', 'error') THEN CAST(floor(value * 10) AS BIGINT)
                    ELSE CAST(0 AS BIGINT) END AS views,
               CASE WHEN event_type IN ('click', 'error') THEN CAST(k % 3 AS BIGINT) END AS shares,
               'kw' || CAST(mix % 25 AS STRING) AS keyword,
               {at}(""" + _arr(["question", "praise", "complaint", "share"]) + """, k % 4 + 1) AS content_intent,
               CASE WHEN event_type = 'signup' THEN {at}(""" + _arr(["IMAGE", "VIDEO", "CAROUSEL_ALBUM"]) + """,
                    CAST(mix % 3 AS INT) + 1) END AS media_type,
               CASE WHEN event_type IN ('click', 'error')
                    THEN 'https://x.com/user_' || CAST(user_id AS STRING) || '/status/' || CAST(event_id AS STRING)
                    ELSE 'https://example.com/p/' || CAST(event_id AS STRING) END AS permalink,
               CASE WHEN event_type = 'purchase' THEN 'Notes on ' || {at}(""" + _arr(WORDS) + """,
                    CAST((mix + 3) % 127 AS INT) + 1) END AS title,
               mix
        FROM ev""",
    "posts": """
        SELECT p.*, d.text || ' ' || {at}(""" + _arr(WORDS) + """, CAST(p.mix % 127 AS INT) + 1) || '. ' ||
               {at}(""" + _arr(CLAUSES) + """, CAST(p.mix % 7 AS INT) + 1) || '.' AS text
        FROM (SELECT *, mix % (SELECT n FROM ndocs) AS doc_id FROM posts_lean) p
             JOIN documents d ON d.doc_id = p.doc_id""",
    # each day squeezed into 30 minutes, so that bursts occur
    "posts_bursty": """
        SELECT post_id, author, user_id, {mkts}(b_us) AS ts, b_us AS us, platform, sentiment_score,
               sentiment_category, likes, comments, views, shares, keyword, content_intent, media_type, permalink,
               title, mix
        FROM (SELECT *, us - us % 86400000000 + CAST(floor((us % 86400000000) / 48) AS BIGINT) AS b_us
              FROM posts_lean) q""",
    "entities": """
        SELECT s.s_suppkey AS entity_id, s.s_name AS name,
               CASE WHEN s.s_suppkey % 10 = 0 THEN 'CELEBRITY' ELSE 'MOVIE' END AS type,
               r.r_name AS industry, 'L' || CAST(s.s_suppkey % 2 AS STRING) AS language,
               {at}(""" + _arr(GENRES) + """, CAST(s.s_suppkey % 12 AS INT) + 1) || ', ' ||
               {at}(""" + _arr(GENRES) + """, CAST((s.s_suppkey * 5 + 3) % 12 AS INT) + 1) AS genre,
               n.n_name AS state
        FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
             JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "entity_keywords": """
        SELECT entity_id, 'kw' || CAST(entity_id % 25 AS STRING) AS keyword,
               CASE WHEN type = 'MOVIE' THEN 'media.movie' ELSE 'media.celebrity' END AS category,
               genre, language, state FROM entities
        UNION ALL
        SELECT entity_id, 'KW' || CAST((entity_id + 7) % 25 AS STRING) AS keyword,
               CASE WHEN type = 'MOVIE' THEN 'media.movie' ELSE 'media.celebrity' END AS category,
               genre, language, state FROM entities""",
    # on every sixth day of an entity its mentions go to the next entity, so that daily series have gaps
    "mentions": """
        SELECT m.mention_id, CASE WHEN (m.e + m.day_no) % 6 = 0 THEN (m.e + 1) % m.n_ent ELSE m.e END
                   AS managed_entity_id,
               m.platform, m.post_id, m.author, m.sentiment, m.sentiment_score, m.us, m.day_no, m.n_ent
        FROM (SELECT post_id AS mention_id, mix % (SELECT n FROM nents) AS e, (SELECT n FROM nents) AS n_ent,
                     platform, post_id, author,
                     CASE WHEN sentiment_score > 75 THEN 'POSITIVE'
                          WHEN sentiment_score >= 1 AND sentiment_score < 50 THEN 'NEGATIVE'
                          ELSE 'NEUTRAL' END AS sentiment,
                     sentiment_score, us, CAST(floor(us / 86400000000) AS BIGINT) AS day_no
              FROM posts_lean) m""",
    "mention_entities": """
        SELECT mention_id, managed_entity_id FROM mentions
        UNION ALL
        SELECT mention_id, CASE WHEN (t + day_no) % 6 = 0 THEN (t + 1) % n_ent ELSE t END AS managed_entity_id
        FROM (SELECT mention_id, (managed_entity_id + 1) % n_ent AS t, day_no, n_ent
              FROM mentions WHERE mention_id % 5 = 0) q""",
    "identity_link": """
        SELECT DISTINCT 'user-' || CAST(user_id * 17 AS STRING) AS global_user_id,
               'user' || CAST(user_id AS STRING) AS normalized_author
        FROM events""",
    "day_originals": """
        SELECT user_id, CAST(floor(us / 86400000000) AS BIGINT) AS day_no, min(post_id) AS post_id
        FROM posts_lean WHERE platform = 'x' AND post_id % 3 <> 0
        GROUP BY user_id, CAST(floor(us / 86400000000) AS BIGINT)""",
    "nusers": "SELECT count(DISTINCT user_id) AS n FROM ev",
    # originals, and on every third post a retweet of the previous day's first post of another handle
    "shared_plan": """
        SELECT p.post_id, p.author, p.us, f.user_id AS handle_id,
               CASE WHEN f.user_id IS NULL THEN p.mix ELSE f.post_id * 7919 + f.user_id * 31 END
                   % (SELECT n FROM ndocs) AS doc_id
        FROM (SELECT *, (user_id * 7) % (SELECT n FROM nusers) AS target,
                     CAST(floor(us / 86400000000) AS BIGINT) - 1 AS prev_day
              FROM posts_lean WHERE platform = 'x') p
        LEFT JOIN day_originals f ON p.post_id % 3 = 0 AND f.user_id = p.target AND f.day_no = p.prev_day""",
    "shared_posts": """
        SELECT s.post_id, s.author, s.us,
               CASE WHEN s.handle_id IS NULL THEN d.text
                    ELSE 'RT @User_' || CAST(s.handle_id AS STRING) || ': '
                         || CASE WHEN s.post_id % 2 = 0 THEN d.text ELSE substr(d.text, 2) END END AS text
        FROM shared_plan s JOIN documents d ON d.doc_id = s.doc_id""",
    "profiles": """
        SELECT author AS global_user_id, 'tribe ' || CAST(max(user_id) % 4 AS STRING) AS tribe_label,
               round(least(1e0, count(*) / 100e0), 6) AS influence_rank,
               round(sqrt(sum(CASE WHEN views > 0 THEN ((likes + comments) * 1e0 / views)
                                       * ((likes + comments) * 1e0 / views) ELSE 0e0 END) / count(*)), 6) AS moi_score,
               count(*) AS total_posts
        FROM posts_lean GROUP BY author""",
    "author_stats": """
        SELECT author, CASE WHEN avg(sentiment_score) > 50 THEN 'Movie Buff' ELSE 'Neutral Informer' END
                   AS audience_classification,
               CASE WHEN max(user_id) % 5 = 0 THEN 'Power Burst Poster' ELSE 'Steady Poster' END AS posting_style,
               CASE WHEN max(user_id) % 5 = 0 THEN 1e0 ELSE round(count(*) / 200e0, 6) END AS branching_ratio,
               count(*) AS total_posts
        FROM posts_lean GROUP BY author HAVING count(*) > 60""",
    "title_rev": """
        SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS rev, count(*) AS n_lines,
               sum(l_quantity) AS qty
        FROM lineitem GROUP BY l_orderkey""",
    "titles": """
        SELECT o.o_orderkey AS title_id,
               'T' || CAST(o.o_orderkey % 5000 AS STRING) ||
               CASE o.o_orderkey % 6 WHEN 0 THEN ' Part 2' WHEN 1 THEN ': The Return' WHEN 2 THEN ' II' ELSE '' END
                   AS movie_name,
               CASE WHEN o.o_custkey % 10 = 3 THEN CAST(year(o.o_orderdate) AS STRING)
                    ELSE substr(CAST(o.o_orderdate AS STRING), 1, 10) END AS release_date,
               {at}(""" + _arr(["hindi", "english", "tamil, hindi", "korean"]) + """,
                    CAST(c.c_nationkey % 4 AS INT) + 1) AS language,
               {at}(""" + _arr(["India", "USA", "South Korea, USA"]) + """,
                    CAST(c.c_nationkey % 3 AS INT) + 1) AS country,
               c.c_mktsegment || ', Drama' AS genre,
               'Dir ' || CAST(o.o_custkey % 400 AS STRING) AS directors,
               o.o_totalprice AS budget,
               CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE r.rev END AS revenue,
               CAST(90 + (o.o_orderkey * 13) % 140 AS DOUBLE) AS runtime_mins,
               CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE 1000e0 + 50 * (year(o.o_orderdate) - 1990)
                    + 100 * (c.c_nationkey % 3) END AS gdp_usd_billions,
               CASE WHEN o.o_orderkey % 8 = 0 THEN NULL
                    ELSE CAST((o.o_orderkey * 7) % 12 AS DOUBLE) END AS inflation_rate_pct,
               CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
                    ELSE CAST((o.o_orderkey * 11) % 120 AS DOUBLE) END AS trailer_days_to_release,
               CASE WHEN o.o_orderkey % 4 = 0 THEN NULL
                    ELSE CAST((o.o_orderkey * 17) % 140 AS DOUBLE) END AS song_days_to_release,
               CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
                    ELSE CAST((o.o_orderkey * 7919) % 100000 AS DOUBLE) END AS trailer_views,
               CASE WHEN o.o_orderkey % 3 = 0 THEN 3e-1 END AS conflict_balance_score,
               CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN o.o_orderkey % 2 = 0 THEN 'Acme, Bolt'
                    ELSE 'Acme' END AS production_companies,
               CASE o.o_orderkey % 4 WHEN 0 THEN 'An official remake of a classic' WHEN 1 THEN NULL
                    ELSE 'A fresh story' END AS overview,
               CASE o.o_orderkey % 4 WHEN 0 THEN 'U/A' WHEN 1 THEN 'A' WHEN 2 THEN 'u' END AS cbfc_rating,
               CAST((o.o_orderkey * 31) % 100 AS DOUBLE) / 10 AS imdb_rating,
               r.n_lines AS votes
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN title_rev r ON r.l_orderkey = o.o_orderkey""",
    "credits": """
        SELECT 'Actor ' || CAST(l.l_suppkey AS STRING) AS actor_name, t.title_id, t.movie_name, t.release_date,
               t.language, t.directors AS director,
               CASE WHEN l.l_linenumber = 7 THEN NULL ELSE CAST(l.l_linenumber AS INT) END AS role_position,
               l.l_partkey * 10 + l.l_linenumber AS credit_seq
        FROM lineitem l JOIN titles t ON t.title_id = l.l_orderkey""",
    "market_index": """
        SELECT 'COMPOSITE' AS index_name, CAST(l_shipdate AS DATE) AS trade_date,
               max(l_extendedprice) AS close
        FROM lineitem WHERE weekday(CAST(l_shipdate AS DATE)) {weekend} GROUP BY CAST(l_shipdate AS DATE)""",
    "ticket_prices": """
        SELECT tier AS city_tier, CAST(min(d) AS DATE) AS period_start, CAST(max(d) AS DATE) AS period_end,
               round(avg(price) / 10000, 4) + CASE tier WHEN 'tier_1' THEN 2 ELSE 0 END AS atp_usd
        FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice AS price, CASE WHEN o_custkey % 2 = 0
                     THEN 'tier_1' ELSE 'tier_2_3' END AS tier,
                     year(o_orderdate) * 12 + month(o_orderdate) AS ym FROM orders) q
        GROUP BY tier, ym""",
    "articles": """
        SELECT d.doc_id, d.text || ' T' || CAST((d.doc_id * 37) % 5000 AS STRING) || ': The Return ' ||
               {at}(""" + _arr(PHRASES) + """, CAST(d.doc_id % 22 AS INT) + 1) || '.' AS text,
               CAST(o.o_orderdate AS DATE) AS pub_date
        FROM documents d JOIN orders o ON o.o_orderkey = (d.doc_id * 37) % 5000""",
    "synopses": """
        SELECT doc_id, text || ' ' || {at}(""" + _arr(CLAUSES) + """, CAST(doc_id % 7 AS INT) + 1) || '. ' ||
               {at}(""" + _arr(CLAUSES) + """, CAST((doc_id * 3 + 1) % 7 AS INT) + 1) || '. ' ||
               {at}(""" + _arr(CLAUSES) + """, CAST(floor(doc_id / 7) % 7 AS INT) + 1) || '.' AS text
        FROM documents""",
    "corpus": """
        SELECT vec_id AS id, 'Saga ' || substr('abcdefghijklmnopqrstuvwxy', CAST(vec_id % 25 AS INT) + 1, 1) ||
               CAST(CAST(floor(vec_id / 50) AS BIGINT) AS STRING) || 'q' || CASE vec_id % 3 WHEN 0 THEN ' Part 2' WHEN 1 THEN ': Origins' ELSE '' END AS name,
               'g' || CAST(label AS STRING) AS genre, embedding AS vec
        FROM embeddings""",
    "macro": """
        SELECT CASE c.c_nationkey % 3 WHEN 0 THEN 'IND' ELSE 'USA' END AS iso3, year(o.o_orderdate) AS year,
               round(avg(o.o_totalprice) / 100, 4) AS gdp_usd_billions, round(avg(c.c_acctbal) / 1000, 4) AS inflation_rate_pct
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_nationkey % 3 < 2
        GROUP BY CASE c.c_nationkey % 3 WHEN 0 THEN 'IND' ELSE 'USA' END, year(o.o_orderdate)""",
    "factor_values": """
        SELECT o_orderkey AS title_id, 'shipping_pace' AS factor_key,
               CAST(o_orderkey % 97 AS DOUBLE) AS value_numeric FROM orders WHERE o_orderstatus = 'F'
        UNION ALL
        SELECT o_orderkey AS title_id, 'priority_level' AS factor_key,
               CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS value_numeric FROM orders""",
    "catalog_names": """
        SELECT p_partkey, p_name || ' ' || p_brand AS name, CAST(1990 + p_size AS INT) AS year FROM part""",
    "external_names": """
        SELECT p_partkey AS ext_id,
               CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, 3) || substr(p_name, 5) || ' ' || p_brand
                    WHEN 1 THEN p_brand || ' ' || p_name ELSE p_name || ' ' || p_brand END AS name,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(1990 + p_size AS INT) END AS year
        FROM part""",
}
TEXTS_OF_MANY = ("posts", "shared_posts")  # views that give one text to many rows
SPARK["weekend"] = "< 5"
DUCK["weekend"] = "BETWEEN 1 AND 5"


def _names_in(text: str, pool) -> list[str]:
    found = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text))
    return [n for n in pool if n in found]


class Tables:
    """Lazy access to base tables and derived views of one data folder: ``t.posts``, ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str, streamed: str | None = None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}
        if streamed:  # this base table is read as a stream of its files
            schema = spark.read.parquet(f"{sf_dir}/{streamed}.parquet").schema
            self._made[streamed] = (spark.readStream.schema(schema).option("pathGlobFilter", f"{streamed}.parquet")
                                    .parquet(sf_dir))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                text = VIEWS[name]
                deps = {d: getattr(self, d) for d in _names_in(text, BASE + list(VIEWS))}
                for d in deps:
                    text = re.sub(rf"\b(FROM|JOIN)(\s+){d}\b", rf"\1\2[[{d}]]", text)
                text = text.format(**SPARK).replace("[[", "{").replace("]]", "}")
                if name in TEXTS_OF_MANY:
                    deps["documents"] = self._spread_texts(deps["documents"])
                self._made[name] = self.spark.sql(text, **deps)
            else:
                raise AttributeError(name)
        return self._made[name]

    def _spread_texts(self, documents: DataFrame) -> DataFrame:
        """A fixed number of partitions by doc_id: a join hands each text to many rows, so what it makes is far larger
        than what is shuffled for it, by which partitions would be coalesced. Broadcast texts would leave the work to
        the few splits of the narrow rows."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = documents.repartition(max(parts, 3 * self.spark.sparkContext.defaultParallelism), "doc_id")
        return spread.hint("merge")


def oracle(body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the views it uses, spelled for DuckDB. ``body`` may start with further CTEs."""
    need: list[str] = []

    def visit(text):
        for n in _names_in(text, list(VIEWS)):
            if n not in need:
                visit(VIEWS[n])
                need.append(n)

    visit(body)
    ctes = [f"{n} AS ({VIEWS[n].format(**DUCK)})" for n in need]
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("SELECT"):
        return (head + ",\n".join(ctes) + "\n" + body) if ctes else body
    return head + ",\n".join(ctes + [body])
