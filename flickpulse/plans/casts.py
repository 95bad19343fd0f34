"""Result columns whose type the oracle database widens or narrows (sums of integers, counts of months and the like).

They are cast to the type the Spark query returns: bigint in ``BIGINTS``, double in ``DOUBLES``.
"""

BIGINTS = {
    "normalize_author": "n_posts", "keyword_match_exact": "n_posts",
    "user_platform_stats": "x_likes x_views youtube_replies reddit_score",
    "platform_handles": "total_likes total_comments total_views", "keyword_reach": "total_reach",
    "channel_strategy": "reach", "platform_breakdown": "measure post_count", "uncategorized_anti": "total_engagement",
    "movie_buffs": "total_engagement", "audience_affinity": "total_engagement",
    "keyword_spreaders": "total_engagement",
    "entity_spreaders": "total_likes total_comments total_views total_engagement",
    "top_spreaders": "total_likes total_comments total_views", "viral_seeds": "total_reach",
    "overwrite_atomic": "total_reach", "stream_reach_tumbling": "total_reach", "stream_profile_upsert": "total_reach",
    "genre_reach": "total_reach", "rollup_platform": "mention_count distinct_authors",
    "aspect_drivers": "mention_count distinct_authors", "strictly_prior_join": "prior_films year",
    "track_record": "lead_prior_films", "release_clash_count": "clashes", "chain_evidence": "lag_days",
    "title_row_filter": "release_year", "market_tag": "market_is_home", "news_event_flag": "flag",
    "title_functions": "release_year", "feature_frame": "release_year market_is_home",
}
DOUBLES = {
    "sentence_polarity": "polarity", "conflict_balance": "p n", "calendar_flags": "festive exam_season league_season summer",
}


def with_casts(key: str, sql: str) -> str:
    parts = [f"CAST({c} AS {kind}) AS {c}" for table, kind in ((BIGINTS, "BIGINT"), (DOUBLES, "DOUBLE"))
             for c in table.get(key, "").split()]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql}) result" if parts else sql
