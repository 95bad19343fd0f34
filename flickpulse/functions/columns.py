"""Column helpers: strings, handles and URLs, dates, numbers, maps, and category tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flickpulse.functions import vocab


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- strings -------------------------------------------------------------------------------------------------------
def normalize_author(c) -> Column:
    """Lower case, only a-z and 0-9; null when nothing is left."""
    s = F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")
    return F.when(s != "", s)


def same_text(a, b) -> Column:
    return F.lower(_c(a)) == F.lower(_c(b))


def contains_text(a, b) -> Column:
    """Case-insensitive containment; wildcard characters stand for themselves."""
    return F.contains(F.lower(_c(a)), F.lower(_c(b)))


def retweet_handle(c) -> Column:
    h = F.regexp_extract(_c(c), r"^RT @(\w+):", 1)
    return F.when(h != "", h)


def retweet_body(c) -> Column:
    return F.regexp_replace(_c(c), r"^RT @\w+:\s*", "")


def trigrams(c) -> Column:
    """Distinct 3-letter grams of every word, padded with two blanks before and one after."""
    words = F.array_remove(F.split(F.lower(_c(c)), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.flatten(F.transform(
        words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1),
                                     lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))))


def trigram_similarity(grams_a, grams_b) -> Column:
    both = F.size(F.array_intersect(_c(grams_a), _c(grams_b)))
    total = F.size(_c(grams_a)) + F.size(_c(grams_b)) - both
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


def mask_value(c) -> Column:
    s = _c(c).cast("string")
    n = F.length(s)
    return (F.when(s.isNull(), F.lit(None).cast("string")).when(n <= 2, F.lit("**"))
            .when(n <= 4, F.concat(s.substr(1, 1), F.lit("***")))
            .otherwise(F.concat(s.substr(1, 1), F.lit("***"), F.right(s, F.lit(1)))))


# ---- titles --------------------------------------------------------------------------------------------------------
def franchise_stem(c) -> Column:
    s = F.trim(_c(c))
    for pattern in (r"(?i)\s*[:\-–]?\s*(part|chapter|vol\.?|volume|book)\s+[ivxlcdm0-9]+\s*$",
                    r"(?i)\s+[ivxlcdm]{1,6}\s*$", r"\s+[0-9]{1,2}\s*$"):
        s = F.regexp_replace(s, pattern, "")
    return F.lower(F.trim(s))


def title_prefix(c) -> Column:
    """Text before the first ':' or dash separator that leaves at least four characters."""
    s = F.trim(_c(c))
    at = [F.instr(s, sep) for sep in (":", " - ", " – ")]
    first = F.array_min(F.filter(F.array(*at), lambda i: i > 4))
    return F.lower(F.trim(F.when(first.isNotNull(), F.substring(s, 1, first - 1)).otherwise(s)))


def primary_genre(c) -> Column:
    g = F.lower(F.trim(F.split(_c(c), ",")[0]))
    return F.when(_c(c).isNull() | (F.trim(_c(c)) == ""), F.lit("unknown")).otherwise(g)


def company_count(c) -> Column:
    n = F.size(F.filter(F.split(_c(c), ","), lambda p: F.trim(p) != ""))
    return F.when(_c(c).isNotNull() & (F.trim(_c(c)) != ""), n.cast("double"))


def certificate_ordinal(c) -> Column:
    s = F.upper(F.regexp_replace(_c(c), r"[\s/\-]", ""))
    return reduce(lambda acc, kv: acc.when(s == kv[0], F.lit(kv[1])), list(vocab.CERTIFICATE_ORDINAL.items())[1:],
                  F.when(s == "U", F.lit(vocab.CERTIFICATE_ORDINAL["U"])))


def remake_detected(c) -> Column:
    return F.when(_c(c).isNotNull(), _c(c).rlike(vocab.REMAKE_PATTERN).cast("double"))


def first_country(c) -> Column:
    return F.trim(F.split(_c(c), ",")[0])


def is_home_language(c, languages=None) -> Column:
    words = "|".join(languages or vocab.HOME_LANGUAGES)
    return F.coalesce(_c(c).rlike(rf"(?i)\b({words})\b"), F.lit(False))


def is_home_market(language, country, languages=None, home: str = vocab.HOME_COUNTRY) -> Column:
    return is_home_language(language, languages) | F.coalesce(F.trim(_c(country)) == home, F.lit(False))


# ---- urls ----------------------------------------------------------------------------------------------------------
def x_handle(permalink) -> Column:
    h = F.regexp_extract(_c(permalink), r"(?i)(?:twitter\.com|x\.com)/([^/?#]+)/status/", 1)
    return F.when(h != "", h)


def profile_url(platform, author, permalink) -> Column:
    name = F.regexp_replace(F.coalesce(_c(author), F.lit("")), "^@", "")
    plain = name.rlike(r"^[\x21-\x7e]+$")
    some = F.trim(name) != ""
    p = _c(platform)
    return (F.when((p == "x") & x_handle(permalink).isNotNull(),
                   F.concat(F.lit("https://twitter.com/"), x_handle(permalink)))
            .when((p == "x") & plain, F.concat(F.lit("https://twitter.com/"), name))
            .when((p == "youtube") & some, F.concat(F.lit("https://www.youtube.com/@"), name))
            .when((p == "reddit") & some, F.concat(F.lit("https://reddit.com/user/"), name))
            .when((p == "instagram") & some, F.concat(F.lit("https://www.instagram.com/"), name, F.lit("/")))
            .otherwise(F.lit("")))


# ---- dates ---------------------------------------------------------------------------------------------------------
def release_year(c) -> Column:
    y = F.regexp_extract(F.trim(_c(c)), r"^(\d{4})", 1)
    return F.when(y != "", y.cast("int"))


def release_day(c) -> Column:
    """Full dates only; year-only text gives null."""
    s = F.trim(_c(c))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def in_windows(day, windows=None) -> Column:
    md = F.month(_c(day)) * 100 + F.dayofmonth(_c(day))
    hits = [md.between(a * 100 + b, c * 100 + d) for a, b, c, d in (windows or vocab.FESTIVE_WINDOWS)]
    return F.when(_c(day).isNotNull(), reduce(lambda x, y: x | y, hits).cast("double"))


def in_months(day, months) -> Column:
    return F.when(_c(day).isNotNull(), F.month(_c(day)).isin(*months).cast("double"))


# ---- numbers -------------------------------------------------------------------------------------------------------
def sigmoid(x) -> Column:
    e = F.exp(-F.abs(_c(x)))
    return F.when(_c(x) >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def saturate(x, k) -> Column:
    pos = F.greatest(_c(x), F.lit(0.0))
    return pos / (pos + F.lit(float(k)))


def log_saturate(x, k) -> Column:
    level = F.log10(1 + F.greatest(_c(x), F.lit(0.0)))
    return level / (level + F.lit(float(k)))


def clamp(x, low=0.0, high=1.0) -> Column:
    return F.least(F.greatest(_c(x), F.lit(float(low))), F.lit(float(high)))


def round_half_up(x, digits: int) -> Column:
    """floor(x*10^k + 0.5) / 10^k, also for negatives."""
    scale = float(10 ** digits)
    return F.floor(_c(x) * scale + 0.5) / scale


def gaussian_kernel(gap, sigma) -> Column:
    return F.exp(-(_c(gap) * _c(gap)) / (2 * _c(sigma) * _c(sigma)))


def interpolate(x, knots) -> Column:
    """Piecewise-linear curve through (x, y) knots, flat outside."""
    x = _c(x)
    out = F.when(x <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(knots[-1][1]))))


# ---- arrays and maps -----------------------------------------------------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    d = l2_norm(a) * l2_norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(F.lit(0.0))


def map_sum(a, b) -> Column:
    """Merge two string->double maps, adding shared keys."""
    keys = F.array_union(F.map_keys(_c(a)), F.map_keys(_c(b)))
    zero = F.lit(0.0)
    return F.map_from_arrays(keys, F.transform(
        keys, lambda k: F.coalesce(F.element_at(_c(a), k), zero) + F.coalesce(F.element_at(_c(b), k), zero)))


def top_key(m) -> Column:
    """Key of the largest value; the smallest key wins ties."""
    best = F.array_min(F.transform(F.map_entries(_c(m)), lambda e: F.struct((-e["value"]).alias("v"),
                                                                            e["key"].alias("k"))))
    return best["k"]


# ---- category tables -----------------------------------------------------------------------------------------------
def steps(x, table, default) -> Column:
    """First label whose lower bound is reached; ``table`` is [(bound, label), ...] from high to low."""
    x = _c(x)
    out = F.when(x >= table[0][0], F.lit(table[0][1]))
    for bound, label in table[1:]:
        out = out.when(x >= bound, F.lit(label))
    return out.otherwise(F.lit(default))


def tone(score) -> Column:
    return (F.when(_c(score) < 50, F.lit("negative")).when(_c(score) > 75, F.lit("positive"))
            .otherwise(F.lit("neutral")))


def influence_tier(ratio) -> Column:
    return steps(ratio, [(0.8, "Viral Node"), (0.6, "Amplifier"), (0.3, "Participant")], "Observer")


def virality_tier(ratio) -> Column:
    return steps(ratio, [(0.8, "Viral Topic"), (0.6, "Trending"), (0.3, "Active Conversation")], "Niche")


def amplification(ratio) -> Column:
    return steps(ratio, [(0.8, "HIGH"), (0.5, "MEDIUM"), (0.3, "LOW-MEDIUM")], "LOW")


def band(percent) -> Column:
    return steps(percent, [(80, "Very High"), (60, "High"), (40, "Moderate"), (20, "Low")], "Very Low")


def sentiment_label(net) -> Column:
    n = _c(net)
    return (F.when(n >= 0.3, F.lit("Predominantly Positive")).when(n >= 0.05, F.lit("Leaning Positive"))
            .when(n > -0.05, F.lit("Mixed / Neutral")).when(n > -0.3, F.lit("Leaning Negative"))
            .otherwise(F.lit("Predominantly Negative")))


def posting_style(n_regions, largest) -> Column:
    return (F.when(F.coalesce(_c(n_regions), F.lit(0)) == 0, F.lit("Steady Poster"))
            .when(_c(largest) >= 10, F.lit("Power Burst Poster"))
            .when(_c(n_regions) >= 2, F.lit("Burst Poster")).otherwise(F.lit("Reactive Poster")))


def audience_type(tone_, ratio) -> Column:
    t, r = _c(tone_), _c(ratio)
    return (F.when((t == "negative") & (r >= 0.7), F.lit("Critical Power Influencer"))
            .when(t == "negative", F.lit("Active Critic"))
            .when((t == "positive") & (r >= 0.7), F.lit("Movie Buff"))
            .when(t == "positive", F.lit("Positive Engager")).otherwise(F.lit("Neutral Informer")))


def activity_class(views, comments, high_views=10000, low_views=1000, high_comments=100) -> Column:
    """Viewing and commenting class, looked up by the levels of both counts; exactly ``high_comments`` is no level."""
    v, c = _c(views), _c(comments)
    view_level = F.when(v > high_views, "high").when(v < low_views, "low").when(v.isNotNull(), "middle")
    comment_level = F.when(c > high_comments, "many").when(c == 0, "none").when(c < high_comments, "few")
    classes = F.create_map(*[F.lit(x) for item in vocab.ACTIVITY_CLASSES.items() for x in item])
    return F.coalesce(F.try_element_at(classes, F.concat_ws(" ", view_level, comment_level)), F.lit("UNKNOWN"))


# ---- expressions over earlier results ------------------------------------------------------------------------------
ALLOWED_FUNCTIONS = {"abs", "ceil", "coalesce", "exp", "floor", "greatest", "least", "ln", "log10", "pow", "round",
                     "sqrt"}


def checked_expression(text: str, columns: list[str]) -> Column:
    """Arithmetic over known columns and whitelisted functions; anything else is refused before Spark sees it."""
    if re.search(r"[^\w\s.,()+\-*/%]", text):
        raise ValueError(f"character not allowed in {text!r}")
    for name, call in re.findall(r"([A-Za-z_]\w*)\s*(\()?", text):
        if (name.lower() not in ALLOWED_FUNCTIONS) if call else (name not in columns):
            raise ValueError(f"{name!r} is not allowed")
    return F.expr(text)
