"""All registered queries: importing this module registers them."""

from flickpulse.plans import cat_daily, cat_misc, cat_models, cat_posts, cat_text, cat_timeline, cat_titles
from flickpulse.plans.registry import QUERIES

MODULES = (cat_posts, cat_daily, cat_timeline, cat_text, cat_titles, cat_misc, cat_models)
__all__ = ["MODULES", "QUERIES"]
