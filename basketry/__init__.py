"""basketry — commerce analytics operators on Spark DataFrames.

Every operator takes a :class:`basketry.sources.Star` (eight DataFrames:
orders, order_items, customers, sellers, products, order_payments,
order_reviews, geolocation) plus keyword parameters and returns a lazy
DataFrame.  See README.md for the operator list.
"""

from basketry.sources.star import Star, STAR_TABLES

__all__ = ["Star", "STAR_TABLES"]
