"""The star: eight named DataFrames every operator reads from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

STAR_TABLES = ("orders", "order_items", "customers", "sellers", "products",
               "order_payments", "order_reviews", "geolocation")


class Star:
    """Eight DataFrames by name.  A table may be given as a zero-argument
    callable; it is then built on first use (plans only, no data)."""

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        missing = set(STAR_TABLES) - set(tables)
        if missing:
            raise ValueError(f"missing star tables: {sorted(missing)}")
        self._tables = dict(tables)
        self._hot: dict[tuple, list] = {}

    def table(self, name: str) -> DataFrame:
        value = self._tables[name]
        if not isinstance(value, DataFrame):
            value = value()
            self._tables[name] = value
        return value

    def items(self):
        return ((name, self.table(name)) for name in STAR_TABLES)

    def hot_keys(self, table: str, key: str) -> list:
        """Keys of ``table.key`` holding very many rows (see plans.skew), computed once.

        Taken over the whole table, so they include the hot keys of any
        filtered or projected fact built from it.
        """
        from basketry.plans.skew import hot_key_share, hot_keys
        df = self.table(table)
        memo = (table, key, hot_key_share(df.sparkSession))
        if memo not in self._hot:
            self._hot[memo] = hot_keys(df.select(key), key)
        return self._hot[memo]

    def replace(self, **tables) -> "Star":
        return Star(**{**self._tables, **tables})

    orders = property(lambda self: self.table("orders"))
    order_items = property(lambda self: self.table("order_items"))
    customers = property(lambda self: self.table("customers"))
    sellers = property(lambda self: self.table("sellers"))
    products = property(lambda self: self.table("products"))
    order_payments = property(lambda self: self.table("order_payments"))
    order_reviews = property(lambda self: self.table("order_reviews"))
    geolocation = property(lambda self: self.table("geolocation"))
