"""Fact tables shared by several operators.

Items, payments and reviews are pre-aggregated to order grain before they
are joined to orders (eager aggregation): the partial aggregate runs
map-side, so the shuffle on order_id carries about one row per order
instead of one per item, and the join output is order-sized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import exprs as X
from basketry.plans.sizing import dealt, fold
from basketry.sources.star import Star


def item_totals(items: DataFrame) -> DataFrame:
    """Per order_id: item count and exact sums / non-null counts."""
    g = X.gmv()
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(g).alias("gmv_sum"), F.count(g).alias("gmv_cnt"),
        F.sum("price").alias("price_sum"), F.count("price").alias("price_cnt"),
        F.sum("freight_value").alias("freight_sum"))


def orders_where(star: Star, cond, *cols: str) -> DataFrame:
    return star.orders.filter(cond).select("order_id", *cols)


def order_facts(star: Star, cond=None, cols=("customer_id", "order_purchase_timestamp")) -> DataFrame:
    """Orders (filtered by ``cond``, default: valid) inner-joined to their item totals.

    Inner join semantics equal the item-grain join: orders without items
    vanish, and every orders row carries the sums of its items.
    """
    cond = X.is_valid() if cond is None else cond
    return orders_where(star, cond, *cols).join(item_totals(star.order_items), "order_id")


def lines_of_orders(star: Star, cond, by: str, aggregates: dict[str, Column], order_cols=(), n: int | None = None) -> DataFrame:
    """(order, ``by``) rows of the items of orders matching ``cond``: ``aggregates`` and the order's columns.

    Items are folded before they are joined, so an order with very many items
    is one row per ``by`` value and task; orders that repeat give a row for
    each of theirs, as the item-grain join does.  With ``n`` (see
    ``plans.sizing``) both sides are dealt to that many partitions by order,
    and an order and ``by`` value may be several rows, to be added up.
    """
    lines = fold(star.order_items, n, "order_id", [by], aggregates, merge=False)
    return lines.join(dealt(orders_where(star, cond, *order_cols), n, "order_id"), "order_id")


def by_member(per_order: DataFrame, keys: list[str], members: dict[str, str], sums: list[str]) -> DataFrame:
    """Per ``keys``: ``sums``, ``n_orders`` and the number of distinct members of several kinds, in one pass.

    ``per_order`` has one row per (order, keys); ``members`` maps an output
    column to the array column with the order's members (NULLs are none).
    Every member becomes a row (keys, kind, member); the first of an order
    carries its sums and the order itself, so one shuffle gives exact sums,
    distinct orders and distinct members, without Spark's multi-distinct
    Expand of every row.
    """
    def tag(kind: int, column: str) -> Column:
        present = F.filter(column, lambda m: m.isNotNull())
        return F.transform(present, lambda m: F.struct(F.lit(kind).alias("kind"), m.cast("string").alias("member")))

    tagged = F.concat(*[tag(kind, c) for kind, c in enumerate(members.values())])
    rows = per_order.select(*keys, *sums, F.posexplode_outer(tagged).alias("_pos", "_m"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    distinct = rows.groupBy(*keys, "_m.kind", "_m.member").agg(
        *[F.sum(F.when(first, F.col(c))).alias(c) for c in sums], F.sum(F.when(first, 1).otherwise(0)).alias("n_orders"))
    return distinct.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("n_orders").alias("n_orders"),
        *[F.count_if(F.col("kind") == kind).alias(out) for kind, out in enumerate(members)])


def by_bitmap(rows: DataFrame, keys: list[str], order: str, surrogate: str, sums: list[str], out: str) -> DataFrame:
    """Per ``keys``: ``sums``, distinct orders (``n_orders``) and distinct members given by dense non-negative surrogates, in one pass.

    Members are kept in exact, mergeable bitmaps: 4 KB per group and 32,768
    surrogates that occur in it, whatever the number of rows.  They are built
    map-side and joined by OR, so what a (hot) group shuffles does not grow
    with its rows.  The first row of an order within a group counts it.
    """
    first = F.row_number().over(Window.partitionBy(*keys, order).orderBy(surrogate)) == 1
    pages = rows.withColumn("_first", first).groupBy(*keys, F.shiftright(surrogate, 15).alias("_page")).agg(
        *[F.sum(c).alias(c) for c in sums], F.count_if("_first").alias("n_orders"),
        F.bitmap_construct_agg(F.coalesce(F.col(surrogate) % 32768, F.lit(0))).alias("_bits"))
    return pages.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("n_orders").alias("n_orders"),
        F.coalesce(F.sum(F.when(F.col("_page").isNotNull(), F.bitmap_count("_bits"))), F.lit(0)).alias(out))


def by_folded(rows: DataFrame, keys: list[str], order: str, member: str, sums: list[str], out: str, n: int | None = None) -> DataFrame:
    """What ``by_bitmap`` gives, by a row per (keys, member) that is folded map-side, for any number of members and tasks.

    Bitmaps built in every task add up to tasks x pages x 4 KB; here a group
    shuffles one row per member and task at most, and memory goes by members.
    """
    first = F.row_number().over(Window.partitionBy(*keys, order).orderBy(member)) == 1
    members = dealt(rows, n, *keys, order).withColumn("_first", first).groupBy(*keys, member).agg(
        *[F.sum(c).alias(c) for c in sums], F.count_if("_first").alias("n_orders"))
    return members.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("n_orders").alias("n_orders"), F.count(member).alias(out))
