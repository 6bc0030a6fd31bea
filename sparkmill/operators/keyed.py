"""Rows per key: latest, first, as-of, ordered lookups, comparisons of two keyed tables.

All are one shuffle by the key with partial aggregation where an aggregate says enough, and a window only where rows must be ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_with_ties(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Every row whose order column is the greatest of its key; ties stay. Rows with a null key or order never match. An inner join with the group's maximum."""
    top = df.groupBy(*keys).agg(F.max(order).alias(order))
    return df.join(top, [*keys, order]).select(*df.columns)


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key by the order columns, null least. A null key is a key. A partial aggregate, no sort of groups."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "pos") -> DataFrame:
    """The first n rows of each key with their position; the limit is pushed below the shuffle (WindowGroupLimit)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, strict: bool = False) -> DataFrame:
    """Adds the value of the nearest row at or before each row (strict: before) of the key in which it isn't null."""
    end = -1 if strict else Window.currentRow
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def last_known_before_day(df: DataFrame, keys: Sequence[str], day: str, value: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds the value of the latest earlier day of the key in which it isn't null; of one day's rows the greatest order holds. Rows of the same day never see each other."""
    days = df.where(F.col(value).isNotNull()).groupBy(*keys, day).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    frame = Window.partitionBy(*keys).orderBy(F.col(day)).rowsBetween(Window.unboundedPreceding, -1)
    every = df.select(*keys, day).distinct().join(days, [*keys, day], "left")
    seen = every.withColumn(name, F.last("_v", ignorenulls=True).over(frame)).select(*keys, day, name)
    return df.join(seen, [*keys, day], "left")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time; null where there is none.

    A union of both sides in one window: one shuffle, no pairs of rows within
    a key, whatever its size. Of right rows with one time the greatest values hold. Right rows with a null time never match, left rows with one get nulls.
    """
    v = F.struct(*values)
    a = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_v": F.lit(None)})
    b = right.where(F.col(right_time).isNotNull()).groupBy(*keys, right_time).agg(F.max(v).alias("_v")).select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), "_v")
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_last", F.when(F.col("_t").isNotNull(), F.last("_v", ignorenulls=True).over(w))).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_last.{c}").alias(c) for c in values])


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, status: missing in a or b, or different in a value (null equals null), of a full outer join."""
    x = a.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_in_a"))
    y = b.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_in_b"))
    j = x.join(y, list(keys), "full_outer")
    status = F.when(F.col("_in_a").isNull(), "missing_left").when(F.col("_in_b").isNull(), "missing_right").when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    return j.select(*keys, status.alias("status")).where("status IS NOT NULL")


def ordered_lookup(lists: DataFrame, key: str, items: str, dim: DataFrame, dim_key: str, value: str, name: str) -> DataFrame:
    """key, name: the values of each list's items in the list's order; an unknown item keeps its place as null."""
    each = lists.select(key, F.posexplode(items).alias("_i", "_x"))
    found = each.join(dim.select(F.col(dim_key).alias("_x"), F.col(value).alias("_v")), "_x", "left")
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_l")).select(key, F.transform("_l", lambda e: e["_v"]).alias(name))


def zip_tables(a: DataFrame, a_order: Sequence[str], b: DataFrame, b_order: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Rows of a and b of one group paired by position. Raises where a group has more rows on one side (when computed)."""
    x = a.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*a_order)))
    y = b.withColumn("_n", F.row_number().over(Window.partitionBy(*groups).orderBy(*b_order)))
    j = x.withColumn("_l", F.lit(1)).join(y.withColumn("_r", F.lit(1)), [*groups, "_n"], "full_outer")
    fits = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("the sides differ in length"))).otherwise(F.col("_n"))
    return j.withColumn("_n", fits.cast("int")).withColumnRenamed("_n", "position").drop("_l", "_r")
