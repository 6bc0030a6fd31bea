"""Daily series: day pairs, moves, evaluable events, streaks, gaps, first sightings. A series stays rows; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_pairs(daily: DataFrame, keys: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """Rows whose previous calendar day was observed, with that day's values as prev_<name>. daily has one row per key and day."""
    w = Window.partitionBy(*keys).orderBy(day)
    d = daily.withColumn("_before", F.lag(F.struct(F.col(day).alias("_d"), *values)).over(w))
    d = d.where(F.datediff(F.col(day), F.col("_before._d")) == 1)
    return d.select("*", *[F.col(f"_before.{v}").alias(f"prev_{v}") for v in values]).drop("_before")


def moved(now: Column, before: Column, percent: int) -> Column:
    """Whether a decimal value moved by at least percent of what it was; exact, by cross-multiplication. From 0 any change counts."""
    return F.when(before == 0, now != 0).otherwise(F.abs(now - before) * 100 >= before * percent)


def move_kinds(price: str, compare: str, percent: int) -> Column:
    """All kinds of change that hold on a day pair, as an array: base_change (the undiscounted price moved), promo_start, promo_end, promo_depth (the price moved while on promotion on both days).

    Where none holds, sub_threshold alone if the undiscounted price, or the price of a lasting promotion, moved by less than percent; else the array is empty.
    """
    on = lambda p, c: F.coalesce(F.col(c) > F.col(p), F.lit(False))
    base = lambda p, c: F.when(on(p, c), F.col(c)).otherwise(F.col(p))
    p0, c0 = f"prev_{price}", f"prev_{compare}"
    now, was, base_now, base_was = on(price, compare), on(p0, c0), base(price, compare), base(p0, c0)
    holds = {
        "base_change": moved(base_now, base_was, percent),
        "promo_start": now & ~was,
        "promo_end": was & ~now,
        "promo_depth": was & now & moved(F.col(price), F.col(p0), percent),
    }
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in holds.items()]))
    small = (base_now != base_was) | (was & now & (F.col(price) != F.col(p0)))
    return F.when(F.size(kinds) > 0, kinds).when(small, F.array(F.lit("sub_threshold"))).otherwise(F.array().cast("array<string>"))


def evaluable(daily: DataFrame, keys: Sequence[str], day: str, event: str, days: int = 7, missing: int = 0) -> DataFrame:
    """Events with enough quiet days before (no event in them) and enough observed days from the event on; missing days are forgiven on either side. RANGE frames count days, not rows."""
    at = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    base = Window.partitionBy(*keys).orderBy(at)
    before, after = base.rangeBetween(-days, -1), base.rangeBetween(0, days - 1)
    d = daily.withColumns({"_b": F.count("*").over(before), "_e": F.coalesce(F.sum(F.col(event).cast("int")).over(before), F.lit(0)), "_a": F.count("*").over(after)})
    return d.where(F.col(event) & (F.col("_b") >= days - missing) & (F.col("_e") == 0) & (F.col("_a") >= days - missing)).drop("_b", "_e", "_a")


def islands(days: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """keys, first_day, last_day, length of every run of consecutive days."""
    d = days.select(*keys, day).where(F.col(day).isNotNull()).distinct()
    w = Window.partitionBy(*keys).orderBy(day)
    d = d.withColumn("_g", F.date_sub(F.col(day), F.row_number().over(w)))
    return d.groupBy(*keys, "_g").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("length")).drop("_g")


def streak_at_end(days: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """keys, last_day, streak: the length of the run that ends on the key's last day."""
    return islands(days, keys, day).groupBy(*keys).agg(F.max("last_day").alias("last_day"), F.max_by("length", "last_day").alias("streak"))


def gaps(days: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """keys, day: the days between the key's first and last that are missing."""
    span = days.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).where("_a IS NOT NULL")
    every = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    return every.join(days.select(*keys, day).distinct(), [*keys, day], "left_anti")


def nth_last_day(days: DataFrame, keys: Sequence[str], day: str, n: int) -> DataFrame:
    """keys, start: the n-th last different day of the key, or its first if it has fewer."""
    d = days.select(*keys, day).where(F.col(day).isNotNull()).distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc(day))
    return d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).groupBy(*keys).agg(F.min(day).alias("start"))


def first_days(df: DataFrame, keys: Sequence[str], day: str, n: int) -> DataFrame:
    """Rows of the first n different days of each key. The days are ranked once each, so a hot key's rows are in no one task; rows with a null day or key never match."""
    days = df.select(*keys, day).where(F.col(day).isNotNull()).distinct()
    w = Window.partitionBy(*keys).orderBy(day)
    first = days.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
    return df.join(first, [*keys, day], "left_semi")


def new_per_day(df: DataFrame, group: str, item: str, day: str) -> DataFrame:
    """group, day, new_items: how many items of the group were seen first on each of its days but the first; 0 where none was."""
    seen = df.where(F.col(item).isNotNull() & F.col(day).isNotNull())
    first = seen.groupBy(group, item).agg(F.min(day).alias(day)).groupBy(group, day).agg(F.count("*").alias("new_items"))
    days = df.select(group, day).where(F.col(day).isNotNull()).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(day)))
    return days.where("_k > 1").join(first, [group, day], "left").select(group, day, F.coalesce("new_items", F.lit(0)).alias("new_items"))


def compress(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds name: the value where it differs from the last stored one before it in the key, else null. Nulls store nothing."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.when(~F.col(value).eqNullSafe(F.last(value, ignorenulls=True).over(w)), F.col(value)))
