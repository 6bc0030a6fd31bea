"""Selections by hash order: shuffles, quotas with redistribution, proportional strata, round robin. The same rows come out on every run and cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(*keys: str, seed: int = 7) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def round_robin(df: DataFrame, group: str, order: Sequence[Column], group_order: Column, n: int) -> DataFrame:
    """The first n rows taken from the groups in turn: depth by depth, groups by group_order (an aggregate)."""
    depth = df.withColumn("depth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("depth") <= n)
    turn = df.groupBy(group).agg(group_order.alias("turn"))
    return depth.join(turn, group).orderBy("depth", F.desc("turn"), group).limit(n)


def quotas(counts: DataFrame, group: str, available: str, order: str, quota: int) -> DataFrame:
    """group, take: quota per group; what a group lacks is handed on to the next groups in order, as far as they have rows. Running sums over one row per group."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what is still owed after a group: the running lack, less its least value so far (a surplus is never owed back)
    d = counts.withColumn("lack", F.sum(F.lit(quota) - F.col(available)).over(w))
    d = d.withColumn("owed", F.col("lack") - F.least(F.lit(0), F.min("lack").over(w)))
    d = d.withColumn("carried", F.coalesce(F.lag("owed").over(Window.orderBy(order)), F.lit(0)))
    return d.select(group, F.least(F.col(available), quota + F.col("carried")).cast("int").alias("take"))


def stratified(df: DataFrame, stratum: str, key: str, share: float, at_least: int) -> DataFrame:
    """Of each stratum round-half-up(share * rows) rows, but at least at_least where it has them, in hash order."""
    size = df.groupBy(stratum).agg(F.least(F.count("*"), F.greatest(F.lit(at_least), F.round(F.count("*") * share))).alias("_take"))
    # the limit is pushed below the exchange where the ranks are cut by a constant; strata are few, so their greatest take is one
    most = int(size.agg(F.max("_take")).first()[0] or 0)
    w = Window.partitionBy(stratum).orderBy(hash_order(key), key)
    ranked = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    j = ranked.join(size.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s")))
    return j.where("_k <= _take").drop("_s", "_k", "_take")


def sample_with_cases(df: DataFrame, key: str, stratum: str, cases: str, size: int, least: int, seed: int = 7) -> DataFrame:
    """key of size rows: of every case (an array column) the first least rows, of each stratum its share of the places that are left, then whatever comes first until size is reached; all in an order that only the seed and the keys decide. Too many are cut off by that order. Keys are different; fewer rows than size are all taken."""
    d = df.select(key, stratum, cases, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("_u"))
    order = ["_u", key]
    each = d.select(key, "_u", F.explode(cases).alias("_case"))
    hard = each.withColumn("_k", F.row_number().over(Window.partitionBy("_case").orderBy(*order))).where(F.col("_k") <= least).select(key).distinct()
    total, taken = d.count(), hard.count()
    share = d.groupBy(stratum).agg(F.bround(F.lit(max(0, size - taken)) * F.count("*") / F.lit(max(1, total)), 0).alias("_share")).withColumnRenamed(stratum, "_s")
    rest = d.join(hard, key, "left_anti").withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_k") <= size)
    fill = rest.join(share, F.col(stratum).eqNullSafe(F.col("_s"))).where("_k <= _share").select(key)
    chosen = hard.withColumn("_rank", F.lit(0)).unionByName(fill.withColumn("_rank", F.lit(0)))
    ranked = d.join(chosen, key, "left").withColumn("_rank", F.coalesce("_rank", F.lit(1)))
    return ranked.orderBy("_rank", *order).limit(size).select(key)
