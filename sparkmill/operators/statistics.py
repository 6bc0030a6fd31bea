"""Aggregates and tests of evaluation: Wilson intervals, precision and recall, McNemar's exact test, sweeps, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of 97.5 percent.
Z = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """The interval of a proportion as a struct low, high; [0, 1] for no observations, exact 0 and 1 at the ends."""
    p, z2 = k / n, z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low = F.when(n == 0, 0.0).when(k == 0, 0.0).otherwise(mid - half)
    high = F.when(n == 0, 1.0).when(k == n, 1.0).otherwise(mid + half)
    return F.struct(low.alias("low"), high.alias("high"))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")]


def quality(df: DataFrame) -> DataFrame:
    """Adds prec, recall, f1, accuracy to tp, fp, fn, tn; an undefined one is null, f1 is 0 where both are defined and one is 0."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    f1 = F.when(p.isNull() | r.isNull(), None).when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r))
    return df.withColumns({"prec": p, "recall": r, "f1": f1, "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn)})


def mcnemar(b: Column, c: Column) -> Column:
    """The exact two-sided p of b against c discordant pairs: twice the binomial tail at 1/2, at most 1; 1 where there are none. Terms are multiplied up, so no factorial overflows below n of about 1000."""
    n, m = (b + c).cast("int"), F.least(b, c).cast("int")
    term0 = F.pow(F.lit(0.5), n.cast("double"))
    start = F.struct(term0.alias("t"), F.lit(0.0).alias("s"))
    step = lambda acc, i: F.struct((acc["t"] * (n - i) / (i + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0), m), start, step)["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def sweep(df: DataFrame, score: str, actual: str, steps: int = 100) -> DataFrame:
    """threshold (in steps of 1/steps from 0 to 1) and the confusion at each: scores are counted by the step they reach first, then summed from above, so the rows are read once and not multiplied."""
    reach = F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)).cast("int")
    hist = df.where(F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) >= 0)).groupBy(reach.alias("k")).agg(F.count_if(actual).alias("pos"), F.count_if(~F.col(actual)).alias("neg"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k")).join(hist, "k", "left").na.fill(0)
    up = Window.orderBy(F.desc("k"))  # 101 rows
    total = Window.partitionBy()
    g = grid.withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up), "p": F.sum("pos").over(total), "n": F.sum("neg").over(total)})
    return g.select(F.col("k").alias("step"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def plateau(sweep_: DataFrame, by: str = "f1") -> DataFrame:
    """first_step, last_step, mid_step (rounded half down) and best of the longest run of neighbouring steps that have the greatest value; the first of equal runs. Null counts as -1."""
    d = sweep_.select("step", F.coalesce(by, F.lit(-1.0)).alias("v"))
    d = d.withColumn("best", F.max("v").over(Window.partitionBy())).where("v = best")
    d = d.withColumn("g", F.col("step") - F.row_number().over(Window.orderBy("step")))
    runs = d.groupBy("g").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.max("best").alias("best"))
    top = runs.orderBy((F.col("first_step") - F.col("last_step")), "first_step").limit(1)
    return top.select("first_step", "last_step", F.floor((F.col("first_step") + F.col("last_step")) / 2).cast("int").alias("mid_step"), "best")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key and named share q the value at rank round-half-even(q * (n - 1)), counted from 0 in ascending order; nulls don't count.

    Values are counted first, so a hot key is reduced before it is sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    c = counts.withColumns({"_n": F.sum("_c").over(w), "_to": F.sum("_c").over(w.orderBy(value))})
    at = lambda q: F.bround(F.lit(q) * (F.col("_n") - 1), 0)
    hit = lambda q: F.min(F.when((F.col("_to") > at(q)) & (F.col("_to") - F.col("_c") <= at(q)), F.col(value)))
    return c.groupBy(*keys).agg(F.max("_n").alias("n"), *[hit(q).alias(name) for name, q in shares.items()])
