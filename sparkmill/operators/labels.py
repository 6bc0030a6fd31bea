"""Checks of labels and fields: compatibility of two files, revisions, tallies per field, metrics with a least support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_of(c: Column) -> Column:
    """train, validation or test, however spelled; null for anything else."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("train", "training"), "train").when(s.isin("validation", "val", "valid", "dev"), "validation").when(s == "test", "test")


def compatible(a: DataFrame, b: DataFrame, key: str, fixed: Sequence[str], free: str) -> DataFrame:
    """key, finding: missing_left, missing_right, the first fixed column that differs (null equals null), changed where only the free column does, else equal. Both have one row a key."""
    x = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in (*fixed, free)], F.lit(True).alias("_a"))
    y = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in (*fixed, free)], F.lit(True).alias("_b"))
    j = x.join(y, key, "full_outer")
    out = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right")
    for c in fixed:
        out = out.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), c)
    return j.select(key, out.when(~F.col(f"_a_{free}").eqNullSafe(F.col(f"_b_{free}")), "changed").otherwise("equal").alias("finding"))


def merge_revisions(df: DataFrame, key: str, order: Sequence[str], answer: str, review: str) -> DataFrame:
    """key, answer, revisions, conflicts: the last decision of each key in order; each change of the answer from one decision to the next is a revision if the later comes from a review, else a conflict. Late rows take their place by the order, whenever they arrive."""
    before = F.lag(answer).over(Window.partitionBy(key).orderBy(*order))
    d = df.withColumn("_changed", before.isNotNull() & (F.col(answer) != before))
    g = d.groupBy(key).agg(F.max_by(answer, F.struct(*order)).alias(answer), F.count_if(F.col("_changed") & F.col(review)).alias("revisions"), F.count_if(F.col("_changed") & ~F.coalesce(review, F.lit(False))).alias("conflicts"))
    return g.select(key, answer, "revisions", "conflicts")


def supported_metrics(groups: DataFrame, rows: DataFrame, group: str, predicted: Column, actual: Column, least: int) -> DataFrame:
    """group, n_pos, n_neg, reportable, prec, recall, f1, false_positive_rate of every group, also of those without rows. prec, recall and f1 are null below the least number of positives; f1 is 0 where one of the two is undefined or 0."""
    g = rows.groupBy(group).agg(F.count_if(actual).alias("n_pos"), F.count_if(~actual).alias("n_neg"), F.count_if(predicted & actual).alias("_tp"), F.count_if(predicted & ~actual).alias("_fp"))
    g = groups.join(g, group, "left").na.fill(0, ["n_pos", "n_neg", "_tp", "_fp"])
    ok = F.col("n_pos") >= least
    p, r = F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp")), F.try_divide(F.col("_tp"), F.col("n_pos"))
    f1 = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0)
    rounded = lambda c, n: F.round(F.when(ok, c), 6).alias(n)
    return g.select(group, "n_pos", "n_neg", ok.alias("reportable"), rounded(p, "prec"), rounded(r, "recall"), rounded(f1, "f1"), F.round(F.try_divide(F.col("_fp"), F.col("n_neg")), 6).alias("false_positive_rate"))


def field_tallies(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, labelled, correct, missing, extra, different, recall, symmetric of each field and of all (null).

    df has each field's expected value as <field>_a and the one found as <field>_b. recall is correct / labelled; symmetric also counts what was found where nothing is expected.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").cast("string").alias("a"), F.col(f"{f}_b").cast("string").alias("b")) for f in fields])
    each = df.select(F.explode(pairs).alias("p")).select("p.*")
    a, b = F.col("a"), F.col("b")
    g = each.rollup("field").agg(F.count("a").alias("labelled"), F.count_if(a == b).alias("correct"), F.count_if(a.isNotNull() & b.isNull()).alias("missing"), F.count_if(a.isNull() & b.isNotNull()).alias("extra"), F.count_if(a != b).alias("different"))
    return g.select("*", F.round(F.try_divide("correct", "labelled"), 6).alias("recall"), F.round(F.try_divide(F.col("correct"), F.col("labelled") + F.col("extra")), 6).alias("symmetric"))


def differing_shares(df: DataFrame, features: dict[str, tuple[Column, Column]], most: float) -> DataFrame:
    """feature, share, dominant: of each feature the share of rows in which its two values differ (null equals null), and whether it is more than most. One pass."""
    g = df.agg(*[F.avg((~a.eqNullSafe(b)).cast("int")).alias(f) for f, (a, b) in features.items()])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 6).alias("share")) for f in features])
    return g.select(F.explode(rows).alias("r")).select("r.feature", "r.share", (F.col("r.share") > most).alias("dominant"))
