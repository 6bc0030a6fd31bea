"""Quantities in whole grams and millilitres (problem 7): the grammar of functions.quantity over whole tables, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sparkmill.functions.quantity import read_amount
from sparkmill.functions.units import half_up, parse_number, parse_unit, to_canonical
from sparkmill.session import table

AMOUNT = StructType([StructField(n, IntegerType()) for n in ("weight_g", "volume_ml", "units", "bonus_g")])
_MOST = 2**31 - 1


def _bounded(x: int | None) -> int | None:
    return x if x is None or x <= _MOST else None


@F.pandas_udf(AMOUNT)
def stated_amount(title: pd.Series) -> pd.DataFrame:
    seen: dict = {}
    rows = []
    for t in title:
        t = t if isinstance(t, str) else None
        if t not in seen:
            seen[t] = tuple(map(_bounded, read_amount(t)[:4]))
        rows.append(seen[t])
    return pd.DataFrame(rows, columns=["weight_g", "volume_ml", "units", "bonus_g"], dtype="object").astype("Int32")


@F.pandas_udf(StructType([StructField("canonical", StringType()), StructField("dimension", StringType())]))
def canonical_quantity(value: pd.Series, unit: pd.Series) -> pd.DataFrame:
    """A number as typed and a unit expression, as canonical amount rounded half up and exponent vector; nulls where either can't be read."""
    out = []
    for v, u in zip(value, unit):
        x = parse_unit(u) if isinstance(u, str) else None
        n = parse_number(v, isinstance(u, str) and u.strip().lower() in ("g", "gr", "ml")) if isinstance(v, str) and v.strip() else None
        out.append((None, None) if x is None or n is None else (str(half_up(to_canonical(n, x))), ",".join(map(str, x.dim))))
    return pd.DataFrame(out, columns=["canonical", "dimension"])


def disagreeing(df: DataFrame, stated: Column, recorded: dict[str, Column]) -> DataFrame:
    """Rows whose title states an amount that is not exactly what is recorded; adds weight_g, volume_ml and bonus_g with the right values, -1 where there is none.

    A title without an amount (null, empty, none in it) is no case. A missing recorded value differs from a stated one.
    """
    df = df.withColumn("_a", stated).drop("weight_g", "volume_ml", "bonus_g")
    df = df.where("_a.weight_g IS NOT NULL OR _a.volume_ml IS NOT NULL")
    same = F.lit(True)
    for f, c in recorded.items():
        same = same & c.cast("int").eqNullSafe(F.col(f"_a.{f}"))
    right = [F.coalesce(F.col(f"_a.{f}"), F.lit(-1)).cast("int").alias(f) for f in ("weight_g", "volume_ml", "bonus_g")]
    return df.where(~same).select("*", *right).drop("_a")


def norm_cases(norm: DataFrame) -> DataFrame:
    n = norm.select("id", "sample_title", "net_weight_g", "net_volume_ml", "bonus_weight_g")
    bad = disagreeing(n, stated_amount("sample_title"), {"weight_g": F.col("net_weight_g"), "volume_ml": F.col("net_volume_ml"), "bonus_g": F.col("bonus_weight_g")})
    return bad.select(F.lit("norm_listings").alias("record_set"), F.col("id").cast("long").alias("record_id"), "weight_g", "volume_ml", "bonus_g")


def variant_cases(listings: DataFrame) -> DataFrame:
    """Variants whose grams are not what their own title states, or, where that states nothing, the entry's title. Liquids are no cases."""
    v = listings.select(F.col("title").alias("t"), F.explode("variants").alias("v")).select("t", F.col("v.id").alias("id"), F.col("v.title").alias("own"), F.col("v.grams").alias("grams"))
    v = v.withColumns({"a": stated_amount("own"), "b": stated_amount("t")})
    own = F.col("a.weight_g").isNotNull() | F.col("a.volume_ml").isNotNull()
    w = F.when(own, F.col("a.weight_g")).otherwise(F.col("b.weight_g"))
    v = v.select("id", "grams", w.alias("weight_g")).where("weight_g IS NOT NULL AND NOT grams <=> weight_g AND id IS NOT NULL")
    return v.select(F.lit("category_variants").alias("record_set"), F.col("id").cast("long").alias("record_id"), "weight_g", F.lit(-1).alias("volume_ml"), F.lit(-1).alias("bonus_g"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose titles state another amount than is recorded, with the right values."""
    return norm_cases(table(spark, sf_dir, "norm_listings")).unionByName(variant_cases(table(spark, sf_dir, "category_listings"))).distinct()


def p7_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing's amounts in whole grams and millilitres: what the title states, else what is recorded."""
    n = table(spark, sf_dir, "norm_listings").select("id", "sample_title", "net_weight_g", "net_volume_ml", "pack_count", "bonus_weight_g").withColumn("a", stated_amount("sample_title"))
    says = F.col("a.weight_g").isNotNull() | F.col("a.volume_ml").isNotNull()
    pick = lambda f, c: F.when(says, F.col(f"a.{f}")).otherwise(F.col(c)).alias(f)
    return n.select("id", says.alias("stated"), pick("weight_g", "net_weight_g"), pick("volume_ml", "net_volume_ml"), pick("bonus_g", "bonus_weight_g"), F.coalesce("a.units", "pack_count", F.lit(1)).alias("units"))
