"""What changed between consecutive full snapshots (problem 2).

A full outer join on the key compares canonical row hashes: a missing side is
an addition or a removal, unequal hashes are a change. The number of the snapshot is part of the key, so that
one join covers every pair of neighbours at once, and a hot source spreads over all tasks by its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.session import table


def row_hash(columns: Sequence[str]) -> Column:
    """Two independent 64-bit hashes over the values; null equals only null, and moving a value to another column changes the hash."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *reversed(parts)).alias("h2"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[Column | str]) -> DataFrame:
    """One row per key: the one with the greatest order columns, compared from the left, null least. A partial aggregate, no sort."""
    kept = F.struct(*keep)
    return rows.groupBy(*keys).agg(F.max_by(kept, F.struct(*order)).alias("_kept")).select(*keys, "_kept.*")


def diff_snapshots(rows: DataFrame, snapshots: DataFrame, group: str, key: str, date: str, compare: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """group, key, date, change_kind of every record added, removed or changed against the group's previous snapshot.

    rows: all deliveries. snapshots: group, date of every snapshot that took
    place; a snapshot without rows removes every record. Rows of other dates, without a key or of no group don't count. Of
    rows with one (group, key, date) the one with the greatest columns newest holds (null least). compare is compared exactly, null equal to null.
    Further columns are ignored. An empty table gives no rows.
    """
    order = Window.partitionBy("g").orderBy("d")
    numbered = snapshots.select(F.col(group).alias("g"), F.col(date).alias("d")).where("g IS NOT NULL AND d IS NOT NULL").distinct().withColumn("n", F.row_number().over(order))
    numbered = numbered.withColumn("next_d", F.lead("d").over(order))
    rows = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(date).alias("d"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(newest)], row_hash(compare).alias("h"))
    held = latest(rows.where("g IS NOT NULL AND k IS NOT NULL AND d IS NOT NULL"), ["g", "k", "d"], [f"o{i}" for i in range(len(newest))], ["h"])
    held = held.join(numbered, ["g", "d"])
    now = held.select("g", "k", "d", "n", "h")
    before = held.where("next_d IS NOT NULL").select("g", "k", F.col("next_d").alias("d"), F.col("h").alias("h0"))
    joined = now.join(before, ["g", "k", "d"], "full_outer")
    kind = F.when(F.col("h0").isNull(), F.when(F.col("n") > 1, "added")).when(F.col("h").isNull(), "removed").when(F.col("h") != F.col("h0"), "changed")
    return joined.select(F.col("g").alias(group), F.col("k").alias(key), F.col("d").alias(date), kind.alias("change_kind")).where("change_kind IS NOT NULL")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of raw_listings by source and day with an ok run, and of product_matches by price_date."""
    runs = table(spark, sf_dir, "scrape_runs").where("status = 'ok'").select("source", F.to_date("started_at").alias("collected_date"))
    raw = diff_snapshots(table(spark, sf_dir, "raw_listings"), runs, "source", "external_id", "collected_date", ["content_hash", "price", "compare_at_price"], ["scraped_at", "id"])
    matches = table(spark, sf_dir, "product_matches").where("source IS NOT NULL")
    dates = matches.select("price_date").distinct().select(F.lit("all").alias("all"), "price_date")
    keyed = matches.withColumns({"all": F.lit("all"), "key": F.when(F.col("product_id").isNotNull(), F.struct("source", "product_id"))})
    pm = diff_snapshots(keyed, dates, "all", "key", "price_date", ["external_id", "content_hash", "competitor_price"], ["created_at", "id"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("snapshot_date")
    return raw.select(F.lit("raw_listings").alias("record_set"), "source", F.col("external_id").alias("record_key"), day("collected_date"), "change_kind").unionByName(
        pm.select(F.lit("product_matches").alias("record_set"), F.col("key.source").alias("source"), F.col("key.product_id").cast("string").alias("record_key"), day("price_date"), "change_kind")
    )


P2_SQL = """
with runs as (select distinct source, cast(started_at at time zone 'UTC' as date) d from scrape_runs where status = 'ok' and source is not null and started_at is not null),
rs as (select source, d, lag(d) over (partition by source order by d) pd, lead(d) over (partition by source order by d) nd from runs),
raw1 as (select source, external_id k, collected_date d, content_hash a, price b, compare_at_price c,
  row_number() over (partition by source, external_id, collected_date order by scraped_at desc nulls last, id desc nulls last) rn
  from raw_listings where external_id is not null),
raw2 as (select r.source, k, r.d, a, b, c, pd, nd from raw1 r join rs on rs.source = r.source and rs.d = r.d where rn = 1),
rawj as (select coalesce(n.source, p.source) source, coalesce(n.k, p.k) k, coalesce(n.d, p.nd) d,
  case when p.k is null then case when n.pd is not null then 'added' end
       when n.k is null then case when p.nd is not null then 'removed' end
       when n.a is distinct from p.a or n.b is distinct from p.b or n.c is distinct from p.c then 'changed' end kind
  from raw2 n full outer join raw2 p on n.source = p.source and n.k = p.k and n.d = p.nd),
ds as (select d, lag(d) over (order by d) pd, lead(d) over (order by d) nd from (select distinct price_date d from product_matches where source is not null and price_date is not null)),
pm1 as (select source, cast(product_id as varchar) k, price_date d, external_id a, content_hash b, competitor_price c,
  row_number() over (partition by source, product_id, price_date order by created_at desc nulls last, id desc nulls last) rn
  from product_matches where source is not null and product_id is not null),
pm2 as (select source, k, p.d, a, b, c, pd, nd from pm1 p join ds on ds.d = p.d where rn = 1),
pmj as (select coalesce(n.source, p.source) source, coalesce(n.k, p.k) k, coalesce(n.d, p.nd) d,
  case when p.k is null then case when n.pd is not null then 'added' end
       when n.k is null then case when p.nd is not null then 'removed' end
       when n.a is distinct from p.a or n.b is distinct from p.b or n.c is distinct from p.c then 'changed' end kind
  from pm2 n full outer join pm2 p on n.source = p.source and n.k = p.k and n.d = p.nd)
select 'raw_listings' record_set, source, k record_key, strftime(d, '%Y-%m-%d') snapshot_date, kind change_kind from rawj where kind is not null
union all select 'product_matches', source, k, strftime(d, '%Y-%m-%d'), kind from pmj where kind is not null
"""
