"""The N best items of every group (problem 5), by partition lower bounds.

Each partition's N-th best item is a bound that the N-th best of the whole group cannot fall below, so the partition drops
its rows under its own bound before anything is shuffled: of a group of millions at most N rows a partition move. The one exchange is by group; there the
greatest bound of all partitions meets the group's rows, drops those under it, and the survivors are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.session import table

#: Rows of the partition's own best that may wait before they are reduced again.
PENDING = 400_000


def _local_best(d: pd.DataFrame, n: int) -> pd.DataFrame:
    """Of each group (a, b) the n best different items: by score descending, then item ascending; bound is the n-th best's score, null where there are fewer."""
    b, names = pd.factorize(d["b"], use_na_sentinel=False)
    item = pd.factorize(d["item"], sort=True)[0]
    a, s = d["a"].to_numpy(), d["score"].to_numpy()
    order = np.lexsort((item, -s, b, a))
    a, b, item, s = a[order], b[order], item[order], s[order]
    # a link counts once: its first row in this order that has its item
    twin = pd.DataFrame({"a": a, "b": b, "i": item}).duplicated().to_numpy()
    order, a, b, s = order[~twin], a[~twin], b[~twin], s[~twin]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    pos = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    kept = pos < n
    out = d.iloc[order[kept]].copy()
    size = np.repeat(np.diff(np.r_[start, len(a)]), np.diff(np.r_[start, len(a)]))
    nth = np.repeat(s[np.minimum(start + n - 1, len(a) - 1)] if len(a) else s, np.diff(np.r_[start, len(a)]))
    out["bound"] = pd.array(np.where(size >= n, nth, 0.0)[kept], dtype="Float64")
    out.loc[(size < n)[kept], "bound"] = pd.NA
    return out


def top_n(rows: DataFrame, group_id: str, group_name: str, item: str, score: str, n: int = 3) -> DataFrame:
    """group_id, group_name, item, score, pos: the n best different items of each (group_id, group_name), pos from 1.

    By score descending, equal scores by item ascending (code point). Rows
    with a null or NaN score, a null group_id or a null item don't count; a null group_name is a group
    of its own. A repeated item counts once with its highest score; -0.0 equals 0.0. Other columns are ignored. An empty table gives no rows.
    """
    s = F.col(score).cast("double") + F.lit(0.0)
    r = rows.select(F.col(group_id).alias("a"), F.col(group_name).alias("b"), F.col(item).alias("item"), s.alias("score"))
    r = r.where("a IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    kinds = dict(r.dtypes)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for d in batches:
            held.append(_local_best(d, n))
            rows += len(held[-1])
            if rows > PENDING:
                best = _local_best(pd.concat(held, ignore_index=True), n)
                if len(best) > PENDING // 2:  # many small groups: pass them on, nothing grows
                    yield best
                    held, rows = [], 0
                else:
                    held, rows = [best], len(best)
        if held:
            yield _local_best(pd.concat(held, ignore_index=True), n)

    local = r.mapInPandas(keep, f"a {kinds['a']}, b {kinds['b']}, item {kinds['item']}, score double, bound double")
    # one exchange by the group serves the repeated items, the bound and the ranks; a group is at most n rows a partition
    linked = local.repartition("a", "b").groupBy("a", "b", "item").agg(F.max("score").alias("score"), F.max("bound").alias("bound"))
    whole = Window.partitionBy("a", "b")
    bounded = linked.withColumn("bound", F.max("bound").over(whole)).where("bound IS NULL OR score >= bound")
    pos = F.row_number().over(whole.orderBy(F.desc("score"), F.asc("item")))
    ranked = bounded.withColumn("pos", pos).where(F.col("pos") <= n)
    return ranked.select(F.col("a").alias(group_id), F.col("b").alias(group_name), F.col("item").alias(item), F.col("score").alias(score), "pos")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best links of every product and source."""
    links = table(spark, sf_dir, "scored_links").select("product_id", "source", "external_id", "score")
    return top_n(links, "product_id", "source", "external_id", "score", 3).select("product_id", "source", "external_id", "pos")


P5_SQL = """
with l as (select product_id, source, external_id, max(score + 0.0) score from scored_links
  where score is not null and not isnan(score) and product_id is not null and external_id is not null group by all)
select product_id, source, external_id, cast(pos as integer) pos from (
  select *, row_number() over (partition by product_id, source order by score desc, external_id) pos from l) where pos <= 3
"""
