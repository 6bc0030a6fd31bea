"""Vector similarity: cosine, nearest in a block, fusion of rankings, retrieval quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null if a vector is null or has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


#: Vectors of a side in one block, on average; two blocks are one task's matrix product.
BLOCK_ROWS = 2_048


def block_top_k(queries: DataFrame, items: DataFrame, block: str, q_id: str, i_id: str, vec: str, k: int) -> DataFrame:
    """q, i, sim, rank: of each query the k nearest items of its block, itself left out; ties by i. Queries of a null block, and vectors that are null or have no length, have none; vectors of one block have one length.

    Either side of a block is cut into parts of bounded size, whatever the block holds; each part of the queries meets each of the items in one matrix product, of
    which only the k best of a query go on, so that a query moves k rows a part.
    """
    a = queries.select(F.col(q_id).alias("q"), F.col(block).alias("blk"), F.col(vec).alias("v")).where("blk IS NOT NULL AND v IS NOT NULL")
    b = items.select(F.col(i_id).alias("i"), F.col(block).alias("blk"), F.col(vec).alias("v")).where("blk IS NOT NULL AND v IS NOT NULL")
    parts = lambda d, name: d.groupBy("blk").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
    n = parts(a, "nq").join(parts(b, "ni"), "blk")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = a.join(n, "blk").select("blk", "q", "v", F.pmod(F.xxhash64("q"), F.col("nq")).cast("int").alias("x"), every("ni").alias("y"))
    b = b.join(n, "blk").select("blk", "i", "v", F.pmod(F.xxhash64("i"), F.col("ni")).cast("int").alias("y"), every("nq").alias("x"))
    kinds = dict(a.dtypes)["q"], dict(b.dtypes)["i"]

    def unit_rows(d: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        v = np.stack([np.asarray(x, np.float64) for x in d["v"]]) if len(d) else np.zeros((0, 1))
        size = np.sqrt((v * v).sum(1))
        fine = size > 0
        return d[fine], v[fine] / size[fine][:, None]

    def meet(qs: pd.DataFrame, its: pd.DataFrame) -> pd.DataFrame:
        (qs, u), (its, v) = unit_rows(qs), unit_rows(its)
        out = []
        if len(qs) and len(its):
            order = np.argsort(its["i"].to_numpy(), kind="stable")
            ids, v = its["i"].to_numpy()[order], v[order]
            sims = np.round(u @ v.T, 6) + 0.0
            for q, row in zip(qs["q"].to_numpy(), sims):
                row = np.where(ids == q, -np.inf, row)  # itself, however often it is there, comes last
                near = np.argsort(-row, kind="stable")[:k]
                out.append(pd.DataFrame({"q": q, "i": ids[near], "sim": row[near]}))
        d = pd.concat(out) if out else pd.DataFrame({"q": [], "i": [], "sim": []})
        return d[d["sim"] > -np.inf]

    keys = ["blk", "x", "y"]
    sims = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(meet, f"q {kinds[0]}, i {kinds[1]}, sim double")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "i")
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], query: str, item: str, rank: str, k: int, constant: int = 60) -> DataFrame:
    """query, item, score, pos: reciprocal rank fusion of several rankings, the k best."""
    u = rankings[0].select(query, item, rank)
    for r in rankings[1:]:
        u = u.unionByName(r.select(query, item, rank))
    s = u.groupBy(query, item).agg(F.round(F.sum(1.0 / (constant + F.col(rank))), 9).alias("score"))
    return s.withColumn("pos", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))).where(F.col("pos") <= k)


def retrieval_quality(ranking: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, ks: tuple[int, ...]) -> DataFrame:
    """One row: queries, hit_at_k for each k, mrr. A query without a relevant item among the ranked counts 0."""
    hits = relevant.join(ranking, [query, item], "left").groupBy(query).agg(F.min(rank).alias("r"))
    return hits.agg(F.count("*").alias("queries"), *[F.round(F.avg((F.coalesce("r", F.lit(1 << 30)) <= k).cast("int")), 6).alias(f"hit_at_{k}") for k in ks], F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def recall_either_direction(ranking: DataFrame, pairs: DataFrame, query: str, item: str, rank: str, left: str, right: str, bucket: str, k: int) -> DataFrame:
    """bucket, pooled, pairs, hits, recall: of the pairs (left, right) of each bucket those with right among left's k best or left among right's, and one row pooled over all (pooled = 1, bucket null).

    Every row of pairs counts. Pairs of an item with itself or with a null end can't be tested and are left out; a null bucket is one of its own.
    """
    near = ranking.where(F.col(rank) <= k).select(query, item).distinct()
    forth = near.select(F.col(query).alias("_l"), F.col(item).alias("_r"))
    both = forth.unionByName(forth.select(F.col("_r").alias("_l"), F.col("_l").alias("_r"))).distinct().withColumn("_hit", F.lit(1))
    p = pairs.where(F.col(left) != F.col(right)).select(F.col(bucket).alias("bucket"), F.col(left).alias("_l"), F.col(right).alias("_r"))
    j = p.join(both, ["_l", "_r"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    g = j.groupingSets([["bucket"], []], "bucket").agg(F.grouping("bucket").cast("int").alias("pooled"), F.count("*").alias("pairs"), F.sum("_hit").alias("hits"))
    return g.where("pairs > 0").select("bucket", "pooled", "pairs", "hits", F.round(F.col("hits") / F.col("pairs"), 6).alias("recall"))
