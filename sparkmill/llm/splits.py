"""Splits that keep related records together (problem 4).

Rows that share a node, directly or over other rows, form a component. The split starts
from a hashed assignment of whole components and is improved by moving and
exchanging whole components under simulated annealing, in many shards side by side, each with
several seeds of which the best is kept. Components too large for a shard are split first, in the same way among themselves, in
fewer shards of their own: there are hundreds of times fewer of them, so this goes a few levels deep at most, and no component leaves the search.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.operators.graph import connected_components
from sparkmill.session import cut, table

SPLITS = ("train", "validation", "test")
SHARES = (0.70, 0.15, 0.15)
#: Components in a shard, on average; a component of more than 1/GIANT of a shard's rows is a giant.
SHARD_COMPONENTS, GIANT = 4_000, 10


def split_name(c: Column) -> Column:
    """train, validation or test, however spelled; null for anything else."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("train", "training"), "train").when(s.isin("validation", "val", "valid", "dev"), "validation").when(s == "test", "test")


def pair_nodes(df: DataFrame) -> DataFrame:
    """Adds nodes: the sorted 16-character prefixes of the row's listings, from the hashes and from pair_id however spelled."""
    token = F.regexp_extract_all(F.lower(F.coalesce("pair_id", F.lit(""))), F.lit(r"(?<![0-9a-f])([0-9a-f]{16})(?![0-9a-f])"), F.lit(1))
    given = F.array_compact(F.array(*[F.lower(F.substring(F.trim(c), 1, 16)) for c in ("left_content_hash", "right_content_hash")]))
    return df.withColumn("nodes", F.array_sort(F.array_distinct(F.concat(F.filter(given, lambda x: F.length(x) == 16), token))))


def proper_pair_id(nodes: str = "nodes") -> Column:
    return F.when(F.size(nodes) == 2, F.concat_ws("_", F.col(nodes)))


def with_components(df: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Adds component: a 64-bit id that all rows linked by nodes have in common, the least hash of their nodes. A row without nodes is in no component (null)."""
    df = df.drop("component")
    ids = F.transform(nodes, lambda n: F.xxhash64(n))
    first, last = F.try_element_at(ids, F.lit(1)), F.try_element_at(ids, F.lit(-1))
    ends = df.where(F.size(nodes) > 0).select(first.alias("x"), last.alias("y"))
    extra = df.where(F.size(nodes) > 2).select(F.explode(ids).alias("x"), first.alias("y"))
    comps = connected_components(ends.unionByName(extra), "x", "y")
    return df.withColumn("_n", F.when(F.size(nodes) > 0, first)).join(comps.select(F.col("node").alias("_n"), "component"), "_n", "left").drop("_n")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose group has two or more different given splits, and the group's smallest proper pair_id.

    Null and unreadable splits say nothing. Rows delivered twice count once. A row of no listing, or with a null occurrence_id, is no case.
    """
    rows = pair_nodes(table(spark, sf_dir, "phase3_labels").select("pair_id", "occurrence_id", "split", "left_content_hash", "right_content_hash"))
    rows = cut(with_components(rows.select("occurrence_id", split_name(F.col("split")).alias("split"), "nodes").distinct()))
    groups = rows.where("component IS NOT NULL").groupBy("component").agg(F.count_distinct("split").alias("n"), F.min(proper_pair_id()).alias("group_pair_id")).where("n > 1")
    return rows.where("occurrence_id IS NOT NULL").join(groups, "component").select("occurrence_id", "group_pair_id").distinct()


def _deviation(size: list[float], labels: list[dict], goal_size: Sequence[float], goal: Sequence[dict], rows: float) -> float:
    """Squared deviations of the splits' sizes and of their counts of each label, relative to all rows."""
    d = sum((s - g) ** 2 for s, g in zip(size, goal_size))
    for have, want in zip(labels, goal):
        for k, g in want.items():
            d += 0.5 * (have.get(k, 0) - g) ** 2
    return d / max(1.0, rows) ** 2


def anneal(sizes: list[int], hists: list[dict], start: list[int], shares: Sequence[float], seed: int, steps: int) -> tuple[float, list[int]]:
    """The best assignment met and its deviation. Moves a component or exchanges two of different splits; accepts losses with falling temperature."""
    rng = random.Random(seed)
    rows, k, at = float(sum(sizes)), len(shares), list(start)
    total: dict = {}
    for h in hists:
        for x, c in h.items():
            total[x] = total.get(x, 0) + c
    goal_size = [s * rows for s in shares]
    goal = [{x: s * c for x, c in total.items()} for s in shares]
    size, have = [0.0] * k, [dict.fromkeys(total, 0.0) for _ in shares]
    for i, p in enumerate(at):
        size[p] += sizes[i]
        for x, c in hists[i].items():
            have[p][x] += c

    def change(i: int, p: int, q: int) -> float:
        """The gain in squared deviation when component i goes from p to q."""
        d = 0.0
        for p_, sign in ((p, -1), (q, 1)):
            e = size[p_] - goal_size[p_]
            d += (e + sign * sizes[i]) ** 2 - e * e
            for x, c in hists[i].items():
                e = have[p_][x] - goal[p_][x]
                d += 0.5 * ((e + sign * c) ** 2 - e * e)
        return d

    def go(i: int, q: int) -> None:
        p = at[i]
        size[p] -= sizes[i]
        size[q] += sizes[i]
        for x, c in hists[i].items():
            have[p][x] -= c
            have[q][x] += c
        at[i] = q

    now = _deviation(size, have, goal_size, goal, 1.0)
    best, best_at = now, list(at)
    if k < 2 or not sizes:
        return best / max(1.0, rows) ** 2, best_at
    heat = max(1.0, now / max(1, len(sizes)))
    for step in range(steps):
        t = heat * (1 - step / steps) ** 2 + 1e-9
        i = rng.randrange(len(sizes))
        p, q = at[i], rng.randrange(k)
        if p == q:
            continue
        d = change(i, p, q)
        go(i, q)
        j = -1
        if d > 0 and len(sizes) > 1:  # try an exchange before giving up
            j = rng.randrange(len(sizes))
            if at[j] == q and j != i:
                d += change(j, q, p)
                go(j, p)
            else:
                j = -1
        if d <= 0 or rng.random() < math.exp(-d / t):
            now += d
            if now < best - 1e-9:
                best, best_at = now, list(at)
        else:
            if j >= 0:
                go(j, q)
            go(i, p)
    return best / max(1.0, rows) ** 2, best_at


def split_components(comps: DataFrame, shares: Sequence[float] = SHARES, names: Sequence[str] = SPLITS, seeds: int = 4, steps: int = 12_000, shard_components: int = SHARD_COMPONENTS) -> DataFrame:
    """component, split for comps (component, rows, labels map<string,bigint>). Deterministic. An empty table gives no rows."""
    stats = comps.agg(F.count("*").alias("n"), F.sum("rows").alias("r")).first()
    if not stats["n"]:
        return comps.select("component", F.lit("").alias("split")).limit(0)
    shards = max(1, round(stats["n"] / shard_components))
    giants, placed, want = None, None, list(shares)
    if shards > 1:
        limit = max(1.0, stats["r"] / shards / GIANT)
        giants = comps.where(F.col("rows") > limit)  # fewer than shards * GIANT
        placed = cut(split_components(giants, shares, names, seeds, steps, shard_components))
        comps = comps.where(F.col("rows") <= limit)
        held = {r["split"]: r["r"] for r in placed.join(giants, "component").groupBy("split").agg(F.sum("rows").alias("r")).collect()}
        # what the large ones have over or under their shares is made up for by the others
        left = [max(0.0, s * stats["r"] - held.get(n, 0)) for s, n in zip(shares, names)]
        want = [f / sum(left) for f in left] if sum(left) else want
    cuts = [sum(want[: i + 1]) for i in range(len(want))]

    def solve(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("component")
        sizes = [int(x) for x in d["rows"]]
        hists = [dict(h) if h is not None else {} for h in d["labels"]]
        start = [next((i for i, c in enumerate(cuts) if u < c), len(cuts) - 1) for u in d["u"]]
        tries = [anneal(sizes, hists, start, want, seed, min(steps, 400 * len(sizes) + 1)) for seed in range(seeds)]
        best = min(range(seeds), key=lambda s: (tries[s][0], s))
        return pd.DataFrame({"component": d["component"], "split": [names[p] for p in tries[best][1]]})

    u = F.pmod(F.xxhash64(F.lit("start"), "component"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sharded = comps.withColumns({"u": u, "shard": F.pmod(F.xxhash64(F.lit("shard"), "component"), F.lit(shards))})
    kind = dict(comps.dtypes)["component"]
    solved = sharded.groupBy("shard").applyInPandas(solve, f"component {kind}, split string")
    return solved if placed is None else solved.unionByName(placed)


def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occurrence_id, component, split, rows: a split of all rows near 70, 15 and 15 percent that never separates linked rows."""
    rows = pair_nodes(table(spark, sf_dir, "phase3_labels").select("pair_id", "occurrence_id", "tier", "left_content_hash", "right_content_hash"))
    rows = with_components(rows)
    rows = cut(rows.withColumn("component", F.coalesce("component", F.xxhash64(F.lit("row"), F.coalesce("occurrence_id", F.lit(""))))))
    tiers = rows.groupBy("component", F.coalesce("tier", F.lit("")).alias("tier")).agg(F.count("*").alias("n"))
    comps = tiers.groupBy("component").agg(F.sum("n").alias("rows"), F.map_from_entries(F.collect_list(F.struct("tier", "n"))).alias("labels"))
    return rows.join(split_components(cut(comps)), "component").groupBy("occurrence_id", "component", "split").agg(F.count("*").alias("rows"))


P4_SQL = """
with r as (select occurrence_id, case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('validation', 'val', 'valid', 'dev') then 'validation' when lower(trim(split)) = 'test' then 'test' end s,
  list_sort(list_distinct(list_concat(list_filter([lower(left(trim(left_content_hash), 16)), lower(left(trim(right_content_hash), 16))], lambda x: x is not null and length(x) = 16),
    regexp_extract_all(lower(coalesce(pair_id, '')), '[0-9a-f]{16}')))) ns from phase3_labels),
q as (select distinct * from r where len(ns) > 0),
e as (select distinct ns[1] x, ns[-1] y from q),
both_ as (select x, y from e union select y, x from e),
walk as (with recursive w(n, c) as (select x, x from both_ union select b.y, w.c from w join both_ b on b.x = w.n where w.c <= b.y) select n, min(c) c from w group by n),
g as (select c, count(distinct s) k, min(case when len(ns) = 2 then ns[1] || '_' || ns[2] end) p from q join walk on n = ns[1] group by c having k > 1)
select distinct occurrence_id, p group_pair_id from q join walk on n = ns[1] join g on g.c = walk.c where occurrence_id is not null
"""
