"""Filling containers of fixed capacity (problem 9) by swap-based local search.

Items go to shards by a hash of their key. A shard is filled best-fit in descending order; then the search moves items and
exchanges one for one and two for one between any of its underfull containers, each step raising the sum of squared fills, until containers
empty and no step is left. Of a shard's containers the fuller half and all full ones are done; the items of the others go
into a further round of as many shards as they need, so that a task never holds more than a shard, and the shards together waste hardly more than one would.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm.tokens import count_tokens
from sparkmill.session import cut, table

CAPACITY = 2048
#: Items in a shard, on average; a shard is one task's work.
SHARD_ITEMS = 10_000


def best_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions: items in descending order, each into the fullest container that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # sorted (room, bin)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(room, (sizes[i], -1))
        if k < len(room):
            r, b = room.pop(k)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r > sizes[i]:
            insort(room, (r - sizes[i], b))
    return bins


class _Search:
    """The local search over one shard. Sizes of single items, and of two items of a container, are kept in order, so that the best that fits is found by bisection whatever the number of containers."""

    def __init__(self, bins: list[list[int]], sizes: Sequence[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins = [set(b) for b in bins]
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.home = {i: b for b, held in enumerate(bins) for i in held}
        self.least = -(-sum(self.fill) // capacity)
        self.used = sum(1 for b in bins if b)

    def run(self) -> list[list[int]]:
        while self.used > self.least and self._sweep():
            pass
        return [sorted(b) for b in self.bins if b]

    def _sweep(self) -> bool:
        """Offers every underfull container, the fullest first, the best steps that it can take. Whether there was any."""
        under = sorted((b for b in range(len(self.bins)) if self.bins[b] and self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
        ones = sorted((self.sizes[i], i) for b in under for i in self.bins[b])
        twos = []
        for b in under:
            first = {self.sizes[i]: i for i in sorted(self.bins[b], reverse=True)}  # different sizes of a container: few, as they add up to the capacity at most
            kinds = sorted(first)
            twos += [(x + y, first[x], first[y]) for k, x in enumerate(kinds) for y in kinds[:k]]
        twos.sort()
        changed = False
        for b in under:
            while self.bins[b] and self.fill[b] < self.capacity and (step := self._best(b, ones, twos)):
                self._take(b, *step)
                changed = True
                if self.used <= self.least:
                    return True
        return changed

    def _best(self, b: int, ones: list, twos: list) -> tuple[int, tuple[int, ...], int | None] | None:
        """The giver, what b gets and what it gives back for it: of all moves and exchanges that raise the squares, the one that fills b most."""
        best, gain, room = None, 0, self.capacity - self.fill[b]
        backs = [(0, None)] + sorted((self.sizes[j], j) for j in self.bins[b])
        for size, j in backs:
            for table in (ones, twos) if j is not None else (ones,):
                k = bisect_left(table, (size + room + 1,)) - 1
                while k >= 0 and (d := table[k][0] - size) > gain:
                    got = table[k][1:]
                    a = self.home[got[0]]
                    # the squares rise if b ends fuller than the giver was
                    if a != b and (len(got) == 1 or self.home[got[1]] == a) and self.fill[b] + d > self.fill[a]:
                        best, gain = (a, got, j), d
                        break
                    k -= 1
                if gain == room:
                    return best
        return best

    def _take(self, b: int, a: int, got: tuple[int, ...], back: int | None) -> None:
        for i, x, y in [(i, a, b) for i in got] + ([(back, b, a)] if back is not None else []):
            self.bins[x].discard(i)
            self.bins[y].add(i)
            self.fill[x] -= self.sizes[i]
            self.fill[y] += self.sizes[i]
            self.home[i] = y
        if not self.bins[a]:
            self.used -= 1


def improve(bins: list[list[int]], sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """The local search from the given containers. Each step raises the sum of squared fills, so it ends."""
    return _Search(bins, sizes, capacity).run()


def pack_list(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    return improve(best_fit(sizes, capacity), sizes, capacity)


def _solver(capacity: int, round_no: int, last: bool):
    """Packs a shard and names its finished containers: the full ones and the fuller half, in the last round all."""

    def solve(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["size", "key", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes = d["size"].tolist()
        names = [""] * len(sizes)
        bins = sorted(pack_list(sizes, capacity), key=lambda b: (-sum(sizes[i] for i in b), b))
        for k, b in enumerate(bins):
            if last or 2 * k < len(bins) or sum(sizes[i] for i in b) == capacity:
                for i in b:
                    names[i] = f"r{round_no}-{d['shard'].iat[0]}-{k}"
        d["container"] = names
        return d[["key", "piece", "size", "container"]]

    return solve


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """key, piece, size, container: every item in containers of the capacity, as few as possible.

    An item larger than the capacity is cut into full pieces, each a container of its own, and a rest (piece counts from 0); no
    other is cut. Items of size 0 or null take no room; all of them are in container "empty". Repeated
    rows are items of their own. Deterministic for the same rows. An empty table gives no rows.
    """
    kind = dict(items.dtypes)[key]
    it = items.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("size"))
    it = cut(it)  # sizing may be costly, and the items are read several times
    empty = it.where("size <= 0").select("key", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit("empty").alias("container"))
    whole = F.floor(F.col("size") / capacity).cast("int")
    over = it.where(F.col("size") > capacity)
    full = over.select("key", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")).select("key", "piece", F.lit(capacity).alias("size"), F.concat(F.lit("full-"), F.coalesce("key", F.lit("null")), F.lit("-"), F.col("piece").cast("string")).alias("container"))
    rest = over.select("key", whole.alias("piece"), (F.col("size") % capacity).cast("int").alias("size")).where("size > 0")
    todo = it.where((F.col("size") > 0) & (F.col("size") <= capacity)).select("key", F.lit(0).alias("piece"), "size").unionByName(rest)
    todo = cut(todo)
    done = []
    n, round_no = todo.count(), 0
    while n:
        shards = max(1, round(n / shard_items))
        last = shards == 1
        placed = todo.withColumn("shard", F.pmod(F.xxhash64(F.lit(round_no), "key", "piece"), F.lit(shards)))
        placed = cut(placed.groupBy("shard").applyInPandas(_solver(capacity, round_no, last), "key string, piece int, size int, container string"))
        done.append(placed.where("container <> ''"))
        todo = placed.where("container = ''")
        n, round_no = (0 if last else todo.count()), round_no + 1
    for d in done:
        full = full.unionByName(d)
    return full.unionByName(empty).select(F.col("key").cast(kind).alias(key), "piece", "size", "container")


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, n_tokens, container: documents sized in byte_bpe_50k tokens in containers of 2,048."""
    sizes = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pack(sizes, "doc_id", "n_tokens").withColumnRenamed("size", "n_tokens")
