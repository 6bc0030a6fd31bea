import math
import random
from collections import Counter

import pytest

from sparkmill.llm import packing
from sparkmill.llm.packing import best_fit, improve, pack


def check(spark, sizes, capacity, **kw):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "k bigint, n int, container string")
    rows = pack(df, "k", "n", capacity, **kw).collect()
    fill, pieces = Counter(), Counter()
    for r in rows:
        pieces[r["k"]] += r["size"]
        if r["container"] != "empty":
            fill[r["container"]] += r["size"]
            assert r["size"] <= capacity
    assert all(f <= capacity for f in fill.values())
    assert [pieces[i] for i in range(len(sizes))] == [s or 0 for s in sizes]
    for i, s in enumerate(sizes):
        if s is not None and s <= capacity:
            assert sum(r["k"] == i for r in rows) == 1
    return len(fill)


def test_whole_and_few(spark):
    rng = random.Random(5)
    sizes = [rng.choice([3, 17, 60, 99, 100, 101, 250, 0, None, rng.randint(1, 100)]) for _ in range(600)]
    n = check(spark, sizes, 100)
    assert n <= math.ceil(sum(s or 0 for s in sizes) / 100) * 1.15


def test_shards_meet(spark):
    rng = random.Random(6)
    sizes = [rng.randint(1, 40) for _ in range(2000)]
    assert check(spark, sizes, 100, shard_items=150) <= math.ceil(sum(sizes) / 100) + 2


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "k bigint, n int")
    assert pack(df, "k", "n", 10).count() == 0
    twice = spark.createDataFrame([(1, 4), (1, 4), (None, 4)], "k bigint, n int")
    assert pack(twice, "k", "n", 10).groupBy("container").sum("size").count() == 2


def test_search_empties_a_bin():
    sizes = [6, 6, 5, 5, 4, 4]
    bins = [[0], [1], [2, 3], [4, 5]]  # 6 | 6 | 10 | 8
    assert len(improve([list(b) for b in bins], sizes, 10)) == 3
    assert sum(len(b) for b in best_fit(sizes, 10)) == 6


@pytest.mark.parametrize("least, most, gap", [(500, 1100, 0.6), (300, 900, 0.5)])
def test_search_beats_best_fit(least, most, gap):
    """Sizes of which few sums fill a container: the search closes a large part of the gap between best fit and the lower bound."""
    rng = random.Random(1)
    sizes = [rng.randint(least, most) for _ in range(3000)]
    bound, plain = -(-sum(sizes) // 2048), best_fit(sizes, 2048)
    done = improve([list(b) for b in plain], sizes, 2048)
    assert sorted(i for b in done for i in b) == list(range(3000)) and max(sum(sizes[i] for i in b) for b in done) <= 2048
    assert len(done) - bound <= gap * (len(plain) - bound)


def test_every_step_raises_the_squares():
    rng = random.Random(3)
    sizes = [rng.randint(1, 60) for _ in range(300)]
    search = packing._Search(best_fit(sizes, 100), sizes, 100)
    squares = lambda: sum(f * f for f in search.fill)
    take, seen = search._take, [squares()]

    def step(*a):
        take(*a)
        seen.append(squares())

    search._take, search.least = step, 0
    search.run()
    assert len(seen) > 1 and all(x < y for x, y in zip(seen, seen[1:]))


def test_shards_of_hard_sizes(spark):
    """Items of which no two fit together settle too; small shards waste little more than a single one."""
    sizes = [1100] * 2000
    assert check(spark, sizes, 2048, shard_items=200) == 2000
    rng = random.Random(8)
    sizes = [rng.randint(500, 1100) for _ in range(3000)]
    parted, whole = check(spark, sizes, 2048, shard_items=250), len(packing.pack_list(sizes, 2048))
    assert parted <= 1.02 * whole
