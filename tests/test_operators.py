import itertools
import math
import random
from datetime import date

from pyspark.sql import functions as F

from sparkmill.functions import columns as C
from sparkmill.operators import keyed as K
from sparkmill.operators import sampling as P
from sparkmill.operators import series as S
from sparkmill.operators import similarity as V
from sparkmill.operators import statistics as A
from sparkmill.operators.graph import connected_components
from sparkmill.sources import pages, sinks


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        else:
            find(a if a is not None else b)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(30)] + [(5, None), (None, 900), (7, 7), (7, 7)]
    df = spark.createDataFrame(edges, "a int, b int")
    assert {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()} == components(edges)
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), ("a", 8, 80), ("b", None, 1)], "k string, t2 int, v int")
    got = {(r["k"], r["t"]): r["v"] for r in K.asof(left, right, ["k"], "t", "t2", ["v"]).collect()}
    assert got == {("a", 5): 51, ("a", 1): None, ("b", 9): None, (None, 3): None, ("a", None): None}


def test_keyed(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 3, "w")], "k string, o int, v string")
    assert sorted(r["v"] for r in K.latest_with_ties(d, ["k"], "o").collect()) == ["y", "z"]
    assert sorted(r["v"] for r in K.one_per_key(d, ["k"], ["o", "v"]).collect()) == ["w", "z"]
    a, b = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k int, v int"), spark.createDataFrame([(1, None), (2, 6), (4, 1)], "k int, v int")
    assert sorted(tuple(r) for r in K.compare_tables(a, b, ["k"], ["v"]).collect()) == [(2, "different"), (3, "missing_right"), (4, "missing_left")]


def test_series(spark):
    days = spark.createDataFrame([("a", date(2026, 1, d)) for d in (1, 2, 3, 6, 7)] + [("b", date(2026, 1, 2))], "k string, d date")
    assert {r["k"]: r["streak"] for r in S.streak_at_end(days, ["k"], "d").collect()} == {"a": 2, "b": 1}
    assert sorted(r["d"].day for r in S.gaps(days, ["k"], "d").collect()) == [4, 5]
    e = spark.createDataFrame([("a", date(2026, 1, d), d == 8) for d in range(1, 15)], "k string, d date, e boolean")
    assert S.evaluable(e, ["k"], "d", "e").count() == 1
    assert S.evaluable(e.where("d <> '2026-01-03'"), ["k"], "d", "e").count() == 0
    assert S.evaluable(e.where("d <> '2026-01-03'"), ["k"], "d", "e", missing=1).count() == 1


def test_move_boundary(spark):
    d = spark.createDataFrame([("100.00", "102.00"), ("100.00", "101.99"), ("0.00", "1.00"), ("0.00", "0.00")], "a string, b string")
    m = d.select(S.moved(F.col("b").cast("decimal(12,2)"), F.col("a").cast("decimal(12,2)"), 2).alias("m"))
    assert [r["m"] for r in m.collect()] == [True, False, True, False]


def test_statistics(spark):
    d = spark.range(1)
    for b, c in itertools.product(range(6), range(6)):
        want = 1.0 if b + c == 0 else min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
        assert abs(d.select(A.mcnemar(F.lit(b), F.lit(c)).alias("p")).first()["p"] - want) < 1e-12
    w = d.select(A.wilson(F.lit(0.0), F.lit(0.0)).alias("w")).first()["w"]
    assert (w["low"], w["high"]) == (0.0, 1.0)
    v = spark.createDataFrame([("a", float(x)) for x in (1, 1, 2, 3, 4, 5)] + [("a", None)], "k string, v double")
    r = A.nearest_rank(v, ["k"], "v", {"m": 0.5}).first()
    assert (r["n"], r["m"]) == (6, 2.0)  # round half even of 2.5 is 2


def test_quotas(spark):
    c = spark.createDataFrame([("a", 3), ("b", 50), ("c", 0), ("d", 12), ("e", 99)], "g string, n int")
    want, carry = {}, 0
    for g, n in (("a", 3), ("b", 50), ("c", 0), ("d", 12), ("e", 99)):
        want[g] = min(n, 10 + carry)
        carry = 10 + carry - want[g]
    assert {r["g"]: r["take"] for r in P.quotas(c, "g", "n", "g", 10).collect()} == want


def test_vectors(spark):
    e = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.1]), (3, 0, [0.0, 1.0]), (4, 0, None), (5, 0, [0.0, 0.0]), (6, None, [1.0, 0.0])], "i int, b int, v array<float>")
    got = [(r["q"], r["i"]) for r in V.block_top_k(e, e, "b", "i", "i", "v", 1).collect() if r["q"] == 1]
    assert got == [(1, 2)]


def test_blocks_of_vectors(spark, monkeypatch):
    """Parts of any size give what all pairs give; repeated ids, ties and the query itself among the nearest."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)]
    d = spark.createDataFrame(rows, "i int, b int, v array<float>")
    want = {}
    for q, b, v in rows:
        sims = [(-round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 6) + 0.0, i) for i, c, w in rows if c == b and i != q and any(v) and any(w)]
        want[q] = [i for _, i in sorted(sims)[:4]]
    for size in (7, 2048):
        monkeypatch.setattr(V, "BLOCK_ROWS", size)
        got = {}
        for r in V.block_top_k(d, d, "b", "i", "i", "v", 4).orderBy("q", "rank").collect():
            got.setdefault(r["q"], []).append(r["i"])
        assert got == {q: x for q, x in want.items() if x}
    assert V.block_top_k(d.limit(0), d, "b", "i", "i", "v", 4).count() == 0


def test_text(spark):
    d = spark.createDataFrame([("Pui și Rață",), (None,), ("",)], "t string")
    r = d.select(C.flavours(F.col("t")).alias("f"), C.fold(F.col("t")).alias("o"), C.blocking_key(F.col("t")).alias("b")).collect()
    assert (r[0]["f"], r[0]["o"], r[1]["f"], r[2]["b"]) == ("Chicken+Duck", "pui si rata", None, None)
    m = spark.createDataFrame([("1.234,50 lei",), ("12,5",), ("99.90",), ("0,00",), ("abc",), (None,), ("1.234",)], "t string").select(C.money(F.col("t")).cast("double").alias("m"))
    assert [x["m"] for x in m.collect()] == [1234.5, 12.5, 99.9, None, None, None, 1234.0]


def test_pages(spark):
    body = '{"products": [{"id": 1, "title": "A", "handle": "a", "variants": [{"id": 10, "title": "Default Title", "price": "5.00"}, {"id": 11, "title": "2 kg", "price": ""}]}, {"id": 2, "title": null}]}'
    p = spark.createDataFrame([("u", body), ("v", "no json"), ("w", None)], "url string, body string")
    rows = pages.json_products(p).collect()
    assert sorted((r["title"], r["link"]) for r in rows if r["title"]) == [("A", "/products/a?variant=10"), ("A - 2 kg", "/products/a?variant=11")]
    assert sorted(r["url"] for r in rows if r["error"]) == ["v", "w"]
    h = spark.createDataFrame([("u", "<li class=c><b>Hi</b> <i>3,50</i></li><li class=c><b> </b></li>"), ("v", None)], "url string, html string")
    cards = pages.html_cards(h, r"<li class=c>.*?</li>", {"title": r"<b>(.*?)</b>", "price": r"<i>(.*?)</i>"}).collect()
    assert [(r["title"], r["price"]) for r in cards] == [("Hi", "3,50"), (None, None)]
    m = spark.createDataFrame([("d", "# T\n## 1. One\nbody\nmore\n## 2. Two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")], "doc string, text string")
    assert [(r["number"], r["heading"], r["body"][:4]) for r in pages.markdown_sections(m).collect()] == [(1, "One", "body"), (2, "Two", "| a ")]
    assert [r["cells"] for r in pages.markdown_table(m).collect()] == [["a", "b"], ["1", "2"]]
    s = spark.createDataFrame([("u", 'x<script>S={"p:1": {"seller": "s:1"}, "s:1": {"name": "N"}, "p:2": {"seller": "s:9"}}</script>')], "url string, html string")
    nodes = pages.follow(pages.embedded_state(s, r"S=(\{.*\})</script>"), "$.seller", "seller")
    assert {r["key"]: r["seller"] is not None for r in nodes.collect()} == {"p:1": True, "s:1": False, "p:2": False}


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    n = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    once = sinks.upsert(t, n, ["k"], ["o"])
    assert sorted((r["k"], r["v"]) for r in once.collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(sinks.upsert(once, n, ["k"], ["o"]).collect()) == sorted(once.collect())
    assert {r["k"]: r["action"] for r in sinks.upsert_and_delete(t, n.where("o <> 1 OR k = 3"), ["k"], ["v"]).collect()} == {1: "delete", 2: "update", 3: "insert"}
    assert [r["k"] for r in sinks.append_new(t, n, "k").collect()] == [3]
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(once, path, ["k"])
    sinks.overwrite_partitions(once.where("k = 1").withColumn("v", F.lit("z")), path, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "d"), (3, "e")]


def test_adapters(spark, tmp_path):
    from sparkmill.sources.adapters import ShopPages

    (tmp_path / "a.json").write_text('{"products": [{"title": "T", "price": 3}, {"title": null}]}')
    (tmp_path / "b.json").write_text("broken")
    spark.dataSource.register(ShopPages)
    rows = spark.read.format("shop_pages").option("path", str(tmp_path)).option("shop", "json").load().collect()
    assert [tuple(r) for r in rows] == [("a.json", 0, "T", "3")]


def test_streams(spark, tmp_path):
    from sparkmill.streaming import twins

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, "y"), ("b", 1, None)], "k string, at int, v string")
    rows.repartition(2).write.parquet(str(tmp_path / "s"))
    s = twins.stream_of(spark, str(tmp_path / "s"))
    got = twins.run_to_end(twins.changes_only(s, "k", "at", "v"), spark, "append", "c").collect()
    assert {r["v"] for r in got} == {"x", "y"}
    table, log = twins.guarded_upserts(twins.stream_of(spark, str(tmp_path / "s"), 100), spark, ["k"], ["at"], previous=100)
    assert log[0][1:] == (5, False) and table.count() == 0
    table, log = twins.guarded_upserts(twins.stream_of(spark, str(tmp_path / "s"), 100), spark, ["k"], ["at"], previous=5)
    assert log[0][1:] == (5, True) and {r["k"]: r["at"] for r in table.collect()} == {"a": 4, "b": 1}
