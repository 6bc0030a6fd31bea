import random

from sparkmill.llm.topn import top_n


def brute(rows, n):
    best = {}
    for p, s, x, sc in rows:
        if p is None or x is None or sc is None or sc != sc:
            continue
        g = best.setdefault((p, s), {})
        g[x] = max(g.get(x, float("-inf")), sc + 0.0)
    return sorted((p, s or "", x, i) for (p, s), g in best.items() for i, (x, _) in enumerate(sorted(g.items(), key=lambda t: (-t[1], t[0]))[:n], 1))


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice([f"x{i}" for i in range(40)] + [None, "", "Ω"]), rng.choice([0.5, 0.25, -0.0, 0.0, 1.0, float("nan"), None, float("inf"), rng.random()])) for _ in range(3000)]
    df = spark.createDataFrame([(*r, 7, 0.0) for r in rows], "p int, s string, x string, sc double, pos int, bound double").repartition(7)
    got = sorted((r["p"], r["s"] or "", r["x"], r["pos"]) for r in top_n(df, "p", "s", "x", "sc", 3).collect())
    assert got == brute(rows, 3)


def test_pending_rows_are_reduced(spark, monkeypatch):
    df = spark.range(20000).selectExpr("cast(id % 3 as int) p", "'a' s", "cast(id as string) x", "cast(id as double) sc")
    got = [(r["p"], r["x"]) for r in top_n(df, "p", "s", "x", "sc", 2).orderBy("p", "pos").collect()]
    assert got == [(0, "19998"), (0, "19995"), (1, "19999"), (1, "19996"), (2, "19997"), (2, "19994")]


def test_empty(spark):
    assert top_n(spark.createDataFrame([], "p int, s string, x string, sc double"), "p", "s", "x", "sc").count() == 0
