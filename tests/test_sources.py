"""Files written and read back, settings, and streams against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from sparkmill.sources import pages, sinks
from sparkmill.streaming import twins

SCHEMA = "a int, b string, c double"
ROWS = [(1, 'say "hi", you', 1.5), (2, "two\nlines", None), (3, None, -0.25), (None, "ü;|", 3.0)]


def test_csv_and_json_come_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    key = lambda r: (r[0] is None, r)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, pages.read_csv(spark, str(tmp_path / "c"), SCHEMA).collect()), key=key) == sorted(ROWS, key=key)
    sinks.write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, pages.read_json(spark, str(tmp_path / "j"), SCHEMA, lines=True).collect()), key=key) == sorted(ROWS, key=key)
    sinks.write_csv(df.limit(0), str(tmp_path / "c"))
    assert pages.read_csv(spark, str(tmp_path / "c"), SCHEMA).count() == 0
    (tmp_path / "one.json").write_text('[{"a": 1, "b": "x", "other": 2}, {"a": null}]')
    assert [tuple(r) for r in pages.read_json(spark, str(tmp_path / "one.json"), SCHEMA).collect()] == [(1, "x", None), (None, None, None)]
    (tmp_path / "bom.csv").write_bytes("\ufeffa,b,c\n1,x,\n".encode())
    assert [tuple(r) for r in pages.read_csv(spark, str(tmp_path / "bom.csv"), SCHEMA).collect()] == [(1, "x", None)]


def test_settings(spark, tmp_path):
    (tmp_path / "s.toml").write_text('top = 1\n[limits]\nfloor = 0.05\nname = "x"\n')
    assert {tuple(r) for r in pages.toml_table(spark, str(tmp_path / "s.toml")).collect()} == {("", "top", "1"), ("limits", "floor", "0.05"), ("limits", "name", "x")}


def test_windows_equal_their_batch_twins(spark, tmp_path):
    at = lambda minutes: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minutes)
    rows = [("a", at(m)) for m in (0, 3, 9, 10, 31, 32, 55)] + [("b", at(m)) for m in (5, 5, 47)]
    for part in (rows[:5], rows[5:], [("end", at(100_000))], [("end", at(200_000))]):  # later rows close the windows before
        spark.createDataFrame(part, "k string, t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    batch = spark.read.parquet(str(tmp_path / "e"))
    for name, make in {
        "tumbling": lambda d: twins.tumbling(d, "t", ["k"], "10 minutes", "60 minutes"),
        "sliding": lambda d: twins.sliding(d, "t", ["k"], "20 minutes", "10 minutes", "60 minutes"),
        "sessions": lambda d: twins.sessions(d, "t", ["k"], "15 minutes", "60 minutes"),
    }.items():
        stream = twins.stream_of(spark, str(tmp_path / "e"), 100)
        got = sorted(map(tuple, twins.run_to_end(make(stream), spark, "append", name).where("k <> 'end'").collect()))
        want = sorted(map(tuple, make(batch).where(F.col("k") != "end").collect()))
        assert got == want and len(want) > 3, name


def test_walk_stops(spark):
    p = spark.createDataFrame([("a", 1, False, True), ("a", 2, False, False), ("a", 3, False, True), ("b", 1, True, True), ("b", 2, False, True), ("c", 1, False, True), ("c", 2, False, True), ("c", 3, False, True)], "c string, p int, failed boolean, more boolean")
    r = spark.createDataFrame([(c, n, f"{c}{n}", 0) for c, n in [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3)]] + [("c", 1, "a1", 1), ("c", 1, None, 2)], "c string, p int, k string, at int")
    walk = lambda most=None: [x["k"] for x in pages.category_walk(p, r, "c", "p", "failed", "more", "k", "at", 2, most).orderBy("c", "p", "at").collect()]
    assert walk() == ["a1", "a2", "c1", None, "c2"] and walk(3) == ["a1", "a2", "c1"]
    assert pages.category_walk(p.limit(0), r, "c", "p", "failed", "more", "k", "at", 2).count() == 0


def test_sample_with_cases(spark):
    from sparkmill.operators.sampling import sample_with_cases

    d = spark.range(200).selectExpr("id", "CASE WHEN id < 150 THEN 's' WHEN id < 190 THEN 't' END AS s", "CASE WHEN id IN (3, 4, 5) THEN array('x') WHEN id = 7 THEN array('x', 'y') ELSE array() END AS c")
    got = {r["id"] for r in sample_with_cases(d, "id", "s", "c", 40, 2).collect()}
    assert len(got) == 40 and 7 in got and len(got & {3, 4, 5, 7}) >= 2 and sum(i < 150 for i in got) in range(28, 34) and any(i >= 190 for i in got)
    assert got == {r["id"] for r in sample_with_cases(d.repartition(5), "id", "s", "c", 40, 2).collect()}
    assert sample_with_cases(d, "id", "s", "c", 500, 2).count() == 200 and sample_with_cases(d.limit(0), "id", "s", "c", 5, 2).count() == 0
