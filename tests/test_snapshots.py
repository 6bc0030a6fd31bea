from datetime import date

from sparkmill.operators.snapshots import diff_snapshots

D = [date(2026, 1, d) for d in range(1, 5)]


def run(spark, rows, snaps):
    r = spark.createDataFrame(rows, "s string, k string, d date, h string, p decimal(12,2), at int, n int, change_kind string")
    s = spark.createDataFrame(snaps, "s string, d date")
    return sorted(tuple(x) for x in diff_snapshots(r, s, "s", "k", "d", ["h", "p"], ["at"]).collect())


def test_kinds(spark):
    rows = [
        ("a", "x", D[0], "1", None, 1, 0, ""), ("a", "x", D[0], "9", None, 0, 0, ""),  # the latest delivery holds
        ("a", "x", D[1], "1", None, 1, 0, ""), ("a", "x", D[1], "1", None, 1, 0, ""),  # null equals null, repeated row
        ("a", "y", D[0], None, None, 1, 0, ""), ("a", "z", D[1], "1", None, 1, 0, ""),
        ("a", "x", D[3], None, None, 1, 0, ""), ("b", "x", D[1], "1", None, 1, 0, ""),
        ("a", None, D[1], "1", None, 1, 0, ""), (None, "q", D[1], "1", None, 1, 0, ""), ("a", "off", D[2], "1", None, 1, 0, ""),
    ]
    got = run(spark, rows, [("a", D[0]), ("a", D[1]), ("a", D[3]), ("a", D[3]), ("b", D[1]), ("b", D[2])])
    assert got == [("a", "x", D[3], "changed"), ("a", "y", D[1], "removed"), ("a", "z", D[1], "added"), ("a", "z", D[3], "removed"), ("b", "x", D[2], "removed")]


def test_values_that_move_between_columns(spark):
    r = spark.createDataFrame([("a", "x", D[0], "v", None), ("a", "x", D[1], None, "v")], "s string, k string, d date, h string, p string")
    s = spark.createDataFrame([("a", D[0]), ("a", D[1])], "s string, d date")
    assert diff_snapshots(r, s, "s", "k", "d", ["h", "p"], ["h"]).collect()[0]["change_kind"] == "changed"


def test_empty(spark):
    assert run(spark, [], [("a", D[0])]) == []
