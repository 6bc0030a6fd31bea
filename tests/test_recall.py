from sparkmill.operators.similarity import recall_either_direction


def test_recall_counts_either_direction_per_bucket_and_pooled(spark):
    ranking = spark.createDataFrame([("a", "b", 1), ("a", "c", 3), ("d", "a", 2), ("b", "a", 1), ("e", "f", 2)], "q string, i string, r int")
    pairs = [("x", "a", "b"), ("x", "a", "d"), ("x", "a", "c"), ("y", "f", "e"), ("y", "f", "g"), ("y", "f", "f"), ("y", None, "a"), (None, "g", "a")]
    df = spark.createDataFrame(pairs, "s string, l string, m string")
    got = {tuple(r) for r in recall_either_direction(ranking, df, "q", "i", "r", "l", "m", "s", 2).collect()}
    assert got == {("x", 0, 3, 2, 0.666667), ("y", 0, 2, 1, 0.5), (None, 0, 1, 0, 0.0), (None, 1, 6, 3, 0.5)}
    assert recall_either_direction(ranking, df.limit(0), "q", "i", "r", "l", "m", "s", 2).count() == 0
