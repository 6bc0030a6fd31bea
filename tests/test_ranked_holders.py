import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from sparkmill.operators import lexical

LETTERS = "abcdefghij"


def write(spark, path, products, listings):
    spark.createDataFrame(products, "id int, title string").write.parquet(f"{path}/products.parquet")
    spark.createDataFrame(listings, "id int, sample_title string").write.parquet(f"{path}/norm_listings.parquet")


def brute(queries, items, k):
    want = set()
    for q, ws in queries:
        hits = [(-round(len(ws) / len(t), 6), i) for i, t in items if ws and set(ws) <= set(t)]
        want |= {(q, i, -s, pos) for pos, (s, i) in enumerate(sorted(hits)[:k], 1)}
    return want


def test_the_titles_words_are_not_broadcast(spark, tmp_path):
    """Spark takes 5,000 titles for less than 10 MB also when a row a word is made of them, each with all words; the driver would hold them all."""
    rnd = random.Random(1)
    listings = [(k, " ".join(f"{rnd.choice(LETTERS)}word{rnd.randrange(300)}" for _ in range(14)) + f" own{k}") for k in range(5000)]
    write(spark, tmp_path, [(k, f"own{k} {listings[k][1].split()[0]}") for k in range(0, 5000, 50)], listings)
    key, before = "spark.sql.maxBroadcastTableSize", spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set(key, "8m")
    try:
        got = e.queries()["lexical_ranked"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r["q"], r["i"], r["pos"]) for r in got) == [(k, k, 1) for k in range(0, 5000, 50)]


@pytest.mark.parametrize("equal", ["none", "ids", "words", "both"])
def test_equal_hashes_change_no_row(spark, monkeypatch, equal):
    rnd = random.Random(2)
    sets = lambda n, least, most: [(k, sorted(rnd.sample(LETTERS, rnd.randint(least, most)))) for k in range(n)]
    queries, items = [*sets(40, 0, 4), (90, ["absent"]), (91, ["a", "absent"])], [*sets(60, 0, 6), (80, ["a", "b"]), (81, ["a", "b"])]
    if equal in ("ids", "both"):
        monkeypatch.setattr(lexical, "_id", lambda text: F.lit(7).cast("long"))
    if equal in ("words", "both"):
        monkeypatch.setattr(lexical, "_keys", lambda text: F.array(F.lit(0)))
    got = lexical.rank_holders(spark.createDataFrame(queries, "q int, ws array<string>"), spark.createDataFrame(items, "i int, t array<string>"), 5).collect()
    assert len(got) == len(set(got)) and {(r["q"], r["i"], r["score"], r["pos"]) for r in got} == brute(queries, items, 5)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path / "q", [(1, "oil")], [])
    write(spark, tmp_path / "n", [], [(1, "oil")])
    for d in "qn":
        assert e.queries()["lexical_ranked"](spark, str(tmp_path / d)).collect() == []
