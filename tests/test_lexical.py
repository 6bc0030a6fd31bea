import re

import __spark_entry__ as e


def words(title):
    return set(re.findall(r"[a-z0-9']+", title.lower())) if title else set()


def test_every_product_is_ranked_by_all_its_words(spark, tmp_path):
    products = [(1, "Granule Gold 2 kg"), (2, "Oil"), (3, "granule adultish Gold"), (4, ""), (5, None), (6, "kg 2 oil absent")]
    listings = [(10, "Gold granule 2 kg"), (11, "GRANULE for cats, Gold, 2 kg"), (12, "granule adultish"), (13, "oil 2 kg"), (14, "Adultish granule gold new"), (15, None)]
    listings += [(k, f"granule oil n{k}") for k in range(100, 320)]
    spark.createDataFrame(products, "id int, title string").write.parquet(f"{tmp_path}/products.parquet")
    spark.createDataFrame(listings, "id int, sample_title string").write.parquet(f"{tmp_path}/norm_listings.parquet")
    want = set()
    for q, title in products:
        hits = [(-round(len(words(title)) / len(words(t)), 6), i) for i, t in listings if words(title) and words(title) <= words(t)]
        want |= {(q, i, -s, pos) for pos, (s, i) in enumerate(sorted(hits)[:200], 1)}
    got = {(r["q"], r["i"], r["score"], r["pos"]) for r in e.queries()["lexical_ranked"](spark, str(tmp_path)).collect()}
    assert got == want and {q for q, *_ in want} == {1, 2, 3}
