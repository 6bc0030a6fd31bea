"""Changes of a day pair against sets written out by hand, and folding against Python's own normalisation."""

import hashlib
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkmill.functions import columns as C
from sparkmill.operators import series as S

PAIRS = [
    # price, compare before; price, compare now; kinds
    (100, None, 102, None, {"base_change"}),
    (100, None, 101.99, None, {"sub_threshold"}),
    (100, None, 100, None, set()),
    (100, None, 100, 100, set()),
    (100, None, 80, 100, {"promo_start"}),
    (100, None, 80, 120, {"base_change", "promo_start"}),
    (80, 100, 100, None, {"promo_end"}),
    (80, 100, 120, None, {"base_change", "promo_end"}),
    (80, 100, 70, 100, {"promo_depth"}),
    (80, 100, 70, 110, {"base_change", "promo_depth"}),
    (80, 100, 80.5, 100, {"sub_threshold"}),
    (80, 100, 80, 100.5, {"sub_threshold"}),
    (80, 90, 80, 70, {"base_change", "promo_end"}),
    (80, 70, 80, None, set()),
    (0, None, 5, None, {"base_change"}),
    (0, None, 0, None, set()),
]


@pytest.mark.parametrize("percent", [2])
def test_all_kinds_of_a_day_pair(spark, percent):
    dec = lambda x: None if x is None else Decimal(str(x))
    rows = [(i, *map(dec, p[:4])) for i, p in enumerate(PAIRS)]
    d = spark.createDataFrame(rows, "i int, prev_p decimal(12,2), prev_c decimal(12,2), p decimal(12,2), c decimal(12,2)")
    got = {r["i"]: r["k"] for r in d.select("i", S.move_kinds("p", "c", percent).alias("k")).collect()}
    assert {i: set(k) for i, k in got.items()} == {i: p[4] for i, p in enumerate(PAIRS)}
    assert all(len(k) == len(set(k)) for k in got.values())


def test_fold_is_nfkd(spark):
    texts = ["Hrană  uscată", "½ kg", "SÜSS ™ ﬁn", "A\u00a0B\u2003C", " x ", "İstanbul", "ё й", "ＡＢ", "", None, "plain ASCII\t\nX"]
    want = [None if t is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)).split()) for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    d = d.select("i", C.fold(F.col("t")).alias("f")).withColumn("h", C.content_hash(F.col("f")))
    got = {r["i"]: (r["f"], r["h"]) for r in d.collect()}
    assert [got[i] for i in range(len(texts))] == [(w, w if w is None else hashlib.sha256(w.encode()).hexdigest()) for w in want]
