"""Attributes of titles and replies, against cases written out by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmill.functions import attributes as A
from sparkmill.functions import columns as C
from sparkmill.functions.listings import folded
from sparkmill.functions.quantity import read_amount
from sparkmill.plans import checks


def values(spark, texts, make):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", make(F.col("v")).alias("x"))
    return [r["x"] for r in d.orderBy("i").collect()]


def test_breed_size(spark):
    cases = {
        "Royal Canin MINI Adult": "Mini", "Brit L-XL 12 kg": "L-XL", "xs-s adult": "XS-S", "Hrana XS-XL caini": None, "Nisip 7,6 L": None, "Nisip 7 , L": None, "HILL'S Plan": None, "HILL’S Plan M": "M", "M-Pets os": None, "L-Carnitina 10 g": None,
        "Os M 30-51 cm": None, "Os L, 40x30x20 cm": None, "Hrana S caini 10 kg": "S", "Lesa caine M": None, "Cușcă transport L": None, "Ham reglabil M": None, "with ham and chicken M": "M", "hrana m caini": None, "XL": "XL", "": None, None: None,
    }
    assert values(spark, list(cases), A.breed_size) == list(cases.values())


def test_stage_form_flavour(spark):
    assert values(spark, ["Adulti (8+)", "Senior 7+ pui", "Puppy & Junior", "8+ kg", "Mature", None], A.life_stage) == ["adult+8", "senior+7", "puppy", None, None, None]
    assert values(spark, ["Hrană uscată", "hrana semi-umeda", "semi umeda, umeda", "Conservă umedă", "plicuri uscate", "uscat", "sosete", None], lambda v: A.food_form(folded(v))) == ["dry", None, "wet", "tin", "pouch", "dry", None, None]
    assert values(spark, ["Ton și Creveți cu ton", "Șuncă/JAMBON", "ponton", "Căprioară venison pui", None], lambda v: A.flavour(folded(v))) == ["tuna+shrimp", "ham", None, "deer+chicken", None]


def test_sizes_meet(spark):
    pairs = [("Mini", "S", True), ("Mini", "M", False), ("Maxi", "L-XL", True), ("Maxi", "L", True), ("Medium", "M", True), ("xs-s", "Mini", True), ("S-L", "Maxi", True), ("odd", "M", None), (None, "M", None)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = d.select("i", C.overlaps(C.size_rank(F.col("a")), C.size_rank(F.col("b"))).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [p[2] for p in pairs]


@pytest.mark.parametrize(
    "text, price, why, error",
    [
        ("PRICE: 12.50 RON\r\nRATIONALE: because\nof this ", 12.5, "because\nof this", None), (" PRICE : 7\n\n RATIONALE:x", 7.0, "x", None), ("PRICE: 007\nRATIONALE: x", None, None, "not of the form"), ("PRICE: 1e9\nRATIONALE: x", None, None, "not of the form"),
        ("PRICE: -5\nRATIONALE: x", None, None, "not of the form"), ("PRICE: 0.00\nRATIONALE: x", None, None, "price is not positive"), ("PRICE: 1\nPRICE: 2\nRATIONALE: x", None, None, "not one PRICE line"), ("hello", None, None, "not one PRICE line"),
        ("Sure!\nPRICE: 3\nRATIONALE: x", None, None, "not of the form"), ("PRICE: 1.234\nRATIONALE: x", None, None, "not of the form"), ("PRICE: 3\nRATIONALE:  ", None, None, "not of the form"), ("", None, None, "not one PRICE line"),
    ],
)
def test_replies(spark, text, price, why, error):
    r = values(spark, [text], A.parse_reply)[0]
    assert (r["price"] if r["price"] is None else float(r["price"]), r["rationale"], r["error"]) == (price, why, error)


def test_answers(spark):
    assert [tuple(x) for x in values(spark, [" Yes\n", "No", "yes", "", None, "Yes."], A.parse_answer)] == [(1.0, True), (0.0, True), (0.0, False), (0.0, False), (0.0, False), (0.0, False)]
    assert values(spark, [None], A.parse_reply) == [None]


def test_composed_extraction_keeps_the_row(spark):
    d = spark.createDataFrame([(1, "Brit Premium Mini Adult pui hrană uscată 2 x 3 kg", "Brit Premium", "x"), (2, None, None, "x"), (3, "9" * 5000 + " kg", "", "x")], "id int, t string, b string, size string")
    rows = {r["id"]: r for r in checks.extracted(d, "t", "b").collect()}
    a = rows[1]
    assert (a["brand_name"], a["amount"]["weight_g"], a["amount"]["units"], a["flavours"], a["size"], a["stage"], a["form"], a["errors"]) == ("brit", 3000, 2, "chicken", "Mini", "adult", "dry", {})
    assert rows[2]["brand_name"] is None and rows[2]["errors"] == {} and rows[2]["amount"]["weight_g"] is None
    assert rows[3]["errors"] == {} and rows[3]["amount"]["weight_g"] is None


def test_an_unreadable_field_has_its_error(monkeypatch):
    def broken(t):
        if t == "bad":
            raise ValueError("unreadable")
        return read_amount(t)

    monkeypatch.setattr(checks, "read_amount", broken)
    out = checks._amount.func(pd.Series(["2 kg", "bad", None]))
    assert out["error"].tolist() == [None, "ValueError: unreadable", None] and out["weight_g"].tolist()[0] == 2000 and out["weight_g"].isna().tolist() == [False, True, True]
