"""Listing functions against cases written out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkmill.functions import listings as L
from sparkmill.operators import labels as B
from sparkmill.operators import sampling as P
from sparkmill.operators import series as S
from sparkmill.sources import pages

KEYS = [
    ("Hrana uscata caini Brit Care Lamb 12 kg", "Brit Care", "brit care | lamb | 12000g"),
    ("Lamb BRIT  care 12kg caini", "BRIT care", "brit care | lamb | 12000g"),
    ("Brit Care Lamb 12 kg + 2 kg gratis", "Brit Care", "brit care | lamb | 12000g +2000g"),
    ("Brit Care Lamb 12+2kg", "Brit Care", "brit care | lamb | 12000g +2000g"),
    ("Brit Care Lamb 24x85 g", "Brit Care", "brit care | 24x85 lamb | 2040g"),
    ("Brit Care Lamb 24 × 0,085 kg", "Brit Care", "brit care | lamb | 2040g"),
    ("Hrană uscată câini ORIJEN Original 0,85kg", None, "orijen | original | 850g"),
    ("ORIJEN Original", "Orijen", None),
    ("ORIJEN 2 kg", "Orijen", None),
    ("Smølke Vådfoder 400 g", "Smølke", "smolke | vadfoder | 400g"),
    ("Hill’s Science 1,5 l", "Hill's", "hill's | science | 1500g"),
    ("Lamb 0 kg", "Brit", None),
    ("", "Brit", None),
    (None, "Brit", None),
    ("Lamb 2 kg", "  ", "lamb |  | 2000g"),
    ("Lamb 99999999999999999999999999 kg", "Brit", None),
]


def test_overlap_keys(spark):
    d = spark.createDataFrame([(i, t, b) for i, (t, b, _) in enumerate(KEYS)], "i int, title string, brand string").withColumn("t", L.folded(F.col("title")))
    d = d.withColumns({"b": L.key_brand(F.col("brand"), F.col("t")), "w": L.base_grams(F.col("t")), "x": L.bonus_grams(F.col("t"))})
    got = {r["i"]: r["k"] for r in d.select("i", L.overlap_key(F.col("b"), L.line_words(F.col("t"), F.col("b")), F.col("w"), F.col("x")).alias("k")).collect()}
    want = {i: k for i, (_, _, k) in enumerate(KEYS)}
    want[14] = None  # nothing is left but the brand
    assert got == want


def one(spark, value, *columns, kind="string"):
    return tuple(spark.createDataFrame([(value,)], f"v {kind}").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    "brand, canonical, span",
    [
        ("PRO PLAN", "purina", "pro plan"), ("PURINA Pro Plan", "purina", "purina"), ("Hill’s Science Plan", "hill's", "hill's"), ("Premium", "premium", "premium"), ("Brit Premium", "brit", "brit"),
        ("Brit Care Premium", "brit care", "brit care"), (" BRIT ", "brit", "brit"), ("", None, None), ("  ", None, None), (None, None, None), ("one", "one", "one"), ("opti", "opti", "opti"),
    ],
)
def test_brands(spark, brand, canonical, span):
    v = F.col("v")
    assert one(spark, brand, L.canonical_brand(v), L.brand_span(v), L.distributor(L.canonical_brand(v))) == (canonical, span, brand == "opti")


@pytest.mark.parametrize(
    "kind, title, category, species",
    [
        ("hrana-uscata-caini", "", "food", "dog"), ("asternut-litiera-nisip-silicat", "caini", "litter", "cat"), ("Jucarie pentru pisici ", "x", "toy", "cat"), ("sampon pentru caini si pisici", "x", "accessory", None),
        ("unknown", "Nisip pentru pisici", "litter", "cat"), ("unknown", "Ham reglabil câini", "accessory", "dog"), ("unknown", "Hammer", None, None), (None, "Lesă pentru pisici și câini", "accessory", None), (None, "", None, None),
        (None, "Advance Dog Adult", None, "dog"), (None, "Royal Canin Kitten", None, "cat"), ("lapte praf", "pentru pisici", "food", "cat"),
    ],
)
def test_categories(spark, kind, title, category, species):
    d = spark.createDataFrame([(kind, title)], "k string, v string").withColumn("t", L.folded(F.col("v"))).withColumn("c", L.category(F.col("k"), F.col("t")))
    assert tuple(d.select("c", L.species(F.col("k"), F.col("t"), F.col("c"))).first()) == (category, species)


def test_every_kind_of_goods_is_known(spark):
    kinds = L.FOOD + L.ACCESSORY + L.LITTER + L.TOY
    assert len(kinds) == len(set(kinds)) == 40
    d = spark.createDataFrame([(k,) for k in kinds], "k string").withColumn("s", L.species(F.col("k"), F.lit(""), L.category(F.col("k"), F.lit(""))))
    got = {r["k"]: r["s"] for r in d.collect()}
    assert {k for k, s in got.items() if s is None} == {"igiena-si-ingrijire"} & set() | {k for k in kinds if k not in L.LITTER and (k in L.NO_SPECIES or not any(w in k for w in ("caini", "catei", "pisic")))}


def test_texts(spark):
    v = F.col("v")
    assert one(spark, 'a "b"  \n c' + "x" * 300, L.clean_text(v))[0] == ("a 'b' c" + "x" * 300)[:160]
    assert one(spark, "tuna+Salmon++tuna", L.flavour_set(v))[0] == ["salmon", "tuna"] and one(spark, None, L.flavour_set(v))[0] == []
    assert [one(spark, t, L.stage_marker(F.lit(None).cast("string"), L.folded(v)))[0] for t in ("Pisoi 2 kg", "Cățeluș", "Senior Junior", "pui", None)] == ["kitten", "puppy", "senior", None, None]
    assert one(spark, "Adult", L.stage_marker(v, F.lit("junior")))[0] == "adult"
    assert one(spark, "12 kg Hrana uscata 2,5 kg + 1 kg mini 5 - 10 kg 4 x 85 g Smølke", L.hard_cases(L.folded(v)))[0] == ["bonus_pack", "breed_size_code", "decimal_comma", "dosage_band", "missing_diacritics", "multipack", "special_char_brand", "weight_leading_token"]
    assert one(spark, "nimic", L.hard_cases(L.folded(v)))[0] == ["no_weight_in_title"]
    assert [one(spark, t, L.regulated_word(L.folded(v)))[0] for t in ("Pipetă antiparazitară", "Royal VD 2 kg", "avd", "dieta veterinară")] == ["antiparazitar", "vd", None, "dieta veterinara"]
    assert one(spark, "ab", L.parts_key(v, F.lit("c")))[0] == hashlib.sha256(b"ab\0c\0").hexdigest() != one(spark, "a", L.parts_key(v, F.lit("bc")))[0]
    assert one(spark, " 12 ", L.comparable(v, True), L.comparable(v))[:] == ("12", "12") and one(spark, " ", L.comparable(v))[0] is None and one(spark, "A b", L.comparable(v))[0] == "ab"
    assert one(spark, "x", L.public_name(v, {"x": "shop_a"}))[0] == "shop_a" and one(spark, "y", L.public_name(v, {"x": "shop_a"}))[0] == "shop_" + hashlib.sha256(b"y").hexdigest()[:4]


def test_revisions_whenever_they_arrive(spark):
    rows = [("p", 1, "m", False), ("p", 2, "n", True), ("p", 3, "n", False), ("p", 4, "s", True), ("q", 1, "m", False), ("q", 2, "n", False), ("r", 1, "m", None), ("s", 1, "m", False), ("s", 1, "m", False)]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "k string, at int, a string, review boolean")
        got = {tuple(r) for r in B.merge_revisions(d, "k", ["at"], "a", "review").collect()}
        assert got == {("p", "s", 2, 0), ("q", "n", 0, 1), ("r", "m", 0, 0), ("s", "m", 0, 0)}


def test_compatible_and_tallies(spark):
    a = spark.createDataFrame([(1, "x", "m"), (2, "x", "m"), (3, None, "m"), (4, "x", "m")], "k int, f string, l string")
    b = spark.createDataFrame([(1, "x", "m"), (2, "y", "m"), (3, None, "n"), (5, "x", "m")], "k int, f string, l string")
    assert {tuple(r) for r in B.compatible(a, b, "k", ["f"], "l").collect()} == {(1, "equal"), (2, "f"), (3, "changed"), (4, "missing_right"), (5, "missing_left")}
    d = spark.createDataFrame([("a", "a"), ("a", None), (None, "a"), ("a", "b"), (None, None)], "x_a string, x_b string")
    got = {r["field"]: tuple(r)[1:] for r in B.field_tallies(d, ["x"]).collect()}
    assert got["x"] == (3, 1, 1, 1, 1, 0.333333, 0.25) == got[None]
    assert B.field_tallies(d.limit(0), ["x"]).where("field IS NOT NULL").count() == 0
    rows = spark.createDataFrame([("t", True, True)] * 5 + [("t", True, False)] + [("u", True, True)], "g string, p boolean, a boolean")
    m = {r["g"]: (r["n_pos"], r["reportable"], r["prec"], r["false_positive_rate"]) for r in B.supported_metrics(spark.createDataFrame([("t",), ("u",), ("v",)], "g string"), rows, "g", F.col("p"), F.col("a"), 5).collect()}
    assert m == {"t": (5, True, 0.833333, 1.0), "u": (1, False, None, None), "v": (0, False, None, None)}


def test_cards_with_bad_data(spark):
    card = "<li data='{j}'><b>{p}</b></li>"
    html = card.format(j="{&quot;t&quot;: &quot;A &amp;amp; B&quot;, &quot;price&quot;: &quot;1234.50&quot;}", p="1.234,50 lei") + card.format(j='{"t": "C", "price": "5.00"}', p="6,00") + card.format(j="broken", p="1") + "<li><b>2</b></li>"
    d = spark.createDataFrame([("u", html), ("v", None), ("w", "")], "url string, html string")
    got = [(r["position"], r["t"], r["error"]) for r in pages.attribute_cards(d, r"<li.*?</li>", r"data='([^']*)'", {"t": "$.t", "price": "$.price"}, r"<b>([^<]*)</b>").orderBy("position").collect()]
    assert got == [(0, "A &amp; B", None), (1, "C", "price"), (2, None, "no data"), (3, None, "no data")]


def test_chains_of_references(spark):
    s = 'S={"p:1": {"s": "s:1"}, "s:1": {"c": "c:1"}, "c:1": {"n": 7}, "p:2": {"s": "s:9"}, "p:3": {}, "p:4": {"s": "s:2"}, "s:2": {"c": "p:4"}}</script>'
    nodes = pages.embedded_state(spark.createDataFrame([("u", s), ("v", None), ("w", "S=nothing</script>")], "url string, html string"), r"S=(\{.*\})</script>")
    got = {r["key"]: (r["found"] is not None, r["error"]) for r in pages.follow_all(nodes, ["$.s", "$.c"], "p:").collect()}
    assert got == {"p:1": (True, None), "p:2": (False, "dangling at step 1"), "p:3": (False, "no reference at step 1"), "p:4": (True, None)}


def test_unreadable_table_is_empty(spark, tmp_path):
    schema = "a int"
    (tmp_path / "bad.parquet").write_text("no parquet")
    assert pages.read_or_empty(spark, "file://" + str(tmp_path / "bad.parquet"), schema).count() == 0
    assert pages.read_or_empty(spark, "file://" + str(tmp_path / "none.parquet"), schema).count() == 0
    spark.range(3).selectExpr("cast(id as int) a").write.parquet(str(tmp_path / "t.parquet"))
    spark.range(3).coalesce(1).selectExpr("cast(id as int) a").write.parquet(str(tmp_path / "u.parquet"))
    assert pages.read_or_empty(spark, str(tmp_path / "t.parquet"), schema).count() == 3
    sizes = {r["name"]: r["bytes"] for r in pages.table_bytes(spark, str(tmp_path)).collect()}
    assert set(sizes) == {"bad", "t", "u"} and sizes["bad"] == 10 and sizes["t"] > sizes["u"] > 100


def test_first_days_and_strata(spark):
    d = spark.createDataFrame([("a", x % 4) for x in range(20)] + [("b", 1), (None, 1), ("a", None)], "k string, d int")
    got = sorted((r["k"], r["d"]) for r in S.first_days(d, ["k"], "d", 2).collect())
    assert got == [("a", 0)] * 5 + [("a", 1)] * 5 + [("b", 1)]
    t = spark.range(100).selectExpr("CASE WHEN id < 90 THEN 'x' WHEN id < 95 THEN 'y' END AS s", "id")
    n = {r["s"]: r["n"] for r in P.stratified(t, "s", "id", 0.1, 3).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert n == {"x": 9, "y": 3, None: 3} and P.stratified(t.limit(0), "s", "id", 0.1, 3).count() == 0
