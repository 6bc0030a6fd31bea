from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkmill.functions.quantity import one_edit, read_amount
from sparkmill.functions.titles import read_title
from sparkmill.functions.units import convert, half_up, parse_number, parse_unit
from sparkmill.operators.units_normalize import canonical_quantity, disagreeing, norm_cases, stated_amount, variant_cases


@pytest.mark.parametrize(
    "title, want",
    [
        ("Hrana caini 10kg", (10000, None, None, None)),
        ("1,24 kilograme", (1240, None, None, None)),
        ("12.000 grame", (12000, None, None, None)),
        ("13.608 kg", (13608, None, None, None)),
        ("11 pounds", (4990, None, None, None)),
        ("13.2 ounces", (374, None, None, None)),
        ("4fl oz", (None, 118, None, None)),
        ("8 fl. oz. TRANSPORT GRATUIT", (None, 237, None, None)),
        ("0,33 litri", (None, 330, None, None)),
        ("25 cl", (None, 250, None, None)),
        ("80dag", (800, None, None, None)),
        ("24 × 85 grame", (85, None, 24, None)),
        ("0,085 kg x 24buc", (85, None, 24, None)),
        ("set 4 bucăți, 800 g", (800, None, 4, None)),
        ("(12 buc.) 79 gr", (79, None, 12, None)),
        ("4 plicuri x 0,07 Kg gust de miel", (70, None, 4, None)),
        ("0.4 kg GRATUIT la 3 kilograme", (3000, None, None, 400)),
        ("4+0,5 kg", (4000, None, None, 500)),
        ("2KG plus ½ kg gratis, pt. talie 10 - 20kg", (2000, None, None, 500)),
        ("15-kg (+1/2 kg bonus) sac 48 x 49 cm", (15000, None, None, 500)),
        ("TRANSPORT GRATUIT 12 kg", (12000, None, None, None)),
        ("13,608KG TRANSPORT GRATUIT (caini 5-20 kg)", (13608, None, None, None)),
        ("Senior sac 25 x 24 cm | Livrare 24h", (None, None, None, None)),
        ("2 kile", (2000, None, None, None)),
        ("3 kilo caini", (3000, None, None, None)),
        ("20 deca", (200, None, None, None)),
        ("0,5 tone", (500000, None, None, None)),
        ("1 1/2 kg", (1500, None, None, None)),
        ("12 x 1 1/2 kg", (1500, None, 12, None)),
        ("Taurina 250mg, 100 g", (100, None, None, None)),
        ("5000 mg", (5, None, None, None)),
        ("250 mg", (None, None, None, None)),
        ("9" * 5000 + " kg, 2 kg", (2000, None, None, None)),
        ("40 xilograme", (40000, None, None, None)),
        (None, (None, None, None, None)),
        ("", (None, None, None, None)),
        ("x" * 200_000, (None, None, None, None)),
    ],
)
def test_amounts(title, want):
    assert tuple(read_amount(title)[:4]) == want


def test_units():
    assert parse_unit("kg/m^3").dim == (1, -3, 0, 0)
    assert parse_unit("fl. oz.").scale == Fraction("29.5735295625")
    assert parse_unit("bag") is None and parse_unit("") is None
    assert convert("2", "lb", "g") == Fraction("907.18474")
    assert convert("100", "c", "f") == 212
    assert convert("1", "kg", "ml") is None
    assert parse_number("1.234,5") == Fraction("1234.5") and parse_number("2½") == Fraction(5, 2) and parse_number("0.500", True) == Fraction(1, 2)
    assert half_up(Fraction(5, 2)) == 3 and one_edit("ounces", "onuces") and not one_edit("grame", "rama")


def test_titles():
    t = read_title("VIVIR DRONAND® - pisoi - gust de curcan - hrana uscata - ClazortPezs, 4 plicuri x 0,07 Kg | Promo")
    assert (t.species, t.age, t.ingredient, t.form, t.name) == ("cat", "young", "turkey", "dry", ("vivir", "dronand", "clazort", "pezs"))
    assert read_title(None).name == () and read_title("  ").age is None


def test_cases(spark):
    norm = spark.createDataFrame(
        [(1, "Hrana 2 kg", 2000, None, None, 5), (2, "Hrana 2 kg", 2, None, None, 5), (2, "Hrana 2 kg", 2, None, None, 5), (3, "Hrana", 7, None, None, 5), (4, None, None, None, None, 5), (5, "Ulei 100 ml", 100, None, None, 5), (6, "3 kg + 300 g gratis", 3000, None, None, 5)],
        "id int, sample_title string, net_weight_g int, net_volume_ml int, bonus_weight_g int, weight_g int",
    )
    got = {tuple(r)[1:] for r in norm_cases(norm).collect()}
    assert got == {(2, 2000, -1, -1), (5, -1, 100, -1), (6, 3000, -1, 300)}
    assert norm_cases(norm.limit(0)).count() == 0
    clash = disagreeing(norm, stated_amount("sample_title"), {"weight_g": F.col("net_weight_g")})
    assert clash.columns.count("weight_g") == 1
    v = spark.createDataFrame([("Hrana 5 kg", [(1, "Standard", 5), (2, "Sac 400 g", 400), (3, None, None), (None, "1 kg", 1)]), ("Ulei 1 l", [(4, "", 1000)]), (None, None)], "title string, variants array<struct<id:bigint,title:string,grams:int>>")
    assert {tuple(r)[1:3] for r in variant_cases(v).collect()} == {(1, 5000), (3, 5000)}


def test_canonical(spark):
    d = spark.createDataFrame([("2,5", "kg"), ("x", "kg"), ("1", "bag"), (None, None), ("12.500", "g")], "v string, u string")
    assert [tuple(r) for r in d.select(canonical_quantity("v", "u").alias("q")).select("q.*").collect()] == [("2500", "1,0,0,0"), (None, None), (None, None), (None, None), ("12500", "1,0,0,0")]
