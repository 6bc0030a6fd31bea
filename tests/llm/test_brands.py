import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkmill.llm.brands import BKTree, Matcher, levenshtein, match_values, with_swaps

REF = [(1, "Zudrikex", None), (2, "Zudrikex Pro", ["ZUDPRO"]), (3, "Dr. Bavlinos", ["D.B."]), (4, "Hono & Clutik", None), (5, "Manek's Munirt", None), (6, "Gredel Stupir Natura", None)]


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_metric(a, b):
    assert levenshtein(a, b) == plain(a, b) and with_swaps(a, b) <= plain(a, b)


def test_tree_returns_every_entry():
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(300)})
    tree = BKTree(keys)
    for _ in range(40):
        q = "".join(rng.choice("abcd") for _ in range(6))
        assert sorted(tree.search(q, 2)) == sorted((plain(q, k), k) for k in keys if plain(q, k) <= 2)
    assert BKTree().search("x", 3) == []


def test_readings():
    m = Matcher(REF)
    for value, want in {
        "zudrik3x": 1, "Zudrikex™": 1, "  ZUDRIKEX PR0 ": 2, "zudpro": 2, "d.b.": 3, "Z U D R I K E X": 1, "SC Zudrikex SRL": 1, "marca: Dr. Bavlinos": 3, "Dr.&nbsp;Bavlinos": 3, "D. Bavlions": 3, "Hono & Clutik / Hono & Clutik": 4,
        "Clutik, Hono &": 4, "MANEK&#X27;S&NBSP;MUNIRT": 5, "Mаnek's Munirt": 5, "Natura, Gredel Stupir": 6, "gredel stup…": 6, "Zudrikex (TM)": 1, "zudrike": 1, "manek's munirt - hrana uscata": 5,
        "diverse": None, "DIST-3796": None, "cod 00375": None, "n/a": None, "Trirax Brotisk": None, "x" * 5000: None,
    }.items():
        got = m.best(value)
        assert (got[1] if got else None) == want, value


def test_table(spark):
    v = spark.createDataFrame([("zudrik3x", 1.0), ("zudrik3x", 2.0), (None, 0.0), ("  ", 0.0), ("diverse", 0.0)], "value string, distance double")
    ref = spark.createDataFrame([(*r, "DE") for r in REF] + [(None, "Nobody", None, None), (9, None, None, None)], "brand_id int, brand_name string, aliases array<string>, country string")
    one = {r["value"]: r["entry"] for r in match_values(v, "value", ref, "brand_id", "brand_name", "aliases").collect()}
    many = {r["value"]: r["entry"] for r in match_values(v, "value", ref, "brand_id", "brand_name", "aliases", shard_entries=2).collect()}
    assert one == many == {"zudrik3x": 1, "diverse": -1}
    assert match_values(v.limit(0), "value", ref, "brand_id", "brand_name", "aliases").count() == 0
    assert {r["entry"] for r in match_values(v, "value", ref.limit(0), "brand_id", "brand_name", "aliases").collect()} == {-1}


def test_one_walk_finds_what_brute_force_finds():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé漢") for _ in range(rng.choice([1, 3, 5, 8, 12, 62, 63, 64, 70])))
    names = sorted({word() for _ in range(150)})
    asked = [rng.choice(names)[rng.randrange(2) :] + rng.choice(["", "x", "ab"]) for _ in range(200)] + [""]
    most = [rng.randrange(7) for _ in asked]
    got = BKTree(names).search_many(asked, most)
    assert [sorted(x) for x in got] == [sorted((d, n) for n in names if (d := levenshtein(a, n)) <= t) for a, t in zip(asked, most)]
    assert BKTree([]).search_many(["a"], [3]) == [[]] and BKTree(["a"]).search_many([], []) == []


def test_shards_give_what_one_tree_gives(spark):
    rng = random.Random(10)
    names = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 12))) for _ in range(300)})
    ref = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "i int, n string, a array<string>")
    values = spark.createDataFrame([(n[:k] + "x" + n[k + 1 :],) for n in names for k in (1, 3)] + [(None,), (" ",), ("zzzzzzzz",)], "v string")
    one, many = (sorted((r["v"], r["entry"], r["distance"] or 0.0) for r in match_values(values, "v", ref, "i", "n", "a", shard_entries=k).collect()) for k in (1000, 40))
    assert one == many and any(r[1] == -1 for r in one) and len(one) > 500
