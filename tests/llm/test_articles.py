import itertools
import random

from pyspark.sql import functions as F

from sparkmill.llm.articles import EDITS, _brands_agree, articles, line_candidates, read_lines, similar_brands, similar_lines, word_edits

SCHEMA = "id int, sample_title string, product_line string, net_weight_g int, net_volume_ml int, pack_count int, bonus_weight_g int, life_stage string, flavour string, species string, article string"


def groups(spark, rows):
    got = {}
    for r in articles(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["article"], set()).add(r["id"])
    return sorted(map(sorted, got.values()))


def test_same_article(spark):
    rows = [
        (1, "Hrana uscata caini VIVIR DRONAND Clazort Pezis Junior cu miel 3 kg", "Clazort Pezis Lamb", 3000, None, None, None, "Puppy", "Lamb", "dog", ""),
        (2, "gust de miel - catelusi - Pezis Clazort - Vivir Dronand - 3.000 grame", "Pezis Clazort", 3, None, None, None, None, None, "dog", ""),
        (3, "Clazort Pezs Puppy Lamb 3kg dog TRANSPORT GRATUIT", None, None, None, None, None, None, None, None, ""),  # no brand, a slip
        (4, "VIVIR DRONAND ClazortPezis Puppy Lamb dog 3 kg + 300 g gratis", "Clazort Pezis", 3000, None, None, 300, None, None, "dog", ""),  # a bonus
        (5, "Vivir Dronand Clazort Pezis Adult Lamb dog 3 kg", "Clazort Pezis", 3000, None, None, None, None, None, "dog", ""),  # another age
        (6, "Vivir Dronand Clazort Pezis Junior Miel caini", "Clazort Pezis", 3000, None, None, None, None, None, "dog", ""),  # amount left out
        (7, "Vivir Dronand Clazort Vlebrum Junior Miel caini 3 kg", "Clazort Vlebrum", 3000, None, None, None, None, None, "dog", ""),  # another line
        (8, None, None, None, None, None, None, None, None, None, ""), (9, "", "", None, None, None, None, None, None, None, ""),
        (1, "Hrana uscata caini VIVIR DRONAND Clazort Pezis Junior cu miel 3 kg", "Clazort Pezis Lamb", 3000, None, None, None, "Puppy", "Lamb", "dog", ""),
        (10, "Vivir Dronand Clazort Pezis Junior Miel caini 4 x 3 kg " + "z" * 50_000, "Clazort Pezis", 3000, None, 4, None, None, None, "dog", ""),
    ]
    got = groups(spark, rows)
    assert [1, 2, 3, 6] in got and [4] in got and [5] in got and [7] in got and not any(8 in g or 9 in g for g in got)


def test_empty(spark):
    assert groups(spark, []) == []


def test_lines(spark):
    names = ["clazort pezis", "clazort pezs", "clazortpezis", "pezis clazort", "clazort vlebrum", "trafur gritro", "trafur piskita"]
    got = {(r["a"], r["b"]) for r in similar_lines(spark.createDataFrame([(" ".join(sorted(n.split())),) for n in names], "line string")).collect()}
    assert got == {("clazort pezis", "clazort pezs"), ("clazort pezis", "clazortpezis"), ("clazort pezs", "clazortpezis")}
    assert word_edits("a bcd", "bcd a")[0] == 0 and word_edits("ab cd", "cdab")[0] == word_edits("cdab", "ab cd")[0] == 1 and word_edits("clazort pezis", "clazort pezs")[0] == 1


def test_candidates_hold_what_brute_force_finds(spark):
    """Slips in one, two or no other words, words joined and parted, words that every line shares."""
    rng = random.Random(4)
    lines = {"pezisor", "pezsor", "duo naturalissimo", "dou naturalissimo", "gold naturalissimo", "glod naturalissimo", "naturalissimo x y", "naturalissimo xy", "a b c d e f", "a b c d ef", "z" * 400, "z" * 399}
    for base in ["clazort pezis", "naturalissimo gold", "brekart naturalissimo", "vlebrum", "trafur gritro senti", "hypercalifragilistic duo"]:
        for _ in range(40):
            words = base.split()
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(words))
                w = words[k]
                i = rng.randrange(max(1, len(w) - 1))
                words[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]]) or "q"
            if rng.random() < 0.3:
                words = ["".join(words)]
            lines.add(" ".join(sorted(words)))
    lines |= {f"naturalissimo {''.join(w)}fum" for w in itertools.product("bdkt", "aeou", "lmnrs")}
    lines = sorted(lines)
    want = {(a, b) for a, b in itertools.combinations(lines, 2) if word_edits(a, b)[0] <= EDITS}
    got = {(r["a"], r["b"]) for r in line_candidates(read_lines(spark.createDataFrame([(x,) for x in lines], "line string"))).collect()}
    assert len(want) > 500 and want <= got and len(got) < 0.5 * len(lines) ** 2 / 2
    assert {("pezisor", "pezsor"), ("dou naturalissimo", "duo naturalissimo"), ("naturalissimo x y", "naturalissimo xy")} <= got


def test_brands_hold_what_brute_force_finds(spark):
    rng = random.Random(5)
    brands = {"vivir dronand", "vivirdronand", "vivir drnand", "hono clutik", "honoclutik", "drbavlinos", "dr bavlinos", "ab", "abc", "abcd", "y" * 100, "y" * 98}
    for base in ["vivir dronand", "zudrikex pro", "gredel stupir natura"]:
        for _ in range(30):
            b = list(base)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(b))
                b[i : i + 1] = rng.choice([[], ["q"], [b[i], "q"], [" "]])
            brands.add("".join(b).strip())
    df = spark.createDataFrame([(b,) for b in sorted(brands)], "brand string")
    got = {(r["p"], r["q"]) for r in similar_brands(df).collect()}
    every = df.select(F.col("brand").alias("p")).crossJoin(df.select(F.col("brand").alias("q"))).where("p < q").where(_brands_agree("p", "q"))
    want = {(r["p"], r["q"]) for r in every.collect()}
    assert len(want) > 200 and {x for x in got if x[0] < x[1]} == want and all((q, p) in got for p, q in got) and {(b, b) for b in brands} <= got
