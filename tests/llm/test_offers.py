import numpy as np
import pytest

from sparkmill.llm import offers
from sparkmill.llm.offers import LETTERS_APART, LETTER_BITS, TRIGRAMS_APART, OfferIndex, deduplicate, read_names, read_offer, same_words, vector
from sparkmill.llm.names import letter_sets, word_keys
from sparkmill.session import cut

SCHEMA = "offer_id int, batch_no int, title string, description string, content_hash string, name string"
T = "Conserva pt. pisici Vohind Ginund Stekutam Jestos Adult bogat in curcan 156 grame"
D = "Stekutam Jestos by Vohind Ginund brings curcan to the bowl every day, made pentru pisici adult."


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted((r["first_id"], r["offer_id"]) for r in deduplicate(df, OfferIndex(spark), **kw).collect())


def test_repeats_over_batches(spark):
    rows = [
        (1, 1, T, D, "h1"), (2, 1, T.upper() + " | Promo", D, None), (3, 2, T.replace("Vohind", "Voihnd"), None, None), (4, 2, T.replace("156", "185"), D, None), (5, 3, T.replace("curcan", "ton"), D, None),
        (6, 3, T.replace("156 grame", "4 x 156 grame"), D, None), (7, 3, T.replace("Adult", "Adlut"), D, None), (8, 4, "TRANSPORT GRATUIT " + T.replace(" 156 grame", ", grame 156"), D, None), (9, 4, T.replace("Stekutam Jestos", "Flokosk Skasurart"), D, None),
        (10, 5, T.replace("156", "185") + " NOU!", None, None), (11, 5, None, None, None), (12, 6, None, None, None), (13, 6, None, D, "h9"), (14, None, "", None, "h9"), (15, 2, "x " * 20_000, None, None),
    ]
    want = [(1, 2), (1, 3), (1, 7), (1, 8), (4, 10), (13, 14)]
    assert found(spark, rows, round_offers=1) == want
    assert found(spark, rows, round_offers=100) == want


def test_rounds():
    assert offers.rounds({3: 5, 1: 5, 2: 1, 4: 20, 5: 1}, 6) == [[1, 2], [3, 4], [5]]
    assert offers.rounds({1: 9, 2: 9}, 6) == [[1], [2]] and offers.rounds({}, 6) == []


def test_empty(spark):
    assert found(spark, []) == []


def slipped(word, rng):
    i = int(rng.integers(max(1, len(word) - 1)))
    return [word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :], word[:i] + "q" + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + "z" + word[i:]][int(rng.integers(4))]


def slipped_names(rng):
    """Names with up to four slips in random words, words joined, parted and added; one-word names and very long words among them."""
    names = {"gold", "gold pezis", "pezis", "ab", "abcdefghijk", "abcdef ghijk", "abcd efghijk", "", "vohind x9", "#ab", "#ac", "pezisor", "pezsor", "x" * 300, "x" * 298 + "y", "ab" * 9}
    for base in ["ginund jestos stekutam vohind", "bavlinos fudrus vubram", "clutik guces", "vohindaru", "hono ruvlix zetra", "abracadabrantesque" * 2 + " hono", "gold vet natura pro select"]:
        for _ in range(40):
            words = base.split()
            for _ in range(int(rng.integers(1, 5))):
                k = int(rng.integers(len(words)))
                words[k] = slipped(words[k], rng)
            if rng.random() < 0.2 and len(words) > 1:
                words[:2] = ["".join(words[:2])]
            if rng.random() < 0.1 and len(words[0]) > 4:
                words[:1] = [words[0][:3], words[0][3:]]
            if rng.random() < 0.1:
                words.append("15kg")
            names.add(" ".join(sorted(w for w in words if w)))
    return sorted(names)


def test_bounds_hold():
    names = slipped_names(np.random.default_rng(1))
    alike = [(a, b) for a in names for b in names if a < b and same_words(a, b)]
    assert len(alike) > 500 and all(same_words(b, a) for a, b in alike)
    for a, b in alike:
        d = vector(a) != vector(b)
        assert d[:LETTER_BITS].sum() <= LETTERS_APART and d[LETTER_BITS:].sum() <= TRIGRAMS_APART
    assert not same_words("ginund jestos stekutam vohind", "bavlinos fudrus vubram") and not same_words("#ab", "#ac") and not same_words("", "ab")


def test_words_within_two_edits_share_a_key():
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefgh"))
    for n in list(range(1, 24)) + [40, 200]:
        for _ in range(60):
            w = "".join(rng.choice(letters, n))
            v = slipped(slipped(w, rng), rng)
            assert set(word_keys(w)[0]) & set(word_keys(v)[1]) and set(word_keys(v)[0]) & set(word_keys(w)[1]), (w, v)
            assert set(letter_sets(w)) & set(letter_sets(slipped(w, rng)))
    assert len(word_keys("x" * 5000)[1]) < 200


def test_reading():
    name, age, ing, a, _ = read_offer(T.replace("curcan", "crucan"), D)
    assert (age, ing, a.weight_g) == ("adult", "turkey", 156) and "stekutam" in name
    assert read_offer(None, None)[0] == ""


def linked(spark, index, names):
    """The links that the index finds when names come as a batch of their own."""
    folder = f"b{len(index.state['tables']['names'])}"
    read = cut(read_names(spark.createDataFrame([(n,) for n in names], "name string")))
    index._write(read.select("name"), "names", folder)
    near = cut(index._search(read, *index._learn_words(read, folder), folder))
    index._write(near, "links", folder)
    for t in ("names", "links", "words", "near_words", "forms", "cells", "sets"):
        index.state["tables"][t].append([folder, 0])
    return {(r["q"], r["name"]) for r in near.collect()}


@pytest.mark.parametrize("seed, parts", [(2, 1), (3, 3)])
def test_cells_hold_what_brute_force_finds(spark, seed, parts):
    rng = np.random.default_rng(seed)
    names = [str(n) for n in rng.permutation(slipped_names(rng))]
    index = OfferIndex(spark)
    got = set()
    for k in range(parts):
        got |= linked(spark, index, names[k::parts])
    want = {(a, b) for a in names for b in names if a != b and same_words(a, b)}
    assert len(want) > 1000
    assert got | {(b, a) for a, b in got} == want


def test_hot_words_are_left_alone(spark):
    """Names that share a word with all others are found without meeting them: only cells of rare words are probed."""
    rng = np.random.default_rng(5)
    names = sorted({f"hono {''.join(rng.choice(list('abcdefghijklmnop'), 9))} clutik" for _ in range(3000)})
    index = OfferIndex(spark)
    read = cut(read_names(spark.createDataFrame([(" ".join(sorted(n.split())),) for n in names], "name string")))
    counts, near = index._learn_words(read, "b0")
    assert index._search(read, counts, near, "b0").count() <= 10


def test_opened_again(spark, tmp_path):
    path = "file://" + str(tmp_path / "index")
    rows = [(1, 1, T, D, "h1"), (2, 1, T.replace("Stekutam Jestos", "Flokosk Skasurart"), D, None)]
    more = [(3, 2, T.replace("Vohind", "Voihnd"), None, None), (4, 2, T.replace("156", "185"), D, None)]
    frame = lambda r: spark.createDataFrame([(*x, "x") for x in r], SCHEMA)
    pairs = lambda d: sorted((r["first_id"], r["offer_id"]) for r in d.collect())
    assert pairs(OfferIndex(spark, path, cells=256).add(frame(rows))) == []
    again = OfferIndex(spark, path)
    assert again.state["batches"] == 1 and again.state["cells"] == 256
    assert pairs(again.add(frame(more))) == [(1, 3)]
    assert pairs(OfferIndex(spark, path).add(frame(more))) == [(1, 3)]  # given again
    third = OfferIndex(spark, path)
    assert third.kinds().count() == 4 and pairs(third.add(frame([(9, 3, T, D, None)]))) == [(1, 9)]


def test_a_small_batch_reads_few_cells(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 8))
    index = OfferIndex(spark, cells=256)
    linked(spark, index, [f"{word()} {word()} {word()}" for _ in range(500)])
    linked(spark, index, ["abcdabcd efghefgh ijklijkl"])
    assert index.cells_read["cells"] <= 20 and index.cells_read["forms"] <= 128


def test_folders_are_merged(spark):
    index = OfferIndex(spark)
    rows = [(i, i, T if i % 3 else T.replace("156", "185"), D, None) for i in range(1, offers.FAN_IN + 3)]
    frame = lambda r: spark.createDataFrame([(*x, "x") for x in r], SCHEMA)
    got = {(r["first_id"], r["offer_id"]) for x in rows for r in index.add(frame([x])).collect()}
    assert got == {(3 if i % 3 == 0 else 1, i) for i in range(1, offers.FAN_IN + 3) if i not in (1, 3)}
    assert all(len(f) == 3 for f in index.state["tables"].values()) and index.kinds().count() == 2
    index.vacuum()
    assert OfferIndex(spark, index.path).kinds().count() == 2


def test_any_grouping_of_batches_gives_the_same_rows(spark):
    cut_off = T[: T.index(" 156")]
    other = "Hrana umeda pisici Vohind Ginund Jestos Stekutam curcan adult 156 g"
    rows = [(1, 1, cut_off, D, None), (2, 2, T, D, None), (3, 3, other, D, None), (4, 4, other + " NOU!", D, None), (5, 5, T, D, None), (6, 5, other, D, None)]
    got = [found(spark, rows, round_offers=k) for k in (1, 2, 100)]
    assert got[0] == [(1, k) for k in range(2, 7)] and all(g == got[0] for g in got)
