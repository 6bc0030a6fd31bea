import random
from collections import defaultdict

from pyspark.sql import functions as F

from sparkmill.llm.splits import anneal, pair_nodes, split_components, split_name, with_components

H = [f"{i:016x}" + "0" * 48 for i in range(40)]


def labels(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, occurrence_id string, split string, left_content_hash string, right_content_hash string, component string")


def test_nodes_and_components(spark):
    rows = [
        (None, "o1", " Train ", H[1], H[2], "x"), (f" {H[3][:16].upper()}-{H[2][:16]}", "o2", "val", None, None, "x"),
        (f"{H[4][:16]}_{H[5][:16]}", "o3", None, H[4], None, "x"), (None, "o4", "test", H[6], None, "x"), (None, "o5", "odd", None, None, "x"), (None, "o1", " Train ", H[1], H[2], "x"),
    ]
    got = {r["occurrence_id"]: (r["component"], r["s"]) for r in with_components(pair_nodes(labels(spark, rows))).withColumn("s", split_name(F.col("split"))).collect()}
    assert {o: s for o, (_, s) in got.items()} == {"o1": "train", "o2": "validation", "o3": None, "o4": "test", "o5": None}
    of = {o: c for o, (c, _) in got.items()}
    assert of["o1"] == of["o2"] and len({of["o1"], of["o3"], of["o4"]}) == 3 and of["o5"] is None and None not in (of["o1"], of["o3"], of["o4"])
    assert with_components(pair_nodes(labels(spark, []))).count() == 0


def test_split_keeps_components_and_shares(spark):
    rng = random.Random(2)
    comps = [(f"c{i:04d}", rng.choice([1, 1, 2, 3, 9]), {rng.choice("ab"): 1}) for i in range(900)] + [("big", 700, {"a": 700})]
    df = spark.createDataFrame(comps, "component string, rows bigint, labels map<string,bigint>")
    got = {r["component"]: r["split"] for r in split_components(df).collect()}
    assert len(got) == 901
    size, total = defaultdict(int), sum(c[1] for c in comps)
    for c, n, _ in comps:
        size[got[c]] += n
    for name, share in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
        assert abs(size[name] / total - share) < 0.01
    assert split_components(df.limit(0)).count() == 0


def test_annealing_never_ends_worse():
    sizes, hists = [5, 3, 3, 2, 1, 1], [{"a": 5}, {"b": 3}, {"a": 3}, {"b": 2}, {}, {"a": 1}]
    first, _ = anneal(sizes, hists, [0] * 6, (0.7, 0.15, 0.15), 1, 0)
    best, at = anneal(sizes, hists, [0] * 6, (0.7, 0.15, 0.15), 1, 3000)
    assert best < first and len(at) == 6
    assert anneal([], [], [], (1.0,), 1, 10) == (0.0, [])


def deviations(comps, got):
    size, have = defaultdict(int), defaultdict(int)
    total, labels = sum(c[1] for c in comps), defaultdict(int)
    for c, n, h in comps:
        size[got[c]] += n
        for x, k in h.items():
            have[got[c], x] += k
            labels[x] += k
    share = {"train": 0.7, "validation": 0.15, "test": 0.15}
    return max(abs(size[n] / total - s) for n, s in share.items()), max(abs(have[n, x] / labels[x] - s) for n, s in share.items() for x in labels)


def test_giants_are_split_by_the_search_too(spark):
    """Three levels: giants among giants. Sizes and labels stay near their shares, those of the giants alone too."""
    rng = random.Random(7)
    comps = [(f"c{i:05d}", 1, {rng.choice("ab"): 1}) for i in range(3000)]
    comps += [(f"d{i:03d}", n, {rng.choice("ab"): n}) for i in range(150) for n in [rng.randint(40, 60)]]
    comps += [(f"e{i}", 600, {"a": 400, "b": 200}) for i in range(5)]
    df = spark.createDataFrame(comps, "component string, rows bigint, labels map<string,bigint>")
    got = {r["component"]: r["split"] for r in split_components(df, shard_components=60).collect()}
    assert len(got) == len(comps)
    size, label = deviations(comps, got)
    assert size < 0.01 and label < 0.06
    big = [c for c in comps if c[1] > 1]
    assert deviations(big, got)[0] < 0.08
    again = {r["component"]: r["split"] for r in split_components(df.repartition(7), shard_components=60).collect()}
    assert again == got
