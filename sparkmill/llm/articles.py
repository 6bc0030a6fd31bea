"""Listings that are one article (problem 1).

Titles are read into attributes and a name. Distinct names are blocked on their rarest word, met as it is or within
two edits, and, where words are joined or parted, on their letters; they are compared by
the inverse-frequency-weighted cosine of their character n-grams, vetoed where a word or the brand
differs by more than typing slips, and clustered into lines. Listings of one line with the same
species, age group, ingredient, content, number of units and bonus are one article; conflicting numbers or variants
keep them apart, an attribute that is left out doesn't.

Work is done on distinct names, so that a hot brand, line or exact copy costs no more than its different spellings. A word that
many names share blocks none of them that has a rarer one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.functions.titles import read_title
from sparkmill.llm.brands import with_swaps
from sparkmill.llm.names import both_ways, kept_keys, keyed_words, letter_sets, near_words, rarest, sought_keys, word_keys
from sparkmill.operators.graph import connected_components
from sparkmill.session import cut, spread, table

#: Length of the n-grams; the least cosine; edits by which two spellings of a line may differ in all.
GRAM, COSINE, EDITS = 3, 0.4, 2
#: What recorded life stages are called here.
_STAGE = {"puppy": "young", "kitten": "young", "junior": "young", "adult": "adult", "senior": "senior"}


def _orders(words: list[str]) -> list[str]:
    """The words joined in every order; in the given one where they are too many."""
    return ["".join(p) for p in itertools.permutations(words)] if len(words) <= 4 else ["".join(words)]


def word_edits(a: str, b: str) -> tuple[int, str, str]:
    """Edits between two names of words, and the two as they were compared: words are matched one to one where there are as many; else the names are joined in the order that fits best, which is an edit itself."""
    if a == b:
        return 0, a, b
    x, y = a.split(), b.split()
    if len(x) == len(y) <= 4:
        return min((sum(with_swaps(p, q) for p, q in zip(x, perm)), a, b) for perm in itertools.permutations(y))
    if len(x) == len(y):
        return with_swaps(a, b), a, b
    return min((1 + with_swaps(p, q), p, q) for p in _orders(x) for q in _orders(y))


def grams(name: str) -> list[str]:
    return [w[i : i + GRAM] for word in name.split() for w in (f" {word} ",) for i in range(len(w) - GRAM + 1)]


def line_of(words: list[str], line: list[str]) -> tuple[list[str], list[str]]:
    """The words of a title that are its line, given the line as recorded, and the others."""
    left, mine = list(words), []
    joined = "".join(line)
    if len(line) > 1:
        turned = "".join(reversed(line))
        for w in left:
            if abs(len(w) - len(joined)) <= 2 and (with_swaps(w, joined) <= 2 or with_swaps(w, turned) <= 2):
                return [w], [x for x in left if x != w]
    for x in line:
        # a word whose length differs by more is more than two edits away
        best = x if x in left else min((w for w in left if abs(len(w) - len(x)) <= 2), key=lambda w: with_swaps(w, x), default=None)
        if best is not None and with_swaps(best, x) <= min(2, max(len(x), len(best)) // 3):
            mine.append(best)
            left.remove(best)
    return mine, left


def read_listings(norm: DataFrame) -> DataFrame:
    """Attributes and words of every listing: what the title states, else what is recorded."""
    schema = "id int, species string, age string, ing string, w int, v int, n int, b int, stated boolean, line string, alias string, brand string, words array<string>"
    cols = ["id", "sample_title", "product_line", "net_weight_g", "net_volume_ml", "pack_count", "bonus_weight_g", "life_stage", "flavour", "species"]

    def num(x) -> int | None:
        return None if x is None or x != x else int(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for i, title, pl, nw, nv, pc, bo, stage, flav, spec in d[cols].itertuples(index=False):
                t = read_title(title if isinstance(title, str) else None)
                line = list(read_title(pl).name) if isinstance(pl, str) else []
                a = t.amount
                stated = a.weight_g is not None or a.volume_ml is not None
                nums = (a.weight_g, a.volume_ml, a.units or 1, a.bonus_g or 0) if stated else (num(nw), num(nv), num(pc) if a.units is None else a.units, num(bo))
                nums = tuple(x if x is None or x < 2**31 else None for x in nums)
                low = lambda x: x.lower() if isinstance(x, str) else None
                species = t.species or low(spec)
                words = list(t.name)
                if line:
                    mine, rest = line_of(words, line)
                    name, alias, brand, words = " ".join(sorted(line)), " ".join(sorted(mine)) or None, " ".join(sorted(rest)), None
                else:
                    name = alias = brand = None
                rows.append((i, species, t.age or _STAGE.get(low(stage) or ""), t.ingredient or low(flav), *nums, stated, name, alias, brand, words))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype="object")
            yield out.astype({"id": "int32", "w": "Int32", "v": "Int32", "n": "Int32", "b": "Int32", "stated": "bool"})

    return spread(norm.where("id IS NOT NULL").select(*cols), "id").mapInPandas(run, schema)


def settle_names(rows: DataFrame) -> DataFrame:
    """Line and brand of rows whose line is not recorded: words are line or brand by how often each of them is either in all other rows."""
    known = rows.where("line IS NOT NULL")
    as_line = known.select(F.explode(F.split("line", " ")).alias("word"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    as_brand = known.where("brand <> ''").select(F.explode(F.split("brand", " ")).alias("word"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    share = as_line.unionByName(as_brand).groupBy("word").agg((F.sum("l") / F.sum(F.col("l") + F.col("r"))).alias("share"))
    open_ = rows.where("line IS NULL AND size(words) > 0").select("id", F.explode("words").alias("word")).join(share, "word", "left")
    best = Window.partitionBy("id").orderBy(F.desc("s"), "word")
    ranked = open_.withColumn("s", F.coalesce("share", F.lit(0.6))).withColumn("k", F.row_number().over(best))
    is_line = (F.col("s") > 0.5) | (F.col("k") == 1) | ((F.col("k") == 2) & (F.col("s") > 0.25))
    join = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("word")))), " ")
    names = ranked.groupBy("id").agg(join(is_line).alias("line2"), join(~is_line).alias("brand2"))
    return rows.join(names, "id", "left").withColumns({"line": F.coalesce("line", "line2"), "brand": F.coalesce("brand", "brand2")}).drop("line2", "brand2", "words")


def read_lines(lines: DataFrame) -> DataFrame:
    """line, words, sets, letters: different words, letter sets, and all letters in order of the alphabet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = [(x, sorted(set(x.split())), letter_sets(x), "".join(sorted(x.replace(" ", "")))) for x in d["line"]]
            yield pd.DataFrame(rows, columns=["line", "words", "sets", "letters"])

    return lines.select("line").mapInPandas(run, "line string, words array<string>, sets array<bigint>, letters string")


def line_candidates(lines: DataFrame) -> DataFrame:
    """a, b: pairs a < b of different lines (of read_lines), among them all whose word_edits are at most EDITS.

    Words matched one to one differ by no more edits each, so the rarest word of a line is within these of one of the other's words. Joined and parted words
    leave one edit to the letters, so the lines share a letter set.
    """
    each = lines.select("line", "letters", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    keyed = cut(keyed_words(counts))
    near = near_words(sought_keys(keyed), kept_keys(keyed))
    rare = rarest(each.select("line", "letters", "word").withColumn("line", F.struct("line", "letters")), counts, "line", 1)
    probes = rare.select("line", "word").unionByName(rare.join(near, "word").select("line", F.col("other").alias("word")))
    probes = probes.select(F.col("line.line").alias("p"), F.col("line.letters").alias("pl"), "word")
    met = probes.join(each, "word").where((F.col("p") != F.col("line")) & (F.levenshtein("pl", "letters", 2 * EDITS) >= 0)).select(F.col("p").alias("x"), F.col("line").alias("y"))
    sets = lines.select("line", F.size("words").alias("m"), F.explode("sets").alias("s"))
    x, y = sets.alias("x"), sets.alias("y")
    joined = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.m") < F.col("y.m"))).select(F.col("x.line").alias("x"), F.col("y.line").alias("y"))
    return met.unionByName(joined).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_lines(lines: DataFrame) -> DataFrame:
    """a, b: pairs a < b of different spellings of a line."""
    lines = lines.select("line").where("line <> ''").distinct()
    words = F.split("line", " ")
    pairs = line_candidates(cut(read_lines(lines)))
    grammed = lines.select("line", F.explode(words).alias("w")).select("line", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    grammed = grammed.select("line", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - GRAM + 1), lambda i: F.substring("w", i, F.lit(GRAM)))).alias("g")).distinct()
    # at most 38^3 n-grams of letters, digits and blank: bounded, whatever the data
    df = {r["g"]: r["n"] for r in grammed.groupBy("g").agg(F.count("*").alias("n")).collect()}
    total = max(1, lines.count())
    sent = lines.sparkSession.sparkContext.broadcast({g: 1 + math.log((1 + total) / (1 + n)) for g, n in df.items()})

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        idf, norms, unseen = sent.value, {}, 1 + math.log(1 + total)

        def vector(s: str) -> tuple[dict, float]:
            if s not in norms:
                v: dict = {}
                for g in grams(s):
                    v[g] = v.get(g, 0.0) + idf.get(g, unseen)
                norms[s] = (v, math.sqrt(sum(c * c for c in v.values())) or 1.0)
            return norms[s]

        out = []
        for p, q in zip(a, b):
            edits, p, q = word_edits(p, q)
            if edits > EDITS:  # the veto
                out.append(False)
                continue
            (u, m), (v, n) = vector(p), vector(q)
            out.append(sum(c * v.get(g, 0.0) for g, c in u.items()) / (m * n) >= COSINE)
        return pd.Series(out)

    return pairs.where(alike("a", "b"))


def _brands_agree(x: str, y: str) -> Column:
    return (F.col(x) == F.col(y)) | ((F.length(x) >= 5) & (F.levenshtein(x, y, 2) >= 0)) | (F.levenshtein(F.replace(F.col(x), F.lit(" "), F.lit("")), F.replace(F.col(y), F.lit(" "), F.lit("")), 1) >= 0)


def similar_brands(brands: DataFrame) -> DataFrame:
    """p, q: different brands that agree, both ways, and each with itself. Blocked on what is left without two letters or fewer, however parted into words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame([(x, *word_keys(x), word_keys(x.replace(" ", ""))[0], word_keys(x.replace(" ", ""))[1]) for x in d["brand"]], columns=["brand", "k1", "s1", "k2", "s2"])

    keyed = brands.select("brand").mapInPandas(run, "brand string, k1 array<string>, s1 array<string>, k2 array<string>, s2 array<string>")
    kept = keyed.select(F.col("brand").alias("q"), F.explode(F.array_union("k1", "k2")).alias("key"))
    sought = keyed.select(F.col("brand").alias("p"), F.explode(F.array_union("s1", "s2")).alias("key"))
    pairs = sought.join(kept, "key").where("p < q").select("p", "q").distinct().where(_brands_agree("p", "q"))
    return both_ways(pairs, "p", "q", "p", "q").unionByName(brands.select(F.col("brand").alias("p"), F.col("brand").alias("q")))


def line_clusters(rows: DataFrame) -> DataFrame:
    """line, brand, cluster: every distinct name and its cluster. A name without a brand joins the best supported cluster that has its line."""
    names = rows.groupBy("line", "brand").agg(F.count("*").alias("support"))
    other = rows.where("alias IS NOT NULL AND alias <> line").groupBy(F.col("alias").alias("line"), "brand").agg(F.lit(0).cast("long").alias("support"))
    names = names.unionByName(other).groupBy("line", "brand").agg(F.sum("support").alias("support")).where("line <> ''")
    names = cut(names.withColumn("name", F.concat_ws("|", "line", "brand")))
    links = similar_lines(names)
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(names.select(F.col("line").alias("a"), F.col("line").alias("b")).distinct()))
    # brands that agree are found once among the different ones, so that a line of many brands doesn't pair them all
    brands = names.where("brand <> ''").select("brand").distinct()
    agree = cut(similar_brands(brands))
    x = names.select(F.col("line").alias("a"), F.col("brand").alias("p"), F.xxhash64("name").alias("na"))
    y = names.select(F.col("line").alias("b"), F.col("brand").alias("q"), F.xxhash64("name").alias("nb"), F.col("support").alias("sb"))
    near = cut(x.join(links, "a"))
    full = near.where("p <> ''").join(agree, "p").join(y, ["b", "q"]).where("na <> nb")
    bare = near.where("p = ''").join(y.where("q = ''"), "b").where("na <> nb")
    links = full.select("na", "nb").unionByName(bare.select("na", "nb"))
    alone = names.select(F.xxhash64("name").alias("na"), F.xxhash64("name").alias("nb"))
    comps = cut(connected_components(cut(links.unionByName(alone)), "na", "nb"))
    # a name without brand: its component goes to the branded component that supports its line best
    reach = near.where("p = ''").join(y.where("q <> ''"), "b").select(F.col("na").alias("node"), F.col("nb").alias("other"), "sb")
    support = reach.join(comps, "node").withColumnRenamed("component", "c0").join(comps.select(F.col("node").alias("other"), F.col("component").alias("c1")), "other")
    goes = support.groupBy("c0", "c1").agg(F.sum("sb").alias("s")).groupBy("c0").agg(F.max_by("c1", F.struct("s", "c1")).alias("c1"))
    done = comps.join(goes, comps["component"] == goes["c0"], "left").select(F.col("node").alias("id"), F.coalesce("c1", "component").alias("cluster"))
    return names.withColumn("id", F.xxhash64("name")).join(done, "id").select("line", "brand", "cluster")


def articles(norm: DataFrame) -> DataFrame:
    """id, article (a struct) of every listing that can be told; listings with the same article are one.

    A listing that leaves its content out joins the only article of its line
    and variant that fits what is recorded, or of those the one with a single unit and no bonus; where several fit, or none of its
    line can be told (null or empty title and line), it has no row. Repeated ids are one listing.
    """
    rows = cut(settle_names(cut(read_listings(norm))))
    clusters = cut(line_clusters(rows.where("line IS NOT NULL")))
    rows = rows.join(clusters, ["line", "brand"])
    only = rows.where("species IS NOT NULL").groupBy("cluster", "species").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("species", F.struct("k", "species")).alias("usual"))
    rows = rows.join(only, "cluster", "left").withColumn("species", F.coalesce("species", "usual", F.lit("?")))
    rows = cut(rows.select("id", "cluster", "species", F.coalesce("age", F.lit("?")).alias("age"), F.coalesce("ing", F.lit("?")).alias("ing"), "w", "v", "n", "b", "stated"))
    kind = ["cluster", "species", "age", "ing"]
    numbers = [F.coalesce("w", F.lit(-1)).alias("w"), F.coalesce("v", F.lit(-1)).alias("v"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("b", F.lit(0)).alias("b")]
    told = rows.where("stated").select("id", *kind, *numbers)
    loose = rows.where("NOT stated")
    choice = told.select(*kind, "w", "v", "n", "b").distinct()
    fits = loose.select("id", *kind, F.col("w").alias("w0"), F.col("v").alias("v0"), F.col("n").alias("n0"), F.col("b").alias("b0")).join(choice, kind)
    fits = fits.where("(w0 IS NULL OR w0 = w) AND (v0 IS NULL OR v0 = v) AND (n0 IS NULL OR n0 = n) AND (b0 IS NULL OR b0 = b)")
    plain = (F.col("n") == 1) & (F.col("b") == 0)
    pick = fits.groupBy("id", *kind).agg(F.count("*").alias("all"), F.count_if(plain).alias("plain"), F.min_by(F.struct("w", "v", "n", "b"), F.struct((~plain).cast("int"), "n", "b", "w", "v")).alias("k"))
    # of several, the plain one only where the content is recorded
    sure = pick.join(loose.select("id", (F.col("w").isNotNull() | F.col("v").isNotNull()).alias("content")), "id").where("all = 1 OR (plain = 1 AND content)")
    joined = sure.select("id", *kind, "k.w", "k.v", "k.n", "k.b")
    alone = loose.where("w IS NOT NULL OR v IS NOT NULL").join(pick.select("id"), "id", "left_anti").select("id", *kind, *numbers)
    return told.unionByName(joined).unionByName(alone).select("id", F.struct(*kind, "w", "v", "n", "b").alias("article")).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of listings that are the same article."""
    a = cut(articles(table(spark, sf_dir, "norm_listings")))
    x, y = a.select(F.col("id").alias("id_a"), "article"), a.select(F.col("id").alias("id_b"), "article")
    return x.join(y, "article").where("id_a < id_b").select("id_a", "id_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, group_id, group_size: every listing with the least id of its article."""
    a = articles(table(spark, sf_dir, "norm_listings"))
    g = a.groupBy("article").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return a.join(g, "article").select("id", "group_id", "group_size")
