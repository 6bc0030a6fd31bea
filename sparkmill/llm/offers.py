"""New batches against everything accepted (problem 6), by a persisted inverted file of vector cells.

An offer's name (the words of its title that are no attribute, amount or advertisement) is a vector of bits: its letters with
their counts, and its hashed character trigrams. The index holds the names, with their full vectors, in cells: one for
each of a name's words and one for each of its letter sets (all letters, and all but one of each). A query probes the cells of its rarest word and of all words
within two edits of that, then the next rarest word's own cell and those of its letter sets. A name outside these differs by
three edits or more in one word, by more than one short word, and by two letters or more where words are joined or parted, so no nearer match
is possible and the search ends: cells of common words are left alone. In the cells, names whose vectors differ in more bits
than the allowed edits can change are dropped; the others are compared exactly: the words may differ by typing slips only, and age
group, ingredient, content, units and bonus must agree. What is new is appended to the cells; history is not processed again.
Every kind is kept with the first of its chain, also a repeat, so that the rows don't depend on how batches are grouped.

The index lies in a folder that all executors share and is opened again by its path. A manifest, written last, names the
folders that count; a batch that broke off leaves none. Cells lie in files by number, and a batch reads only the files of the cells that it probes.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sparkmill.functions import titles
from sparkmill.functions.quantity import Amount, fold, read_amount
from sparkmill.functions.titles import read_title
from sparkmill.llm.brands import levenshtein, with_swaps
from sparkmill.llm.names import both_ways, kept_keys, keyed_words, letter_sets, near_words, rarest, sought_keys
from sparkmill.session import cut, scratch_path, spread, table

#: Bits of a vector: letters (26 and two for all else) by counts up to COUNTS, filled up to whole words of 64, then trigrams.
LETTERS, COUNTS, LETTER_BITS, DIMENSIONS = 28, 4, 128, 256
VECTOR = [f"v{i}" for i in range((LETTER_BITS + DIMENSIONS) // 64)]
#: Most bits in which names differ that same_words accepts. Letters: a substitution changes two, and there are three edits; a word of five stands alone.
#: Trigrams: a swap changes four on either side; of words joined or parted one edit, and two on either side of four borders.
LETTERS_APART, TRIGRAMS_APART = 3 * 2, 2 * 8 + 4 * 4
#: Offers that a round of waiting batches holds at least, where there are so many.
ROUND_OFFERS = 40_000
#: Offers that a task reads, at most, on average.
TASK_OFFERS = 20_000
#: Files of the cells in a folder of the index; folders of one size that are merged into one.
CELLS, FAN_IN = 8, 4

_VOCABULARY = sorted(
    {w for words in (titles.AGE, titles.INGREDIENT, titles.SPECIES, titles.SIZE, titles.FORM, titles.ADVERTS, titles.LINKS) for phrase in words for w in re.findall(r"[a-z]{4,}", phrase)}
    | {"grame", "kilograme", "bucati", "plicuri", "gratuit", "gratis", "bonus", "cadou", "separat"}
)

#: Words of the vocabulary that a moved neighbour leaves over.
_PARTS = frozenset(_VOCABULARY) | {"dry", "wet", "cat", "dog", "set", "oil"}


@lru_cache(maxsize=1)
def _slips() -> dict[str, str]:
    """Every word one slip away from a word of the vocabulary of five letters or more."""
    letters, out = "abcdefghijklmnopqrstuvwxyz", {}
    for w in _VOCABULARY:
        if len(w) < 5:
            out.update({w[:i] + w[i + 1] + w[i] + w[i + 2 :]: w for i in range(len(w) - 1)})
            continue
        for i in range(len(w) + 1):
            for c in letters:
                out[w[:i] + c + w[i:]] = w
                if i < len(w):
                    out[w[:i] + c + w[i + 1 :]] = w
            if i < len(w):
                out[w[:i] + w[i + 1 :]] = w
            if i + 1 < len(w):
                out[w[:i] + w[i + 1] + w[i] + w[i + 2 :]] = w
    for w in _VOCABULARY:
        out.pop(w, None)
    return out


_WORD = re.compile(r"[a-z]{4,12}")
_TAGS = re.compile(r"<[^>]{1,40}>|&(?:nbsp|amp|#x?[0-9a-f]+);")


def repair(title: str) -> str:
    """The folded title with slips in the vocabulary's words mended."""
    slips = _slips()
    return _WORD.sub(lambda m: slips.get(m[0], m[0]), fold(_TAGS.sub(" ", titles._CAMEL.sub(" ", titles.strip_marks(title)))))


_SWAPPED = [re.compile(r"\b(kg|g|gr|grame|kilograme|ml|l|litri|lb|oz)\.? (\d[\d.,]*)(?![\w.,%+])"), re.compile(r"(?<![\w.,])(\d[\d.,]*)\s+[a-z]+,?\s+(kg|gr?|grame|kilograme|ml|litri)\b")]


def read_offer(title: str | None, description: str | None) -> tuple[str, str | None, str | None, Amount, str]:
    """name, age, ingredient, amount, bag: what a title says; age and ingredient from the description where a slip hides them. bag is the title's words in order of the alphabet."""
    s = repair(title) if title else ""
    t = read_title(s)
    a = t.amount
    if a.weight_g is None and a.volume_ml is None:  # neighbouring words were swapped
        for k, p in enumerate(_SWAPPED):
            if m := p.search(s):
                num, unit = (m[2], m[1]) if k == 0 else (m[1], m[2])
                b = read_amount(f"{num} {unit}")
                a = Amount(b.weight_g, b.volume_ml, a.units, a.bonus_g, a.rest)
                break
    age, ing = t.age, t.ingredient
    if (age is None or ing is None) and description:
        d = read_title(description)
        age, ing = age or d.age, ing or d.ingredient
    if a.weight_g is None and a.volume_ml is None and (m := re.search(r" (\d+(?:[.,]\d+)?)$", s)):  # cut before the unit
        b = read_amount(m[1] + (" g" if float(m[1].replace(",", ".")) >= 50 else " kg"))
        a = Amount(b.weight_g, b.volume_ml, a.units, a.bonus_g, a.rest)
    words = [w for w in t.name if len(w) > 2 and not w.isdigit() and w not in _PARTS]
    return " ".join(sorted(words)), age, ing, a, " ".join(sorted(re.findall(r"[a-z0-9.,']+", s)))


def vector(name: str) -> np.ndarray:
    v = np.zeros(LETTER_BITS + DIMENSIONS, bool)
    for c, n in Counter(name.replace(" ", "")).items():
        at = COUNTS * (ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 2)
        have = int(v[at : at + COUNTS].sum())
        v[at + have : at + min(COUNTS, have + n)] = True
    for w in name.split():
        w = f" {w} "
        for i in range(len(w) - 2):
            v[LETTER_BITS + zlib.crc32(w[i : i + 3].encode()) % DIMENSIONS] = True
    return v


def packed(name: str) -> list[int]:
    return np.packbits(vector(name)).view(np.int64).tolist()


def within(x: str, y: str) -> Column:
    """Whether the vectors of x and y (prefixes of columns) differ in no more bits than same_words can leave."""
    bits = [F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in VECTOR]
    n = LETTER_BITS // 64
    return (sum(bits[1:n], bits[0]) <= LETTERS_APART) & (sum(bits[n + 1 :], bits[n]) <= TRIGRAMS_APART)


def words_of(name: str) -> list[str]:
    """The different words by which a name is compared; none of a name that is known by a hash or not at all."""
    return [] if name.startswith("#") else sorted(set(name.split()))


def same_words(a: str, b: str) -> bool:
    """Whether two names are one but for slips: at most three edits, two in a word; a short word more; or words joined or parted, with at most one edit. Only names of words can be alike."""
    if a == b:
        return True
    if a.startswith("#") or b.startswith("#"):  # known by a hash or not at all
        return False
    x, y = a.split(), b.split()
    for w in list(x):
        if w in y:
            x.remove(w)
            y.remove(w)
    if not x or not y:  # a word of the trade that a slip has made a name
        return len(x + y) == 1 and len((x + y)[0]) <= 5 and bool(a) and bool(b)
    if len(x) == len(y) <= 4:
        far = []
        for u in x:
            # a swap is two of the metric's edits, so more than four of these are more than two slips
            far.append([with_swaps(u, w) if abs(len(u) - len(w)) <= 2 and levenshtein(u, w) <= 4 else 9 for w in y])
            if min(far[-1]) > 2:
                break
        else:
            for p in itertools.permutations(range(len(y))):
                e = [far[i][j] for i, j in enumerate(p)]
                if sum(e) <= 3 and all(k <= min(2, max(1, max(len(u), len(y[j])) // 3)) for k, u, j in zip(e, x, p)):
                    return True
    p, q = "".join(x), "".join(y)
    if len(x) <= 3 and len(y) <= 3 and abs(len(p) - len(q)) <= 1 and sum((Counter(p) - Counter(q)).values()) <= 1:
        return any(with_swaps("".join(p), "".join(q)) <= 1 for p in itertools.permutations(x) for q in itertools.permutations(y)) and max(len("".join(x)), len("".join(y))) > 5
    return False


_OFFER = "offer_id int, name string, age string, ing string, w int, v int, n int, b int, bag string"
_KIND = _OFFER + ", k1 bigint, k2 bigint, first_id int"


def read_offers(batch: DataFrame, rows: int | None = None) -> DataFrame:
    """The offers as they are compared. A blank title is known by its content_hash alone. A batch often lies in few of the files; where its number of rows is known, it is spread over so many tasks as that needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for i, t, desc, h in d[["offer_id", "title", "description", "content_hash"]].itertuples(index=False):
                t = t if isinstance(t, str) and t.strip() else None
                name, age, ing, a, bag = read_offer(t, desc if isinstance(desc, str) else None)
                stated = a.weight_g is not None or a.volume_ml is not None
                if t is None:
                    name, bag = (f"#{h}", f"#{h}") if isinstance(h, str) else (f"#offer {i}", "")
                nums = (a.weight_g, a.volume_ml, a.units or 1, a.bonus_g or 0) if stated else (None, None, a.units, a.bonus_g)
                rows.append((i, name, age, ing, *[x if x is None or x < 2**31 else None for x in nums], bag))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OFFER.split(", ")], dtype="object")
            yield out.astype({"offer_id": "int32", "w": "Int32", "v": "Int32", "n": "Int32", "b": "Int32"})

    few = batch.select("offer_id", "title", "description", "content_hash").where("offer_id IS NOT NULL")
    n = few.sparkSession.sparkContext.defaultParallelism
    return (spread(few, "offer_id") if rows is None else few.repartition(max(n, -(-rows // TASK_OFFERS)), "offer_id")).mapInPandas(run, _OFFER)


def read_names(names: DataFrame) -> DataFrame:
    """name, words, sets and the vector of each name."""
    schema = "name string, words array<string>, sets array<bigint>, " + ", ".join(f"{c} bigint" for c in VECTOR)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = [(n, words_of(n), letter_sets(n) if words_of(n) else [], *packed(n)) for n in d["name"]]
            yield pd.DataFrame(rows, columns=["name", "words", "sets", *VECTOR])

    return names.select("name").mapInPandas(run, schema)


@F.pandas_udf(BooleanType())
def _same_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_words(x, y) for x, y in zip(a, b)], dtype=bool)


def _word_cell(word: str) -> Column:
    return F.xxhash64(F.lit("word"), F.col(word))


def _set_cell(letters: str) -> Column:
    return F.xxhash64(F.lit("letters"), F.col(letters))


#: The index's tables. cells, sets and forms lie in files by the number of their cell.
_TABLES = {
    "kinds": _KIND,
    "names": "name string",
    "links": "q string, name string",
    "words": "word string, n bigint",
    "near_words": "word string, other string",
    "forms": "word string, key bigint, cell int",
    "cells": "name string, " + ", ".join(f"{c} bigint" for c in VECTOR) + ", key bigint, cell int",
    "sets": "name string, key bigint, cell int",
}


class OfferIndex:
    """The accepted offers, persisted under a folder that all executors share: names in vector cells, and every kind (offers that are read alike) with its earliest offer and the first_id it was resolved to.

    A folder that holds an index already is opened as it was left; cells applies to a new one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, cells: int = CELLS) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "offers")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.state: dict = {"version": 0, "batches": 0, "cells": cells, "tables": {t: [] for t in _TABLES}}
        folder = self._path("manifest")
        if self._fs.exists(folder):
            versions = [int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json")]
            if versions:
                text = spark.read.text(f"{self.path}/manifest/{max(versions):09d}.json", wholetext=True).first()[0]
                self.state = json.loads(text)
        self.cells_read: dict[str, int] = {}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _commit(self, state: dict) -> None:
        """The manifest appears whole or not at all: it is written beside its place and renamed."""
        state["version"] += 1
        name = f"manifest/{state['version']:09d}.json"
        out = self._fs.create(self._path(name + ".new"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(self._path(name + ".new"), self._path(name)):
            raise RuntimeError(f"another writer has changed the index {self.path}")
        self.state = state

    def _read(self, what: str) -> DataFrame:
        """A table of the index, of all batches accepted."""
        folders = [f[0] for f in self.state["tables"][what]]
        if not folders:
            return self.spark.createDataFrame([], _TABLES[what])
        return self._folders(what, folders)

    def _folders(self, what: str, folders: list[str]) -> DataFrame:
        base, columns = f"{self.path}/{what}", [c.split()[0] for c in _TABLES[what].split(", ")]
        return self.spark.read.option("basePath", base).schema(_TABLES[what]).parquet(*[f"{base}/folder={f}" for f in folders]).select(columns)

    def _write(self, df: DataFrame, what: str, folder: str) -> DataFrame:
        to = f"{self.path}/{what}/folder={folder}"
        if what in ("cells", "sets", "forms"):
            df = df.withColumn("cell", F.pmod("key", F.lit(self.state["cells"])).cast("int")).repartition("cell")
            df.write.mode("overwrite").partitionBy("cell").parquet(to)
        else:
            df.write.mode("overwrite").parquet(to)
        return self._folders(what, [folder])

    def _probed(self, what: str, keys: DataFrame) -> DataFrame:
        """The rows of the cells in which the keys lie; files of other cells are not read. There are at most as many numbers as cells."""
        if not self.state["tables"][what]:
            return self._read(what)
        numbers = [r[0] for r in keys.select(F.pmod("key", F.lit(self.state["cells"])).cast("int")).distinct().collect()]
        self.cells_read[what] = len(numbers)
        return self._read(what).where(F.col("cell").isin(numbers))

    def kinds(self) -> DataFrame:
        return self._read("kinds")

    def _learn_words(self, names: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
        """Adds the words of new names: their counts, their keys, and which words lie within two edits. Returns counts and near words of old and new."""
        counts = self._write(names.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words", folder)
        fresh = counts.join(self._read("words").select("word").distinct(), "word", "left_anti")
        keyed = cut(keyed_words(fresh))
        kept = self._write(kept_keys(keyed), "forms", folder)
        sought = sought_keys(keyed)
        known = self._probed("forms", sought).select("word", "key").unionByName(kept.select("word", "key"))
        near = self._write(near_words(sought, known), "near_words", folder)
        return self._read("words").unionByName(counts), self._read("near_words").unionByName(near)

    def _search(self, names: DataFrame, counts: DataFrame, near: DataFrame, folder: str) -> DataFrame:
        """q, name of every new name and every other one, old or new, that same_words accepts; appends the new names to the cells."""
        each = names.select("name", F.explode("words").alias("word"))
        n = counts.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
        rare = rarest(each, n, "name", 2)
        alike = rare.where("k = 1").join(near, "word").select("name", F.col("other").alias("word"))
        vectors = names.select("name", *VECTOR)
        probes = rare.select("name", "word").unionByName(alike).select("name", _word_cell("word").alias("key")).distinct()
        probes = cut(probes.join(vectors, "name").select(F.col("name").alias("q"), "key", *[F.col(c).alias(f"q_{c}") for c in VECTOR]))
        own = self._write(names.select("name", *VECTOR, F.explode("words").alias("w")).select("name", *VECTOR, _word_cell("w").alias("key")), "cells", folder)
        members = self._probed("cells", probes).unionByName(own).select("name", "key", *VECTOR)
        met = probes.join(members, "key").where((F.col("q") != F.col("name")) & within("q_", "")).select("q", "name")
        # names that share a letter set are few and near: these cells need no vectors
        sets = self._write(names.select("name", F.explode("sets").alias("s")).select("name", _set_cell("s").alias("key")), "sets", folder)
        asked = sets.select(F.col("name").alias("q"), "key")
        regrouped = asked.join(self._probed("sets", asked).unionByName(sets).select("name", "key"), "key").where("q <> name").select("q", "name")
        return met.unionByName(regrouped).distinct().where(_same_words("q", "name"))

    def add(self, batch: DataFrame, rows: int | None = None) -> DataFrame:
        """first_id, offer_id of every offer of the batch that repeats one accepted before or with a smaller id in the batch; then appends what is new.

        offer_id rises with arrival. Empty batches, repeated rows, null titles, descriptions and hashes are allowed; other columns are ignored.
        A batch that is given again gives the same rows and adds nothing.
        """
        attrs = ["name", "age", "ing", "w", "v", "n", "b", "bag"]
        parts = [x for c in attrs for x in (F.col(c).isNull(), F.col(c))]
        state = json.loads(json.dumps(self.state))
        folder = f"b{state['batches']}"
        offers = cut(read_offers(batch, rows).withColumns({"k1": F.xxhash64(*parts), "k2": F.xxhash64(F.lit(2), *parts)}))
        known_kinds = self.kinds()
        # a kind that came before is resolved already
        kinds = cut(offers.groupBy("k1", "k2", *attrs).agg(F.min("offer_id").alias("offer_id")).join(known_kinds.select("k1", "k2"), ["k1", "k2"], "left_anti"))
        names = cut(read_names(kinds.select("name").distinct().join(self._read("names"), "name", "left_anti")))
        written = self._write(names.select("name"), "names", folder)
        near = self._search(names, *self._learn_words(names, folder), folder)
        # names that are known already have their neighbours of before; new ones link both ways
        links = self._write(both_ways(near, "q", "name", "q", "name"), "links", folder)
        mine = kinds.select("name").distinct()
        earlier = self._read("links").join(mine.join(written, "name", "left_anti").select(F.col("name").alias("q")), "q", "left_semi")
        sim = links.unionByName(earlier).unionByName(mine.select(F.col("name").alias("q"), "name")).distinct()
        x = kinds.select(*[F.col(c).alias(f"x_{c}") for c in ["offer_id", *attrs]])
        y = known_kinds.select("offer_id", *attrs, "first_id").unionByName(kinds.select("offer_id", *attrs, F.col("offer_id").alias("first_id")))
        pairs = x.join(sim, F.col("x_name") == F.col("q")).join(y, "name").where(F.col("offer_id") < F.col("x_offer_id"))
        agree = lambda c: F.col(c).isNull() | F.col(f"x_{c}").isNull() | (F.col(c) == F.col(f"x_{c}"))
        stated = lambda p: F.col(f"{p}w").isNotNull() | F.col(f"{p}v").isNotNull()
        numbers = F.col("w").eqNullSafe(F.col("x_w")) & F.col("v").eqNullSafe(F.col("x_v")) & F.col("n").eqNullSafe(F.col("x_n")) & F.col("b").eqNullSafe(F.col("x_b"))
        bag = F.split("bag", " ")
        x_bag = F.split("x_bag", " ")
        alike = F.size(F.array_intersect(bag, x_bag)) / F.size(F.array_union(bag, x_bag))
        exact = stated("") & stated("x_") & numbers
        open_ = ~(stated("") & stated("x_")) & agree("n") & agree("b") & (alike >= 0.7)
        match = pairs.where((F.col("bag") == F.col("x_bag")) | (agree("age") & agree("ing") & (exact | open_)))
        rank = F.when((F.col("bag") == F.col("x_bag")) | exact, F.lit(0.0)).otherwise(1 - alike)
        found = cut(match.groupBy("x_offer_id").agg(F.min_by("first_id", F.struct(rank, "offer_id")).alias("first")))
        while True:  # the first of a kind that is itself a repeat within the batch
            nxt = found.select(F.col("x_offer_id").alias("first"), F.col("first").alias("further"))
            if not found.join(nxt, "first", "left_semi").head(1):
                break
            found = cut(found.join(nxt, "first", "left").select("x_offer_id", F.coalesce("further", "first").alias("first")))
        settled = kinds.join(found, kinds["offer_id"] == found["x_offer_id"], "left").withColumn("first_id", F.coalesce("first", "offer_id")).select("offer_id", *attrs, "k1", "k2", "first_id")
        settled = self._write(settled, "kinds", folder)
        resolved = settled.unionByName(known_kinds).select("k1", "k2", "first_id")
        out = cut(offers.select("k1", "k2", "offer_id").join(resolved, ["k1", "k2"]).where("first_id < offer_id").select("first_id", "offer_id").distinct())
        for t in _TABLES:
            state["tables"][t].append([folder, 0])
        state["batches"] += 1
        self._commit(state)
        self._merge()
        return out

    def _merge(self) -> None:
        """FAN_IN folders of one size become one of the next, so that few are read however many batches came; a row is rewritten as often as the number has digits in that base."""
        state = json.loads(json.dumps(self.state))
        for t, folders in state["tables"].items():
            while len(last := folders[-FAN_IN:]) == FAN_IN and len({size for _, size in last}) == 1:
                size = last[0][1] + 1
                name = f"{last[-1][0]}-{size}"
                self._write(self._folders(t, [f for f, _ in last]), t, name)
                folders[-FAN_IN:] = [[name, size]]
        if state != self.state:
            self._commit(state)

    def vacuum(self) -> None:
        """Deletes folders that the newest manifest doesn't name. Rows that add has returned stay readable; DataFrames read from the index before may not."""
        for t, folders in self.state["tables"].items():
            keep = {f"folder={f}" for f, _ in folders}
            if self._fs.exists(self._path(t)):
                for f in self._fs.listStatus(self._path(t)):
                    if f.getPath().getName() not in keep:
                        self._fs.delete(f.getPath(), True)


def rounds(sizes: dict[int, int], least: int) -> list[list[int]]:
    """Batch numbers in order, in rounds that end once they hold so many offers; a batch is never parted."""
    out: list[list[int]] = []
    held = least
    for n in sorted(sizes):
        if held >= least:
            out.append([])
            held = 0
        out[-1].append(n)
        held += sizes[n]
    return out


def deduplicate(offers: DataFrame, index: OfferIndex, batch: str = "batch_no", round_offers: int = ROUND_OFFERS) -> DataFrame:
    """first_id, offer_id of every repeat, batch after batch in order of their numbers; offers of no batch come last.

    Small batches that wait together are taken in one round, which changes the cost but no row; a batch of round_offers or more is a round of its own.
    """
    sizes = {r[0]: r[1] for r in offers.groupBy(batch).count().collect()}  # as many as there are batches
    rest = sizes.pop(None, 0)
    parts = [(offers.where(F.col(batch).isin(r)), sum(sizes[n] for n in r)) for r in rounds(sizes, round_offers)]
    out = None
    for part, rows in parts + ([(offers.where(F.col(batch).isNull()), rest)] if rest else []):
        found = index.add(part, rows)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else offers.select(F.col("offer_id").alias("first_id"), "offer_id").limit(0)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every offer that repeats one with a smaller id, with the first of its kind."""
    return deduplicate(table(spark, sf_dir, "offer_intake"), OfferIndex(spark)).distinct()
