"""Mapping of free-entered values to a canonical list (problem 3), by a BK-tree under Levenshtein's metric.

A value is read in a few plain ways (wrapping words off, letters for look-alike
digits and foreign letters, spaced letters joined) and reduced to a key; the entries' names, their
turned word orders and their aliases are keys too. The tree returns every entry within the threshold of a key, pruned by the triangle
inequality, and the nearest wins. It is walked once for all values of a batch: at each node the distances to all values that are still open are computed side by side. Values too short for a threshold must be an alias, or the beginning of a name that was cut.

The entries are split into shards of bounded size, each with its own tree; values and shards meet in one job, and the shards' winners merge by the
least (distance, entry). Values are mapped once, however often they occur.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.session import cut, table

#: Entries of one tree; a reference of more is split into shards, so that what a task holds is bounded.
SHARD_ENTRIES = 20_000
#: Values that walk the tree side by side.
TOGETHER = 2_048
#: Values that meet a shard in one task, on average, at most.
SLICE_VALUES = 50_000
#: Foreign letters that look like Latin ones, digits typed for letters.
LOOKALIKE = str.maketrans("авеёкмнорстухіјѕԁһցзɡαβεζηικμνορτυχ", "abeekmhopctyxijsdhg3gabeznikmnoptux")
DIGITS = str.maketrans("013457$@", "oieastsa")
#: Words that wrap a name.
BEFORE = re.compile(r"^(?:(?:marca|brand|brandul|by|producator|vandut de|sc|s\.c\.|hrana (?:uscata |umeda )?(?:pentru |pt\.? )?(?:caini|pisici))\s*:?\s+|marca:)+")
AFTER = re.compile(
    r"(?:\s*(?:,\s*ro|,?\s*(?:s\.?r\.?l\.?|s\.?a\.?|gmbh|ltd\.?|inc\.?|llc|s\.?p\.?a\.?)|\((?:import|r|tm|c|ro)\)|[®™©]|-\s*hrana (?:uscata|umeda)|pet ?food(?: romania)?|romania|international|import|official|oficial))+$"
)
_SEPARATORS = re.compile(r"[^a-z0-9]+")


class Reading(NamedTuple):
    key: str  #: letters and digits only, l and i as one letter
    words: tuple[str, ...]
    cut: bool  #: ends with a mark of omission


def merge_il(s: str) -> str:
    return s.replace("l", "i")


def plain(value: str) -> str:
    """Lower case without entities, diacritics and foreign look-alikes, with single spaces."""
    s = html.unescape(html.unescape(value.replace("&NBSP;", "&nbsp;").replace("&AMP;", "&amp;")))
    s = re.sub(r"&#X([0-9A-F]+);", lambda m: chr(int(m[1], 16)), s).lower().translate(LOOKALIKE)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).translate(LOOKALIKE)
    return re.sub(r"[\s​﻿]+", " ", s).strip()


def read(value: str, letters: bool = False) -> list[Reading]:
    """The readings of a value, the plainest first; none of a blank one. letters: digits are read as letters."""
    raw = html.unescape(value)
    s = plain(re.sub("[®™©]", " ", raw))
    cut = s.endswith(("…", "...", ".")) and not re.search(r"(?:ltd|s\.?r\.?l|s\.?a|inc|\b[a-z])\.$", s)
    s = AFTER.sub("", s).strip("[](){}\"'`«»„”“*.,;:|_- …")
    for _ in range(3):
        t = AFTER.sub("", BEFORE.sub("", s)).strip(" \"'[](){}.,;:|_-")
        if t == s or not t:
            break
        s = t
    forms = [s]
    if m := re.fullmatch(r"(.+?)\s*/\s*(.+)", s):
        forms += [m[1], m[2]]
    if (n := len(s)) > 6 and n % 2 and s[: n // 2] == s[n // 2 + 1 :] and s[n // 2] == " ":
        forms.append(s[: n // 2])
    if "," in s:
        a, _, b = s.partition(",")
        forms.append(f"{b.strip()} {a.strip()}")
    out, seen = [], set()
    for f in forms:
        if letters:
            f = f.translate(DIGITS)
        words = tuple(w for w in _SEPARATORS.split(f.replace("'", "")) if w)
        key = merge_il("".join(words))
        if key and key not in seen:
            seen.add(key)
            out.append(Reading(key, words, cut))
    return out


def levenshtein(a: str, b: str) -> int:
    """The number of insertions, deletions and substitutions; a metric. Bit-parallel over the columns of a."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    return _columns(_masks(a), len(a), b)


def _masks(a: str) -> dict[str, int]:
    m: dict[str, int] = {}
    for i, c in enumerate(a):
        m[c] = m.get(c, 0) | 1 << i
    return m


def _columns(masks: dict[str, int], n: int, b: str) -> int:
    """Myers' algorithm: vp and vn hold where a column of the distance table rises and falls."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, d = full, 0, n
    get = masks.get
    for c in b:
        x = get(c, 0)
        y = x | vn
        x = (((x & vp) + vp) ^ vp) | x
        hp = vn | ~(x | vp) & full
        hn = vp & x
        if hp & top:
            d += 1
        elif hn & top:
            d -= 1
        hp = (hp << 1 | 1) & full
        hn = hn << 1 & full
        vp = hn | ~(y | hp) & full
        vn = hp & y
    return d


def with_swaps(a: str, b: str) -> int:
    """Edits where a swap of neighbours counts once. As _columns; a swap is a letter that is b's one before, where that one's was not met."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    masks, n = _masks(a), len(a)
    full, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, d = full, 0, n
    met = before = 0
    get = masks.get
    for c in b:
        x = get(c, 0)
        swap = ((~met & x) << 1) & before
        met = ((((x & vp) + vp) ^ vp) | x | vn | swap) & full
        hp = vn | ~(met | vp) & full
        hn = met & vp
        if hp & top:
            d += 1
        elif hn & top:
            d -= 1
        hp = (hp << 1 | 1) & full
        hn = hn << 1 & full
        vp = hn | ~(met | hp) & full
        vn = hp & met
        before = x
    return d


class BKTree:
    """Keys under a metric. search() returns every key within the threshold: a subtree at distance e of a node at distance d can hold one only if |d - e| <= threshold."""

    def __init__(self, keys: Sequence[str] = ()) -> None:
        self.root: tuple[str, dict] | None = None
        for k in keys:
            self.add(k)

    def add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while (d := levenshtein(node[0], key)) != 0:
            nxt = node[1].get(d)
            if nxt is None:
                node[1][d] = (key, {})
                return
            node = nxt

    def search(self, key: str, threshold: int) -> list[tuple[int, str]]:
        out, todo = [], [self.root] if self.root else []
        masks, n = _masks(key), len(key)
        while todo:
            name, kids = todo.pop()
            d = _columns(masks, n, name)
            if d <= threshold:
                out.append((d, name))
            todo += [kid for e, kid in kids.items() if abs(d - e) <= threshold]
        return out


    def search_many(self, keys: Sequence[str], thresholds: Sequence[int]) -> list[list[tuple[int, str]]]:
        """search() of every key with its threshold, in one walk of the tree."""
        out: list[list[tuple[int, str]]] = [[] for _ in keys]
        order = sorted(range(len(keys)), key=lambda i: len(keys[i]))  # texts of like length have as many columns
        for at in range(0, len(order), TOGETHER):
            self._walk(keys, thresholds, order[at : at + TOGETHER], out)
        return out

    def _walk(self, keys: Sequence[str], thresholds: Sequence[int], which: list[int], out: list[list[tuple[int, str]]]) -> None:
        if self.root is None:
            return
        texts, t = _Texts([keys[i] for i in which]), np.array([thresholds[i] for i in which])
        todo = [(self.root, np.arange(len(which)))]
        while todo:
            (name, kids), open_ = todo.pop()
            d = texts.distances(name, open_)
            for i in np.flatnonzero(d <= t[open_]):
                out[which[open_[i]]].append((int(d[i]), name))
            for e, kid in kids.items():
                if len(rest := open_[np.abs(d - e) <= t[open_]]):
                    todo.append((kid, rest))


class _Texts:
    """Texts as rows of letters' numbers, for Levenshtein distances to one word of all at once."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.texts = list(texts)
        self.size = np.array([len(x) for x in self.texts])
        points = np.frombuffer("".join(x.ljust(max(self.size)) for x in self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, codes = np.unique(points, return_inverse=True)
        self.code = {chr(c): k for k, c in enumerate(letters.tolist())}
        self.rows = codes.reshape(len(self.texts), -1).T if len(points) else np.zeros((0, len(self.texts)), int)

    def distances(self, word: str, which: np.ndarray) -> np.ndarray:
        """Myers' algorithm as in _columns, a row of machine words for the texts; a word longer than these goes the slow way."""
        n = len(word)
        if not 0 < n < 64:
            return np.array([levenshtein(word, self.texts[i]) for i in which])
        masks = np.zeros(len(self.code) + 1, np.uint64)
        for c, m in _masks(word).items():
            if c in self.code:
                masks[self.code[c]] = m
        one = np.uint64(1)
        full, top = np.uint64((1 << n) - 1), np.uint64(1 << (n - 1))
        vp, vn = np.full(len(which), full), np.zeros(len(which), np.uint64)
        size = self.size[which]
        d = np.full(len(which), n)
        for at in range(int(size.max(initial=0))):
            x = masks[self.rows[at][which]]
            y = x | vn
            x = (((x & vp) + vp) ^ vp) | x
            hp = vn | ~(x | vp) & full
            hn = vp & x
            inside = at < size
            d += inside & ((hp & top) != 0)
            d -= inside & ((hn & top) != 0)
            hp = (hp << one | one) & full
            hn = hn << one & full
            vp = hn | ~(y | hp) & full
            vn = hp & y
        return d


def threshold(n: int) -> int:
    """Edits, swaps counted once, allowed for a key of n characters. A swap is two edits of the tree's metric, so the tree is searched to twice as many."""
    return 0 if n < 5 else 1 if n < 7 else 2 if n < 10 else 3


class Matcher:
    """A shard of the reference: (id, name, aliases)."""

    def __init__(self, entries: Sequence[tuple[int, str, Sequence[str] | None]]) -> None:
        self.exact: dict[str, set[int]] = {}
        self.alias: dict[str, set[int]] = {}
        self.first: list[tuple[str, int]] = []
        self.length: dict[int, int] = {}
        self.name: dict[int, str] = {}
        for i, name, aliases in entries:
            words = read(name)[0].words if name and read(name) else ()
            for k in range(len(words)):
                key = merge_il("".join(words[k:] + words[:k]))
                self.exact.setdefault(key, set()).add(i)
            self.length[i] = len("".join(words))
            self.name[i] = merge_il("".join(words))
            self.first.append((merge_il("".join(words)), i))
            for a in aliases or ():
                if a and (r := read(a)):
                    self.alias.setdefault(r[0].key, set()).add(i)
        self.tree = BKTree(sorted(self.exact))
        self.cut_trees: dict[int, BKTree] = {}  # of the beginnings of each length
        self.first.sort()

    def beginnings(self, key: str) -> list[int]:
        """Entries whose name begins with key, the shortest first."""
        k = bisect_left(self.first, (key, -1))
        out = []
        while k < len(self.first) and self.first[k][0].startswith(key):
            out.append(self.first[k][1])
            k += 1
        return sorted(out, key=lambda i: (self.length[i], i))

    def best(self, value: str) -> tuple[float, int] | None:
        return self.best_many([value])[0]

    def best_many(self, values: Sequence[str]) -> list[tuple[float, int] | None]:
        """(distance, id) of each value's nearest entry; None if none is within the threshold. Equally near entries: the one whose length is nearest, then the least id.

        A plainer way to read a value comes before the edits: as it stands, with
        digits as letters, as an alias, as the beginning of a name that was cut.
        """
        all_readings, all_found, asked = [], [], []
        for at, value in enumerate(values):
            readings = [(0.1 * letters, r) for letters in ((False, True) if any(c in "0134578$@" for c in value) else (False,)) for r in read(value, letters)]
            readings = [(h, r) for h, r in readings if not re.fullmatch(r"[a-z]{0,12}\d{3,}", r.key)]  # no codes
            found = self._plain(readings)
            all_readings.append(readings)
            all_found.append(found)
            if not found:
                asked += [(at, h, r.key, t) for h, r in readings if (t := threshold(len(r.key)))]
        hits = self.tree.search_many([key for _, _, key, _ in asked], [2 * t for *_, t in asked])
        for (at, h, key, t), near in zip(asked, hits):
            for _, name in near:
                if (d := with_swaps(key, name)) <= t:
                    all_found[at] += [(d + h, abs(self.length[i] - len(key)), i) for i in self.exact[name]]
        for at, (readings, found) in enumerate(zip(all_readings, all_found)):
            if not found or found[0][0] >= 1:  # none was read plainly
                all_found[at] = found + self._cut_with_a_slip(readings)
        return [min(found)[::2] if found else None for found in all_found]

    def _plain(self, readings: list[tuple[float, Reading]]) -> list[tuple[float, int, int]]:
        found: list[tuple[float, int, int]] = []
        for h, r in readings:
            found += [(h, abs(self.length[i] - len(r.key)), i) for i in self.exact.get(r.key, ())]
            found += [(h + 0.05, 0, i) for i in self.alias.get(r.key, ())]
        if not found:
            for h, r in readings:
                if len(r.key) >= 4 and (cut := self.beginnings(r.key)):
                    # one name, or a name and its longer relatives
                    if all(i == cut[0] or self.name[i].startswith(self.name[cut[0]]) for i in cut):
                        found.append((h + (0.3 if r.cut else 0.6), 0, cut[0]))
        return found

    def _cut_with_a_slip(self, readings: list[tuple[float, Reading]]) -> list[tuple[float, int, int]]:
        found = []
        for h, r in readings:
            n = len(r.key)
            if r.cut and n >= 6:
                if n not in self.cut_trees:
                    self.cut_trees[n] = BKTree(sorted({k[:n] for k, _ in self.first if len(k) > n}))
                near = {k for _, k in self.cut_trees[n].search(r.key, 2) if with_swaps(k, r.key) <= 1}
                ids = [i for k in near for i in self.beginnings(k) if len(self.name[i]) > n]
                if ids:
                    found.append((1.5 + h, 0, min(ids, key=lambda i: (self.length[i], i))))
        return found


def match_values(values: DataFrame, column: str, reference: DataFrame, id_: str, name: str, aliases: str, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """column, entry, distance for every distinct value of the column; entry is -1 and distance null where none is meant. Null and blank values give no row."""
    distinct = cut(values.select(F.col(column).alias("value")).where("value IS NOT NULL AND trim(value) <> ''").distinct())
    ref = reference.select(F.col(id_).cast("int").alias("id"), F.col(name).alias("name"), F.col(aliases).alias("aliases")).where("id IS NOT NULL AND name IS NOT NULL")
    shards = max(1, -(-ref.count() // shard_entries))
    slices = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // SLICE_VALUES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    entries = ref.select("id", "name", "aliases", shard.alias("shard"), every(slices).alias("slice"))
    asked = distinct.select("value", F.pmod(F.xxhash64("value"), F.lit(slices)).cast("int").alias("slice"), every(shards).alias("shard"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["id", "name"])
        best = Matcher([(int(i), n, None if x is None else list(x)) for i, n, x in zip(b["id"], b["name"], b["aliases"])]).best_many(a["value"].tolist()) if len(a) else []
        return pd.DataFrame({"value": a["value"], "distance": pd.array([b[0] if b else None for b in best], dtype="Float64"), "entry": pd.array([b[1] if b else None for b in best], dtype="Int32")})

    # few bytes, much work: a stated number of parts is not put together again
    parted = lambda d: d.repartition(shards * slices, "shard", "slice").groupBy("shard", "slice")
    met = parted(asked).cogroup(parted(entries)).applyInPandas(run, "value string, distance double, entry int")
    won = met.groupBy("value").agg(F.min(F.when(F.col("entry").isNotNull(), F.struct("distance", "entry"))).alias("w"))
    return won.select(F.col("value").alias(column), F.coalesce("w.entry", F.lit(-1)).alias("entry"), F.col("w.distance").alias("distance"))


def brand_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_set, record_id, value of the three columns, without blank values."""
    sets = (("category_listings", "vendor"), ("norm_listings", "brand"), ("products", "brand"))
    out = None
    for name, column in sets:
        d = table(spark, sf_dir, name).select(F.lit(name).alias("record_set"), F.col("id").cast("long").alias("record_id"), F.col(column).alias("value"))
        out = d if out is None else out.unionByName(d)
    return out.where("record_id IS NOT NULL AND value IS NOT NULL AND trim(value) <> ''")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value that is not a brand's name as it stands, with the brand meant, or -1."""
    ref = table(spark, sf_dir, "brand_reference")
    values = brand_values(spark, sf_dir)
    names = ref.select(F.lower("brand_name").alias("low")).where("low IS NOT NULL").distinct()
    cases = values.withColumn("low", F.lower(F.trim("value"))).join(names, "low", "left_anti")
    mapped = match_values(cases, "value", ref, "brand_id", "brand_name", "aliases")
    return cases.join(mapped, "value").select("record_set", "record_id", F.col("entry").alias("brand_id")).distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_set, mapped, unmatched, exact: how many values stand as they are, were mapped, or mean no entry."""
    found = p3_found(spark, sf_dir).groupBy("record_set").agg(F.count_if(F.col("brand_id") >= 0).alias("mapped"), F.count_if(F.col("brand_id") < 0).alias("unmatched"))
    all_ = brand_values(spark, sf_dir).groupBy("record_set").agg(F.count("*").alias("values_"))
    return all_.join(found, "record_set", "left").select("record_set", F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmatched", F.lit(0)).alias("unmatched"), (F.col("values_") - F.coalesce("mapped", F.lit(0)) - F.coalesce("unmatched", F.lit(0))).alias("exact"))
