"""Names of words as slips leave them: keys under which words within two edits, or letters of joined and parted words, meet without comparing all with all."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sparkmill.llm.brands import with_swaps

#: Edits in a word, swaps counted once. Words up to SHORT letters meet by what is left without as many letters, longer ones by their pieces.
WORD_EDITS, SHORT, PIECES = 2, 16, 5
#: Words whose keys a worker holds at a time.
KEYED_TOGETHER = 1_000


@lru_cache(maxsize=4096)
def _weight(letter: str) -> int:
    return int.from_bytes(hashlib.blake2b(letter.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def letter_sets(name: str) -> list[int]:
    """Sums of the letters' weights: of all letters of a name, and of all but one of each different letter. Names one edit apart, however parted into words, share one."""
    letters = Counter(name.replace(" ", ""))
    whole = sum(_weight(c) * n for c, n in letters.items())
    return [((whole - x + 2**63) % 2**64) - 2**63 for x in (0, *map(_weight, sorted(letters)))]


def word_keys(word: str) -> tuple[list[str], list[str]]:
    """Keys under which a word is kept, and those under which it is looked for: two words within WORD_EDITS edits share one.

    A short word: what is left without any WORD_EDITS letters or fewer. A longer one is kept by its PIECES pieces, one of which the
    edits leave whole, as a swap can reach over into a second, and looked for by every piece that words of nearly its length can have nearly there.
    """
    kept: set[str] = set()
    sought: set[str] = set()
    n = len(word)
    if n <= SHORT:
        level = {word}
        for _ in range(WORD_EDITS):
            level |= {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        kept |= {"-" + w for w in level}
    sought |= kept
    if n > SHORT - WORD_EDITS:
        ends = lambda m: [m * i // PIECES for i in range(PIECES + 1)]
        e = ends(n)
        kept |= {f"{n}/{e[i]}/{word[e[i] : e[i + 1]]}" for i in range(PIECES)}
        for m in range(n - WORD_EDITS, n + WORD_EDITS + 1):
            e = ends(m)
            for i in range(PIECES):
                for at in range(max(0, e[i] - WORD_EDITS), min(n, e[i] + WORD_EDITS) + 1):
                    piece = word[at : at + e[i + 1] - e[i]]
                    if len(piece) == e[i + 1] - e[i]:
                        sought.add(f"{m}/{e[i]}/{piece}")
    return sorted(kept), sorted(sought)


def keyed_words(words: DataFrame) -> DataFrame:
    """word, kept, sought: the keys of word_keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for at in range(0, len(d), KEYED_TOGETHER):  # a word has a hundred keys, so less than a batch at a time is held
                yield pd.DataFrame([(w, *word_keys(w)) for w in d["word"][at : at + KEYED_TOGETHER]], columns=["word", "kept", "sought"])

    return words.select("word").mapInPandas(run, "word string, kept array<string>, sought array<string>")


def kept_keys(keyed: DataFrame) -> DataFrame:
    return keyed.select("word", F.explode("kept").alias("k")).select("word", F.xxhash64("k").alias("key"))


def sought_keys(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("word").alias("a"), F.explode("sought").alias("k")).select("a", F.xxhash64("k").alias("key"))


@F.pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is None or with_swaps(x, y) <= WORD_EDITS for x, y in zip(a, b)], dtype=bool)


def near_words(sought: DataFrame, kept: DataFrame) -> DataFrame:
    """word, other: different words within WORD_EDITS edits, both ways."""
    pairs = sought.join(kept, "key").where("a <> word").select("a", "word").distinct()
    # a swap is two plain edits; only pairs with more of these than WORD_EDITS need to be looked at for swaps
    pairs = pairs.withColumn("d", F.levenshtein("a", "word", 2 * WORD_EDITS)).where("d >= 0")
    pairs = pairs.where(_near(F.when(F.col("d") > WORD_EDITS, F.col("a")), "word"))
    return both_ways(pairs, "a", "word", "word", "other")


def both_ways(pairs: DataFrame, a: str, b: str, x: str, y: str) -> DataFrame:
    """Different pairs x, y of pairs (a, b) and (b, a)."""
    turned = F.array(F.struct(F.col(a).alias(x), F.col(b).alias(y)), F.struct(F.col(b).alias(x), F.col(a).alias(y)))
    return pairs.select(F.explode(turned).alias("p")).select(f"p.{x}", f"p.{y}").distinct()


def rarest(each: DataFrame, counts: DataFrame, name: str, k: int) -> DataFrame:
    """name, word, k: of each name's words the k rarest by counts (word, n), the rarest first."""
    order = Window.partitionBy(name).orderBy("n", "word")
    return each.join(counts, "word").withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select(name, "word", "k")
