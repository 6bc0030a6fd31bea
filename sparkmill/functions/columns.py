"""Text functions as column expressions. Only the folding of texts beyond ASCII leaves whole-stage code generation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The characters that separate words in Unicode, and the four separators of ASCII.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words of ingredients in the order in which they are looked for, and what they are called.
FLAVOURS = {"pui": "Chicken", "chicken": "Chicken", "rata": "Duck", "duck": "Duck", "miel": "Lamb", "lamb": "Lamb", "vita": "Beef", "beef": "Beef", "somon": "Salmon", "salmon": "Salmon", "ton": "Tuna", "tuna": "Tuna", "pastrav": "Trout", "trout": "Trout", "hering": "Herring", "herring": "Herring", "curcan": "Turkey", "turkey": "Turkey", "iepure": "Rabbit", "rabbit": "Rabbit", "porc": "Pork", "pork": "Pork", "caprioara": "Venison", "venison": "Venison"}


@F.pandas_udf(StringType())
def _without_marks(text: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}
    out = []
    for t in text:
        if t is not None and t not in seen:
            seen[t] = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))
        out.append(None if t is None else seen[t])
    return pd.Series(out, dtype="object")


def single_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{SPACES}]+", " "))


def fold(c: Column) -> Column:
    """Lower case, compatibility decomposition without combining marks (NFKD), single spaces, trimmed; null stays null.

    Only texts beyond ASCII leave the JVM, in Arrow batches; the others are lowered in place.
    """
    marked = _without_marks(F.when(~c.rlike(r"^\p{ASCII}*$"), c))
    return single_spaces(F.coalesce(marked, F.lower(c)))


def content_hash(folded: Column) -> Column:
    return F.sha2(folded, 256)


def tokens(c: Column) -> Column:
    """Different words of letters, digits and apostrophes, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(fold(c), F.lit("[a-z0-9']+"), F.lit(0))))


def blocking_key(c: Column) -> Column:
    """Only ASCII letters and digits, lower case; null if none is left. Other letters are dropped, not folded."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), F.lit(""))


def flavours(c: Column) -> Column:
    """The ingredients named in a text, different ones in the text's order, joined by "+"; null if none is."""
    names = F.create_map(*[F.lit(x) for kv in FLAVOURS.items() for x in kv])
    found = F.regexp_extract_all(fold(c), F.lit(r"\b(" + "|".join(FLAVOURS) + r")\b"), F.lit(1))
    return F.nullif(F.array_join(F.array_distinct(F.transform(found, lambda w: names[w])), "+"), F.lit(""))


def money(c: Column) -> Column:
    """An amount with dots or blanks between thousands and a decimal comma, or with a decimal point, as DECIMAL(12,2); null if it is none or not above 0."""
    s = F.regexp_replace(F.trim(c), r"[\s ]|lei|ron|RON|Lei", "")
    comma = F.regexp_replace(F.translate(s, ".", ""), ",", ".")
    n = F.when(s.rlike(r"^\d{1,3}(\.\d{3})+$"), F.translate(s, ".", "")).when(s.rlike(r"^\d{1,3}(\.?\d{3})*,\d{1,2}$|^\d+,\d{1,2}$"), comma).when(s.rlike(r"^\d+(\.\d{1,2})?$"), s)
    v = n.try_cast("decimal(12,2)")
    return F.when(v > 0, v)


def labelled_text(fields: dict[str, Column], missing: str = "<none>") -> Column:
    """ "name: value | name: value", a missing value by its mark, in the order given."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{k}: "), F.coalesce(F.nullif(F.trim(v.cast("string")), F.lit("")), F.lit(missing))) for k, v in fields.items()])


def differing_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """The names of the fields whose two values differ, null equal to null, joined by a comma."""
    return F.array_join(F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in pairs.items()])), ",")


def first_token_of(c: Column, words: list[str]) -> Column:
    """The first of the words, in the list's order, that a folded text holds as a whole word."""
    padded = F.concat(F.lit(" "), F.regexp_replace(fold(c), "[^a-z0-9]+", " "), F.lit(" "))
    return F.coalesce(*[F.when(F.instr(padded, f" {w} ") > 0, F.lit(w)) for w in words])


#: The intervals of sizes that codes mean.
SIZE_RANKS = {"XS": (0, 0), "S": (1, 1), "M": (2, 2), "L": (3, 3), "XL": (4, 4), "MINI": (0, 1), "MEDIUM": (2, 2), "MAXI": (3, 4)}


def size_rank(c: Column) -> Column:
    """The interval of sizes that a code such as XS-S, M, Mini or L-XL means, as a struct lo, hi; null if it is none."""
    low, high = (F.create_map(*[F.lit(x) for k, v in SIZE_RANKS.items() for x in (k, v[i])]) for i in (0, 1))
    parts = F.split(F.upper(F.trim(c)), "-")
    lo, hi = low[F.element_at(parts, 1)], high[F.element_at(parts, -1)]
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi")))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two closed intervals (structs lo, hi) meet; null if one is unknown."""
    return (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])
