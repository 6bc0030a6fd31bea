"""Reading a product title: species, age group, main ingredient, breed size, food form, amounts, and the name that is left.

The words are the vocabulary of the trade in Romanian and English; whatever is neither an amount
nor one of these words is the name (brand and line, in any order).
"""

from __future__ import annotations

import re
from typing import NamedTuple

from sparkmill.functions.quantity import Amount, fold, read_amount

#: The words of each attribute, folded, and what they stand for.
AGE = {
    "puppy & junior": "young", "kitten & junior": "young", "puppy": "young", "kitten": "young", "junior": "young", "catelusi": "young", "catel": "young", "pisoi": "young", "pui de pisica": "young",
    "caini adulti": "adult", "pisici adulte": "adult", "adulti": "adult", "adulte": "adult", "adult": "adult",
    "seniori 8+": "senior", "seniori": "senior", "senior": "senior", "mature 10+": "senior", "mature": "senior", "ageing": "senior", "varstnici": "senior", "varstnice": "senior",
}
INGREDIENT = {
    "chicken": "chicken", "pui": "chicken", "duck": "duck", "rata": "duck", "lamb": "lamb", "miel": "lamb", "beef": "beef", "vita": "beef", "salmon": "salmon", "somon": "salmon",
    "tuna": "tuna", "ton": "tuna", "trout": "trout", "pastrav": "trout", "herring": "herring", "hering": "herring", "turkey": "turkey", "curcan": "turkey", "rabbit": "rabbit", "iepure": "rabbit",
    "pork": "pork", "porc": "pork", "venison": "venison", "caprioara": "venison",
}
SPECIES = {"caini": "dog", "caine": "dog", "dog": "dog", "dogs": "dog", "pisici": "cat", "pisica": "cat", "cat": "cat", "cats": "cat"}
SIZE = {
    "talie mica": "mini", "small breed": "mini", "mini": "mini", "xs-s": "mini", "talie medie": "medium", "medium breed": "medium", "medium": "medium", "m": "medium",
    "talie mare": "maxi", "large breed": "maxi", "maxi": "maxi", "l-xl": "maxi",
}
FORM = {
    "hrana uscata": "dry", "dry food": "dry", "granule": "dry", "hrana umeda": "wet", "wet food": "wet", "conserva": "wet",
    "supliment lichid": "liquid", "supplement oil": "liquid", "ulei": "liquid", "lichid": "liquid",
}
ADVERTS = [
    "transport gratuit", "livrare gratuita", "livrare 24h", "oferta limitata", "stoc limitat", "cel mai mic pret", "super pret", "super oferta", "calitate premium", "produs original",
    "recomandat de crescatori", "pachet avantajos", "black deal", "best seller", "inclus separat", "reducere", "promotie", "[promo]", "promo", "nou!", "oferta", "cantitate:",
]
LINKS = ["gust de", "bogat in", "cu gust de", "pentru", "pt.", "pt", "for", "cu", "with", "plus", "in plus", "la"]


def _any(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_ADS = re.compile(rf"(?<![a-z0-9])(?:{_any(ADVERTS)})(?![a-z0-9])|-?\d+\s?%|★+")
_ATTR = re.compile(
    rf"(?<![a-z0-9])(?:(?P<form>{_any(FORM)})|(?P<age>{_any(AGE)})|(?P<size>{_any(SIZE)})|(?P<species>{_any(SPECIES)})|(?P<ing>{_any(INGREDIENT)})|(?P<link>{_any(LINKS)}))(?![a-z0-9+])"
)
_CAMEL = re.compile(r"(?<=[a-zăâîșț])(?=[A-ZĂÂÎȘȚ][a-zăâîșț])")
_WORDS = re.compile(r"[a-z0-9]+(?:'[a-z]+)?")
_FIELDS = {"form": FORM, "age": AGE, "size": SIZE, "species": SPECIES, "ing": INGREDIENT}


class Title(NamedTuple):
    amount: Amount
    species: str | None
    age: str | None
    ingredient: str | None
    size: str | None
    form: str | None
    name: tuple[str, ...]  #: words that are no attribute, in order


def strip_marks(text: str) -> str:
    return text.replace("®", " ").replace("™", " ")


def read_title(text: str | None) -> Title:
    """Every attribute that the title states, the first where it states several; None for the others. A null or empty text has none and no name."""
    if not text or not text.strip():
        return Title(read_amount(None), None, None, None, None, None, ())
    amount = read_amount(_CAMEL.sub(" ", strip_marks(text)))
    s = _ADS.sub(" | ", amount.rest)
    got: dict[str, str] = {}
    parts, at = [], 0
    for m in _ATTR.finditer(s):
        kind = m.lastgroup
        parts.append(s[at : m.start()])
        parts.append(" ")
        at = m.end()
        if kind != "link":
            got.setdefault(kind, _FIELDS[kind][m[0]])
            if kind == "age":
                got.setdefault("young_of", "cat" if m[0] in ("kitten", "kitten & junior", "pisoi", "pui de pisica", "pisici adulte", "adulte", "varstnice") else "dog" if m[0] in ("puppy", "puppy & junior", "catelusi", "caini adulti", "adulti", "varstnici") else "")
    parts.append(s[at:])
    words = tuple(w for w in _WORDS.findall("".join(parts)) if len(w) > 1 or w == "&")
    return Title(amount, got.get("species") or got.get("young_of") or None, got.get("age"), got.get("ing"), got.get("size"), got.get("form"), words)


__all__ = ["Title", "read_title", "fold"]
