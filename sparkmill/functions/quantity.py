"""Amounts stated in product titles: content of one unit, number of units, bonus.

The grammar, over a lower-case text without diacritics::

    amount := number ["-" | " "] unit                   one quantity (mass or volume)
    pack   := count ["plicuri" ...] "x" amount          "24 x 85g", "4 plicuri x 0,07 kg"
            | amount "x" count [pieces]                 "85g x 24buc"
            | "set" count pieces "," amount             "set 4 bucati, 800 g"
            | "(" count pieces ")" amount               "(12 buc.) 79 g"
    bonus  := amount mark "la" amount                   "0.4 kg gratis la 3 kg"
            | amount ("plus" | "+" | "(+" | "(") amount mark
            | number "+" number unit                    "4+0,5 kg"

Sizes of a bag (``sac 37 x 26 cm``), weights of the animal (``(caini 2-17 kg)``, ``pt. talie 10 - 20kg``) and
free delivery are no amounts; they are blanked before the scan.
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction
from typing import NamedTuple

from sparkmill.functions.units import MASS, NUMBER, SMALL, UNITS, VOLUME, half_up, parse_number, parse_unit

_UNIT_NAMES = sorted((n for n, u in UNITS.items() if u.dim in (MASS, VOLUME) and n != "floz"), key=len, reverse=True)
_UNIT = r"(?:fl\.?\s?oz|" + "|".join(_UNIT_NAMES) + r")(?![a-z])\.?"
_QTY = re.compile(rf"(?<![\d.,/])({NUMBER})[\s-]?({_UNIT})")
_SUM = re.compile(rf"(?<![\d.,/])({NUMBER})\s?\+\s?({NUMBER})[\s-]?({_UNIT})")
_PIECES = r"(?:buc(?:\.|ati|ata)?|plicuri|plic|conserve|doze|cutii|bucati|pcs|pouches|cans)"
_MASKS = [
    re.compile(r"(?:transport|livrare)\s+gratuit[a]?"),
    re.compile(r"\(\s*(?:caini|pisici|dog|cat|dogs|cats|talie)\b[^)]*\)"),
    re.compile(rf"(?:pt\.?|pentru|for)\s+talie\s+{NUMBER}\s*-\s*{NUMBER}\s*kg"),
    re.compile(rf"(?:sac\s+)?(?<![\d.,]){NUMBER}\s*x\s*{NUMBER}(?:\s*x\s*{NUMBER})?\s*cm\b"),
    re.compile(r"livrare\s+\d+\s*h\b"),
]
_MARK = r"(?:gratis|gratuit|bonus|in plus|cadou|extra|free)(?![a-z])"
_MARK_AFTER = re.compile(rf"\s*{_MARK}")
_LA_AFTER = re.compile(rf"\s*{_MARK}\s+(?:la|for|with)\s*$")
_PLUS_BEFORE = re.compile(r"(?:\+|\bplus|\(\+?)\s*$")
_COUNT_BEFORE = re.compile(rf"(?<![\d.,])(\d{{1,3}})\s*(?:{_PIECES})?\s*x\s*$")
_SET_BEFORE = re.compile(rf"(?:\bset\s+(?:de\s+)?|\(\s*|\bpachet\s+)(\d{{1,3}})\s*{_PIECES}\s*[),]?\s*,?\s*$")
_COUNT_AFTER = re.compile(rf"\s*x\s*(\d{{1,3}})(?:\s*{_PIECES}|(?![\d.,]|\s*x|\s*cm))")
_SET_ANY = re.compile(rf"(?:\bset\s+(?:de\s+)?|\(\s*)(\d{{1,3}})\s*{_PIECES}")
_SPACES = re.compile(r"\s+")
_WORD_AFTER = re.compile(rf"(?<![\d.,/])({NUMBER})[\s-]?([a-z]{{5,10}})\b")
_DOSE = re.compile(r"\d[\s-]?mg\.?$")
_LONG_UNITS = ("kilograme", "grame", "pounds", "ounces", "litri")


def fold(text: str | None) -> str:
    """Lower case without diacritics and with single spaces; vulgar fractions stay."""
    if not text:
        return ""
    s = text.lower().replace("×", "x")
    if not s.isascii():
        s = "".join(c if c in "½¼¾" else "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d)) for c in s)
    return _SPACES.sub(" ", s).strip()


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by at most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Amount(NamedTuple):
    weight_g: int | None
    volume_ml: int | None
    units: int | None
    bonus_g: int | None
    rest: str  #: the folded text without the stated amounts


NOTHING = Amount(None, None, None, None, "")


def read_amount(text: str | None) -> Amount:
    """What a title states; None for what it doesn't. Null and empty texts state nothing."""
    s = fold(text)
    if not s:
        return NOTHING
    for m in _MASKS:
        s = m.sub(lambda x: " " * len(x[0]), s)
    found: list[tuple[int, int, Fraction, tuple, bool]] = []  # start, end, canonical, dimension, is bonus
    taken: list[tuple[int, int]] = []
    if m := _SUM.search(s):
        name = m[3].rstrip(".")
        u = parse_unit(name)
        small = name in SMALL
        a, b = parse_number(m[1], small), parse_number(m[2], small)
        if u and a is not None and b is not None:
            found += [(m.start(), m.end(1), a * u.scale, u.dim, False), (m.start(2), m.end(), b * u.scale, u.dim, True)]
            taken.append((m.start(), m.end()))
    for m in _QTY.finditer(s):
        if any(x < m.end() and m.start() < y for x, y in taken):
            continue
        name = m[2].rstrip(".")
        u, v = parse_unit(name), parse_number(m[1], name in SMALL)
        if u and v is not None:
            found.append((m.start(), m.end(), v * u.scale, u.dim, bool(_MARK_AFTER.match(s, m.end()))))
    # milligrams are the dose of a substance where another amount is stated, or where they are less than a gram
    found = [x for x in found if x[4] or not _DOSE.search(s[x[0] : x[1]])] or [x for x in found if x[2] >= 1]
    if not found:
        for m in _WORD_AFTER.finditer(s):  # a typing slip in a long unit's name
            name = next((n for n in _LONG_UNITS if one_edit(n, m[2])), None)
            if name and (v := parse_number(m[1], name in SMALL)) is not None:
                u = UNITS[name]
                found.append((m.start(), m.end(), v * u.scale, u.dim, bool(_MARK_AFTER.match(s, m.end()))))
    if not found:
        n = _SET_ANY.search(s)
        return Amount(None, None, int(n[1]) if n else None, None, s)
    base = next((x for x in found if not x[4]), None)
    bonus = next((x for x in found if x[4]), None)
    if base is None:
        base, bonus = found[0], None
    elif bonus is None and len(found) > 1:
        second = next((x for x in found if x is not base), None)
        if second and second[0] > base[0] and re.search(r"(?:\+|\bplus)\s*$", s[: second[0]]):
            bonus = second
    count = None
    before, spans = s[: base[0]], [(x[0], x[1]) for x in (base, bonus) if x]
    if m := _COUNT_BEFORE.search(before) or _SET_BEFORE.search(before):
        count = int(m[1])
        spans.append((m.start(), base[0]))
    elif m := _COUNT_AFTER.match(s, base[1]):
        count = int(m[1])
        spans.append((base[1], m.end()))
    elif m := _SET_ANY.search(s):
        count = int(m[1])
        spans.append((m.start(), m.end()))
    if bonus and (m := _MARK_AFTER.match(s, bonus[1])):
        spans.append((m.start(), m.end()))
    chars = list(s)
    for a, b in spans:
        chars[a:b] = " " * (b - a)
    v = half_up(base[2])
    return Amount(
        v if base[3] == MASS else None,
        v if base[3] == VOLUME else None,
        count if count and count > 1 else (1 if count == 1 else None),
        half_up(bonus[2]) if bonus and bonus[3] == MASS else None,
        "".join(chars),
    )
