"""Units and dimensions: a small grammar for unit expressions and exact conversion.

A dimension is a vector of integer exponents over the base dimensions (mass,
length, time, temperature). A unit is a scale and an offset to the canonical unit of its dimension:
``canonical = value * scale + offset``. Scales are exact fractions, so that
rounding to whole units never depends on binary floating point. Canonical mass
is the gram; canonical length is the centimetre, so that canonical volume (length 3) is the
millilitre.

Grammar of an expression::

    expr   := factor (("*" | "·" | " " | "/") factor)*
    factor := name [ ("^") integer ]

``fl oz`` and ``fl. oz.`` are one name. A unit with an offset (temperature) may only stand alone.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

BASES = ("mass", "length", "time", "temperature")
Dim = tuple[int, int, int, int]
ONE: Dim = (0, 0, 0, 0)
MASS: Dim = (1, 0, 0, 0)
LENGTH: Dim = (0, 1, 0, 0)
VOLUME: Dim = (0, 3, 0, 0)
TIME: Dim = (0, 0, 1, 0)
TEMPERATURE: Dim = (0, 0, 0, 1)


class Unit(NamedTuple):
    dim: Dim
    scale: Fraction
    offset: Fraction = Fraction(0)


_F = Fraction
#: International definitions of the units.
_TABLE: list[tuple[str, Dim, Fraction, Fraction]] = [
    ("mg", MASS, _F(1, 1000), _F(0)),
    ("g gr gram grame grams", MASS, _F(1), _F(0)),
    ("dag deca decagrame", MASS, _F(10), _F(0)),
    ("kg kilo kile kilogram kilograme kilograms", MASS, _F(1000), _F(0)),
    ("t tona tone", MASS, _F(1_000_000), _F(0)),
    ("lb lbs pound pounds", MASS, _F("453.59237"), _F(0)),
    ("oz ounce ounces uncie uncii", MASS, _F("28.349523125"), _F(0)),
    ("ml mililitri mililitru", VOLUME, _F(1), _F(0)),
    ("cl centilitri", VOLUME, _F(10), _F(0)),
    ("dl decilitri", VOLUME, _F(100), _F(0)),
    ("l litru litri liter litre liters litres", VOLUME, _F(1000), _F(0)),
    ("floz", VOLUME, _F("29.5735295625"), _F(0)),
    ("mm", LENGTH, _F(1, 10), _F(0)),
    ("cm", LENGTH, _F(1), _F(0)),
    ("m", LENGTH, _F(100), _F(0)),
    ("in inch inches", LENGTH, _F("2.54"), _F(0)),
    ("s sec", TIME, _F(1), _F(0)),
    ("min", TIME, _F(60), _F(0)),
    ("h ore ora", TIME, _F(3600), _F(0)),
    ("k kelvin", TEMPERATURE, _F(1), _F(0)),
    ("c °c celsius", TEMPERATURE, _F(1), _F("273.15")),
    ("f °f fahrenheit", TEMPERATURE, _F(5, 9), _F("459.67") * _F(5, 9)),
]
UNITS: dict[str, Unit] = {n: Unit(d, s, o) for names, d, s, o in _TABLE for n in names.split()}
#: Units whose amounts are written with a thousands mark, so that 12.500 g is 12500 g, while 13.608 kg is a decimal.
SMALL = frozenset("g gr gram grame grams ml mililitri mililitru mg".split())

_FL_OZ = re.compile(r"\bfl\.?\s*oz\b\.?")
_FACTOR = re.compile(r"\s*([*·/]?)\s*([a-z°]+)\.?(?:\^(-?\d+))?")


@lru_cache(maxsize=4096)
def parse_unit(text: str) -> Unit | None:
    """The unit that an expression such as ``kg``, ``fl. oz`` or ``g/cm^3`` stands for; None if it is none."""
    s = _FL_OZ.sub("floz", text.strip().lower())
    dim, scale, offset, at, n = ONE, Fraction(1), Fraction(0), 0, 0
    while at < len(s):
        m = _FACTOR.match(s, at)
        if not m or (u := UNITS.get(m[2])) is None or (n == 0 and m[1]):
            return None
        power = int(m[3] or 1) * (-1 if m[1] == "/" else 1)
        dim = tuple(a + power * b for a, b in zip(dim, u.dim))  # type: ignore[assignment]
        scale *= u.scale**power
        if u.offset:
            if n or power != 1:
                return None
            offset = u.offset
        at, n = m.end(), n + 1
    if n == 0 or (offset and n > 1):
        return None
    return Unit(dim, scale, offset)


_PARTS = {"½": Fraction(1, 2), "¼": Fraction(1, 4), "¾": Fraction(3, 4)}
#: A number: a vulgar fraction (one sign, or two numbers with a slash, also behind a whole number), or digits with marks between groups.
NUMBER = r"(?:(?:\d{1,3}\s)?\d{1,2}/\d{1,2}(?![\d/])|\d+(?:[.,]\d+)*\s?[½¼¾]?|[½¼¾])"


#: Characters of the longest number that is read; longer runs of digits are no amounts.
LONGEST = 40


def parse_number(text: str, small_unit: bool = False) -> Fraction | None:
    """A number as typed: ``1.5``, ``1,5``, ``12.500`` (12500 before a small unit), ``1.234,5``, ``2½``, ``1/2``, ``1 1/2``.

    Two different marks: the last is the decimal mark. One mark more than once: thousands. One mark
    once: thousands if exactly three digits follow, at most three (not a lone 0) go before and the unit is small, else decimal.
    """
    s = text.strip()
    if len(s) > LONGEST:
        return None
    part = Fraction(0)
    if s and s[-1] in _PARTS:
        part, s = _PARTS[s[-1]], s[:-1].strip()
        if not s:
            return part
    if "/" in s:
        a, b = s.split("/")
        *whole, a = a.split()
        return int(whole[0] if whole else 0) + Fraction(int(a), int(b)) if int(b) else None
    marks = [c for c in s if c in ".,"]
    if not marks:
        return Fraction(int(s)) + part if s.isdigit() else None
    if len(set(marks)) == 2:
        dec = marks[-1]
        s = s.replace("," if dec == "." else ".", "").replace(dec, ".")
        return Fraction(s) + part if s.count(".") == 1 else None
    if len(marks) > 1:
        return Fraction(int(s.replace(marks[0], ""))) + part
    a, b = s.split(marks[0])
    if small_unit and len(b) == 3 and a and a != "0" and len(a) <= 3:
        return Fraction(int(a + b)) + part
    return Fraction(f"{a or 0}.{b}") + part


def to_canonical(value: Fraction, unit: Unit) -> Fraction:
    return value * unit.scale + unit.offset


def half_up(x: Fraction) -> int:
    return (2 * x.numerator + x.denominator) // (2 * x.denominator)


def convert(value: str, unit: str, to: str) -> Fraction | None:
    """Exact conversion between two unit expressions of one dimension; None where they don't fit."""
    a, b = parse_unit(unit), parse_unit(to)
    v = parse_number(value, unit.strip().lower() in SMALL)
    if a is None or b is None or v is None or a.dim != b.dim:
        return None
    return (to_canonical(v, a) - b.offset) / b.scale
