"""What a shop's listing says, as column expressions: overlap keys, brands, category, species, stage, and the texts made from them."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkmill.functions.columns import SPACES, single_spaces

#: Letters that don't decompose, and curly quotes.
LETTERS = {"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "đ": "d", "’": "'", "‘": "'"}
#: Words of shop prose that tell nothing about the product, folded.
PROSE = (
    "hrana uscata umeda pentru caini cainii pisici pisica catel catei pui adult adulti junior senior recompense delicioase conserva conserve"
    " plic plicuri punga sac saci cu si de la fara in pe gratuit gratis bonus"
).split()
#: Bare units and pack forms.
UNITS = "kg g gr grame mg ml l buc x".split()
_UNIT = "(?:grame|kg|ml|gr|g|l)"
_NUMBER = r"\d+(?:[.,]\d+)?"
_BONUS = rf"({_NUMBER})\s*({_UNIT})?\s*\+\s*({_NUMBER})\s*({_UNIT})\b"
_PACK = rf"(\d+)\s*[x×]\s*({_NUMBER})\s*({_UNIT})\b"
_PLAIN = rf"({_NUMBER})\s*({_UNIT})\b"

#: Brand values that stand for another brand, and the ends that name a line of a brand, the longest first.
BRAND_ALIASES = {"pro plan": "purina", "dog chow": "purina", "cat chow": "purina", "affinity advance": "advance", "julius k-9": "julius-k9", "m-petss": "m-pets"}
BRAND_ENDS = ["science plan", "pet nutrition", "pro plan", "cat chow", "dog chow", "premium", "care", "life", "expert", "fresh", "classe", "one"]
#: Brand values that are codes of distributors.
DISTRIBUTORS = ["opti", "ipts"]

#: The shops' own kinds of goods by category, as path segments and as product types.
FOOD = [
    "hrana-uscata-caini", "hrana-uscata-pisici", "hrana-umeda-caini", "hrana-umeda-pisici", "recompense-delicioase-caini", "recompense-delicioase-pisici",
    "hrana umeda pentru pisici", "hrana uscata pentru caini", "recompense pentru caini", "hrana uscata pentru pisici", "hrana umeda pentru caini", "recompense pentru pisici",
    "hrana uscata pentru catei", "hrana uscata pentru pisicute", "hrana semi-umeda pentru caini", "hrana semi-umeda pentru pisici", "hrana umeda pentru pisicute",
    "salam pentru caini", "lapte praf", "pesti albi la punga", "snack lichid pentru pisici", "snack nuggets cu branza",
]
ACCESSORY = [
    "accesorii-caini", "accesorii-pisici", "igiena-si-ingrijire-caini", "igiena-si-ingrijire-pisici",
    "sampon pentru caini", "ingrijire", "accesorii racoritoare", "accesorii", "sampon pentru caini si pisici", "sisal pentru pisici", "zgarda pentru caini", "imbracaminte",
]
LITTER = ["asternut-litiera-nisip-silicat", "nisip pentru litiera", "asternut"]
TOY = ["jucarii-caini", "jucarie pentru pisici", "jucarie pentru caini"]
#: Words of a title that tell the category and the species, folded.
TITLE_CATEGORY = {"litter": r"\b(nisip|litiera)\b", "toy": r"\bjucarie\w*\b", "accessory": r"\b(zgarda|zgarzi|lesa|lese|cusca|custi|transport)\b|^ham\b"}
DOG = r"\b(caini|caine|catei|catelus\w*|canine|dogs?|puppy)\b"
CAT = r"\b(pisic\w*|felin\w*|cats?|kitten)\b"
#: Kinds of goods that are named for neither or both species, so that they tell none.
NO_SPECIES = ["asternut-litiera-nisip-silicat", "sampon pentru caini si pisici", "sisal pentru pisici", "snack lichid pentru pisici"]
#: Words of a stage in a title, folded, and what they are called where that is another word.
STAGE = r"\b(kitten|pisoi|pisicute|puppy|catei|catelus|catelusi|junior|senior|mature)\b"
STAGE_NAMES = {"pisoi": "kitten", "pisicute": "kitten", "catei": "puppy", "catelus": "puppy", "catelusi": "puppy"}
#: Regulated goods by words of a title, spaces part of some, in the order in which they are looked for.
REGULATED = [
    "antiparazitar", "deparazitare", "vaccin", "pipeta", "pipete", "antibiotic", "veterinary diet", "dieta veterinara", "diete veterinare",
    "prescription diet", "vet diet", "comprimate", "antiinflamator", " vd ", " vhn ", " pd ", "hidrolizat", "hydrolyzed",
]
_WEIGHT = r"\s*(?:kg|g|ml|l)\b"
#: Patterns of titles that are hard to read, folded; "^" stands at the start.
HARD_CASES = {
    "weight_leading_token": rf"^\s*{_NUMBER}{_WEIGHT}", "decimal_comma": rf"\d+,\d+{_WEIGHT}", "decimal_point": rf"\d+\.\d+{_WEIGHT}", "missing_diacritics": r"\b(uscata|umeda|caini|catel)\b",
    "multipack": rf"\d+\s*[x×]\s*{_NUMBER}{_WEIGHT}", "dosage_band": r"\b\d+\s*-\s*\d+\s*kg\b", "breed_size_code": r"\b(mini|medium|maxi|junior|senior|xs-xl|xs|xl)\b",
    "ro_descriptive_prefix": r"^(hrana|recompense)\b", "special_char_brand": r"(smolke|hill's)",
}


@F.pandas_udf(StringType())
def _marks_off(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in text], dtype="object")


def plain_letters(c: Column) -> Column:
    """Letters without marks (NFKD), letters that don't decompose by their plain ones, straight quotes; case and spaces stay."""
    s = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LETTERS.items(), c)
    # only texts beyond ASCII leave the JVM
    return F.coalesce(_marks_off(F.when(~s.rlike(r"^\p{ASCII}*$"), s)), s)


def folded(c: Column) -> Column:
    return plain_letters(F.lower(c))


def _grams(number: Column, unit: Column) -> Column:
    return (F.replace(number, F.lit(","), F.lit(".")).try_cast("decimal(20,4)") * F.when(unit.isin("kg", "l"), 1000).otherwise(1)).cast("decimal(24,4)")


def base_grams(text: Column) -> Column:
    """Grams or millilitres that a folded title states: what stands before a "+ bonus", a pack's count times its unit, or the first amount; null for none, or for one beyond a 64-bit number."""
    g = lambda p, i: F.regexp_extract(text, p, i)
    bonus = _grams(g(_BONUS, 1), F.coalesce(F.nullif(g(_BONUS, 2), F.lit("")), g(_BONUS, 4)))
    pack = (_grams(g(_PACK, 2), g(_PACK, 3)) * g(_PACK, 1).try_cast("decimal(10,0)")).cast("decimal(34,4)")
    plain = _grams(g(_PLAIN, 1), g(_PLAIN, 2))
    return F.floor(F.when(text.rlike(_BONUS), bonus).when(text.rlike(_PACK), pack).when(text.rlike(_PLAIN), plain)).try_cast("bigint")


def bonus_grams(text: Column) -> Column:
    """Grams of a "+ bonus" in a folded title; 0 for none."""
    g = _grams(F.regexp_extract(text, _BONUS, 3), F.regexp_extract(text, _BONUS, 4))
    return F.when(text.rlike(_BONUS), F.floor(g).try_cast("bigint")).otherwise(F.when(text.isNotNull(), F.lit(0)))


def _telling(tokens: Column) -> Column:
    """Tokens that are neither prose nor a unit, a number or an amount."""
    stop = F.array(*map(F.lit, PROSE + UNITS))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t) & ~t.rlike(r"^\d+(?:kg|g|gr|grame|mg|ml|l)?$"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9']+"), F.lit(0))


def key_brand(brand: Column, title_folded: Column) -> Column:
    """The folded brand with single spaces; without one the first telling word of the title; "" where there is none."""
    given = F.when(F.trim(brand) != "", single_spaces(folded(brand)))
    return F.coalesce(given, F.try_element_at(_telling(_tokens(title_folded)), F.lit(1)), F.lit(""))


def line_words(title_folded: Column, brand_folded: Column) -> Column:
    """Different telling words of the title in order of the alphabet, with the brand's words taken out of it wherever they stand."""
    words = F.filter(F.split(brand_folded, f"[{SPACES}]+"), lambda w: w != "")
    rest = F.aggregate(words, title_folded, lambda t, w: F.replace(t, w, F.lit(" ")))
    return F.array_sort(F.array_distinct(_telling(_tokens(rest))))


def overlap_key(brand: Column, words: Column, weight: Column, bonus: Column) -> Column:
    """ "brand | words | 4000g +500g"; null where the title states no amount above 0, or no brand or word is left. A bonus pack is another unit than the plain one."""
    text = F.concat(brand, F.lit(" | "), F.array_join(words, " "), F.lit(" | "), weight.cast("string"), F.lit("g"), F.when(bonus > 0, F.concat(F.lit(" +"), bonus.cast("string"), F.lit("g"))).otherwise(""))
    return F.when((weight > 0) & (brand != "") & (F.size(words) > 0), text)


def _case_plain(brand: Column) -> Column:
    return F.trim(F.lower(F.translate(brand, "’‘", "''")))


def _without_end(s: Column) -> Column:
    cut = F.coalesce(*[F.when(s.endswith(f" {e}"), F.trim(F.substring(s, F.lit(1), F.length(s) - len(e) - 1))) for e in BRAND_ENDS], F.lit(""))
    return F.coalesce(F.when(~s.isin(BRAND_ENDS), F.nullif(cut, F.lit(""))), s)


def canonical_brand(brand: Column) -> Column:
    """Lower case, straight quotes; an alias by its brand, else without one end that names a line, never emptied. Null for blank."""
    s = F.nullif(_case_plain(brand), F.lit(""))
    alias = F.create_map(*[F.lit(x) for kv in BRAND_ALIASES.items() for x in kv])
    return F.coalesce(alias[s], _without_end(s))


def brand_span(brand: Column) -> Column:
    """The part of a brand value that is the maker's name: all of an alias, else what is left without the end that names a line."""
    s = F.nullif(_case_plain(brand), F.lit(""))
    return F.when(s.isin(list(BRAND_ALIASES)), s).otherwise(_without_end(s))


def distributor(brand: Column) -> Column:
    return F.coalesce(F.lower(brand).isin(DISTRIBUTORS), F.lit(False))


def path_segment(url: Column) -> Column:
    """The first folder of a url's path; null where the path has none."""
    return F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/]+/([^/]+)/", 1), F.lit(""))


def category(kind: Column, title_folded: Column, otherwise: str | None = None) -> Column:
    """food, accessory, litter or toy: by the shop's own kind (a path segment or a product type), else by words of the title, else otherwise."""
    k = F.lower(F.trim(kind))
    by_kind = F.when(k.isin(FOOD), "food").when(k.isin(ACCESSORY), "accessory").when(k.isin(LITTER), "litter").when(k.isin(TOY), "toy")
    by_title = F.coalesce(*[F.when(title_folded.rlike(p), F.lit(c)) for c, p in TITLE_CATEGORY.items()])
    return F.coalesce(by_kind, by_title, F.lit(otherwise).cast("string"))


def title_species(title_folded: Column) -> Column:
    """dog or cat by words of the title; null where it names neither or both."""
    dog, cat = title_folded.rlike(DOG), title_folded.rlike(CAT)
    return F.when(dog & ~cat, "dog").when(cat & ~dog, "cat")


def species(kind: Column, title_folded: Column, category_: Column) -> Column:
    """Litter is for cats; else by the shop's own kind of goods, where this names one species; else by the title."""
    k = F.lower(F.trim(kind))
    known = k.isin(FOOD + ACCESSORY + TOY) & ~k.isin(NO_SPECIES)
    by_kind = F.when(known & k.rlike(r"caini|catei"), "dog").when(known & k.rlike("pisic"), "cat")
    return F.when(category_ == "litter", "cat").otherwise(F.coalesce(by_kind, title_species(title_folded)))


def stage_marker(extracted: Column, title_folded: Column) -> Column:
    """The recorded stage in lower case, else the first stage word of the title; null for none."""
    word = F.nullif(F.regexp_extract(title_folded, STAGE, 1), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in STAGE_NAMES.items() for x in kv])
    return F.coalesce(F.lower(F.nullif(extracted, F.lit(""))), names[word], word)


def flavour_set(flavour: Column) -> Column:
    """The different flavours of "a+b" in order of the alphabet; empty for none."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(flavour, F.lit(""))), r"\+"), lambda f: f != "")))


def hard_cases(title_folded: Column) -> Column:
    """Names of the ways in which a title is hard to read, in order of the alphabet."""
    cases = [F.when(title_folded.rlike(p), F.lit(k)) for k, p in HARD_CASES.items()]
    cases += [F.when(base_grams(title_folded).isNull(), F.lit("no_weight_in_title")), F.when(bonus_grams(title_folded) > 0, F.lit("bonus_pack"))]
    return F.array_sort(F.array_compact(F.array(*cases)))


def regulated_word(title_folded: Column) -> Column:
    """The first word of regulated goods, in the list's order, that the padded title holds; trimmed."""
    padded = F.concat(F.lit(" "), single_spaces(title_folded), F.lit(" "))
    return F.coalesce(*[F.when(F.instr(padded, w) > 0, F.lit(w.strip())) for w in REGULATED])


def clean_text(c: Column, most: int = 160) -> Column:
    """Straight single quotes for double ones, single spaces, at most so many characters."""
    return F.substring(single_spaces(F.replace(c, F.lit('"'), F.lit("'"))), 1, most)


def size_text(weight: Column, volume: Column) -> Column:
    return F.coalesce(F.concat(weight.cast("string"), F.lit(" g")), F.concat(volume.cast("string"), F.lit(" ml")), F.lit(""))


def parts_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each followed by a zero byte, so that no two lists of parts are alike; null if a part is."""
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\x00"))]), 256)


def embedding_text(brand: Column, line: Column, title: Column, weight: Column, volume: Column, count: Column, stage: Column, flavour: Column, size: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    amount = F.coalesce(F.concat(weight.cast("string"), F.lit("g")), F.concat(volume.cast("string"), F.lit("ml")))
    tail = F.concat_ws(" ", amount, F.when(count != 1, F.concat(F.lit("x"), count.cast("string"))), some(stage), some(flavour), some(size))
    return F.trim(F.concat(F.coalesce(brand, F.lit("")), F.lit(" "), F.coalesce(some(line), title, F.lit("")), F.lit(" "), tail))


def comparable(c: Column, numeric: bool = False) -> Column:
    """A label as it is compared: a whole number, else lower case without blanks; null for blank."""
    s = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return s.try_cast("bigint").cast("string") if numeric else F.replace(F.lower(s), F.lit(" "), F.lit(""))


def public_name(c: Column, aliases: dict[str, str]) -> Column:
    """A shop's alias, else "shop_" and four hexadecimal digits of its name's SHA-256."""
    named = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[c] if aliases else F.lit(None)
    return F.coalesce(named, F.concat(F.lit("shop_"), F.substring(F.sha2(c, 256), 1, 4)))
