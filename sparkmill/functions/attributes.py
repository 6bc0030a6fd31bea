"""Attributes that a title states by the words of the trade, as column expressions, and replies in a strict form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmill.functions.columns import SPACES
from sparkmill.functions.listings import TITLE_CATEGORY, folded

#: Words of ingredients, folded, and what they are called.
FLAVOURS = {
    "chicken": "chicken", "pui": "chicken", "lamb": "lamb", "miel": "lamb", "beef": "beef", "vita": "beef", "salmon": "salmon", "somon": "salmon", "turkey": "turkey", "curcan": "turkey",
    "duck": "duck", "rata": "duck", "rabbit": "rabbit", "iepure": "rabbit", "tuna": "tuna", "ton": "tuna", "fish": "fish", "peste": "fish", "liver": "liver", "ficat": "liver", "game": "game", "vanat": "game",
    "bizon": "bison", "macrou": "mackerel", "sunca": "ham", "jambon": "ham", "pasare": "poultry", "caprioara": "deer", "venison": "deer", "ren": "reindeer", "gasca": "goose", "sardine": "sardine", "cod": "cod",
    "creveti": "shrimp", "crevete": "shrimp", "shrimp": "shrimp",
}
#: Size codes of two letters, the one that says nothing, and words of sizes.
COMPOUND = "XS-XL|XS-S|XS-M|XS-L|S-XL|S-M|S-L|M-XL|M-L|L-XL"
ALL_SIZES = "XS-XL"
SIZE_WORDS = "mini|medium|maxi"
#: The stages that a title states, folded.
STAGES = r"\b(puppy|junior|adulti|adult|senior)\b"
#: Words of a food's form, folded: those of a pack or a kind first, then dry and wet.
FORM_FIRST = r"\b(conserva|plic(?:uri)?|punguta|jerky|pate|ragout|cremo(?:asa|s)|tub|sos)\b"
FORM_THEN = r"\b(uscata?e?|umeda?)\b"
FORMS = {
    "uscata": "dry", "uscat": "dry", "uscate": "dry", "umeda": "wet", "umed": "wet", "conserva": "tin", "plic": "pouch", "plicuri": "pouch", "punguta": "pouch", "jerky": "dry",
    "pate": "wet", "ragout": "wet", "cremoasa": "wet", "cremos": "wet", "tub": "wet", "sos": "wet",
}


def _named(names: dict[str, str], word: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[word]


def flavour(title_folded: Column) -> Column:
    """The different ingredients in the title's order, joined by "+"; null for none."""
    found = F.regexp_extract_all(title_folded, F.lit(r"\b(" + "|".join(FLAVOURS) + r")\b"), F.lit(1))
    return F.nullif(F.array_join(F.array_distinct(F.transform(found, lambda w: _named(FLAVOURS, w))), "+"), F.lit(""))


def breed_size(title: Column) -> Column:
    """The size of the animal: a code of two letters (none for the one that means all), a word, or the first capital that stands alone.

    A capital is no size behind a number or an apostrophe, before a measure in cm or mm, or before a hyphen and a letter. Goods
    that have a size themselves (leashes, cages, harnesses) have none.
    """
    own_size = folded(title).rlike(TITLE_CATEGORY["accessory"])
    number = r"\d+(?:[.,]\d+)?"
    alone = rf"(?<!\d\s{{0,20}},?\s{{0,20}})(?<!['’]\s{{0,20}})\b(XS|XL|S|M|L)\b(?![\s,]*{number}\s*(?:[x×-]\s*{number}\s*)*(?:cm|mm)\b)(?!-[A-Za-z])"
    g = lambda p: F.nullif(F.regexp_extract(title, p, 1), F.lit(""))
    compound, word, letter = F.upper(g(rf"(?i)\b({COMPOUND})\b")), F.initcap(g(rf"(?i)\b({SIZE_WORDS})\b")), g(alone)
    return F.when(own_size, None).when(compound == ALL_SIZES, None).otherwise(F.coalesce(compound, word, letter))


def life_stage(title: Column) -> Column:
    """puppy, junior, adult or senior, with "+8" where the title states an age such as (8+); null for none."""
    word = F.nullif(F.regexp_extract(folded(title), STAGES, 1), F.lit(""))
    age = F.nullif(F.concat(F.regexp_extract(title, r"\((\d{1,2})\+\)|\b(\d{1,2})\+(?!\d)", 1), F.regexp_extract(title, r"\((\d{1,2})\+\)|\b(\d{1,2})\+(?!\d)", 2)), F.lit(""))
    return F.concat(F.when(word.startswith("adult"), "adult").otherwise(word), F.coalesce(F.concat(F.lit("+"), age), F.lit("")))


def food_form(title_folded: Column) -> Column:
    """tin, pouch, dry or wet by the first word of a pack or kind, else by the first of dry and wet; half-wet is neither."""
    t = F.regexp_replace(title_folded, r"semi[- ]umed", "semi_")
    return _named(FORMS, F.coalesce(F.nullif(F.regexp_extract(t, FORM_FIRST, 1), F.lit("")), F.nullif(F.regexp_extract(t, FORM_THEN, 1), F.lit(""))))


_PRICE_LINE = r"(?m)^[ \t]*PRICE[ \t]*:"
_REPLY = r"(?s)^PRICE[ \t]*:[ \t]*((?:0|[1-9]\d{0,8})(?:\.\d{1,2})?)(?:[ \t]*RON)?[ \t]*\n+[ \t]*RATIONALE[ \t]*:[ \t]*(.+)$"


def parse_reply(text: Column) -> Column:
    """price, rationale, error of a reply of exactly a PRICE line and a RATIONALE; anything else has an error and no price. Null is no reply."""
    s = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), f"^[{SPACES}]+|[{SPACES}]+$", "")
    lines = F.regexp_count(s, F.lit(_PRICE_LINE))
    price, why = F.regexp_extract(s, _REPLY, 1).try_cast("decimal(12,2)"), F.trim(F.regexp_extract(s, _REPLY, 2))
    error = F.when(lines != 1, "not one PRICE line").when(~s.rlike(_REPLY), "not of the form").when(price <= 0, "price is not positive").when(why == "", "no rationale")
    fine = s.isNotNull() & error.isNull()
    return F.when(s.isNotNull(), F.struct(F.when(fine, price).alias("price"), F.when(fine, F.substring(why, 1, 2000)).alias("rationale"), error.alias("error")))


def parse_answer(text: Column) -> Column:
    """score, ok: 1 for Yes and 0 for No, exactly; 0 and not ok for anything else."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.struct(F.when(s == "Yes", 1.0).otherwise(0.0).alias("score"), s.isin("Yes", "No").alias("ok"))
