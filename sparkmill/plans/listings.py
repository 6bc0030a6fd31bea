"""Listings: keys across shops, brands, categories, texts, candidates and the checks of labels and fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkmill.functions import columns as C
from sparkmill.functions import listings as L
from sparkmill.operators import labels as B
from sparkmill.operators import similarity as V
from sparkmill.plans.aggregates import _LABELLED, _labelled
from sparkmill.session import table as T


def _keyed(s, d):
    n = T(s, d, "norm_listings").select("id", "sample_source", "brand", L.folded(F.col("sample_title")).alias("t"))
    n = n.withColumns({"b": L.key_brand(F.col("brand"), F.col("t")), "w": L.base_grams(F.col("t")), "x": L.bonus_grams(F.col("t"))})
    return n.select("id", "sample_source", L.overlap_key(F.col("b"), L.line_words(F.col("t"), F.col("b")), F.col("w"), F.col("x")).alias("key"))


def overlap_keys(s, d):
    """Every listing's key by which shops' listings of one product meet; null where it has none."""
    return _keyed(s, d).select("id", "key")


def overlap_shared(s, d):
    """Keys that more than one shop has, by how many."""
    k = _keyed(s, d).where("key IS NOT NULL AND sample_source IS NOT NULL").groupBy("key").agg(F.count_distinct("sample_source").alias("sources"))
    return k.where("sources > 1").groupBy("sources").agg(F.count("*").alias("keys"))


def canonical_brands(s, d):
    b = F.col("brand")
    return T(s, d, "norm_listings").select("id", L.canonical_brand(b).alias("canonical"), L.brand_span(b).alias("span"), L.distributor(L.canonical_brand(b)).alias("distributor"))


def listing_categories(s, d):
    """Category and species of every entry, by its product type, else by its title; food where nothing else is told."""
    n = T(s, d, "category_listings").where("id IS NOT NULL").select("id", "product_type", L.folded(F.coalesce("title", F.lit(""))).alias("t"))
    n = n.withColumn("category", L.category(F.col("product_type"), F.col("t"), "food"))
    return n.select("id", "category", L.species(F.col("product_type"), F.col("t"), F.col("category")).alias("species"))


def url_categories(s, d):
    """Listings by source and category, by the first folder of their url, else by their title."""
    n = T(s, d, "raw_listings").select("source", L.path_segment(F.col("url")).alias("k"), L.folded(F.coalesce("title", F.lit(""))).alias("t"))
    n = n.withColumn("category", L.category(F.col("k"), F.col("t")))
    return n.groupBy("source", "category", L.species(F.col("k"), F.col("t"), F.col("category")).alias("species")).agg(F.count("*").alias("n"))


def stage_and_flavours(s, d):
    t = L.folded(F.col("sample_title"))
    return T(s, d, "norm_listings").select("id", L.stage_marker(F.col("life_stage"), t).alias("stage"), F.array_join(L.flavour_set(F.col("flavour")), ",").alias("flavours"))


def hard_case_labels(s, d):
    n = T(s, d, "norm_listings").where("sample_title IS NOT NULL").select("id", L.folded(F.col("sample_title")).alias("t"))
    return n.select("id", F.array_join(L.hard_cases(F.col("t")), ",").alias("cases"))


def quarantine_reasons(s, d):
    """Entries of regulated goods with all their signals: a word of the title, and a product type for a vet's diet."""
    word = L.regulated_word(L.folded(F.col("title")))
    kind = F.lower("product_type")
    reason = F.concat_ws(";", F.concat(F.lit("title_token:"), word), F.when(kind.contains("veterinar"), F.concat(F.lit("product_type:"), kind)))
    return T(s, d, "category_listings").select("id", F.nullif(reason, F.lit("")).alias("reason"))


def prompt_texts(s, d):
    """Titles as they may stand in a quoted line, the pair's key, and the key under which an answer about them is kept."""
    m = T(s, d, "product_matches").where("id IS NOT NULL").select("id", F.concat(F.col("product_id").cast("string"), F.lit(":"), "source").alias("link_key"), L.clean_text(F.col("competitor_title")).alias("title"))
    return m.withColumn("request", L.parts_key(F.col("link_key"), F.col("title")))


def embedding_texts(s, d):
    c = F.col
    return T(s, d, "norm_listings").select("id", L.embedding_text(c("brand"), c("product_line"), c("sample_title"), c("net_weight_g"), c("net_volume_ml"), c("pack_count"), c("life_stage"), c("flavour"), c("breed_size_class")).alias("text"), L.size_text(c("net_weight_g"), c("net_volume_ml")).alias("size"))


@F.pandas_udf(StringType())
def _sorted_json(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            return json.dumps(json.loads(t), sort_keys=True)
        except ValueError:
            return None

    return pd.Series([None if t is None else one(t) for t in text], dtype="object")


def payload_hashes(s, d):
    """Hashes of the payloads with their keys in order; null for none and for what is no JSON."""
    return T(s, d, "raw_listings").where("raw_payload IS NOT NULL").select("id", F.sha2(_sorted_json("raw_payload"), 256).alias("hash"))


def blocked_candidates(s, d):
    """Per product the listings with its brand's key: how many, and the least and greatest id. A product without a key has none. Listings are counted by key before they meet the products."""
    p = T(s, d, "products").select(F.col("id").alias("product_id"), C.blocking_key(F.col("brand")).alias("k")).where("k IS NOT NULL")
    n = T(s, d, "norm_listings").where("brand_blocking_key <> ''").groupBy(F.col("brand_blocking_key").alias("k")).agg(F.count("*").alias("candidates"), F.min("id").alias("first"), F.max("id").alias("last"))
    return p.join(n, "k").select("product_id", "candidates", "first", "last")


#: What a title says of a new recipe.
REFORMULATED = ["%noua formula%", "%noua reteta%", "%reformulat%", "%new formula%", "%new recipe%", "%formula imbunatatita%", "%generatie noua%"]


def reformulated_pairs(s, d):
    """Pairs of listings of one brand key and line of which a title speaks of a new recipe, or says that it is new. Only these meet the others, so a hot line doesn't pair all with all."""
    t = F.lower("sample_title")
    marked = F.coalesce(*[F.when(t.like(p), F.lit(True)) for p in [*REFORMULATED, "%nou!%"]], F.lit(False))
    n = T(s, d, "norm_listings").where("brand_blocking_key IS NOT NULL AND product_line IS NOT NULL").select("content_hash", "brand_blocking_key", F.lower(F.trim("product_line")).alias("line"), marked.alias("m"))
    a = n.where("m").select(F.col("content_hash").alias("x"), "brand_blocking_key", "line")
    j = a.join(n, ["brand_blocking_key", "line"]).where("x <> content_hash")
    return j.select(F.least("x", "content_hash").alias("a"), F.greatest("x", "content_hash").alias("b")).distinct()


def _variant_pairs(s, d, same, other):
    """Pairs of classes of a brand key with equal amounts (null equals null) and equal same, but another value of other."""
    keys = ["brand_blocking_key", "net_weight_g", "net_volume_ml", "pack_count", "bonus_weight_g", *same]
    n = T(s, d, "norm_listings").where(f"brand_blocking_key IS NOT NULL AND {other} IS NOT NULL").groupBy(*keys, other).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    a, b = n.alias("a"), n.alias("b")
    on = F.col("a.brand_blocking_key") == F.col("b.brand_blocking_key")
    for k in keys[1:]:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    j = a.join(b, on & (F.col(f"a.{other}") < F.col(f"b.{other}")))
    return j.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def same_quantity_other_stage(s, d):
    return _variant_pairs(s, d, ["flavour"], "life_stage")


def same_quantity_other_size(s, d):
    return _variant_pairs(s, d, [], "breed_size_code")


def same_capacity_other_flavour(s, d):
    return _variant_pairs(s, d, [], "flavour")


def resolved_variants(s, d):
    """Each matched link with the newest listing of its source and url whose title states the product's weight; null where none does."""
    m = T(s, d, "product_matches").join(T(s, d, "products").select(F.col("id").alias("product_id"), "net_weight_g"), "product_id").where("url IS NOT NULL AND source IS NOT NULL").select("product_id", "source", "url", "net_weight_g").distinct()
    r = T(s, d, "raw_listings").where("url IS NOT NULL AND source IS NOT NULL").select("id", "source", "url", L.base_grams(L.folded(F.col("title"))).alias("w"))
    r = r.where("w IS NOT NULL").groupBy("source", "url", "w").agg(F.max("id").alias("listing_id"))
    return m.join(r.withColumnRenamed("w", "net_weight_g"), ["source", "url", "net_weight_g"], "left").select("product_id", "source", "url", "listing_id")


def competitor_series(s, d):
    """Every product's price series of each shop, days ascending, as text."""
    m = T(s, d, "product_matches").where("product_id IS NOT NULL AND source IS NOT NULL AND price_date IS NOT NULL AND competitor_price IS NOT NULL")
    day = m.groupBy("product_id", "source", "price_date").agg(F.max_by("competitor_price", F.struct("created_at", "id")).alias("p"))
    point = F.concat(F.date_format("price_date", "yyyy-MM-dd"), F.lit("="), F.col("p").cast("string"))
    return day.groupBy("product_id", "source").agg(F.array_join(F.array_sort(F.collect_list(point)), " ").alias("series"))


def split_compatibility(s, d):
    """Whether the first annotators' pairs stand in the others' file with equal tier and split: pairs by finding."""
    p = T(s, d, "phase3_labels").where("pair_id IS NOT NULL").withColumn("mine", F.col("labeled_by").isin("annotator_0", "annotator_1"))
    pick = lambda c: p.where(c).groupBy("pair_id").agg(F.min("split").alias("split"), F.min("tier").alias("tier"), F.min("label").alias("label"))
    return B.compatible(pick("mine"), pick("NOT mine"), "pair_id", ["split", "tier"], "label").groupBy("finding").agg(F.count("*").alias("n"))


def tier_metrics(s, d):
    """Every tier's positives, negatives and rates at 0.5, tiers without scored pairs too; below five positives only the false-positive rate is told."""
    tiers = T(s, d, "phase3_labels").where("tier IS NOT NULL").select("tier").distinct()
    return B.supported_metrics(tiers, _labelled(s, d), "tier", F.col("score") >= 0.5, F.col("actual"), 5)


def field_accuracy(s, d):
    """What titles state against what is recorded, by field and for all fields (null)."""
    t = L.folded(F.col("sample_title"))
    n = T(s, d, "norm_listings").select(
        F.nullif(L.comparable(L.stage_marker(F.lit(None), t)), F.lit("")).alias("life_stage_a"), L.comparable(F.col("life_stage")).alias("life_stage_b"),
        L.comparable(C.flavours(F.col("sample_title"))).alias("flavour_a"), L.comparable(F.col("flavour")).alias("flavour_b"),
        L.comparable(L.base_grams(t), True).alias("net_weight_g_a"), L.comparable(F.col("net_weight_g"), True).alias("net_weight_g_b"),
    )
    return B.field_tallies(n, ["life_stage", "flavour", "net_weight_g"])


def species_mismatches(s, d):
    """Listings per source whose title names another species than is recorded."""
    n = T(s, d, "norm_listings").select("sample_source", "species", L.title_species(L.folded(F.col("sample_title"))).alias("t"))
    return n.where("t <> species").groupBy(F.col("sample_source").alias("source"), "t").agg(F.count("*").alias("n"))


def _decisions(s, d):
    """Labels as decisions on a pair in the order of their occurrences; the last annotator's are reviews."""
    p = T(s, d, "phase3_labels").where("pair_id IS NOT NULL AND occurrence_id IS NOT NULL AND label IS NOT NULL")
    return p.select("pair_id", "occurrence_id", "label", (F.col("labeled_by") == "annotator_3").alias("review")).distinct()


def revised_labels(s, d):
    """Each pair's decision after later ones: the last holds; changes by a review are revisions, others conflicts."""
    return B.merge_revisions(_decisions(s, d), "pair_id", ["occurrence_id", "label"], "label", "review")


def seeded_sample(s, d):
    """Two hundred listings in an order that only the seed and their ids decide."""
    n = T(s, d, "norm_listings").where("id IS NOT NULL").select("id", F.md5(F.concat(F.lit("7:"), F.col("id").cast("string"))).alias("u"))
    return n.orderBy("u", "id").limit(200).select("id")


def public_shops(s, d):
    r = T(s, d, "raw_listings").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    name = L.public_name(F.col("source"), {"latranel": "shop_a", "mustacel": "shop_b", "codalunga": "shop_c"})
    return r.select(name.alias("shop"), F.concat(F.lit("Shop "), F.upper(F.substring(name, 6, 60))).alias("label"), "n")


def preferred_weights(s, d):
    """Our own weight of a product before what its title states."""
    return T(s, d, "products").select("id", F.coalesce(F.col("net_weight_g").cast("bigint"), L.base_grams(L.folded(F.col("title")))).alias("weight"))


def leaking_nodes(s, d):
    """Listings of test pairs that train pairs have too: how many, and rows of each side that they touch."""
    from sparkmill.operators.labels import split_of

    p = T(s, d, "phase3_labels").select(split_of(F.col("split")).alias("sp"), F.explode(F.array("left_content_hash", "right_content_hash")).alias("h")).where("h IS NOT NULL AND sp IS NOT NULL")
    g = p.groupBy("h").agg(F.count_if(F.col("sp") == "train").alias("tr"), F.count_if(F.col("sp") == "test").alias("te")).where("tr > 0 AND te > 0")
    return g.agg(F.count("*").alias("listings"), F.coalesce(F.sum("tr"), F.lit(0)).alias("train_rows"), F.coalesce(F.sum("te"), F.lit(0)).alias("test_rows"))


def dominant_features(s, d):
    """Share of labelled pairs that differ in a feature, and whether it is more than two fifths."""
    n = T(s, d, "norm_listings").groupBy("content_hash").agg(*[F.min(c).alias(c) for c in ("net_weight_g", "life_stage", "flavour", "species")])
    p = T(s, d, "phase3_labels").where("occurrence_id IS NOT NULL").select("occurrence_id", "left_content_hash", "right_content_hash").distinct()
    a, b = n.alias("a"), n.alias("b")
    j = p.join(a, F.col("left_content_hash") == F.col("a.content_hash")).join(b, F.col("right_content_hash") == F.col("b.content_hash"))
    return B.differing_shares(j, {c: (F.col(f"a.{c}"), F.col(f"b.{c}")) for c in ("net_weight_g", "life_stage", "flavour", "species")}, 0.4)


def display_prices(s, d):
    """Prices as they are shown: two decimals with separators, n/a for none, and the signed change against the price before a reduction."""
    p, c = F.col("price"), F.col("compare_at_price")
    pct = F.round((p - c) * 100 / c, 1).cast("decimal(12,1)")
    shown = F.concat(F.when(pct >= 0, "+").otherwise(""), pct.cast("string"), F.lit("%"))
    return T(s, d, "raw_listings").select("id", F.coalesce(F.concat(F.format_number(p, 2), F.lit(" RON")), F.lit("n/a")).alias("price"), F.coalesce(F.when(c > 0, shown), F.lit("n/a")).alias("change"), F.coalesce(F.date_format("collected_date", "yyyy-MM-dd"), F.lit("n/a")).alias("day"))


def label_unions(s, d):
    """Labelled files put together: rows and pairs of each annotator and of all."""
    p = T(s, d, "phase3_labels")
    parts = [p.where(F.col("labeled_by") == f"annotator_{i}").select(F.lit(str(i)).alias("part"), "pair_id", "label") for i in range(4)]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.rollup("part").agg(F.count("*").alias("n"), F.count_distinct("pair_id").alias("pairs"))


def separated_tiers(s, d):
    """Medians of scores of either class per tier and the best F1 over thresholds in steps of a tenth; a tier is separated if a half lies between the medians."""
    r = _labelled(s, d).where("tier IS NOT NULL")
    med = r.groupBy("tier").agg(F.round(F.median(F.when(F.col("actual"), F.col("score"))), 6).alias("median_match"), F.round(F.median(F.when(~F.col("actual"), F.col("score"))), 6).alias("median_other"))
    grid = r.select("tier", "actual", "score", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k")).withColumn("yes", F.col("score") >= F.col("k") / 10)
    g = grid.groupBy("tier", "k").agg(F.count_if(F.col("yes") & F.col("actual")).alias("tp"), F.count_if(F.col("yes") != F.col("actual")).alias("wrong"))
    best = g.groupBy("tier").agg(F.round(F.max(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong"))), 6).alias("best_f1"))
    return med.join(best, "tier").select("tier", "median_match", "median_other", "best_f1", F.coalesce((F.col("median_match") > 0.5) & (F.col("median_other") < 0.5), F.lit(False)).alias("separated"))


def paired_scores(s, d):
    """Two scorings of the same pairs: how far they lie apart and how many verdicts turn."""
    r = _labelled(s, d).select("score", (F.lit(1) - F.col("score") * F.col("score")).alias("other"))
    return r.agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("score") - F.col("other"))), 6).alias("most"), F.round(F.avg(F.abs(F.col("score") - F.col("other"))), 6).alias("mean"), F.count_if((F.col("score") >= 0.5) != (F.col("other") >= 0.5)).alias("flips"))


def either_direction_recall(s, d):
    """Of the vectors' five nearest by cosine, how many the first coordinate's ten nearest hold in either direction, per label and for all."""
    from sparkmill.plans.text import _two_rankings

    dense, first = _two_rankings(s, d)
    e = T(s, d, "embeddings").select(F.col("vec_id").alias("q"), F.col("label").cast("string").alias("label"))
    pairs = dense.where("rank <= 5").join(e, "q").select(F.col("q").alias("l"), F.col("i").alias("r"), "label")
    return V.recall_either_direction(first, pairs, "q", "i", "rank", "l", "r", "label", 10)


def quantity_shapes(s, d):
    """How listings' amounts are recorded: by shape and source."""
    has = lambda c: F.col(c).isNotNull()
    base = F.when(has("net_weight_g") & has("net_volume_ml"), "both").when(has("net_weight_g"), "mass").when(has("net_volume_ml"), "volume").otherwise("none")
    shape = F.concat(base, F.when(F.col("pack_count") > 1, "_pack").otherwise(""), F.when(F.col("bonus_weight_g") > 0, "_bonus").otherwise(""))
    return T(s, d, "norm_listings").groupBy(F.col("sample_source").alias("source"), shape.alias("shape")).agg(F.count("*").alias("n"))


def largest_tables(s, d):
    """The five tables with the most bytes."""
    from sparkmill.sources.pages import table_bytes

    return table_bytes(s, d).orderBy(F.desc("bytes"), "name").limit(5)


def catalogue_filter(s, d):
    """Products of a category and a brand, letters' case apart."""
    return T(s, d, "products").where((F.col("category") == "hrana uscata") & (F.lower("brand") == "hono & clutik")).select("id", "sku")


def model_inputs(s, d):
    """Rows for a model: of test pairs no label, of others the label and their side."""
    sp = B.split_of(F.col("split"))
    p = T(s, d, "phase3_labels").where(F.col("pair_id").isNotNull() & sp.isNotNull()).select("pair_id", "occurrence_id", F.when(sp == "test", "test").when(sp == "validation", "val").otherwise("train").alias("side"), F.when(sp != "test", F.col("label")).alias("label"))
    return p.distinct()


QUERIES = {f.__name__: f for f in (
    overlap_keys, overlap_shared, canonical_brands, listing_categories, url_categories, stage_and_flavours, hard_case_labels, quarantine_reasons, prompt_texts, embedding_texts, payload_hashes, blocked_candidates, reformulated_pairs,
    same_quantity_other_stage, same_quantity_other_size, same_capacity_other_flavour, resolved_variants, competitor_series, split_compatibility, tier_metrics, field_accuracy, species_mismatches, revised_labels, seeded_sample, public_shops, preferred_weights,
    leaking_nodes, dominant_features, display_prices, label_unions, separated_tiers, paired_scores, either_direction_recall, quantity_shapes, largest_tables, catalogue_filter, model_inputs,
)}

_LOW = "lower({})"
for _k, _v in L.LETTERS.items():
    _LOW = f"replace({_LOW}, '{_k}', '" + _v.replace("'", "''") + "')"
_FOLDED = f"replace(replace(replace(strip_accents({_LOW}), '½', '1⁄2'), '…', '...'), '™', 'TM')"


def _fold(c: str) -> str:
    return _FOLDED.format(c)


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _value(p: str, n: int, unit: str) -> str:
    return f"(cast(replace(regexp_extract(t, '{p}', {n}), ',', '.') as decimal(20,4)) * case when {unit} in ('kg', 'l') then 1000 else 1 end)"


_U = "coalesce(nullif(regexp_extract(t, '" + L._BONUS + "', 2), ''), regexp_extract(t, '" + L._BONUS + "', 4))"
_BASE = f"""cast(floor(case when regexp_matches(t, '{L._BONUS}') then {_value(L._BONUS, 1, _U)} when regexp_matches(t, '{L._PACK}') then {_value(L._PACK, 2, f"regexp_extract(t, '{L._PACK}', 3)")} * cast(regexp_extract(t, '{L._PACK}', 1) as integer)
  when regexp_matches(t, '{L._PLAIN}') then {_value(L._PLAIN, 1, f"regexp_extract(t, '{L._PLAIN}', 2)")} end) as bigint)"""
_BONUS_G = f"""case when regexp_matches(t, '{L._BONUS}') then cast(floor({_value(L._BONUS, 3, f"regexp_extract(t, '{L._BONUS}', 4)")}) as bigint) else 0 end"""
_TELL = "list_filter({}, lambda x: not list_contains(" + _list(L.PROSE + L.UNITS) + ", x) and not regexp_full_match(x, '[0-9]+(kg|g|gr|grame|mg|ml|l)?'))"
_KEYS = f"""a as (select id, sample_source, brand, {_fold('sample_title')} t from norm_listings),
  b as (select *, {_TELL.format("regexp_extract_all(t, '[a-z0-9'']+')")} ts, {_BASE} w, {_BONUS_G} x from a),
  c as (select *, coalesce(case when trim(brand) <> '' then trim(regexp_replace({_fold('brand')}, '[\\s\\x{{00a0}}]+', ' ', 'g')) end, ts[1], '') b from b),
  e as (select *, list_reduce(list_prepend(t, list_filter(string_split(b, ' '), lambda y: y <> '')), lambda p, q: replace(p, q, ' ')) rest from c),
  f as (select *, list_sort(list_distinct({_TELL.format("regexp_extract_all(rest, '[a-z0-9'']+')")})) ws from e),
  k as (select id, sample_source, case when w > 0 and b <> '' and len(ws) > 0 then b || ' | ' || array_to_string(ws, ' ') || ' | ' || w || 'g' || case when x > 0 then ' +' || x || 'g' else '' end end as key from f)"""
_CASEPLAIN = "nullif(trim(lower(translate(brand, '’‘', ''''''))), '')"
_END = "case " + " ".join(f"when b = '{e}' then b" for e in L.BRAND_ENDS) + " " + " ".join(f"when b like '% {e}' and trim(left(b, length(b) - {len(e) + 1})) <> '' then trim(left(b, length(b) - {len(e) + 1}))" for e in L.BRAND_ENDS) + " else b end"
_ALIAS = "case b " + " ".join(f"when '{k}' then '{v}'" for k, v in L.BRAND_ALIASES.items()) + " end"
_CAT = (
    f"case when k in ({_list(L.FOOD)[1:-1]}) then 'food' when k in ({_list(L.ACCESSORY)[1:-1]}) then 'accessory' when k in ({_list(L.LITTER)[1:-1]}) then 'litter' when k in ({_list(L.TOY)[1:-1]}) then 'toy' "
    + " ".join(f"when regexp_matches(t, '{p}') then '{c}'" for c, p in L.TITLE_CATEGORY.items())
)
_TSPEC = f"case when regexp_matches(t, '{L.DOG}') and not regexp_matches(t, '{L.CAT}') then 'dog' when regexp_matches(t, '{L.CAT}') and not regexp_matches(t, '{L.DOG}') then 'cat' end"
_KNOWN = f"k in ({_list(L.FOOD + L.ACCESSORY + L.TOY)[1:-1]}) and k not in ({_list(L.NO_SPECIES)[1:-1]})"
_SPEC = f"case when category = 'litter' then 'cat' when {_KNOWN} and regexp_matches(k, 'caini|catei') then 'dog' when {_KNOWN} and k like '%pisic%' then 'cat' else {_TSPEC} end"
_STAGEW = f"nullif(regexp_extract({{}}, '{L.STAGE}', 1), '')"
_STAGEN = "case {0} " + " ".join(f"when '{k}' then '{v}'" for k, v in L.STAGE_NAMES.items()) + " else {0} end"
_SPLIT = "case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('validation', 'val', 'valid', 'dev') then 'validation' when lower(trim(split)) = 'test' then 'test' end"


def _pairs_sql(same: list[str], other: str) -> str:
    keys = ["net_weight_g", "net_volume_ml", "pack_count", "bonus_weight_g", *same]
    on = " and ".join(f"a.{k} is not distinct from b.{k}" for k in keys)
    return f"""with n as (select brand_blocking_key, {', '.join(keys)}, {other}, min(id) id, count(*) n from norm_listings where brand_blocking_key is not null and {other} is not null group by all)
        select a.id id_a, b.id id_b, a.n n_a, b.n n_b from n a join n b on a.brand_blocking_key = b.brand_blocking_key and {on} and a.{other} < b.{other}"""


def _comparable(c: str) -> str:
    return f"replace(lower(nullif(trim({c}), '')), ' ', '')"


_FLAVOURS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in C.FLAVOURS.items()) + "}"
_TITLE_FOLD = "trim(regexp_replace(replace(replace(replace(strip_accents(lower(sample_title)), '½', '1⁄2'), '…', '...'), '™', 'TM'), '[\\s\\x{00a0}]+', ' ', 'g'))"
_FLAV = f"nullif(array_to_string(list_filter(list_transform(regexp_extract_all({_TITLE_FOLD}, '\\b({'|'.join(C.FLAVOURS)})\\b', 1), lambda w: {_FLAVOURS}[w]), lambda x, i: list_position(list_transform(regexp_extract_all({_TITLE_FOLD}, '\\b({'|'.join(C.FLAVOURS)})\\b', 1), lambda w: {_FLAVOURS}[w]), x) = i), '+'), '')"
_DISPLAY = "case when price is null then 'n/a' else format('{:,.2f}', price) || ' RON' end"
_REQ = "cast(product_id as varchar) || ':' || source"
_CLEAN = "left(trim(regexp_replace(replace(competitor_title, '\"', ''''), '[\\s\\x{00a0}]+', ' ', 'g')), 160)"

SQL = {
    "overlap_keys": f"with {_KEYS} select id, key from k",
    "overlap_shared": f"with {_KEYS}, g as (select key, count(distinct sample_source) sources from k where key is not null and sample_source is not null group by 1) select sources, count(*) keys from g where sources > 1 group by 1",
    "canonical_brands": f"with b as (select id, {_CASEPLAIN} b from norm_listings), c as (select id, coalesce({_ALIAS}, {_END}) canonical, case when {_ALIAS} is not null then b else {_END} end span from b) select *, coalesce(lower(canonical) in ('opti', 'ipts'), false) distributor from c",
    "listing_categories": f"with a as (select id, lower(trim(product_type)) k, {_fold('coalesce(title, chr(32))')} t from category_listings where id is not null), b as (select *, {_CAT} else 'food' end category from a) select id, category, {_SPEC} species from b",
    "url_categories": f"with a as (select source, lower(nullif(regexp_extract(url, '^[a-z]+://[^/]+/([^/]+)/', 1), '')) k, {_fold('coalesce(title, chr(32))')} t from raw_listings), b as (select *, {_CAT} end category from a) select source, category, {_SPEC} species, count(*) n from b group by all",
    "stage_and_flavours": f"with a as (select id, life_stage, flavour, {_STAGEW.format(_fold('sample_title'))} w from norm_listings) select id, coalesce(lower(nullif(life_stage, '')), {_STAGEN.format('w')}) stage, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(coalesce(flavour, '')), '+'), lambda f: f <> ''))), ',') flavours from a",
    "hard_case_labels": f"with a as (select id, {_fold('sample_title')} t from norm_listings where sample_title is not null) select id, array_to_string(list_sort(list_filter(["
    + ", ".join(f"case when regexp_matches(t, '{p}') then '{k}' end".replace("hill's", "hill''s") for k, p in L.HARD_CASES.items())
    + f", case when {_BASE} is null then 'no_weight_in_title' end, case when {_BONUS_G} > 0 then 'bonus_pack' end], lambda x: x is not null)), ',') cases from a",
    "quarantine_reasons": f"with a as (select id, ' ' || trim(regexp_replace({_fold('title')}, '[\\s\\x{{00a0}}]+', ' ', 'g')) || ' ' t, lower(product_type) k from category_listings) select id, nullif(concat_ws(';', 'title_token:' || case "
    + " ".join(f"when contains(t, '{w}') then '{w.strip()}'" for w in L.REGULATED)
    + " end, case when k like '%veterinar%' then 'product_type:' || k end), '') reason from a",
    "prompt_texts": f"with a as (select id, {_REQ} link_key, {_CLEAN} title from product_matches where id is not null) select *, sha256(link_key || chr(0) || title || chr(0)) request from a",
    "embedding_texts": """select id, trim(coalesce(brand, '') || ' ' || coalesce(nullif(product_line, ''), sample_title, '') || ' ' || concat_ws(' ', coalesce(net_weight_g || 'g', net_volume_ml || 'ml'), case when pack_count <> 1 then 'x' || pack_count end, nullif(life_stage, ''), nullif(flavour, ''), nullif(breed_size_class, ''))) as text,
        coalesce(net_weight_g || ' g', net_volume_ml || ' ml', '') as size from norm_listings""",
    "blocked_candidates": "with p as (select id product_id, nullif(regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g'), '') k from products) select product_id, count(*) candidates, min(n.id) as first, max(n.id) as last from p join norm_listings n on n.brand_blocking_key = k where k <> '' group by product_id, p.k",
    "reformulated_pairs": f"""with n as (select content_hash h, brand_blocking_key b, lower(trim(product_line)) l, {' or '.join(f"lower(sample_title) like '{p}'" for p in [*REFORMULATED, '%nou!%'])} m from norm_listings where brand_blocking_key is not null and product_line is not null)
        select distinct x.h a, y.h b from n x join n y on x.b = y.b and x.l = y.l and x.h < y.h where x.m or y.m""",
    "same_quantity_other_stage": _pairs_sql(["flavour"], "life_stage"),
    "same_quantity_other_size": _pairs_sql([], "breed_size_code"),
    "same_capacity_other_flavour": _pairs_sql([], "flavour"),
    "resolved_variants": f"""with m as (select distinct product_id, source, url, net_weight_g g from product_matches join products p on p.id = product_id where url is not null and source is not null), a as (select id, source, url, {_fold('title')} t from raw_listings), r as (select id, source, url, {_BASE} w from a)
        select m.product_id, m.source, m.url, max(r.id) listing_id from m left join r on r.source = m.source and r.url = m.url and r.w = m.g group by m.product_id, m.source, m.url, m.g""",
    "competitor_series": """with d as (select product_id, source, price_date, competitor_price p, row_number() over (partition by product_id, source, price_date order by created_at desc nulls last, id desc) k from product_matches where product_id is not null and source is not null and price_date is not null and competitor_price is not null)
        select product_id, source, string_agg(strftime(price_date, '%Y-%m-%d') || '=' || p, ' ' order by price_date) series from d where k = 1 group by 1, 2""",
    "split_compatibility": """with p as (select pair_id, split, tier, label, labeled_by in ('annotator_0', 'annotator_1') mine from phase3_labels where pair_id is not null), a as (select pair_id, min(split) s, min(tier) t, min(label) l from p where mine group by 1), b as (select pair_id, min(split) s, min(tier) t, min(label) l from p where not mine group by 1)
        select case when a.pair_id is null then 'missing_left' when b.pair_id is null then 'missing_right' when a.s is distinct from b.s then 'split' when a.t is distinct from b.t then 'tier' when a.l is distinct from b.l then 'changed' else 'equal' end finding, count(*) n from a full join b on a.pair_id = b.pair_id group by 1""",
    "tier_metrics": f"""with {_LABELLED}, t as (select distinct tier from phase3_labels where tier is not null), g as (select t.tier, count(*) filter (actual) n_pos, count(*) filter (not actual) n_neg, cast(count(*) filter (actual and score >= 0.5) as double) tp, cast(count(*) filter (not actual and score >= 0.5) as double) fp from t left join l on l.tier = t.tier group by 1),
        q as (select *, tp / nullif(tp + fp, 0) p, tp / nullif(n_pos, 0) r from g) select tier, n_pos, n_neg, n_pos >= 5 reportable, case when n_pos >= 5 then round(p, 6) end prec, case when n_pos >= 5 then round(r, 6) end recall, case when n_pos >= 5 then round(case when p > 0 and r > 0 then 2 * p * r / (p + r) else 0 end, 6) end f1, round(fp / nullif(n_neg, 0), 6) false_positive_rate from q""",
    "field_accuracy": f"""with n as (select *, {_fold('sample_title')} t from norm_listings), f as (select 'life_stage' field, {_comparable(_STAGEN.format(_STAGEW.format('t')))} a, {_comparable('life_stage')} b from n union all select 'flavour', {_comparable(_FLAV)}, {_comparable('flavour')} from n union all select 'net_weight_g', cast({_BASE} as varchar), cast(net_weight_g as varchar) from n),
        g as (select field, count(a) labelled, count(*) filter (a = b) correct, count(*) filter (a is not null and b is null) missing, count(*) filter (a is null and b is not null) extra, count(*) filter (a <> b) different from f group by rollup (field)) select *, round(correct / nullif(cast(labelled as double), 0), 6) recall, round(correct / nullif(cast(labelled + extra as double), 0), 6) as "symmetric" from g""",
    "species_mismatches": f"with a as (select sample_source source, species, {_fold('sample_title')} t from norm_listings), b as (select source, species, {_TSPEC} t from a) select source, t, count(*) n from b where t <> species group by all",
    "revised_labels": """with q as (select distinct pair_id, occurrence_id, label, labeled_by = 'annotator_3' review from phase3_labels where pair_id is not null and occurrence_id is not null and label is not null), c as (select *, lag(label) over w p, row_number() over (partition by pair_id order by occurrence_id desc, label desc) k from q window w as (partition by pair_id order by occurrence_id, label))
        select pair_id, max(label) filter (k = 1) as label, count(*) filter (p is not null and label <> p and review) revisions, count(*) filter (p is not null and label <> p and not coalesce(review, false)) conflicts from c group by 1""",
    "seeded_sample": "select id from norm_listings where id is not null order by md5('7:' || id), id limit 200",
    "public_shops": "with a as (select coalesce(case source when 'latranel' then 'shop_a' when 'mustacel' then 'shop_b' when 'codalunga' then 'shop_c' end, 'shop_' || left(sha256(source), 4)) shop, count(*) n from raw_listings where source is not null group by source) select shop, 'Shop ' || upper(substr(shop, 6)) as label, n from a",
    "preferred_weights": f"with a as (select id, net_weight_g g, {_fold('title')} t from products) select id, coalesce(cast(g as bigint), {_BASE}) weight from a",
    "leaking_nodes": f"with p as (select {_SPLIT} sp, unnest([left_content_hash, right_content_hash]) h from phase3_labels), g as (select h, count(*) filter (sp = 'train') tr, count(*) filter (sp = 'test') te from p where h is not null and sp is not null group by 1 having tr > 0 and te > 0) select count(*) listings, cast(coalesce(sum(tr), 0) as bigint) train_rows, cast(coalesce(sum(te), 0) as bigint) test_rows from g",
    "dominant_features": """with n as (select content_hash h, min(net_weight_g) w, min(life_stage) l, min(flavour) f, min(species) s from norm_listings group by 1), j as (select a.*, b.w w2, b.l l2, b.f f2, b.s s2 from (select distinct occurrence_id, left_content_hash x, right_content_hash y from phase3_labels where occurrence_id is not null) p join n a on a.h = x join n b on b.h = y),
        g as (select avg(cast(w is distinct from w2 as integer)) net_weight_g, avg(cast(l is distinct from l2 as integer)) life_stage, avg(cast(f is distinct from f2 as integer)) flavour, avg(cast(s is distinct from s2 as integer)) species from j) select feature, round(share, 6) share, round(share, 6) > 0.4 dominant from (unpivot g on net_weight_g, life_stage, flavour, species into name feature value share)""",
    "display_prices": f"select id, {_DISPLAY} price, case when price is not null and compare_at_price > 0 then case when p >= 0 then '+' else '' end || p || '%' else 'n/a' end change, coalesce(strftime(collected_date, '%Y-%m-%d'), 'n/a') as day from (select *, cast(round((price - compare_at_price) * 100 / compare_at_price, 1) as decimal(12,1)) p from raw_listings)",
    "label_unions": "select part, count(*) n, count(distinct pair_id) pairs from (select right(labeled_by, 1) part, pair_id from phase3_labels where labeled_by in ('annotator_0', 'annotator_1', 'annotator_2', 'annotator_3')) group by rollup (part)",
    "separated_tiers": f"""with {_LABELLED}, m as (select tier, round(median(cast(score as double)) filter (actual), 6) a, round(median(cast(score as double)) filter (not actual), 6) o from l where tier is not null group by 1), g as (select tier, k, count(*) filter (score >= k / 10.0 and actual) tp, count(*) filter ((score >= k / 10.0) <> actual) wrong from l, (select unnest(range(11)) k) where tier is not null group by 1, 2),
        b as (select tier, round(max(2 * tp / nullif(cast(2 * tp + wrong as double), 0)), 6) best_f1 from g group by 1) select m.tier, a median_match, o median_other, best_f1, coalesce(a > 0.5 and o < 0.5, false) separated from m join b using (tier)""",
    "paired_scores": f"with {_LABELLED}, s as (select cast(score as double) x, 1 - cast(score as double) * cast(score as double) y from l) select count(*) n, round(max(abs(x - y)), 6) most, round(avg(abs(x - y)), 6) mean, count(*) filter ((x >= 0.5) <> (y >= 0.5)) flips from s",
    "quantity_shapes": "select sample_source source, case when net_weight_g is not null and net_volume_ml is not null then 'both' when net_weight_g is not null then 'mass' when net_volume_ml is not null then 'volume' else 'none' end || case when pack_count > 1 then '_pack' else '' end || case when bonus_weight_g > 0 then '_bonus' else '' end shape, count(*) n from norm_listings group by all",
    "catalogue_filter": "select id, sku from products where category = 'hrana uscata' and lower(brand) = 'hono & clutik'",
    "model_inputs": f"with p as (select pair_id, occurrence_id, label, {_SPLIT} sp from phase3_labels) select distinct pair_id, occurrence_id, case sp when 'validation' then 'val' else sp end side, case when sp <> 'test' then label end as label from p where pair_id is not null and sp is not null",
}
