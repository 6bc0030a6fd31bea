"""Joins and rows per key over the price watch's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmill.operators import keyed as K
from sparkmill.operators import similarity as V
from sparkmill.session import table as T

_UTC = "cast({} at time zone 'UTC' as date)"


def latest_per_key_ties(s, d):
    """All listings whose scraped_at is the latest of their (source, source_product_id)."""
    return K.latest_with_ties(T(s, d, "raw_listings"), ["source", "source_product_id"], "scraped_at").select("id", "source", "source_product_id")


def latest_per_key_single(s, d):
    r = T(s, d, "raw_listings").select("source", "external_id", "id", "scraped_at", "title", F.col("price").cast("double").alias("price"))
    return K.one_per_key(r, ["source", "external_id"], ["scraped_at", "id"]).select("source", "external_id", "id", "title", "price")


def first_per_key(s, d):
    r = T(s, d, "raw_listings").where("content_hash IS NOT NULL").select("content_hash", "id", "source", "title")
    return K.one_per_key(r, ["content_hash"], ["id"], last=False)


def asof_last_payload(s, d):
    """Each listing with the payload hash last known on or before its day."""
    r = T(s, d, "raw_listings").select("id", "source", "external_id", "collected_date", "raw_payload_sha256")
    return K.last_known(r, ["source", "external_id"], ["collected_date", "id"], "raw_payload_sha256", "known").select("id", "known")


def previous_hash_before_day(s, d):
    r = T(s, d, "raw_listings").where("source IS NOT NULL AND external_id IS NOT NULL AND collected_date IS NOT NULL").select("id", "source", "external_id", "collected_date", "raw_payload_sha256")
    return K.last_known_before_day(r, ["source", "external_id"], "collected_date", "raw_payload_sha256", ["id"], "before").select("id", "before")


def asof_match_price(s, d):
    """Each accepted match with the listing's price as of its price_date, through the general as-of join."""
    m = T(s, d, "product_matches").where("source IS NOT NULL AND external_id IS NOT NULL").select("id", "source", "external_id", "price_date")
    r = T(s, d, "raw_listings").where("source IS NOT NULL AND external_id IS NOT NULL AND price IS NOT NULL").select("source", "external_id", "collected_date", F.col("price").cast("double").alias("listed"))
    return K.asof(m, r, ["source", "external_id"], "price_date", "collected_date", ["listed"]).select("id", "listed")


def fact_dim_left(s, d):
    """Listings per source with and without a row of the title dimension."""
    n = T(s, d, "norm_listings").select("content_hash", F.lit(1).alias("known")).distinct()
    r = T(s, d, "raw_listings").select("source", "content_hash").join(n, "content_hash", "left")
    return r.groupBy("source").agg(F.count("*").alias("listings"), F.count("known").alias("known"))


def fact_dim_inner(s, d):
    n = T(s, d, "norm_listings").select("content_hash", "food_form")
    return T(s, d, "raw_listings").select("content_hash", "source").join(n, "content_hash").groupBy("source", "food_form").agg(F.count("*").alias("n"))


def new_keys_anti(s, d):
    """Title hashes without a row in the dimension, with their first listing."""
    r = T(s, d, "raw_listings").where("content_hash IS NOT NULL").select("content_hash", "id")
    return r.join(T(s, d, "norm_listings").select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min("id").alias("first_id"))


def semi_matched_listings(s, d):
    m = T(s, d, "product_matches").select("source", "external_id")
    return T(s, d, "raw_listings").select("id", "source", "external_id").join(m, ["source", "external_id"], "left_semi")


def _classes(s, d, attributes):
    """Listings with a brand key and a line as classes of equal attributes, each with its least id and its number of listings: pairs are made of these, so a hot group costs its variety squared, not its rows."""
    n = T(s, d, "norm_listings").where("brand_blocking_key <> '' AND trim(product_line) <> ''").withColumn("line", F.lower(F.trim("product_line")))
    return n.groupBy("brand_blocking_key", "line", *attributes).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def _pairs(j):
    return j.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def quantity_differs_self_join(s, d):
    """Pairs of classes of one brand key and line (case and blanks apart) whose quantities differ, null-safe."""
    c = _classes(s, d, ["net_weight_g", "net_volume_ml", "pack_count"])
    a, b = c.alias("a"), c.alias("b")
    return _pairs(a.join(b, (F.col("a.brand_blocking_key") == F.col("b.brand_blocking_key")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.id") < F.col("b.id"))))


def same_quantity_other_flavour(s, d):
    """Pairs of classes that agree in all but the flavour."""
    c = _classes(s, d, ["net_weight_g", "net_volume_ml", "life_stage", "flavour"])
    a, b = c.alias("a"), c.alias("b")
    on = F.col("a.id") < F.col("b.id")
    for k in ("brand_blocking_key", "line"):
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    for k in ("net_weight_g", "net_volume_ml", "life_stage"):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return _pairs(a.join(b, on & (F.col("a.flavour") != F.col("b.flavour"))))


def other_brand_same_line(s, d):
    """Pairs of brand keys that have one line."""
    c = _classes(s, d, [])
    a, b = c.alias("a"), c.alias("b")
    return _pairs(a.join(b, (F.col("a.line") == F.col("b.line")) & (F.col("a.brand_blocking_key") != F.col("b.brand_blocking_key")) & (F.col("a.id") < F.col("b.id"))))


def lookup_default(s, d):
    """Matches per product, 0 where it has none."""
    c = T(s, d, "product_matches").groupBy("product_id").agg(F.count("*").alias("n"))
    return T(s, d, "products").select("id").join(c, F.col("id") == F.col("product_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("matches"))


def cross_source_pairs(s, d):
    """Per day, pairs of shops that list the same title."""
    r = T(s, d, "raw_listings").where("content_hash IS NOT NULL AND source IS NOT NULL").select("content_hash", "collected_date", "source").distinct()
    a, b = r.alias("a"), r.alias("b")
    j = a.join(b, (F.col("a.content_hash") == F.col("b.content_hash")) & F.col("a.collected_date").eqNullSafe(F.col("b.collected_date")) & (F.col("a.source") < F.col("b.source")))
    return j.groupBy(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b")).agg(F.count_distinct("a.content_hash").alias("titles"))


def exact_week_before(s, d):
    """Each match with the same product's and source's price exactly seven days before."""
    m = T(s, d, "product_matches").where("product_id IS NOT NULL AND source IS NOT NULL").select("id", "product_id", "source", "price_date", F.col("competitor_price").cast("double").alias("price"), "created_at")
    daily = K.one_per_key(m, ["product_id", "source", "price_date"], ["created_at", "id"]).select("product_id", "source", "price_date", "price")
    before = daily.select("product_id", "source", F.date_add("price_date", 7).alias("price_date"), F.col("price").alias("price_7d_ago"))
    return daily.join(before, ["product_id", "source", "price_date"], "left").select("product_id", "source", F.date_format("price_date", "yyyy-MM-dd").alias("day"), "price", "price_7d_ago")


def latest_run_per_source(s, d):
    r = T(s, d, "scrape_runs").where("source IS NOT NULL")
    top = r.groupBy("source").agg(F.max("id").alias("id"))
    return r.join(top.select("id"), "id", "left_semi").select("source", "id", "status", "items_found")


def previous_ok_count(s, d):
    """Each run with the items of the latest ok run of its source before it, and whether it dropped by more than two fifths."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("started_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    r = T(s, d, "scrape_runs").select("id", "source", "started_at", "items_found", F.when(F.col("status") == "ok", F.struct("items_found")).alias("ok"))
    r = r.withColumn("previous", F.last("ok", ignorenulls=True).over(w)["items_found"])
    drop = F.coalesce((F.col("previous") > 0) & ((F.col("previous") - F.col("items_found")) * 10 > F.col("previous") * 4), F.lit(False))
    return r.select("id", "previous", drop.alias("volume_drop"))


def compare_two_days(s, d):
    """Titles' prices on the two last days of every source: missing on either side or different."""
    r = T(s, d, "raw_listings").where("external_id IS NOT NULL AND source IS NOT NULL AND collected_date IS NOT NULL").select("source", "external_id", "collected_date", "id", "scraped_at", "price")
    one = K.one_per_key(r, ["source", "external_id", "collected_date"], ["scraped_at", "id"])
    days = r.select("source", "collected_date").distinct()
    from pyspark.sql import Window

    k = days.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("collected_date")))).where("k <= 2")
    one = one.join(k, ["source", "collected_date"])
    return K.compare_tables(one.where("k = 2"), one.where("k = 1"), ["source", "external_id"], ["price"])


def ordered_alias_lookup(s, d):
    """Each brand's aliases in their order with the least brand that has the alias as an alias."""
    b = T(s, d, "brand_reference").where("aliases IS NOT NULL")
    dim = b.select("brand_id", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.min("brand_id").alias("owner"))
    out = K.ordered_lookup(b, "brand_id", "aliases", dim, "alias", "owner", "owners")
    return out.select("brand_id", F.array_join(F.transform("owners", lambda x: x.cast("string")), ",", "none").alias("owners"))


def zip_matches_links(s, d):
    """Products' best link and best match of every source, paired by position where both sides have one."""
    from sparkmill.operators.keyed import ranked

    m = T(s, d, "product_matches").where("product_id IS NOT NULL AND source IS NOT NULL").select("product_id", "source", "id", "score")
    m1 = ranked(m, ["product_id", "source"], [F.desc("score"), F.asc("id")], 1).select("product_id", "source", F.col("id").alias("match_id"))
    first = m.groupBy("product_id", "source").agg(F.min("id").alias("first_id"))
    return K.zip_tables(m1, ["match_id"], first, ["first_id"], ["product_id", "source"]).select("product_id", "source", "position", "match_id", "first_id")


def key_set_check(s, d):
    """Products without a match and matches without a product."""
    p, m = T(s, d, "products").select(F.col("id").alias("product_id")), T(s, d, "product_matches").select("product_id").where("product_id IS NOT NULL").distinct()
    return p.join(m, "product_id", "left_anti").select(F.lit("unmatched").alias("side"), "product_id").unionByName(m.join(p, "product_id", "left_anti").select(F.lit("unknown").alias("side"), "product_id"))


def best_per_shop(s, d):
    """Best link of each product and shop among those with a score of at least 0.5; NaN never counts."""
    r = T(s, d, "scored_links").where("product_id IS NOT NULL AND external_id IS NOT NULL AND NOT isnan(score) AND score >= 0.5").select("product_id", "source", "external_id", "score")
    return K.ranked(r, ["product_id", "source"], [F.desc("score"), F.asc("external_id")], 1).select("product_id", "source", "external_id", F.round("score", 9).alias("score"))


def current_price(s, d):
    """Each listing's current row: newest day, in stock first, cheapest, least id; none if it is older than its shop's newest day by more than a week."""
    r = T(s, d, "raw_listings").where("source IS NOT NULL AND external_id IS NOT NULL AND collected_date IS NOT NULL").select("source", "external_id", "collected_date", "in_stock", F.col("price").cast("double").alias("price"), "id", "excluded_reason")
    r = r.join(r.groupBy("source").agg(F.max("collected_date").alias("newest")), "source")
    r = r.where("excluded_reason IS NULL AND collected_date >= date_sub(newest, 7)")
    order = [F.desc("collected_date"), F.desc(F.coalesce("in_stock", F.lit(False))), F.asc_nulls_last("price"), F.asc("id")]
    return K.ranked(r, ["source", "external_id"], order, 1).select("source", "external_id", "id", "price")


def superseded_observation(s, d):
    """Matches whose price_date is older than the newest of their product and source."""
    from pyspark.sql import Window

    m = T(s, d, "product_matches").where("product_id IS NOT NULL AND source IS NOT NULL").select("id", "product_id", "source", "price_date")
    return m.withColumn("newest", F.max("price_date").over(Window.partitionBy("product_id", "source"))).where("price_date < newest").select("id", F.date_format("newest", "yyyy-MM-dd").alias("newest"))


def occurrence_ordinal(s, d):
    """Which appearance of its pair every labelled row is, by occurrence_id; repeated rows count once."""
    from pyspark.sql import Window

    r = T(s, d, "phase3_labels").where("pair_id IS NOT NULL").select("pair_id", "occurrence_id").distinct()
    return r.select("pair_id", "occurrence_id", (F.row_number().over(Window.partitionBy("pair_id").orderBy("occurrence_id")) - 1).alias("ordinal"))


def quantity_interval_overlap(s, d):
    """Products and listings of one brand text whose weights lie within ten percent: a range join bounded by buckets of the logarithm."""
    p = T(s, d, "products").where("net_weight_g > 0").select(F.col("id").alias("product_id"), F.lower(F.trim("brand")).alias("b"), F.col("net_weight_g").alias("pw"))
    n = T(s, d, "norm_listings").where("net_weight_g > 0").select(F.col("id").alias("norm_id"), F.lower(F.trim("brand")).alias("b"), F.col("net_weight_g").alias("nw"))
    bucket = lambda c: F.floor(F.log(c) / 0.2)
    p = p.withColumn("k", F.explode(F.array(bucket(F.col("pw")) - 1, bucket(F.col("pw")), bucket(F.col("pw")) + 1)))
    j = p.join(n.withColumn("k", bucket(F.col("nw"))), ["b", "k"]).where("nw * 10 >= pw * 9 AND nw * 10 <= pw * 11")
    return j.select("product_id", "norm_id").distinct()


def nearest_scalar_subquery(s, d):
    """The ten vectors nearest by cosine to the vector that a scalar subquery gives: the one with the least id."""
    e = T(s, d, "embeddings").where("vec_id IS NOT NULL")
    q = e.select(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q"))
    e = e.withColumn("q", q.scalar())
    far = F.round(1 - V.cosine(F.col("embedding"), F.col("q.embedding")), 6)
    return e.where("vec_id <> q.vec_id").select("vec_id", far.alias("distance")).orderBy(F.asc_nulls_last("distance"), "vec_id").limit(10)


QUERIES = {f.__name__: f for f in (
    latest_per_key_ties, latest_per_key_single, first_per_key, asof_last_payload, previous_hash_before_day, asof_match_price, fact_dim_left, fact_dim_inner, new_keys_anti, semi_matched_listings,
    quantity_differs_self_join, same_quantity_other_flavour, other_brand_same_line, lookup_default, cross_source_pairs, exact_week_before, latest_run_per_source, previous_ok_count, compare_two_days,
    ordered_alias_lookup, zip_matches_links, key_set_check, best_per_shop, current_price, superseded_observation, occurrence_ordinal, quantity_interval_overlap, nearest_scalar_subquery,
)}

SQL = {
    "latest_per_key_ties": "select r.id, r.source, r.source_product_id from raw_listings r join (select source, source_product_id, max(scraped_at) m from raw_listings group by all) t on r.source = t.source and r.source_product_id = t.source_product_id and r.scraped_at = t.m",
    "latest_per_key_single": "select source, external_id, id, title, cast(price as double) price from (select *, row_number() over (partition by source, external_id order by scraped_at desc nulls last, id desc nulls last) k from raw_listings) where k = 1",
    "first_per_key": "select content_hash, id, source, title from (select *, row_number() over (partition by content_hash order by id) k from raw_listings where content_hash is not null) where k = 1",
    "asof_last_payload": "select id, last_value(raw_payload_sha256 ignore nulls) over (partition by source, external_id order by collected_date nulls first, id rows unbounded preceding) known from raw_listings",
    "previous_hash_before_day": """select r.id, (select t.raw_payload_sha256 from raw_listings t where t.source = r.source and t.external_id = r.external_id and t.collected_date < r.collected_date and t.raw_payload_sha256 is not null
        order by t.collected_date desc, t.id desc limit 1) before from raw_listings r where r.source is not null and r.external_id is not null and r.collected_date is not null""",
    "asof_match_price": """with p as (select source, external_id, collected_date d, max(cast(price as double)) listed from raw_listings where price is not null and source is not null and external_id is not null and collected_date is not null group by all)
        select m.id, p.listed from (select * from product_matches where source is not null and external_id is not null) m asof left join p on m.source = p.source and m.external_id = p.external_id and m.price_date >= p.d""",
    "fact_dim_left": "select source, count(*) listings, count(n.content_hash) known from raw_listings r left join (select distinct content_hash from norm_listings) n using (content_hash) group by source",
    "fact_dim_inner": "select source, food_form, count(*) n from raw_listings r join norm_listings n on r.content_hash = n.content_hash group by all".replace("select source", "select r.source"),
    "new_keys_anti": "select content_hash, min(id) first_id from raw_listings r where content_hash is not null and not exists (select 1 from norm_listings n where n.content_hash = r.content_hash) group by 1",
    "semi_matched_listings": "select id, source, external_id from raw_listings r where exists (select 1 from product_matches m where m.source = r.source and m.external_id = r.external_id)",
    "quantity_differs_self_join": """with c as (select brand_blocking_key k, lower(trim(product_line)) l, net_weight_g w, net_volume_ml v, pack_count p, min(id) id, count(*) n from norm_listings where brand_blocking_key <> '' and trim(product_line) <> '' group by all) select a.id id_a, b.id id_b, a.n n_a, b.n n_b from c a join c b on a.k = b.k and a.l = b.l and a.id < b.id and (a.w is distinct from b.w or a.v is distinct from b.v or a.p is distinct from b.p)""",
    "same_quantity_other_flavour": """with c as (select brand_blocking_key k, lower(trim(product_line)) l, net_weight_g w, net_volume_ml v, life_stage s, flavour f, min(id) id, count(*) n from norm_listings where brand_blocking_key <> '' and trim(product_line) <> '' group by all) select a.id id_a, b.id id_b, a.n n_a, b.n n_b from c a join c b on a.k = b.k and a.l = b.l and a.id < b.id and a.w is not distinct from b.w and a.v is not distinct from b.v and a.s is not distinct from b.s and a.f <> b.f""",
    "other_brand_same_line": """with c as (select brand_blocking_key k, lower(trim(product_line)) l, min(id) id, count(*) n from norm_listings where brand_blocking_key <> '' and trim(product_line) <> '' group by all) select a.id id_a, b.id id_b, a.n n_a, b.n n_b from c a join c b on a.l = b.l and a.k <> b.k and a.id < b.id""",
    "lookup_default": "select p.id, count(m.product_id) matches from products p left join product_matches m on m.product_id = p.id group by p.id",
    "cross_source_pairs": "with r as (select distinct content_hash, collected_date, source from raw_listings where content_hash is not null and source is not null) select a.source source_a, b.source source_b, count(distinct a.content_hash) titles from r a join r b on a.content_hash = b.content_hash and a.collected_date is not distinct from b.collected_date and a.source < b.source group by all",
    "exact_week_before": """with d as (select product_id, source, price_date, cast(competitor_price as double) price from (select *, row_number() over (partition by product_id, source, price_date order by created_at desc nulls last, id desc) k from product_matches where product_id is not null and source is not null) where k = 1)
        select d.product_id, d.source, strftime(d.price_date, '%Y-%m-%d') as day, d.price, b.price price_7d_ago from d left join d b on b.product_id = d.product_id and b.source = d.source and b.price_date = d.price_date - 7""",
    "latest_run_per_source": "select source, id, status, items_found from scrape_runs where id in (select max(id) from scrape_runs where source is not null group by source)",
    "previous_ok_count": """with r as (select *, lag(case when status = 'ok' then id end ignore nulls) over (partition by source order by started_at nulls first, id) pid from scrape_runs)
        select r.id, p.items_found previous, coalesce(p.items_found > 0 and (p.items_found - r.items_found) * 10 > p.items_found * 4, false) volume_drop from r left join scrape_runs p on p.id = r.pid""",
    "compare_two_days": """with one as (select source, external_id, collected_date d, price from (select *, row_number() over (partition by source, external_id, collected_date order by scraped_at desc nulls last, id desc) k from raw_listings where external_id is not null and source is not null and collected_date is not null) where k = 1),
        ds as (select source, d, row_number() over (partition by source order by d desc) k from (select distinct source, d from one)), a as (select one.* from one join ds on one.source = ds.source and one.d = ds.d and ds.k = 2), b as (select one.* from one join ds on one.source = ds.source and one.d = ds.d and ds.k = 1)
        select coalesce(a.source, b.source) source, coalesce(a.external_id, b.external_id) external_id, case when a.source is null then 'missing_left' when b.source is null then 'missing_right' else 'different' end status from a full join b on a.source = b.source and a.external_id = b.external_id
        where a.source is null or b.source is null or a.price is distinct from b.price""",
    "ordered_alias_lookup": """with e as (select brand_id, unnest(aliases) al, generate_subscripts(aliases, 1) i from brand_reference where aliases is not null), o as (select al, min(brand_id) w from e group by al)
        select brand_id, string_agg(coalesce(cast(w as varchar), 'none'), ',' order by i) owners from e left join o using (al) group by brand_id""",
    "zip_matches_links": """select product_id, source, 1 as position, match_id, first_id from (select product_id, source, id match_id, row_number() over (partition by product_id, source order by score desc nulls last, id) k from product_matches where product_id is not null and source is not null)
        join (select product_id, source, min(id) first_id from product_matches where product_id is not null and source is not null group by all) using (product_id, source) where k = 1""",
    "key_set_check": "select 'unmatched' side, id product_id from products where id not in (select product_id from product_matches where product_id is not null) union all select distinct 'unknown', product_id from product_matches where product_id is not null and product_id not in (select id from products)",
    "best_per_shop": "select product_id, source, external_id, round(score, 9) score from (select *, row_number() over (partition by product_id, source order by score desc, external_id) k from scored_links where product_id is not null and external_id is not null and not isnan(score) and score >= 0.5) where k = 1",
    "current_price": """select source, external_id, id, price from (select source, external_id, id, cast(price as double) price, row_number() over (partition by source, external_id order by collected_date desc, coalesce(in_stock, false) desc, price asc nulls last, id) k
        from (select *, max(collected_date) over (partition by source) m from raw_listings where source is not null and external_id is not null and collected_date is not null) where excluded_reason is null and collected_date >= m - 7) where k = 1""",
    "superseded_observation": "select id, strftime(m, '%Y-%m-%d') newest from (select *, max(price_date) over (partition by product_id, source) m from product_matches where product_id is not null and source is not null) where price_date < m",
    "occurrence_ordinal": "select pair_id, occurrence_id, row_number() over (partition by pair_id order by occurrence_id nulls first) - 1 as ordinal from (select distinct pair_id, occurrence_id from phase3_labels where pair_id is not null)",
    "quantity_interval_overlap": "select distinct p.id product_id, n.id norm_id from products p join norm_listings n on lower(trim(p.brand)) = lower(trim(n.brand)) where p.net_weight_g > 0 and n.net_weight_g > 0 and cast(n.net_weight_g as bigint) * 10 >= cast(p.net_weight_g as bigint) * 9 and cast(n.net_weight_g as bigint) * 10 <= cast(p.net_weight_g as bigint) * 11",
    "nearest_scalar_subquery": "with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings where vec_id is not null) select vec_id, round(1 - list_cosine_similarity(v, (select v from e order by vec_id limit 1)), 6) distance from e where vec_id <> (select min(vec_id) from e) order by distance nulls last, vec_id limit 10",
}
