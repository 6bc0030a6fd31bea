"""Attributes read from titles, replies, reports on labels and collection, seeds and costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sparkmill.functions import attributes as A
from sparkmill.functions import listings as L
from sparkmill.functions.quantity import read_amount
from sparkmill.operators import labels as B
from sparkmill.operators import series as S
from sparkmill.operators.sampling import sample_with_cases
from sparkmill.plans import listings as P
from sparkmill.plans import series as R
from sparkmill.session import table as T
from sparkmill.sources import pages, sinks

_AMOUNT = StructType([*[StructField(c, IntegerType()) for c in ("weight_g", "volume_ml", "units", "bonus_g")], StructField("error", StringType())])


@F.pandas_udf(_AMOUNT)
def _amount(title: pd.Series) -> pd.DataFrame:
    def one(t):
        try:
            return *read_amount(t)[:4], None
        except (ValueError, OverflowError, ZeroDivisionError) as e:
            return None, None, None, None, f"{type(e).__name__}: {e}"

    rows = [tuple(None if isinstance(x, int) and x >= 2**31 else x for x in one(t)) for t in title]
    out = pd.DataFrame(rows, columns=[f.name for f in _AMOUNT], dtype="object")
    return out.astype({c: "Int32" for c in ("weight_g", "volume_ml", "units", "bonus_g")})


def extracted(df, title: str, brand: str):
    """Adds brand_name, amount, flavours, size, stage, form and errors: everything that a title and a brand field state. A field that can't be read is null with its error; it never costs the row."""
    t = F.col(title)
    d = df.withColumns({"_t": L.folded(t), "_a": _amount(t)})
    d = d.withColumns({"brand_name": L.canonical_brand(F.col(brand)), "amount": F.struct("_a.weight_g", "_a.volume_ml", "_a.units", "_a.bonus_g"), "flavours": A.flavour(F.col("_t")), "size": A.breed_size(t), "stage": A.life_stage(t), "form": A.food_form(F.col("_t"))})
    errors = F.map_filter(F.create_map(F.lit("quantity"), F.col("_a.error")), lambda k, v: v.isNotNull())
    return d.withColumn("errors", errors).drop("_t", "_a")


def extracted_attributes(s, d):
    """What titles state, per listing; a query without SQL, as the amounts are a grammar's and the sizes' guards look behind."""
    n = extracted(T(s, d, "norm_listings").select("id", "sample_title", "brand"), "sample_title", "brand")
    return n.select("id", "brand_name", "amount.weight_g", "amount.volume_ml", "amount.units", "amount.bonus_g", "flavours", "size", "stage", "form", F.size("errors").alias("failed"))


def title_flavours(s, d):
    return T(s, d, "norm_listings").select("id", A.flavour(L.folded(F.col("sample_title"))).alias("flavour"))


def title_stages(s, d):
    return T(s, d, "norm_listings").select("id", A.life_stage(F.col("sample_title")).alias("stage"))


def title_forms(s, d):
    return T(s, d, "norm_listings").select("id", A.food_form(L.folded(F.col("sample_title"))).alias("form"))


def parsed_replies(s, d):
    """Replies made of the matches, every fifth with a second price line and every seventh with a price of three decimals, read back."""
    m = T(s, d, "product_matches").where("id IS NOT NULL AND competitor_price IS NOT NULL")
    text = F.concat(F.lit("PRICE: "), F.col("competitor_price").cast("string"), F.when(F.col("id") % 7 == 0, "1").otherwise(""), F.lit(" RON\r\nRATIONALE: as "), F.coalesce("source", F.lit("?")), F.when(F.col("id") % 5 == 0, "\nPRICE: 3").otherwise(""))
    return m.select("id", A.parse_reply(text).alias("r")).select("id", F.col("r.price").cast("double").alias("price"), "r.rationale", "r.error")


def label_lookup(s, d):
    """Matches whose listing has a label, and the least ids of those that have none, per source."""
    p = T(s, d, "phase3_labels").where("left_content_hash IS NOT NULL").groupBy(F.col("left_content_hash").alias("content_hash")).agg(F.min("label").alias("label"), F.lit(True).alias("_known"))
    j = T(s, d, "product_matches").where("source IS NOT NULL AND id IS NOT NULL").join(p, "content_hash", "left")
    missing = j.where("_known IS NULL").select("source", "id").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("id"))).where("k <= 5")
    first = missing.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("unmatched"))
    return j.groupBy("source").agg(F.count("_known").alias("matched"), F.count_if(F.col("_known").isNull()).alias("others")).join(first, "source", "left").select("source", "matched", "others", F.coalesce("unmatched", F.lit("")).alias("unmatched"))


def shape_examples(s, d):
    """The five commonest shapes of titles, letters and digits replaced by one of each, with their three least titles."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.col("title")), "[0-9]+", "9"), "[A-Za-z]+", "a"), "[^a9]+", " ")
    v = T(s, d, "category_listings").where("title IS NOT NULL").select(shape.alias("shape"), "title")
    top = v.groupBy("shape").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(5)
    each = v.distinct().withColumn("k", F.row_number().over(Window.partitionBy("shape").orderBy("title"))).where("k <= 3")
    examples = each.groupBy("shape").agg(F.array_join(F.array_sort(F.collect_list("title")), " | ").alias("examples"))
    return top.join(examples, "shape").select("shape", "n", "examples")


def label_report(s, d):
    """Per tier: rows, labelled ones, pairs labelled more than once, of these the share that agrees with itself, and the annotators."""
    p = T(s, d, "phase3_labels").where("tier IS NOT NULL AND pair_id IS NOT NULL AND occurrence_id IS NOT NULL").select("tier", "pair_id", "occurrence_id", "label", "labeled_by").distinct()
    pairs = p.groupBy("tier", "pair_id").agg(F.count("*").alias("rows"), F.count("label").alias("labelled"), F.count_distinct("label").alias("kinds"), F.count_distinct("occurrence_id").alias("times"))
    again = (F.col("times") > 1) & (F.col("labelled") > 1)
    g = pairs.groupBy("tier").agg(F.sum("rows").alias("rows_"), F.sum("labelled").alias("labelled"), F.count_if(again).alias("repeated"), F.count_if(again & (F.col("kinds") == 1)).alias("agreeing"))
    return g.join(p.groupBy("tier").agg(F.count_distinct("labeled_by").alias("annotators")), "tier").select("tier", "rows_", "labelled", "repeated", F.round(F.try_divide("agreeing", "repeated"), 6).alias("agreement"), "annotators")


def open_findings(s, d):
    """Findings of the two files' comparison that nobody has acknowledged, by kind; pairs that only the others have are exempt."""
    p = T(s, d, "phase3_labels").where("pair_id IS NOT NULL").withColumn("mine", F.col("labeled_by").isin("annotator_0", "annotator_1"))
    pick = lambda c: p.where(c).groupBy("pair_id").agg(F.min("split").alias("split"), F.min("tier").alias("tier"), F.min("label").alias("label"))
    found = B.compatible(pick("mine"), pick("NOT mine"), "pair_id", ["split", "tier"], "label").where("finding NOT IN ('equal', 'missing_left')")
    known = p.where("labeled_by = 'annotator_3'").select("pair_id").distinct()
    return found.join(known, "pair_id", "left_anti").groupBy("finding").agg(F.count("*").alias("n"))


def count_parity(s, d):
    """Pairs of the first occurrences against all rows per split and tier, and how far they lie apart."""
    p = T(s, d, "phase3_labels").where("pair_id IS NOT NULL AND occurrence_id IS NOT NULL").select("pair_id", "occurrence_id", B.split_of(F.col("split")).alias("split"), "tier").distinct()
    first = p.groupBy("pair_id").agg(F.min_by(F.struct("split", "tier"), F.struct("occurrence_id", "split", "tier")).alias("f")).groupBy("f.split", "f.tier").agg(F.count("*").alias("pairs"))
    rows = p.groupBy("split", "tier").agg(F.count("*").alias("rows_"))
    a, b = first.alias("a"), rows.alias("b")
    j = a.join(b, F.col("a.split").eqNullSafe(F.col("b.split")) & F.col("a.tier").eqNullSafe(F.col("b.tier")), "full_outer")
    pairs, every = F.coalesce("a.pairs", F.lit(0)), F.coalesce("b.rows_", F.lit(0))
    return j.select(F.coalesce("a.split", "b.split").alias("split"), F.coalesce("a.tier", "b.tier").alias("tier"), pairs.alias("pairs"), every.alias("rows_"), (every - pairs).alias("more"))


def collection_status(s, d):
    """Per source its last good day, alerts, failures, listings of that day, and the share of its titles that can be keyed."""
    r = T(s, d, "scrape_runs").where("source IS NOT NULL")
    runs = r.groupBy("source").agg(F.max(F.when(F.col("status") == "ok", F.to_date("started_at"))).alias("day"), F.count_if(F.col("status") == "volume_alert").alias("alerts"), F.count_if(F.col("status") == "failed").alias("failures"))
    n = T(s, d, "raw_listings").groupBy("source", F.col("collected_date").alias("day")).agg(F.count("*").alias("listings"))
    k = P._keyed(s, d).groupBy(F.col("sample_source").alias("source")).agg(F.round(F.avg(F.col("key").isNotNull().cast("int")), 6).alias("keyable"))
    return runs.join(n, ["source", "day"], "left").join(k, "source", "left").select("source", F.date_format("day", "yyyy-MM-dd").alias("day"), "alerts", "failures", F.coalesce("listings", F.lit(0)).alias("listings"), "keyable")


def price_position_percent(s, d):
    """Each product's price against the median of its competitors' last prices, in percent; null where that is 0."""
    m = T(s, d, "product_matches").where("competitor_price IS NOT NULL AND product_id IS NOT NULL AND source IS NOT NULL")
    last = m.groupBy("product_id", "source").agg(F.max_by(F.col("competitor_price").cast("double"), F.struct("price_date", "created_at", "id")).alias("p"))
    med = last.groupBy(F.col("product_id").alias("id")).agg(F.median("p").alias("m"), F.count("*").alias("shops"))
    j = T(s, d, "products").where("current_price IS NOT NULL").select("id", F.col("current_price").cast("double").alias("c")).join(med, "id")
    return j.select("id", "shops", F.round((F.col("c") - F.col("m")) * 100 / F.nullif("m", F.lit(0.0)), 4).alias("percent"))


def ledger_guard(s, d):
    """Second occurrences of pairs that are in the first annotator's ledger already and don't come from a reviewer."""
    p = T(s, d, "phase3_labels").where("pair_id IS NOT NULL AND occurrence_id IS NOT NULL")
    ledger = p.where("labeled_by = 'annotator_0'").select("pair_id").distinct()
    rows = p.where("labeled_by <> 'annotator_0'").select("pair_id", "occurrence_id", (F.col("labeled_by") == "annotator_3").alias("again")).distinct()
    return sinks.ledger_violations(ledger, rows, "pair_id", "again").select("pair_id", "occurrence_id")


def seeded_series(s, d):
    """A catalogue of thirty rows and a price of each for every one of 180 days, made of arithmetic alone: rows and sums per product."""
    x = s.range(30 * 180).select((F.col("id") % 30).alias("product"), F.floor(F.col("id") / 30).alias("day"))
    x = x.withColumn("cents", 1000 + F.col("product") * 137 + (F.col("product") * 7 + F.col("day")) % 11 * 5)
    return x.groupBy("product").agg(F.count("*").alias("days"), F.sum("cents").alias("total"), F.min("cents").alias("least"), F.max("cents").alias("most"))


def cost_per_thousand(s, d):
    """Per source the listings a second of its good runs, the hours that a million takes, and the cost of a thousand at half a unit an hour."""
    r = T(s, d, "scrape_runs").where("status = 'ok' AND duration_seconds > 0 AND items_ingested > 0 AND source IS NOT NULL")
    g = r.groupBy("source").agg((F.sum("items_ingested") / F.sum("duration_seconds")).alias("rate"))
    return g.select("source", F.round("rate", 6).alias("rate"), F.round(1_000_000 / F.col("rate") / 3600, 4).alias("hours"), F.round(0.5 * 1000 / F.col("rate") / 3600, 6).alias("cost"))


def pair_prompts(s, d):
    """The text that asks about two listings, of every labelled pair whose titles are known."""
    n = T(s, d, "norm_listings").groupBy("content_hash").agg(F.min("sample_title").alias("t")).where("t IS NOT NULL")
    p = T(s, d, "phase3_labels").where("occurrence_id IS NOT NULL").select("occurrence_id", "left_content_hash", "right_content_hash").distinct()
    j = p.join(n.select(F.col("content_hash").alias("left_content_hash"), F.col("t").alias("x")), "left_content_hash").join(n.select(F.col("content_hash").alias("right_content_hash"), F.col("t").alias("y")), "right_content_hash")
    return j.select("occurrence_id", F.format_string("Are these two listings the same article? Answer Yes or No.\nA: %s\nB: %s", F.col("x"), F.col("y")).alias("prompt"))


def events_without_decoration(s, d):
    """Event days per source when listings whose promotions never start or end are taken at their plain price."""
    flagged = R.decorative_promo(s, d).withColumn("_off", F.lit(True))
    x = R.daily(s, d).join(flagged, ["source", "external_id"], "left").withColumn("c", F.when(F.col("_off").isNull(), F.col("c"))).drop("_off")
    p = S.day_pairs(x, ["source", "external_id"], "d", ["price", "c"]).where("price IS NOT NULL AND prev_price IS NOT NULL").withColumn("kinds", S.move_kinds("price", "c", 2))
    return p.where((F.size("kinds") > 0) & ~F.array_contains("kinds", "sub_threshold")).groupBy("source").agg(F.count("*").alias("events"))


def category_walk(s, d):
    """Handles that a walk of the shops' pages takes: a page without vendors failed, one of fewer than three entries is the last, eight pages a shop at most."""
    c = T(s, d, "category_listings").where("source IS NOT NULL AND page_no IS NOT NULL AND handle IS NOT NULL").select("source", "page_no", "handle", "id", "vendor")
    p = c.groupBy("source", "page_no").agg((F.count("vendor") == 0).alias("failed"), (F.count("*") >= 3).alias("more"))
    return pages.category_walk(p, c, "source", "page_no", "failed", "more", "handle", "id", 8).select("source", "page_no", "handle", "id")


def gate_sample(s, d):
    """A hundred listings: two of every way of being hard to read, the rest by source."""
    n = T(s, d, "norm_listings").where("sample_title IS NOT NULL AND id IS NOT NULL").select("id", "sample_source", L.hard_cases(L.folded(F.col("sample_title"))).alias("cases"))
    return sample_with_cases(n, "id", "sample_source", "cases", 100, 2)


QUERIES = {f.__name__: f for f in (
    extracted_attributes, title_flavours, title_stages, title_forms, parsed_replies, label_lookup, shape_examples, label_report, open_findings, count_parity, collection_status, price_position_percent, ledger_guard, seeded_series, cost_per_thousand, pair_prompts,
    events_without_decoration, category_walk, gate_sample,
)}

_NAMES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in A.FLAVOURS.items()) + "}"
_FORMS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in A.FORMS.items()) + "}"
_COMPARED = """p as (select pair_id, split, tier, label, labeled_by, labeled_by in ('annotator_0', 'annotator_1') mine from phase3_labels where pair_id is not null), a as (select pair_id, min(split) s, min(tier) t, min(label) l from p where mine group by 1), b as (select pair_id, min(split) s, min(tier) t, min(label) l from p where not mine group by 1),
  f as (select coalesce(a.pair_id, b.pair_id) pair_id, case when a.pair_id is null then 'missing_left' when b.pair_id is null then 'missing_right' when a.s is distinct from b.s then 'split' when a.t is distinct from b.t then 'tier' when a.l is distinct from b.l then 'changed' else 'equal' end finding from a full join b on a.pair_id = b.pair_id)"""

_HARD = P.SQL["hard_case_labels"].replace("array_to_string(list_sort(", "list_sort(").replace("lambda x: x is not null)), ',') cases", "lambda x: x is not null)) cases").replace("where sample_title is not null", "where sample_title is not null and id is not null")

SQL = {
    "title_flavours": f"with a as (select id, list_transform(regexp_extract_all({P._fold('sample_title')}, '\\b({'|'.join(A.FLAVOURS)})\\b', 1), lambda w: {_NAMES}[w]) l from norm_listings) select id, nullif(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '+'), '') flavour from a",
    "title_stages": f"with a as (select id, nullif(regexp_extract({P._fold('sample_title')}, '{A.STAGES}', 1), '') w, coalesce(nullif(regexp_extract(sample_title, '\\((\\d{{1,2}})\\+\\)', 1), ''), nullif(regexp_extract(sample_title, '\\b(\\d{{1,2}})\\+(?:\\D|$)', 1), '')) g from norm_listings) select id, case when w like 'adult%' then 'adult' else w end || coalesce('+' || g, '') stage from a",
    "title_forms": f"with a as (select id, regexp_replace({P._fold('sample_title')}, 'semi[- ]umed', 'semi_', 'g') t from norm_listings) select id, {_FORMS}[coalesce(nullif(regexp_extract(t, '{A.FORM_FIRST}', 1), ''), nullif(regexp_extract(t, '{A.FORM_THEN}', 1), ''))] form from a",
    "parsed_replies": """select id, case when id % 5 <> 0 and id % 7 <> 0 and competitor_price > 0 then cast(competitor_price as double) end price, case when id % 5 <> 0 and id % 7 <> 0 and competitor_price > 0 then 'as ' || coalesce(source, '?') end rationale,
        case when id % 5 = 0 then 'not one PRICE line' when id % 7 = 0 then 'not of the form' when competitor_price <= 0 then 'price is not positive' end as error from product_matches where id is not null and competitor_price is not null""",
    "label_lookup": """with p as (select distinct left_content_hash h from phase3_labels where left_content_hash is not null), j as (select m.source, m.id, p.h is not null k from product_matches m left join p on p.h = m.content_hash where m.source is not null and m.id is not null), u as (select source, id, row_number() over (partition by source order by id) n from j where not k)
        select j.source, count(*) filter (k) matched, count(*) filter (not k) others, coalesce((select string_agg(cast(id as varchar), ',' order by id) from u where u.source = j.source and n <= 5), '') unmatched from j group by 1""",
    "shape_examples": """with v as (select regexp_replace(regexp_replace(regexp_replace(trim(title), '[0-9]+', '9', 'g'), '[A-Za-z]+', 'a', 'g'), '[^a9]+', ' ', 'g') shape, title from category_listings where title is not null), t as (select shape, count(*) n from v group by 1 order by 2 desc, 1 limit 5), e as (select shape, title, row_number() over (partition by shape order by title) k from (select distinct * from v))
        select shape, n, (select string_agg(title, ' | ' order by title) from e where e.shape = t.shape and k <= 3) examples from t""",
    "label_report": """with p as (select distinct tier, pair_id, occurrence_id, label, labeled_by from phase3_labels where tier is not null and pair_id is not null and occurrence_id is not null), q as (select tier, pair_id, count(*) r, count(label) l, count(distinct label) k, count(distinct occurrence_id) o from p group by 1, 2),
        g as (select tier, cast(sum(r) as bigint) rows_, cast(sum(l) as bigint) labelled, count(*) filter (o > 1 and l > 1) repeated, count(*) filter (o > 1 and l > 1 and k = 1) agreeing from q group by 1) select tier, rows_, labelled, repeated, round(agreeing / nullif(cast(repeated as double), 0), 6) agreement, (select count(distinct labeled_by) from p where p.tier = g.tier) annotators from g""",
    "open_findings": f"with {_COMPARED} select finding, count(*) n from f where finding not in ('equal', 'missing_left') and pair_id not in (select pair_id from p where labeled_by = 'annotator_3') group by 1",
    "count_parity": f"""with p as (select distinct pair_id, occurrence_id, {P._SPLIT} sp, tier from phase3_labels where pair_id is not null and occurrence_id is not null), f as (select * from (select *, row_number() over (partition by pair_id order by occurrence_id, sp nulls first, tier nulls first) k from p) where k = 1), a as (select sp, tier, count(*) n from f group by all), b as (select sp, tier, count(*) n from p group by all)
        select b.sp as split, b.tier, coalesce(a.n, 0) pairs, b.n rows_, b.n - coalesce(a.n, 0) more from b left join a on a.sp is not distinct from b.sp and a.tier is not distinct from b.tier""",
    "collection_status": f"""with {P._KEYS}, r as (select source, max(case when status = 'ok' then cast(started_at at time zone 'UTC' as date) end) d, count(*) filter (status = 'volume_alert') alerts, count(*) filter (status = 'failed') failures from scrape_runs where source is not null group by 1)
        select r.source, strftime(d, '%Y-%m-%d') as day, alerts, failures, (select count(*) from raw_listings l where l.source = r.source and l.collected_date = d) listings, (select round(avg(case when key is null then 0 else 1 end), 6) from k where k.sample_source = r.source) keyable from r""",
    "price_position_percent": """with l as (select product_id, cast(competitor_price as double) p, row_number() over (partition by product_id, source order by price_date desc nulls last, created_at desc nulls last, id desc) k from product_matches where competitor_price is not null and product_id is not null and source is not null), m as (select product_id, median(p) m, count(*) n from l where k = 1 group by 1)
        select id, n shops, round((cast(current_price as double) - m) * 100 / nullif(m, 0), 4) percent from products join m on m.product_id = id where current_price is not null""",
    "ledger_guard": "select distinct pair_id, occurrence_id from phase3_labels where pair_id is not null and occurrence_id is not null and labeled_by not in ('annotator_0', 'annotator_3') and pair_id in (select pair_id from phase3_labels where labeled_by = 'annotator_0' and pair_id is not null and occurrence_id is not null)",
    "seeded_series": "with x as (select i % 30 product, i // 30 as d from range(5400) t(i)), y as (select product, 1000 + product * 137 + (product * 7 + d) % 11 * 5 c from x) select product, count(*) as days, cast(sum(c) as bigint) total, min(c) least, max(c) most from y group by 1",
    "cost_per_thousand": "with g as (select source, sum(items_ingested) / sum(duration_seconds) r from scrape_runs where status = 'ok' and duration_seconds > 0 and items_ingested > 0 and source is not null group by 1) select source, round(r, 6) rate, round(1000000 / r / 3600, 4) as hours, round(0.5 * 1000 / r / 3600, 6) cost from g",
    "events_without_decoration": f"""with {R._K2}, o as (select source, external_id, avg(case when c > price then 1 else 0 end) share from daily group by all), e as (select source, external_id, count(*) filter (len(list_filter(ks, lambda x: x like 'promo%')) > 0) k from kinds group by all),
        f as (select o.source, o.external_id from o left join e using (source, external_id) where share >= 0.9 and coalesce(k, 0) = 0), x as (select d.source, d.external_id, d.d, d.price, case when f.source is null then d.c end c from daily d left join f on f.source = d.source and f.external_id = d.external_id),
        y as (select a.source, a.price, a.c, b.price p0, b.c c0 from x a join x b on a.source = b.source and a.external_id = b.external_id and b.d = a.d - 1 where a.price is not null and b.price is not null), z as (select *, coalesce(c > price, false) n, coalesce(c0 > p0, false) w, case when coalesce(c > price, false) then c else price end bn, case when coalesce(c0 > p0, false) then c0 else p0 end bw from y)
        select source, count(*) events from z where n <> w or (bw = 0 and bn <> 0) or (bw <> 0 and abs(bn - bw) * 100 >= bw * 2) or (n and w and ((p0 = 0 and price <> 0) or (p0 <> 0 and abs(price - p0) * 100 >= p0 * 2))) group by 1""",
    "category_walk": """with c as (select source, page_no, handle, id, vendor from category_listings where source is not null and page_no is not null and handle is not null), p as (select source, page_no, count(vendor) = 0 f, count(*) >= 3 m from c group by 1, 2),
        q as (select *, coalesce(sum(case when f or not m then 1 else 0 end) over (partition by source order by page_no rows between unbounded preceding and 1 preceding), 0) b, row_number() over (partition by source order by page_no) k from p),
        r as (select c.*, row_number() over (partition by handle order by source, page_no, id) n from c join q using (source, page_no) where b = 0 and k <= 8 and not f) select source, page_no, handle, id from r where n = 1""",
    "gate_sample": "with h as materialized (" + _HARD + """), d as (select h.id, n.sample_source s, h.cases, md5('7:' || h.id) u from h join norm_listings n on n.id = h.id), e as (select id, row_number() over (partition by c order by u, id) k from (select id, u, unnest(cases) c from d)), a as (select distinct id from e where k <= 2),
        g as (select s, round_even((100 - (select count(*) from a)) * cast(count(*) as double) / (select count(*) from d), 0) n from d group by 1), f as (select d.id, d.s, row_number() over (partition by d.s order by u, d.id) k from d where d.id not in (select id from a)), c as (select id from a union select f.id from f join g on f.s is not distinct from g.s where k <= g.n)
        select id from (select d.id, d.u, case when c.id is null then 1 else 0 end r from d left join c on c.id = d.id) order by r, u, id limit 100""",
    "pair_prompts": "with n as (select content_hash h, min(sample_title) t from norm_listings group by 1 having min(sample_title) is not null), p as (select distinct occurrence_id, left_content_hash x, right_content_hash y from phase3_labels where occurrence_id is not null) select occurrence_id, 'Are these two listings the same article? Answer Yes or No.' || chr(10) || 'A: ' || a.t || chr(10) || 'B: ' || b.t prompt from p join n a on a.h = x join n b on b.h = y",
}
