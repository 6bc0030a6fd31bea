"""Daily series of the shops' listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkmill.operators import keyed as K
from sparkmill.operators import series as S
from sparkmill.session import table as T

_DAILY = """daily as (select source, external_id, collected_date d, price, compare_at_price c from (select *, row_number() over (partition by source, external_id, collected_date order by id desc) k from raw_listings
  where source is not null and external_id is not null and collected_date is not null) where k = 1)"""
_KINDS = (
    _DAILY
    + """, p as (select a.*, b.price p0, b.c c0 from daily a join daily b on a.source = b.source and a.external_id = b.external_id and b.d = a.d - 1 where a.price is not null and b.price is not null),
  q as (select *, coalesce(c > price, false) pn, coalesce(c0 > p0, false) pw, case when coalesce(c > price, false) then c else price end bn, case when coalesce(c0 > p0, false) then c0 else p0 end bw from p),
  r as (select *, list_filter([case when (bw = 0 and bn <> 0) or (bw <> 0 and abs(bn - bw) * 100 >= bw * {n}) then 'base_change' end, case when pn and not pw then 'promo_start' end, case when pw and not pn then 'promo_end' end,
    case when pn and pw and ((p0 = 0 and price <> 0) or (p0 <> 0 and abs(price - p0) * 100 >= p0 * {n})) then 'promo_depth' end], lambda x: x is not null) ks from q),
  kinds as (select source, external_id, d, case when len(ks) > 0 then ks when bn <> bw or (pn and pw and price <> p0) then ['sub_threshold'] else [] end ks, len(ks) > 0 ev from r)"""
)


def daily(s, d):
    """One observation per listing and day: the row with the greatest id."""
    r = T(s, d, "raw_listings").where("source IS NOT NULL AND external_id IS NOT NULL AND collected_date IS NOT NULL").select("source", "external_id", F.col("collected_date").alias("d"), "id", "price", F.col("compare_at_price").alias("c"))
    return K.one_per_key(r, ["source", "external_id", "d"], ["id"])


def _events(s, d, percent):
    p = S.day_pairs(daily(s, d), ["source", "external_id"], "d", ["price", "c"]).where("price IS NOT NULL AND prev_price IS NOT NULL")
    kinds = S.move_kinds("price", "c", percent)
    return p.withColumn("kinds", kinds).withColumn("event", (F.size("kinds") > 0) & ~F.array_contains("kinds", "sub_threshold"))


def day_pair_join(s, d):
    return S.day_pairs(daily(s, d), ["source", "external_id"], "d", ["price"]).groupBy("source").agg(F.count("*").alias("pairs"))


def price_events(s, d):
    """On how many day pairs of every source each kind of change holds, all kinds of a day; a move counts from two percent."""
    return _events(s, d, 2).select("source", F.explode("kinds").alias("kind")).groupBy("source", "kind").agg(F.count("*").alias("n"))


def events_per_listing(s, d):
    """Listings by their number of event days, three or more as three."""
    e = _events(s, d, 2).groupBy("source", "external_id").agg(F.count_if("event").alias("k"))
    return e.groupBy("source", F.least("k", F.lit(3)).alias("bucket")).agg(F.count("*").alias("n"))


def evaluable_events(s, d):
    """Events with seven quiet days before and seven observed days from them on, one missing day forgiven on either side."""
    days = daily(s, d).select("source", "external_id", "d")
    e = _events(s, d, 2).where("event").select("source", "external_id", "d", F.lit(True).alias("event"))
    x = days.join(e, ["source", "external_id", "d"], "left").withColumn("event", F.coalesce("event", F.lit(False)))
    return S.evaluable(x, ["source", "external_id"], "d", "event", 7, 1).select("source", "external_id", F.date_format("d", "yyyy-MM-dd").alias("day"))


def decorative_promo(s, d):
    """Listings on promotion on nine tenths of their days without a promotion's start, end or change."""
    on = daily(s, d).groupBy("source", "external_id").agg(F.avg(F.coalesce(F.col("c") > F.col("price"), F.lit(False)).cast("int")).alias("share"))
    e = _events(s, d, 2).groupBy("source", "external_id").agg(F.count_if(F.exists("kinds", lambda k: k.startswith("promo_"))).alias("k"))
    return on.join(e, ["source", "external_id"], "left").where("share >= 0.9 AND coalesce(k, 0) = 0").select("source", "external_id")


def streak_and_gaps(s, d):
    days = T(s, d, "raw_listings").select("source", "collected_date").where("source IS NOT NULL AND collected_date IS NOT NULL")
    g = S.gaps(days, ["source"], "collected_date").groupBy("source").agg(F.count("*").alias("gap_days"))
    return S.streak_at_end(days, ["source"], "collected_date").join(g, "source", "left").select("source", F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "streak", F.coalesce("gap_days", F.lit(0)).alias("gap_days"))


def gap_dates(s, d):
    days = T(s, d, "raw_listings").select("source", "external_id", "collected_date").where("source IS NOT NULL AND external_id IS NOT NULL")
    return S.gaps(days, ["source", "external_id"], "collected_date").groupBy("source").agg(F.count("*").alias("missing"))


def history_span(s, d):
    """Span, days and staleness of every source and of the union of all (source null)."""
    r = T(s, d, "raw_listings").where("collected_date IS NOT NULL AND source IS NOT NULL")
    g = r.rollup("source").agg(F.min("collected_date").alias("a"), F.max("collected_date").alias("b"), F.count_distinct("collected_date").alias("days"))
    top = F.max("b").over(Window.partitionBy())
    return g.select("source", "days", (F.datediff("b", "a") + 1).alias("span"), (F.datediff(top, F.col("b")) > 1).alias("stale"))


def holdout_start(s, d):
    days = T(s, d, "raw_listings").where("source IS NOT NULL").select("source", "collected_date")
    return S.nth_last_day(days, ["source"], "collected_date", 14).select("source", F.date_format("start", "yyyy-MM-dd").alias("start"))


def new_titles_per_day(s, d):
    r = T(s, d, "raw_listings").where("source IS NOT NULL").select("source", "content_hash", "collected_date")
    return S.new_per_day(r, "source", "content_hash", "collected_date").select("source", F.date_format("collected_date", "yyyy-MM-dd").alias("day"), "new_items")


def hash_compress(s, d):
    """How many payload hashes a listing's history must store when repeats of the last stored one are left out."""
    r = T(s, d, "raw_listings").where("source IS NOT NULL AND external_id IS NOT NULL").select("source", "external_id", "collected_date", "id", "content_hash")
    return S.compress(r, ["source", "external_id"], ["collected_date", "id"], "content_hash", "stored").groupBy("source").agg(F.count("content_hash").alias("hashes"), F.count("stored").alias("stored"))


def payload_bytes_saved(s, d):
    """Characters of payload that storing only changes frees."""
    r = T(s, d, "raw_listings").where("source IS NOT NULL AND external_id IS NOT NULL AND raw_payload_sha256 IS NOT NULL").select("source", "external_id", "collected_date", "id", "raw_payload_sha256", F.length("raw_payload").alias("size"))
    c = S.compress(r, ["source", "external_id"], ["collected_date", "id"], "raw_payload_sha256", "stored")
    return c.groupBy("source").agg(F.sum(F.when(F.col("stored").isNull(), F.col("size")).otherwise(0)).alias("freed"))


def first_n_days_window(s, d):
    r = T(s, d, "raw_listings").where("source IS NOT NULL AND collected_date IS NOT NULL").select("source", "collected_date", "external_id")
    return S.first_days(r, ["source"], "collected_date", 2).groupBy("source").agg(F.count("*").alias("rows_"), F.count_distinct("external_id").alias("listings"))


def sliding_counts(s, d):
    """Listings' rows of each source in the seven days up to each day."""
    r = T(s, d, "raw_listings").where("source IS NOT NULL AND collected_date IS NOT NULL").groupBy("source", "collected_date").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.datediff("collected_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-6, 0)
    return r.select("source", F.date_format("collected_date", "yyyy-MM-dd").alias("day"), F.sum("n").over(w).alias("week"))


def session_islands(s, d):
    """Sessions of every user's events: a pause of six hours or more begins a new one."""
    e = T(s, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).where("user_id IS NOT NULL AND t IS NOT NULL")
    w = Window.partitionBy("user_id").orderBy("t")
    e = e.withColumn("new", (F.col("t") - F.lag("t").over(w) >= 6 * 3_600_000_000).cast("int"))
    e = e.withColumn("session", F.sum(F.coalesce("new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id").agg(F.max("session").alias("k")).select("user_id", (F.col("k") + 1).alias("sessions"))


def tumbling_counts(s, d):
    """Events by type in windows of a day."""
    e = T(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


QUERIES = {f.__name__: f for f in (
    day_pair_join, price_events, events_per_listing, evaluable_events, decorative_promo, streak_and_gaps, gap_dates, history_span, holdout_start, new_titles_per_day, hash_compress, payload_bytes_saved, first_n_days_window, sliding_counts, session_islands, tumbling_counts,
)}
_K2 = _KINDS.replace("{n}", "2")
SQL = {
    "day_pair_join": f"with {_DAILY} select a.source, count(*) pairs from daily a join daily b on a.source = b.source and a.external_id = b.external_id and b.d = a.d - 1 group by 1",
    "price_events": f"with {_K2} select source, kind, count(*) n from (select source, unnest(ks) kind from kinds) group by all",
    "events_per_listing": f"with {_K2}, e as (select source, external_id, count(*) filter (ev) k from kinds group by all) select source, least(k, 3) bucket, count(*) n from e group by all",
    "evaluable_events": f"""with {_K2}, e as (select d.*, coalesce(k.ev, false) ev from daily d left join kinds k on k.source = d.source and k.external_id = d.external_id and k.d = d.d),
        w as (select e.*, (select count(*) from e x where x.source = e.source and x.external_id = e.external_id and x.d between e.d - 7 and e.d - 1) nb, (select count(*) from e x where x.source = e.source and x.external_id = e.external_id and x.ev and x.d between e.d - 7 and e.d - 1) ne,
        (select count(*) from e x where x.source = e.source and x.external_id = e.external_id and x.d between e.d and e.d + 6) na from e where ev) select source, external_id, strftime(d, '%Y-%m-%d') as day from w where nb >= 6 and ne = 0 and na >= 6""",
    "decorative_promo": f"""with {_K2}, o as (select source, external_id, avg(case when c > price then 1 else 0 end) share from daily group by all), e as (select source, external_id, count(*) filter (len(list_filter(ks, lambda x: x like 'promo%')) > 0) k from kinds group by all)
        select o.source, o.external_id from o left join e using (source, external_id) where share >= 0.9 and coalesce(k, 0) = 0""",
    "streak_and_gaps": """with d as (select distinct source, collected_date d from raw_listings where source is not null and collected_date is not null), i as (select source, d, d - cast(row_number() over (partition by source order by d) as integer) g from d),
        r as (select source, g, max(d) b, count(*) n from i group by all), t as (select source, max(b) b from r group by 1), x as (select source, date_diff('day', min(d), max(d)) + 1 - count(*) gap from d group by 1)
        select t.source, strftime(t.b, '%Y-%m-%d') last_day, r.n streak, x.gap gap_days from t join r on r.source = t.source and r.b = t.b join x on x.source = t.source""",
    "gap_dates": """with d as (select distinct source, external_id, collected_date d from raw_listings where source is not null and external_id is not null and collected_date is not null), x as (select source, external_id, date_diff('day', min(d), max(d)) + 1 - count(*) gap from d group by all)
        select source, cast(sum(gap) as bigint) missing from x where gap > 0 group by 1""",
    "history_span": """with g as (select source, min(collected_date) a, max(collected_date) b, count(distinct collected_date) as days from raw_listings where collected_date is not null and source is not null group by rollup (source))
        select source, days, date_diff('day', a, b) + 1 as span, date_diff('day', b, max(b) over ()) > 1 as stale from g""",
    "holdout_start": "select source, strftime(min(d), '%Y-%m-%d') as start from (select *, row_number() over (partition by source order by d desc) k from (select distinct source, collected_date d from raw_listings where source is not null and collected_date is not null)) where k <= 14 group by 1",
    "new_titles_per_day": """with f as (select source, d, count(*) n from (select source, content_hash, min(collected_date) d from raw_listings where source is not null and content_hash is not null and collected_date is not null group by 1, 2) group by 1, 2),
        k as (select source, d, row_number() over (partition by source order by d) k from (select distinct source, collected_date d from raw_listings where source is not null and collected_date is not null))
        select k.source, strftime(k.d, '%Y-%m-%d') as day, coalesce(f.n, 0) new_items from k left join f on f.source = k.source and f.d = k.d where k.k > 1""",
    "hash_compress": """with r as (select source, content_hash h, last_value(content_hash ignore nulls) over (partition by source, external_id order by collected_date nulls first, id rows between unbounded preceding and 1 preceding) p from raw_listings where source is not null and external_id is not null)
        select source, count(h) hashes, count(*) filter (h is not null and h is distinct from p) stored from r group by 1""",
    "payload_bytes_saved": """with r as (select source, raw_payload_sha256 h, length(raw_payload) l, lag(raw_payload_sha256) over (partition by source, external_id order by collected_date nulls first, id) p from raw_listings where source is not null and external_id is not null and raw_payload_sha256 is not null)
        select source, cast(sum(case when h is not distinct from p then l else 0 end) as bigint) freed from r group by 1""",
    "first_n_days_window": "select source, count(*) rows_, count(distinct external_id) listings from (select *, dense_rank() over (partition by source order by collected_date) k from raw_listings where source is not null and collected_date is not null) where k <= 2 group by 1",
    "sliding_counts": "with r as (select source, collected_date d, count(*) n from raw_listings where source is not null and collected_date is not null group by all) select source, strftime(d, '%Y-%m-%d') as day, cast(sum(n) over (partition by source order by d range between interval 6 days preceding and current row) as bigint) as week from r",
    "session_islands": "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hours then 1 else 0 end n from events where user_id is not null and ts is not null) select user_id, cast(sum(n) as bigint) + 1 as sessions from e group by 1",
    "tumbling_counts": "select event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) n from events where ts is not null group by all",
}
