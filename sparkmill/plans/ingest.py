"""Scans, sinks and streams over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmill.session import table as T
from sparkmill.sources import pages, sinks
from sparkmill.streaming import twins


def json_page_scan(s, d):
    """The category entries written as JSON, a page of a shop each, scanned back into one row per variant."""
    c = T(s, d, "category_listings").select(F.concat_ws("/", "source", "page_no").alias("page"), F.struct("id", "title", "handle", "vendor", "product_type", "variants").alias("p"))
    body = c.groupBy("page").agg(F.to_json(F.struct(F.sort_array(F.collect_list("p")).alias("products"))).alias("body"))
    r = pages.json_products(body, "body", "page").where("variant_id IS NOT NULL")
    return r.groupBy("url").agg(F.count("*").alias("variants"), F.count_distinct("product_id").alias("products"), F.count("price").alias("priced"))


def html_card_scan(s, d):
    """The entries written as cards with a JSON attribute, a page of a shop each, and scanned back; every card whose variant's price isn't the shown one is an error."""
    c = T(s, d, "category_listings").where("id IS NOT NULL AND source IS NOT NULL AND page_no IS NOT NULL").select("id", F.concat_ws("/", "source", "page_no").alias("page"), "title", F.try_element_at("variants", F.lit(1))["price"].alias("price"))
    data = F.to_json(F.struct("id", "title", "price"))
    for sign, entity in {"&": "&amp;", '"': "&quot;", "<": "&lt;", ">": "&gt;"}.items():
        data = F.replace(data, F.lit(sign), F.lit(entity))
    # every seventh card shows another price
    shown = F.when(F.col("id") % 7 == 0, F.lit("1,01")).otherwise(F.coalesce("price", F.lit("")))
    card = F.concat(F.lit('<li class="card" data-product="'), data, F.lit('"><b>'), shown, F.lit("</b></li>"))
    p = c.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", card.alias("c")))), lambda x: x["c"]), "\n").alias("html"))
    r = pages.attribute_cards(p, r'<li class="card".*?</li>', r'data-product="([^"]*)"', {"id": "$.id", "title": "$.title", "price": "$.price"}, r"<b>([^<]*)</b>", "html", "page")
    return r.groupBy("url").agg(F.count("*").alias("cards"), F.count("title").alias("titled"), F.count_if(F.col("error") == "price").alias("wrong"), F.count_if(F.col("error") == "no data").alias("broken"))


def embedded_state_scan(s, d):
    """Listings written as a page's cache of products, shops and cities by reference, and read back over two references; shops of every third letter have no city."""
    r = T(s, d, "product_matches").where("source IS NOT NULL AND id IS NOT NULL AND product_id IS NOT NULL").select("id", "source", (F.col("product_id") % 20).alias("page"))
    node = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    shop = F.concat(F.lit("s:"), F.col("source"))
    rows = r.select("page", node(F.concat(F.lit("p:"), F.col("id")), F.to_json(F.struct(shop.alias("shop")))).alias("n"))
    rows = rows.unionByName(r.select("page", "source").distinct().select("page", node(shop, F.to_json(F.struct(F.concat(F.lit("c:"), F.substring("source", 1, 1)).alias("city")))).alias("n")))
    rows = rows.unionByName(r.select("page", F.substring("source", 1, 1).alias("i")).distinct().where(F.ascii("i") % 3 != 0).select("page", node(F.concat(F.lit("c:"), F.col("i")), F.to_json(F.struct(F.col("i").alias("name")))).alias("n")))
    html = rows.groupBy("page").agg(F.concat(F.lit("<script>STATE="), F.to_json(F.map_from_entries(F.collect_list("n"))), F.lit("</script>")).alias("html"))
    got = pages.follow_all(pages.embedded_state(html.select(F.col("page").cast("string").alias("url"), "html"), r"STATE=(\{.*\})</script>"), ["$.shop", "$.city"], "p:")
    return got.groupBy("url", F.get_json_object("found", "$.name").alias("city"), "error").agg(F.count("*").alias("n"))


def first_wins_walk(s, d):
    """Handles of the category walk, the first entry of each by page."""
    c = T(s, d, "category_listings").where("handle IS NOT NULL").select("handle", "page_no", "id")
    return pages.first_wins(c, "handle", ["page_no", "id"])


def pages_read(s, d):
    """Pages that a walk with full pages of ten entries reads; a page without entries with vendors counts as failed."""
    c = T(s, d, "category_listings").where("source IS NOT NULL AND page_no IS NOT NULL").groupBy("source", "page_no").agg(F.count("*").alias("n"), (F.count("vendor") == 0).alias("failed"))
    return pages.pages_read(c, "source", "page_no", "n", "failed", 5, 3).groupBy("source").agg(F.count("*").alias("pages"))


def idempotent_upsert(s, d):
    """The listings of the last day put into those before by source and external_id, newest scraped_at last."""
    r = T(s, d, "raw_listings").where("source IS NOT NULL AND external_id IS NOT NULL").select("source", "external_id", "scraped_at", "id", F.col("price").cast("double").alias("price"), "collected_date")
    last = r.agg(F.max("collected_date").alias("m"))
    x = r.join(F.broadcast(last), F.col("collected_date") <= F.col("m"))
    keys = ["source", "external_id"]
    old, new = x.where("collected_date < m").drop("m", "collected_date"), x.where("collected_date = m").drop("m", "collected_date")
    base = sinks.upsert(old.limit(0), old, keys, ["scraped_at", "id"])
    return sinks.upsert(base, new, keys, ["scraped_at", "id"]).select("source", "external_id", "id", "price")


def sync_actions(s, d):
    """What makes the catalogue's products equal to the products that have matches."""
    p = T(s, d, "products").select("id", "stock")
    m = T(s, d, "product_matches").where("product_id IS NOT NULL").groupBy(F.col("product_id").alias("id")).agg((F.count("*") % 7).cast("int").alias("stock"))
    return sinks.upsert_and_delete(p, m, ["id"], ["stock"]).groupBy("action").agg(F.count("*").alias("n"))


def append_new_titles(s, d):
    r = T(s, d, "raw_listings").where("content_hash IS NOT NULL").select("content_hash", "title")
    return sinks.append_new(T(s, d, "norm_listings"), r, "content_hash").select("content_hash")


def backfill_counts(s, d):
    """How many values a fill of life_stage and food_form from the titles would change."""
    n = T(s, d, "norm_listings")
    low = F.lower("sample_title")
    _, counts = sinks.backfill(n, {"life_stage": F.coalesce("life_stage", F.when(low.contains("senior"), "Senior")), "food_form": F.coalesce("food_form", F.when(low.contains("dry food"), "dry"))})
    return counts


def stream_tumbling(s, d):
    """Events by type and day, by a stream that runs to its end; a final window is emitted by the watermark, so the last day is left to the batch."""
    e = twins.stream_of(s, f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    # complete mode into a table: every window, also the last
    out = twins.scratch_path(s, "tumbling")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/now")

    q = e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{out}/now").select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def stream_dedup(s, d):
    """Different users and types of a stream of events, within a watermark longer than the data."""
    e = twins.stream_of(s, f"{d}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return twins.run_to_end(twins.deduplicated(e, "ts", ["user_id", "event_type"], "3650 days"), s, "append", "dedup").select("user_id", "event_type")


def stream_changes(s, d):
    """Stored hashes per listing by a stream with the last hash as state."""
    r = twins.stream_of(s, f"{d}/raw_listings.parquet").where("source IS NOT NULL AND external_id IS NOT NULL")
    r = r.select(F.concat_ws("|", "source", "external_id").alias("listing"), F.concat(F.date_format("collected_date", "yyyyMMdd"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("at"), "content_hash")
    return twins.run_to_end(twins.changes_only(r, "listing", "at", "content_hash"), s, "append", "changes").groupBy("listing").agg(F.count("*").alias("stored"))


QUERIES = {f.__name__: f for f in (json_page_scan, html_card_scan, embedded_state_scan, first_wins_walk, pages_read, idempotent_upsert, sync_actions, append_new_titles, backfill_counts, stream_tumbling, stream_dedup, stream_changes)}

SQL = {
    "json_page_scan": "select url, count(*) variants, count(distinct id) products, count(*) filter (try_cast(v.price as decimal(12,2)) > 0) priced from (select concat_ws('/', source, cast(page_no as varchar)) url, id, title, unnest(variants) v from category_listings) where title is not null and v.id is not null group by 1",
    "html_card_scan": """with c as (select id, concat_ws('/', source, page_no) url, title, case when length(title) is null then 0 else 1 end t, variants[1].price p, trim(variants[1].price) q from category_listings where id is not null and source is not null and page_no is not null)
        select url, count(*) cards, cast(sum(t) as bigint) titled, count(*) filter ((id % 7 = 0 and try_cast(p as decimal(12,2)) is distinct from 1.01)) wrong, cast(0 as bigint) broken from c group by 1""",
    "embedded_state_scan": """select cast(product_id % 20 as varchar) url, case when ascii(source) % 3 <> 0 then left(source, 1) end city, case when ascii(source) % 3 = 0 then 'dangling at step 2' end as error, count(*) n from product_matches where source is not null and id is not null and product_id is not null group by all""",
    "first_wins_walk": "select handle, page_no, id from (select handle, page_no, id, row_number() over (partition by handle order by page_no, id) k from category_listings where handle is not null) where k = 1",
    "pages_read": """with recursive c as (select source, page_no, count(*) n, count(vendor) = 0 failed, row_number() over (partition by source order by page_no) k from category_listings where source is not null and page_no is not null group by 1, 2),
        w as (select source, k, case when failed then 1 else 0 end streak, (not failed and n < 5) stop from c where k = 1 union all select c.source, c.k, case when c.failed then w.streak + 1 else 0 end, (not c.failed and c.n < 5) or (c.failed and w.streak + 1 >= 3) from w join c on c.source = w.source and c.k = w.k + 1 where not w.stop)
        select source, count(*) pages from w group by 1""",
    "idempotent_upsert": """select source, external_id, id, price from (select source, external_id, id, cast(price as double) price, row_number() over (partition by source, external_id order by (collected_date = (select max(collected_date) from raw_listings where source is not null and external_id is not null)) desc, scraped_at desc nulls last, id desc) k
        from raw_listings where source is not null and external_id is not null and collected_date is not null) where k = 1""",
    "sync_actions": """with m as (select product_id id, cast(count(*) % 7 as integer) stock from product_matches where product_id is not null group by 1) select case when p.id is null then 'insert' when m.id is null then 'delete' when p.stock is not distinct from m.stock then 'keep' else 'update' end as action, count(*) n from products p full join m on p.id = m.id group by 1""",
    "append_new_titles": "select distinct content_hash from raw_listings where content_hash is not null and content_hash not in (select content_hash from norm_listings where content_hash is not null)",
    "backfill_counts": "select count(*) filter (life_stage is null and contains(lower(sample_title), 'senior')) life_stage, count(*) filter (food_form is null and contains(lower(sample_title), 'dry food')) food_form from norm_listings",
    "stream_tumbling": "select event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) n from events where ts is not null group by all",
    "stream_dedup": "select distinct user_id, event_type from events",
    "stream_changes": """with r as (select source || '|' || external_id listing, content_hash h, last_value(content_hash ignore nulls) over (partition by source, external_id order by collected_date, id rows between unbounded preceding and 1 preceding) p from raw_listings where source is not null and external_id is not null)
        select listing, count(*) stored from r where h is not null and h is distinct from p group by 1""",
}
