"""Aggregates, pivots, percentiles, tests of evaluation and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkmill.operators import sampling as P
from sparkmill.operators import statistics as A
from sparkmill.session import table as T


def count_per_group(s, d):
    return T(s, d, "product_matches").groupBy("product_id").agg(F.count("*").alias("n"))


def global_min_max(s, d):
    r = T(s, d, "raw_listings").agg(F.min("collected_date").alias("a"), F.max("collected_date").alias("b"), F.count_distinct("collected_date").alias("days"))
    return r.select(F.date_format("a", "yyyy-MM-dd").alias("first_day"), F.date_format("b", "yyyy-MM-dd").alias("last_day"), "days")


def source_summary_filter_agg(s, d):
    """Rows in scope beside all distinct days, per source: a filtered aggregate mixed with an unfiltered one."""
    return T(s, d, "raw_listings").groupBy("source").agg(F.expr("count(*) FILTER (WHERE excluded_reason IS NULL)").alias("in_scope"), F.count_distinct("collected_date").alias("days"), F.count_if(F.col("compare_at_price") > F.col("price")).alias("discounted"))


def distinct_pairs_count(s, d):
    return T(s, d, "raw_listings").select("source", "external_id").distinct().agg(F.count("*").alias("pairs"))


def status_pivot(s, d):
    return T(s, d, "scrape_runs").groupBy(F.coalesce("source", F.lit("baseline")).alias("source")).pivot("status", ["ok", "volume_alert", "failed"]).agg(F.count(F.lit(1))).na.fill(0)


def spend_rollup(s, d):
    """Runs, items and seconds by source and status, with subtotals and the total."""
    r = T(s, d, "scrape_runs").where("source IS NOT NULL AND status IS NOT NULL").rollup("source", "status").agg(F.count("*").alias("runs"), F.sum("items_found").alias("items"), F.round(F.sum("duration_seconds"), 3).alias("seconds"))
    return r


def grouping_sets_labels(s, d):
    return T(s, d, "phase3_labels").where("tier IS NOT NULL").cube("tier", F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


def category_average_of_rounded(s, d):
    """The mean per category of margins that are rounded to a tenth of a percent first, and their least."""
    p = T(s, d, "products").where("purchase_cost IS NOT NULL AND current_price > 0").select("category", F.round((F.col("current_price") - F.col("purchase_cost")).cast("decimal(24,6)") * 100 / F.col("current_price"), 1).alias("m"))
    return p.groupBy("category").agg(F.round(F.avg("m"), 1).cast("double").alias("mean"), F.min("m").cast("double").alias("least"), F.count("*").alias("n"))


def price_position(s, d):
    """Least, median and greatest competitor price per product."""
    m = T(s, d, "product_matches").where("product_id IS NOT NULL AND competitor_price IS NOT NULL").select("product_id", F.col("competitor_price").cast("double").alias("p"))
    return m.groupBy("product_id").agg(F.min("p").alias("low"), F.round(F.median("p"), 4).alias("mid"), F.max("p").alias("high"))


def titles_in_many_sources(s, d):
    g = T(s, d, "raw_listings").where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count_distinct("source").alias("sources")).where("sources >= 2")
    return g.groupBy("sources").agg(F.count("*").alias("titles"))


def linear_percentiles(s, d):
    q = F.percentile(F.col("duration_seconds"), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    r = T(s, d, "scrape_runs").where("duration_seconds IS NOT NULL AND source IS NOT NULL").groupBy("source").agg(q.alias("q"), F.avg("duration_seconds").alias("m"))
    return r.select("source", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.round("m", 6).alias("mean"))


def nearest_rank_percentiles(s, d):
    r = T(s, d, "raw_listings").where("source IS NOT NULL").select("source", F.col("price").cast("double").alias("price"))
    return A.nearest_rank(r, ["source"], "price", {"median": 0.5, "p90": 0.9, "highest": 1.0})


def latest_non_null(s, d):
    """Per content hash the flavour of the greatest id that has one."""
    return T(s, d, "norm_listings").groupBy("brand_blocking_key").agg(F.expr("max_by(flavour, id) FILTER (WHERE flavour IS NOT NULL)").alias("flavour"))


def coverage_unpivot(s, d):
    """Filled values per shop and attribute."""
    fields = ["brand", "product_line", "pack_count", "life_stage", "flavour", "food_form", "species"]
    n = T(s, d, "norm_listings").select("sample_source", *[F.col(f).cast("string").alias(f) for f in fields])
    return n.unpivot(["sample_source"], fields, "field", "value").groupBy("sample_source", "field").agg(F.count("*").alias("rows_"), F.count("value").alias("filled"))


def top_shapes(s, d):
    """The three commonest masked titles of each category: digits as 9, other letters kept."""
    n = T(s, d, "norm_listings").where("category IS NOT NULL").select("category", F.regexp_replace(F.regexp_extract("sample_title", r"(\d+[.,]?\d*) ?(kg|g|gr|ml|l)\b", 0), r"\d+", "9").alias("shape")).where("shape <> ''")
    c = n.groupBy("category", "shape").agg(F.count("*").alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "shape")
    return c.withColumn("pos", F.row_number().over(w)).where("pos <= 3")


def rows_per_day_of_week(s, d):
    r = T(s, d, "raw_listings").where("collected_date IS NOT NULL")
    return r.groupBy(F.weekday("collected_date").alias("weekday")).agg(F.count("*").alias("n"))


def _labelled(s, d):
    """Labelled pairs with a score made of the hashes, as a stand-in for a model's prediction."""
    r = T(s, d, "phase3_labels").where("label IN ('match', 'no_match') AND occurrence_id IS NOT NULL").select("occurrence_id", "tier", "label").distinct()
    u = F.conv(F.substring(F.md5("occurrence_id"), 1, 6), 16, 10).cast("int") % 1001 / 1000.0
    return r.select("occurrence_id", "tier", (F.col("label") == "match").alias("actual"), u.alias("score"))


_LABELLED = "l as (select occurrence_id, tier, label = 'match' actual, (cast('0x' || left(md5(occurrence_id), 6) as integer) % 1001) / 1000.0 as score from (select distinct occurrence_id, tier, label from phase3_labels where label in ('match', 'no_match') and occurrence_id is not null))"


def confusion_wilson(s, d):
    """Per tier the confusion at 0.5, precision, recall, F1, accuracy and the interval of the recall."""
    g = _labelled(s, d).where("tier IS NOT NULL").groupBy("tier").agg(*A.confusion(F.col("score") >= 0.5, F.col("actual")))
    q = A.quality(g).withColumn("w", A.wilson(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")))
    return q.select("tier", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("prec", "recall", "f1", "accuracy")], F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


def threshold_sweep(s, d):
    return A.sweep(_labelled(s, d), "score", "actual")


def threshold_plateau(s, d):
    p = A.plateau(A.quality(A.sweep(_labelled(s, d), "score", "actual")))
    return p.select("first_step", "last_step", "mid_step", F.round("best", 6).alias("best"))


def score_distribution(s, d):
    return _labelled(s, d).groupBy("actual").agg(F.count("*").alias("n"), F.round(F.median("score"), 6).alias("median"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg((F.col("score") >= 0.9).cast("int")), 6).alias("high_share"))


def mcnemar_exact(s, d):
    """Two thresholds compared on the same pairs, per tier."""
    r = _labelled(s, d).where("tier IS NOT NULL")
    a, b = (F.col("score") >= 0.4) == F.col("actual"), (F.col("score") >= 0.6) == F.col("actual")
    g = r.groupBy("tier").agg(F.count_if(a & b).alias("both_right"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))
    return g.withColumn("p", F.round(A.mcnemar(F.col("only_a"), F.col("only_b")), 6))


def invalid_scores(s, d):
    """Scores that are null, NaN or outside [0, 1], per source."""
    x = F.col("score")
    return T(s, d, "scored_links").where(x.isNull() | F.isnan(x) | (x < 0) | (x > 1)).groupBy("source").agg(F.count("*").alias("n"))


def round_robin_rows(s, d):
    """Twenty matches taken from the shops in turn, shops with more rows first."""
    m = T(s, d, "product_matches").where("source IS NOT NULL").select("source", "id", "score")
    return P.round_robin(m, "source", [F.desc_nulls_last("score"), F.asc("id")], F.count("*"), 20).select("source", "id", "depth")


def quota_fill(s, d):
    """A quota of 30 rows per tier, what a tier lacks handed on to the next."""
    c = T(s, d, "phase3_labels").where("tier IS NOT NULL").groupBy("tier").agg(F.count("*").cast("int").alias("rows_"))
    return P.quotas(c, "tier", "rows_", "tier", 30)


def stratified_counts(s, d):
    """How many rows a sample of a tenth, two at least, takes of every tier."""
    r = T(s, d, "phase3_labels").where("tier IS NOT NULL AND occurrence_id IS NOT NULL").select("tier", "occurrence_id").distinct()
    return P.stratified(r, "tier", "occurrence_id", 0.1, 2).groupBy("tier").agg(F.count("*").alias("n"))


def ordered_page(s, d):
    """The tenth page of ten products by price, missing prices last."""
    return T(s, d, "products").select("id", F.col("current_price").cast("double").alias("price")).orderBy(F.desc_nulls_last("price"), "id").offset(90).limit(10)


def truncated_errors(s, d):
    """Each run's errors, at most two of 40 characters, with how many more there are."""
    e = F.coalesce("error_detail", F.array().cast("array<string>"))
    r = T(s, d, "scrape_runs").select("id", F.array_join(F.transform(F.slice(e, 1, 2), lambda x: F.substring(x, 1, 40)), "|", "").alias("some"), F.size(e).alias("n"))
    return r.select("id", F.when(F.col("n") > 2, F.concat("some", F.lit(" +"), (F.col("n") - 2).cast("string"), F.lit(" more"))).otherwise(F.col("some")).alias("errors_"))


def set_algebra(s, d):
    """Days with ok runs against days with listings, per source: in both, only one, either."""
    a = T(s, d, "scrape_runs").where("status = 'ok' AND source IS NOT NULL AND started_at IS NOT NULL").select("source", F.to_date("started_at").alias("d")).distinct()
    b = T(s, d, "raw_listings").where("source IS NOT NULL AND collected_date IS NOT NULL").select("source", F.col("collected_date").alias("d")).distinct()
    n = lambda df, k: df.groupBy("source").agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "source", "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "runs only")).unionByName(n(b.subtract(a), "rows only")).unionByName(n(a.union(b).distinct(), "either"))


def unordered_pair_dedup(s, d):
    """Labelled pairs of listings in either order, once each, the first by occurrence_id."""
    r = T(s, d, "phase3_labels").where("left_content_hash IS NOT NULL AND right_content_hash IS NOT NULL AND occurrence_id IS NOT NULL")
    r = r.select(F.least("left_content_hash", "right_content_hash").alias("a"), F.greatest("left_content_hash", "right_content_hash").alias("b"), "occurrence_id")
    return r.groupBy("a", "b").agg(F.min("occurrence_id").alias("first"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    count_per_group, global_min_max, source_summary_filter_agg, distinct_pairs_count, status_pivot, spend_rollup, grouping_sets_labels, category_average_of_rounded, price_position, titles_in_many_sources, linear_percentiles, nearest_rank_percentiles, latest_non_null,
    coverage_unpivot, top_shapes, rows_per_day_of_week, confusion_wilson, threshold_sweep, threshold_plateau, score_distribution, mcnemar_exact, invalid_scores, round_robin_rows, quota_fill, stratified_counts, ordered_page, truncated_errors, set_algebra, unordered_pair_dedup,
)}

_SWEEP = _LABELLED + ", w as (select g.i step, count(*) filter (score >= g.i / 100.0 - 1e-10 and actual) tp, count(*) filter (score >= g.i / 100.0 - 1e-10 and not actual) fp, count(*) filter (score < g.i / 100.0 - 1e-10 and actual) fn, count(*) filter (score < g.i / 100.0 - 1e-10 and not actual) tn from range(101) g(i), l group by 1)"
_F1 = "case when tp + fp = 0 or tp + fn = 0 then null when tp = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end"
SQL = {
    "count_per_group": "select product_id, count(*) n from product_matches group by 1",
    "global_min_max": "select strftime(min(collected_date), '%Y-%m-%d') first_day, strftime(max(collected_date), '%Y-%m-%d') last_day, count(distinct collected_date) as days from raw_listings",
    "source_summary_filter_agg": "select source, count(*) filter (excluded_reason is null) in_scope, count(distinct collected_date) as days, count(*) filter (compare_at_price > price) discounted from raw_listings group by 1",
    "distinct_pairs_count": "select count(*) pairs from (select distinct source, external_id from raw_listings)",
    "status_pivot": "select coalesce(source, 'baseline') source, count(*) filter (status = 'ok') ok, count(*) filter (status = 'volume_alert') volume_alert, count(*) filter (status = 'failed') failed from scrape_runs group by 1",
    "spend_rollup": "select source, status, count(*) runs, cast(sum(items_found) as bigint) items, round(sum(duration_seconds), 3) as seconds from scrape_runs where source is not null and status is not null group by rollup (source, status)",
    "grouping_sets_labels": "select tier, label, count(*) n from (select tier, coalesce(label, 'none') as label from phase3_labels where tier is not null) group by cube (tier, label)",
    "category_average_of_rounded": """select category, cast(round(cast(sum(m10) as decimal(24,6)) / 10 / count(*), 1) as double) mean, min(m10) / 10.0 least, count(*) n from (select category, cast(floor(((cast(current_price as hugeint_) - cast(purchase_cost as hugeint_)) * 2000 + cast(current_price as hugeint_)) / (2 * cast(current_price as hugeint_))) as bigint) m10 from products where purchase_cost is not null and current_price > 0) group by 1""",
    "price_position": "select product_id, cast(min(competitor_price) as double) low, round(median(cast(competitor_price as double)), 4) mid, cast(max(competitor_price) as double) high from product_matches where product_id is not null and competitor_price is not null group by 1",
    "titles_in_many_sources": "select sources, count(*) titles from (select content_hash, count(distinct source) sources from raw_listings where content_hash is not null group by 1) where sources >= 2 group by 1",
    "linear_percentiles": "select source, round(quantile_cont(duration_seconds, 0.5), 6) p50, round(quantile_cont(duration_seconds, 0.95), 6) p95, round(quantile_cont(duration_seconds, 0.99), 6) p99, round(avg(duration_seconds), 6) mean from scrape_runs where duration_seconds is not null and source is not null group by 1",
    "nearest_rank_percentiles": """with r as (select source, cast(price as double) price, row_number() over (partition by source order by price) - 1 as k, count(*) over (partition by source) n from raw_listings where source is not null and price is not null)
        select source, max(n) n, max(price) filter (k = round_even(0.5 * (n - 1), 0)) median, max(price) filter (k = round_even(0.9 * (n - 1), 0)) p90, max(price) filter (k = n - 1) highest from r group by 1""",
    "latest_non_null": "select brand_blocking_key, max_by(flavour, id) filter (flavour is not null) flavour from norm_listings group by 1",
    "coverage_unpivot": "select sample_source, field, count(*) rows_, count(value) filled from (select sample_source, unnest(['brand', 'product_line', 'pack_count', 'life_stage', 'flavour', 'food_form', 'species']) field, unnest([brand, product_line, cast(pack_count as varchar), life_stage, flavour, food_form, species]) as value from norm_listings) group by all",
    "top_shapes": """with c as (select category, regexp_replace(regexp_extract(sample_title, '(\\d+[.,]?\\d*) ?(kg|g|gr|ml|l)\\b', 0), '\\d+', '9', 'g') shape, count(*) n from norm_listings where category is not null group by 1, 2)
        select category, shape, n, pos from (select *, row_number() over (partition by category order by n desc, shape) pos from c where shape <> '') where pos <= 3""",
    "rows_per_day_of_week": "select cast(isodow(collected_date) - 1 as integer) weekday, count(*) n from raw_listings where collected_date is not null group by 1",
    "confusion_wilson": f"""with {_LABELLED}, c as (select tier, count(*) filter (score >= 0.5 and actual) tp, count(*) filter (score >= 0.5 and not actual) fp, count(*) filter (score < 0.5 and actual) fn, count(*) filter (score < 0.5 and not actual) tn from l where tier is not null group by 1),
        q as (select *, cast(tp + fn as double) n, 1.959963984540054 z, tp / nullif(cast(tp + fn as double), 0) p from c) select tier, tp, fp, fn, tn, round(tp / nullif(cast(tp + fp as double), 0), 6) prec, round(p, 6) recall, round({_F1}, 6) f1, round((tp + tn) / cast(tp + fp + fn + tn as double), 6) accuracy,
        round(case when n = 0 or tp = 0 then 0.0 else ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) end, 6) low, round(case when n = 0 or tp = n then 1.0 else ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) end, 6) high from q""",
    "threshold_sweep": f"with {_SWEEP} select cast(step as integer) step, tp, fp, fn, tn from w",
    "threshold_plateau": f"""with {_SWEEP}, f as (select step, coalesce({_F1}, -1.0) v from w), b as (select *, max(v) over () best from f), r as (select step, best, step - row_number() over (order by step) g from b where v = best)
        select cast(min(step) as integer) first_step, cast(max(step) as integer) last_step, cast(floor((min(step) + max(step)) / 2) as integer) mid_step, round(max(best), 6) best from r group by g order by count(*) desc, min(step) limit 1""",
    "score_distribution": f"with {_LABELLED} select actual, count(*) n, round(median(cast(score as double)), 6) median, cast(min(score) as double) least, cast(max(score) as double) most, round(avg(case when score >= 0.9 then 1 else 0 end), 6) high_share from l group by 1",
    "mcnemar_exact": f"""with {_LABELLED}, g as (select tier, count(*) filter (a and b) both_right, count(*) filter (a and not b) only_a, count(*) filter (not a and b) only_b, count(*) filter (not a and not b) neither from (select tier, (score >= 0.4) = actual a, (score >= 0.6) = actual b from l where tier is not null) group by 1)
        select tier, both_right, only_a, only_b, neither, round(case when only_a + only_b = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) end, 6) p from g""",
    "invalid_scores": "select source, count(*) n from scored_links where score is null or isnan(score) or score < 0 or score > 1 group by 1",
    "round_robin_rows": """with m as (select source, id, row_number() over (partition by source order by score desc nulls last, id) depth, count(*) over (partition by source) n from product_matches where source is not null) select source, id, cast(depth as integer) depth from m order by depth, n desc, source limit 20""",
    "quota_fill": """with recursive c as (select tier, cast(count(*) as integer) a, row_number() over (order by tier) k from phase3_labels where tier is not null group by tier),
        w as (select k, tier, least(a, 30) take, 30 - least(a, 30) carry from c where k = 1 union all select c.k, c.tier, least(c.a, 30 + w.carry), 30 + w.carry - least(c.a, 30 + w.carry) from w join c on c.k = w.k + 1) select tier, cast(take as integer) take from w""",
    "stratified_counts": "select tier, least(count(*), greatest(2, cast(round(count(*) * 0.1) as bigint))) n from (select distinct tier, occurrence_id from phase3_labels where tier is not null and occurrence_id is not null) group by 1",
    "ordered_page": "select id, cast(current_price as double) price from products order by current_price desc nulls last, id limit 10 offset 90",
    "truncated_errors": "select id, case when coalesce(len(error_detail), 0) > 2 then array_to_string(list_transform(error_detail[1:2], lambda x: left(coalesce(x, ''), 40)), '|') || ' +' || (len(error_detail) - 2) || ' more' else coalesce(array_to_string(list_transform(error_detail[1:2], lambda x: left(coalesce(x, ''), 40)), '|'), '') end errors_ from scrape_runs",
    "set_algebra": """with a as (select distinct source, cast(started_at at time zone 'UTC' as date) d from scrape_runs where status = 'ok' and source is not null and started_at is not null), b as (select distinct source, collected_date d from raw_listings where source is not null and collected_date is not null)
        select 'both' what, source, count(*) n from (select * from a intersect select * from b) group by 2 union all select 'runs only', source, count(*) from (select * from a except select * from b) group by 2 union all select 'rows only', source, count(*) from (select * from b except select * from a) group by 2 union all select 'either', source, count(*) from (select * from a union select * from b) group by 2""",
    "unordered_pair_dedup": "select least(left_content_hash, right_content_hash) a, greatest(left_content_hash, right_content_hash) b, min(occurrence_id) as first, count(*) n from phase3_labels where left_content_hash is not null and right_content_hash is not null and occurrence_id is not null group by all",
}
SQL["category_average_of_rounded"] = """with m as (select category, round(cast((current_price - purchase_cost) * 100 as decimal(24,6)) * 1.0 / current_price, 1) m from products where purchase_cost is not null and current_price > 0) select category, round(avg(m), 1) mean, min(m) least, count(*) n from m group by 1"""
