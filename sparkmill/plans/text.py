"""Text, vectors and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmill.functions import columns as C
from sparkmill.operators import similarity as V
from sparkmill.operators.graph import connected_components
from sparkmill.operators.lexical import rank_holders
from sparkmill.session import table as T


def normalized_title_hash(s, d):
    """Listings whose content_hash is or isn't the hash of their folded title."""
    r = T(s, d, "raw_listings").where("content_hash IS NOT NULL AND title IS NOT NULL").select("id", (C.content_hash(C.fold(F.col("title"))) == F.col("content_hash")).alias("same"))
    return r.groupBy("same").agg(F.count("*").alias("n"))


def blocking_keys(s, d):
    return T(s, d, "norm_listings").select("id", C.blocking_key(F.col("brand")).alias("key"))


def flavour_join(s, d):
    return T(s, d, "norm_listings").select("id", C.flavours(F.col("sample_title")).alias("flavours"))


def title_tokens(s, d):
    return T(s, d, "products").select("id", F.array_join(C.tokens(F.col("title")), " ").alias("words"))


def money_texts(s, d):
    v = T(s, d, "category_listings").select(F.explode("variants").alias("v")).select(F.col("v.id").alias("id"), C.money(F.col("v.price")).cast("double").alias("price"), C.money(F.col("v.compare_at_price")).cast("double").alias("compare_at"))
    return v.where("id IS NOT NULL")


def pair_text(s, d):
    return T(s, d, "norm_listings").select("id", C.labelled_text({"title": F.col("sample_title"), "brand": F.col("brand"), "line": F.col("product_line"), "weight": F.col("net_weight_g"), "stage": F.col("life_stage")}).alias("text"))


def attribute_diff(s, d):
    """Pairs of labelled listings and the attributes in which they differ."""
    n = T(s, d, "norm_listings").select("content_hash", "net_weight_g", "life_stage", "flavour", "food_form")
    first = n.groupBy("content_hash").agg(F.min(F.struct(F.coalesce("net_weight_g", F.lit(-1)).alias("w"), F.coalesce("life_stage", F.lit("")).alias("l"), F.coalesce("flavour", F.lit("")).alias("f"), F.coalesce("food_form", F.lit("")).alias("o"))).alias("v"))
    p = T(s, d, "phase3_labels").where("occurrence_id IS NOT NULL").select("occurrence_id", "left_content_hash", "right_content_hash").distinct()
    a, b = first.select(F.col("content_hash").alias("left_content_hash"), F.col("v").alias("a")), first.select(F.col("content_hash").alias("right_content_hash"), F.col("v").alias("b"))
    j = p.join(a, "left_content_hash").join(b, "right_content_hash")
    return j.select("occurrence_id", C.differing_fields({"weight": (F.col("a.w"), F.col("b.w")), "stage": (F.col("a.l"), F.col("b.l")), "flavour": (F.col("a.f"), F.col("b.f")), "form": (F.col("a.o"), F.col("b.o"))}).alias("differ"))


def token_filter(s, d):
    """The first of a list of words in every title."""
    return T(s, d, "raw_listings").where("title IS NOT NULL").select("id", C.first_token_of(F.col("title"), ["somon", "salmon", "pui", "chicken"]).alias("word")).where("word IS NOT NULL")


def like_any(s, d):
    low = F.lower("title")
    some = low.like("%gratuit%") | low.like("%reducere%") | low.like("%promo%")
    return T(s, d, "raw_listings").where(some & ~low.like("%transport%")).groupBy("source").agg(F.count("*").alias("n"))


def size_rank_overlap(s, d):
    """Breed sizes of one brand key, each by its least listing, that overlap or not."""
    n = T(s, d, "norm_listings").where("brand_blocking_key <> '' AND breed_size_code IS NOT NULL")
    n = n.groupBy("brand_blocking_key", "breed_size_code").agg(F.min("id").alias("id")).withColumn("r", C.size_rank(F.col("breed_size_code")))
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.brand_blocking_key") == F.col("b.brand_blocking_key")) & (F.col("a.id") < F.col("b.id")))
    return j.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), C.overlaps(F.col("a.r"), F.col("b.r")).alias("meet"))


def json_payload_fields(s, d):
    """Payload prices that differ from the listing's, per source."""
    r = T(s, d, "raw_listings").where("raw_payload IS NOT NULL").select("source", F.get_json_object("raw_payload", "$.price").alias("p"))
    return r.groupBy("source").agg(F.count("*").alias("payloads"), F.count("p").alias("priced"))


def lexical_rank(s, d):
    """For the first two words of more than six letters, by the alphabet, of every product title that has two, the best titles of the dimension that hold both. A sample that SQL can check; lexical_ranked is the whole operator."""
    from pyspark.sql import Window

    q = T(s, d, "products").select(F.col("id").alias("q"), F.slice(F.filter(C.tokens(F.col("title")), lambda w: F.length(w) > 6), 1, 2).alias("ws")).where("size(ws) = 2")
    n = T(s, d, "norm_listings").select(F.col("id").alias("i"), C.tokens(F.col("sample_title")).alias("t"))
    inv = n.select("i", "t", F.explode("t").alias("w"))
    hit = q.select("q", "ws", F.element_at("ws", 1).alias("w")).join(inv, "w").where(F.array_contains("t", F.element_at("ws", 2)))
    sc = hit.select("q", "i", F.round(2.0 / F.size("t"), 6).alias("score"))
    return sc.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "i"))).where("pos <= 5")


def lexical_ranked(s, d):
    """For every product's title as a query, the titles of the dimension that hold all of its words, by the share of their words that are the query's; a pool of 200. A title without words has none."""
    q = T(s, d, "products").select(F.col("id").alias("q"), C.tokens(F.col("title")).alias("ws"))
    return rank_holders(q, T(s, d, "norm_listings").select(F.col("id").alias("i"), C.tokens(F.col("sample_title")).alias("t")), 200)


def block_topk_cosine(s, d):
    e = T(s, d, "embeddings").where("label IS NOT NULL")
    return V.block_top_k(e, e, "label", "vec_id", "vec_id", "embedding", 5).select("q", "i", "sim", "rank")


def global_topk_cosine(s, d):
    """The ten vectors nearest to the vector with the least id."""
    e = T(s, d, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("u"))
    q = e.orderBy("vec_id").first()  # one vector, a literal in the plan
    if q is None or q["u"] is None:
        return e.select("vec_id", F.lit(0.0).alias("sim")).limit(0)
    sim = F.round(V.dot(F.col("u"), F.array(*map(F.lit, q["u"]))), 6)
    return e.where(F.col("vec_id") != q["vec_id"]).select("vec_id", sim.alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(10)


def _two_rankings(s, d):
    from pyspark.sql import Window

    e = T(s, d, "embeddings").where("label IS NOT NULL")
    dense = V.block_top_k(e.where("vec_id % 50 = 0"), e, "label", "vec_id", "vec_id", "embedding", 20).select("q", "i", "rank")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("l"), F.col("embedding")[0].cast("double").alias("x"))
    near = q.join(e.select(F.col("vec_id").alias("i"), F.col("label").alias("l"), F.col("embedding")[0].cast("double").alias("y")), "l").where("q <> i")
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.abs(F.col("x") - F.col("y")), "i"))).where("rank <= 20").select("q", "i", "rank")
    return dense, first


def rrf_fusion(s, d):
    """Two rankings of the stated queries fused: by cosine and by the first coordinate."""
    return V.fuse(list(_two_rankings(s, d)), "q", "i", "rank", 10).select("q", "i", "score", "pos")


def recall_mrr(s, d):
    """How well the first coordinate's ranking finds the three nearest vectors by cosine."""
    dense, first = _two_rankings(s, d)
    return V.retrieval_quality(first, dense.where("rank <= 3").select("q", "i"), "q", "i", "rank", (1, 3, 10))


def connected_labels(s, d):
    """Components of the labelled pairs over listings and their sizes."""
    e = T(s, d, "phase3_labels").where("left_content_hash IS NOT NULL OR right_content_hash IS NOT NULL").select("left_content_hash", "right_content_hash").distinct()
    c = connected_components(e, "left_content_hash", "right_content_hash")
    return c.groupBy("component").agg(F.count("*").alias("nodes"))


QUERIES = {f.__name__: f for f in (
    normalized_title_hash, blocking_keys, flavour_join, title_tokens, money_texts, pair_text, attribute_diff, token_filter, like_any, size_rank_overlap, json_payload_fields, lexical_rank, lexical_ranked, block_topk_cosine, global_topk_cosine, rrf_fusion, recall_mrr, connected_labels,
)}

_FOLD = "trim(regexp_replace(replace(replace(replace(strip_accents(lower({})), '½', '1⁄2'), '…', '...'), '™', 'TM'), '[\\s\\x{{00a0}}]+', ' ', 'g'))"
_WORDS = "list_sort(list_distinct(regexp_extract_all(" + _FOLD + ", '[a-z0-9'']+')))"
_NAMES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in C.FLAVOURS.items()) + "}"
_NORMED = "e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings where label is not null)"
_DENSE = _NORMED + ", dn as (select a.vec_id q, b.vec_id i, round(list_cosine_similarity(a.v, b.v), 6) sim, a.label from e a join e b on a.label = b.label and a.vec_id <> b.vec_id {w})"
_TWO = _DENSE.format(w="where a.vec_id % 50 = 0") + """, dr as (select q, i, r from (select q, i, row_number() over (partition by q order by sim desc, i) r from dn) where r <= 20),
  fr as (select q, i, r from (select a.vec_id q, b.vec_id i, row_number() over (partition by a.vec_id order by abs(a.v[1] - b.v[1]), b.vec_id) r from e a join e b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 50 = 0) where r <= 20)"""
SQL = {
    "normalized_title_hash": f"select sha256({_FOLD.format('title')}) = content_hash same, count(*) n from raw_listings where content_hash is not null and title is not null group by 1",
    "blocking_keys": "select id, nullif(regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g'), '') as key from norm_listings",
    "flavour_join": f"select id, nullif(array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: x), '+'), '') flavours from (select id, list_transform(regexp_extract_all({_FOLD.format('sample_title')}, '\\b({'|'.join(C.FLAVOURS)})\\b', 1), lambda w: {_NAMES}[w]) l from norm_listings)",
    "title_tokens": f"select id, array_to_string({_WORDS.format('title')}, ' ') words from products",
    "money_texts": """with v as (select unnest(variants) v from category_listings), t as (select v.id id, trim(v.price) p, trim(v.compare_at_price) c from v where v.id is not null)
        select id, case when try_cast(p as decimal(12,2)) > 0 then cast(try_cast(p as decimal(12,2)) as double) end price, case when try_cast(c as decimal(12,2)) > 0 then cast(try_cast(c as decimal(12,2)) as double) end compare_at from t""",
    "pair_text": "select id, concat('title: ', coalesce(nullif(trim(sample_title), ''), '<none>'), ' | brand: ', coalesce(nullif(trim(brand), ''), '<none>'), ' | line: ', coalesce(nullif(trim(product_line), ''), '<none>'), ' | weight: ', coalesce(cast(net_weight_g as varchar), '<none>'), ' | stage: ', coalesce(nullif(trim(life_stage), ''), '<none>')) as text from norm_listings",
    "attribute_diff": """with f as (select content_hash h, min(struct_pack(w := coalesce(net_weight_g, -1), l := coalesce(life_stage, ''), f := coalesce(flavour, ''), o := coalesce(food_form, ''))) v from norm_listings group by 1)
        select distinct occurrence_id, concat_ws(',', case when a.v.w <> b.v.w then 'weight' end, case when a.v.l <> b.v.l then 'stage' end, case when a.v.f <> b.v.f then 'flavour' end, case when a.v.o <> b.v.o then 'form' end) differ
        from (select distinct occurrence_id, left_content_hash, right_content_hash from phase3_labels where occurrence_id is not null) p join f a on a.h = left_content_hash join f b on b.h = right_content_hash""",
    "token_filter": f"select id, word from (select id, case when p like '% somon %' then 'somon' when p like '% salmon %' then 'salmon' when p like '% pui %' then 'pui' when p like '% chicken %' then 'chicken' end word from (select id, ' ' || regexp_replace({_FOLD.format('title')}, '[^a-z0-9]+', ' ', 'g') || ' ' p from raw_listings where title is not null)) where word is not null",
    "like_any": "select source, count(*) n from raw_listings where (lower(title) like '%gratuit%' or lower(title) like '%reducere%' or lower(title) like '%promo%') and lower(title) not like '%transport%' group by 1",
    "size_rank_overlap": """with m as (select map {'XS': 0, 'S': 1, 'M': 2, 'L': 3, 'XL': 4, 'MINI': 0, 'MEDIUM': 2, 'MAXI': 3} l, map {'XS': 0, 'S': 1, 'M': 2, 'L': 3, 'XL': 4, 'MINI': 1, 'MEDIUM': 2, 'MAXI': 4} h),
        n as (select id, brand_blocking_key b, l[string_split(upper(trim(breed_size_code)), '-')[1]] x, h[string_split(upper(trim(breed_size_code)), '-')[-1]] y from (select brand_blocking_key, breed_size_code, min(id) id from norm_listings group by 1, 2), m
        where brand_blocking_key <> '' and breed_size_code is not null) select a.id id_a, b.id id_b, least(a.x, a.y) <= greatest(b.x, b.y) and least(b.x, b.y) <= greatest(a.x, a.y) meet from n a join n b on a.b = b.b and a.id < b.id""",
    "json_payload_fields": "select source, count(*) payloads, count(json_extract_string(raw_payload, '$.price')) priced from raw_listings where raw_payload is not null group by 1",
    "lexical_rank": f"""with q as (select id q, list_filter({_WORDS.format('title')}, lambda w: length(w) > 6)[1:2] ws from products), n as (select id i, {_WORDS.format('sample_title')} t from norm_listings), inv as (select i, t, unnest(t) w from n),
        h as (select q, i, round(2.0 / len(t), 6) score from q join inv on inv.w = q.ws[1] where len(ws) = 2 and list_contains(t, ws[2])) select q, i, cast(score as double) score, pos from (select *, row_number() over (partition by q order by score desc, i) pos from h) where pos <= 5""",
    "block_topk_cosine": f"with {_DENSE.format(w='')} select q, i, sim, rank from (select q, i, sim, row_number() over (partition by q order by sim desc, i) rank from dn) where rank <= 5",
    "global_topk_cosine": "with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings), q as (select * from e order by vec_id limit 1) select e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) sim from e, q where e.vec_id <> q.vec_id order by sim desc, e.vec_id limit 10",
    "rrf_fusion": f"with {_TWO}, u as (select * from dr union all select * from fr), f as (select q, i, round(sum(cast(1 as double) / (60 + r)), 9) score from u group by all) select q, i, score, pos from (select *, row_number() over (partition by q order by score desc, i) pos from f) where pos <= 10",
    "recall_mrr": f"with {_TWO}, h as (select dr.q, min(fr.r) r from dr left join fr on fr.q = dr.q and fr.i = dr.i where dr.r <= 3 group by 1) select count(*) queries, round(avg(case when r <= 1 then 1 else 0 end), 6) hit_at_1, round(avg(case when r <= 3 then 1 else 0 end), 6) hit_at_3, round(avg(case when r <= 10 then 1 else 0 end), 6) hit_at_10, round(avg(coalesce(1.0 / r, 0)), 6) mrr from h",
    "connected_labels": """with recursive e as (select distinct left_content_hash x, right_content_hash y from phase3_labels where left_content_hash is not null and right_content_hash is not null and left_content_hash <> right_content_hash), b as (select x, y from e union select y, x from e),
        ns as (select left_content_hash n from phase3_labels where left_content_hash is not null union select right_content_hash from phase3_labels where right_content_hash is not null), w(n, c) as (select n, n from ns union select b.y, w.c from w join b on b.x = w.n where w.c < b.y)
        select component, count(*) nodes from (select n, min(c) component from w group by n) group by 1""",
}
