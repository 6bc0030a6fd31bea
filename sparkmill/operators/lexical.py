"""Items that hold all words of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.session import cut

#: Counts of words that are broadcast, whatever the number of words; they choose the word over which a query meets the items, not what it finds.
BUCKETS = 1 << 16


def _words(text: Column) -> Column:
    return F.split(text, " ")


def _keys(text: Column) -> Column:
    return F.array_distinct(F.transform(_words(text), lambda w: F.hash(w)))


def _id(text: Column) -> Column:
    return F.xxhash64(text)


def _marks(keys: Column) -> Column:
    """64 bits, of which each word sets one."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)))))


def rank_holders(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """q, i, score, pos: of each query (q, ws) the k items (i, t) that hold all words of ws, by the share of t that these are; ties by i. ws and t are different words, without blanks, in one order; a query without words has none.

    Equal word lists are one until they are ranked. A query meets the items over its rarest word, where an item is known by a 64-bit id and 64 marks: what is moved once a word has a
    fixed size. Most items fail by their marks; those left are compared word by word, so equal hashes cost time, not rows. Spark takes exploded rows for no more than what
    they are made of, so the joins are told not to broadcast any.
    """
    q = cut(queries.select("q", F.concat_ws(" ", "ws").alias("ask")).distinct()).where("ask <> ''")
    i = cut(items.select("i", F.concat_ws(" ", "t").alias("text"))).where("text <> ''").select("i", "text", _id(F.col("text")).alias("id"))
    bucket = F.pmod("h", F.lit(BUCKETS)).alias("bucket")
    n = i.select(F.explode(_keys(F.col("text"))).alias("h")).groupBy(bucket).agg(F.count("*").alias("n"))
    asked = q.select("ask").distinct().select("ask", F.explode(_keys(F.col("ask"))).alias("h")).withColumn("bucket", bucket)
    # an item that holds all words holds the rarest; a word of no item ends the query
    rarest = asked.join(F.broadcast(n), "bucket", "left").groupBy("ask").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "h"))["h"].alias("h"))
    rarest = rarest.select("ask", "h", _marks(_keys(F.col("ask"))).alias("need"))
    held = i.select("id", "text").distinct().select("id", _keys(F.col("text")).alias("hs")).select("id", _marks(F.col("hs")).alias("has"), F.explode("hs").alias("h"))
    near = rarest.join(held.hint("merge"), "h").where(F.col("need").bitwiseAND(F.bitwise_not("has")) == 0)
    near = near.select("ask", "id").repartition("id").distinct()  # two texts of one id would meet a query twice
    hit = near.join(i.hint("merge"), "id").where(F.size(F.array_except(_words(F.col("ask")), _words(F.col("text")))) == 0)
    sc = hit.select("ask", "i", F.round(F.size(_words(F.col("ask"))) / F.size(_words(F.col("text"))), 6).alias("score"))
    best = sc.withColumn("pos", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "i"))).where(F.col("pos") <= k)
    return q.join(best.hint("merge"), "ask").select("q", "i", "score", "pos")
