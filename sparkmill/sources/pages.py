"""Scans of shop pages and documents held in a DataFrame, and file sources."""

from __future__ import annotations

import tomllib

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.functions.columns import money as amount

#: The JSON of a shop's product page.
PRODUCTS_PAGE = (
    "products array<struct<id:bigint,title:string,handle:string,vendor:string,product_type:string,"
    "variants:array<struct<id:bigint,title:string,sku:string,price:string,compare_at_price:string,grams:int,available:boolean>>>>"
)


def json_products(pages: DataFrame, body: str = "body", url: str = "url") -> DataFrame:
    """url, position, product_id, variant_id, title, link, price, compare_at: a row per variant of every page. The title of a variant is added where it says something; a product with several variants gets links with the variant.

    A body that is null or no JSON gives one row with error set instead of
    failing the scan; a product without a title or variants gives none.
    """
    p = pages.select(F.col(url).alias("url"), F.from_json(F.col(body), PRODUCTS_PAGE, {"mode": "PERMISSIVE"}).alias("p"))
    bad = p.where("p IS NULL OR p.products IS NULL").select("url", F.lit("no products").alias("error"))
    each = p.select("url", F.posexplode("p.products").alias("position", "x")).where("x.title IS NOT NULL")
    v = each.select("url", "position", "x", F.explode("x.variants").alias("v"), F.size("x.variants").alias("n"))
    plain = F.lower(F.trim(F.coalesce("v.title", F.lit("")))).isin("", "default title", "standard")
    title = F.when(plain, F.col("x.title")).otherwise(F.concat_ws(" - ", "x.title", "v.title"))
    link = F.concat(F.lit("/products/"), F.coalesce("x.handle", F.lit("")), F.when(F.col("n") > 1, F.concat(F.lit("?variant="), F.col("v.id").cast("string"))).otherwise(""))
    positive = lambda c: F.when(c.try_cast("decimal(12,2)") > 0, c.try_cast("decimal(12,2)"))
    rows = v.select("url", "position", F.col("x.id").alias("product_id"), F.col("v.id").alias("variant_id"), title.alias("title"), link.alias("link"), positive(F.col("v.price")).alias("price"), positive(F.col("v.compare_at_price")).alias("compare_at"))
    return rows.unionByName(bad, allowMissingColumns=True)


def html_cards(pages: DataFrame, card: str, fields: dict[str, str], html: str = "html", url: str = "url") -> DataFrame:
    """url, position and the named fields of every card of a page: card is a regular expression of a card's markup, each field one whose first group is its value. A field that isn't found is null; a null page has no cards."""
    c = pages.select(F.col(url).alias("url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(card), F.lit(0))).alias("position", "card"))
    text = lambda e: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("card", e, 1), "<[^>]*>", "")), F.lit(""))
    return c.select("url", "position", *[text(e).alias(k) for k, e in fields.items()])


def attribute_cards(pages: DataFrame, card: str, attribute: str, fields: dict[str, str], shown_price: str | None = None, html: str = "html", url: str = "url") -> DataFrame:
    """url, position, the named fields and error of every card of a page whose data stand in an attribute as JSON.

    attribute is a regular expression of a card whose first group is the JSON, its quotes written as entities or not; each field is a path in it. error is
    null, "no data" (no attribute, or no JSON in it), or "price" where shown_price, a regular expression of the price as shown, gives another amount than the field
    price. A bad card is a row with its error and never fails the page; a null page has no cards.
    """
    c = pages.select(F.col(url).alias("url"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(card), F.lit(0))).alias("position", "card"))
    plain = F.regexp_extract("card", attribute, 1)
    for entity, sign in {"&quot;": '"', "&#34;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}.items():
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    c = c.withColumn("_json", F.from_json(plain, "map<string,string>", {"mode": "PERMISSIVE"})).withColumn("_text", plain)
    values = {k: F.get_json_object("_text", p) for k, p in fields.items()}
    error = F.when(F.col("_json").isNull() | (F.size("_json") == 0), "no data")
    if shown_price is not None:
        shown = amount(F.regexp_extract("card", shown_price, 1))
        error = error.when(shown.isNotNull() & ~shown.eqNullSafe(values["price"].try_cast("decimal(12,2)")), "price")
    return c.select("url", "position", *[v.alias(k) for k, v in values.items()], error.alias("error"))


def embedded_state(pages: DataFrame, marker: str, html: str = "html", url: str = "url") -> DataFrame:
    """url, key, node: the objects of a JSON cache that a page embeds after a marker (a regular expression whose first group is the JSON); node is the object's JSON text."""
    cache = F.from_json(F.regexp_extract(F.col(html), marker, 1), "map<string,string>")
    return pages.select(F.col(url).alias("url"), F.explode(cache).alias("key", "node"))


def follow(nodes: DataFrame, path: str, name: str) -> DataFrame:
    """Adds the node that each node's reference points to, by a self-join on the page and key; a dangling reference is null."""
    at = nodes.withColumn("_ref", F.get_json_object("node", path))
    target = nodes.select("url", F.col("key").alias("_ref"), F.col("node").alias(name))
    return at.join(target, ["url", "_ref"], "left").drop("_ref")


def follow_all(nodes: DataFrame, steps: list[str], start: str) -> DataFrame:
    """url, key, found, error of every node whose key begins with start: the node at the end of a chain of references, each step a path in the node that the step before has found.

    A chain that ends early has found null, and error names the step: "no reference" where the path gives none, "dangling" where nothing has the key that it names.
    """
    at = nodes.where(F.col("key").startswith(start)).withColumns({"found": F.col("node"), "error": F.lit(None).cast("string")}).select("url", "key", "found", "error")
    target = nodes.select("url", F.col("key").alias("_ref"), F.col("node").alias("_next"))
    for n, path in enumerate(steps, 1):
        j = at.withColumn("_ref", F.get_json_object("found", path)).join(target, ["url", "_ref"], "left")
        why = F.when(F.col("_ref").isNull(), f"no reference at step {n}").when(F.col("_next").isNull(), f"dangling at step {n}")
        at = j.select("url", "key", F.col("_next").alias("found"), F.coalesce("error", why).alias("error"))
    return at


def first_wins(rows: DataFrame, key: str, order: list[str], most: int | None = None) -> DataFrame:
    """The first row of every key in the walk's order, and of these the first ones up to the asked number."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")
    return first.orderBy(*order).limit(most) if most is not None else first


def category_walk(pages: DataFrame, rows: DataFrame, category: str, page: str, failed: str, more: str, key: str, position: str, most_pages: int, most: int | None = None) -> DataFrame:
    """The rows that a walk of the categories in order takes: of each category the pages up to the first that failed, that has no further one, or that is the last allowed; of a failed page none; of every key the first in the whole run, and no more than most in all."""
    w = Window.partitionBy(category).orderBy(page)
    ends = (F.col(failed) | ~F.col(more)).cast("int")
    d = pages.withColumn("_before", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.row_number().over(w))
    read = d.where((F.col("_before") == 0) & (F.col("_n") <= most_pages) & ~F.col(failed)).select(category, page)
    return first_wins(rows.join(read, [category, page], "left_semi"), key, [category, page, position], most)


def pages_read(pages: DataFrame, category: str, order: str, rows: str, failed: str, page_size: int, failures: int) -> DataFrame:
    """The pages up to where the walk of each category stops: the first short page, or the last of so many failed ones in a row."""
    w = Window.partitionBy(category).orderBy(order)
    d = pages.withColumn("_run", F.sum((~F.col(failed)).cast("int")).over(w))
    d = d.withColumn("_streak", F.sum(F.col(failed).cast("int")).over(Window.partitionBy(category, "_run").orderBy(order)))
    d = d.withColumn("_stop", (~F.col(failed) & (F.col(rows) < page_size)) | (F.col(failed) & (F.col("_streak") >= failures)))
    before = F.coalesce(F.max(F.col("_stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_done", before).where("_done = 0").drop("_run", "_streak", "_stop", "_done")


def markdown_sections(docs: DataFrame, text: str = "text", key: str = "doc") -> DataFrame:
    """key, number, heading, body of the second-level sections with a number ("## 3. Title")."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(F.col(text), "\r", "")), r"\n(?=## )"), lambda p: p.rlike(r"^## \d+\."))
    s = docs.select(F.col(key).alias("doc"), F.explode(parts).alias("p"))
    return s.select("doc", F.regexp_extract("p", r"^## (\d+)\.", 1).cast("int").alias("number"), F.trim(F.regexp_extract("p", r"^## \d+\.([^\n]*)", 1)).alias("heading"), F.regexp_replace(F.regexp_replace("p", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))


def markdown_table(docs: DataFrame, text: str = "text", key: str = "doc") -> DataFrame:
    """key, row, cells of pipe tables, without the rules under their heads."""
    lines = F.split(F.regexp_replace(F.col(text), "\r", ""), "\n")
    l = docs.select(F.col(key).alias("doc"), F.posexplode(lines).alias("row", "line"))
    l = l.where(F.trim("line").rlike(r"^\|.*\|$") & ~F.trim("line").rlike(r"^\|[\s:|-]*-[\s:|-]*\|$"))
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    return l.select("doc", "row", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def toml_table(spark: SparkSession, path: str) -> DataFrame:
    """section, name, value (as text) of a TOML file of settings; read on the driver, as it is a file of settings."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    rows = []
    for k, v in data.items():
        rows += [(k, n, str(x)) for n, x in v.items()] if isinstance(v, dict) else [("", k, str(v))]
    return spark.createDataFrame(rows, "section string, name string, value string")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a head line and a declared schema; a byte order mark is no part of the first name. Doubled quotes stand for one, line ends may stand in quotes, an empty field is null."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE", quote='"', escape='"', multiLine=True)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Documents of JSON files with a declared schema: one a file, or an array of them, or one a line. A broken file gives a row of nulls."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema if it is missing or its rows can't be read; one row is read to tell."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(1).collect()
        return df
    except (PySparkException, Py4JJavaError) as e:
        if not any(reason in str(e) for reason in ("PATH_NOT_FOUND", "FAILED_READ_FILE")):
            raise
        return spark.createDataFrame([], schema)


def table_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes of every Parquet table of a folder, one file or many; only files' names and lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return files.groupBy(F.regexp_extract("path", r"/([^/]+)\.parquet(?:/[^/]*)?$", 1).alias("name")).agg(F.sum("length").alias("bytes"))
