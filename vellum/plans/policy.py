"""Queries of policies: allow-lists, overrides, used and unused members, labels and scrubbing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.scalars import large_enough, passes_savings, savings_percent, signed_delta
from vellum.operators.aggregate import placement_targets
from vellum.operators.classify import document_class, page_class
from vellum.operators.policy import apply_overrides, drop_keys, label_with_overrides, unused_resources, used_resources
from vellum.plans.registry import query
from vellum.session import read_table


@query(
    "policy_override",
    """
SELECT d.doc_id, d.lang, CASE WHEN l.quality = 0 THEN TRUE WHEN l.quality = 1 THEN FALSE ELSE d.lang IN ('de', 'es') END AS remove
FROM documents d LEFT JOIN labels l USING (doc_id)
""",
)
def policy_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    over = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "remove").when(F.col("quality") == 1, "keep").alias("action"))
    return apply_overrides(docs, over, docs.where("lang IN ('de', 'es')"), "doc_id", "lang").select("doc_id", "lang", "remove")


@query(
    "query_keys",
    """
SELECT page_id, len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ('ref', 'utm_source'))) AS kept,
  len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] IN ('ref', 'utm_source'))) AS dropped FROM pages
""",
)
def query_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.nullif(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit(""))
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.str_to_map(text, F.lit("&"), F.lit("=")), F.create_map().cast("map<string,string>")).alias("keys"))
    kept = drop_keys(pages, "keys", ["ref", "utm_source"])
    return kept.select("page_id", F.size("keys").cast("long").alias("kept"), F.col("dropped").cast("long").alias("dropped"))


@query("used_resources", "SELECT c_mktsegment, COUNT(*) AS used FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1")
def used(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return used_resources(read_table(spark, sf_dir, "customer"), orders, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("used"))


@query("pruned_resources", "SELECT c_mktsegment, COUNT(*) AS unused FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return unused_resources(read_table(spark, sf_dir, "customer"), orders, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("unused"))


@query("candidate_difference", "SELECT doc_id FROM documents WHERE lang <> 'en' EXCEPT SELECT doc_id FROM labels")
def candidate_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id").subtract(read_table(spark, sf_dir, "labels").select("doc_id"))


@query("inventory_union", "SELECT doc_id FROM documents WHERE n_chars > 3000 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def inventory_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_ = read_table(spark, sf_dir, "documents").where("n_chars > 3000").select("doc_id")
    return long_.unionByName(read_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")).distinct()


@query(
    "label_override",
    """
SELECT doc_id, NULLIF(COALESCE(o.text, l.text), '') AS label FROM documents LEFT JOIN (SELECT doc_id, 'q' || CAST(quality AS VARCHAR) AS text FROM labels) l USING (doc_id)
LEFT JOIN (SELECT doc_id, CASE WHEN quality = 0 THEN '' ELSE 'toxic' END AS text FROM labels WHERE toxic = 1) o USING (doc_id)
""",
)
def label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    own = labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("text"))
    over = labels.where("toxic = 1").select("doc_id", F.when(F.col("quality") == 0, "").otherwise("toxic").alias("text"))
    return label_with_overrides(read_table(spark, sf_dir, "documents").select("doc_id"), own, over, "doc_id").select("doc_id", "label")


@query("image_prefilter", "SELECT p_partkey, p_size, CAST(floor(p_retailprice) AS BIGINT) AS h FROM part WHERE p_size * 10 > 128 AND CAST(floor(p_retailprice) AS BIGINT) > 128 AND p_size * 10 * CAST(floor(p_retailprice) AS BIGINT) > 16384")
def image_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", F.floor("p_retailprice").alias("h"))
    return part.where(large_enough(F.col("p_size") * 10, F.col("h")))


@query(
    "savings_gate",
    """
WITH s AS (SELECT l_orderkey, CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS before, CAST(SUM(CAST(floor(CAST(floor(l_extendedprice) AS BIGINT) * (1 - l_discount)) AS BIGINT)) AS BIGINT) AS after FROM lineitem GROUP BY 1)
SELECT l_orderkey, before, after, before - after AS saved, round(CASE WHEN before = 0 THEN 0 ELSE (before - after) * 100.0 / before END, 6) AS percent FROM s WHERE after < before AND before - after >= 128 AND (before - after) * 100 >= before * 5
""",
)
def savings_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("l_extendedprice")
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(price).alias("before"), F.sum(F.floor(price * (1 - F.col("l_discount")))).alias("after"))
    kept = rows.where(passes_savings("before", "after", 128, 5)).withColumn("saved", signed_delta("before", "after"))
    return kept.withColumn("percent", F.round(savings_percent("saved", "before"), 6))


@query(
    "placement_agg",
    """
WITH p AS (SELECT l_orderkey % 1000 AS doc, l_partkey, MAX(l_quantity * 10) AS w, MAX(l_quantity * 7) AS h, COUNT(*) AS uses, MAX(CAST(l_partkey AS BIGINT)) AS pw FROM lineitem GROUP BY 1, 2),
whole AS (SELECT l_orderkey % 1000 AS doc FROM lineitem GROUP BY 1 HAVING bool_and(l_tax < 0.08)),
t AS (SELECT doc, l_partkey, uses, pw, greatest(1, least(pw, CAST(ceil(w * 300 / 72.0) AS BIGINT))) AS target_width, greatest(1, least(pw, CAST(ceil(h * 300 / 72.0) AS BIGINT))) AS target_height FROM p)
SELECT doc, l_partkey, uses, target_width, target_height FROM t WHERE target_width * target_height * 10 <= pw * pw * 9 AND doc IN (SELECT doc FROM whole)
""",
)
def placement_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("doc"), "l_partkey", (F.col("l_quantity") * 10).alias("w"), (F.col("l_quantity") * 7).alias("h"), F.col("l_partkey").cast("long").alias("pw"), (F.col("l_tax") < 0.08).alias("complete"))
    return placement_targets(rows, "doc", "l_partkey", "w", "h", "pw", "pw", "complete")


_PAGE = """
WITH f AS (SELECT doc_id, source, length(text) - length(replace(text, chr(10), '')) AS paints, n_chars % 101 / 100.0 AS coverage, doc_id % 3 AS native, doc_id % 2 AS images, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS unknown, doc_id % 7 <> 0 AS complete FROM documents),
p AS (SELECT *, CASE WHEN paints = 0 AND complete THEN 'blank' WHEN paints = 0 THEN 'unknown'
  WHEN coverage >= 0.98 AND native = 0 AND complete AND unknown = 0 THEN 'raster' WHEN coverage >= 0.5 AND native > 0 THEN 'mixed'
  WHEN (NOT complete OR unknown > 0) AND images > 0 THEN 'unknown' ELSE 'native' END AS class FROM f)
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("paints"), (F.col("n_chars") % 101 / 100.0).alias("coverage"),
        (d % 3).alias("native"), (d % 2).alias("images"), (d % 11 == 0).cast("int").alias("unknown"), (d % 7 != 0).alias("complete"),
    )
    kind = page_class(F.col("paints"), F.col("coverage"), F.col("native"), F.col("images"), F.col("unknown"), F.col("complete"))
    return rows.withColumn("class", kind)


@query("page_class", _PAGE + "SELECT class, COUNT(*) AS pages FROM p GROUP BY class")
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy("class").agg(F.count("*").alias("pages"))


@query(
    "doc_class",
    _PAGE
    + """, c AS (SELECT source || '-' || CAST(doc_id // 50 AS VARCHAR) AS document, COUNT(*) FILTER (class = 'raster') AS raster_pages, COUNT(*) FILTER (class = 'native') AS native_pages, COUNT(*) FILTER (class = 'mixed') AS mixed_pages,
  COUNT(*) FILTER (class = 'blank') AS blank_pages, COUNT(*) FILTER (class = 'unknown') AS unknown_pages FROM p GROUP BY 1)
SELECT *, CASE WHEN raster_pages + native_pages + mixed_pages + unknown_pages = 0 THEN 'blank' WHEN raster_pages = raster_pages + native_pages + mixed_pages + unknown_pages THEN 'raster'
 WHEN native_pages = raster_pages + native_pages + mixed_pages + unknown_pages THEN 'native' WHEN raster_pages * 10 >= (raster_pages + native_pages + mixed_pages + unknown_pages) * 9 AND unknown_pages = 0 THEN 'mostly-raster'
 WHEN unknown_pages = raster_pages + native_pages + mixed_pages + unknown_pages THEN 'unknown' ELSE 'mixed' END AS representation FROM c
""",
)
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).withColumn("document", F.concat("source", F.lit("-"), F.expr("doc_id div 50").cast("string")))
    return document_class(rows, "document", "class")
