"""The named queries of this subpackage: thin digests over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.simhash import simhash_groups

    return simhash_groups(read_table(spark, sf_dir, "documents"))


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.mixing import mix_plan

    return mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@query("op9_sstable")
def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.sstable import read_digest, write_shards

    return read_digest(write_shards(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


_SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, unnest(range(len(words) - 19)) AS s, words FROM w WHERE len(words) >= 20
), win AS (
  SELECT doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') AS seq FROM places
), rep AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, s + i AS p FROM rep, range(20) AS r(i)
), flat AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM w
), kept AS (
  SELECT f.doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM flat f ANTI JOIN gone g USING (doc_id, p) GROUP BY 1
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op2_substring_dedup", _SUBSTRING_SQL)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.substring import substring_dedup

    found = substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_c0").alias("doc_id"), "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op4_cross_polytope")
def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.vectors import cosine_groups

    return cosine_groups(read_table(spark, sf_dir, "embeddings"))


_TOPK_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.ints AS DOUBLE[]), CAST(r.ints AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.row <> r.row WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query("op10_threshold_topk", _TOPK_SQL)
def op10_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.topk import exact_topk

    return exact_topk(read_table(spark, sf_dir, "embeddings"))


#: Host and path rules of the query on pages.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


@query("op1_url_rules")
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the same id say which pages of the mining sample are bad: low quality or toxic."""
    from vellum.llm.urls import judge_urls

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").when((F.col("quality") == 1) & (F.col("toxic") == 0), "allow")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("label"))
    return judge_urls(pages, pages.join(labels, "page_id").select("url", "label"), URL_RULES)


@query("op8_rule_ensemble")
def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.quality import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))[0]


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: `lang` is what they declare and `source` their host."""
    from vellum.llm.language import identify

    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")).withColumnRenamed("id", "doc_id")


@query("pages_language_id")
def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on raw pages, with markup language, address suffix and host."""
    from vellum.llm.language import declared_language, identify, visible_text
    from vellum.llm.urls import host_of

    pages = read_table(spark, sf_dir, "pages")
    found = identify(pages, "page_id", visible_text(F.col("html")), declared_language(F.col("html")), F.nullif(host_of(F.col("url")), F.lit("")))
    return found.withColumnRenamed("id", "page_id")
