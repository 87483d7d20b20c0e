"""Queries over document files that are made of the documents table: the adapter end to end."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.codecs import flate
from vellum.functions.scalars import decode_text_string
from vellum.operators.aggregate import content_density
from vellum.plans.registry import query
from vellum.session import checkpoint, read_table
from vellum.sources import analysis, cos, documents, text_state


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document file of a row: one page, a line of text an operator, every fifth with a hidden line."""
    name = cos.Name
    for batch in batches:
        made = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = [b"\xfe\xff" + line.encode("utf-16-be") for line in (text or "").split("\n")]
            body = b"BT /F1 10 Tf 12 TL 1 0 0 1 50 750 Tm\n" + b"".join(cos.serialise(x) + b" Tj T*\n" for x in lines) + b"ET"
            if doc_id % 5 == 0:
                body += b"\nBT /F1 10 Tf 3 Tr 1 0 0 1 50 20 Tm (unseen) ' ET"
            objects = {
                cos.Ref(1): {"Type": name("Catalog"), "Pages": cos.Ref(2)},
                cos.Ref(2): {"Type": name("Pages"), "Kids": [cos.Ref(3)], "Count": 1, "MediaBox": [0, 0, 100000, 1000]},
                cos.Ref(3): {"Type": name("Page"), "Parent": cos.Ref(2), "Contents": cos.Ref(4), "Resources": {}},
                cos.Ref(4): cos.Stream({"Filter": name("FlateDecode")}, flate(body)),
                cos.Ref(5): {"Title": str(doc_id).encode()},
            }
            made.append(cos.write(cos.Document(objects, {"Root": cos.Ref(1), "Info": cos.Ref(5)}, "", 0), packed=doc_id % 2 == 0))
        paths = [f"{i}.pdf" for i in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], ["path", "content"])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of a document file for every document with an id and a text."""
    docs = read_table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return docs.mapInArrow(_build, "path string, content binary")


@query("adapter_text", "SELECT CAST(doc_id AS VARCHAR) AS title, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def adapter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read back from the files' content streams."""
    made = checkpoint(files(spark, sf_dir))  # read twice, and making them is most of the work
    shown = documents.parse_content(documents.scan_pages(made)).where("op = 'Tj'")
    lines = shown.select("doc_id", F.struct("seq", decode_text_string(F.col("operands")[0]["str"]).alias("line")).alias("x"))
    texts = lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
    titles = documents.scan_objects(made, ("doc_id", "keys", "value")).where(F.array_contains("keys", "Title"))
    titles = titles.select("doc_id", F.decode(F.unhex(F.regexp_extract("value", "<([0-9a-f]*)>", 1)), "UTF-8").alias("title"))
    return titles.join(texts, "doc_id").select("title", "lines", F.sha2("text", 256).alias("digest"))


_ROLES = ("dict:Catalog", "dict:Pages", "dict:Page", "dict:untyped", "stream:page-content")


@query(
    "adapter_roles",
    "SELECT role, CASE role WHEN 'stream:object-stream' THEN n2 WHEN 'stream:xref-stream' THEN n2 ELSE n END AS objects FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (doc_id % 2 = 0) AS n2 FROM documents WHERE text IS NOT NULL), "
    "(SELECT unnest([" + ", ".join(f"'{r}'" for r in (*_ROLES, "stream:object-stream", "stream:xref-stream")) + "]) AS role)",
)
def adapter_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by structural role."""
    return analysis.scan_roles(files(spark, sf_dir), ("role",)).groupBy("role").agg(F.count("*").alias("objects"))


@query(
    "adapter_hidden_text",
    "SELECT 'rendering-mode-invisible' AS mechanism, 'other-invisible' AS category, 'keep' AS action, COUNT(*) AS texts FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0",
)
def adapter_hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden texts by mechanism, those below the page left aside."""
    found = text_state.scan_hidden(files(spark, sf_dir))
    return found.where("mechanism = 'rendering-mode-invisible'").groupBy("mechanism", "category", "action").agg(F.count("*").alias("texts"))


@query(
    "adapter_density",
    "SELECT COUNT(*) AS documents, CAST(SUM(len(string_split(text, chr(10))) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS text_shows, MAX(len(string_split(text, chr(10))) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS most FROM documents WHERE text IS NOT NULL",
)
def adapter_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content density: text operators in all and at most on one page."""
    per = content_density(documents.parse_content(documents.scan_pages(files(spark, sf_dir))))
    return per.agg(F.count("*").alias("documents"), F.sum("text_show_total").alias("text_shows"), F.max("text_show_max_page").alias("most"))


@query("adapter_collectable", "SELECT COUNT(*) FILTER (doc_id % 2 = 0) * 2 AS objects FROM documents WHERE text IS NOT NULL")
def adapter_collectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that no trailer reaches: only the packed files' own object and cross-reference streams."""
    return analysis.scan_roles(files(spark, sf_dir), ("reached",)).where("NOT reached").agg(F.count("*").alias("objects"))


@query(
    "adapter_duplicates",
    "SELECT COUNT(*) AS duplicate_groups, CAST(SUM(n - 1) AS BIGINT) AS spare FROM (SELECT text, doc_id % 5 = 0 AS h, COUNT(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1)",
)
def adapter_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal content streams over the corpus."""
    streams = analysis.scan_roles(files(spark, sf_dir), ("stream_role", "data_sha256")).where("stream_role = 'page-content'")
    groups = streams.groupBy("data_sha256").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("spare"))
