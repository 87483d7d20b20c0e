"""Queries of scans and passes over document files with forms, fonts, annotations, layers and private data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.codecs import flate
from vellum.operators import inventory
from vellum.operators.classify import page_class
from vellum.plans.registry import query
from vellum.session import checkpoint, read_table, shared_dir, spread
from vellum.sources import analysis, cos, documents, passes, text_state

_FROM = "FROM documents WHERE doc_id IS NOT NULL"
JPEG = b"\xff\xd8\xff\xe1\0\6Exif\xff\xdb\0\4ab\xff\xda\0\2\xff\xd9"


def _document(d: int) -> cos.Document:
    """A document of two pages whose parts follow the number's remainders."""
    name, ref, stream = cos.Name, cos.Ref, cos.Stream
    k = 1 + d % 3
    first = b"q %d 0 0 3 0 0 cm /Fm Do Q q 7 0 0 8 0 0 cm /Im Do Q BT /F1 10 Tf 1 0 0 1 50 60 Tm (ab) Tj ET" % (2 * k)
    first += b" BT /F1 10 Tf 3 Tr 1 0 0 1 60 90 Tm (unseen) Tj ET" if d % 4 == 0 else b""
    annotations = [ref(10), ref(11), ref(12)]
    catalog = {"Type": name("Catalog"), "Pages": ref(2), "AcroForm": {"Fields": [ref(11)]}}
    catalog |= {"Metadata": ref(30)} if d % 2 == 0 else {}
    catalog |= {"OCProperties": {"OCGs": [], "D": {}}} if d % 3 == 0 else {}
    catalog |= {"Names": {"JavaScript": {"Names": []}, "EmbeddedFiles": {"Names": []}}} if d % 5 == 0 else {}
    catalog |= {"OpenAction": {"S": name("JavaScript"), "JS": b"x"}} if d % 4 == 0 else {}
    catalog |= {"PieceInfo": {"Tool": {}}} if d % 7 == 0 else {}
    catalog |= {"Odd": 1} if d % 6 == 0 else {}
    image = {"Type": name("XObject"), "Subtype": name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": name("DeviceGray")}
    font = {"Type": name("Font"), "Subtype": name("TrueType"), "FirstChar": 97, "Widths": [250, 500, 750], "FontDescriptor": ref(16)}
    gstate = {"Type": name("ExtGState"), "ca": 0.5}
    form = lambda body, **more: stream({"Type": name("XObject"), "Subtype": name("Form"), "BBox": [0, 0, 10, 10], **more}, body)
    objects = {
        ref(1): catalog,
        ref(2): {"Type": name("Pages"), "Kids": [ref(3), ref(4)], "Count": 2, "MediaBox": [0, 0, 612, 792]},
        ref(3): {"Type": name("Page"), "Parent": ref(2), "Contents": ref(5), "Resources": ref(6), "Annots": annotations, "CropBox": [310, 20, 10 + d % 10, 220], "UserUnit": 2} | ({"Thumb": ref(33)} if d % 3 == 0 else {}),
        ref(4): {"Type": name("Page"), "Parent": ref(2), "Contents": [ref(7), ref(27)], "Resources": ref(6), "UserUnit": -1},
        ref(5): stream({"Filter": name("FlateDecode")}, flate(first)),
        ref(6): {"XObject": {"Fm": ref(8), "Im": ref(9), "Twin": ref(14), "Jpg": ref(19)}, "Font": {"F1": ref(13), "F2": ref(18)}, "ExtGState": {"A": ref(20), "B": ref(21)}, "ColorSpace": {"C1": [name("ICCBased"), ref(24)], "C2": [name("ICCBased"), ref(25)]}, "Shading": {"S1": {"ShadingType": 2, "Function": ref(22)}, "S2": {"ShadingType": 2, "Function": ref(23)}}},
        ref(7): stream({}, b"BT /F2 10 Tf (bc) Tj ET"),
        ref(27): stream({}, b"BT /F2 10 Tf (bc) Tj ET"),
        ref(8): form(b"10 0 0 10 0 0 cm /Im Do", Matrix=[1, 0, 0, 1, 5, 5], Resources={"XObject": {"Im": ref(9)}}),
        ref(9): stream(dict(image), b"\x07"),
        ref(14): stream(dict(image), b"\x07"),
        ref(19): stream(image | {"Filter": name("DCTDecode")}, JPEG),
        ref(10): {"Type": name("Annot"), "Subtype": name("Link"), "Rect": [0, 0, 9, 9], "A": {"S": name("URI"), "URI": b"u", "Next": {"S": name("Launch" if d % 5 == 1 else "GoTo")}}},
        ref(11): {"Type": name("Annot"), "Subtype": name("Widget"), "FT": name("Tx"), "V": b"secret", "Rect": [100, 100, 120, 140], "AP": {"N": ref(15)}},
        ref(12): {"Type": name("Annot"), "Subtype": name("Text"), "Rect": [0, 0, 10, 10], "F": 2 if d % 2 else 0, "AP": {"N": ref(26)}},
        ref(13): dict(font),
        ref(18): dict(font),
        ref(16): {"Type": name("FontDescriptor"), "FontFile2": ref(17)},
        ref(17): stream({}, b"program"),
        ref(15): form(b"0 0 10 10 re f"),
        ref(26): form(b"0 0 10 10 re f", **({"LastModified": b"D:2020"} if d % 3 else {})),
        ref(20): dict(gstate),
        ref(21): dict(gstate),
        ref(22): stream({"FunctionType": 0, "Domain": [0, 1]}, b"fn"),
        ref(23): stream({"FunctionType": 0, "Domain": [0, 1]}, b"fn"),
        ref(24): stream({"N": 3}, b"profile"),
        ref(25): stream({"N": 3}, b"profile"),
        ref(30): stream({"Type": name("Metadata"), "Subtype": name("XML")}, b"<x/>"),
        ref(33): stream({"Width": 1}, b"t"),
        ref(34): {"Title": str(d).encode()},
    }
    return cos.Document(objects, {"Root": ref(1), "Info": ref(34)}, "", 0)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        made = [cos.write(_document(d), packed=d % 2 == 0) for d in ids]
        yield pa.RecordBatch.from_arrays([pa.array([f"{d}.pdf" for d in ids], pa.string()), pa.array(made, pa.binary())], ["path", "content"])


#: Documents that one task makes and reads; their numbers are few bytes, which the engine would leave in one task.
FILES_PER_TASK = 2000


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id")
    return spread(docs, "doc_id", rows=FILES_PER_TASK).distinct()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a document of two pages for every document's number."""
    return _numbers(spark, sf_dir).mapInArrow(_build, "path string, content binary")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, made once, for plans that read them more than once."""
    return checkpoint(files(spark, sf_dir))


# --- scans ---------------------------------------------------------------------------------------


@query("page_boxes", f"SELECT page, x0, y0, x1, y1, user_unit, COUNT(*) AS pages FROM (SELECT 0 AS page, 10.0::DOUBLE + doc_id % 10 AS x0, 20.0::DOUBLE AS y0, 310.0::DOUBLE AS x1, 220.0::DOUBLE AS y1, 2.0::DOUBLE AS user_unit {_FROM} UNION ALL SELECT 1, 0.0, 0.0, 612.0, 792.0, NULL {_FROM}) GROUP BY ALL")
def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by box and unit: corners in any order, inherited boxes, unusable units."""
    pages = documents.scan_pages(files(spark, sf_dir))
    return pages.groupBy("page", "x0", "y0", "x1", "y1", "user_unit").agg(F.count("*").alias("pages"))


@query("form_contents", f"SELECT sha256(c) AS digest, CAST(SUM(n) AS BIGINT) AS forms FROM (SELECT '10 0 0 10 0 0 cm /Im Do' AS c, COUNT(*) AS n {_FROM} UNION ALL SELECT '0 0 10 10 re f', 2 * COUNT(*) {_FROM}) GROUP BY c")
def form_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded contents of form objects."""
    return documents.scan_forms(files(spark, sf_dir)).where("complete").groupBy(F.sha2("content", 256).alias("digest")).agg(F.count("*").alias("forms"))


@query("image_placements", f"SELECT 20.0::DOUBLE * (1 + doc_id % 3) AS width, 30.0::DOUBLE AS height, CAST(2 AS BIGINT) AS uses, COUNT(*) AS images {_FROM} GROUP BY 1")
def image_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by their largest placement, in forms too."""
    placed = text_state.placements(text_state.scan_events(files(spark, sf_dir)))
    return placed.groupBy("width", "height", "uses").agg(F.count("*").alias("images"))


@query("direct_bindings", f"SELECT 0 AS page, COUNT(*) AS images {_FROM}")
def direct_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that pages draw themselves."""
    return text_state.direct_bindings(text_state.scan_events(files(spark, sf_dir))).groupBy("page").agg(F.count("*").alias("images"))


@query("glyph_usage", f"SELECT codes, COUNT(*) AS fonts FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN [97, 98, 101, 110, 115, 117] ELSE [97, 98] END AS c {_FROM} UNION ALL SELECT [98, 99] {_FROM}), (SELECT 1), LATERAL (SELECT array_to_string(c, ' ') AS codes) GROUP BY codes")
def glyph_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts by the codes that texts show in them."""
    usage = text_state.glyph_usage(text_state.scan_events(files(spark, sf_dir)))
    return usage.groupBy(F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes")).agg(F.count("*").alias("fonts"))


@query("glyph_unions", f"SELECT CASE WHEN doc_id % 4 = 0 THEN '97 98 99 101 110 115 117' ELSE '97 98 99' END AS codes, COUNT(*) AS programs {_FROM} GROUP BY 1")
def glyph_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs by the codes of all fonts that use them."""
    made = stored(spark, sf_dir)
    programs = inventory.programs_of(analysis.font_uses(made)).select("doc_id", "program", F.explode("users").alias("font"))
    usage = text_state.glyph_usage(text_state.scan_events(made)).join(programs, ["doc_id", "font"])
    unions = inventory.glyph_unions(usage, ["doc_id", "program"])
    return unions.groupBy(F.array_join(F.transform("codes", lambda c: c.cast("string")), " ").alias("codes")).agg(F.count("*").alias("programs"))


@query("font_ownership", f"SELECT CAST(2 AS BIGINT) AS users, FALSE AS only_cid_truetype, COUNT(*) AS programs {_FROM}")
def font_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded programs by the fonts that use them."""
    return inventory.programs_of(analysis.font_uses(files(spark, sf_dir))).groupBy(F.size("users").cast("long").alias("users"), "only_cid_truetype").agg(F.count("*").alias("programs"))


@query("incoming_owners", f"SELECT CAST(owners AS BIGINT) AS owners, CAST(COUNT(*) AS BIGINT) AS objects FROM (SELECT unnest(CASE WHEN doc_id % 2 = 0 THEN [2, 2] ELSE [2, 2] END) AS owners {_FROM}) GROUP BY 1")
def incoming_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and descriptors that two objects refer to."""
    objects = analysis.scan_roles(files(spark, sf_dir), ("kind", "subtype", "incoming")).where("subtype = 'Image' OR kind = 'FontDescriptor'")
    owned = objects.select(F.array_distinct(F.transform("incoming", lambda x: x["src"])).alias("owners"))
    return owned.where(F.size("owners") > 1).groupBy(F.size("owners").cast("long").alias("owners")).agg(F.count("*").alias("objects"))


@query("edge_counts", f"SELECT 'dict:Page' AS source, key, target, CAST(n * m AS BIGINT) AS edges FROM (SELECT COUNT(*) AS m {_FROM}), (SELECT * FROM (VALUES ('Parent', 'dict:Pages', 2), ('Resources', 'dict:untyped', 2), ('Contents', 'stream:page-content', 3), ('Annots', 'dict:Annot/Link', 1), ('Annots', 'dict:Annot/Widget', 1), ('Annots', 'dict:Annot/Text', 1)) AS t(key, target, n))")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of pages by key and the role of what they refer to."""
    edges = analysis.role_edges(files(spark, sf_dir), ("source", "key", "target")).where("source = 'dict:Page' AND key <> 'Thumb'")
    return edges.groupBy("source", "key", "target").agg(F.count("*").alias("edges"))


@query("key_counts", f"SELECT 'dict:Page' AS role, key, CAST(n AS BIGINT) AS objects FROM (SELECT COUNT(*) AS m, COUNT(*) FILTER (doc_id % 3 = 0) AS t {_FROM}), LATERAL (SELECT unnest(['Type', 'Parent', 'Contents', 'Resources', 'UserUnit', 'Annots', 'CropBox', 'Thumb']) AS key, unnest([2 * m, 2 * m, 2 * m, 2 * m, 2 * m, m, m, t]) AS n) WHERE n > 0")
def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of pages."""
    return inventory.key_counts(analysis.scan_roles(files(spark, sf_dir), ("role", "keys"))).where("role = 'dict:Page'")


@query("streams_by_subtype", f"SELECT 'Image' AS subtype, CAST(3 * COUNT(*) AS BIGINT) AS streams {_FROM} UNION ALL SELECT 'Form', CAST(3 * COUNT(*) AS BIGINT) {_FROM}")
def streams_by_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachable streams of two subtypes."""
    streams = analysis.scan_roles(files(spark, sf_dir), ("type", "subtype", "reached")).where("type = 'stream' AND reached")
    counts = streams.agg(*[F.count_if(F.col("subtype") == s).alias(s) for s in ("Image", "Form")])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("subtype"), F.col(s).alias("streams")) for s in ("Image", "Form")])).alias("x")).select("x.*")


@query("plain_streams", f"SELECT CAST(COUNT(*) * 3 AS BIGINT) AS images, CAST(COUNT(*) * 2 AS BIGINT) AS plain {_FROM}")
def plain_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that keep their own data plainly."""
    images = documents.scan_objects(files(spark, sf_dir), ("subtype", "keys", "filters")).where("subtype = 'Image'")
    return images.agg(F.count("*").alias("images"), F.count_if(inventory.is_plain_stream(F.col("keys"), F.col("filters"))).alias("plain"))


@query("unreadable_files", f"SELECT COUNT(*) FILTER (doc_id % 7 = 3) AS failed, COUNT(*) FILTER (doc_id % 7 <> 3) * 2 AS pages {_FROM}")
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged files stand among the failures, and the others are read."""
    number = F.regexp_extract("path", r"^(\d+)", 1).cast("long")
    made = stored(spark, sf_dir).withColumn("content", F.when(number % 7 == 3, F.lit("nothing of a document").cast("binary")).otherwise(F.col("content")))
    failed = documents.failure_report(documents.scan_failures(made)).select("failed")
    return failed.crossJoin(documents.scan_pages(made).agg(F.count("*").alias("pages")))  # one row each


@query("event_page_class", f"SELECT class, COUNT(*) AS pages FROM (SELECT 'native' AS class {_FROM} UNION ALL SELECT 'native' {_FROM}) GROUP BY 1")
def event_page_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page classes from the paints that contents make."""
    facts = text_state.page_facts(text_state.scan_events(stored(spark, sf_dir)))  # read for counts and for covers
    kind = page_class(F.col("paints"), F.col("coverage"), F.col("visible_native"), F.col("image_paints"), F.col("unknown_paints"), F.col("complete"))
    return facts.groupBy(kind.alias("class")).agg(F.count("*").alias("pages"))


@query(
    "document_risks",
    f"""
WITH c AS (SELECT COUNT(*) FILTER (doc_id % 3 = 0) AS three, COUNT(*) FILTER (doc_id % 4 = 0) AS four, COUNT(*) FILTER (doc_id % 7 = 0) AS seven, COUNT(*) FILTER (doc_id % 2 = 0) AS two, COUNT(*) AS n {_FROM})
SELECT kind, CAST(count AS BIGINT) AS count FROM c, LATERAL (SELECT unnest(['thumbnail', 'automatic-action', 'hidden-layer', 'piece-info', 'xmp-metadata', 'form-value', 'jpeg-metadata']) AS kind, unnest([three, four, three, seven, two, n, n]) AS count) WHERE count > 0
""",
)
def document_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files hold that their pages don't show, by kind."""
    kinds = ("thumbnail", "automatic-action", "hidden-layer", "piece-info", "xmp-metadata", "form-value", "jpeg-metadata")
    return analysis.risk_summary(stored(spark, sf_dir)).where(F.col("kind").isin(*kinds)).groupBy("kind").agg(F.sum("count").alias("count"))


@query("repeated_files", f"SELECT COUNT(*) * 2 AS files, CAST(SUM(2 + 2) AS BIGINT) AS pages, CAST(SUM(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS hidden {_FROM}")
def repeated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of files that all come twice: a copy has its row and changes no other."""
    made = stored(spark, sf_dir)
    twice = made.union(made.select(F.concat(F.lit("copy-"), "path").alias("path"), "content"))
    return analysis.summaries(twice).agg(F.count("*").alias("files"), F.sum("pages").alias("pages"), F.sum("hidden_text_findings").alias("hidden"))


def _inline_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, ref = cos.Name, cos.Ref
    short, long_ = b"BI /W 2 /H 1 /BPC 8 /CS /G /F /AHx ID %02X%02X> EI ", b"BI /Height 1 /Width 2 /ColorSpace /DeviceGray /Filter /ASCIIHexDecode /BitsPerComponent 8 ID %02X%02X> EI "
    for batch in batches:
        made, ids = [], batch.column(0).to_pylist()
        for d in ids:
            pair = (d % 5, d % 3)
            content = (short if d % 2 else long_) % pair + long_ % (255, d % 3)
            objects = {ref(1): {"Type": name("Catalog"), "Pages": ref(2)}, ref(2): {"Type": name("Pages"), "Kids": [ref(3)], "Count": 1}, ref(3): {"Type": name("Page"), "Parent": ref(2), "Contents": ref(4)}, ref(4): cos.Stream({"Key": d}, content)}
            made.append(cos.write(cos.Document(objects, {"Root": ref(1)}, "", 0)))
        yield pa.RecordBatch.from_arrays([pa.array([f"{d}.pdf" for d in ids], pa.string()), pa.array(made, pa.binary())], ["path", "content"])


@query("inline_images", f"SELECT images, CAST(COUNT(*) AS BIGINT) AS kinds FROM (SELECT COUNT(*) AS images FROM (SELECT doc_id % 5 AS a, doc_id % 3 AS b {_FROM} UNION ALL SELECT 255, doc_id % 3 {_FROM}) GROUP BY a, b) GROUP BY images")
def inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline images that mean the same, shortened or not."""
    found = documents.scan_inline_images(_numbers(spark, sf_dir).mapInArrow(_inline_files, "path string, content binary"))
    return found.groupBy("fingerprint").agg(F.count("*").alias("images")).groupBy("images").agg(F.count("*").alias("kinds"))


# --- twins ---------------------------------------------------------------------------------------


@query(
    "exact_twins",
    f"SELECT target, CAST(n AS BIGINT) AS twins FROM (SELECT COUNT(*) AS n {_FROM}), (SELECT unnest(['image', 'font', 'ext-gstate', 'sampled-function', 'icc-profile', 'page-content']) AS target) UNION ALL SELECT 'appearance', COUNT(*) FILTER (doc_id % 3 = 0) {_FROM}",
)
def exact_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that equal an earlier one of their document, by target."""
    objects = analysis.scan_roles(files(spark, sf_dir), ("doc_id", "num", "type", "kind", "keys", "value", "raw", "stream_role", "incoming"))
    twins = inventory.twins_of(inventory.with_targets(objects))
    return twins.groupBy("target").agg(F.count("*").alias("twins"))


@query("form_twins", f"SELECT 'exact' AS kind, COUNT(*) FILTER (doc_id % 3 = 0) AS forms {_FROM} UNION ALL SELECT 'but for dates', COUNT(*) {_FROM}")
def form_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that equal another with all they refer to, exactly and but for their dates."""
    kinds = {"exact": ("Length",), "but for dates": ("Length", "LastModified")}
    counts = analysis.form_twins(files(spark, sf_dir), kinds).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("forms")) for k in kinds])).alias("x")).select("x.*")


# --- passes --------------------------------------------------------------------------------------


def _took(made: DataFrame, kind: str) -> DataFrame:
    return made.select(F.explode("counts").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("removed")).select(F.lit(kind).alias("pass"), "label", "removed")


@query(
    "preservation_passes",
    f"""
WITH c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (doc_id % 2 = 0) AS two, COUNT(*) FILTER (doc_id % 3 = 0) AS three, COUNT(*) FILTER (doc_id % 4 = 0) AS four, COUNT(*) FILTER (doc_id % 5 = 0) AS five, COUNT(*) FILTER (doc_id % 6 = 0) AS six, COUNT(*) FILTER (doc_id % 7 = 0) AS seven, COUNT(*) FILTER (doc_id % 3 <> 0) AS dated {_FROM})
SELECT pass, label, CAST(removed AS BIGINT) AS removed FROM c, LATERAL (SELECT * FROM (VALUES ('functional', 'private-data', seven), ('functional', 'thumbnails', three),
  ('visible-surface', 'private-data', seven), ('visible-surface', 'thumbnails', three), ('visible-surface', 'annotations', 3 * n), ('visible-surface', 'metadata', n + two + dated), ('visible-surface', 'catalog-keys', n + five + four + six)) AS t(pass, label, removed)) WHERE removed > 0
""",
)
def preservation_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two presets take from files."""
    made = stored(spark, sf_dir)
    both = [_took(passes.preserve(made, preset), preset) for preset in ("functional", "visible-surface")]
    return both[0].union(both[1])


@query(
    "scrub_passes",
    f"""
WITH c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (doc_id % 2 = 0) AS two, COUNT(*) FILTER (doc_id % 3 = 0) AS three, COUNT(*) FILTER (doc_id % 4 = 0) AS four, COUNT(*) FILTER (doc_id % 5 = 0) AS five, COUNT(*) FILTER (doc_id % 5 = 1) AS launch, COUNT(*) FILTER (doc_id % 7 = 0) AS seven, COUNT(*) FILTER (doc_id % 3 <> 0) AS dated {_FROM})
SELECT pass, label, CAST(removed AS BIGINT) AS removed FROM c, LATERAL (SELECT * FROM (VALUES ('1', 'info-dictionary', n), ('1', 'xmp-reference', two), ('1', 'piece-info', seven), ('1', 'last-modified', dated), ('1', 'jpeg-metadata', n),
  ('2', 'info-dictionary', n), ('2', 'xmp-reference', two), ('2', 'piece-info', seven), ('2', 'last-modified', dated), ('2', 'jpeg-metadata', n), ('2', 'thumbnail', three), ('2', 'dangerous-actions', four + launch), ('2', 'javascript-names', five), ('2', 'attachments', five), ('2', 'form-value', n)) AS t(pass, label, removed)) WHERE removed > 0
""",
)
def scrub_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both levels of scrubbing take from files."""
    made = stored(spark, sf_dir)
    return _took(passes.scrub_files(made, 1), "1").union(_took(passes.scrub_files(made, 2), "2"))


@query("flattened_annotations", f"SELECT CAST(SUM(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS flattened, CAST(0 AS BIGINT) AS annotations, CAST(SUM(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS fills {_FROM}")
def flattened_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations' appearances as page content; hidden ones are left out."""
    flat = checkpoint(passes.apply(files(spark, sf_dir), [passes.flatten_annotations()]))
    counts = _took(flat, "flat").where("label = 'flattened'").agg(F.sum("removed").alias("flattened"))
    left = documents.scan_objects(flat, ("kind",)).where("kind = 'Annot'").agg(F.count("*").alias("annotations"))
    fills = text_state.scan_events(flat).where("event = 'fill' AND depth = 1").agg(F.count("*").alias("fills"))
    return counts.crossJoin(left).crossJoin(fills)  # one row each


@query("link_shells", f"SELECT CAST(COUNT(*) AS BIGINT) AS removed, CAST(0 AS BIGINT) AS actions {_FROM}")
def link_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that keep what they show only."""
    bare = checkpoint(passes.apply(files(spark, sf_dir), [passes.link_shells]))
    left = documents.scan_objects(bare, ("subtype", "keys")).where("subtype = 'Link'").agg(F.count_if(F.array_contains("keys", "A")).alias("actions"))
    return _took(bare, "links").agg(F.sum("removed").alias("removed")).crossJoin(left)  # one row each


@query("normalised_files", f"SELECT CAST(2 * COUNT(*) AS BIGINT) AS pages, TRUE AS one_a_line {_FROM}")
def normalised_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' contents with one instruction a line."""
    made = passes.apply(files(spark, sf_dir), [passes.normalise_contents])
    pages = checkpoint(documents.scan_pages(made).select("doc_id", "page", "content"))
    lines = F.size(F.split(F.col("content").cast("string"), "\n"))
    per = documents.parse_content(pages).groupBy("doc_id", "page").agg(F.count("*").alias("n")).join(pages.select("doc_id", "page", lines.alias("lines")), ["doc_id", "page"])
    return per.agg(F.count("*").alias("pages"), F.bool_and(F.col("n") == F.col("lines")).alias("one_a_line"))


@query("removed_hidden_text", f"SELECT COUNT(*) FILTER (doc_id % 4 = 0) AS removed, CAST(0 AS BIGINT) AS left_over, CAST(3 * COUNT(*) AS BIGINT) AS texts {_FROM}")
def removed_hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the invisible mode taken out of files; all others stay."""
    made = stored(spark, sf_dir)
    found = text_state.scan_hidden(made).withColumn("remove", F.col("mechanism") == "rendering-mode-invisible")
    clean = checkpoint(passes.remove_hidden(made, found))
    events = text_state.scan_events(clean).where("event = 'text'")
    counts = _took(clean, "hidden").agg(F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))
    return counts.crossJoin(events.agg(F.count_if(F.col("mode") == 3).alias("left_over"), F.count("*").alias("texts")))  # one row each


@query("optimization_report", f"SELECT COUNT(*) AS files, CAST(0 AS BIGINT) AS failed, TRUE AS smaller, CAST(COUNT(*) AS BIGINT) AS info {_FROM}")
def optimization_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes before and after a scrub, with what it took."""
    made = stored(spark, sf_dir)
    report = inventory.optimization_report(made, passes.scrub_files(made, 2))
    return report.select("files", "failed", ((F.col("saved") > 0) & (F.col("percent") < 100) & (F.col("saved") == F.col("bytes_before") - F.col("bytes_after"))).alias("smaller"), F.col("took")["info-dictionary"].alias("info"))


# --- caches, retargets and names -----------------------------------------------------------------


@query("known_inputs", f"SELECT COUNT(*) FILTER (doc_id % 3 <> 0) AS files {_FROM}")
def known_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose analysis can be used again, as their size and digest are the same."""
    made = stored(spark, sf_dir)
    number = F.regexp_extract("path", r"^(\d+)", 1).cast("long")
    sha = F.when(number % 3 == 0, F.sha2(F.lit("else"), 256)).otherwise(F.sha2("content", 256))
    known = made.select(F.octet_length("content").cast("long").alias("size"), sha.alias("sha256"), number.alias("objects"))
    return inventory.matching_inputs(made, known.dropDuplicates(["size", "sha256"])).agg(F.count("*").alias("files"))


@query("cache_hits", "SELECT o_custkey AS num, o_orderpriority AS level, o_orderstatus AS digest, MIN(o_orderkey) AS encoded, COUNT(*) AS streams FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2, 3")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose compressed form is known by number, level and digest."""
    rows = read_table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("num"), F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("digest"), "o_orderkey")
    hits = inventory.cache_hits(rows, rows.select("num", "level", "digest", F.col("o_orderkey").alias("encoded")))
    return hits.groupBy("num", "level", "digest", "encoded").agg(F.count("*").alias("streams"))


@query("page_retargets", "WITH one AS (SELECT c_name AS f, MIN(c_custkey) AS new FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'same' WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name FROM customer) GROUP BY 1 HAVING COUNT(*) = 1 AND c_name IS NOT NULL) SELECT c_custkey + 1000000 AS old, new FROM customer JOIN one ON c_name = f")
def page_retargets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale pages that a single live page equals."""
    key = F.col("c_custkey")
    customers = read_table(spark, sf_dir, "customer")
    live = customers.select(key.alias("page"), F.when(key % 5 == 0, "same").when(key % 7 != 0, F.col("c_name")).alias("fingerprint"))
    return inventory.retargets(customers.select((key + 1_000_000).alias("page"), F.col("c_name").alias("fingerprint")), live)


@query("elidable_profiles", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_size * 1500 >= greatest(32768, p_partkey * 2000 // 50)")
def elidable_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour profiles worth leaving out for their alternates."""
    key = F.col("p_partkey")
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.when(key % 3 != 0, "DeviceRGB").alias("alternate"), (F.col("p_size") * 1500).cast("long").alias("bytes"), (key * 2000).alias("file_bytes"))
    return inventory.elidable_profiles(rows).select("p_partkey")


@query("source_name_join", "SELECT n_name AS source, COUNT(*) AS files FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 4 <> 3 GROUP BY 1")
def source_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the source that a side table of JSON lines gives them; malformed lines are left out."""
    folder = f"{shared_dir(spark).rstrip('/')}/names-{uuid.uuid4().hex}"
    nation = read_table(spark, sf_dir, "nation")
    line = F.when(F.col("n_nationkey") % 4 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"), F.col("n_name").alias("source"))))
    nation.select(line.alias("value")).write.text(folder)
    names = documents.side_names(spark, folder)
    rows = read_table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("file"))
    return rows.join(names, "file").groupBy("source").agg(F.count("*").alias("files"))


@query("sidecar_labels", "SELECT p_brand AS glyph, CASE WHEN p_size > 45 THEN NULLIF('over' || CAST(p_size % 2 AS VARCHAR), 'over0') ELSE 'own' END AS label, COUNT(*) AS glyphs FROM part WHERE p_size % 10 <> 9 GROUP BY 1, 2")
def sidecar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from a side file of JSON lines, those of one kind overridden, an empty text suppressing the label."""
    from vellum.operators.policy import label_with_overrides

    folder = f"{shared_dir(spark).rstrip('/')}/labels-{uuid.uuid4().hex}"
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("glyph"), "p_brand", "p_size")
    line = F.when(F.col("p_size") % 10 == 9, F.lit("[not a label")).otherwise(F.to_json(F.struct("glyph", F.lit("own").alias("text"), F.lit(1.5).alias("weight"))))
    parts.select(line.alias("value")).write.text(folder)
    labels = documents.sidecar(spark, folder, documents.GLYPH_LABELS).where("glyph IS NOT NULL")
    over = parts.where("p_size > 45").select("glyph", F.when(F.col("p_size") % 2 == 0, "").otherwise("over1").alias("text"))
    items = parts.join(labels.select("glyph"), "glyph")
    found = label_with_overrides(items, labels.select("glyph", "text"), over, "glyph")
    return found.groupBy(F.col("p_brand").alias("glyph"), "label").agg(F.count("*").alias("glyphs"))


@query("report_sinks", "SELECT o_orderpriority AS kind, COUNT(*) AS samples, CAST(SUM(length(o_orderstatus || o_orderkey::VARCHAR)) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def report_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report and samples with their manifest, written and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    orders = read_table(spark, sf_dir, "orders")
    samples = orders.select("o_orderkey", F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).cast("binary").alias("payload"))
    documents.write_samples(samples, orders.select("o_orderkey", F.col("o_orderpriority").alias("kind")), folder)
    documents.write_report(orders.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("samples")), f"{folder}/report")
    manifest = spark.read.schema("o_orderkey long, kind string").json(f"{folder}/manifest")
    sizes = spark.read.parquet(f"{folder}/samples").join(manifest, "o_orderkey").groupBy("kind").agg(F.sum(F.octet_length("payload")).alias("bytes"))
    return spark.read.schema("kind string, samples long").json(f"{folder}/report").join(sizes, "kind").select("kind", "samples", "bytes")
