"""Classifiers of pages, documents, streams and hidden text, as ordered cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RASTER_COVERAGE, MIXED_COVERAGE = 0.98, 0.50
INVISIBLE_ALPHA, OPAQUE_ALPHA, COVERED, PAGE_IMAGE = 0.001, 0.995, 0.97, 0.45

# The role that a dictionary key gives the stream it refers to.
INCOMING_ROLES = {
    "Metadata": "metadata",
    "PieceInfo": "authoring-private",
    "Thumb": "thumbnail",
    "ToUnicode": "to-unicode",
    "CIDToGIDMap": "cid-to-gid",
    "CIDSet": "font-support",
    "CharProcs": "type3-charproc",
    "Mask": "image-mask",
    "SMask": "image-mask",
    "ColorSpace": "color-space-support",
    "DestOutputProfile": "color-space-support",
    "XFA": "xfa",
    "Function": "function",
    "Shading": "shading",
    "Pattern": "pattern",
}


def page_class(paints: Column, coverage: Column, visible_native: Column, image_paints: Column, unknown_paints: Column, complete: Column) -> Column:
    """blank, raster, mixed, unknown or native, the first that fits."""
    ambiguous = ~complete | (unknown_paints > 0)
    return (
        F.when((paints == 0) & complete, "blank")
        .when(paints == 0, "unknown")
        .when((coverage >= RASTER_COVERAGE) & (visible_native == 0) & ~ambiguous, "raster")
        .when((coverage >= MIXED_COVERAGE) & (visible_native > 0), "mixed")
        .when(ambiguous & (image_paints > 0), "unknown")
        .otherwise("native")
    )


def document_class(pages: DataFrame, document: str, kind: str) -> DataFrame:
    """(document, counts of page classes, representation)."""
    names = ("raster", "native", "mixed", "blank", "unknown")
    per = pages.groupBy(document).agg(*(F.count_if(F.col(kind) == n).alias(f"{n}_pages") for n in names))
    filled = F.col("raster_pages") + F.col("native_pages") + F.col("mixed_pages") + F.col("unknown_pages")
    found = (
        F.when(filled == 0, "blank")
        .when(F.col("raster_pages") == filled, "raster")
        .when(F.col("native_pages") == filled, "native")
        .when((F.col("raster_pages") * 10 >= filled * 9) & (F.col("unknown_pages") == 0), "mostly-raster")
        .when(F.col("unknown_pages") == filled, "unknown")
        .otherwise("mixed")
    )
    return per.withColumn("representation", found)


def incoming_roles(edges: DataFrame, pages: DataFrame | None = None, key: str = "key", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, roles): the distinct roles by which a node is referred to, from its edges' keys."""
    name = F.lit(None).cast("string")
    for k, role in INCOMING_ROLES.items():
        name = F.when(F.col(key) == k, role).otherwise(name)
    rows = edges.select(F.col(src).alias("_src"), F.col(dst).alias("node"), F.col(key).alias("_key"), name.alias("role"))
    found = rows.where("role IS NOT NULL").select("node", "role")
    if pages is not None:
        holders = pages.select(F.col("node").alias("_src")).distinct()
        found = found.union(rows.where("_key = 'Contents'").join(holders, "_src", "left_semi").select("node", F.lit("page-content")))
    return found.distinct().groupBy("node").agg(F.array_sort(F.collect_list("role")).alias("roles"))


def stream_role(kind: Column, subtype: Column, is_font: Column, is_icc: Column, roles: Column, keys: Column) -> Column:
    """A stream's role by type, subtype, use and defining keys, the first that fits."""
    has = lambda *names: F.forall(F.array(*[F.array_contains(keys, n) for n in names]), lambda x: x)
    return (
        F.when(kind == "Metadata", "metadata")
        .when(kind == "EmbeddedFile", "embedded-file")
        .when(kind == "ObjStm", "object-stream")
        .when(kind == "XRef", "xref-stream")
        .when(subtype == "Image", "image")
        .when(subtype == "Form", "form")
        .when(F.coalesce(is_font, F.lit(False)), "font-program")
        .when(F.array_contains(roles, "page-content"), "page-content")
        .when(F.coalesce(is_icc, F.lit(False)), "icc-profile")
        .when(F.size(roles) == 1, roles[0])
        .when(F.size(roles) > 1, "multi-reference")
        .when(kind == "CMap", "cmap")
        .when(has("PatternType"), "pattern")
        .when(has("ShadingType"), "shading")
        .when(has("FunctionType"), "function")
        .when(has("Width", "Height", "BitsPerComponent"), "image-like")
        .otherwise("other")
    )


def object_role(type_: Column, kind: Column, subtype: Column, stream: Column) -> Column:
    """The structural role of any object."""
    return (
        F.when(type_ == "stream", F.concat(F.lit("stream:"), F.coalesce(stream, F.lit("other"))))
        .when((type_ == "dictionary") & kind.isNotNull() & subtype.isNotNull(), F.concat(F.lit("dict:"), kind, F.lit("/"), subtype))
        .when((type_ == "dictionary") & kind.isNotNull(), F.concat(F.lit("dict:"), kind))
        .when((type_ == "dictionary") & subtype.isNotNull(), F.concat(F.lit("dict:subtype:"), subtype))
        .when(type_ == "dictionary", "dict:untyped")
        .otherwise(type_)
    )


def hidden_mechanism(mode: Column, alpha: Column, layer_off: Column, bounds: Column, in_crop: Column, in_clip: Column, cover_kind: Column) -> Column:
    """How a text is hidden, the first that fits; null if it isn't."""
    return (
        F.when(mode == 3, "rendering-mode-invisible")
        .when(mode == 7, "clip-only-rendering-mode")
        .when(alpha <= INVISIBLE_ALPHA, "zero-opacity")
        .when(layer_off, "optional-content-hidden")
        .when(bounds.isNull(), "degenerate-transform")
        .when(~in_crop, "outside-crop-box")
        .when(~in_clip, "clipped-out")
        .when(cover_kind == "image", "covered-by-image")
        .when(cover_kind == "fill", "covered-by-opaque-fill")
    )


def hidden_category(mechanism: Column, actual_text: Column, page_image: Column, invisible_on_page: Column, dark_cover: Column, cover_share: Column) -> Column:
    """A struct (category, action, confidence) of a hidden text, the first that fits."""
    row = lambda c, a, p: F.struct(F.lit(c).alias("category"), F.lit(a).alias("action"), F.lit(p).cast("float").alias("confidence"))
    ocr = mechanism.isin("rendering-mode-invisible", "zero-opacity", "covered-by-image") & page_image & (invisible_on_page >= 3)
    dark = (mechanism == "covered-by-opaque-fill") & F.coalesce(dark_cover, F.lit(False))
    return (
        F.when(mechanism.isNull(), F.lit(None))
        .when(actual_text.isNotNull(), row("accessibility", "keep", 0.90))
        .when(mechanism == "optional-content-hidden", row("hidden-layer", "keep", 0.95))
        .when(mechanism == "outside-crop-box", row("outside-page", "keep", 0.95))
        .when(ocr, row("ocr-overlay", "keep", 0.92))
        .when(dark & (cover_share <= 0.40), row("likely-redaction-leak", "remove", 0.94))
        .when(dark, row("other-invisible", "keep", 0.65))
        .otherwise(row("other-invisible", "keep", 0.70))
    )


def prunes_physically(category: Column, mechanism: Column, action: Column) -> Column:
    """Whether a text may go without any policy: never recognised or accessible text."""
    never = category.isin("ocr-overlay", "accessibility")
    covered = mechanism.isin("covered-by-opaque-fill", "covered-by-image")
    return F.coalesce(~never & ((mechanism == "zero-opacity") | (covered & (action == "remove"))), F.lit(False))
