"""Queries of value functions: texts, geometry, numbers, streams, pixels, fonts and policies on stand-in rows."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf
from pyspark.sql.types import BinaryType

from vellum.functions import codecs, fonts, raster, scalars
from vellum.operators import aggregate, classify, display, policy, runs, spatial
from vellum.operators.graph import dangerous_chains
from vellum.plans.registry import query
from vellum.session import checkpoint, read_table, spread


def _per_value(each, kind: str):
    """A Pandas UDF of a plain function of its columns' values."""
    return pandas_udf(lambda *columns: pd.Series([each(*row) for row in zip(*columns)]), kind, PandasUDFType.SCALAR)


# --- texts and numbers ---------------------------------------------------------------------------


@query("text_codes", "SELECT o_orderkey, lower(hex(o_orderpriority)) AS hexed, 'FEFF' || regexp_replace(hex(o_orderpriority), '(..)', '00\\1', 'g') AS wide, 'U+' || lpad(upper(to_hex(65 + o_orderkey % 26)), 4, '0') AS label FROM orders")
def text_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal, UTF-16BE with its mark, and a glyph's label from its code."""
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    code = F.lpad(F.hex(65 + F.col("o_orderkey") % 26), 4, "0")
    return rows.select("o_orderkey", scalars.hex_lower("o_orderpriority").alias("hexed"), scalars.utf16be_hex("o_orderpriority").alias("wide"), F.concat(F.lit("U+"), code).alias("label"))


@query("number_forms", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v IN ('-0', '') THEN '0' ELSE v END AS form FROM (SELECT *, rtrim(rtrim(printf('%.10f', l_extendedprice / 8.0 - 5000), '0'), '.') AS v FROM lineitem)")
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reals in their canonical form."""
    form = _per_value(lambda v: codecs.real_form(v).decode(), "string")
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", form(F.col("l_extendedprice") / 8.0 - 5000).alias("form"))


@query(
    "quantised_values",
    """
SELECT o_orderkey, CAST(greatest(-2147483648, least(2147483647, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * floor(o_orderkey * 0.125 * 1000000 + 0.5))) AS INTEGER) AS quantised,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS exact FROM orders
""",
)
def quantised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values rounded and held within 32 bits, and longs as doubles where those are exact."""
    key = F.col("o_orderkey")
    signed = F.when(key % 2 == 0, 1).otherwise(-1) * key * 0.125
    far = F.when(key % 3 == 0, F.lit(2**53 + 1)).otherwise(key)
    return read_table(spark, sf_dir, "orders").select("o_orderkey", scalars.quantised(signed, 1_000_000).alias("quantised"), scalars.exact_double(far).alias("exact"))


@query("snapped_coordinates", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN abs(s - v) * u <= 0.0071 THEN s ELSE v END AS snapped FROM (SELECT *, l_extendedprice / 16.0 AS v, round_even(l_extendedprice / 16.0 / 0.01, 0) * 0.01 AS s, 1 + l_linenumber % 3 AS u FROM lineitem)")
def snapped_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates that go to the grid where that moves them little enough in points."""
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 16.0).alias("v"), (1 + F.col("l_linenumber") % 3).alias("u"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", display.snapped("v", F.col("u")).alias("snapped"))


# --- geometry ------------------------------------------------------------------------------------


def _matrix(*values) -> F.Column:
    return F.struct(*[F.lit(v).cast("double").alias(c) if isinstance(v, (int, float)) else v.cast("double").alias(c) for c, v in zip("abcdef", values)])


@query(
    "affine_bounds",
    """
WITH m AS (SELECT p_partkey, p_size AS s, CAST(p_partkey % 7 AS DOUBLE) AS k FROM part),
t AS (SELECT *, 3 * (-(k + 1)) AS c1, 2 * 2 AS b1 FROM m)
SELECT p_partkey, least(-3.0 * (k + 1) * s + 9, 9.0) AS x0, CAST(5 AS DOUBLE) AS y0, greatest(-3.0 * (k + 1) * s + 9, 9.0) AS x1, CAST(4 * s + 5 AS DOUBLE) AS y1,
  round(12 * 3 * (k + 1), 9) AS size, CAST(0 AS DOUBLE) AS turn FROM t
""",
)
def affine_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of p_size by p_size, scaled by (2, 3) and turned by a right angle: bounds, text size and turn."""
    s, k = F.col("p_size"), F.col("p_partkey") % 7
    inner, outer = _matrix(2, 0, 0, 3, 2, 0), _matrix(0, 2, -(k + 1), 0, 9, 1)
    whole = scalars.compose(inner, outer)
    box = scalars.transformed_bounds(scalars.rect(F.lit(0), F.lit(0), s, s), whole)
    found = read_table(spark, sf_dir, "part").select("p_partkey", box.alias("r"), F.round(scalars.effective_size(whole, F.lit(-12.0)), 9).alias("size"), scalars.off_axis_degrees(whole).alias("turn"))
    return found.select("p_partkey", "r.x0", "r.y0", "r.x1", "r.y1", "size", "turn")


@query(
    "rect_relations",
    """
WITH p AS (SELECT p_partkey, 0.0 AS ax0, 0.0 AS ay0, 30.0 AS ax1, 20.0 AS ay1, CAST(p_size AS DOUBLE) AS bx0, CAST(p_partkey % 25 AS DOUBLE) AS by0, p_size + 10.0 AS bx1, p_partkey % 25 + 5.0 AS by1 FROM part),
i AS (SELECT *, greatest(ax0, bx0) AS x0, greatest(ay0, by0) AS y0, least(ax1, bx1) AS x1, least(ay1, by1) AS y1 FROM p)
SELECT p_partkey, CASE WHEN x0 < x1 AND y0 < y1 THEN (x1 - x0) * (y1 - y0) END AS common, (greatest(ax1, bx1) - least(ax0, bx0)) * (greatest(ay1, by1) - least(ay0, by0)) AS hull,
  bx0 >= ax0 AND by0 >= ay0 AND bx1 <= ax1 AND by1 <= ay1 AS inside, round(sqrt(pow(greatest(ax0 - bx1, bx0 - ax1, 0), 2) + pow(greatest(ay0 - by1, by0 - ay1, 0), 2)), 9) AS gap FROM i
""",
)
def rect_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, hull, containment and distance of a fixed rectangle and one that moves."""
    a, b = scalars.rect(F.lit(0), F.lit(0), F.lit(30), F.lit(20)), scalars.rect(F.col("p_size") + 10, F.col("p_partkey") % 25, F.col("p_size"), F.col("p_partkey") % 25 + 5)
    common = scalars.intersection(a, b)
    return read_table(spark, sf_dir, "part").select("p_partkey", F.when(common.isNotNull(), scalars.area(common)).alias("common"), scalars.area(scalars.union_rect(a, b)).alias("hull"), scalars.contains(a, b).alias("inside"), F.round(scalars.gap(a, b), 9).alias("gap"))


@query(
    "polygons_and_colours",
    """
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END * (s_suppkey % 9 + 1) * CAST(4 AS DOUBLE) AS signed, (s_suppkey % 9 + 1) * CAST(4 AS DOUBLE) AS area, s_suppkey % 2 = 0 AS valid,
  CASE WHEN s_suppkey % 10 = 0 THEN FALSE ELSE 0.2126 * (s_suppkey % 10 / 10.0) + 0.7152 * (s_suppkey % 4 / 10.0) + 0.0722 * 0.5 <= 0.18 END AS dark FROM supplier
""",
)
def polygons_and_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads' areas by the order of their corners, and colours that are dark."""
    key = F.col("s_suppkey")
    w = (key % 9 + 1).cast("double")
    point = lambda x, y: F.array(F.lit(x).cast("double") if isinstance(x, int) else x, F.lit(y).cast("double"))
    ahead, back = F.array(point(0, 0), point(w, 0), point(w, 4), point(0, 4)), F.array(point(0, 0), point(0, 4), point(w, 4), point(w, 0))
    quad = F.when(key % 2 == 0, ahead).otherwise(back)
    red = F.when(key % 10 != 0, key % 10 / 10.0)
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", scalars.signed_area(quad).alias("signed"), scalars.polygon_area(quad).alias("area"), scalars.valid_quad(quad).alias("valid"), scalars.is_dark(red, key % 4 / 10.0, F.lit(0.5)).alias("dark"))


#: Rows of a table of few bytes that one task makes images or fonts of.
MADE_PER_TASK = 5000


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and sizes of parts, dealt over all cores."""
    return spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", rows=MADE_PER_TASK)


# --- streams -------------------------------------------------------------------------------------

_RANGES = "SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS a, o_orderdate::DATE::VARCHAR || '|' || o_orderpriority || '|' || o_orderkey::VARCHAR AS t FROM orders"


@query(
    "byte_ranges",
    f"""
WITH o AS ({_RANGES})
SELECT o_orderkey, substr(t, 1, a) || substr(t, greatest(a + 5, 9) + 1) AS removed, CASE WHEN a > 3 THEN NULL ELSE substr(t, 1, 1) || '<x>' || substr(t, 4, 3) || '<yy>' || substr(t, 10) END AS replaced FROM o
""",
)
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping ranges deleted; replacements put in, or refused where they overlap."""
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).alias("a"), F.concat_ws("|", F.to_date("o_orderdate").cast("string"), "o_orderpriority", F.col("o_orderkey").cast("string")).cast("binary").alias("t"))
    span = lambda s, e: F.struct(F.lit(s).cast("long").alias("start") if isinstance(s, int) else s.alias("start"), F.lit(e).cast("long").alias("end") if isinstance(e, int) else e.alias("end"))
    cut = F.array(span(F.greatest(F.col("a") + 1, F.lit(3).cast("long")), F.greatest(F.col("a") + 5, F.lit(9).cast("long"))), span(F.col("a"), F.col("a") + 5))
    cut = F.transform(cut, lambda r: F.struct(F.least(r["start"], r["end"]).alias("start"), r["end"].alias("end")))
    put = lambda s, e, new: F.struct(F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end"), F.lit(new).cast("binary").alias("new"))
    parts = F.when(F.col("a") > 3, F.array(put(6, 9, "<yy>"), put(1, 3, "<x>"), put(2, 4, "!"))).otherwise(F.array(put(6, 9, "<yy>"), put(1, 3, "<x>")))
    return rows.select("o_orderkey", display.without_ranges("t", cut).cast("string").alias("removed"), display.with_replacements("t", parts).cast("string").alias("replaced"))


@query("text_normalize", "SELECT s_suppkey, 'q' || chr(10) || '1 0 0 1 ' || s_suppkey::VARCHAR || ' 5.5 cm' || chr(10) || '/A' || (s_suppkey % 3)::VARCHAR || ' gs' || chr(10) || '(' || s_name || ') Tj' || chr(10) || 'Q' AS content, s_suppkey % 4 <> 0 AS changed FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, 'q  (open', FALSE FROM supplier WHERE s_suppkey % 4 = 0")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content streams with one instruction a line; what can't be read to its end stays."""
    key = F.col("s_suppkey").cast("string")
    stream = F.concat(F.lit("q  1 0\t0 1 "), key, F.lit(" 5.50 cm\r/A"), (F.col("s_suppkey") % 3).cast("string"), F.lit(" gs ("), "s_name", F.lit(") Tj  Q"))
    raw = F.when(F.col("s_suppkey") % 4 == 0, F.lit("q  (open")).otherwise(stream).cast("binary")
    rows = read_table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw"))
    return rows.withColumn("content", display.normalised("raw")).select("s_suppkey", F.col("content").cast("string").alias("content"), (F.col("content") != F.col("raw")).alias("changed"))


@query("stream_filters", "SELECT doc_id, f AS filter, CASE WHEN f = 'DCTDecode' THEN NULL ELSE sha256(coalesce(lang, '') || '/' || source || '/' || doc_id::VARCHAR) END AS digest, CASE WHEN f = 'DCTDecode' THEN 'unsupported filter DCTDecode' END AS error FROM documents, (SELECT unnest(['FlateDecode', 'ASCIIHexDecode', 'ASCII85Decode', 'RunLengthDecode', 'DCTDecode']) AS f) WHERE source IS NOT NULL")
def stream_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams decoded by each generic filter; image filters are told apart."""
    import base64

    from vellum.sources.documents import decode

    def encode(name, body):
        body = bytes(body)
        if name == "FlateDecode":
            return codecs.flate(body)
        if name == "ASCIIHexDecode":
            return body.hex().encode() + b">"
        if name == "ASCII85Decode":
            return base64.a85encode(body) + b"~>"
        if name == "RunLengthDecode":
            return b"".join(bytes([len(body[i : i + 128]) - 1]) + body[i : i + 128] for i in range(0, len(body), 128)) + b"\x80"
        return body

    names = F.array(*[F.lit(x) for x in ("FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "DCTDecode")])
    docs = read_table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).cast("binary").alias("body"), F.explode(names).alias("filter"))
    rows = docs.select("doc_id", "filter", _per_value(encode, "binary")("filter", "body").alias("raw"), F.array("filter").alias("filters"))
    return decode(rows).select("doc_id", "filter", F.sha2("decoded", 256).alias("digest"), F.col("decode_error").alias("error"))


@query("flate_round_trip", "SELECT doc_id, sha256(text) AS digest, TRUE AS smaller FROM documents WHERE text IS NOT NULL AND length(text) > 400")
def flate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compressed and read again; long ones get smaller."""
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL AND length(text) > 400").select("doc_id", F.col("text").cast("binary").alias("body"))
    back = _per_value(lambda b: codecs.inflate(codecs.flate(bytes(b))), "binary")
    return docs.select("doc_id", F.sha2(back("body"), 256).alias("digest"), (codecs.flate_length("body") < F.octet_length("body")).alias("smaller"))


@query("jpeg_metadata", "SELECT p_partkey, CAST(2 + 4 + 3 + 4 + 2 + 6 AS BIGINT) AS plain, CAST(p_size + 4 + 7 AS BIGINT) AS removed FROM part")
def jpeg_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEGs lose their APP1 segment and comment and keep the rest."""
    def made(n):
        part = lambda marker, body: b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body
        return b"\xff\xd8" + part(0xE0, b"abc") + part(0xE1, bytes(n)) + part(0xFE, b"abc") + part(0xDB, b"ab") + b"\xff\xda\0\2\xff\xd9"

    rows = _parts(spark, sf_dir).select("p_partkey", _per_value(lambda n: made(int(n)), "binary")("p_size").alias("raw"))
    plain = codecs.jpeg_without_metadata("raw")
    return rows.select("p_partkey", F.octet_length(plain).cast("long").alias("plain"), (F.octet_length("raw") - F.octet_length(plain)).cast("long").alias("removed"))


@query(
    "character_maps",
    """
SELECT n_nationkey, lower(lpad(to_hex(n_nationkey + i), 2, '0')) AS code, chr(CAST(65 + n_regionkey + i AS INTEGER)) AS text FROM nation, range(4) r(i)
UNION ALL SELECT n_nationkey, 'fe', 'fi' FROM nation
""",
)
def character_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of ToUnicode maps with a range and a ligature."""
    key = lambda n: F.lower(F.lpad(F.hex("n_nationkey") if n == 0 else F.hex(F.col("n_nationkey") + n), 2, "0"))
    body = F.concat(F.lit("1 begincmap 1 beginbfrange <"), key(0), F.lit("> <"), key(3), F.lit("> <"), F.lpad(F.hex(65 + F.col("n_regionkey")), 4, "0"), F.lit("> endbfrange 1 beginbfchar <fe> <00660069> endbfchar endcmap"))
    found = _per_value(lambda b: [{"code": k.hex(), "text": v} for k, v in codecs.parse_to_unicode(bytes(b)).items()], "array<struct<code:string,text:string>>")
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.explode(found(body.cast("binary"))).alias("x")).select("n_nationkey", "x.code", "x.text")


@query("glyph_widths", "SELECT n_nationkey, CAST(n_nationkey + i AS BIGINT) AS cid, CAST(CASE WHEN i < 2 THEN 500 + i ELSE 250 END AS DOUBLE) AS width FROM nation, range(5) r(i)")
def glyph_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths by glyph from a list and a run."""
    found = _per_value(lambda n: [{"cid": k, "width": w} for k, w in codecs.parse_cid_widths([n, [500, 501], n + 2, n + 4, 250, 9]).items()], "array<struct<cid:long,width:double>>")
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.explode(found("n_nationkey")).alias("x")).select("n_nationkey", "x.cid", "x.width")


# --- pixels and fonts ----------------------------------------------------------------------------


@query(
    "bilevel_images",
    """
WITH p AS (SELECT p_partkey, 5 + p_size % 11 AS w, 3 + p_partkey % 5 AS h FROM part)
SELECT p_partkey, CAST(h * ((w + 7) // 8) AS BIGINT) AS bytes, CAST((SELECT COUNT(*) FROM range(16) x(x), range(8) y(y) WHERE x < w AND y < h AND (x * 3 + y + p_partkey) % 4 = 0) AS BIGINT) AS white, TRUE AS same, CAST(h * ((w + 7) // 8) + 40 AS BIGINT) AS cost FROM p
""",
)
def bilevel_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black and white images packed eight pixels a byte and read again, with what their codec costs."""
    def one(key, w, h):
        x, y = np.meshgrid(np.arange(w), np.arange(h))
        gray = np.where((x * 3 + y + key) % 4 == 0, 255, 0).astype(np.uint8).tobytes()
        packed = raster.pack_bilevel(gray, int(w), int(h))
        return {"bytes": len(packed), "white": int(np.unpackbits(np.frombuffer(packed, np.uint8)).sum()), "same": raster.unpack_bilevel(packed, int(w), int(h)) == gray, "cost": raster.bilevel_cost(len(packed), True, 40)}

    made = pandas_udf(lambda a, b, c: pd.DataFrame([one(*r) for r in zip(a, b, c)]), "bytes long, white long, same boolean, cost long", PandasUDFType.SCALAR)
    rows = _parts(spark, sf_dir).select("p_partkey", made("p_partkey", 5 + F.col("p_size") % 11, 3 + F.col("p_partkey") % 5).alias("r"))
    return rows.select("p_partkey", "r.*")


@query(
    "image_crops",
    """
SELECT p_partkey, CAST(p_size % 4 AS BIGINT) AS x, CAST(p_partkey % 3 AS BIGINT) AS y, CAST(2 + p_size % 5 AS BIGINT) AS w, CAST(1 + p_partkey % 4 AS BIGINT) AS h, lower(lpad(to_hex(100 + p_partkey % 50), 2, '0')) AS border, 240 - p_partkey % 9 AS paper FROM part
""",
)
def image_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mask and a plain background leave of an image, the border's sample and the paper's colour."""
    def one(key, size):
        x, y, w, h = size % 4, key % 3, 2 + size % 5, 1 + key % 4
        alpha, gray = np.zeros((12, 14), np.uint8), np.full((12, 14, 1), 100 + key % 50, np.uint8)
        alpha[y : y + h, x : x + w] = 1 + key % 255
        gray[1 + y : 1 + y + h, 1 + x : 1 + x + w] = 7
        gray[0, 0] = 3
        border = raster.border_sample(gray.tobytes(), 14, 12, 1)
        inner = gray.copy()
        inner[0, 0] = border[0]
        a, b = raster.alpha_crop(alpha.tobytes(), 14, 12), raster.background_crop(inner.tobytes(), 14, 12, 1, border, 4)
        assert b == (a[0] + 1, a[1] + 1, *a[2:])
        paper = np.full((200, 3), 240 - key % 9, np.uint8)
        paper[:25] = 0
        return {"x": a[0], "y": a[1], "w": a[2], "h": a[3], "border": border.hex(), "paper": raster.paper_background(paper.tobytes(), 200)[0]}

    made = pandas_udf(lambda a, b: pd.DataFrame([one(int(k), int(s)) for k, s in zip(a, b)]), "x long, y long, w long, h long, border string, paper long", PandasUDFType.SCALAR)
    return _parts(spark, sf_dir).select("p_partkey", made("p_partkey", "p_size").alias("r")).select("p_partkey", "r.*")


@query("palettes", "SELECT s_suppkey, CAST(least(1 + s_suppkey % 6, 4) AS BIGINT) AS colours, s_suppkey % 6 <= 3 AS exact FROM supplier WHERE s_suppkey % 6 <= 3")
def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of few colours go to a palette without loss."""
    def one(key):
        pixels = np.array([(40 * (i % (1 + key % 6)), 7, 200 - 30 * (i % (1 + key % 6))) for i in range(60)], np.uint8)
        found = raster.quantise(pixels.tobytes(), 4, 0.5)
        back = np.frombuffer(found[0], np.uint8).reshape(-1, 3)[np.frombuffer(found[1], np.uint8)]
        return {"colours": len(found[0]) // 3, "exact": bool((back == pixels).all()) and found[2] == 0}

    made = pandas_udf(lambda a: pd.DataFrame([one(int(k)) for k in a]), "colours long, exact boolean", PandasUDFType.SCALAR)
    return read_table(spark, sf_dir, "supplier").where("s_suppkey % 6 <= 3").select("s_suppkey", made("s_suppkey").alias("r")).select("s_suppkey", "r.*")


def _font(key: int, size: int) -> bytes:
    """A font program whose outlines follow the key, and whose other tables follow its remainder."""
    found = {t: t.encode() + bytes([key % 5]) for t in ("cmap", "hhea", "hmtx", "maxp")} | {"head": bytes(54), "glyf": struct.pack(">q", key), "loca": bytes(4)}
    return fonts.build(found | ({"GPOS": bytes(size), "kern": bytes(4)} if key % 2 else {}))


@query(
    "font_programs",
    """
WITH f AS (SELECT p_partkey, p_partkey % 2 = 1 AS extra, p_size, p_partkey % 5 AS kind FROM part)
SELECT p_partkey, CAST(CASE WHEN extra THEN 2 * 16 + (p_size + 3) // 4 * 4 + 4 ELSE 0 END AS BIGINT) AS unused, CAST(16 + 8 AS BIGINT) AS cmap,
  CAST(COUNT(*) OVER (PARTITION BY kind, extra, CASE WHEN extra THEN p_size END) AS BIGINT) AS skeletons FROM f
""",
)
def font_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a font's unused tables and of its character map, and fonts equal but for their outlines."""
    def one(key, size):
        data = _font(key, size)
        bare, cmap = fonts.strip_unused(data), fonts.strip_cmap(data)
        return {"unused": bare[1] if bare else 0, "cmap": cmap[1], "skeleton": fonts.skeleton_hash(data)}

    made = pandas_udf(lambda a, b: pd.DataFrame([one(int(k), int(s)) for k, s in zip(a, b)]), "unused long, cmap long, skeleton string", PandasUDFType.SCALAR)
    rows = checkpoint(_parts(spark, sf_dir).select("p_partkey", made("p_partkey", "p_size").alias("r")).select("p_partkey", "r.*"))  # read twice
    same = rows.groupBy("skeleton").agg(F.count("*").alias("skeletons"))
    return rows.join(same, "skeleton").select("p_partkey", "unused", "cmap", "skeletons")


# --- policies ------------------------------------------------------------------------------------


def _dictionary(key, entries: dict[str, int]):
    """A map with each name whose divisor divides the key."""
    parts = [F.when(key % d == 0, F.lit(name)) for name, d in entries.items()]
    names = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.map_from_arrays(names, F.transform(names, lambda _: F.lit("v")))


_DIVIDES = lambda names: " + ".join(f"CASE WHEN doc_id % {d} = 0 THEN 1 ELSE 0 END" for d in names)


@query(
    "allow_list_projection",
    f"""
SELECT doc_id, 'page' AS holder, 'functional' AS preset, CAST(1 + {_DIVIDES((2, 5, 7))} AS BIGINT) AS kept FROM documents UNION ALL
SELECT doc_id, 'page', 'known-functional', CAST(1 + {_DIVIDES((5,))} AS BIGINT) FROM documents UNION ALL SELECT doc_id, 'page', 'visible-surface', 1 FROM documents UNION ALL
SELECT doc_id, 'tree', 'functional', CAST(1 + {_DIVIDES((2, 5))} AS BIGINT) FROM documents UNION ALL SELECT doc_id, 'tree', 'known-functional', CAST(1 + {_DIVIDES((2,))} AS BIGINT) FROM documents UNION ALL
SELECT doc_id, 'tree', 'visible-surface', CAST(1 + {_DIVIDES((2,))} AS BIGINT) FROM documents UNION ALL
SELECT doc_id, 'catalog', 'functional', CAST(1 + {_DIVIDES((2, 3, 7))} AS BIGINT) FROM documents UNION ALL SELECT doc_id, 'catalog', 'known-functional', CAST(1 + {_DIVIDES((2, 7))} AS BIGINT) FROM documents UNION ALL
SELECT doc_id, 'catalog', 'visible-surface', CAST(1 + {_DIVIDES((7,))} AS BIGINT) FROM documents
""",
)
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages, tree nodes and catalogues keep of their keys under each preset."""
    docs, key, out = read_table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), None
    holders = {
        "page": (policy.PAGE_KEYS, {"Type": 1, "Metadata": 2, "Thumb": 3, "Tabs": 5, "Odd": 7, "PieceInfo": 4}),
        "tree": (policy.PAGE_TREE_KEYS, {"Type": 1, "Kids": 2, "Thumb": 3, "Odd": 5}),
        "catalog": (policy.CATALOG_KEYS, {"Type": 1, "AcroForm": 2, "Metadata": 3, "PieceInfo": 5, "OCProperties": 7}),
    }
    for holder, (table, entries) in holders.items():
        for preset, on in policy.PRESETS.items():
            kept = policy.project_dictionary(docs.withColumn("keys", _dictionary(key, entries)), "keys", table, on)
            part = kept.select("doc_id", F.lit(holder).alias("holder"), F.lit(preset).alias("preset"), F.size("keys").cast("long").alias("kept"))
            out = part if out is None else out.union(part)
    return out


@query(
    "annotation_filter",
    """
WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Link' WHEN 1 THEN 'Widget' WHEN 2 THEN 'Text' END AS subtype, CASE WHEN doc_id % 5 = 0 THEN TRUE WHEN doc_id % 5 = 1 THEN NULL ELSE FALSE END AS protected FROM documents)
SELECT doc_id, coalesce(protected, FALSE) OR coalesce(subtype <> 'Link', TRUE) AS without_links, coalesce(protected, FALSE) AS only_protected, CAST(2 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS shell FROM a
""",
)
def annotation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that stay when links are switched off, or others too, and what links show as bare shells."""
    key = F.col("doc_id")
    subtype = F.when(key % 4 == 0, "Link").when(key % 4 == 1, "Widget").when(key % 4 == 2, "Text")
    protected = F.when(key % 5 == 0, True).when(key % 5 != 1, False)
    shell = policy.link_shell(_dictionary(key, {"Subtype": 1, "Rect": 1, "Border": 2, "C": 3, "A": 1, "Dest": 5}))
    on = set(policy.SWITCHES)
    return read_table(spark, sf_dir, "documents").select("doc_id", policy.keeps_annotation(subtype, protected, on - {"links"}, True).alias("without_links"), policy.keeps_annotation(subtype, protected, on, False).alias("only_protected"), F.size(shell).cast("long").alias("shell"))


@query(
    "privacy_scrub",
    """
WITH e AS (SELECT doc_id, unnest(['Info', 'Metadata', 'Thumb', 'V', 'Keep', 'AA']) AS key FROM documents),
r AS (SELECT * FROM (VALUES ('Info', 'info-dictionary', 1), ('Metadata', 'xmp-reference', 1), ('Thumb', 'thumbnail', 2), ('AA', 'additional-actions', 2), ('V', 'form-value', 2)) AS t(key, label, level))
SELECT l.level, label, CAST(COUNT(*) AS BIGINT) AS removed FROM e JOIN r USING (key), (SELECT unnest([1, 2]) AS level) l WHERE r.level <= l.level AND (label <> 'form-value' OR doc_id % 3 = 0) GROUP BY 1, 2
""",
)
def privacy_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each level of scrubbing takes from dictionaries, field values only from fields."""
    keys = F.explode(F.array(*[F.lit(k) for k in ("Info", "Metadata", "Thumb", "V", "Keep", "AA")])).alias("key")
    entries = read_table(spark, sf_dir, "documents").select("doc_id", keys, (F.col("doc_id") % 3 == 0).alias("is_field"))
    one, two = (policy.scrub(entries, level, ("form_values", "active_content"))[1].select(F.lit(level).alias("level"), "label", "removed") for level in (1, 2))
    return one.union(two)


@query(
    "physical_prune",
    """
SELECT doc_id, m AS mechanism, c AS category, a AS action, c NOT IN ('ocr-overlay', 'accessibility') AND (m = 'zero-opacity' OR (m LIKE 'covered-by-%' AND a = 'remove')) AS prunes
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'zero-opacity' WHEN 1 THEN 'covered-by-image' WHEN 2 THEN 'covered-by-opaque-fill' ELSE 'clipped-out' END AS m,
  CASE doc_id % 3 WHEN 0 THEN 'ocr-overlay' WHEN 1 THEN 'likely-redaction-leak' ELSE 'other-invisible' END AS c, CASE WHEN doc_id % 5 < 3 THEN 'remove' ELSE 'keep' END AS a FROM documents)
""",
)
def physical_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden texts that may go without any policy."""
    key = F.col("doc_id")
    mechanism = F.when(key % 4 == 0, "zero-opacity").when(key % 4 == 1, "covered-by-image").when(key % 4 == 2, "covered-by-opaque-fill").otherwise("clipped-out")
    category = F.when(key % 3 == 0, "ocr-overlay").when(key % 3 == 1, "likely-redaction-leak").otherwise("other-invisible")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", mechanism.alias("mechanism"), category.alias("category"), F.when(key % 5 < 3, "remove").otherwise("keep").alias("action"))
    return rows.withColumn("prunes", classify.prunes_physically(F.col("category"), F.col("mechanism"), F.col("action")))


@query(
    "hidden_mechanisms",
    """
WITH t AS (SELECT doc_id, doc_id % 10 AS k, doc_id % 3 = 0 AS actual, doc_id % 4 < 2 AS dark, doc_id % 7 / 10.0 AS share FROM documents),
m AS (SELECT *, CASE k WHEN 0 THEN 'rendering-mode-invisible' WHEN 1 THEN 'clip-only-rendering-mode' WHEN 2 THEN 'zero-opacity' WHEN 3 THEN 'optional-content-hidden' WHEN 4 THEN 'degenerate-transform'
  WHEN 5 THEN 'outside-crop-box' WHEN 6 THEN 'clipped-out' WHEN 7 THEN 'covered-by-image' WHEN 8 THEN 'covered-by-opaque-fill' END AS mechanism FROM t)
SELECT mechanism, CASE WHEN actual THEN 'accessibility' WHEN k = 3 THEN 'hidden-layer' WHEN k = 5 THEN 'outside-page' WHEN k IN (0, 2, 7) AND share >= 0.3 THEN 'ocr-overlay' WHEN k = 8 AND dark AND share <= 0.4 THEN 'likely-redaction-leak' ELSE 'other-invisible' END AS category,
  CASE WHEN NOT actual AND k = 8 AND dark AND share <= 0.4 THEN 'remove' ELSE 'keep' END AS action, COUNT(*) AS texts FROM m WHERE mechanism IS NOT NULL GROUP BY 1, 2, 3
""",
)
def hidden_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mechanisms that hide a text, their categories and what is suggested."""
    k, share = F.col("doc_id") % 10, F.col("doc_id") % 7 / 10.0
    box = F.when(k != 4, scalars.rect(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))
    mechanism = classify.hidden_mechanism(F.when(k == 0, 3).when(k == 1, 7).otherwise(0), F.when(k == 2, 0.0).otherwise(1.0), k == 3, box, k != 5, k != 6, F.when(k == 7, "image").when(k == 8, "fill"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", share.alias("share"), mechanism.alias("mechanism"))
    found = classify.hidden_category(F.col("mechanism"), F.when(F.col("doc_id") % 3 == 0, "x"), F.lit(True), F.when(F.col("share") >= 0.3, 3).otherwise(2), F.col("doc_id") % 4 < 2, F.col("share"))
    return rows.where("mechanism IS NOT NULL").withColumn("c", found).groupBy("mechanism", "c.category", "c.action").agg(F.count("*").alias("texts"))


@query(
    "dangerous_actions",
    """
WITH RECURSIVE a AS (SELECT o_orderkey AS node, CASE o_orderkey % 11 WHEN 0 THEN 'JavaScript' WHEN 5 THEN 'Launch' ELSE 'GoTo' END AS kind, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - o_orderkey % 4 + (o_orderkey + 1) % 4 END AS next FROM orders),
w AS (SELECT node, next, kind, 0 AS d FROM a UNION ALL SELECT w.node, a.next, a.kind, d + 1 FROM w JOIN a ON a.node = w.next WHERE d < 5)
SELECT DISTINCT node FROM w WHERE kind IN ('JavaScript', 'Launch')
""",
)
def dangerous_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions whose chain of next ones holds a dangerous one."""
    key = F.col("o_orderkey")
    kind = F.when(key % 11 == 0, "JavaScript").when(key % 11 == 5, "Launch").otherwise("GoTo")
    actions = read_table(spark, sf_dir, "orders").select(key.alias("node"), kind.alias("kind"), F.when(key % 4 != 0, key - key % 4 + (key + 1) % 4).alias("next"))
    chain = actions.where("next IS NOT NULL").select(F.col("node").alias("src"), F.col("next").alias("dst"))
    return dangerous_chains(actions, chain.join(actions.select(F.col("node").alias("dst")), "dst"), list(policy.DANGEROUS_ACTIONS))


# --- runs, claims and groups ---------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Lines of orders, an order's in one task, whose share stays the same as the table grows."""
    return spread(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *more), "l_orderkey")


@query(
    "adjacent_cover",
    """
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS c, CAST(l_quantity AS DOUBLE) AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
x AS (SELECT *, lag(c) OVER o AS pc, lag(w) OVER o AS pw, lead(c) OVER o AS nc, lead(w) OVER o AS nw FROM f WINDOW o AS (PARTITION BY l_orderkey ORDER BY n))
SELECT l_orderkey, COUNT(*) AS covered FROM x WHERE (pc = c AND pw >= w) OR nw >= w GROUP BY 1
""",
)
def adjacent_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills that the next one covers, or the one before in their colour."""
    rows = _lines(spark, sf_dir, "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("colour"), scalars.rect(F.lit(0), F.lit(0), F.col("l_quantity"), F.lit(1)).alias("rect"))
    return runs.adjacent_cover(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).groupBy("l_orderkey").agg(F.count("*").alias("covered"))


@query(
    "merged_rectangles",
    """
WITH r AS (SELECT l_orderkey, l_returnflag AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey, c ORDER BY n) AS island FROM r)
SELECT l_orderkey, CAST(min(n) * 10 AS DOUBLE) AS x0, CAST(max(n) * 10 + 10 AS DOUBLE) AS x1, COUNT(*) AS members FROM g GROUP BY l_orderkey, c, island
""",
)
def merged_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching neighbours of one colour as one rectangle."""
    lines = runs.ordinal(_lines(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "n")
    x = (F.col("n") + 1).cast("double") * 10
    rects = lines.select("l_orderkey", "n", F.col("l_returnflag").alias("colour"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 10).alias("x1"), F.lit(5.0).alias("y1"))
    return display.merged_rects(rects, ["l_orderkey"], ["n"]).select("l_orderkey", "x0", "x1", "members")


@query(
    "paint_runs",
    """
WITH p AS (SELECT l_orderkey, l_returnflag AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey, k ORDER BY n) AS island FROM p), c AS (SELECT l_orderkey, (COUNT(*) + 1) // 2 AS batches FROM g GROUP BY l_orderkey, k, island)
SELECT l_orderkey, CAST(SUM(batches) AS BIGINT) AS batches FROM c GROUP BY 1
""",
)
def paint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paints of one kind in batches of two; equal windings may overlap."""
    lines = runs.ordinal(_lines(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "n")
    paints = lines.select("l_orderkey", "n", F.col("l_returnflag").alias("kind"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(9.0).alias("y1"), F.lit(1).alias("winding"))
    return display.paint_runs(paints, ["l_orderkey"], ["n"], 2).groupBy("l_orderkey").agg((F.max("batch") + 1).alias("batches"))


@query("point_lines", "SELECT s_suppkey, CAST(3 AS BIGINT) AS corners, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 4 END AS BIGINT) AS kept FROM supplier")
def point_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines without the points on their straight parts, and without those that deviate little."""
    key = F.col("s_suppkey")
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), (F.lit(y) if isinstance(y, (int, float)) else y).cast("double").alias("y"))
    straight = F.array(point(0, 0), point(1, 0), point(2, 0), point(2, key), point(2, key + 1))
    bent = F.array(point(0, 0), point(1, F.when(key % 2 == 0, 0.004).otherwise(0.5)), point(2, 0), point(3, 50))
    return read_table(spark, sf_dir, "supplier").select("s_suppkey", F.size(display.without_collinear(straight)).cast("long").alias("corners"), F.size(display.simplified(bent)).cast("long").alias("kept"))


@query(
    "stripe_runs",
    """
WITH d AS (SELECT l_orderkey, l_returnflag AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey, s ORDER BY n) AS island FROM d)
SELECT l_orderkey, CAST(min(n) - 1 AS BIGINT) AS first, COUNT(*) AS members FROM g GROUP BY l_orderkey, s, island HAVING COUNT(*) >= 3
""",
)
def stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring draws of one state that stand one upon the other."""
    lines = runs.ordinal(_lines(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "n")
    draws = lines.select("l_orderkey", "n", F.col("l_returnflag").alias("state"), F.lit(40).alias("width"), F.lit(8).alias("height"), F.lit(0.0).alias("x"), (F.col("n") * 8.4).alias("y"))
    return display.stripe_runs(draws, ["l_orderkey"], ["n"]).select("l_orderkey", F.col("first").cast("long").alias("first"), "members")


@query(
    "exclusive_claims",
    """
WITH p AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_orderkey AS plan FROM p WHERE k = 1
""",
)
def exclusive_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of orders that claim the same customer the dearest stands."""
    orders = read_table(spark, sf_dir, "orders")
    return display.claim(orders.select(F.col("o_orderkey").alias("plan"), F.col("o_totalprice").alias("priority")), orders.select(F.col("o_orderkey").alias("plan"), F.col("o_custkey").alias("member")))


@query(
    "objects_in_place",
    """
WITH n AS (SELECT user_id, COUNT(DISTINCT event_type) AS kinds FROM events GROUP BY 1), t AS (SELECT COUNT(DISTINCT event_type) AS whole, MIN(event_type) AS low FROM events),
f AS (SELECT user_id, COUNT(DISTINCT event_type) AS kinds, MIN(event_type) AS first FROM events GROUP BY 1)
SELECT user_id, CASE WHEN kinds = whole THEN 'all' ELSE 'after-first' END AS mode, CAST(kinds AS BIGINT) AS pages FROM f, t WHERE kinds = whole OR (kinds = whole - 1 AND first <> low AND kinds >= 3)
""",
)
def objects_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as objects and kinds of events as pages: those that stay on all pages, or all but the first."""
    once = read_table(spark, sf_dir, "events").where("event_type IS NOT NULL").groupBy("user_id", "event_type").agg(F.min("event_id").alias("item"))
    kinds = once.select("event_type").distinct().orderBy("event_type").agg(F.array_sort(F.collect_list("event_type")).alias("kinds"))  # a handful
    whole = len(kinds.first()[0])
    page = F.array_position(F.array(*[F.lit(k) for k in kinds.first()[0]]), F.col("event_type")) - 1
    objects = once.select("user_id", page.cast("int").alias("page"), "item", F.lit(5.0).alias("x"), (page * 2.0).alias("y"))
    found = display.persistent_groups(objects, whole, key="user_id", most=12.0)
    return found.groupBy(F.col("key").alias("user_id"), "mode").agg(F.count("*").alias("pages"))


@query(
    "quad_mismatches",
    "SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0 OR (c_custkey % 4 = 0 AND c_custkey % 9 <> 0) ",
)
def quad_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences that aren't where a catalogue has them, or are missing from it."""
    key = F.col("c_custkey")
    quads = read_table(spark, sf_dir, "customer").select("c_custkey", F.array(*[(key + i).cast("double") for i in range(8)]).alias("quad"))
    moved = quads.where(key % 9 != 0).withColumn("quad", F.transform("quad", lambda v, i: v + F.when((i == 3) & (key % 4 == 0), 0.05).otherwise(0.02)))
    return display.mismatched_quads(quads, moved, ["c_custkey"])


# --- pages ---------------------------------------------------------------------------------------


@query(
    "union_coverage",
    """
WITH b AS (SELECT doc_id // 100 AS page, least(612, doc_id * 37 % 500) AS x0, least(792, doc_id * 91 % 700) AS y0, least(612, doc_id * 37 % 500 + 150 + doc_id % 200) AS x1, least(792, doc_id * 91 % 700 + 150 + doc_id % 300) AS y1 FROM documents WHERE doc_id % 3 = 0),
xs AS (SELECT page, x AS a, lead(x) OVER (PARTITION BY page ORDER BY x) AS b FROM (SELECT page, x0 AS x FROM b UNION SELECT page, x1 FROM b)),
ys AS (SELECT page, y AS a, lead(y) OVER (PARTITION BY page ORDER BY y) AS b FROM (SELECT page, y0 AS y FROM b UNION SELECT page, y1 FROM b)),
c AS (SELECT DISTINCT xs.page, xs.a AS xa, xs.b AS xb, ys.a AS ya, ys.b AS yb FROM b JOIN xs ON xs.page = b.page AND xs.a >= b.x0 AND xs.b <= b.x1 JOIN ys ON ys.page = b.page AND ys.a >= b.y0 AND ys.b <= b.y1)
SELECT page, round(SUM((xb - xa) * (yb - ya)) / (612.0 * 792), 9) AS coverage FROM c GROUP BY page
""",
)
def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each page that its large rectangles hold together."""
    from vellum.plans.spatial import _boxes

    rows = _boxes(spark, sf_dir, True).withColumn("target", scalars.rect(F.lit(0), F.lit(0), F.lit(612), F.lit(792)))
    return spatial.union_coverage(rows, ["page"], "rect", "target").withColumn("coverage", F.round("coverage", 9))


@query("occluded_paints", "SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 0")
def occluded_paints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paints under two later halves; a gap, a transparent half or an earlier one leaves them visible."""
    key = F.col("doc_id")
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    half = lambda name, o, low, high, opaque: F.struct(F.lit(name).alias("name"), o.alias("ord"), scalars.rect(F.lit(0), low, F.lit(10), high).alias("rect"), opaque.alias("opaque"))
    paints = F.array(
        half("target", F.lit(1), F.lit(0), F.lit(10), F.lit(False)),
        half("low", F.when(key % 5 == 1, 0).otherwise(2), F.lit(0), F.when(key % 5 == 2, 4.9).otherwise(5.0), key % 5 != 3),
        half("high", F.lit(3), F.when(key % 5 == 4, 5.1).otherwise(5.0), F.lit(12), F.lit(True)),
    )
    rows = docs.select("doc_id", F.explode(paints).alias("p")).select("doc_id", F.col("p.name").alias("id"), F.col("p.ord").alias("ord"), F.col("p.rect").alias("rect"), F.col("p.opaque").alias("opaque"))
    return spatial.occluded(rows, ["doc_id"]).where("id = 'target'").select(F.col("doc_id").alias("id"))


@query(
    "recognised_lines",
    """
SELECT doc_id, l AS line, CASE l WHEN 1 THEN 'accepted' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'blank' WHEN 4 THEN 'unreviewed' WHEN 5 THEN CASE WHEN doc_id % 2 = 0 THEN 'low-confidence' ELSE 'native-overlap' END ELSE 'accepted' END AS status FROM documents, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS l) WHERE doc_id % 4 < 3
""",
)
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines of a page, the surest first, against words that it has and lines taken before."""
    quad = lambda x, y, w: F.array(*[F.lit(float(v)) for v in (x, y, x + w, y, x + w, y + 5, x, y + 5)])
    line = lambda n, text, sure, seen, q: F.struct(F.lit(n).alias("line"), F.lit(text).alias("text"), (sure if not isinstance(sure, float) else F.lit(sure)).alias("confidence"), F.lit(seen).alias("reviewed"), q.alias("quad"))
    odd = F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.99)
    lines = F.array(line(1, "a", 0.99, True, quad(0, 0, 20)), line(2, "a", 0.98, True, quad(3, 0, 20)), line(3, " ", 0.99, True, quad(0, 50, 9)), line(4, "b", 0.99, False, quad(0, 60, 9)), line(5, "c", odd, True, quad(0, 70, 9)), line(6, "d", 0.971, True, quad(0, 80, 9)))
    docs = read_table(spark, sf_dir, "documents").where("doc_id % 4 < 3").select("doc_id")
    words = docs.select("doc_id", quad(5, 71, 2).alias("quad"))
    return spatial.select_lines(docs.select("doc_id", F.explode(lines).alias("l")).select("doc_id", "l.*"), words, "doc_id")


@query("upper_medians", "SELECT l_orderkey, v[len(v) // 2 + 1] AS median FROM (SELECT l_orderkey, list_sort(list(l_quantity)) AS v FROM lineitem WHERE l_quantity > 1e-7 GROUP BY 1)")
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of each order's quantities."""
    return read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(aggregate.upper_median("l_quantity").alias("median"))
