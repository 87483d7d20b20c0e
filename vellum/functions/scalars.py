"""Column expressions: digests, text decoding, geometry, buckets, gates and lexical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- digests and text -------------------------------------------------------------------------


def sha256_hex(payload: Column | str) -> Column:
    """Lower-case hexadecimal SHA-256 of bytes or of a string's UTF-8."""
    return F.sha2(_c(payload).cast("binary"), 256)


def hex_lower(payload: Column | str) -> Column:
    return F.lower(F.hex(_c(payload)))


def decode_text_string(raw: Column | str) -> Column:
    """A text string's characters: UTF-16 by its byte order mark, else UTF-8 with replacement.

    FE FF is big-endian (an odd last byte is left out), FF FE is little-endian if the length is even.
    """
    raw = _c(raw)
    size, mark = F.octet_length(raw), F.hex(F.substring(raw, 1, 2))
    even = F.substring(raw, F.lit(3), (F.floor((size - 2) / 2) * 2).cast("int"))
    wide = F.when(mark == "FEFF", F.decode(even, "UTF-16BE"))
    wide = wide.when((mark == "FFFE") & (size % 2 == 0), F.decode(even, "UTF-16LE"))
    return wide.otherwise(F.make_valid_utf8(raw.cast("string")))


def utf16be_hex(text: Column | str) -> Column:
    """Upper-case hexadecimal UTF-16BE with its byte order mark, as written for actual text."""
    return F.concat(F.lit("FEFF"), F.hex(F.encode(_c(text), "UTF-16BE")))


def overlapping_count(text: Column | str, needle: str) -> Column:
    """How often a needle starts in a text, overlaps counted."""
    quoted = "".join("\\" + x if not x.isalnum() else x for x in needle)
    return F.regexp_count(_c(text), F.lit(f"(?={quoted})"))


# --- buckets, quantities and gates ------------------------------------------------------------


def log2_bucket(n: Column | str) -> Column:
    """floor(log2(n)) without floating point; zero for n below 1."""
    n = _c(n).cast("long")
    return F.when(n >= 1, F.length(F.bin(n)) - 1).otherwise(0).cast("int")


def ratio_decile(part: Column | str, whole: Column | str) -> Column:
    """Tenths by integer division, 0 to 10; zero of nothing is zero."""
    part, whole = _c(part).cast("long"), _c(whole).cast("long")
    tenth = (part * 10 - F.pmod(part * 10, whole)) / whole
    return F.when(whole > 0, F.least(F.lit(10.0), F.greatest(F.lit(0.0), tenth))).otherwise(0).cast("int")


def entropy_half_bits(entropy: Column | str) -> Column:
    """Entropy in half bits, rounded away from zero at a half, 0 to 16."""
    return F.least(F.lit(16), F.greatest(F.lit(0), F.round(_c(entropy) * 2, 0))).cast("int")


def quantised(value: Column | str, scale: float) -> Column:
    """value * scale rounded half away from zero and held within 32 bits."""
    x = F.round(_c(value) * scale, 0)
    return F.least(F.lit(2147483647.0), F.greatest(F.lit(-2147483648.0), x)).cast("int")


def signed_delta(before: Column | str, after: Column | str) -> Column:
    return _c(before).cast("long") - _c(after).cast("long")


def savings_percent(saved: Column | str, before: Column | str) -> Column:
    """100 * saved / before; zero where there was nothing."""
    before = _c(before)
    return F.when(before == 0, F.lit(0.0)).otherwise(_c(saved) * 100.0 / before)


def passes_savings(before: Column | str, after: Column | str, least_bytes: int, least_percent: int) -> Column:
    """Integer gate: smaller, by least_bytes at least and by least_percent at least."""
    before, after = _c(before).cast("long"), _c(after).cast("long")
    saved = before - after
    return (after < before) & (saved >= least_bytes) & (saved * 100 >= before * least_percent)


def large_enough(width: Column | str, height: Column | str, least_width: int = 128, least_height: int = 128, least_area: int = 16384) -> Column:
    """Strictly above each least; the area wraps at 32 bits as unsigned products do."""
    width, height = _c(width).cast("long"), _c(height).cast("long")
    area = (width * height).bitwiseAND(F.lit(0xFFFFFFFF))
    return (width > least_width) & (height > least_height) & (area > least_area)


def exact_double(value: Column | str) -> Column:
    """A long as a double if that loses nothing, else null."""
    value = _c(value).cast("long")
    return F.when(value.cast("double").cast("long") == value, value.cast("double"))


# --- geometry: rectangles are structs x0, y0, x1, y1; matrices a, b, c, d, e, f -----------------


def rect(x0, y0, x1, y1) -> Column:
    """A rectangle of two corners in any order."""
    x0, y0, x1, y1 = (_c(v).cast("double") for v in (x0, y0, x1, y1))
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle, null where there is none of positive extent."""
    x0, y0 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"])
    x1, y1 = F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 < x1) & (y0 < y1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def union_rect(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def intersects(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def contains(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    return (a["x0"] <= b["x0"] + epsilon) & (a["y0"] <= b["y0"] + epsilon) & (a["x1"] >= b["x1"] - epsilon) & (a["y1"] >= b["y1"] - epsilon)


def coverage(cover: Column, target: Column) -> Column:
    """The share of the target's area that the cover holds; zero for an empty target."""
    w = F.least(cover["x1"], target["x1"]) - F.greatest(cover["x0"], target["x0"])
    h = F.least(cover["y1"], target["y1"]) - F.greatest(cover["y0"], target["y0"])
    whole = area(target)
    return F.when(whole > 0, F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / whole).otherwise(0.0)


def gap(a: Column, b: Column) -> Column:
    """The Euclidean distance of two rectangles, zero where they touch."""
    dx = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0.0))
    dy = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0.0))
    return F.hypot(dx, dy)


def compose(inner: Column, outer: Column) -> Column:
    """The matrix that applies `inner` first."""
    i, o = inner, outer
    return F.struct(
        (i["a"] * o["a"] + i["b"] * o["c"]).alias("a"),
        (i["a"] * o["b"] + i["b"] * o["d"]).alias("b"),
        (i["c"] * o["a"] + i["d"] * o["c"]).alias("c"),
        (i["c"] * o["b"] + i["d"] * o["d"]).alias("d"),
        (i["e"] * o["a"] + i["f"] * o["c"] + o["e"]).alias("e"),
        (i["e"] * o["b"] + i["f"] * o["d"] + o["f"]).alias("f"),
    )


def transform_x(m: Column, x: Column, y: Column) -> Column:
    return m["a"] * x + m["c"] * y + m["e"]


def transform_y(m: Column, x: Column, y: Column) -> Column:
    return m["b"] * x + m["d"] * y + m["f"]


def transformed_bounds(r: Column, m: Column) -> Column:
    """The axis-parallel bounds of a rectangle's image."""
    corners = [(r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [transform_x(m, x, y) for x, y in corners], [transform_y(m, x, y) for x, y in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def effective_size(m: Column, font_size: Column | str) -> Column:
    """A font's height on the page."""
    return F.abs(_c(font_size)) * F.hypot(m["c"], m["d"])


def off_axis_degrees(m: Column) -> Column:
    """How far a baseline is from the nearest axis, 0 to 45 degrees."""
    turn = F.pmod(F.degrees(F.atan2(m["b"], m["a"])), F.lit(90.0))
    return F.least(turn, 90.0 - turn)


def is_dark(red: Column, green: Column, blue: Column, most: float = 0.18) -> Column:
    """Luminance of at most `most`; an unknown colour isn't dark."""
    return F.coalesce(red * 0.2126 + green * 0.7152 + blue * 0.0722 <= most, F.lit(False))


def signed_area(quad: Column) -> Column:
    """Shoelace area of an array of (x, y) arrays, positive counter-clockwise."""
    following = F.concat(F.slice(quad, 2, F.size(quad) - 1), F.slice(quad, 1, 1))
    terms = F.zip_with(quad, following, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2.0


def polygon_area(points: Column) -> Column:
    return F.abs(signed_area(points))


def valid_quad(quad: Column) -> Column:
    """Four finite corners in counter-clockwise order, convex and of positive area."""
    turn = lambda i: (quad[(i + 1) % 4][0] - quad[i][0]) * (quad[(i + 2) % 4][1] - quad[(i + 1) % 4][1]) - (quad[(i + 1) % 4][1] - quad[i][1]) * (quad[(i + 2) % 4][0] - quad[(i + 1) % 4][0])
    finite = F.forall(quad, lambda p: F.forall(p, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
    turns = turn(0) > 0
    for i in range(1, 4):
        turns = turns & (turn(i) > 0)
    return (F.size(quad) == 4) & finite & turns
