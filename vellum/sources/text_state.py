"""Graphics and text state over content streams: text events, paints and hidden-text findings.

The state is a stack that every operator changes, so a page's instructions are folded in order by one
task; pages are independent rows and none is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.codecs import parse_cid_widths
from vellum.functions.scalars import area, coverage, intersects
from vellum.operators.classify import COVERED, INVISIBLE_ALPHA, OPAQUE_ALPHA, PAGE_IMAGE, hidden_category, hidden_mechanism
from vellum.sources import cos

Matrix = tuple[float, float, float, float, float, float]
Rect = tuple[float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Events: texts and paints of a page with bounds in page space.
EVENTS = (
    "doc_id string, page int, page_area double, ord long, event string, text binary, mode int, alpha double, layer_off boolean, actual_text binary, "
    "crop struct<x0:double,y0:double,x1:double,y1:double>, clip struct<x0:double,y0:double,x1:double,y1:double>, rect struct<x0:double,y0:double,x1:double,y1:double>, kind string, dark boolean, opaque boolean, complete boolean, "
    "font long, num long, depth int, start long, end long, width double, height double"
)


def times(m: Matrix, n: Matrix) -> Matrix:
    """The matrix that applies m first."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def bounds(m: Matrix, x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    points = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


@dataclass(frozen=True)
class State:
    ctm: Matrix = UNIT
    clip: tuple[float, float, float, float] | None = None
    fill_alpha: float = 1.0
    stroke_alpha: float = 1.0
    normal_blend: bool = True
    luminance: float | None = 0.0
    size: float = 0.0
    mode: int = 0
    leading: float = 0.0
    rise: float = 0.0
    scale: float = 1.0


def _luminance(v: list[float]) -> float | None:
    if len(v) == 1:
        return v[0]
    if len(v) == 3:
        return 0.2126 * v[0] + 0.7152 * v[1] + 0.0722 * v[2]
    if len(v) == 4:
        r, g, b = ((1 - c) * (1 - v[3]) for c in v[:3])
        return 0.2126 * r + 0.7152 * g + 0.0722 * b
    return None


class Font:
    """A font's object number, bytes a code and widths in thousandths of an em."""

    def __init__(self, doc: cos.Document, value) -> None:
        own = doc.dictionary(value)
        self.num = value.num if isinstance(value, cos.Ref) else None
        self.wide = doc.get(own.get("Subtype")) == "Type0"
        numbers = lambda items: [x for x in items if isinstance(x, (int, float, list))]
        if self.wide:
            below = doc.get(own.get("DescendantFonts"))
            descendant = doc.dictionary(below[0]) if isinstance(below, list) and below else {}
            runs = doc.get(descendant.get("W"))
            self.widths = parse_cid_widths(numbers([doc.get(x) for x in runs])) if isinstance(runs, list) else {}
            rest = doc.get(descendant.get("DW", 1000))
            self.rest = float(rest) if isinstance(rest, (int, float)) else 1000.0
        else:
            listed, first = doc.get(own.get("Widths")), doc.get(own.get("FirstChar", 0))
            listed = [doc.get(x) for x in listed] if isinstance(listed, list) and isinstance(first, int) else []
            self.widths = {first + i: float(w) for i, w in enumerate(listed) if isinstance(w, (int, float))}
            self.rest = 500.0

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if self.wide else list(raw)

    def em(self, raw: bytes) -> float:
        return sum(self.widths.get(c, self.rest) for c in self.codes(raw)) / 1000.0


def layer_hidden(doc: cos.Document, value, off: set[cos.Ref]) -> bool:
    """Whether a group is off, or a membership dictionary's policy over its groups hides what it marks."""
    own = doc.dictionary(value)
    if doc.get(own.get("Type")) != "OCMD":
        return isinstance(value, cos.Ref) and value in off
    groups = own.get("OCGs")
    groups = [groups] if isinstance(groups, cos.Ref) and not isinstance(doc.get(groups), list) else [g for g in doc.get(groups) or [] if isinstance(g, cos.Ref)]
    states = [g not in off for g in groups]
    if not states:
        return False
    policy = doc.get(own.get("P"))
    visible = {"AllOn": all(states), "AnyOff": not all(states), "AllOff": not any(states)}.get(str(policy), any(states))
    return not visible


def page_events(doc: cos.Document, page: dict, off: set[cos.Ref]) -> tuple[list[dict], bool]:
    """A page's texts and paints in order, those of forms in their place, and whether all was read.

    Widths are the fonts' own, else half an em a byte. A form that draws itself again is left out; one
    that nests deeper than the interpreter reaches makes the page incomplete.
    """
    out: list[dict] = []
    whole = True
    marks: list[dict] = []
    fonts: dict = {}

    def emit(event: str, rect, s: State, depth: int, **more) -> None:
        hidden = any(x["off"] for x in marks)
        out.append({"ord": len(out), "event": event, "rect": rect, "clip": s.clip, "depth": depth, "layer_off": hidden, **more})

    def run(content: bytes, resources: dict, s: State, path_of: tuple[cos.Ref, ...]) -> None:
        nonlocal whole
        found, read = cos.instructions(content)
        whole = whole and read
        states, properties, xobjects, named = (doc.dictionary(resources.get(k)) for k in ("ExtGState", "Properties", "XObject", "Font"))
        depth, base = len(path_of), len(marks)
        stack, tm, line, path, pending, font = [], UNIT, UNIT, [], False, None

        def show(raw: bytes, at: cos.Instruction) -> None:
            nonlocal tm
            width = (font.em(raw) if font else len(raw) * 0.5) * s.size * s.scale
            m = times((1, 0, 0, 1, 0, s.rise), times(tm, s.ctm))
            flat = abs(m[0] * m[3] - m[1] * m[2]) < 1e-12 or s.size == 0
            alpha = s.stroke_alpha if s.mode in (1, 5) else max(s.fill_alpha, s.stroke_alpha) if s.mode in (2, 6) else s.fill_alpha
            actual = next((x["actual"] for x in reversed(marks) if x["actual"] is not None), None)
            emit("text", None if flat else bounds(m, 0, 0, width, s.size), s, depth, text=raw, mode=s.mode, alpha=alpha, actual_text=actual, font=font.num if font else None, start=at.start, end=at.end)
            tm = times((1, 0, 0, 1, width, 0), tm)

        for x in found:
            op, args = x.op, x.operands
            nums = [float(v) for v in args if isinstance(v, (int, float)) and not isinstance(v, bool)]
            if op == "q":
                stack.append((s, font))
            elif op == "Q" and stack:
                s, font = stack.pop()
            elif op == "cm" and len(nums) == 6:
                s = replace(s, ctm=times(tuple(nums), s.ctm))
            elif op == "gs" and args:
                g = doc.dictionary(states.get(str(args[0])))
                num = lambda k, d: float(v) if isinstance(v := doc.get(g.get(k)), (int, float)) else d  # noqa: B023, E731
                blend = doc.get(g.get("BM"))
                s = replace(s, fill_alpha=num("ca", s.fill_alpha), stroke_alpha=num("CA", s.stroke_alpha), normal_blend=s.normal_blend if blend is None else blend in ("Normal", "Compatible"))
            elif op in ("g", "rg", "k", "sc", "scn"):
                s = replace(s, luminance=_luminance(nums) if op in ("g", "rg", "k") or nums else None)
            elif op == "re" and len(nums) == 4:
                path.append(bounds(s.ctm, nums[0], nums[1], nums[0] + nums[2], nums[1] + nums[3]))
            elif op in ("m", "l", "c", "v", "y", "h"):
                path.append(None)
            elif op in ("W", "W*"):
                pending = True
            elif op in ("f", "F", "f*", "B", "B*", "b", "b*", "S", "s", "n"):
                if op not in ("S", "s", "n"):
                    single = len(path) == 1 and path[0] is not None
                    opaque = single and s.fill_alpha >= OPAQUE_ALPHA and s.normal_blend
                    emit("fill", path[0] if single else None, s, depth, kind="fill", dark=s.luminance is not None and s.luminance <= 0.18, opaque=opaque, alpha=s.fill_alpha)
                elif op != "n":
                    emit("stroke", None, s, depth, kind="stroke", alpha=s.stroke_alpha)
                if pending and len(path) == 1 and path[0]:
                    c = s.clip or path[0]
                    s = replace(s, clip=(max(c[0], path[0][0]), max(c[1], path[0][1]), min(c[2], path[0][2]), min(c[3], path[0][3])))
                path, pending = [], False
            elif op == "sh":
                emit("shade", None, s, depth, kind="shade", alpha=s.fill_alpha)
            elif op == "BI":
                emit("inline-image", bounds(s.ctm, 0, 0, 1, 1), s, depth, kind="image", alpha=s.fill_alpha)
            elif op == "Do" and args:
                ref = xobjects.get(str(args[0]))
                target = doc.get(ref)
                num_of = ref.num if isinstance(ref, cos.Ref) else None
                own = target.dict if isinstance(target, cos.Stream) else {}
                marks.append({"off": layer_hidden(doc, own.get("OC"), off), "actual": None})
                if doc.get(own.get("Subtype")) == "Image":
                    masked = any(k in own for k in ("SMask", "Mask", "ImageMask"))
                    emit("image", bounds(s.ctm, 0, 0, 1, 1), s, depth, kind="image", opaque=not masked and s.fill_alpha >= OPAQUE_ALPHA and s.normal_blend, alpha=s.fill_alpha, num=num_of, matrix=s.ctm)
                elif doc.get(own.get("Subtype")) == "Form" and ref not in path_of:
                    emit("form", None, s, depth, kind="form", alpha=s.fill_alpha, num=num_of)
                    matrix = [doc.get(v) for v in doc.get(own.get("Matrix")) or []]
                    matrix = tuple(map(float, matrix)) if len(matrix) == 6 and all(isinstance(v, (int, float)) for v in matrix) else UNIT
                    inner = doc.dictionary(own.get("Resources")) if own.get("Resources") is not None else resources
                    try:
                        run(doc.decoded(target), inner, replace(s, ctm=times(matrix, s.ctm)), (*path_of, ref))
                    except (ValueError, TypeError, IndexError, RecursionError):
                        whole = False
                else:
                    emit("unknown", None, s, depth, kind="unknown", alpha=s.fill_alpha, num=num_of)
                marks.pop()
            elif op == "BT":
                tm = line = UNIT
            elif op == "Tf" and nums:
                s = replace(s, size=nums[-1])
                ref = named.get(str(args[0])) if isinstance(args[0], cos.Name) else None
                key = ref if isinstance(ref, cos.Ref) else (path_of, str(args[0]))
                if ref is not None and key not in fonts:
                    fonts[key] = Font(doc, ref)
                font = fonts.get(key)
            elif op == "Tr" and nums:
                s = replace(s, mode=int(nums[0]))
            elif op == "TL" and nums:
                s = replace(s, leading=nums[0])
            elif op == "Ts" and nums:
                s = replace(s, rise=nums[0])
            elif op == "Tz" and nums:
                s = replace(s, scale=nums[0] / 100)
            elif op in ("Td", "TD") and len(nums) == 2:
                s = replace(s, leading=-nums[1]) if op == "TD" else s
                tm = line = times((1, 0, 0, 1, nums[0], nums[1]), line)
            elif op == "Tm" and len(nums) == 6:
                tm = line = tuple(nums)
            elif op == "T*":
                tm = line = times((1, 0, 0, 1, 0, -s.leading), line)
            elif op in ("Tj", "'", '"', "TJ"):
                if op in ("'", '"'):
                    tm = line = times((1, 0, 0, 1, 0, -s.leading), line)
                parts = args[0] if op == "TJ" and args and isinstance(args[0], list) else args
                show(b"".join(v for v in parts if isinstance(v, bytes)), x)
            elif op in ("BDC", "BMC"):
                value = args[1] if len(args) > 1 else None
                ref = properties.get(str(value)) if isinstance(value, cos.Name) else value
                own = doc.dictionary(ref)
                actual = doc.get(own.get("ActualText")) if own else None
                marks.append({"off": layer_hidden(doc, ref, off), "actual": actual if isinstance(actual, bytes) else None})
            elif op == "EMC" and len(marks) > base:
                marks.pop()
        del marks[base:]

    run(doc.content(page), doc.dictionary(page.get("Resources")), State(), ())
    return out, whole


def layers_off(doc: cos.Document) -> set[cos.Ref]:
    """Optional-content groups that the default configuration hides; with its base off, all not in ON."""
    properties = doc.dictionary(doc.dictionary(doc.trailer.get("Root")).get("OCProperties"))
    default = doc.dictionary(properties.get("D"))
    listed = lambda d, k: {r for r in doc.get(d.get(k)) or [] if isinstance(r, cos.Ref)}
    if doc.get(default.get("BaseState")) == "OFF":
        return listed(properties, "OCGs") - listed(default, "ON")
    return listed(default, "OFF")


def scan_events(files: DataFrame) -> DataFrame:
    """Texts and paints of all pages; a page that can't be read whole has `complete` false, and one
    that can't be read at all is one event `unreadable`."""
    from vellum.sources.documents import _box, _scan

    def each(doc: cos.Document) -> Iterator[tuple]:
        off = layers_off(doc)
        corners = ("x0", "y0", "x1", "y1")
        shape = lambda r: None if r is None else dict(zip(corners, map(float, r)))
        for i, (_, page) in enumerate(doc.pages()):
            box = _box(doc, page)
            try:
                events, whole = page_events(doc, page, off)
            except (ValueError, TypeError, IndexError):
                events, whole = [{"ord": 0, "event": "unreadable", "rect": None, "clip": None}], False
            for e in events:
                yield (
                    doc.sha256, i, (box[2] - box[0]) * (box[3] - box[1]), e["ord"], e["event"], e.get("text"), e.get("mode"), e.get("alpha"), e.get("layer_off", False), e.get("actual_text"),
                    shape(box), shape(e["clip"]), shape(e["rect"]), e.get("kind"), e.get("dark", False), e.get("opaque", False), whole,
                    e.get("font"), e.get("num"), e.get("depth", 0), e.get("start"), e.get("end"), *_sides(e.get("matrix")),
                )

    return _scan(files, EVENTS, each)


def _sides(m: Matrix | None) -> tuple[float | None, float | None]:
    """The lengths of a placed unit square's sides."""
    return (None, None) if m is None else (math.hypot(m[0], m[1]), math.hypot(m[2], m[3]))


def placements(events: DataFrame) -> DataFrame:
    """(doc_id, num, uses, width, height, pages, complete): every image's placements, in forms too.

    Width and height are the largest in points; an image on a page that can't be read whole is incomplete.
    """
    images = events.where("event = 'image' AND num IS NOT NULL")
    return images.groupBy("doc_id", "num").agg(F.count("*").alias("uses"), F.max("width").alias("width"), F.max("height").alias("height"), F.count_distinct("page").alias("pages"), F.bool_and("complete").alias("complete"))


def direct_bindings(events: DataFrame) -> DataFrame:
    """(doc_id, page, num): images that a page draws itself, not through a form."""
    return events.where("event = 'image' AND num IS NOT NULL AND depth = 0").select("doc_id", "page", "num").distinct()


def glyph_usage(events: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """(doc_id, font, codes): the distinct codes that texts show in each font, in order.

    `wide` (doc_id, font) lists fonts with codes of two bytes.
    """
    texts = events.where("event = 'text' AND font IS NOT NULL").select("doc_id", "font", "text")
    two = F.lit(False)
    if wide is not None:
        texts, two = texts.join(wide.select("doc_id", "font").distinct().withColumn("_two", F.lit(True)), ["doc_id", "font"], "left"), F.coalesce("_two", F.lit(False))
    step = F.when(two, 4).otherwise(2)
    hexed = F.hex("text")
    at = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed), step)).otherwise(F.array().cast("array<int>"))
    codes = F.explode(F.transform(at, lambda i: F.conv(F.substring(hexed, i, step), 16, 10).cast("long"))).alias("code")
    return texts.select("doc_id", "font", codes).distinct().groupBy("doc_id", "font").agg(F.array_sort(F.collect_list("code")).alias("codes"))


HIDDEN = "doc_id string, page int, ord long, text binary, mechanism string, category string, action string, confidence float, depth int, start long, end long"


def _held(covers: np.ndarray, rect: Rect) -> np.ndarray:
    """`scalars.coverage` of one rectangle by many."""
    whole = max(0.0, rect[2] - rect[0]) * max(0.0, rect[3] - rect[1])
    w = np.minimum(covers[:, 2], rect[2]) - np.maximum(covers[:, 0], rect[0])
    h = np.minimum(covers[:, 3], rect[3]) - np.maximum(covers[:, 1], rect[1])
    return np.maximum(w, 0.0) * np.maximum(h, 0.0) / whole if whole > 0 else np.zeros(len(covers))


def _meets(a: Rect, b: Rect) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def _category(mechanism: str, actual: bytes | None, page_image: bool, invisible: int, dark: bool, share: float) -> tuple[str, str, float]:
    """`classify.hidden_category` of one text."""
    if actual is not None:
        return "accessibility", "keep", 0.90
    if mechanism == "optional-content-hidden":
        return "hidden-layer", "keep", 0.95
    if mechanism == "outside-crop-box":
        return "outside-page", "keep", 0.95
    if mechanism in ("rendering-mode-invisible", "zero-opacity", "covered-by-image") and page_image and invisible >= 3:
        return "ocr-overlay", "keep", 0.92
    if mechanism == "covered-by-opaque-fill" and dark:
        return ("likely-redaction-leak", "remove", 0.94) if share <= 0.40 else ("other-invisible", "keep", 0.65)
    return "other-invisible", "keep", 0.70


def page_hidden(events: list[dict], box: Rect) -> Iterator[tuple]:
    """(ord, text, mechanism, category, action, confidence, depth, start, end) of a page's texts that can't be seen."""
    texts = [e for e in events if e["event"] == "text"]
    covers = [e for e in events if e.get("opaque") and e["rect"] is not None]
    rects, order = np.array([e["rect"] for e in covers], np.float64).reshape(-1, 4), np.array([e["ord"] for e in covers])
    sizes = (max(0.0, e["rect"][2] - e["rect"][0]) * max(0.0, e["rect"][3] - e["rect"][1]) if e["event"] == "image" and e["rect"] is not None else -1.0 for e in events)
    page_area = (box[2] - box[0]) * (box[3] - box[1])
    images = np.array([e["rect"] for e, size in zip(events, sizes) if size >= page_area * PAGE_IMAGE and size >= 0], np.float64).reshape(-1, 4)
    invisible = sum(e["mode"] == 3 or e["alpha"] <= INVISIBLE_ALPHA for e in texts)
    for e in texts:
        rect, cover = e["rect"], None
        if len(covers) and rect is not None:
            hit = np.flatnonzero((order > e["ord"]) & (_held(rects, rect) >= COVERED))
            cover = covers[hit[0]] if len(hit) else None  # they are in order
        if e["mode"] == 3:
            mechanism = "rendering-mode-invisible"
        elif e["mode"] == 7:
            mechanism = "clip-only-rendering-mode"
        elif e["alpha"] <= INVISIBLE_ALPHA:
            mechanism = "zero-opacity"
        elif e["layer_off"]:
            mechanism = "optional-content-hidden"
        elif rect is None:
            mechanism = "degenerate-transform"
        elif not _meets(rect, box):
            mechanism = "outside-crop-box"
        elif e["clip"] is not None and not _meets(rect, e["clip"]):
            mechanism = "clipped-out"
        elif cover is not None and cover["kind"] in ("image", "fill"):
            mechanism = "covered-by-image" if cover["kind"] == "image" else "covered-by-opaque-fill"
        else:
            continue
        on_image = rect is not None and len(images) > 0 and bool((_held(images, rect) >= COVERED).any())
        share = 0.0
        if cover is not None:
            c = cover["rect"]
            share = max(0.0, c[2] - c[0]) * max(0.0, c[3] - c[1]) / page_area if page_area else math.inf
        found = _category(mechanism, e["actual_text"], on_image, invisible, cover is not None and bool(cover.get("dark")), share)
        yield e["ord"], e["text"], mechanism, *found, e["depth"], e["start"], e["end"]


def scan_hidden(files: DataFrame) -> DataFrame:
    """`hidden_text` of all pages in one pass: a text meets only what is on its own page."""
    from vellum.sources.documents import _box, _scan

    def each(doc: cos.Document) -> Iterator[tuple]:
        off = layers_off(doc)
        for i, (_, page) in enumerate(doc.pages()):
            box = tuple(map(float, _box(doc, page)))
            try:
                events, _ = page_events(doc, page, off)
            except (ValueError, TypeError, IndexError):
                continue  # no text of it is known
            for row in page_hidden(events, box):
                yield doc.sha256, i, *row

    return _scan(files, HIDDEN, each)


def page_facts(events: DataFrame) -> DataFrame:
    """(doc_id, page, paints, coverage, visible_native, image_paints, unknown_paints, complete) of pages with events."""
    from vellum.operators.spatial import union_coverage

    paints = events.where("event NOT IN ('form', 'unreadable')")
    seen = (F.col("alpha") > INVISIBLE_ALPHA) & ~F.coalesce("layer_off", F.lit(False))
    native = F.col("event").isin("fill", "stroke", "shade") | ((F.col("event") == "text") & ~F.coalesce(F.col("mode").isin(3, 7), F.lit(False)))
    image = F.col("event").isin("image", "inline-image")
    per = events.groupBy("doc_id", "page").agg(
        F.count_if(~F.col("event").isin("form", "unreadable")).alias("paints"), F.count_if(native & seen).alias("visible_native"), F.count_if(image & seen).alias("image_paints"),
        F.count_if(F.col("event") == "unknown").alias("unknown_paints"), F.bool_and("complete").alias("complete"),
    )
    covered = union_coverage(paints.where(image & seen & F.col("rect").isNotNull()), ["doc_id", "page"], "rect", "crop")
    return per.join(covered, ["doc_id", "page"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def hidden_text(events: DataFrame) -> DataFrame:
    """(doc_id, page, ord, text, mechanism, category, action, confidence, depth, start, end) of texts that can't be seen.

    `start` and `end` are places in the page's content where `depth` is zero, else in the form's.

    A text is met only with later opaque paints and large images of its own page.
    """
    page = ["doc_id", "page"]
    texts = events.where("event = 'text'")
    opaque = events.where("opaque AND rect IS NOT NULL").select(*page, F.col("ord").alias("o"), F.col("rect").alias("cover"), F.col("kind").alias("cover_kind"), F.col("dark").alias("cover_dark"))
    pairs = texts.select(*page, "ord", "rect").join(opaque, page).where((F.col("o") > F.col("ord")) & (coverage(F.col("cover"), F.col("rect")) >= COVERED))
    first = pairs.groupBy(*page, "ord").agg(F.min(F.struct("o", "cover_kind", "cover_dark", "cover")).alias("first"))
    large = events.where("event = 'image'").where(area(F.col("rect")) >= F.col("page_area") * PAGE_IMAGE).select(*page, F.col("rect").alias("image"))
    on_image = texts.select(*page, "ord", "rect").join(large, page).where(coverage(F.col("image"), F.col("rect")) >= COVERED).select(*page, "ord").distinct().withColumn("page_image", F.lit(True))
    unseen = texts.where((F.col("mode") == 3) | (F.col("alpha") <= INVISIBLE_ALPHA)).groupBy(*page).agg(F.count("*").alias("invisible"))
    rows = texts.join(first, [*page, "ord"], "left").join(on_image, [*page, "ord"], "left").join(unseen, page, "left")
    in_crop, in_clip = intersects(F.col("rect"), F.col("crop")), F.col("clip").isNull() | intersects(F.col("rect"), F.col("clip"))
    rows = rows.withColumn("mechanism", hidden_mechanism(F.col("mode"), F.col("alpha"), F.col("layer_off"), F.col("rect"), in_crop, in_clip, F.col("first.cover_kind")))
    found = hidden_category(F.col("mechanism"), F.col("actual_text"), F.coalesce("page_image", F.lit(False)), F.coalesce("invisible", F.lit(0)), F.col("first.cover_dark"), area(F.col("first.cover")) / F.col("page_area"))
    return rows.where("mechanism IS NOT NULL").withColumn("c", found).select(*page, "ord", "text", "mechanism", "c.category", "c.action", "c.confidence", "depth", "start", "end")
