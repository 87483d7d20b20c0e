"""Display-list transforms: folds over a stream's ordered instructions, rectangles and points.

Folds are pure functions of one stream, applied stream by stream with `groups.in_groups`: streams are independent
and a stream's order can't be split, so parallelism is over streams and nothing but the stream's own
rows meets in a task. Runs, claims and groups that stay in place are joins and windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf

from vellum.operators.graph import global_rank
from vellum.operators.groups import in_groups
from vellum.session import checkpoint
from vellum.sources import cos


# --- bytes -------------------------------------------------------------------------------------


def remove_ranges(data: bytes, ranges: Sequence[tuple[int, int]]) -> bytes:
    """The bytes outside the given ranges, which may overlap and come in any order."""
    out, at = bytearray(), 0
    for start, end in sorted(ranges):
        out += data[at : max(at, start)]
        at = max(at, end)
    return bytes(out + data[at:])


def replace_ranges(data: bytes, parts: Sequence[tuple[int, int, bytes]]) -> bytes | None:
    """The bytes with ranges replaced; None if any two overlap, as then no rewrite is safe."""
    out, at = bytearray(), 0
    for start, end, new in sorted(parts, key=lambda p: p[:2]):
        if start < at or end < start or end > len(data):
            return None
        out += data[at:start] + new
        at = end
    return bytes(out + data[at:])


def normal_form(content: bytes) -> bytes:
    """One instruction a line; unchanged with inline images or if it can't all be read."""
    found, whole = cos.instructions(content)
    if not whole or any(x.op == "BI" for x in found):
        return content
    return b"\n".join(b" ".join([*map(cos.serialise, x.operands), x.op.encode("latin-1")]) for x in found)


# --- rectangles, lines and points --------------------------------------------------------------

Rect = tuple[float, float, float, float]


def merge_rects(a: Rect, b: Rect, snap: float = 0.01, close: float = 1e-6) -> Rect | None:
    """Two rectangles as one if they share a side's span and touch along it."""
    for i in (0, 1):
        j = 1 - i
        if abs(a[j] - b[j]) <= close and abs(a[j + 2] - b[j + 2]) <= close:
            gap = max(a[i], b[i]) - min(a[i + 2], b[i + 2])
            if -close <= gap <= snap:
                out = [0.0] * 4
                out[j], out[j + 2] = a[j], a[j + 2]
                out[i], out[i + 2] = min(a[i], b[i]), max(a[i + 2], b[i + 2])
                return tuple(out)
    return None


def merge_run(rects: Sequence[Rect], colours: Sequence, snap: float = 0.01) -> list[tuple[Rect, int]]:
    """(rectangle, members) of neighbours of one colour merged as long as they fit."""
    out: list[list] = []
    for rect, colour in zip(rects, colours):
        joined = merge_rects(out[-1][0], rect, snap) if out and out[-1][2] == colour else None
        if joined:
            out[-1][0], out[-1][1] = joined, out[-1][1] + 1
        else:
            out.append([rect, 1, colour])
    return [(r, n) for r, n, _ in out]


def drop_collinear(points: Sequence[tuple[float, float]], most: float = 1e-9) -> list[tuple[float, float]]:
    """Points without those that lie between their neighbours on a straight line, going forward."""
    out: list[tuple[float, float]] = []
    for p in points:
        while len(out) >= 2:
            (ax, ay), (bx, by) = out[-2], out[-1]
            cross = (bx - ax) * (p[1] - by) - (by - ay) * (p[0] - bx)
            ahead = (bx - ax) * (p[0] - bx) + (by - ay) * (p[1] - by)
            if abs(cross) <= most and ahead >= 0:
                out.pop()
            else:
                break
        out.append(p)
    return out


def simplify(points: Sequence[tuple[float, float]], most: float = 0.005) -> list[int]:
    """Indexes that Douglas and Peucker's method keeps within `most` of the polyline."""
    xy, keep = np.asarray(points, float), {0, len(points) - 1}
    open_ = [(0, len(points) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        d, own = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        size = float(d @ d)
        along = np.clip(own @ d / size, 0, 1) if size else np.zeros(len(own))
        far = np.hypot(*(own - along[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > most:
            keep.add(a + 1 + k)
            open_ += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(keep)


def snap_coordinate(value: float, unit: float = 1.0, grid: float = 0.01, most: float = 0.0071) -> float:
    """A coordinate on the grid if that moves it by at most `most` points, else itself."""
    to = round(value / grid) * grid
    return round(to, 10) if math.isfinite(value) and abs(to - value) * unit <= most else value


# --- runs and plans ------------------------------------------------------------------------------


def paint_batches(kinds: Sequence[str], bounds: Sequence[Rect | None], winding: Sequence[int], most: int = 64) -> list[int]:
    """Batch numbers of consecutive paints: one kind, at most `most` members, and no member of the
    contrary winding unless it is disjoint from all before. Unknown bounds stand alone."""
    out: list[int] = []
    members: list[int] = []
    for i, kind in enumerate(kinds):

        def fits() -> bool:
            if not members or len(members) >= most or kinds[members[0]] != kind or bounds[i] is None or bounds[members[0]] is None:  # noqa: B023
                return False
            for m in members:
                a, b = bounds[m], bounds[i]  # noqa: B023
                apart = a[2] <= b[0] or b[2] <= a[0] or a[3] <= b[1] or b[3] <= a[1]
                if not apart and winding[m] != winding[i]:  # noqa: B023
                    return False
            return True

        if fits():
            members.append(i)
            out.append(out[-1])
        else:
            members = [i]
            out.append(out[-1] + 1 if out else 0)
    return out


def stripe_runs(draws: DataFrame, stream: Sequence[str], order: Sequence[str], gap: float = 1.0, least: int = 3) -> DataFrame:
    """(stream, axis, first, members): runs of at least `least` neighbouring draws that make up a stripe.

    Draws have state, width, height (pixels) and x, y. Two neighbours continue a stripe along an axis if
    they share their state, are equally long across it, over five pixels and at least twice as long as
    along it, lie in line across it to within `gap`, and touch along it, on either side, to within `gap`.
    """
    w = Window.partitionBy(*stream).orderBy(*order)
    draws = draws.withColumns({"_n": F.row_number().over(w), "_before": F.lag(F.struct("state", "width", "height", "x", "y")).over(w)})
    was = lambda c: F.col("_before")[c]

    def continues(across: str, along: str, line: str, way: str) -> Column:
        step = F.col(way) - was(way)
        slim = (F.col(across) > 5) & (2 * F.greatest(F.col(along), was(along)) <= F.col(across))
        touch = F.least(F.abs(step - was(along)), F.abs(step + F.col(along))) <= gap
        return (F.col("state") == was("state")) & (F.col(across) == was(across)) & slim & (F.abs(F.col(line) - was(line)) <= gap) & touch

    axis = F.when(continues("width", "height", "x", "y"), "vertical").when(continues("height", "width", "y", "x"), "horizontal")
    links = draws.withColumn("axis", axis).where("axis IS NOT NULL")
    # links of a run are neighbours: their places less their rank are one number
    same = Window.partitionBy(*stream, "axis").orderBy("_n")
    runs = links.withColumn("_run", F.col("_n") - F.row_number().over(same)).groupBy(*stream, "axis", "_run")
    return runs.agg((F.min("_n") - 2).alias("first"), (F.count("*") + 1).alias("members")).where(F.col("members") >= least).drop("_run")


def _settle(wants: DataFrame, slots: int | Column | None = None) -> DataFrame:
    """(seed, slot, item, place) of seeds in ascending order that take an item for each of their slots.

    `wants` is (seed, slot, item, place), `place` saying which item a slot likes best, `slots` how many a
    seed must fill (all it has, if none). A seed takes only what none before it holds, and nothing unless all its slots
    are filled. Each round settles every seed that no open seed before it can hinder, and drops those
    that can't be filled any more; the first open seed is always one of them, so rounds end.
    """
    wants = checkpoint(wants)
    need = wants.groupBy("seed").agg((F.count_distinct("slot") if slots is None else F.max(F.lit(slots))).alias("need"))
    need, taken = checkpoint(need), None
    while not wants.isEmpty():
        best = wants.groupBy("seed", "slot").agg(F.min(F.struct("place", "item")).alias("best"))
        able = best.groupBy("seed").agg(F.count("*").alias("have")).join(need, "seed").where("have = need").select("seed")
        wants = wants.join(able, "seed", "left_semi")
        first = wants.groupBy("item").agg(F.min("seed").alias("owner"))
        picks = best.join(able, "seed", "left_semi").select("seed", "slot", "best.item", "best.place").join(first, "item")
        free = picks.groupBy("seed").agg(F.bool_and(F.col("owner") == F.col("seed")).alias("free")).where("free")
        won = checkpoint(picks.join(free, "seed", "left_semi").select("seed", "slot", "item", "place"))
        taken = won if taken is None else taken.union(won)
        wants = checkpoint(wants.join(won.select("seed").distinct(), "seed", "left_anti").join(won.select("item").distinct(), "item", "left_anti"))
    return wants if taken is None else taken


def claim(plans: DataFrame, members: DataFrame) -> DataFrame:
    """Plans (plan, priority) that stand, where each member (plan, member) may serve one plan only.

    Higher priorities go first, then smaller plans; a plan stands if none that stands before it has a
    member of it. Plans without members stand.
    """
    order = checkpoint(global_rank(plans.withColumn("_first", -F.col("priority")), ["_first", "plan"]).select("plan", F.col("rank").alias("seed")))
    wants = members.distinct().join(order, "plan").select("seed", F.col("member").alias("slot"), F.col("member").alias("item"), F.lit(0).alias("place"))
    held = _settle(wants).select("seed").distinct().join(order, "seed").select("plan")
    return held.union(plans.join(members.select("plan").distinct(), "plan", "left_anti").select("plan"))


def persistent_groups(objects: DataFrame, pages: int, key: str = "key", page: str = "page", item: str = "item", most: float = 12.0, least: int = 3) -> DataFrame:
    """(key, seed, mode, page, item): objects that stay in place on all pages, or on all after the first.

    Objects have a key, a page (0 to pages - 1), a unique item that orders them, x and y. Every object of
    the first page looks on each other page for the nearest (by sum of differences, then item) of its key
    within `most` along either axis; in order of items, one that finds all takes them, and none is taken
    twice. What is left is tried again from the second page on. Fewer than `least` pages make no group.
    """
    grid = lambda c: F.floor(F.col(c) / most)
    rows = objects.select(F.col(key).alias("key"), F.col(page).alias("page"), F.col(item).alias("item"), "x", "y")
    out = None
    for first, mode in ((0, "all"), (1, "after-first")):
        if pages - first < max(least, 1):
            continue
        # what isn't on every page that counts can't make a group
        wide = rows.where(F.col("page") >= first).groupBy("key").agg(F.count_distinct("page").alias("n")).where(F.col("n") == pages - first)
        rows_ = rows.join(wide.select("key"), "key", "left_semi")
        around = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
        seeds = rows_.where(F.col("page") == first).select("key", F.col("item").alias("seed"), F.col("x").alias("sx"), F.col("y").alias("sy"), grid("x").alias("gx"), grid("y").alias("gy"))
        cells = seeds.withColumn("dx", around).withColumn("dy", around).withColumns({"gx": F.col("gx") + F.col("dx"), "gy": F.col("gy") + F.col("dy")})
        others = rows_.where(F.col("page") > first).withColumns({"gx": grid("x"), "gy": grid("y")})
        away = F.abs(F.col("x") - F.col("sx")) + F.abs(F.col("y") - F.col("sy"))
        near = cells.join(others, ["key", "gx", "gy"]).where((F.abs(F.col("x") - F.col("sx")) <= most) & (F.abs(F.col("y") - F.col("sy")) <= most))
        own = seeds.select("seed", F.lit(first).alias("slot"), F.col("seed").alias("item"), F.lit(0.0).alias("place"))
        wants = near.select("seed", F.col("page").alias("slot"), "item", away.alias("place")).union(own)
        found = checkpoint(_settle(wants, pages - first).select("seed", F.lit(mode).alias("mode"), F.col("slot").alias("page"), "item"))
        rows = checkpoint(rows.join(found.select("item"), "item", "left_anti"))
        out = found if out is None else out.union(found)
    if out is None:
        return rows.select("key", F.col("item").alias("seed"), F.lit("all").alias("mode"), "page", "item").where("false")
    return objects.select(F.col(key).alias("key"), F.col(item).alias("item")).join(out, "item").select("key", "seed", "mode", "page", "item")


# --- the same over tables ------------------------------------------------------------------------

SPANS = "array<struct<start:long,end:long>>"


def _udf(each: Callable, kind: str):
    """A Pandas UDF of a function of values; null where the first is null."""

    def run(*columns):
        return pd.Series([None if row[0] is None else each(*row) for row in zip(*columns)])

    return pandas_udf(run, kind, PandasUDFType.SCALAR)


def without_ranges(data: str | Column, ranges: str | Column) -> Column:
    """Bytes without the ranges of an array<struct<start,end>> column; null ranges remove nothing."""
    return _udf(lambda d, r: remove_ranges(bytes(d), [(x["start"], x["end"]) for x in (r if r is not None else [])]), "binary")(data, ranges)


def with_replacements(data: str | Column, parts: str | Column) -> Column:
    """Bytes with the parts of an array<struct<start,end,new>> column put in; null if any two overlap."""
    return _udf(lambda d, r: replace_ranges(bytes(d), [(x["start"], x["end"], bytes(x["new"])) for x in (r if r is not None else [])]), "binary")(data, parts)


def normalised(content: str | Column) -> Column:
    """Content streams with one instruction a line, where that is safe."""
    return _udf(lambda c: normal_form(bytes(c)), "binary")(content)


def merged_rects(rects: DataFrame, stream: Sequence[str], order: Sequence[str], colour: str = "colour", snap: float = 0.01) -> DataFrame:
    """(stream, run, x0, y0, x1, y1, members): neighbouring rectangles (x0, y0, x1, y1) of one colour as one where they fit."""
    n = len(stream)
    kinds = ", ".join(f"{c} {t}" for c, t in rects.select(*stream).dtypes)

    def each(columns: list[list]) -> list[tuple]:
        own = tuple(c[0] for c in columns[:n])
        found = merge_run(list(zip(*columns[n : n + 4])), columns[n + 4], snap)
        return [(*own, i, *map(float, r), members) for i, (r, members) in enumerate(found)]

    wanted = rects.select(*stream, "x0", "y0", "x1", "y1", colour, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    return in_groups(wanted, stream, [f"_o{i}" for i in range(len(order))], each, f"{kinds}, run long, x0 double, y0 double, x1 double, y1 double, members long")


def paint_runs(paints: DataFrame, stream: Sequence[str], order: Sequence[str], most: int = 64) -> DataFrame:
    """Paints (kind, x0, y0, x1, y1, winding) with their `batch` in the stream; null bounds stand alone."""
    names = paints.columns
    kinds = ", ".join(f"{n} {t}" for n, t in paints.dtypes)
    kind, winding, *box = (names.index(c) for c in ("kind", "winding", "x0", "y0", "x1", "y1"))

    def each(columns: list[list]) -> list[tuple]:
        known = [None if any(v is None or v != v for v in r) else r for r in zip(*(columns[i] for i in box))]
        return list(zip(*columns, paint_batches(columns[kind], known, columns[winding], most)))

    return in_groups(paints, stream, order, each, f"{kinds}, batch long")


def _points(each: Callable):
    return _udf(lambda p: each([(q["x"], q["y"]) for q in p]), "array<struct<x:double,y:double>>")


def without_collinear(points: str | Column) -> Column:
    """Arrays of points (x, y) without those on a straight line between their neighbours."""
    return _points(lambda p: [{"x": x, "y": y} for x, y in drop_collinear(p)])(points)


def simplified(points: str | Column, most: float = 0.005) -> Column:
    """Arrays of points (x, y) that stay within `most` of the polyline."""
    return _points(lambda p: [{"x": p[i][0], "y": p[i][1]} for i in simplify(p, most)] if p else [])(points)


def snapped(value: str | Column, unit: float | Column = 1.0, grid: float = 0.01, most: float = 0.0071) -> Column:
    """A coordinate column on the grid where that moves it by at most `most` points, else as it is."""
    value = F.col(value) if isinstance(value, str) else value
    to = F.rint(value / grid) * grid
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite & (F.abs(to - value) * unit <= most), F.round(to, 10)).otherwise(value)


def mismatched_quads(found: DataFrame, expected: DataFrame, on: Sequence[str], quad: str = "quad", most: float = 0.03) -> DataFrame:
    """Keys whose quads differ in any corner by more than `most`, or that only one side has."""
    both = found.select(*on, F.col(quad).alias("_a")).join(expected.select(*on, F.col(quad).alias("_b")), list(on), "full")
    apart = F.exists(F.zip_with("_a", "_b", lambda a, b: F.coalesce(F.abs(a - b) > most, F.lit(True))), lambda x: x)
    return both.where(F.coalesce(apart, F.lit(True))).select(*on)


def match_quads(found: Sequence[Sequence[float]], expected: Sequence[Sequence[float]], most: float = 0.03) -> None:
    """Raises if any corner of a pair of quads is further apart than `most`."""
    for i, (a, b) in enumerate(zip(found, expected, strict=True)):
        if max(abs(p - q) for p, q in zip(a, b, strict=True)) > most:
            raise ValueError(f"occurrence {i} isn't where the catalogue has it")
