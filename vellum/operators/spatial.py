"""Spatial operators: covers, bands, neighbourhoods and unions of rectangles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.scalars import area, coverage, gap, intersects
from vellum.operators.graph import connected_components
from vellum.operators.groups import in_groups


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long")))


def first_later_cover(targets: DataFrame, covers: DataFrame, group: Sequence[str], cell: float, key: str = "id", order: str = "ord", rect: str = "rect", least: float = 0.97) -> DataFrame:
    """(key, cover_ord): for each target the earliest later cover that holds at least `least` of it.

    A cover that holds that much of a target holds the cell of its centre, so targets stand in one
    cell of a grid and covers in those they touch: an equality join in place of all pairs.
    """
    cx, cy = (F.col(f"{rect}.x0") + F.col(f"{rect}.x1")) / 2, (F.col(f"{rect}.y0") + F.col(f"{rect}.y1")) / 2
    t = targets.select(*group, F.col(key), F.col(order).alias("_t"), F.col(rect).alias("_tr"), F.floor(cx / cell).alias("_cx"), F.floor(cy / cell).alias("_cy"))
    c = covers.select(*group, F.col(order).alias("cover_ord"), F.col(rect).alias("_cr"), _cells(F.col(f"{rect}.x0"), F.col(f"{rect}.x1"), cell).alias("_cx"))
    c = c.select("*", _cells(F.col("_cr.y0"), F.col("_cr.y1"), cell).alias("_cy"))
    pairs = t.join(c, [*group, "_cx", "_cy"]).where((F.col("cover_ord") > F.col("_t")) & (coverage(F.col("_cr"), F.col("_tr")) >= least))
    return pairs.groupBy(*group, key).agg(F.min("cover_ord").alias("cover_ord"))


def has_page_image(targets: DataFrame, images: DataFrame, page: str, page_area: str, rect: str = "rect", least_page: float = 0.45, least: float = 0.97) -> DataFrame:
    """Targets of which some image of at least `least_page` of the page holds at least `least`."""
    large = images.where(area(F.col(rect)) >= F.col(page_area) * least_page).select(F.col(page).alias("_p"), F.col(rect).alias("_ir"))
    return targets.join(large, (targets[page] == F.col("_p")) & (coverage(F.col("_ir"), targets[rect]) >= least), "left_semi")


#: Pairs of rows that a task of `nearest_in_band` compares at once.
BAND_PAIRS = 1 << 20


def _nearest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(place in `b` or -1, distance) for each row of `a`: the nearest within the band, ties to the least id.

    `b` is sorted by its first column, so a row's candidates are a slice of it, in which a row of one
    coordinate goes to its two neighbours and those as far away as they are.
    """
    place, away = np.full(len(a), -1), np.full(len(a), np.inf)
    if a.shape[1] == 1 and len(b):
        x, y = a[:, 0], b[:, 0]
        at = np.searchsorted(y, x)
        for first, step in ((at - 1, -1), (at, 1)):
            k, own, nearest = first, np.arange(len(a)), np.full(len(a), np.inf)
            while len(own):
                inside = (k >= 0) & (k < len(y))
                own, k = own[inside], k[inside]
                d = np.abs(x[own] - y[k])
                fits = (d <= most) & (d <= nearest[own])  # rounding may put several equally far
                own, k, d = own[fits], k[fits], d[fits]
                nearest[own] = d
                better = (d < away[own]) | ((d == away[own]) & (ids[k] < ids[place[own]]))
                place[own[better]], away[own[better]] = k[better], d[better]
                k = k + step
        return place, away
    low, high = np.searchsorted(b[:, 0], a[:, 0] - 2 * most), np.searchsorted(b[:, 0], a[:, 0] + 2 * most, "right")
    at = 0
    while at < len(a):
        end = at + max(1, int(np.searchsorted(np.cumsum(high[at:] - low[at:]), BAND_PAIRS, "right")))
        n = high[at:end] - low[at:end]
        own = np.repeat(np.arange(at, end), n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + low[own]
        apart = np.abs(a[own] - b[k])
        own, k, d = (v[(apart <= most).all(1)] for v in (own, k, sum(apart.T)))
        best = np.lexsort((ids[k], d, own))
        own, first = np.unique(own[best], return_index=True)
        place[own], away[own] = k[best][first], d[best][first]
        at = end
    return place, away


def nearest_in_band(a: DataFrame, b: DataFrame, key: str, a_id: str, b_id: str, at: Sequence[str], most: float = 12.0) -> DataFrame:
    """(a_id, b_id, distance): for each row of `a` the row of `b` of its key within the band of every
    coordinate that is nearest in sum of differences; ties to the least id. Bands of the first
    coordinate make it an equality join of three cells, of which no pairs are made: a cell's rows of `b`
    are sorted and searched by those of `a`. Rows of `b` in one place count as their least."""
    first, kinds = at[0], dict(a.dtypes) | dict(b.dtypes)
    whole = lambda df: df.select(*df.columns[:2], *[F.col(c).cast("double").alias(c) for c in at]).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in at))
    cell = F.floor(F.col(first) / most).cast("long")
    left = whole(a.select(key, a_id, *at)).where(F.col(key).isNotNull()).withColumn("_cell", cell)
    right = whole(b.select(key, b_id, *at)).where(F.col(key).isNotNull()).groupBy(key, *at).agg(F.min(b_id).alias(b_id))
    right = right.withColumn("_cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell + d)))

    def run(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        other = other.sort_values(first)
        ids = other[b_id].to_numpy()
        place, away = _nearest(own[list(at)].to_numpy(np.float64), other[list(at)].to_numpy(np.float64), ids, most)
        found = place >= 0
        return pd.DataFrame({a_id: own[a_id].to_numpy()[found], b_id: ids[place[found]], "distance": away[found]})

    both = left.groupBy(key, "_cell").cogroup(right.groupBy(key, "_cell"))
    found = both.applyInPandas(run, f"{a_id} {kinds[a_id]}, {b_id} {kinds[b_id]}, distance double")
    best = found.groupBy(a_id).agg(F.min(F.struct("distance", b_id)).alias("m"))  # a row's id may come twice
    return best.select(a_id, F.col(f"m.{b_id}").alias(b_id), F.col("m.distance").alias("distance"))


def proximity_components(rects: DataFrame, group: Sequence[str], key: str, reach: float, cell: float, rect: str = "rect") -> DataFrame:
    """(key, component) of rectangles linked where they are at most `reach` apart."""
    grown = rects.select(*group, key, F.col(rect).alias("_r"), _cells(F.col(f"{rect}.x0") - reach, F.col(f"{rect}.x1") + reach, cell).alias("_cx"))
    grown = grown.select("*", _cells(F.col("_r.y0") - reach, F.col("_r.y1") + reach, cell).alias("_cy"))
    other = grown.select(*group, F.col(key).alias("_k"), F.col("_r").alias("_o"), "_cx", "_cy")
    links = grown.join(other, [*group, "_cx", "_cy"]).where((F.col(key) < F.col("_k")) & (gap(F.col("_r"), F.col("_o")) <= reach))
    found = connected_components(links.select(F.col(key).alias("a"), F.col("_k").alias("b")).distinct())
    return rects.select(key).join(found.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("component"))


def merged_length(df: DataFrame, group: Sequence[str], low: str, high: str) -> DataFrame:
    """(group, pieces, length) of the union of intervals; empty and reversed ones count for nothing."""
    rows = df.where(F.col(high) > F.col(low))
    w = Window.partitionBy(*group).orderBy(low, high)
    rows = rows.withColumn("_reach", F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = (F.col("_reach").isNull() | (F.col(low) > F.col("_reach"))).cast("int")
    rows = rows.withColumn("_new", new).withColumn("_piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy(*group, "_piece").agg((F.max(high) - F.min(low)).alias("length"))
    return pieces.groupBy(*group).agg(F.count("*").alias("pieces"), F.sum("length").alias("length"))


def union_area(rects: np.ndarray) -> float:
    """The area of a union of rectangles x0, y0, x1, y1, by strips between breakpoints in x."""
    rects = rects[(rects[:, 2] > rects[:, 0]) & (rects[:, 3] > rects[:, 1])]
    if not len(rects):
        return 0.0
    xs = np.unique(rects[:, [0, 2]])
    total = 0.0
    for a, b in zip(xs[:-1], xs[1:]):
        live = rects[(rects[:, 0] <= a) & (rects[:, 2] >= b)]
        if not len(live):
            continue
        live = live[np.argsort(live[:, 1])]
        reach = np.maximum.accumulate(live[:, 3])
        start = np.maximum(live[:, 1], np.r_[-np.inf, reach[:-1]])
        total += (b - a) * float(np.maximum(live[:, 3] - start, 0).sum())
    return total


def union_coverage(df: DataFrame, group: Sequence[str], rect: str, target: str) -> DataFrame:
    """(group, coverage): the share of each group's target that its rectangles hold together.

    A page's rectangles are one task's; pages are many and each small.
    """
    kinds, n = dict(df.dtypes), len(group)

    def each(columns: list[list]) -> list[tuple]:
        own = tuple(c[0] for c in columns[:n])
        t = [c[0] for c in columns[n : n + 4]]
        if any(v is None or v != v for v in t) or t[2] <= t[0] or t[3] <= t[1]:
            return [(*own, 0.0)]
        found = set()
        for r in zip(*columns[n + 4 :]):
            if not any(v is None or v != v for v in r):
                x0, y0, x1, y1 = max(r[0], t[0]), max(r[1], t[1]), min(r[2], t[2]), min(r[3], t[3])
                if x1 > x0 and y1 > y0:
                    found.add((x0, y0, x1, y1))
        if len(found) < 2:
            held = sum((r[2] - r[0]) * (r[3] - r[1]) for r in found)
        else:
            held = union_area(np.array(sorted(found), np.float64))
        return [(*own, min(1.0, held / ((t[2] - t[0]) * (t[3] - t[1]))))]

    parts = [F.col(f"{v}.{c}").cast("double").alias(f"_{k}{i}") for k, v in (("t", target), ("r", rect)) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    schema = ", ".join(f"{g} {kinds[g]}" for g in group) + ", coverage double"
    return in_groups(df.select(*group, *parts), group, [], each, schema)


def occluded(paints: DataFrame, group: Sequence[str], key: str = "id", order: str = "ord", rect: str = "rect", opaque: str = "opaque") -> DataFrame:
    """Paints whose whole rectangle later opaque paints of the group hold together."""
    later = paints.where(opaque).select(*group, F.col(order).alias("_o"), F.col(rect).alias("_r"))
    pairs = paints.select(*group, key, order, F.col(rect).alias("_t")).join(later, list(group)).where((F.col("_o") > F.col(order)) & intersects(F.col("_r"), F.col("_t")))
    covered = union_coverage(pairs, [*group, key], "_r", "_t")
    return covered.where("coverage >= 1 - 1e-9").select(*group, key)


def quads_overlap(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> bool:
    """Whether two convex quads overlap by more than `least` along every axis of their sides."""
    for quad in (a, b):
        for side in np.roll(quad, -1, 0) - quad:
            axis = np.array([-side[1], side[0]])
            size = np.hypot(*axis)
            if size == 0:
                continue
            p, q = a @ (axis / size), b @ (axis / size)
            if min(p.max(), q.max()) - max(p.min(), q.min()) <= least:
                return False
    return True


def clipped_area(a: np.ndarray, b: np.ndarray) -> float:
    """The common area of two convex counter-clockwise polygons."""
    out = list(map(tuple, a))
    for (x0, y0), (x1, y1) in zip(b, np.roll(b, -1, 0)):
        inside = [(x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) for x, y in out]
        new = []
        for i, p in enumerate(out):
            j = (i + 1) % len(out)
            if inside[i] >= 0:
                new.append(p)
            if (inside[i] > 0) != (inside[j] > 0) and inside[i] != inside[j]:
                t = inside[i] / (inside[i] - inside[j])
                new.append((p[0] + t * (out[j][0] - p[0]), p[1] + t * (out[j][1] - p[1])))
        out = new
        if not out:
            return 0.0
    xy = np.array(out)
    n = np.roll(xy, -1, 0)
    return abs(float((xy[:, 0] * n[:, 1] - n[:, 0] * xy[:, 1]).sum())) / 2


def select_lines(lines: DataFrame, words: DataFrame, page: str = "page", min_confidence: float = 0.97) -> DataFrame:
    """(page, line, status) of recognised lines: accepted, or the first reason against.

    Reasons in order: blank, unreviewed, low-confidence, native-overlap (with a word already on the
    page), duplicate (over 0.6 of the smaller area of a line accepted before; the surest go first).
    Lines are (page, line, text, confidence, reviewed, quad), words (page, quad); a quad is eight
    numbers, counter-clockwise. The choice is sequential within a page, so a page is one task's.
    """
    kinds = dict(lines.dtypes)

    def each(columns: list[list]) -> list[tuple]:
        rows = list(zip(*columns[1:]))
        quads = [np.array(r[4], np.float64).reshape(4, 2) for r in rows]
        boxes = [q for q, r in zip(quads, rows) if r[5]]
        missing = lambda v: v is None or v != v

        def place(k: int) -> tuple:
            line, _, sure = rows[k][:3]
            return missing(sure), 0.0 if missing(sure) else -sure, -quads[k][:, 1].max(), quads[k][:, 0].min(), missing(line), 0 if missing(line) else line, k

        status, taken = {}, []
        for k in sorted((k for k, r in enumerate(rows) if not r[5]), key=place):
            q, (_, text, confidence, reviewed) = quads[k], rows[k][:4]
            if not (text or "").strip():
                status[k] = "blank"
            elif not reviewed:
                status[k] = "unreviewed"
            elif not missing(confidence) and confidence < min_confidence:
                status[k] = "low-confidence"
            elif any(quads_overlap(q, w, 0.2) for w in boxes):
                status[k] = "native-overlap"
            elif any(clipped_area(q, t) > 0.6 * min(clipped_area(q, q), clipped_area(t, t)) for t in taken):
                status[k] = "duplicate"
            else:
                status[k] = "accepted"
                taken.append(q)
        return [(columns[0][0], rows[k][0], status[k]) for k in sorted(status)]

    both = lines.select(page, "line", "text", "confidence", "reviewed", "quad", F.lit(False).alias("_word"))
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("line", "text", "confidence", "reviewed")]
    both = both.union(words.select(F.col(page).cast(kinds[page]), *none, "quad", F.lit(True).alias("_word")))
    return in_groups(both, [page], [], each, f"{page} {kinds[page]}, line {kinds['line']}, status string")
