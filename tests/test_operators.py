"""Operators on small rows at both sides of their thresholds."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import fonts, raster, scalars
from vellum.operators import aggregate, classify, dedup, display, graph, policy, runs, sample, spatial


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


# --- checkpoints ---------------------------------------------------------------------------------


def test_checkpointed_rounds_of_joins_keep_a_small_size_estimate(spark):
    """A join's estimate is the product of its sides'; over rounds its digits would fill the driver."""
    from vellum.session import checkpoint

    x = spark.createDataFrame([(i, i % 3) for i in range(6)], "k long, v long")
    for _ in range(6):
        x = checkpoint(x.join(x.select("k", F.col("v").alias("w")), "k").select("k", F.col("w").alias("v")))
        assert x._jdf.queryExecution().logical().stats().sizeInBytes() < 1 << 63
    assert rows(x, "k", "v") == [(i, i % 3) for i in range(6)]
    assert rows(x.join(x.select("k", F.col("v").alias("w")), "k"), "v", "w") == sorted((i % 3, i % 3) for i in range(6))


# --- duplicates ----------------------------------------------------------------------------------


def test_fingerprint_ignores_length_and_map_order(spark):
    df = spark.createDataFrame([(1, b"ab", {"A": "1", "Length": "9", "B": "2"}), (2, b"ab", {"B": "2", "A": "1"}), (3, b"ab", {"A": "12"}), (4, None, {}), (5, b"a", {"A": "1", "B": "2"})], "id int, p binary, d map<string,string>")
    got = {r.id: r.f for r in df.select("id", dedup.fingerprint(F.col("p"), F.col("d"), "x").alias("f")).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and got[5] != got[1]


def test_duplicates_by_role(spark):
    df = spark.createDataFrame([("aa", "x"), ("aa", "x"), ("bbb", "x"), ("bbb", "y"), ("bbb", None), ("c", None), ("c", None), ("d", "x"), (None, "x"), (None, "x")], "p string, r string")
    assert rows(dedup.duplicate_stats(df, "p"), "duplicate_groups", "wasted_bytes") == [(3, 2 + 6 + 1)]
    assert rows(dedup.duplicate_roles(df, "p", "r"), "role", "duplicate_groups", "wasted_bytes") == [("mixed", 1, 6), ("other", 1, 1), ("x", 1, 2)]


def test_redirects_are_followed_to_their_end(spark):
    moved = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8)], "key long, canonical long")
    edges = spark.createDataFrame([(1, 5), (1, 4), (2, 9), (2, 7), (3, None)], "src long, dst long")
    assert sorted(((a, b or -1) for a, b in rows(dedup.rewrite_references(edges, moved).fillna(-1), "src", "dst"))) == [(1, 1), (1, 1), (2, 7), (2, 8), (3, -1)]


def test_fixed_point_joins_equal_cycles(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (11, "a"), (12, "b"), (21, "a"), (22, "c")], "key long, body string")
    edges = spark.createDataFrame([(1, "n", 2), (2, "n", 1), (11, "n", 12), (12, "n", 11), (21, "n", 22), (22, "n", 21)], "src long, slot string, dst long")
    assert rows(dedup.fixed_point_canonical(nodes, edges), "key", "canonical") == [(1, 1), (2, 2), (11, 1), (12, 2), (21, 21), (22, 22)]


def test_scoped_gate_straddles(spark):
    df = spark.createDataFrame([("a", 1, 1024), ("a", 2, 1024), ("b", 1, 1023), ("b", 2, 1023), ("c", 1, 5000), ("c", 1, 5000)], "fp string, scope int, size long")
    assert rows(dedup.scoped_duplicates(df, "fp", "scope", "size"), "fp", "copies", "scopes", "saved") == [("a", 2, 2, 1024)]


# --- aggregates and scalars ----------------------------------------------------------------------


def test_byte_statistics(spark):
    df = spark.createDataFrame([(1, b""), (2, b"\0" * 8), (3, bytes(range(256))), (4, None), (5, b"ab\n\x7f")], "id int, p binary")
    assert rows(aggregate.byte_statistics(df, "id", "p"), "id", "bytes", "entropy", "unique_values", "zero_bytes", "ascii_like") == [(1, 0, 0.0, 0, 0, 0), (2, 8, 0.0, 1, 8, 0), (3, 256, 8.0, 256, 1, 98), (4, 0, 0.0, 0, 0, 0), (5, 4, 2.0, 4, 0, 3)]


def test_buckets(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (1, 1, 0.25), (1023, 511, 7.74), (1024, 1024, 7.75), (2**62, 2**50, 8.0)], "n long, part long, e double")
    got = rows(df.select(scalars.log2_bucket("n").alias("l"), scalars.ratio_decile("part", "n").alias("d"), scalars.entropy_half_bits("e").alias("h")), "l", "d", "h")
    assert got == sorted([(0, 0, 0), (0, 10, 1), (9, 4, 15), (10, 10, 16), (62, 0, 16)])
    gate = spark.createDataFrame([(1000, 950), (1000, 951), (1000, 1000), (0, 0), (100, 120)], "b long, a long")
    assert rows(gate.where(scalars.passes_savings("b", "a", 20, 5)), "b", "a") == [(1000, 950)]
    assert rows(gate.select(scalars.savings_percent(scalars.signed_delta("b", "a"), "b").alias("p")), "p") == [(-20.0,), (0.0,), (0.0,), (4.9,), (5.0,)]
    sizes = spark.createDataFrame([(128, 200), (129, 129), (65536, 65537), (129, 128)], "w long, h long")
    assert rows(sizes.where(scalars.large_enough("w", "h")), "w", "h") == [(129, 129), (65536, 65537)]


def test_text_functions(spark):
    df = spark.createDataFrame([(1, "﻿Hé".encode("utf-16-be")), (2, b"\xff\xfe" + "Hé".encode("utf-16-le")), (3, "Hé".encode()), (4, b"a\xffb"), (5, b"\xfe\xff\0A\0")], "id int, b binary")
    assert rows(df.select("id", scalars.decode_text_string("b").alias("t")), "id", "t") == [(1, "Hé"), (2, "Hé"), (3, "Hé"), (4, "a�b"), (5, "A")]
    one = spark.createDataFrame([("aaaa.a.",)], "t string")
    assert rows(one.select(scalars.overlapping_count("t", "aa").alias("n"), scalars.overlapping_count("t", "a.").alias("m"), scalars.utf16be_hex(F.lit("A😀")).alias("h")), "n", "m", "h") == [(3, 2, "FEFF0041D83DDE00")]
    assert rows(one.select(scalars.quantised(F.lit(0.0005), 1000).alias("a"), scalars.quantised(F.lit(-0.0005), 1000).alias("b"), scalars.quantised(F.lit(1e9), 1000).alias("c"), scalars.exact_double(F.lit(2**53 + 1)).isNull().alias("d")), "a", "b", "c", "d") == [(1, -1, 2147483647, True)]


def test_mode_breaks_ties_to_the_smallest(spark):
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate([0, 1, 2, 4, 6, 6, 7])], "g string, o int, v double")
    assert rows(aggregate.mode_of_deltas(df, "g", ["o"], "v", least_support=2), "pitch", "support", "total") == [(1.0, 3, 5)]
    assert aggregate.mode_of_deltas(df, "g", ["o"], "v").count() == 0
    values = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", float("nan")), ("b", 4.0), ("b", 9.0), ("c", 0.0)], "g string, v double")
    assert rows(values.groupBy("g").agg(aggregate.upper_median("v").alias("m")).fillna(-1), "g", "m") == [("a", 3.0), ("b", 4.0), ("c", -1.0)]
    hist = spark.createDataFrame([("x", 1, 2), ("x", 5, 2), ("y", 7, 1)], "g string, b int, n long")
    assert rows(aggregate.histogram_median(hist, ["g"], "b", "n"), "g", "median") == [("x", 1), ("y", 7)]


def test_geometry(spark):
    r = lambda *v: scalars.rect(*map(F.lit, v))
    m = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("abcdef", (0, 1, -1, 0, 10, 0))])
    a, b = r(0, 0, 10, 10), r(5, 10, 15, 20)
    df = spark.range(1).select(
        scalars.area(a).alias("area"), scalars.coverage(r(0, 0, 5, 10), a).alias("cover"), scalars.gap(a, r(13, 14, 20, 20)).alias("gap"), scalars.intersection(a, b).isNull().alias("none"),
        scalars.transformed_bounds(r(1, 2, 3, 4), m).alias("t"), scalars.off_axis_degrees(F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (1.0, 1.0, -1.0, 1.0, 0.0, 0.0))])).alias("turn"),
        scalars.signed_area(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3))])).alias("quad"),
        scalars.valid_quad(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (0, 3), (2, 3), (2, 0))])).alias("valid"),
    ).first()
    assert (df.area, df.cover, df.gap, df.none, df.quad, df.valid) == (100, 0.5, 5, True, 6, False)
    assert tuple(df.t) == (6, 1, 8, 3) and abs(df.turn - 45) < 1e-9


# --- runs ----------------------------------------------------------------------------------------


def test_runs_and_barriers(spark):
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate("aabBbbba")] + [("t", 0, "a")], "s string, o int, k string")
    assert rows(runs.state_runs(df, ["s"], ["o"], ["k"], 2), "s", "k", "length") == [("s", "a", 2), ("s", "b", 3)]
    assert rows(runs.dead_duplicates(df, ["s"], ["o"], "k", F.col("k") == "B"), "s", "o") == [("s", 0), ("s", 4), ("s", 5)]
    assert rows(runs.boundary_pairs(df.withColumn("key", F.lit(1)), ["s"], ["o"], "k", "key", "b", "B"), "o") == [(2,)]
    assert rows(runs.batches(df, ["s"], ["o"], 3), "s", "o", "batch")[-2:] == [("s", 7, 2), ("t", 0, 0)]
    places = df.withColumns({"start": F.col("o") * 10, "end": F.col("o") * 10 + F.when(F.col("o") == 4, 5).otherwise(10)})
    touching = F.col("start") == F.col("prev_end")
    assert rows(runs.state_runs(places, ["s"], ["o"], ["k"], 2, touching), "s", "k", "length") == [("s", "a", 2), ("s", "b", 2)]


def test_repetition_and_persistence(spark):
    df = spark.createDataFrame([(1, "w", 21)] * 2 + [(2, "w", 21)] * 3 + [(3, "v", 30), (4, "z", 5)] + [(5, f"m{i}", 20) for i in range(8)], "page int, p string, size int")
    got = rows(runs.repeated_within(df, "page", "p", F.col("size") >= 24, F.col("size") >= 20), "page")
    assert got == [(2,)] * 3 + [(3,)] + [(5,)] * 8
    seen = spark.createDataFrame([("all", p) for p in range(4)] + [("late", p) for p in (1, 2, 3)] + [("early", p) for p in (0, 1, 2)] + [("all", 0)], "k string, page int")
    assert rows(runs.persistent_members(seen, "k", "page", 4), "k", "support", "mode") == [("all", 4, "all"), ("late", 3, "after-first")]


def slow_groups(objects, pages, most=12.0):
    """Seeds in order, each taking the nearest free object of every page, page by page."""
    free, out = dict((o[2], o) for o in objects), []
    for first, mode in ((0, "all"), (1, "after-first")):
        for seed in sorted(i for i, o in free.items() if o[1] == first) if pages - first >= 3 else []:
            k, _, _, x, y = free[seed]
            got = [seed]
            for p in range(first + 1, pages):
                near = [(abs(o[3] - x) + abs(o[4] - y), i) for i, o in free.items() if o[0] == k and o[1] == p and abs(o[3] - x) <= most and abs(o[4] - y) <= most]
                got += [min(near)[1]] if near else []
            if len(got) == pages - first:
                out += [(k, seed, mode, first + n, i) for n, i in enumerate(got)]
                for i in got:
                    del free[i]
    return sorted(out)


def test_groups_that_stay_in_place(spark):
    schema = "key string, page int, item long, x double, y double"
    line = [("k", p, i, float(x), 0.0) for i, (p, x) in enumerate([(0, 0), (1, 1), (2, 2), (0, 100), (1, 100), (2, 112.5), (1, 300), (2, 300), (0, 4)])]
    rng = np.random.default_rng(4)
    many = [(str(rng.choice(["a", "b"])), int(rng.integers(0, 4)), 100 + i, float(rng.integers(0, 60)), float(rng.integers(0, 30))) for i in range(90)]
    for objects, pages in ((line, 3), (many, 4)):
        got = display.persistent_groups(spark.createDataFrame(objects, schema), pages)
        want = slow_groups(objects, pages)
        assert rows(got, "key", "seed", "mode", "page", "item") == want and want
    assert display.persistent_groups(spark.createDataFrame(line, schema), 2).count() == 0


# --- policies and classifiers --------------------------------------------------------------------


def test_policies(spark):
    df = spark.createDataFrame([(1, {"Type": "a", "Thumb": "b", "Tabs": "c", "Odd": "d", "Metadata": "e"})], "id int, d map<string,string>")
    kept = lambda preset: set(policy.project_dictionary(df, "d", policy.PAGE_KEYS, policy.PRESETS[preset]).first().d)
    assert kept("functional") == {"Type", "Tabs", "Odd", "Metadata"} and kept("known-functional") == {"Type", "Tabs"} and kept("visible-surface") == {"Type"}
    findings = spark.createDataFrame([(1, "ocr"), (2, "ocr"), (3, "leak"), (4, "leak"), (5, None)], "id int, category string")
    over = spark.createDataFrame([(1, "remove"), (3, "keep")], "id int, action string")
    default = spark.createDataFrame([("leak",)], "category string")
    assert rows(policy.apply_overrides(findings, over, default, "id", "category"), "id", "remove") == [(1, True), (2, False), (3, False), (4, True), (5, False)]
    entries = spark.createDataFrame([(1, "Metadata", False), (1, "V", True), (2, "V", False), (2, "Thumb", False), (2, "Keep", True)], "id int, key string, is_field boolean")
    for level, on, left, gone in ((0, (), 5, []), (1, (), 4, [("xmp-reference", 1)]), (2, ("form_values",), 2, [("form-value", 1), ("thumbnail", 1), ("xmp-reference", 1)])):
        stay, counts = policy.scrub(entries, level, on)
        assert stay.count() == left and rows(counts, "label", "removed") == gone
    resources = spark.createDataFrame([("p", "Font", "F1"), ("p", "Font", "F2"), ("q", "Font", "F3")], "scope string, category string, name string")
    used = spark.createDataFrame([("p", "Font", "F1")], "scope string, category string, name string")
    whole = spark.createDataFrame([("p", True), ("q", False)], "scope string, complete boolean")
    assert rows(policy.used_resources(resources, used, ["scope", "category", "name"], whole), "name") == [("F1",), ("F3",)]
    annotations = spark.createDataFrame([("Link", False), ("Widget", True), ("Note", None)], "s string, p boolean")
    assert rows(annotations.where(policy.keeps_annotation(F.col("s"), F.col("p"), {"forms"}, True)), "s") == [("Note",), ("Widget",)]


def test_page_and_document_classes(spark):
    facts = [(0, 0.0, 0, 0, 0, True, "blank"), (0, 0.0, 0, 0, 0, False, "unknown"), (1, 0.98, 0, 1, 0, True, "raster"), (1, 0.9799, 0, 1, 0, True, "native"), (2, 0.5, 1, 1, 0, True, "mixed"), (2, 0.4999, 1, 1, 0, True, "native"), (2, 0.99, 0, 1, 1, True, "unknown"), (1, 0.0, 0, 0, 1, False, "native")]
    df = spark.createDataFrame(facts, "paints int, coverage double, native int, images int, unknown int, complete boolean, want string")
    got = df.select("want", classify.page_class(*map(F.col, ("paints", "coverage", "native", "images", "unknown", "complete"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    pages = [("a", "raster")] * 9 + [("a", "native")] + [("b", "raster")] * 8 + [("b", "native")] + [("c", "blank")] + [("d", "unknown")] * 2 + [("e", "raster")] * 9 + [("e", "unknown")]
    found = classify.document_class(spark.createDataFrame(pages, "doc string, kind string"), "doc", "kind")
    assert rows(found, "doc", "representation") == [("a", "mostly-raster"), ("b", "mixed"), ("c", "blank"), ("d", "unknown"), ("e", "mixed")]


def test_stream_roles(spark):
    edges = spark.createDataFrame([(1, "Metadata", 5), (2, "Mask", 6), (2, "SMask", 6), (3, "Function", 7), (4, "XFA", 7), (9, "Contents", 8)], "src long, key string, dst long")
    pages = spark.createDataFrame([(9,)], "node long")
    assert rows(classify.incoming_roles(edges, pages), "node", "roles") == [(5, ["metadata"]), (6, ["image-mask"]), (7, ["function", "xfa"]), (8, ["page-content"])]


# --- samples -------------------------------------------------------------------------------------


def test_samples(spark):
    df = spark.createDataFrame([("d", 1, "b", 5), ("d", 1, "a", 6), ("d", 2, "c", 50), ("e", 1, "0", 4)], "doc string, shape int, digest string, size long")
    assert rows(sample.digest_sample(df, "doc", ["shape"], "digest"), "doc", "digest") == [("d", "a"), ("d", "c"), ("e", "0")]
    assert rows(sample.budget_fold(df, ["digest"], "size", 3, 12, 20), "digest") == [("0",), ("a",)]
    assert [r.doc for r in sample.top_by(df, "size", ["doc", "digest"], 2).collect()] == ["d", "d"]


# --- spatial -------------------------------------------------------------------------------------

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(spark, values, extra=""):
    return spark.createDataFrame(values, f"g string, id long, ord long, rect {BOX}{extra}")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 12)] * 4), max_size=8))
def test_union_area_counts_cells(rects):
    cells = np.zeros((12, 12), bool)
    for a, b, c, d in rects:
        cells[min(b, d) : max(b, d), min(a, c) : max(a, c)] = True
    made = np.array([(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in rects], float).reshape(-1, 4)
    assert abs(spatial.union_area(made) - cells.sum()) < 1e-9


def test_covers_and_neighbours(spark):
    texts = boxes(spark, [("p", 1, 1, (10.0, 10.0, 20.0, 20.0)), ("p", 2, 9, (10.0, 10.0, 20.0, 20.0)), ("q", 3, 1, (10.0, 10.0, 20.0, 20.0))])
    covers = boxes(spark, [("p", 10, 5, (0.0, 0.0, 20.0, 19.7)), ("p", 11, 4, (0.0, 0.0, 20.0, 19.6)), ("p", 12, 7, (0.0, 0.0, 500.0, 500.0))])
    assert rows(spatial.first_later_cover(texts, covers, ["g"], 50.0), "id", "cover_ord") == [(1, 5)]
    near = boxes(spark, [("p", i, 0, (float(x), 0.0, float(x + 10), 10.0)) for i, x in ((1, 0), (2, 14), (3, 29), (4, 200))] + [("q", 5, 0, (12.0, 0.0, 13.0, 9.0))])
    assert rows(spatial.proximity_components(near, ["g"], "id", 5.0, 40.0), "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    a = spark.createDataFrame([("k", 1, 0.0, 0.0), ("k", 2, 50.0, 0.0), ("m", 3, 0.0, 0.0)], "key string, a int, x double, y double")
    b = spark.createDataFrame([("k", 7, 12.0, 1.0), ("k", 8, 5.0, 8.0), ("k", 9, 62.1, 0.0), ("m", 6, 3.0, 12.5)], "key string, b int, x double, y double")
    assert rows(spatial.nearest_in_band(a, b, "key", "a", "b", ["x", "y"]), "a", "b", "distance") == [(1, 7, 13.0)]
    paints = boxes(spark, [("p", 1, 1, (0.0, 0.0, 10.0, 10.0), False), ("p", 2, 2, (0.0, 0.0, 6.0, 10.0), True), ("p", 3, 3, (5.0, 0.0, 10.0, 10.0), True), ("p", 4, 0, (0.0, 0.0, 11.0, 10.0), False)], ", opaque boolean")
    assert rows(spatial.occluded(paints, ["g"]), "id") == [(1,)]


def test_line_selection(spark):
    quad = lambda x, y, w=10, h=5: [float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)]
    lines = [(0, 1, "good", 0.99, True, quad(0, 0)), (0, 2, " ", 0.99, True, quad(50, 0)), (0, 3, "x", 0.99, False, quad(60, 0)), (0, 4, "x", 0.96, True, quad(70, 0)), (0, 5, "x", 0.99, True, quad(100, 0)), (0, 6, "again", 0.98, True, quad(2, 0)), (0, 7, "beside", 0.98, True, quad(5, 0))]
    words = [(0, quad(105, 1))]
    got = spatial.select_lines(spark.createDataFrame(lines, "page int, line int, text string, confidence double, reviewed boolean, quad array<double>"), spark.createDataFrame(words, "page int, quad array<double>"))
    assert [s for _, s in rows(got, "line", "status")] == ["accepted", "blank", "unreviewed", "low-confidence", "native-overlap", "duplicate", "accepted"]


# --- graphs --------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(6000, 6300)] + [(9, 9), (8888, 8888)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*pairs, (None, 3), (3, None)], "a long, b long").repartition(5)
    assert rows(graph.connected_components(df), "node", "component") == sorted((n, find(n)) for n in root)
    assert graph.connected_components(df.where("a < -1")).count() == 0


def test_chains_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, "root" if not i else None) for i in range(300)], "id long, up long, v string")
    assert rows(graph.inherited(chain, "id", "up", ["v"]).groupBy("v").count(), "v", "count") == [("root", 300)]
    ring = spark.createDataFrame([(i, (i + 1) % 5, None) for i in range(5)], "id long, up long, v string")
    assert graph.inherited(ring, "id", "up", ["v"]).where("v IS NULL").count() == 5
    moved = spark.createDataFrame([(i + 1, i) for i in range(200)], "key long, canonical long")
    edges = spark.createDataFrame([(1, 200), (2, 150)], "src long, dst long")
    assert rows(dedup.rewrite_references(edges, moved), "src", "dst") == [(1, 0), (2, 0)]
    with pytest.raises(ValueError, match="circle"):
        dedup.rewrite_references(edges, moved.union(spark.createDataFrame([(0, 200)], moved.schema)))
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert graph.reachable(path, spark.createDataFrame([(0,)], "node long")).count() == 41


def test_fixed_point_of_deep_differences(spark):
    """Two chains that are equal but for their last nodes differ all the way up."""
    n = 66
    nodes = spark.createDataFrame([(c * 1000 + i, "end" + str(c) if i == n else "link") for c in (0, 1, 2) for i in range(n + 1)], "key long, body string")
    nodes = nodes.withColumn("body", F.when(F.col("key") == 2000 + n, "end0").otherwise(F.col("body")))
    edges = spark.createDataFrame([(c * 1000 + i, "next", c * 1000 + i + 1) for c in (0, 1, 2) for i in range(n)], "src long, slot string, dst long")
    got = dict(rows(dedup.fixed_point_canonical(nodes, edges), "key", "canonical"))
    assert all(got[i] == i and got[1000 + i] == 1000 + i and got[2000 + i] == i for i in range(n + 1))


def test_reachability_inheritance_and_trees(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (3, 99), (6, None)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.reachable(edges, roots), "node") == [(1,), (2,), (3,), (99,)]
    nodes = spark.createDataFrame([(n,) for n in range(1, 7)], "node long")
    assert rows(graph.unreachable(nodes, edges, roots), "node") == [(4,), (5,), (6,)]
    tree = spark.createDataFrame([(1, None, "a", None), (2, 1, None, "x"), (3, 2, None, None), (4, 5, None, None), (5, 4, None, "z")], "id long, up long, v string, w string")
    got = rows(graph.inherited(tree, "id", "up", ["v", "w"]).fillna("-"), "id", "v", "w")
    assert got == [(1, "a", "-"), (2, "a", "x"), (3, "a", "x"), (4, "-", "z"), (5, "-", "z")]
    level = rows(graph.fan_out(spark.range(70).repartition(7), ["id"], 8, "id"), "level", "node", "low", "high", "children")
    assert level[:2] == [(0, 0, 0, 7, 8), (0, 1, 8, 15, 8)] and level[-3:] == [(1, 0, 0, 63, 8), (1, 1, 64, 69, 1), (2, 0, 0, 69, 2)]
    actions = spark.createDataFrame([(1, "GoTo"), (2, "URI"), (3, "Launch"), (4, "GoTo")], "node long, kind string")
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert rows(graph.dangerous_chains(actions, chain, list(policy.DANGEROUS_ACTIONS)), "node") == [(1,), (2,), (3,)]
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "c"), (3, 0, "a"), (3, 1, "b")], "c int, t int, r string")
    assert rows(graph.shared_prefixes(turns, "c", "t", "r"), "depth", "sequences", "example") == [(1, 3, 1), (2, 2, 1)]


# --- display lists, pixels and fonts -------------------------------------------------------------


def test_display_folds(spark):
    assert display.remove_ranges(b"0123456789", [(5, 7), (1, 3), (2, 4)]) == b"04789"
    assert display.replace_ranges(b"abcdef", [(4, 5, b"X"), (0, 2, b"")]) == b"cdXf" and display.replace_ranges(b"abcdef", [(0, 3, b""), (2, 4, b"")]) is None
    once = display.normal_form(b"q  1 0 0 1 5.50 2 cm\t/A  gs Q")
    assert once == b"q\n1 0 0 1 5.5 2 cm\n/A gs\nQ" and display.normal_form(once) == once and display.normal_form(b"q (open") == b"q (open"
    assert display.merge_run([(0, 0, 5, 1), (5, 0, 9, 1), (9, 0, 12, 1), (0, 5, 1, 6)], ["k", "k", "r", "r"]) == [((0, 0, 9, 1), 2), ((9, 0, 12, 1), 1), ((0, 5, 1, 6), 1)]
    assert display.drop_collinear([(0, 0), (1, 1), (2, 2), (1, 1), (1, 5)]) == [(0, 0), (2, 2), (1, 1), (1, 5)]
    assert display.simplify([(0, 0), (1, 0.004), (2, 0), (3, 0.1), (4, 0)]) == [0, 2, 3, 4]
    assert display.snap_coordinate(1.004) == 1.0 and display.snap_coordinate(1.004, unit=2) == 1.004
    assert display.paint_batches(["f"] * 5 + ["S"], [(0, 0, 1, 1), (0, 0, 2, 2), (1, 1, 2, 2), (9, 9, 10, 10), None, (0, 0, 1, 1)], [1, 1, -1, -1, 1, 1]) == [0, 0, 1, 1, 2, 3]
    assert max(display.paint_batches(["f"] * 130, [(0, 0, 1, 1)] * 130, [1] * 130)) == 2
    stripes = [("v", i, "a" if i < 3 else "b", 20, 2, 0, 2 * i) for i in range(5)] + [("h", i, "a", 2, 20, 30 - 2 * i, 5) for i in range(4)] + [("h", 9, "a", 20, 2, 0, 0)]
    stripes += [("thin", i, "a", 5, 1, 0, i) for i in range(4)] + [("apart", i, "a", 20, 2, 0, 4 * i) for i in range(4)] + [("wide", i, "a", 20, 11, 0, 11 * i) for i in range(4)]
    draws = spark.createDataFrame(stripes, "s string, o int, state string, width int, height int, x int, y int")
    assert rows(display.stripe_runs(draws, ["s"], ["o"]), "s", "axis", "first", "members") == [("h", "horizontal", 0, 4), ("v", "vertical", 0, 3)]
    plans = [(1, 1.0), (2, 5.0), (3, 1.0), (4, 0.5), (5, 0.1)]
    members = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 4), (4, 1), (4, 9)]
    stand = display.claim(spark.createDataFrame(plans, "plan long, priority double"), spark.createDataFrame(members, "plan long, member long"))
    assert rows(stand, "plan") == [(2,), (3,), (4,), (5,)]
    with pytest.raises(ValueError, match="occurrence 0"):
        display.match_quads([[0, 0.04]], [[0, 0]])


def test_display_columns(spark):
    df = spark.createDataFrame([(1, b"0123456789", [(5, 7), (1, 3), (2, 4)], [(4, 5, b"X"), (0, 2, b"")]), (2, b"ab", None, [(0, 2, b""), (1, 2, b"")]), (3, None, [(0, 1)], None)], "id int, d binary, r array<struct<start:long,end:long>>, p array<struct<start:long,end:long,new:binary>>")
    got = {r.id: (r.a and bytes(r.a), r.b and bytes(r.b)) for r in df.select("id", display.without_ranges("d", "r").alias("a"), display.with_replacements("d", "p").alias("b")).collect()}
    assert got == {1: (b"04789", b"23X56789"), 2: (b"ab", None), 3: (None, None)}
    rects = spark.createDataFrame([("s", 1, 5.0, 0.0, 9.0, 1.0, "k"), ("s", 0, 0.0, 0.0, 5.0, 1.0, "k"), ("s", 2, 9.0, 0.0, 12.0, 1.0, "r"), ("t", 0, 0.0, 0.0, 1.0, 1.0, "k")], "s string, o int, x0 double, y0 double, x1 double, y1 double, colour string")
    assert rows(display.merged_rects(rects, ["s"], ["o"]), "s", "run", "x0", "x1", "members") == [("s", 0, 0.0, 9.0, 2), ("s", 1, 9.0, 12.0, 1), ("t", 0, 0.0, 1.0, 1)]
    paints = rects.withColumns({"kind": F.lit("f"), "winding": F.when(F.col("o") == 1, -1).otherwise(1), "x0": F.when(F.col("s") == "s", F.col("x0"))})
    assert rows(display.paint_runs(paints, ["s"], ["o"]), "s", "o", "batch") == [("s", 0, 0), ("s", 1, 0), ("s", 2, 0), ("t", 0, 0)]
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (1.0, 1.0)]), (2, [])], "id int, p array<struct<x:double,y:double>>")
    found = {r.id: ([tuple(q) for q in r.c], [tuple(q) for q in r.d]) for r in lines.select("id", display.without_collinear("p").alias("c"), display.simplified("p").alias("d")).collect()}
    assert found == {1: ([(0, 0), (2, 2), (1, 1)], [(0, 0), (2, 2), (1, 1)]), 2: ([], [])}
    values = spark.createDataFrame([(1, 1.004), (2, 1.0075), (3, float("inf"))], "id int, v double")
    assert rows(values.select("id", display.snapped("v").alias("a"), display.snapped("v", 2.0).alias("b")), "id", "a", "b") == [(1, 1.0, 1.004), (2, 1.01, 1.01), (3, float("inf"), float("inf"))]
    quads = lambda *v: spark.createDataFrame([(i, [float(x) for x in q]) for i, q in v], "id int, quad array<double>")
    assert rows(display.mismatched_quads(quads((1, (0, 0)), (2, (0, 0.04)), (3, (1, 1))), quads((1, (0, 0.02)), (2, (0, 0)), (4, (1, 1))), ["id"]), "id") == [(2,), (3,), (4,)]


def test_pixels():
    rng = np.random.default_rng(0)
    gray = (rng.integers(0, 2, 35) * 255).astype(np.uint8).tobytes()
    assert raster.unpack_bilevel(raster.pack_bilevel(gray, 7, 5), 7, 5) == gray and raster.pack_bilevel(b"\1", 1, 1) is None
    alpha = np.zeros((5, 6), np.uint8)
    assert raster.alpha_crop(alpha.tobytes(), 6, 5) is None
    alpha[1:4, 2:5] = 9
    assert raster.alpha_crop(alpha.tobytes(), 6, 5) == (2, 1, 3, 3)
    image = np.full((6, 6, 3), 200, np.uint8)
    image[2, 3] = 10
    assert raster.border_sample(image.tobytes(), 6, 6, 3) == b"\xc8" * 3 and raster.background_crop(image.tobytes(), 6, 6, 3, b"\xc8" * 3, 4) == (3, 2, 1, 1)
    paper = np.full((1000, 3), (240, 238, 236), np.uint8)
    paper[:100] = 0
    assert raster.paper_background(paper.tobytes(), 1000) == (240, 238, 236) and raster.paper_background(paper.tobytes(), 1001) is None
    paper[:151] = 0
    assert raster.paper_background(paper.tobytes(), 1000) is None
    palette, index, error = raster.quantise(image.tobytes(), 2)
    assert error == 0 and len(palette) == 6 and len(index) == 36


def test_fonts():
    head = bytes(range(54))
    found = {t: t.encode() * 3 for t in ("glyf", "hhea", "hmtx", "loca", "maxp", "cmap", "GPOS", "kern")} | {"head": head}
    data = fonts.build(found)
    assert {k: v for k, v in fonts.tables(data).items() if k != "head"} == {k: v for k, v in found.items() if k != "head"}
    assert fonts.checksum(data) == 0xB1B0AFBA
    small, gone = fonts.strip_unused(data)
    assert gone > 0 and set(fonts.tables(small)) == set(found) - {"GPOS", "kern"} and fonts.strip_unused(small) is None
    bare, _ = fonts.strip_cmap(small)
    assert "cmap" not in fonts.tables(bare) and fonts.skeleton_hash(bare) != fonts.skeleton_hash(small)
    other = fonts.build(found | {"glyf": b"else", "loca": b"else"})
    assert fonts.skeleton_hash(other) == fonts.skeleton_hash(data) and fonts.tables(b"no") is None
    assert fonts.dense_numbers([9, 3]) == {0: 0, 3: 1, 9: 2}


def test_proximity_of_all_documents(spark, tmp_path):
    """The whole query against brute force over every box, beyond id 600 too."""
    import math
    from collections import defaultdict

    from vellum.plans import load
    from vellum.plans.registry import QUERIES

    load()
    spark.range(1000).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    boxes = {d: (d * 37 % 500, d * 91 % 700) for d in range(1000) if d % 3}
    pages = defaultdict(list)
    for d in boxes:
        pages[d // 100].append(d)
    root = {d: d for d in boxes}
    for page in pages.values():
        changed = True
        while changed:
            changed = False
            for a in page:
                for b in page:
                    (ax, ay), (bx, by) = boxes[a], boxes[b]
                    if root[b] < root[a] and math.hypot(max(0, abs(ax - bx) - 20), max(0, abs(ay - by) - 10)) <= 14:
                        root[a], changed = root[b], True
    got = {r["id"]: r["component"] for r in QUERIES["proximity_components"](spark, str(tmp_path)).collect()}
    assert got == root
