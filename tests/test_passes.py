"""Passes and inventories on files and rows made by hand."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import inventory
from vellum.sources import analysis, cos, documents, passes, text_state

N, R, S = cos.Name, cos.Ref, cos.Stream


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def made(objects, trailer=None):
    return cos.write(cos.Document(objects, trailer or {"Root": R(1)}, "", 0))


def page_of(content, resources=None, catalog=None, page=None, **more):
    objects = {R(1): {"Type": N("Catalog"), "Pages": R(2)} | (catalog or {}), R(2): {"Type": N("Pages"), "Kids": [R(3)], "Count": 1}, R(3): {"Type": N("Page"), "Parent": R(2), "Contents": R(4), "Resources": resources or {}} | (page or {}), R(4): S({}, content)}
    return made(objects | {R(int(k[1:])): v for k, v in more.items()})


def files(spark, *contents):
    return spark.createDataFrame([(f"{i}.pdf", c) for i, c in enumerate(contents)], "path string, content binary")


def test_damaged_files_keep_their_bytes(spark):
    good = page_of(b"q Q", page={"Thumb": R(9)}, o9=S({}, b"t"))
    out = {r.path: r for r in passes.preserve(files(spark, good, b"junk", None), "functional").collect()}
    assert out["0.pdf"].counts == {"thumbnails": 1} and out["0.pdf"].error is None
    assert bytes(out["1.pdf"].content) == b"junk" and out["1.pdf"].error and not out["1.pdf"].counts and out["2.pdf"].error
    none = passes.scrub_files(files(spark, good), 0, packed=False).first()
    assert not none.counts and b"/Thumb" in bytes(none.content)
    assert passes.scrub_files(files(spark, good).where("false"), 2).count() == 0


def test_layers_by_membership(spark):
    shown = lambda policy: {"Type": N("OCMD"), "OCGs": [R(10), R(11)]} | ({"P": N(policy)} if policy else {})
    names = [None, "AllOn", "AnyOff", "AllOff", "AnyOn"]
    content = b"".join(b"/OC /P%d BDC BT /F 9 Tf (t%d) Tj ET EMC " % (i, i) for i in range(5))
    resources = {"Properties": {f"P{i}": shown(p) for i, p in enumerate(names)}}
    groups = {"OCProperties": {"OCGs": [R(10), R(11)], "D": {"OFF": [R(11)]}}}
    data = page_of(content, resources, groups, o10={"Type": N("OCG")}, o11={"Type": N("OCG")})
    found = rows(text_state.scan_events(files(spark, data)), "text", "layer_off")
    assert [off for _, off in found] == [False, True, False, True, False]


def test_forms_in_forms(spark):
    form = lambda body, own=None: S({"Subtype": N("Form"), "Matrix": [2, 0, 0, 2, 0, 0], "Resources": {"XObject": own or {}}}, body)
    data = page_of(b"3 0 0 3 0 0 cm /A Do", {"XObject": {"A": R(10)}}, o10=form(b"/B Do /A Do", {"B": R(11), "A": R(10)}), o11=form(b"/I Do BT /F 1 Tf (x) Tj ET", {"I": R(12)}), o12=S({"Subtype": N("Image")}, b""))
    events = text_state.scan_events(files(spark, data))
    assert rows(events, "event", "depth") == [("form", 0), ("form", 1), ("image", 2), ("text", 2), ("unknown", 1)]
    assert rows(text_state.placements(events), "width", "height", "uses", "complete") == [(12.0, 12.0, 1, True)]
    assert text_state.direct_bindings(events).count() == 0
    broken = page_of(b"/A Do", {"XObject": {"A": R(10)}}, o10=S({"Subtype": N("Form"), "Filter": N("FlateDecode")}, b"no"))
    assert rows(text_state.scan_events(files(spark, broken)), "event", "complete") == [("form", False)]
    unread = page_of(b"x", page={"Contents": R(9)}, o9=S({"Filter": N("FlateDecode")}, b"no"))
    assert rows(text_state.scan_events(files(spark, unread)), "event", "complete") == [("unreadable", False)]


def test_glyph_widths_and_codes(spark):
    fonts = {"Font": {"S": R(10), "W": R(11)}}
    data = page_of(b"BT /S 10 Tf (ab) Tj /W 10 Tf <00050006> Tj ET", fonts, o10={"Subtype": N("Type1"), "FirstChar": 97, "Widths": [1000, 250]}, o11={"Subtype": N("Type0"), "DescendantFonts": [{"W": [5, [300, 700]]}]})
    events = text_state.scan_events(files(spark, data)).where("event = 'text'").orderBy("ord").collect()
    assert [round(r.rect.x1 - r.rect.x0, 6) for r in events] == [12.5, 10.0]
    df = text_state.scan_events(files(spark, data))
    wide = df.where("font IS NOT NULL").select("doc_id", F.max("font").over(__import__("pyspark").sql.Window.partitionBy("doc_id")).alias("font")).distinct()
    assert sorted(tuple(r.codes) for r in text_state.glyph_usage(df, wide).collect()) == [(5, 6), (97, 98)]


def test_flatten_keeps_fields_that_readers_draw(spark):
    widget = {"Subtype": N("Widget"), "Rect": [0, 0, 5, 5], "AP": {"N": R(10)}}
    square = {"Subtype": N("Square"), "Rect": [0, 0, 5, 5], "AP": {"N": {"On": R(10)}}, "AS": N("On")}
    empty = {"Subtype": N("Square"), "Rect": [0, 0, 5, 5], "AP": {"N": R(11)}}
    for needs, left, drawn in ((True, 1, 1), (False, 0, 2)):
        data = page_of(b"", catalog={"AcroForm": {"NeedAppearances": needs}}, page={"Annots": [widget, square, empty]}, o10=S({"Subtype": N("Form"), "BBox": [0, 0, 1, 1]}, b""), o11=S({"BBox": [0, 0, 0, 1]}, b""))
        flat = passes.apply(files(spark, data), [passes.flatten_annotations()])
        assert flat.first().counts["flattened"] == drawn
        page = documents.scan_objects(flat).where("kind = 'Page'").first()
        assert ("Annots" in page["keys"]) == bool(left)


def test_dangerous_chains_and_signatures(spark):
    chain = {"S": N("GoTo"), "Next": [{"S": N("URI")}, R(10)]}
    data = page_of(b"", catalog={"OpenAction": chain, "AcroForm": {"SigFlags": 3}, "Perms": {}}, o10={"S": N("GoTo"), "Next": R(11)}, o11={"S": N("ImportData"), "Next": R(10)}, o12={"FT": N("Sig"), "V": R(13)}, o13={}, page=None)
    data = data.replace(b"", b"")
    out = passes.scrub_files(files(spark, data), 2).first()
    assert out.counts["dangerous-actions"] == 1 and out.counts["signature-values"] == 1
    harmless = page_of(b"", catalog={"OpenAction": {"S": N("GoTo"), "Next": R(10)}}, o10={"S": N("URI"), "Next": R(10)})
    assert "dangerous-actions" not in passes.scrub_files(files(spark, harmless), 2).first().counts


def test_jpeg_markers_are_counted_by_bytes(spark):
    df = spark.createDataFrame([(bytes.fromhex("ffe1ffedfffe0ffe1f"),), (b"",), (b"\xff\xff\xe1",)], "raw binary")
    assert [r[0] for r in df.select(analysis.marker_count("raw")).collect()] == [3, 0, 1]


def test_inventories(spark):
    objects = spark.createDataFrame([("d", 1, "page"), ("d", 2, "image")], "doc_id string, num long, role string")
    edges = spark.createDataFrame([("d", 0, "Root", 1), ("d", 1, "Im", 2), ("d", 1, "Im", 7)], "doc_id string, src long, key string, dst long")
    assert rows(inventory.edge_counts(objects, edges), "source", "key", "target", "edges") == [("page", "Im", "image", 1), ("page", "Im", "missing", 1), ("trailer", "Root", "page", 1)]
    streams = spark.createDataFrame([(1, ["A"], ["FlateDecode"]), (2, ["F"], None), (3, [], None), (4, [], ["FlateDecode", "FlateDecode"]), (5, [], ["DCTDecode"])], "id int, keys array<string>, filters array<string>")
    assert rows(streams.where(inventory.is_plain_stream(F.col("keys"), F.col("filters"))), "id") == [(1,), (3,)]
    twin = page_of(b"", {"ExtGState": {"A": R(10), "B": R(11), "C": R(12)}}, o10={"ca": 0.5}, o11={"ca": 0.5}, o12={"ca": 0.25})
    scanned, links = (f(files(spark, twin)) for f in (documents.scan_objects, documents.scan_edges))
    named = analysis.roles(scanned, links)
    targets = inventory.dedup_targets(named, links)
    assert inventory.exact_twins(named, targets).count() == 1
    assert inventory.has_twins(named, targets, "ext-gstate") and not inventory.has_twins(named, targets, "image")


def test_sinks_refuse_what_exists(spark, tmp_path):
    df = spark.range(3)
    documents.write_report(df, f"{tmp_path}/report")
    with pytest.raises(Exception, match="exists|EXIST"):
        documents.write_report(df, f"{tmp_path}/report")
