"""The document adapter on small hand-made files."""

import zlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import codecs
from vellum.sources import cos, documents, text_state


def make(objects: dict[int, bytes], root: int = 1, extra: bytes = b"") -> bytes:
    out = b"%PDF-1.7\n"
    for n, body in objects.items():
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    return out + b"trailer\n<</Root %d 0 R%s>>\nstartxref\n0\n%%%%EOF\n" % (root, extra)


def stream(data: bytes, head: bytes = b"") -> bytes:
    return b"<<%s/Length %d>>\nstream\n" % (head, len(data)) + data + b"\nendstream"


CONTENT = b"""q 0 0 0 rg BT /F1 10 Tf 1 0 0 1 100 100 Tm (secret) Tj ET 90 90 200 50 re f Q
BT /F1 10 Tf 3 Tr 1 0 0 1 10 700 Tm (unseen) Tj ET
BT /F1 10 Tf 0 Tr 1 0 0 1 10 500 Tm (seen \\(here\\)) Tj ET
BT /F1 10 Tf 1 0 0 1 5000 500 Tm (far) Tj ET
/OC /L1 BDC BT /F1 10 Tf 1 0 0 1 10 300 Tm (layer) Tj ET EMC"""
DOC = make(
    {
        1: b"<</Type/Catalog/Pages 2 0 R/OCProperties<</OCGs[7 0 R]/D<</OFF[7 0 R]>>>>>>",
        2: b"<</Type/Pages/Kids[3 0 R 8 0 R]/Count 2/MediaBox[0 0 600 800]>>",
        3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Properties<</L1 7 0 R>>>>>>",
        4: stream(zlib.compress(CONTENT), b"/Filter/FlateDecode"),
        5: b"(nobody refers to this)",
        6: stream(b"x" * 50),
        7: b"<</Type/OCG/Name(a layer)>>",
        8: b"<</Type/Page/Parent 2 0 R/UserUnit -1/CropBox[10 10 50 20]/Contents[6 0 R 99 0 R]>>",
    }
)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs") / "deep"
    folder.mkdir()
    (folder / "a.PDF").write_bytes(DOC)
    (folder.parent / "bad.pdf").write_bytes(b"not at all")
    (folder / "locked.pdf").write_bytes(make({1: b"<</Type/Catalog>>"}, extra=b"/Encrypt 5 0 R"))
    (folder / "skip.txt").write_bytes(DOC)
    return documents.scan_files(spark, str(folder.parent))


def test_scans(files):
    assert files.count() == 3
    objects = {r.num: r for r in documents.scan_objects(files).collect()}
    assert sorted(objects) == list(range(1, 9)) and objects[4].type == "stream" and objects[4].filters == ["FlateDecode"]
    assert objects[3].kind == "Page" and objects[5].type == "string" and objects[4].raw_len == len(zlib.compress(CONTENT))
    edges = {(r.src, r.key, r.dst) for r in documents.scan_edges(files).collect()}
    assert {(0, "Root", 1), (2, "Kids", 3), (3, "Contents", 4), (8, "Contents", 99)} <= edges
    pages = documents.scan_pages(files).orderBy("page").collect()
    assert [(p.num, p.x1, p.y1, p.user_unit) for p in pages] == [(3, 600, 800, 1.0), (8, 50, 20, None)]
    failed = documents.failure_report(documents.scan_failures(files)).first()
    assert failed.failed == 2 and "Encrypted" in failed.examples[1].error


def test_instructions_and_normal_form(files):
    rows = documents.parse_content(documents.scan_pages(files).where("page = 0")).orderBy("seq").collect()
    assert [r.op for r in rows[:4]] == ["q", "rg", "BT", "Tf"] and all(r.complete for r in rows)
    assert rows[5].operands[0].str == b"secret" and rows[3].operands[1].num == 10
    found, whole = cos.instructions(b"BI /W 2 /H 1 ID \x00EI\xff EI Q (cut")
    assert [x.op for x in found] == ["BI", "Q"] and found[0].operands[1] == b"\x00EI\xff" and not whole


def test_hidden_text(files):
    found = {bytes(r.text): r for r in text_state.hidden_text(text_state.scan_events(files)).collect()}
    assert {k: v.mechanism for k, v in found.items()} == {b"secret": "covered-by-opaque-fill", b"unseen": "rendering-mode-invisible", b"far": "outside-crop-box", b"layer": "optional-content-hidden"}
    assert (found[b"secret"].category, found[b"secret"].action) == ("likely-redaction-leak", "remove")
    assert found[b"layer"].category == "hidden-layer" and found[b"far"].category == "outside-page" and found[b"unseen"].category == "other-invisible"


def test_rewrite_is_idempotent_and_drops_the_unreachable(files):
    out = documents.rewrite(files).collect()
    assert len(out) == 1 and out[0].after == len(out[0].content)
    doc = cos.parse(bytes(out[0].content))
    assert len([o for o in doc.objects.values() if o == b"nobody refers to this"]) == 0 and len(doc.pages()) == 2
    for packed in (True, False):
        once = cos.write(cos.parse(DOC), packed)
        assert cos.write(cos.parse(once), packed) == once
        assert cos.parse(once).content(cos.parse(once).pages()[0][1]) == CONTENT


def test_filters_and_forms(spark):
    data = bytes(range(256)) * 3
    import base64

    assert codecs.decode_filters(base64.a85encode(zlib.compress(data)) + b"~>", ["ASCII85Decode", "FlateDecode"]) == data
    assert codecs.decode_filters(data.hex().encode() + b">", ["AHx"]) == data
    assert codecs.decode_filters(b"\x02abc\xfed\x80rest", ["RunLengthDecode"]) == b"abcddd"
    assert codecs.decode_filters(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), ["LZWDecode"]) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    up = zlib.compress(b"\x02\x01\x02\x03" + b"\x02\x01\x01\x01")
    assert codecs.decode_filters(up, ["FlateDecode"], [{"Predictor": 12, "Columns": 3}]) == bytes([1, 2, 3, 2, 3, 4])
    with pytest.raises(codecs.UnsupportedFilter):
        codecs.decode_filters(b"", ["DCTDecode"])
    rows = documents.decode(spark.createDataFrame([(b"61>", ["AHx"]), (b"x", ["JPXDecode"]), (b"zz", ["FlateDecode"])], "raw binary, filters array<string>")).collect()
    assert bytes(rows[0].decoded) == b"a" and rows[1].decode_error == "unsupported filter JPXDecode" and rows[2].decoded is None
    assert [codecs.real_form(v) for v in (1.5, -0.0, 100.0, 0.00001)] == [b"1.5", b"0", b"100", b"0.00001"]
    with pytest.raises(ValueError, match="finite"):
        codecs.real_form(float("inf"))
    assert codecs.name_form("a b#") == b"/a#20b#23" and codecs.string_form(b"a(b") == b"(a\\(b)" and codecs.string_form(b"\0\1") == b"<0001>"


def test_jpeg_and_maps():
    part = lambda m, body: b"\xff" + bytes([m]) + (len(body) + 2).to_bytes(2, "big") + body
    jpeg = b"\xff\xd8" + part(0xE0, b"JFIF") + part(0xE1, b"Exif...") + part(0xE3, b"abc") + part(0xFE, b"note") + b"\xff\xda\x00\x02scan\xff\xd9"
    clean, removed = codecs.strip_jpeg_metadata(jpeg)
    assert removed == 11 + 8 and b"Exif" not in clean and b"abc" in clean and codecs.strip_jpeg_metadata(clean) == (clean, 0)
    assert b"abc" not in codecs.strip_jpeg_metadata(jpeg, aggressive=True)[0] and codecs.strip_jpeg_metadata(b"\xff\xd8\xff\xe1\xff\xff") is None
    cmap = b"beginbfchar <01> <0041> <02> <D83DDE00> endbfchar beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange"
    assert codecs.parse_to_unicode(cmap) == {b"\1": "A", b"\2": "😀", b"\x10": "a", b"\x11": "b", b"\x12": "c", b"\x20": "x", b"\x21": "y"}
    assert codecs.parse_cid_widths([1, [500, 600], 10, 12, 250, 9]) == {1: 500.0, 2: 600.0, 10: 250.0, 11: 250.0, 12: 250.0}


def test_damaged_documents_still_give_objects():
    cut = DOC[: DOC.index(b"7 0 obj") + 20]
    doc = cos.parse(cut)
    assert len(doc.objects) >= 6 and doc.trailer.get("Root") == cos.Ref(1)
    loop = make({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[2 0 R 3 0 R]>>", 3: b"<</Type/Page>>"})
    assert [r.num for r, _ in cos.parse(loop).pages()] == [3]
    with pytest.raises(ValueError, match="no document"):
        cos.parse(b"hello")


def test_policy_on_objects(files):
    from vellum.operators.graph import unreachable
    from vellum.operators.policy import PAGE_KEYS, PRESETS, project_dictionary

    edges, objects = documents.scan_edges(files), documents.scan_objects(files)
    nodes, roots = objects.select(F.col("num").alias("node")), edges.where("src = 0").select(F.col("dst").alias("node"))
    assert {r.node for r in unreachable(nodes, edges, roots).collect()} == {5}
    page = objects.where("kind = 'Page'").select("num", F.from_json("value", "map<string,string>").alias("d"))
    kept = project_dictionary(page, "d", PAGE_KEYS, PRESETS["visible-surface"]).orderBy("num").collect()
    assert [r.dropped for r in kept] == [0, 0] and "UserUnit" in kept[1].d
