"""Document summaries, corpus rankings, risks and incremental ingest."""

from pyspark.sql import functions as F

from vellum.sources import analysis, documents
from vellum.streaming import ingest


def make(objects: dict[int, bytes]) -> bytes:
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n" % n + body + b"\nendobj\n" for n, body in objects.items())
    return out + b"trailer\n<</Root 1 0 R>>\nstartxref\n0\n%%EOF\n"


def stream(data: bytes, head: bytes = b"") -> bytes:
    return b"<<%s/Length %d>>\nstream\n" % (head, len(data)) + data + b"\nendstream"


def sample(extra: bytes) -> bytes:
    return make(
        {
            1: b"<</Type/Catalog/Pages 2 0 R/Metadata 6 0 R/Names<</JS 5 0 R>>>>",
            2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 100 100]>>",
            3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</XObject<</A 7 0 R/B 8 0 R>>>>/Info 0>>",
            4: stream(b"q /A Do Q BT 3 Tr /F 9 Tf (x) Tj ET 0 0 m 5 5 l S" + extra),
            5: stream(b"app.alert(1)"),
            6: stream(b"<xmp/>", b"/Type/Metadata/Subtype/XML"),
            7: stream(b"\1\2\3\4" * 9, b"/Subtype/Image/Width 3/Height 3"),
            8: stream(b"\1\2\3\4" * 9, b"/Subtype/Image/Width 3/Height 3"),
        }
    )


def test_summaries_and_rankings(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sample(b""))
    (tmp_path / "b.pdf").write_bytes(sample(b" % more, so that this is the larger"))
    (tmp_path / "c.pdf").write_bytes(b"junk")
    files = documents.scan_files(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in analysis.summaries(files).collect()}
    assert sorted(rows) == ["a.pdf", "b.pdf"]
    a = rows["a.pdf"]
    assert (a.objects, a.streams, a.pages, a.image_bytes, a.metadata_stream_bytes) == (8, 5, 1, 72, 6)
    assert (a.duplicate_stream_wasted_bytes, a.duplicate_image_wasted_bytes, a.hidden_text_findings) == (36, 36, 1)
    assert (a.draw_total, a.text_show_total, a.path_total, a.paint_total, a.incomplete_pages) == (1, 1, 2, 1, 0)
    top = analysis.corpus_rankings(analysis.summaries(files), 1).where("metric = 'input_bytes'").first()
    assert top.path.endswith("b.pdf") and top["rank"] == 1
    named = {(r.num, r.stream_role or r.role) for r in analysis.roles(documents.scan_objects(files), documents.scan_edges(files)).where(F.col("doc_id") == a.doc_id).collect()}
    assert {(4, "page-content"), (6, "metadata"), (7, "image"), (3, "dict:Page")} <= named
    found = {(r.kind, r["count"]) for r in analysis.risks(files).where("path LIKE '%a.pdf'").collect()}
    assert found == {("javascript", 1), ("info-dictionary", 1)}


def test_ingest_replaces_a_replayed_batch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.pdf").write_bytes(sample(b""))
    scans = {"objects": documents.scan_objects, "failures": documents.scan_failures}
    for name in ("b.pdf", "c.pdf"):
        ingest.ingest(ingest.file_stream(spark, str(source)), scans, str(out), str(tmp_path / "state")).awaitTermination()
        (source / name).write_bytes(b"nothing" if name == "c.pdf" else sample(b" "))
    ingest.ingest(ingest.file_stream(spark, str(source)), scans, str(out), str(tmp_path / "state")).awaitTermination()
    objects = spark.read.parquet(f"{out}/objects")
    assert objects.count() == 16 and objects.select("batch").distinct().count() >= 2
    assert spark.read.parquet(f"{out}/failures").count() == 1


def test_windowed_counts_on_a_table(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = ingest.windowed_counts(events, "ts", "event_type", "1 day")
    assert found.agg(F.sum("events")).first()[0] == events.count()
