"""Queries on tables whose size or shape the smallest tables don't have: results equal to SQL, work in many tasks."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellum.operators import groups, inventory, spatial
from vellum.plans import passes as plans
from vellum.session import spread
from vellum.sources import analysis, cos, documents, text_state


def equals_sql(spark, name: str, folder, *tables: str) -> list[tuple]:
    """The rows of a query over tables in a folder, after comparing them with its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*names).collect())
    assert got == sorted(found.fetchall())
    return got


def test_fixed_point_dedup_looks_as_far_as_its_sql(spark, tmp_path):
    ids = [k * 10**n for k in (1, 2) for n in range(6)]
    rows = [(i, "a" if i == 1 else "b" if i == 2 else "x") for i in ids]
    spark.createDataFrame(rows, "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(equals_sql(spark, "fixed_point_dedup", tmp_path, "documents"))
    assert got[200_000] == 100_000 and got[20_000] == 20_000  # their fifth ancestors differ, and their fourth ones


def test_tree_fanout_has_the_levels_of_its_sql(spark, tmp_path):
    spark.range(66_000).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = equals_sql(spark, "tree_fanout", tmp_path, "orders")
    assert [r[0] for r in got if r[0] > 0] == [1, 1]  # a third level would be one node over these two


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bands_make_no_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = ([(int(k), i, float(x), float(y)) for i, (k, x, y) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(-30, 30, 300) / 2, rng.integers(-30, 30, 300) / 2))] for _ in range(2))
    left, right = (spark.createDataFrame(v, f"key int, {n} int, x double, y double") for v, n in ((a, "a"), (b, "b")))
    for at in (["x"], ["x", "y"]):
        got = spatial.nearest_in_band(left, right, "key", "a", "b", at, 1.5)
        want = {}
        for ka, i, *p in a:
            near = [(sum(abs(u - v) for u, v in zip(p[: len(at)], q)), j) for kb, j, *q in b if ka == kb and all(abs(u - v) <= 1.5 for u, v in zip(p[: len(at)], q))]
            want |= {i: min(near)} if near else {}
        assert {r.a: (r.distance, r.b) for r in got.collect()} == want
        assert "Join" not in plan_of(got)  # pairs of a joined band were sorted in one task


# --- folds of groups -----------------------------------------------------------------------------


def test_groups_may_span_batches(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("g"), "id", F.when(F.col("id") % 10 == 3, None).otherwise(F.col("id")).alias("v"))
    rows = rows.union(spark.createDataFrame([(None, 5, 5), (None, 4, 4)], "g long, id long, v long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = groups.in_groups(rows, ["g"], ["v"], lambda c: [(c[0][0], len(c[1]), c[2][0], c[2][-1])], "g long, n long, first long, last long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(None, 2, 4, 5)] + [(g, len(range(g, 1000, 7)), min(i for i in range(g, 1000, 7) if i % 10 != 3), None) for g in range(7)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["merged_rectangles", "paint_runs", "occluded_paints", "recognised_lines", "event_page_class"])
def test_no_frame_is_made_for_a_group(spark, data, name):
    assert "InPandas" not in plan_of(entry.queries()[name](spark, data))


def test_tables_are_dealt_by_their_rows(spark, data):
    table = spark.range(1000)
    assert spread(table, "id", rows=10).rdd.getNumPartitions() == 100 and spread(table, "id", rows=5000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    for name in ("image_crops", "bilevel_images", "dedup_runs", "stripe_runs"):
        assert "REPARTITION_BY_NUM" in plan_of(entry.queries()[name](spark, data))


# --- files ---------------------------------------------------------------------------------------


def test_files_are_made_in_many_tasks(spark, data):
    tasks = plans.files(spark, data).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1  # their numbers fit one task's share of bytes many times


@pytest.mark.parametrize("name", ["edge_counts", "key_counts", "font_ownership", "incoming_owners", "exact_twins", "form_twins", "plain_streams"])
def test_files_are_made_and_read_once(spark, data, name):
    plan = plan_of(entry.queries()[name](spark, data))
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_one_pass_finds_what_joins_find(spark, data):
    made = plans.files(spark, data).where("path < '12'")
    objects, edges = documents.scan_objects(made), documents.scan_edges(made)
    named, rows = analysis.roles(objects, edges), lambda df: sorted(map(str, df.collect()))
    columns = ("doc_id", "num", "type", "kind", "keys", "value", "raw", "stream_role", "role", "incoming")
    one = analysis.scan_roles(made, columns)
    assert rows(one.select("doc_id", "num", "stream_role", "role")) == rows(named.select("doc_id", "num", "stream_role", "role"))
    assert rows(inventory.twins_of(inventory.with_targets(one))) == rows(inventory.exact_twins(named, inventory.dedup_targets(named, edges)))
    assert rows(analysis.role_edges(made, ("source", "key", "target")).groupBy("source", "key", "target").agg(F.count("*").alias("edges"))) == rows(inventory.edge_counts(named, edges))
    assert rows(inventory.programs_of(analysis.font_uses(made))) == rows(inventory.font_programs(objects, edges))
    for ignored in (("Length",), ("Length", "LastModified")):
        found = analysis.form_twins(made, {"x": ignored})
        assert rows(found.select("doc_id", "num", "canonical")) == rows(inventory.form_twins(objects, edges, ignored))
    reached = analysis.scan_roles(made, ("type", "subtype", "reached")).where("reached AND type = 'stream' AND subtype = 'Image'")
    assert reached.count() == inventory.streams_with_subtype(objects, edges, "Image").count() > 0


def test_hidden_text_is_found_in_one_pass(spark, data):
    parts = [b"/OC /L BDC", b"EMC", b"q", b"Q", b"0 g", b"1 g", b"/G gs", b"3 Tr", b"0 Tr", b"7 Tr", b"0 0 30 30 re W n", b"/Im Do", b"200 0 0 200 0 0 cm", b"0 0 200 200 re f", b"10 10 40 30 re f", b"BT /F 9 Tf 1 0 0 1 12 12 Tm (ab) Tj ET", b"BT /F 9 Tf 1 0 0 1 900 12 Tm (far) Tj ET", b"BT /F 9 Tf 0 0 0 0 12 12 Tm (flat) Tj ET", b"/S <</ActualText (x)>> BDC"]
    name, ref, rng = cos.Name, cos.Ref, np.random.default_rng(5)
    files = []
    for k in range(60):
        content = b"\n".join(parts[i] for i in rng.integers(0, len(parts), 25))
        objects = {
            ref(1): {"Type": name("Catalog"), "Pages": ref(2), "OCProperties": {"OCGs": [ref(6)], "D": {"OFF": [ref(6)]}}},
            ref(2): {"Type": name("Pages"), "Kids": [ref(3)], "Count": 1, "MediaBox": [0, 0, 200, 200]},
            ref(3): {"Type": name("Page"), "Parent": ref(2), "Contents": ref(4), "Resources": {"XObject": {"Im": ref(5)}, "ExtGState": {"G": {"ca": 0 if k % 3 == 0 else 1}}, "Properties": {"L": ref(6)}}},
            ref(4): cos.Stream({}, content),
            ref(5): cos.Stream({"Type": name("XObject"), "Subtype": name("Image"), "Width": 1, "Height": 1}, b"x"),
            ref(6): {"Type": name("OCG"), "Name": b"a"},
        }
        files.append((f"{k}.pdf", bytearray(cos.write(cos.Document(objects, {"Root": ref(1)}, "", 0)))))
    made = spark.createDataFrame(files, "path string, content binary")
    one, joined = text_state.scan_hidden(made), text_state.hidden_text(text_state.scan_events(made))
    assert sorted(map(str, one.collect())) == sorted(map(str, joined.select(*one.columns).collect()))
    assert len({r.mechanism for r in one.collect()}) >= 7
    for plan in (one, entry.queries()["adapter_hidden_text"](spark, data)):
        assert "Join" not in plan_of(plan)


def test_texts_are_put_into_files_once(spark, data):
    plan = plan_of(entry.queries()["adapter_text"](spark, data))
    assert plan.count("MapInArrow") == 3  # pages, their instructions and objects; the files are stored
