"""Graph operators: connected components, reachability, fixed points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import checkpoint


EDGES_PER_FILE, BROADCAST_EDGES = 200_000, 50_000
#: Frontiers of a search that are kept apart before they are written as one table.
FRONTIERS = 24


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) with root the least node of each component of the given edges."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts a partition's edges; the forest held never exceeds the nodes seen so far."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 500_000:
            lone = np.unique(a[a == b])
            a, b = (np.concatenate([x, lone]) for x in local_forest(a, b))
    lone = np.unique(a[a == b])
    a, b = (np.concatenate([x, lone]) for x in local_forest(a, b))
    for i in range(0, len(a), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 20_000]), pa.array(b[i : i + 20_000])], ["a", "b"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", about: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge, component being its least reachable node.

    Each partition first contracts its own edges to a forest; then large-star and small-star
    steps alternate, each a grouped minimum and a join, until the edges stand still (about the
    logarithm of the longest chain in rounds, however many these are). Edges with
    a null end are ignored, self loops only name their node. Every round is checkpointed. `about` may say
    about how many nodes or edges there are, so that few don't go to many files; those that fit one
    task need no rounds, as its forest is whole.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    # self loops only name their node; both kinds of rows come from one run over the edges
    alone = about is not None and about < EDGES_PER_FILE
    if about is not None:  # a shuffle, as the edges' own making may need all its tasks
        pairs = pairs.repartition(1 + about // EDGES_PER_FILE)
    kept = checkpoint(pairs.mapInArrow(_forest, "a long, b long"))
    stars = kept.where("a <> b")
    now = seen = stars.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
    while now[0] and not alone:
        # edges point from a node to a smaller one: the large star moves each to what its end points at
        ends = stars.groupBy(F.col("a").alias("end")).agg(F.min("b").alias("m"))
        if now[0] <= BROADCAST_EDGES:  # else a join, whose hubs the engine splits
            ends = F.broadcast(ends)
        large = stars.join(ends, stars["b"] == ends["end"], "left").select("a", F.coalesce("m", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        stars = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        # as many files as the edges left ask for: late rounds have few
        stars = checkpoint(stars.coalesce(1 + now[0] // EDGES_PER_FILE))
        now = stars.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == seen:
            break
        seen = now
    # at the end every node has one edge, to its root
    found = stars.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    nodes = kept.where("a = b").select(F.col("a").alias("node")).distinct()
    lone = nodes.join(found.union(roots).select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    every = found.union(roots).union(lone)
    return every.coalesce(1 + now[0] // EDGES_PER_FILE)


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", node: str = "node") -> DataFrame:
    """Nodes reached from the roots along directed edges, roots included; cycles are harmless.

    The frontier advances by a join and an anti-join a round until it is empty. Only the frontier is
    checkpointed; what was seen is the union of all frontiers, written as one table now and then.
    """
    links = checkpoint(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).dropna().distinct())
    front = checkpoint(roots.select(F.col(node).alias("node")).dropna().distinct())
    seen, parts = front, 1
    while True:
        step = front.join(links, front["node"] == links["_s"]).select(F.col("_d").alias("node")).distinct()
        front = checkpoint(step.join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen, parts = seen.union(front), parts + 1
        if parts >= FRONTIERS:
            seen, parts = checkpoint(seen), 1


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame, node: str = "node", **names: str) -> DataFrame:
    """Nodes that no root reaches: what a collector would drop."""
    return nodes.join(reachable(edges, roots, node=node, **names).withColumnRenamed("node", node), node, "left_anti")


def inherited(nodes: DataFrame, key: str, parent: str, values: list[str]) -> DataFrame:
    """Nodes with each value taken from the nearest ancestor that has it, themselves first.

    Every round a node takes what the ancestor it points at has found and then points where that one
    points, so chains of any depth take a logarithm of rounds; a cycle of parents ends when as many
    steps are made as there are nodes. Keys are unique; null keys inherit and pass nothing on.
    """
    rows = checkpoint(nodes.withColumn("_at", F.col(parent)))
    missing = F.lit(False)
    for v in values:
        missing = missing | F.col(v).isNull()
    for _ in range(1 + rows.count().bit_length()):
        if rows.where(F.col("_at").isNotNull() & missing).isEmpty():
            break
        above = rows.select(F.col(key).alias("_up"), F.col("_at").alias("_next"), *[F.col(v).alias(f"_v_{v}") for v in values])
        climbing = rows.join(above, F.col("_at") == F.col("_up"), "left")
        rows = checkpoint(climbing.select(*[F.coalesce(c, f"_v_{c}").alias(c) if c in values else F.col(c) for c in nodes.columns], F.col("_next").alias("_at")))
    return rows.drop("_at")


def fan_out(df: DataFrame, order: list[str], width: int, low: str, group: list[str] | None = None) -> DataFrame:
    """(level, node, low, high, children): a balanced tree over ordered rows, `width` children a node.

    Without groups the first level ranks rows by range partitions and their counts, so no task sees
    all rows; each level above has a `width`th of the rows.
    """
    group = group or []
    if group:
        ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
    else:
        ranked = global_rank(df, order).withColumn("_n", F.col("rank") - 1)
    level = ranked.groupBy(*group, F.floor(F.col("_n") / width).alias("node")).agg(F.min(low).alias("low"), F.max(low).alias("high"), F.count("*").alias("children"))
    out, k = level.withColumn("level", F.lit(0)), 1
    while not level.where("node > 0").isEmpty():
        level = checkpoint(level.groupBy(*group, F.floor(F.col("node") / width).alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("children")))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
        k += 1
    return out


def global_rank(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows with `rank` from 1 in a total order, without a window over one partition.

    Rows are sorted into range partitions; each partition's rows are numbered and shifted by the
    counts of those before it, which are one number a partition.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    w = Window.partitionBy("_p").orderBy(*order)
    counts = placed.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.withColumn("_k", F.row_number().over(w))
    return numbered.join(F.broadcast(counts.select("_p", "_before")), "_p").withColumn("rank", F.col("_k") + F.col("_before")).drop("_p", "_k", "_before")


def shared_prefixes(df: DataFrame, sequence: str, order: str, item: str, least: int = 2) -> DataFrame:
    """(prefix, depth, sequences, example): every prefix that at least `least` sequences begin with.

    A prefix is named by the digest chain of its items, so all depths are one grouped count.
    """
    w = Window.partitionBy(sequence).orderBy(order)
    rows = df.withColumns({"depth": F.row_number().over(w), "_items": F.collect_list(F.sha2(F.coalesce(F.col(item).cast("binary"), F.lit("").cast("binary")), 256)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    named = rows.select(F.col(sequence), "depth", F.sha2(F.array_join("_items", ""), 256).alias("prefix"))
    return named.groupBy("prefix", "depth").agg(F.count("*").alias("sequences"), F.min(sequence).alias("example")).where(F.col("sequences") >= least)


def dangerous_chains(actions: DataFrame, next_edges: DataFrame, dangerous: list[str], key: str = "node", kind: str = "kind") -> DataFrame:
    """Nodes whose chain of next actions holds a dangerous one: they reach it along the edges."""
    bad = actions.where(F.col(kind).isin(*dangerous)).select(F.col(key).alias("node"))
    return reachable(next_edges, bad, src="dst", dst="src")
