"""Ordered analytics: runs, islands, barriers, repetitions and batches within a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, stream: Sequence[str], order: Sequence[str], state: Sequence[str], joined: Column | None = None) -> DataFrame:
    """Rows with `island`, the number of their run of equal states in a stream.

    `joined`, over the columns with prev_ before them of the row before, may forbid that a run goes on.
    """
    w = Window.partitionBy(*stream).orderBy(*order)
    before = {f"prev_{c}": F.lag(c).over(w) for c in dict.fromkeys([*state, *order, *[c for c in df.columns if c in ("start", "end")]])}
    rows = df.withColumns(before).withColumn("_n", F.row_number().over(w))
    same = F.col("_n") > 1
    for c in state:
        same = same & F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    if joined is not None:
        same = same & F.coalesce(joined, F.lit(False))
    rows = rows.withColumn("_new", (~same).cast("int"))
    return rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n", "_new", *before)


def state_runs(df: DataFrame, stream: Sequence[str], order: Sequence[str], state: Sequence[str], least: int, joined: Column | None = None) -> DataFrame:
    """(stream, state, island, length): runs of at least `least` rows of one state."""
    return islands(df, stream, order, state, joined).groupBy(*stream, *state, "island").agg(F.count("*").alias("length")).where(F.col("length") >= least)


def prefix_runs(df: DataFrame, stream: Sequence[str], order: Sequence[str], prefix: str, least_blocks: int = 2, least_prefix: int = 4096, least_saved: int = 16384) -> DataFrame:
    """Runs of neighbouring blocks with one long prefix that hoisting would save enough of."""
    rows = df.withColumn("digest", F.sha2(F.col(prefix).cast("binary"), 256)).withColumn("size", F.octet_length(prefix).cast("long"))
    runs = islands(rows, stream, order, ["digest"]).groupBy(*stream, "digest", "island").agg(F.count("*").alias("blocks"), F.min("size").alias("size"))
    runs = runs.withColumn("saved", (F.col("blocks") - 1) * F.col("size"))
    return runs.where((F.col("blocks") >= least_blocks) & (F.col("size") >= least_prefix) & (F.col("saved") >= least_saved))


def epochs(df: DataFrame, stream: Sequence[str], order: Sequence[str], barrier: Column) -> DataFrame:
    """Rows with `epoch`, the barriers passed up to and with them."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("epoch", F.sum(F.coalesce(barrier, F.lit(False)).cast("int")).over(w))


def dead_duplicates(df: DataFrame, stream: Sequence[str], order: Sequence[str], key: str, barrier: Column) -> DataFrame:
    """Rows that a later row of the same key paints over before any barrier; barrier rows never are."""
    rows = epochs(df, stream, order, barrier).withColumn("_bar", F.coalesce(barrier, F.lit(False)))
    w = Window.partitionBy(*stream, "epoch", key).orderBy(*order)
    # the barrier that opens an epoch stands in it, so only rows that are none compete
    live = rows.where(~F.col("_bar") & F.col(key).isNotNull())
    return live.withColumn("_later", F.lead(F.lit(1)).over(w)).where("_later IS NOT NULL").drop("_later", "_bar")


def boundary_pairs(df: DataFrame, stream: Sequence[str], order: Sequence[str], op: str, key: str, close: str, open_: str) -> DataFrame:
    """Rows `close` whose next row is `open_` with the same key: a boundary that can go."""
    w = Window.partitionBy(*stream).orderBy(*order)
    rows = df.withColumns({"_next_op": F.lead(op).over(w), "_next_key": F.lead(key).over(w)})
    return rows.where((F.col(op) == close) & (F.col("_next_op") == open_) & (F.col(key) == F.col("_next_key"))).drop("_next_op", "_next_key")


def batches(df: DataFrame, stream: Sequence[str], order: Sequence[str], size: int = 64) -> DataFrame:
    """Rows with `batch`: consecutive groups of at most `size` in a stream."""
    w = Window.partitionBy(*stream).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def repeated_within(df: DataFrame, page: str, payload: str, strong: Column, medium: Column, least_payload: int = 3, least_page: int = 8) -> DataFrame:
    """Candidates to remove: strong ones, and medium ones that repeat on the page or crowd it."""
    rows = df.withColumn("_medium", medium & ~strong)
    counts = rows.where(medium).groupBy(page, payload).agg(F.count("*").alias("_same"))
    pages = counts.groupBy(page).agg(F.sum("_same").alias("_all"))
    # two small aggregates and joins: a page's rows need not stand in one task
    rows = rows.join(counts, [page, payload], "left").join(pages, page, "left")
    keep = strong | (medium & ((F.col("_same") >= least_payload) | (F.col("_all") >= least_page)))
    return rows.where(keep).drop("_medium", "_same", "_all")


def persistent_members(df: DataFrame, key: str, page: str, pages: int, least: int = 3) -> DataFrame:
    """(key, support, mode): keys on all pages, or on all but the first; relational division."""
    per = df.where(F.col(key).isNotNull()).groupBy(key, page).agg(F.count("*").alias("_n"))
    found = per.groupBy(key).agg(F.count("*").alias("support"), F.min(page).alias("first"))
    mode = F.when(F.col("support") == pages, "all").when((F.col("support") == pages - 1) & (F.col("first") > 0), "after-first")
    return found.withColumn("mode", mode).where(F.col("mode").isNotNull() & (F.col("support") >= least)).select(key, "support", "mode")


def adjacent_cover(df: DataFrame, stream: Sequence[str], order: Sequence[str], rect: str = "rect", colour: str = "colour") -> DataFrame:
    """Fills that the next one covers, whatever its colour, or the one before in the same colour."""
    from vellum.functions.scalars import contains

    w = Window.partitionBy(*stream).orderBy(*order)
    rows = df.withColumns({"_nr": F.lead(rect).over(w), "_nc": F.lead(colour).over(w), "_pr": F.lag(rect).over(w), "_pc": F.lag(colour).over(w)})
    after = contains(F.col("_nr"), F.col(rect))  # a later opaque fill hides whatever colour it has
    before = contains(F.col("_pr"), F.col(rect)) & F.col("_pc").eqNullSafe(F.col(colour))
    return rows.where(F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))).drop("_nr", "_nc", "_pr", "_pc")


def ordinal(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Rows with their place from zero within a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
