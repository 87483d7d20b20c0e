"""Aggregations over facts of documents, streams and pages."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(df: DataFrame, sums: Mapping[str, Column | str], counts: Mapping[str, Column]) -> DataFrame:
    """One row of sums (null counts as zero) and of numbers of rows for which a condition holds."""
    zero = F.lit(0).cast("long")
    parts = [F.coalesce(F.sum(F.col(c) if isinstance(c, str) else c), zero).alias(n) for n, c in sums.items()]
    return df.agg(F.count("*").alias("documents"), *parts, *(F.count_if(c).alias(n) for n, c in counts.items()))


def producer_stats(df: DataFrame, producer: str, sums: Mapping[str, Column | str]) -> DataFrame:
    """Documents and sums for each producer; rows without one are left out."""
    parts = [F.coalesce(F.sum(F.col(c) if isinstance(c, str) else c), F.lit(0).cast("long")).alias(n) for n, c in sums.items()]
    return df.where(F.col(producer).isNotNull()).groupBy(producer).agg(F.count("*").alias("documents"), *parts)


def occurrence_counts(df: DataFrame, kind: str, document: str) -> DataFrame:
    """(kind, occurrences, documents): exact; the first aggregation is by both, so a frequent kind is spread."""
    per = df.where(F.col(kind).isNotNull()).groupBy(kind, document).agg(F.count("*").alias("n"))
    return per.groupBy(kind).agg(F.sum("n").alias("occurrences"), F.count(document).alias("documents"))


def map_sum(df: DataFrame, column: str) -> DataFrame:
    """(key, total) over a column of maps."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def risk_rollup(df: DataFrame, counts: Mapping[str, Column], notes: Mapping[str, str] | None = None) -> DataFrame:
    """(kind, total, note) of counted risks; kinds without any occurrence have no row."""
    one = df.agg(*(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(n) for n, c in counts.items()))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).cast("long").alias("total"), F.lit((notes or {}).get(n, "")).alias("note")) for n in counts]))
    return one.select(rows.alias("r")).select("r.*").where("total > 0")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(1):
            raw = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.empty(0, np.uint8)
            counts = np.bincount(raw, minlength=256)
            p = counts[counts > 0] / max(1, len(raw))
            plain = int(counts[0x20:0x7F].sum() + counts[[9, 10, 13]].sum())
            rows.append((len(raw), float(-(p * np.log2(p)).sum()) + 0.0 if len(raw) else 0.0, int((counts > 0).sum()), int(counts[0]), plain))
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = (pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", "bytes", "entropy", "unique_values", "zero_bytes", "ascii_like"])


def byte_statistics(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id, bytes, entropy in bits a byte, unique_values, zero_bytes, ascii_like) of payloads.

    Null payloads are empty; an empty payload has entropy zero.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(payload).cast("binary").alias("payload"))
    return rows.mapInArrow(_statistics, f"id {kind}, bytes long, entropy double, unique_values int, zero_bytes long, ascii_like long")


def mode_of_deltas(df: DataFrame, group: str, order: Sequence[str], value: str, scale: float = 1e4, least_support: int = 32, least_share: float = 0.01) -> DataFrame:
    """(pitch, support, total): the most frequent step between neighbours, quantised; ties to the smallest.

    Steps of zero don't count; no row unless enough steps agree.
    """
    step = F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    keys = df.select(F.round(F.abs(step) * scale, 0).cast("long").alias("key")).where("key > 0").groupBy("key").agg(F.count("*").alias("support"))
    whole = keys.agg(F.sum("support").alias("total"), F.max(F.struct("support", (-F.col("key")).alias("negative"))).alias("top"))
    found = whole.select((-F.col("top.negative") / scale).alias("pitch"), F.col("top.support").alias("support"), "total")
    return found.where((F.col("support") >= least_support) & (F.col("support") >= F.col("total") * least_share))


def upper_median(column: Column | str, least: float = 1e-7) -> Column:
    """The upper median of a group's finite values above `least`; null without any."""
    x = F.col(column) if isinstance(column, str) else column
    kept = F.when(~F.isnan(x) & (F.abs(x) < float("inf")) & (x > least), x)
    values = F.array_sort(F.collect_list(kept))
    return F.when(F.size(values) > 0, F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int")))


def histogram_median(df: DataFrame, group: Sequence[str], bucket: str, count: str) -> DataFrame:
    """The lower median bucket of counted buckets in each group."""
    w = Window.partitionBy(*group)
    running = df.withColumns({"_run": F.sum(count).over(w.orderBy(bucket)), "_all": F.sum(count).over(w)})
    return running.where(F.col("_run") * 2 >= F.col("_all")).groupBy(*group).agg(F.min(bucket).alias("median"))


def content_density(instructions: DataFrame, document: str = "doc_id", page: str = "page") -> DataFrame:
    """Per document: operators of each kind, in all and at most on one page, and incomplete pages."""
    kinds = {"path": ["m", "l", "c", "v", "y", "h", "re"], "paint": ["S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "sh"], "draw": ["Do"], "text_show": ["Tj", "TJ", "'", '"']}
    per = instructions.groupBy(document, page).agg(
        F.count("op").alias("operators"),
        *(F.count_if(F.col("op").isin(*ops)).alias(n) for n, ops in kinds.items()),
        F.bool_and(F.coalesce("complete", F.lit(True))).alias("complete"),
    )
    names = ["operators", *kinds]
    return per.groupBy(document).agg(
        *(F.sum(n).alias(f"{n}_total") for n in names), *(F.max(n).alias(f"{n}_max_page") for n in names), F.count_if(~F.col("complete")).alias("incomplete_pages")
    )


def placement_targets(placements: DataFrame, document: str, image: str, width: str, height: str, pixel_width: str, pixel_height: str, complete: str, ppi: int = 300) -> DataFrame:
    """(document, image, target_width, target_height): images worth resizing for print.

    The target follows an image's largest placement in points; it must save a tenth of the pixels.
    A document with any incomplete geometry keeps all its images.
    """
    whole = placements.groupBy(document).agg(F.bool_and(F.coalesce(complete, F.lit(False))).alias("_whole")).where("_whole")
    per = placements.groupBy(document, image).agg(F.max(width).alias("w"), F.max(height).alias("h"), F.max(pixel_width).cast("long").alias("pw"), F.max(pixel_height).cast("long").alias("ph"), F.count("*").alias("uses"))
    aim = lambda points, most: F.greatest(F.lit(1), F.least(most, F.ceil(points * ppi / 72.0)))
    per = per.withColumns({"target_width": aim(F.col("w"), F.col("pw")), "target_height": aim(F.col("h"), F.col("ph"))})
    saves = F.col("target_width") * F.col("target_height") * 10 <= F.col("pw") * F.col("ph") * 9
    return per.where(saves).join(whole, document, "left_semi").select(document, image, "uses", "target_width", "target_height")
