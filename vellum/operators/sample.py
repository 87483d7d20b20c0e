"""Rankings and deterministic samples by content digest."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.scalars import entropy_half_bits, log2_bucket, ratio_decile


def top_by(df: DataFrame, metric: str, ties: Sequence[str], k: int = 20, nonzero: bool = False) -> DataFrame:
    """The k rows of the highest metric, ties by the given columns; a limit after a sort keeps k rows a task."""
    rows = df.where(F.col(metric) > 0) if nonzero else df
    return rows.orderBy(F.desc(metric), *ties).limit(k)


def rankings(df: DataFrame, metrics: Sequence[str], ties: Sequence[str], k: int = 20) -> DataFrame:
    """(metric, rank, value, ties...) of every metric's k highest non-zero rows, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    rows = df.select(*ties, pairs.alias("p")).select(*ties, "p.metric", "p.value").where("value > 0")
    w = Window.partitionBy("metric").orderBy(F.desc("value"), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shape_key(kind: Column, decoded: Column, encoded: Column, entropy: Column, zeros: Column, ascii_like: Column) -> Column:
    """The bucket of a payload: kind, log2 of the size, tenths of encoded size, zeros and ASCII, half bits of entropy."""
    return F.struct(
        kind.alias("kind"),
        log2_bucket(decoded).alias("size_log2"),
        ratio_decile(encoded, decoded).alias("source_ratio_decile"),
        entropy_half_bits(entropy).alias("entropy_half_bits"),
        ratio_decile(zeros, decoded).alias("zero_decile"),
        ratio_decile(ascii_like, decoded).alias("ascii_decile"),
    )


def digest_sample(df: DataFrame, document: str, shape: Sequence[str], digest: str, per_document: int = 16) -> DataFrame:
    """For each document the least digest of each shape, and of these the least `per_document`."""
    first = Window.partitionBy(document, *shape).orderBy(digest)
    # min over the shape then rank within the document: neither needs a document's rows sorted whole
    least = df.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    w = Window.partitionBy(document).orderBy(digest)
    return least.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_document).drop("_k")


def shape_cap(df: DataFrame, shape: Sequence[str], order: Sequence[str], most: int = 8) -> DataFrame:
    """At most `most` rows of each shape, the first in order."""
    w = Window.partitionBy(*shape).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def budget_fold(df: DataFrame, order: Sequence[str], size: str, most_rows: int = 2048, most_bytes: int = 128 << 20, most_each: int = 16 << 20) -> DataFrame:
    """The greedy sample within budgets: in order, a row too large for what is left is skipped.

    Greedy skipping depends on all rows before, so one task folds the candidates; these are the
    capped sample, which earlier steps hold to a few rows for each document and shape.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order)).reset_index(drop=True)
        keep, rows, used = [], 0, 0
        for n in part[size].tolist():
            fits = n <= most_each and rows < most_rows and used + n <= most_bytes
            keep.append(fits)
            rows, used = rows + fits, used + (n if fits else 0)
        return part[keep]

    columns = df.columns
    return df.groupBy(F.lit(0).alias("_one")).applyInPandas(lambda part: fold(part[columns]), df.schema)
