"""Python functions of a group's rows, many groups a call: no frame is made for a group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that go back at once.
OUT_ROWS = 10_000


def in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], each: Callable[[list[list]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows (of `schema`) that `each` makes of every group's columns, as lists in the order of the table's columns.

    A group's rows come in order, nulls last. They are sorted by the engine and told apart by a mark on
    their first, so a task holds the rows of one group and a batch.
    """
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in (order or keys)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        out: list[tuple] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)).tolist()
            columns = [c.to_pylist() for c in batch.columns[:-1]]
            first = starts[0] if starts else batch.num_rows
            if held:
                for own, more in zip(held, columns):
                    own += more[:first]
            for at, end in zip(starts, [*starts[1:], batch.num_rows]):
                if held:
                    out += each(held)
                held = [c[at:end] for c in columns]
                if len(out) >= OUT_ROWS:
                    yield made(out)
                    out = []
        if held:
            out += each(held)
        if out:
            yield made(out)

    return df.withColumn("_first", F.row_number().over(w) == 1).mapInArrow(run, kind)
