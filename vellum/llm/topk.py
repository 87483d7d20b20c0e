"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Rows are dealt into shards of bounded size. A shard keeps, for every dimension, its rows in the
order of that component. A query walks all lists at once, from the end that its own component's
sign makes good: rows met are scored in full, and the components at the walk's depth bound what
any row not yet met can score. It stops when that bound lies below its kth best score.

A shard's rows come to a task before the queries, so its lists are built once and blocks of
queries stream past them; of a query each shard sends no more than its k best on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import checkpoint

SCALE = 64.0
SHARD_ROWS, QUERY_ROWS = 8192, 512
STRIDE = 48
#: Rows scored in one product.
SCORED = 2048


def _ints(column: pa.Array, width: int) -> np.ndarray:
    """Integer components, missing ones of shorter vectors being zero."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Lists:
    """A shard's sorted lists: for each dimension its rows by ascending component, then the same reversed."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        self.rows, self.ids, self.x = rows, ids, x
        up = np.argsort(x, axis=0, kind="stable").T
        self.order = np.concatenate([up, up[:, ::-1]])  # 2 d lists; d + i is dimension i from the top
        self.largest = int(np.abs(x).max(initial=0))

    def _kind(self, queries: np.ndarray) -> type:
        """The fastest type in which all inner products are exact."""
        most = self.largest * int(np.abs(queries).max(initial=0)) * max(1, self.x.shape[1])
        return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's k best rows but its `own`, ties to smaller ids.

        The block's queries walk the lists together: what one of them meets is scored for all that
        still walk, in one product of matrices.
        """
        (n, d), kind = self.x.shape, self._kind(queries)
        x, q = self.x.astype(kind), queries.astype(kind)
        lists = np.where(queries > 0, np.arange(d) + d, np.arange(d))  # the good end for each query
        seen, walking = np.zeros(n, bool), np.arange(len(queries))
        best = [np.empty(0, np.int64)] * 3  # query, id, score
        kth = np.full(len(queries), np.iinfo(np.int64).min)
        depth, stride = 0, STRIDE
        while len(walking):
            to = min(n, depth + stride)
            met = np.zeros(n, bool)
            met[self.order[np.unique(lists[walking]), depth:to].ravel()] = True
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            for i in range(0, len(rows), SCORED):
                part = rows[i : i + SCORED]
                score = (q[walking] @ x[part].T).astype(np.int64, copy=False) if kind is np.int64 else q[walking] @ x[part].T
                floor = kth[walking]
                if (floor == np.iinfo(np.int64).min).any() and len(part) > k + 1:
                    # k + 1 as a query's own row may be among them
                    local = np.partition(score, len(part) - k - 1, axis=1)[:, len(part) - k - 1]
                    floor = np.maximum(floor, local.astype(np.int64))
                a, c = np.nonzero(score >= floor[:, None])
                a_q, c_id = walking[a], self.ids[part[c]]
                other = self.rows[part[c]] != own[a_q]
                best = self._merge(best, [a_q[other], c_id[other], score[a, c][other].astype(np.int64)], k, kth)
            if to >= n:
                break
            # of each list the component at the depth: no row further on has a better one
            at = self.x[self.order[lists[walking], to], np.arange(d)]
            bound = (at * queries[walking]).sum(1)
            walking = walking[~(bound < kth[walking])]
            depth, stride = to, stride * 8
        return best[0], best[1], best[2]

    @staticmethod
    def _merge(best: list[np.ndarray], new: list[np.ndarray], k: int, kth: np.ndarray) -> list[np.ndarray]:
        """The k best of each query; raises the queries' kth scores in place where they have k."""
        query, ids, score = (np.concatenate(c) for c in zip(best, new))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.empty(0, bool)
        rank = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(query) else query
        full = rank == k - 1
        kth[query[full]] = score[full]
        keep = rank < k
        return [query[keep], ids[keep], score[keep]]


def _answer(k: int, query_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by shard, rows before queries; columns are shard, asks, row, vec_id, ints."""
        now, held, lists, width = None, [], None, 0
        for batch in batches:
            shard, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1]), True]) if len(shard) else [0]
            for a, b in zip(edge[:-1], edge[1:]):
                if shard[a] != now:
                    now, held, lists = shard[a], [], None
                part = batch.slice(a, b - a)
                if not asks[a]:
                    held.append(part)
                    continue
                if not held and lists is None:
                    continue
                if lists is None:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    ints = rows.column("ints").chunk(0)
                    width, held = int(np.diff(ints.offsets.to_numpy()).max(initial=0)), []
                    lists = Lists(rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), _ints(ints, width))
                for i in range(0, part.num_rows, query_rows):
                    block = part.slice(i, query_rows)
                    row, own = block.column(2).to_numpy(), block.column(3).to_numpy()
                    asked = _ints(block.column(4), max(width, int(np.diff(block.column(4).offsets.to_numpy()).max(initial=0))))
                    query, ids, score = lists.search(row, asked[:, :width], k)
                    yield pa.RecordBatch.from_arrays([pa.array(row[query]), pa.array(own[query]), pa.array(ids), pa.array(score)], ["row", "query_id", "vec_id", "score"])

    return run


def exact_topk(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every query, an id divisible by `every`.

    A score is the inner product of the vectors' integer components floor(scale * x); ties go to
    the smaller id. Rows with a null id, or a vector that is null or holds null or non-finite
    components, take no part; shorter vectors count as padded with zeros. Rows that repeat an id are
    rows and queries of their own: each is a candidate for the others and has its own k answers under
    the same query_id. An empty table gives no rows; extra columns are not read.
    """
    values = F.col(vector_col).cast("array<double>")
    sane = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(values, lambda v: F.floor(v * scale).cast("long"))
    live = table.where(F.col(id_col).isNotNull() & F.coalesce(sane, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("ints"))
    # the number is part of the checkpoint, so it names a row once and for all
    live = checkpoint(live.withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-live.count() // shard_rows))
    columns = ["shard", "asks", "row", "vec_id", "ints"]
    rows = live.withColumns({"shard": F.pmod(F.xxhash64("row"), F.lit(shards)), "asks": F.lit(False)}).select(columns)
    queries = live.where(F.col("vec_id") % every == 0).withColumns({"shard": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))), "asks": F.lit(True)}).select(columns)
    dealt = rows.union(queries).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    found = dealt.mapInArrow(_answer(k, query_rows), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
