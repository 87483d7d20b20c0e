"""Best-fit packing of token sequences with swap-based local search.

Pieces are packed group by group: best fit in decreasing length first, then a search among the
underfull bins. It takes the emptiest bin and moves its pieces to others, exchanges one of them
for a smaller one or for two smaller ones of a fuller bin, each step raising the sum of squared
fills, until the bin is empty or nothing improves. Groups are dealt by a hash of the document, so
one holds a bounded share of the pieces however many there are.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.text import pieces as cut
from vellum.llm.text import text_bytes
from vellum.session import checkpoint, small_batches

CAPACITY = 2048
GROUP_PIECES = 40_000
#: Steps of the search for each underfull bin, on average over a group's bins.
STEPS = 24


def _pairs(sizes: Counter) -> list[tuple[int, int]]:
    """The pairs of lengths in a bin, each once: however many pieces it has, few lengths are distinct."""
    order = sorted(sizes, reverse=True)
    return [(x, y) for i, x in enumerate(order) for y in order[i if sizes[x] > 1 else i + 1 :]]


def _low(mask: int) -> int:
    return (mask & -mask).bit_length() - 1


class _Bins:
    """Bins by free space; those with room are indexed by their pieces and pairs of pieces."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.items, self.free = capacity, [], []
        self.at: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # free -> piece length -> bins
        self.two: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.mask: dict[tuple[int, int], int] = defaultdict(int)  # (pieces taken, free) -> lengths there

    def _enter(self, b: int, add: bool) -> None:
        f, sizes = self.free[b], Counter(s for s, _ in self.items[b])
        if not f or not sizes:
            return
        found = [(1, self.at[f], set(sizes))]
        if len(self.items[b]) > 2:
            found.append((2, self.two[f], {x + y for x, y in _pairs(sizes)}))
        for k, index, lengths in found:
            for y in lengths:
                if add:
                    index[y].add(b)
                    self.mask[k, f] |= 1 << y
                else:
                    index[y].discard(b)
                    if not index[y]:
                        self.mask[k, f] &= ~(1 << y)

    def change(self, b: int, out: list[tuple[int, int]], into: list[tuple[int, int]], indexed: bool = True) -> None:
        if indexed:
            self._enter(b, False)
        for x in out:
            self.items[b].remove(x)
        self.items[b].extend(into)
        self.free[b] += sum(s for s, _ in out) - sum(s for s, _ in into)
        if indexed:
            self._enter(b, True)

    def exchange(self, x: int) -> tuple[int, int, int] | None:
        """(gain, bin, pieces) of the exchange for a piece of length x that fills another bin most."""
        best = None
        for (k, f), mask in self.mask.items():
            if not mask or (best and f <= best[0]):
                continue
            least = max(1, x - f)
            rest = mask >> least
            if rest and (y := least + _low(rest)) < x and (not best or x - y > best[0]):
                best = (x - y, min((self.at if k == 1 else self.two)[f][y]), k)
        return best


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece; deterministic in the order of `lengths`."""
    bins = np.full(len(lengths), -1, np.int64)
    whole = lengths >= capacity
    bins[whole] = np.arange(whole.sum())
    state, holding, where = _Bins(capacity), 0, defaultdict(list)
    order = np.flatnonzero(~whole)
    for i in order[np.argsort(-lengths[order], kind="stable")].tolist():
        size = int(lengths[i])
        rest = holding >> size
        if rest:
            f = size + _low(rest)
            b = where[f].pop()
            if not where[f]:
                holding &= ~(1 << f)
        else:
            b, f = len(state.items), capacity
            state.items.append([])
            state.free.append(capacity)
        state.items[b].append((size, i))
        state.free[b] = f - size
        if f - size:
            where[f - size].append(b)
            holding |= 1 << (f - size)
    _search(state)
    at = int(whole.sum())
    for items in state.items:
        if items:
            for _, i in items:
                bins[i] = at
            at += 1
    return bins


def _search(state: _Bins) -> None:
    capacity = state.capacity
    used = len(state.items)
    total = sum(capacity - f for f in state.free)
    least = -(-total // capacity)
    queue = sorted((b for b in range(used) if state.free[b]), key=lambda b: (-state.free[b], b))
    for b in queue:
        state._enter(b, True)
    steps = STEPS * len(queue)
    for b in queue:
        if used <= least or steps <= 0:
            return
        state._enter(b, False)  # while this bin gives it takes back only smaller pieces
        moved = True
        while moved and state.items[b] and steps > 0:
            moved = False
            own = sorted(state.items[b], reverse=True)
            by: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for x in own:
                by[x[0]].append(x)
            offers = [[same[0]] for same in by.values()]
            pairs = _pairs(Counter({n: len(same) for n, same in by.items()}))
            offers += sorted(([by[x][0], by[y][x == y]] for x, y in pairs), key=lambda o: -o[0][0] - o[1][0])
            for offer in offers:
                steps -= 1
                size = sum(n for n, _ in offer)
                room = [f for (k, f), mask in state.mask.items() if k == 1 and mask and f >= size]
                if room:
                    f = min(room)
                    to = min(t for bins in state.at[f].values() for t in bins)
                    state.change(b, offer, [], indexed=False)
                    state.change(to, [], offer)
                    moved = True
                    break
                best = state.exchange(size) if size <= capacity else None
                if best and capacity - state.free[best[1]] + best[0] > capacity - state.free[b] and not (best[2] == 2 and len(offer) == 2):
                    gain, to, k = best
                    out = _pick(state.items[to], size - gain, k)
                    state.change(to, out, offer)
                    state.change(b, offer, out, indexed=False)
                    moved = True
                    break
        if state.items[b]:
            state._enter(b, True)  # what it has left over may yet take another bin's pieces
        else:
            used -= 1


def _pick(items: list[tuple[int, int]], length: int, k: int) -> list[tuple[int, int]]:
    if k == 1:
        return [min(x for x in items if x[0] == length)]
    items = sorted(items)
    return next([x, y] for i, x in enumerate(items) for y in items[i + 1 :] if x[0] + y[0] == length)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vellum.llm.tokens import encoder

        enc = encoder(path)
        for batch in cut(batches, 1, 1 << 20):
            ids, at = enc.encode(*text_bytes(batch.column(1)))
            rows: list[tuple[int, int, int, int, int]] = []
            for r in range(batch.num_rows):
                own = np.append(ids[at[r] : at[r + 1]], end_id).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity]
                    rows.append((r, k, s, len(part), zlib.crc32(part.tobytes())))
            r, k, s, n, crc = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(k.astype(np.int32)), pa.array(s), pa.array(n), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _pack_group(capacity: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        lengths = part["length"].to_numpy()
        bins = pack(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
        first = np.concatenate([[True], np.diff(bins[order]) > 0])
        offset = np.empty(len(part), np.int64)
        offset[order] = before - before[first][np.cumsum(first) - 1]
        part["sequence_id"] = (int(part["group"].iloc[0]) << 32) + bins
        part["offset"] = offset
        return part.drop(columns="group")

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece with its place in a sequence of at most `capacity` tokens.

    Null and empty texts are one piece of the end id; rows that repeat an id are packed each for
    itself; null ids are kept; texts of any length are cut into pieces; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = checkpoint(rows.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    groups = max(1, -(-found.count() // group_pieces))
    dealt = found.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(_pack_group(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.coalesce(groups)
