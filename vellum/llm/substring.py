"""Exact substring deduplication with prefix-partitioned suffix trees over words.

Documents are dealt into memory-sized units. The suffixes that the trees index start at content-
defined places: of every window of `window` words its least-named run of `prefix` words, so equal
windows always meet under the same prefix and a seventh of all suffixes is enough (a sparse suffix
tree). The steps:

1. each unit names the prefixes its suffixes start with, and partitions of the prefix space find
   those that several units share; all others hold no repeat beyond their unit;
2. each unit sends the suffixes below shared prefixes, as text, to the group of their prefix. A
   prefix that more than `crowded` units share is lengthened to the whole window, so that variable-
   length prefixes keep every group of suffixes within memory; windows of such a crowd first meet in
   ranges of `crowded` units, each of which sends only its earliest on;
3. each group builds its subtree top down, splitting nodes by the words that follow and dropping
   those with one leaf; the deep internal nodes, `window` words and more below the root, are the
   repeats, of which every leaf but the earliest is reported to its unit;
4. each unit joins these with the repeats inside itself, merges overlapping windows to maximal
   repeats and cuts them from the texts.

A unit first drops its own repeats, so what a passage that a third of all documents share costs in
its group is one suffix a unit. Words and word runs are compared by 64-bit names.
"""

from __future__ import annotations

import struct
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellum.llm.text import Sequences, release_memory, text_bytes, word_hashes, words
from vellum.session import BYTES_PER_FILE, checkpoint, in_files, small_batches

WINDOW, PREFIX = 20, 8
UNIT_BYTES = 2 << 20
CROWDED = 4096
_LEAST = np.iinfo(np.int64).min


class Unit:
    """The words, windows and anchored prefixes of a unit's rows in their order of precedence."""

    def __init__(self, table: pa.Table, window: int, prefix: int) -> None:
        ids = pc.fill_null(table.column("_id"), _LEAST)
        order = pc.sort_indices(pa.table({"i": ids, "t": pc.fill_null(table.column("_text"), "")}), [("i", "ascending"), ("t", "ascending")])
        self.table = table.take(order)
        self.ids = self.table.column("_id").fill_null(_LEAST).to_numpy()
        text = self.table.column("_text").combine_chunks()
        self.raw, self.at = text_bytes(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
        self.start, self.end, self.first = words(self.raw, self.at)
        n, counts = len(self.start), np.diff(self.first)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.windows = np.flatnonzero(np.arange(n) + window <= self.first[1:][self.row]) if n else np.empty(0, np.int64)
        empty = np.empty(0, np.uint64)
        self.names, self.anchor, self.key = empty, np.empty(0, np.int64), empty
        if not len(self.windows):
            return
        sequence = Sequences(word_hashes(self.raw, self.start, self.end))
        self.names = sequence.of(self.windows, window)
        runs = sequence.of(np.arange(n - prefix + 1), prefix)
        bits = max(20, int(n).bit_length())
        low = np.uint64((1 << bits) - 1)
        least, reach, width = (runs & ~low) | np.arange(len(runs), dtype=np.uint64), 1, window - prefix + 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: reach - width], least[width - reach :])
        self.anchor = (least[self.windows] & low).astype(np.int64)
        self.key = runs[self.anchor]

    def local_repeats(self) -> np.ndarray:
        """Of each window, whether an equal one starts earlier in the unit."""
        order = np.argsort(self.names, kind="stable")
        again = np.zeros(len(order), bool)
        again[order[1:]] = self.names[order][1:] == self.names[order][:-1]
        return again


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal buckets together, and where each begins (and the end)."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
    return order, edge


def _prefixes(window: int, prefix: int, buckets: int, table: pa.Table) -> pa.Table:
    unit = Unit(table, window, prefix)
    key = np.unique(unit.key)
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order, edge = _by_bucket(bucket)
    key, bucket = key[order], bucket[order]
    blobs = [key[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
    g = table.column("_unit")[0].as_py()
    return pa.table({"bucket": pa.array(bucket[edge[:-1]], pa.int64()), "unit": pa.array([g] * len(blobs), pa.int64()), "keys": pa.array(blobs, pa.binary())})


def _shared(crowded: int, table: pa.Table) -> pa.Table:
    """Of a bucket's prefixes those in several units, back to each unit; crowded ones apart."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    key, count = np.unique(np.concatenate(parts), return_counts=True)
    few, many = key[(count > 1) & (count <= crowded)], key[count > crowded]
    out = {"unit": [], "few": [], "many": []}
    for g, own in zip(table.column("unit").to_pylist(), parts):
        a, b = own[np.isin(own, few)], own[np.isin(own, many)]
        if len(a) or len(b):
            for name, value in (("unit", g), ("few", a.tobytes()), ("many", b.tobytes())):
                out[name].append(value)
    return pa.table(out, pa.schema([("unit", pa.int64()), ("few", pa.binary()), ("many", pa.binary())]))


_HEAD = struct.Struct("<qq")


def _suffixes(window: int, prefix: int, buckets: int, docs: pa.Table, shared: pa.Table) -> pa.Table:
    schema = pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("suffixes", pa.binary()), ("crowded", pa.bool_())])
    if not docs.num_rows or not shared.num_rows:
        return schema.empty_table()
    unit = Unit(docs, window, prefix)
    few = np.frombuffer(b"".join(shared.column("few").to_pylist()), np.uint64)
    many = np.frombuffer(b"".join(shared.column("many").to_pylist()), np.uint64)
    first = ~unit.local_repeats()
    short, long_ = first & np.isin(unit.key, few), first & np.isin(unit.key, many)
    live = np.flatnonzero(short | long_)
    if not len(live):
        return schema.empty_table()
    # neighbouring windows below one short prefix share a stretch of text
    at, anchor, own = unit.windows[live], unit.anchor[live], long_[live]
    begin = np.r_[True, (np.diff(at) != 1) | (np.diff(anchor) != 0) | own[1:] | own[:-1]]
    head = np.flatnonzero(begin)
    count = np.diff(np.r_[head, len(live)])
    w = at[head]
    key = np.where(own[head], unit.names[live][head], unit.key[live][head])
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    row, crowded = unit.row[w], own[head]
    order, edge = _by_bucket(bucket * 2 + crowded)
    whole, zip_ = unit.raw.tobytes(), zstandard.ZstdCompressor(level=1)
    left, right = unit.start[w], unit.end[w + count + window - 2]
    blobs = []
    for a, b in zip(edge[:-1], edge[1:]):
        o = order[a:b]
        texts = [whole[x:y] for x, y in zip(left[o].tolist(), right[o].tolist())]
        columns = np.stack([unit.ids[row[o]], row[o], w[o] - unit.first[row[o]], count[o], right[o] - left[o]]).astype(np.int64)
        blobs.append(zip_.compress(_HEAD.pack(len(o), 0) + columns.tobytes() + b"".join(texts)))
    g = docs.column("_unit")[0].as_py()
    return pa.table({"bucket": pa.array(bucket[order][edge[:-1]], pa.int64()), "unit": pa.array([g] * len(blobs), pa.int64()), "suffixes": pa.array(blobs, pa.binary()), "crowded": pa.array(crowded[order][edge[:-1]], pa.bool_())})


def deep_nodes(sequence: Sequences, at: np.ndarray, depth: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (indexes into `at`) below internal nodes `depth` words deep, and each one's node.

    The subtree grows top down: every round splits all nodes by their leaves' next words, and a
    node of one leaf is dropped as it can't be internal.
    """
    live, node, deep = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while deep < depth and len(live):
        step = min(stride, depth - deep)
        edge = sequence.of(at[live] + deep, step)
        order = np.lexsort((edge, node))
        live, node, edge = live[order], node[order], edge[order]
        new = np.r_[True, (node[1:] != node[:-1]) | (edge[1:] != edge[:-1])]
        node = np.cumsum(new) - 1
        keep = np.bincount(node)[node] > 1
        live, node, deep = live[keep], node[keep], deep + step
    return live, node


def _leaves(window: int, table: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """A group's suffixes (columns, units, texts) and, of every deep internal node of its subtree, all
    leaves but the earliest: each one's suffix and place."""
    columns, texts, units = [], [], []
    for g, blob in zip(table.column("unit").to_pylist(), table.column("suffixes").to_pylist()):
        plain = zstandard.ZstdDecompressor().decompress(blob)
        n, _ = _HEAD.unpack_from(plain)
        columns.append(np.frombuffer(plain, np.int64, 5 * n, _HEAD.size).reshape(5, n))
        texts.append(plain[_HEAD.size + 40 * n :])
        units.append(np.full(n, g, np.int64))
    held, whole, unit = np.concatenate(columns, axis=1), b"".join(texts), np.concatenate(units)
    ids, row, begin, count, size = held
    raw = np.frombuffer(whole, np.uint8)
    start, end, first = words(raw, np.r_[0, np.cumsum(size)])
    sequence = Sequences(word_hashes(raw, start, end))
    of = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    leaf, node = deep_nodes(sequence, first[of] + step, window, PREFIX)
    owner, place = of[leaf], begin[of[leaf]] + step[leaf]
    order = np.lexsort((place, row[owner], unit[owner], ids[owner], node))
    later = order[1:][node[order][1:] == node[order][:-1]]
    return held, unit, whole, owner[later], place[later]


_FOUND = pa.schema([("unit", pa.int64()), ("rows", pa.binary()), ("starts", pa.binary())])


def _told(held: np.ndarray, unit: np.ndarray, owner: np.ndarray, place: np.ndarray) -> pa.Table:
    """Leaves by unit."""
    by_unit, edge = _by_bucket(unit[owner])
    owner, place = owner[by_unit], place[by_unit]
    out = {"unit": [], "rows": [], "starts": []}
    for a, b in zip(edge[:-1], edge[1:]):
        out["unit"].append(int(unit[owner[a]]))
        out["rows"].append(held[1][owner[a:b]].astype(np.uint32).tobytes())
        out["starts"].append(place[a:b].astype(np.uint32).tobytes())
    return pa.table(out, _FOUND)


def _trees(window: int, table: pa.Table) -> pa.Table:
    held, unit, _, owner, place = _leaves(window, table)
    release_memory()
    return _told(held, unit, owner, place)


def _thinned(window: int, table: pa.Table) -> pa.Table:
    """Whole windows that a range of units has, the earliest of each going on; the others are told."""
    held, unit, whole, owner, place = _leaves(window, table)
    told = _told(held, unit, owner, place)
    stays = np.ones(len(unit), bool)
    stays[owner] = False
    stop = np.cumsum(held[4])
    zip_, rows = zstandard.ZstdCompressor(level=1), {"unit": [], "suffixes": []}
    for g in np.unique(unit[stays]):
        own = np.flatnonzero(stays & (unit == g))
        texts = b"".join(whole[stop[i] - held[4][i] : stop[i]] for i in own)
        rows["unit"].append(int(g))
        rows["suffixes"].append(zip_.compress(_HEAD.pack(len(own), 0) + held[:, own].tobytes() + texts))
    bucket, n, m = table.column("bucket")[0].as_py(), len(rows["unit"]), told.num_rows
    release_memory()
    return pa.table({
        "bucket": pa.array([bucket] * n + [None] * m, pa.int64()),
        "unit": pa.concat_arrays([pa.array(rows["unit"], pa.int64()), told.column("unit").combine_chunks()]),
        "suffixes": pa.array(rows["suffixes"] + [None] * m, pa.binary()),
        "rows": pa.array([None] * n + told.column("rows").to_pylist(), pa.binary()),
        "starts": pa.array([None] * n + told.column("starts").to_pylist(), pa.binary()),
    })


def _cut(window: int, prefix: int, rejoin: bool, schema: pa.Schema, docs: pa.Table, found: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    unit = Unit(docs, window, prefix)
    gone = unit.windows[unit.local_repeats()]
    if found.num_rows:
        rows = np.frombuffer(b"".join(found.column("rows").to_pylist()), np.uint32)
        starts = np.frombuffer(b"".join(found.column("starts").to_pylist()), np.uint32)
        gone = np.concatenate([gone, unit.first[rows] + starts])
    step = np.zeros(len(unit.start) + 1, np.int64)
    np.add.at(step, gone, 1)
    np.add.at(step, gone + window, -1)
    covered = np.cumsum(step)[:-1] > 0
    whole = unit.raw.tobytes()
    n_words = np.diff(unit.first)
    lost = np.concatenate([[0], np.cumsum(covered)])
    n_removed = lost[unit.first[1:]] - lost[unit.first[:-1]]
    kept, spans = [], []
    for r in range(unit.table.num_rows):
        a, b = unit.first[r], unit.first[r + 1]
        if not n_removed[r]:
            text = whole[unit.at[r] : unit.at[r + 1]]
            kept.append((b" ".join(text.split()) if rejoin else text).decode("utf-8", "replace"))
            spans.append([])
            continue
        edge = np.flatnonzero(np.diff(np.r_[0, covered[a:b].astype(np.int8), 0]))
        cuts = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
        spans.append([{"begin": x, "end": y} for x, y in cuts])
        left = [(0 if i == 0 else cuts[i - 1][1], x) for i, (x, _) in enumerate(cuts)] + [(cuts[-1][1], int(b - a))]
        parts = [b" ".join(whole[unit.start[a + x] : unit.end[a + y - 1]].split()) for x, y in left if y > x]
        kept.append(b" ".join(parts).decode("utf-8", "replace"))
    release_memory()
    out = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, schema.field("spans").type)}
    return pa.table([out[f.name] if f.name in out else unit.table.column(f.name) for f in schema], schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prefix: int = PREFIX, unit_bytes: int = UNIT_BYTES, crowded: int = CROWDED, rejoin: bool = True) -> DataFrame:
    """`docs` with n_words, n_removed, kept and spans beside its own columns, as _c0, _c1, ...

    A word goes if a window of `window` consecutive words covers it whose words also start earlier:
    in a row of a smaller id (null being the smallest; rows that repeat an id are ordered by their
    unit and text), or earlier in the row. Windows are judged on the input. `kept` is what stays,
    joined by single spaces (without `rejoin` a text that loses nothing stays as it is), `spans` the maximal stretches of words that went. Null texts have no
    words; texts of any length are judged whole; an empty table gives no rows. The columns of `docs` come back as _c<position>, so that no name can clash.
    """
    small_batches(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    units = max(1, -(-int(total) // unit_bytes))
    buckets = max(16, units)
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    base = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(units)).alias("_unit"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[c for c, n in zip(own, docs.columns) if n != text_col])
    kept_columns = [f.name for f in base.schema if f.name not in ("_unit", "_id", "_text")]
    grouped = base.groupBy("_unit")
    keys = grouped.applyInArrow(lambda t: _prefixes(window, prefix, buckets, t), "bucket long, unit long, keys binary")
    shared = keys.groupBy("bucket").applyInArrow(lambda t: _shared(crowded, t), "unit long, few binary, many binary")
    many = units > crowded  # else no prefix can be in so many units
    shared = checkpoint(shared) if many else shared
    suffixes = grouped.cogroup(shared.groupBy("unit")).applyInArrow(lambda d, s: _suffixes(window, prefix, buckets, d, s), "bucket long, unit long, suffixes binary, crowded boolean")
    trees = lambda x: x.groupBy("bucket").applyInArrow(lambda t: _trees(window, t), "unit long, rows binary, starts binary")
    if many and not shared.where(F.octet_length("many") > 0).isEmpty():
        # what a crowd of units shares goes through ranges of units first, which send one of each window on
        suffixes = checkpoint(suffixes)
        ranges = suffixes.where("crowded").withColumn("range", F.floor(F.col("unit") / crowded))
        thin = ranges.groupBy("bucket", "range").applyInArrow(lambda t: _thinned(window, t), "bucket long, unit long, suffixes binary, rows binary, starts binary")
        thin = checkpoint(thin)
        left = suffixes.where("NOT crowded").select("bucket", "unit", "suffixes").union(thin.where("suffixes IS NOT NULL").select("bucket", "unit", "suffixes"))
        found = trees(left).union(thin.where("rows IS NOT NULL").select("unit", "rows", "starts"))
    else:
        found = trees(suffixes)
    out = StructType([f for f in base.schema if f.name in kept_columns])
    out = StructType(out.fields + StructType.fromDDL("n_words long, n_removed long, kept string, spans array<struct<begin:int,end:int>>").fields)
    schema = to_arrow_schema(out)
    done = grouped.cogroup(found.groupBy("unit")).applyInArrow(lambda d, f: _cut(window, prefix, rejoin, schema, d, f), out)
    return in_files(done, total, BYTES_PER_FILE)


def substring_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`docs` without their repeated passages. A text that loses nothing stays as it is, one that
    loses all goes with its row, and one that loses a part becomes its kept words."""
    done = substring_dedup(docs, id_col, text_col, rejoin=False).where("n_removed = 0 OR n_removed < n_words")
    out = []
    for i, f in enumerate(docs.schema):
        value = F.col("kept") if f.name == text_col else F.col(f"_c{i}")
        if f.name == length_col:
            value = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(value).cast(f.dataType)
        out.append(value.alias(f.name))
    return done.select(*out)
