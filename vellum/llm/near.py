"""Near copies by the Jaccard similarity of their word shingles: all pairs of 0.8 or more.

Texts become sets of five-word shingles, named by 64-bit hashes. Pairs to be tried come from two
sources. The first is the SimHash operator over the same shingles: what its balls bring together.
The second loses no pair: two sets that are 0.8 alike share one of their first fifth and one more
shingles under any order common to all, so every distinct set goes to these (prefix filtering).
Shingles that many texts of a sample have come last in that order, which keeps buckets small and
decides nothing else; of buckets that hold the same sets one is kept. Within a bucket a pair goes on
if its sizes and its parities allow for the similarity: a parity bit says whether a class of shingles
has an odd number, so two never differ in more bits than the sets in shingles.

Pairs are tried in three rounds, each on what the rounds before left in different components: the
balls' links, of every set its most alike in the pairs that span its buckets, then all pairs left. A pair is tried
on parities of eight classes or more a shingle, which refuse or, where chance can't explain their
likeness, accept it; what they leave open is compared as whole sets, of 40 bits a shingle. Pairs that hang together go to
one place, which gets each set once, however many of them name it; large clusters are cut into blocks.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.simhash import ball_links, fingerprint
from vellum.llm.text import Sequences, mix, pieces, release_memory, text_bytes, word_hashes, words
from vellum.operators.graph import connected_components, local_forest
from vellum.session import checkpoint, in_files, small_batches

SHINGLE = 5
#: Documents whose shingles are counted for the order, and how many of these make a shingle common.
SAMPLE_DOCS, COMMON = 8_000, 2
#: Bytes of a bucket's parities, of sets of more than LONG shingles and of others.
LONG, LONG_BYTES, SHORT_BYTES = 512, 256, 64
#: Sets of so many shingles at most are tried as they are; others on so many classes a shingle at least.
SMALL, CLASSES = 64, 8
#: A pair is accepted on its parities where chance explains their likeness less often than e to this.
CHANCE = -35.0
#: Ends of pairs whose texts' digests, eight bytes each, go to all tasks at most; more are joined by a shuffle.
BROADCAST_ENDS = 1_000_000
#: Text bytes of a range of keys, keys that a task holds, and sets of one key that it sends to the key's range.
RANGE_BYTES, HELD, HOT = 16 << 20, 1 << 21, 64
#: Sets of a bucket that are compared in one place, and bytes of sets in a place for clusters of pairs
#: and in a block of a cluster that is too large for one.
BLOCK, CELL_BYTES, BLOCK_BYTES = 4096, 4 << 20, 32 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, and where each text's start and end."""
    raw, at = text_bytes(column)
    raw = _LOWER[raw]
    start, end, first = words(raw, at)
    n = np.diff(first)
    many = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), many)
    place = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    names = Sequences(word_hashes(raw, start, end)).of(place, np.minimum(n, shingle)[row])
    order = np.lexsort((names, row))
    names, row = names[order], row[order]
    new = np.r_[True, (names[1:] != names[:-1]) | (row[1:] != row[:-1])][: len(names)]
    names, row = names[new], row[new]
    return names, np.searchsorted(row, np.arange(len(n) + 1), "left")


def _set_names(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(mix(names ^ _SALT), out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _count(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            names, n = np.unique(shingle_sets(batch.column(0), shingle)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], ["name", "n"])

    return run


def parities(names: np.ndarray, size: int) -> np.ndarray:
    """`size` bytes, a power of two, of whose bits each is the parity of a class of shingles."""
    classes = (names & np.uint64(8 * size - 1)).astype(np.int64)
    return np.packbits((np.bincount(classes, minlength=8 * size) & 1).astype(np.uint8), bitorder="little")


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parities of half as many classes, until they fill `size` bytes."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _nodes(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2, 1 << 20):
            names, at = shingle_sets(batch.column(2), shingle)
            n = np.diff(at)
            raw, begin = text_bytes(batch.column(2))
            whole = raw.tobytes()
            fp = np.fromiter((fingerprint(whole[a:b], shingle) for a, b in zip(begin[:-1], begin[1:])), np.uint64, batch.num_rows)
            prints = [parities(names[p:q], LONG_BYTES if q - p > LONG else SHORT_BYTES).tobytes() for p, q in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(_set_names(names, at)), pa.array(n), pa.array(fp.view(np.int64)), pa.array(prints, pa.binary())],
                ["doc_id", "t", "node", "n", "fp", "print"],
            )

    return run


def _keys(shingle: int, common: np.ndarray, ranges: int, bits: int):
    """The first fifth and one more of every distinct set's shingles, packed by ranges of keys.

    A key is the first `bits` bits of a shingle's name: two that share a key by chance meet for nothing.
    """

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, node = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(edge, np.diff(np.r_[edge, len(key)]))
        # what one task has above HOT of a key is shared for sure and goes elsewhere, dealt by its set
        to = np.where(rank < HOT, key % np.uint64(ranges), np.uint64(ranges) + node % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        key, node, to = key[order], node[order], to[order]
        edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1], edge[1:]):
            yield pa.RecordBatch.from_arrays([pa.array(to[a : a + 1]), pa.array([_packed(key[a:b], node[a:b])], pa.binary())], ["range", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, many = np.empty(0, np.uint64), [], 0
        for batch in pieces(batches, 0, 1 << 20):
            names, at = shingle_sets(batch.column(0), shingle)
            n, node = np.diff(at), _set_names(names, at).view(np.uint64)
            new = np.zeros(len(n), bool)  # a set goes once from a task
            new[np.unique(node, return_index=True)[1]] = True
            new &= ~np.isin(node, seen)
            seen = np.concatenate([seen, node[new]])
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((names, np.isin(names, common), row))
            most = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
            ahead = new[row] & (np.arange(len(names)) - at[:-1][row] < most[row])
            held.append((names[order][ahead] >> np.uint64(64 - bits), node[row[ahead]]))
            many += len(held[-1][0])
            if many > HELD:
                yield from pack(held)
                held, many = [], 0
        if many:
            yield from pack(held)
        release_memory()

    return run


def _packed(key: np.ndarray, node: np.ndarray) -> bytes:
    """Ascending keys as differences, their nodes as places in a list, byte by byte, compressed."""
    nodes, place = np.unique(node, return_inverse=True)
    columns = np.diff(key, prepend=np.zeros(1, np.uint64)), place.astype(np.uint64), nodes
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8).T.ravel() for x in columns]
    return len(key).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    n = int.from_bytes(blob[:8], "little")
    step, place, nodes = (np.ascontiguousarray(x.reshape(8, -1).T).view(np.uint64).ravel() for x in np.split(planes, [8 * n, 16 * n]))
    return np.cumsum(step, dtype=np.uint64), nodes[place.astype(np.int64)]


def _shared(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        """(key, node) of the keys that several sets have; of keys with equal sets the least."""
        parts = [_unpacked(x) for x in table.column("rows").to_pylist()]
        key, node = (np.concatenate(x) for x in zip(*parts))
        if table.column("range")[0].as_py() < ranges:
            full = [np.empty(0, np.uint64)]
            for own, _ in parts:
                names, n = np.unique(own, return_counts=True)
                full.append(names[n >= HOT])  # may have more sets elsewhere
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node = key[new], node[new]
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[edge, len(key)])
            sets = np.bitwise_xor.reduceat(mix(node ^ _SALT), edge)
            first = np.zeros(len(edge), bool)
            first[np.unique(np.stack([sets, size.astype(np.uint64)]), axis=1, return_index=True)[1]] = True
            keep = (size > 1) & (first | np.isin(key[edge], np.concatenate(full)))
            live = np.repeat(keep, size)
            key, node = key[live], node[live]
        release_memory()
        return pa.table({"key": pa.array(key.view(np.int64)), "node": pa.array(node.view(np.int64))})

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by the first column, cut where its value changes."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        key = table.column(0).to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks().to_batches()[0]
    if rest is not None and rest.num_rows:
        yield pa.Table.from_batches([rest])


def spanning_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs that span the components of all: of each component the first that leaves it."""
    _, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root, taken = np.arange(int(ends.max(initial=-1)) + 1), np.empty(0, np.int64)
    live = np.arange(len(a))
    while True:
        live = live[root[x[live]] != root[y[live]]]
        if not len(live):
            return np.unique(taken)
        firsts = np.full(len(root), len(a))
        np.minimum.at(firsts, root[x[live]], live)
        np.minimum.at(firsts, root[y[live]], live)
        taken = np.concatenate([taken, firsts[firsts < len(a)]])
        node, low = local_forest(x[taken], y[taken])
        root = np.arange(len(root))
        root[node] = low


def _pairs(forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key and size; rows are key, n, node, component, print."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def out():
            a, b, apart = (np.concatenate(x) for x in zip(*found))
            _, one = np.unique(np.column_stack([a, b]), axis=0, return_index=True)
            for i in range(0, len(one), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[one[i : i + 20_000]]) for x in (a, b, apart)], ["a", "b", "apart"])

        for table in _by_key(batches):
            key, n, node, comp = (table.column(i).to_numpy() for i in range(4))
            own = [np.frombuffer(x, np.uint8) for x in table.column(4).to_pylist()]
            prints = np.concatenate([_folded(x, SHORT_BYTES) for x in own]).view(np.uint64).reshape(len(key), -1)
            long = np.flatnonzero(n > LONG)
            nth = np.searchsorted(long, np.arange(len(key)))
            longs = np.concatenate([own[i] for i in long] or [np.empty(0, np.uint8)]).view(np.uint64).reshape(len(long), LONG_BYTES // 8)
            edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            for p, q in zip(edge[:-1], edge[1:]):
                xs, ys, far = [], [], []
                i = p
                while i < q - 1:
                    j = min(q, i + max(1, (1 << 16) // int(q - i)))
                    to = p + int(np.searchsorted(n[p:q] * 4, n[j - 1] * 5, "right"))
                    differ = np.bitwise_count(prints[i:j, None] ^ prints[None, i:to]).sum(2, dtype=np.int64)
                    fits = (9 * differ <= n[i:j, None] + n[None, i:to]) & (comp[i:j, None] != comp[None, i:to])
                    x, y = np.nonzero(fits)
                    x, y, d = i + x[y > x], i + y[y > x], differ[x[y > x], y[y > x]]
                    both = np.flatnonzero((n[x] > LONG) & (n[y] > LONG))
                    for k in range(0, len(both), 1 << 14):
                        some = both[k : k + (1 << 14)]
                        d[some] = np.bitwise_count(longs[nth[x[some]]] ^ longs[nth[y[some]]]).sum(1, dtype=np.int64)
                    near = 9 * d <= n[x] + n[y]
                    x, y, d = x[near], y[near], d[near]
                    xs.append(node[x])
                    ys.append(node[y])
                    far.append(d / np.maximum(n[x] + n[y], 1))
                    i = j
                if not xs:
                    continue
                x, y, d = np.concatenate(xs), np.concatenate(ys), np.concatenate(far)
                x, y, d = x[x != y], y[x != y], d[x != y]
                if not len(x):
                    continue
                a, b = np.minimum(x, y), np.maximum(x, y)
                if forest and len(a) > 1:
                    order = np.lexsort((b, a, d))  # the most alike first
                    a, b, d = a[order], b[order], d[order]
                    some = spanning_pairs(a, b)
                    a, b, d = a[some], b[some], d[some]
                found.append((a, b, d))
                held += len(a)
                if held > 500_000:
                    yield from out()
                    found.clear()
                    held = 0
        if found:
            yield from out()

    return run


def _squeezed(names: np.ndarray) -> bytes:
    """The first 40 bits of ascending names, as differences byte by byte, compressed."""
    step = np.diff(names >> np.uint64(24), prepend=np.zeros(1, np.uint64))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(len(step), 8).T[:5]).tobytes())


def _spread(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(5, -1)
    return np.cumsum(np.ascontiguousarray(np.concatenate([planes, np.zeros((3, planes.shape[1]), np.uint8)]).T).view(np.uint64).ravel(), dtype=np.uint64)


def _evidence(shingle: int, whole: bool, asked: np.ndarray | None):
    """(node, n, names or parities) of texts that come with their digests, copies once from a task; all or those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.uint64)

        def wanted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch if asked is None else batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), asked)))

        for batch in pieces(wanted(), 1, 1 << 20):
            own = batch.column(0).to_numpy().view(np.uint64) ^ mix(np.diff(text_bytes(batch.column(1))[1]).astype(np.uint64))
            new = np.zeros(len(own), bool)
            new[np.unique(own, return_index=True)[1]] = True
            new &= ~np.isin(own, seen)
            seen = np.concatenate([seen, own[new]])
            batch = batch.filter(pa.array(new))
            names, at = shingle_sets(batch.column(1), shingle)
            n, node = np.diff(at), _set_names(names, at)
            size = [1 << max(0, int(CLASSES * k - 1).bit_length() - 3) for k in n.tolist()]
            blobs = [_squeezed(names[p:q]) if whole else names[p:q].tobytes() if q - p <= SMALL else parities(names[p:q], s).tobytes() for p, q, s in zip(at[:-1], at[1:], size)]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(blobs, pa.binary())], ["node", "n", "blob"])

    return run


def _try(whole: bool):
    def run(pairs: pa.Table, ends: pa.Table) -> pa.Table:
        """(a, b, verdict) of a block's pairs: 0 apart, 1 alike, 2 open."""
        a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
        node, n = ends.column("node").to_numpy(), ends.column("n").to_numpy()
        blobs = ends.column("blob").to_pylist()
        order = np.argsort(node)
        i, j = (order[np.searchsorted(node, x, sorter=order)] if len(node) else np.empty(0, np.int64) for x in (a, b))
        total = n[i] + n[j]
        verdict, differ, classes = np.zeros(len(a), np.int64), np.zeros(len(a)), np.ones(len(a))
        sets: dict[int, np.ndarray] = {}
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            p, q = blobs[x], blobs[y]
            if whole or (n[x] <= SMALL and n[y] <= SMALL):
                if whole:
                    for z, blob in ((x, p), (y, q)):
                        if z not in sets:
                            sets[z] = _spread(blob)
                    p, q = sets[x], sets[y]
                else:
                    p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                verdict[k] = 9 * shared >= 4 * total[k]
                continue
            least = min(len(s) for s, m in ((p, n[x]), (q, n[y])) if m > SMALL)
            p, q = (parities(np.frombuffer(s, np.uint64), least) if m <= SMALL else _folded(np.frombuffer(s, np.uint8), least) for s, m in ((p, n[x]), (q, n[y])))
            differ[k], classes[k], verdict[k] = np.bitwise_count(p ^ q).sum(dtype=np.int64), 8 * least, 2
        asked = verdict == 2
        # to look as alike as this at the bound, so many of the differing shingles must have met in pairs
        bound = total / 9
        met, mean = (bound - differ) / 2, np.maximum(bound * bound / (2 * classes), 1e-9)
        chance = np.where(met > mean, met - mean + met * np.log(mean / np.maximum(met, 1e-9)), 0.0)
        verdict[asked & (chance < CHANCE)] = 1
        verdict[asked & (9 * differ > total)] = 0
        return pa.table({"a": pa.array(a), "b": pa.array(b), "verdict": pa.array(verdict)})

    return run


def _forget(spark) -> None:
    """Lets the driver give up plans, broadcasts and shuffles of rounds that are over, and their memory.

    The session does so by itself every half hour, which is too late for many short jobs.
    """
    gc.collect()
    spark._jvm.System.gc()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, component) for every row of `docs`: chains of texts whose sets are 0.8 alike or more.

    Null and empty texts are copies of one another; texts of fewer words than a shingle are one
    shingle; rows that repeat an id are one document and link what each of them links; texts of any
    length are compared whole; an empty table gives no rows; columns other than the two aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("t"), F.col(text_col).alias("text"))
    rows, size = text.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sample = text.where(F.pmod("t", F.lit(max(1, rows // SAMPLE_DOCS))) == 0).dropDuplicates(["t"]).select("text")
    counts = sample.mapInArrow(_count(shingle), "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    common = counts.where(F.col("n") >= COMMON).select("name").toArrow().column("name").to_numpy().view(np.uint64)
    every = checkpoint(text.mapInArrow(_nodes(shingle), "doc_id long, t long, node long, n long, fp long, print binary"))
    ranges, bits = max(24, int(size) // RANGE_BYTES), min(64, 14 + int(size).bit_length())
    dealt = text.select("text").mapInArrow(_keys(shingle, common, ranges, bits), "range long, rows binary")
    keys = checkpoint(dealt.groupBy("range").applyInArrow(_shared(ranges), "key long, node long"))
    # buckets of the same sets meet the same pairs: the least key stands for them
    sets = keys.groupBy("key").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("set"), F.count("*").alias("m"))
    sets = sets.where("m > 1").groupBy("set", "m").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    keys = checkpoint(keys.join(sets, "key"))
    nodes = checkpoint(every.groupBy("node").agg(F.min("t").alias("t"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("print").alias("print")))

    def near_prints() -> DataFrame:
        reps = checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
        same = nodes.join(reps, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
        rep = lambda end: reps.select(F.col("fp").alias(end), F.col("rep").alias(f"{end}_"))
        balls = checkpoint(ball_links(reps.select("fp"))).join(rep("a"), "a").join(rep("b"), "b")
        return same.union(balls.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))).where("a <> b").distinct()

    def in_buckets(labels: DataFrame, forest: bool) -> DataFrame:
        own = nodes.select("node", "n", "print").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        held = keys.join(own.select("node", "component"), "node")
        mixed = checkpoint(held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"))
        cells = keys.join(mixed, "key").withColumn("i", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        if not forest:  # every two blocks of a bucket meet
            cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            cells = cells.withColumns({"i": F.least("i", "other"), "other": F.greatest("i", "other")})
        else:
            cells = cells.withColumn("other", F.col("i"))
        cells = cells.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", "i", "other")).alias("key"), "node")
        rows_ = cells.join(own, "node").select("key", "n", "node", "component", "print").repartition("key").sortWithinPartitions("key", "n")
        found = rows_.mapInArrow(_pairs(forest), "a long, b long, apart double")
        if not forest:
            return found.select("a", "b").distinct()
        # of every set the pair with the most alike; both ends choose, and buckets agree on how alike a pair is
        ends = found.select(F.explode(F.array("a", "b")).alias("node"), F.struct("apart", "a", "b").alias("pair"))
        return ends.groupBy("node").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct()

    def tried(some: DataFrame, groups: DataFrame, whole: bool) -> DataFrame:
        """The verdicts on pairs; sets are made anew from the texts that are asked for.

        `groups` are the components of the pairs. Each goes to one cell with others, or to cells of its
        own, one for every two blocks of its ends, if its sets are more than a cell should hold.
        """
        each = 4 if whole else 2
        ends = some.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(groups, "node").join(nodes.select("node", "t", "n"), "node")
        # steps are checkpointed so that plans stay short: the driver keeps every plan's metrics
        ends = checkpoint(ends.select("node", "t", "n", F.col("component").alias("group")))
        count, shingles = ends.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        parts = ends.groupBy("group").agg(F.ceil(F.sum("n") * each / BLOCK_BYTES).cast("int").alias("parts"))
        ends = checkpoint(ends.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1)))))
        if not count:
            return some.sparkSession.createDataFrame([], "a long, b long, verdict long")
        common = F.pmod(F.xxhash64("group"), F.lit(max(1, int(shingles) * each // CELL_BYTES)))
        one = ends.select(F.col("node").alias("a"), "group", "parts", F.col("part").alias("i"))
        two = ends.select(F.col("node").alias("b"), F.col("part").alias("j"))
        cell = F.when(F.col("parts") <= 1, common).otherwise(F.xxhash64("group", F.least("i", "j"), F.greatest("i", "j")))
        cells = checkpoint(some.join(one, "a").join(two, "b").select(cell.alias("cell"), "a", "b"))
        # digests alone go to all tasks: a broadcast of rows would stand many times its size in the driver
        few = ends.select("t").toArrow().column("t").to_numpy() if count <= BROADCAST_ENDS else None
        some_text = text.select("t", "text") if few is not None else text.join(ends.select("t").distinct(), "t", "left_semi").select("t", "text")
        made = some_text.mapInArrow(_evidence(shingle, whole, few), "node long, n long, blob binary")
        # a text of another set that has an asked one's digest finds no cell
        made = made.join(cells.select(F.col("cell").alias("place"), F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("place", "node", "n", "blob")
        _forget(spark)
        return checkpoint(cells.groupBy("cell").cogroup(made.groupBy("place")).applyInArrow(_try(whole), "a long, b long, verdict long"))

    ids = every.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    links = checkpoint(every.join(ids, "doc_id").select("a", F.col("node").alias("b")))
    done, labels = None, None
    for step in (0, 1, 2):
        _forget(spark)
        some = in_buckets(labels, step == 1) if step else near_prints()
        some = checkpoint(some if done is None else some.join(done, ["a", "b"], "left_anti"))
        groups = checkpoint(connected_components(some, about=some.count()))
        by_parity = tried(some, groups, False)
        _forget(spark)
        by_set = tried(by_parity.where("verdict = 2").select("a", "b"), groups, True)
        _forget(spark)
        found = by_parity.union(by_set).where("verdict = 1").select("a", "b")
        links = checkpoint(links.union(found))
        labels = checkpoint(connected_components(links, about=rows))
        done = some if done is None else checkpoint(done.union(some))
    _forget(spark)
    return in_files(every.select("doc_id", "node").join(labels, "node", "left"), rows).select("doc_id", F.coalesce("component", "node").alias("component"))
