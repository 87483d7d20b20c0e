"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits, each set where over half of its shingles' hashes set it. Two
fingerprints at distance three or less agree, in one of their two 32-bit halves, to within one
bit: half the radius. So every distinct fingerprint is sent, for each half, to that half's value
and to the values one bit below it (the ball of half the radius, of which one direction is
enough), and meets there all that it may link to. What a bucket verifies leaves it as a spanning
forest, never as all pairs, so a large group of near copies costs rows in proportion to itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.text import pieces, text_bytes
from vellum.operators.graph import connected_components, local_forest
from vellum.session import BYTES_PER_FILE, checkpoint, in_files, small_batches

SEED = 42
#: Fingerprints of a bucket that are compared in one place.
BLOCK = 16_384


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text: A-Z lowered, words joined by single spaces."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            raw, at = text_bytes(batch.column(1))
            whole = raw.tobytes()
            found = np.fromiter((fingerprint(whole[a:b], shingle) for a, b in zip(at[:-1], at[1:])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def _close(a: np.ndarray, b: np.ndarray, most: int, ida: np.ndarray, idb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pairs of a x b at `most` differing bits or fewer, block by block as forests."""
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= most)
        if len(x):
            p, q = local_forest(ida[i + x], idb[y])
            out_a.append(p)
            out_b.append(q)
    return np.concatenate(out_a), np.concatenate(out_b)


def _buckets(radius: int, split: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by their first column, the bucket or a cell of it; then key and fp."""
        rest: list[np.ndarray] = []

        def solve(cell, key, fp):
            value = key.view(np.uint64) >> np.uint64(1)
            half = np.where(key & 1 == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
            home, at = value & np.uint64(0xFFFFFFFF) == half, fp.view(np.int64)
            out_a, out_b = [], []
            edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            first, size = edge[:-1], np.diff(edge)
            homes = np.add.reduceat(home.astype(np.int64), first) if len(cell) else first
            for i, n in zip(first[(size > 1) & (homes > 0)], size[(size > 1) & (homes > 0)]):
                f, r, h = fp[i : i + n], at[i : i + n], home[i : i + n]
                for a, b in (_close(f[h], f[h], radius, r[h], r[h]), _close(f[~h], f[h], radius, r[~h], r[h])):
                    out_a.append(a)
                    out_b.append(b)
            if out_a:
                a, b = local_forest(np.concatenate(out_a), np.concatenate(out_b))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def columns(x):
            return (x[0], x[1], x[2].view(np.uint64)) if split else (x[0], x[0], x[1].view(np.uint64))

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))  # the last bucket may go on
            if cut:
                yield from solve(*columns([x[:cut] for x in now]))
            rest = [x[cut:] for x in now]
        if rest and len(rest[0]):
            yield from solve(*columns(rest))

    return run


def ball_links(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that span the links among distinct fingerprints; `prints` is (fp).

    A bucket of more than `block` fingerprints is cut into blocks, each pair of which is a cell of its own.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the halves' ball of one bit covers a radius of 3 at most")
    halves = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("fp", 32).cast("long").alias("half")),
            F.struct(F.lit(1).alias("side"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
        )
    )
    side = prints.select("fp", halves.alias("h")).select("fp", "h.side", "h.half")
    below = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("half").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    values = F.concat(F.array("half"), F.transform(F.filter(below, lambda bit: bit != 0), lambda bit: F.col("half") - bit))
    rows = side.select("fp", "side", F.explode(values).alias("value")).select((F.col("value") * 2 + F.col("side")).alias("key"), "fp")
    out = "a long, b long"
    # a bucket holds those of its own half and of 32 others at most, so few of a half make no large one
    most = side.groupBy("side", "half").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if 33 * (most or 0) <= block:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_buckets(radius, False), out)
    large = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    plain = rows.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    mine = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
    cells = rows.join(large, "key").select("key", "fp", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    cells = cells.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "key", "fp")
    return plain.mapInArrow(_buckets(radius, False), out).union(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_buckets(radius, True), out))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Null and empty texts have fingerprint zero and link like any other; rows that repeat an id
    stay apart as rows, each under its own fingerprint; a null id takes part under its fingerprint and
    gets the least id of its component, null if that has none. Ids may be any long. Texts of any length
    are read whole; an empty table gives no rows; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    prints = checkpoint(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"))
    rows = prints.count()
    reps = checkpoint(in_files(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), rows))
    ends = connected_components(ball_links(reps.select("fp"), radius, block), about=rows)
    named = checkpoint(reps.join(ends.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = named.join(least, "component").select("fp", "component_id")
    return in_files(prints.join(known, "fp"), rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each near-duplicate group: that with the least id.

    Groups are chains of texts whose sets of five-word shingles are 0.8 alike or more
    (`near.jaccard_components`): the balls around fingerprints of these shingles bring the nearest
    together, and as 64 bits are too few for the rest, a search that loses no pair follows.
    Rows with a null id can't be named in a group and stay; rows that repeat an id are one document.
    """
    from vellum.llm.near import jaccard_components

    groups = checkpoint(jaccard_components(docs, id_col, text_col))
    keep = groups.groupBy("component").agg(F.min("doc_id").alias("_keep_id")).where("_keep_id IS NOT NULL").select("_keep_id")
    kept = docs.join(keep, docs[id_col] == keep["_keep_id"], "left_semi")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return in_files(kept, size, BYTES_PER_FILE).unionByName(in_files(docs.where(F.col(id_col).isNull()), size, BYTES_PER_FILE))
