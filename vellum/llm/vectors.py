"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.graph import connected_components, local_forest
from vellum.session import checkpoint, in_files

COSINE = 0.98
TABLES, PROBES, SEED = 6, 2, 5
#: Vertices that a bucket's code is made of; more of them make smaller buckets and miss more links.
HASHES = 1
#: Vectors of the search above which a block is WIDER times larger: there are blocks enough for all
#: tasks by then, and a vector goes to its bucket once for each block. Links are the same either way.
BUCKETED, WIDER = 1 << 20, 8
BLOCK = 1024
VECTORS_PER_FILE = 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def cross_polytope(x: np.ndarray, tables: int, probes: int, seed: int, hashes: int = 1) -> np.ndarray:
    """Bucket codes, rows x tables x (1 + hashes * probes), the home bucket first.

    A code is made of `hashes` vertices: each the vertex of the cross-polytope closest to the vector
    after three rounds of random signs and a Hadamard transform. A probe takes the next closest
    vertex in one of them.
    """
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    take = min(1 + probes, 2 * width)
    rng = np.random.default_rng(seed)
    codes = np.empty((len(x), tables, 1 + hashes * probes), np.int64)
    for t in range(tables):
        tops = []
        for _ in range(hashes):
            y = x
            for signs in rng.choice([-1.0, 1.0], (3, width)):
                y = hadamard(y * signs)
            both = np.concatenate([y, -y], axis=1)  # vertex v and its opposite v + width
            top = np.argpartition(-both, take - 1, axis=1)[:, :take] if take < 2 * width else np.tile(np.arange(take), (len(x), 1))
            order = np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable")
            tops.append(np.take_along_axis(top, order, 1).astype(np.int64))
        base = (2 * width) ** np.arange(hashes, dtype=np.int64)
        home = sum(top[:, 0] * w for top, w in zip(tops, base))
        codes[:, t, :] = home[:, None]
        for k in range(hashes):
            for j in range(1, take):
                codes[:, t, k * probes + j] = home + (tops[k][:, j] - tops[k][:, 0]) * base[k]
    return codes


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component goes first so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows_of_buckets(tables: int, probes: int, seed: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes):
                part = batch.filter(pa.array(sizes == width))
                rep, label, vector, _, copies = part.columns
                codes = cross_polytope(_unit(_matrix(vector)), tables, probes, seed, hashes)
                # one row for each distinct bucket of a table; the home bucket is the first
                n, per = len(codes), codes.shape[2]
                row = np.repeat(np.arange(n), tables * per)
                table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), per), n)
                home = np.tile(np.arange(per) == 0, n * tables)
                packed = codes.astype(np.int32 if codes.max() < 1 << 31 else np.int64).reshape(n, -1)
                every = pa.array([packed[i].tobytes() for i in range(n)], pa.binary())
                live = home | (codes.reshape(-1) != np.repeat(codes[:, :, 0].reshape(-1), per))
                row, at = row[live], pa.array(row[live])
                yield pa.RecordBatch.from_arrays([label.take(at), pa.array(np.full(len(row), width, np.int32)), pa.array(table[live]), pa.array(codes.reshape(-1)[live]), pa.array(home[live]), rep.take(at), vector.take(at), copies.take(at), every.take(at)], ["label", "width", "table", "code", "home", "rep", "vector", "copies", "codes"])

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of code rows (pairs x tables x codes): the first table and bucket where they meet."""
    none = np.iinfo(np.int64).max
    ab = np.where((a[:, :, :1] == b).any(2), a[:, :, 0], none)
    ba = np.where((b[:, :, :1] == a).any(2), b[:, :, 0], none)
    low = np.minimum(ab, ba)
    table = (low < none).argmax(1)
    return table, np.take_along_axis(low, table[:, None], 1)[:, 0]


def _verify(tables: int, cosine: float):
    def run(part: pa.Table) -> pa.Table:
        """One block pair of a bucket: the links that first meet here, as counts and a forest."""
        home = part.column("home").to_numpy(zero_copy_only=False)
        rep, side, copies = (part.column(c).to_numpy() for c in ("rep", "side", "copies"))
        x = _unit(_matrix(part.column("vector").combine_chunks()))
        raw = part.column("codes").to_pylist()
        codes = np.frombuffer(b"".join(raw), np.int32 if part.column("narrow")[0].as_py() else np.int64).reshape(len(raw), tables, -1).astype(np.int64)
        table, code = part.column("table")[0].as_py(), part.column("code")[0].as_py()
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        a_out, b_out, node_out, n_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, (1 << 18) // max(1, len(right)))
        for i in range(0, len(left), step):
            own = left[i : i + step]
            p, q = np.nonzero(x[own] @ x[right].T >= cosine - 1e-9)
            p, q = own[p], right[q]
            # side 0 is one block with itself, 1 and 2 are two blocks of a pair
            go = (home[p] | home[q]) & (rep[p] != rep[q]) & ((side[p] != 0) | (rep[p] < rep[q]))
            p, q = p[go], q[go]
            exact = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
            p, q = p[exact], q[exact]
            t, c = _first_meeting(codes[p], codes[q])
            p, q = (z[(t == table) & (c == code)] for z in (p, q))
            if len(p):
                node, at = np.unique(np.concatenate([rep[p], rep[q]]), return_inverse=True)
                node_out.append(node)
                n_out.append(np.bincount(at, np.concatenate([copies[q], copies[p]])).astype(np.int64))
                ends = local_forest(rep[p], rep[q])
                a_out.append(ends[0])
                b_out.append(ends[1])
        a, b = local_forest(np.concatenate(a_out), np.concatenate(b_out))
        node, at = np.unique(np.concatenate(node_out), return_inverse=True)
        n = np.bincount(at, np.concatenate(n_out), len(node)).astype(np.int64)
        none = pa.nulls(len(node), pa.int64())
        return pa.table({"a": pa.concat_arrays([pa.array(node), pa.array(a)]), "b": pa.concat_arrays([none, pa.array(b)]), "n": pa.concat_arrays([pa.array(n), pa.array(np.zeros(len(a), np.int64))])})

    return run


def cosine_groups(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, seed: int = SEED, block: int = BLOCK, hashes: int = HASHES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link if their labels are equal and not null and their vectors' cosine, in doubles, is at
    least `cosine`. Equal vectors of a label are one node of the search with a weight. A bucket
    larger than `block` is cut into blocks whose pairs are separate tasks, and a pair counts only in
    the first bucket in which it meets, so no pair is written out. Codes are the same for tables of
    any size: whether two vectors meet depends on the two alone, never on how many others there
    are, so the work of a bucket grows with its square. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without a label or id, link with nothing.
    Rows that repeat an id are vectors of their own: each has the links of its own vector, and a
    component the least id of its vectors. An empty table gives no rows; extra columns are not read.
    """
    values = F.col(vector_col).cast("array<double>")
    sane = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    able = F.coalesce(sane, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = checkpoint(table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(able, F.col(vector_col)).alias("vector")))
    total = rows.count()
    reps = rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # several vectors may have one id, so nodes are numbered; the numbers are part of the checkpoint
    reps = checkpoint(in_files(reps, total, VECTORS_PER_FILE).withColumn("rep", F.monotonically_increasing_id()))
    nodes = reps.select("rep", "label", "vector", F.size("vector").alias("width"), "copies")
    searched = nodes.count()
    block *= WIDER if searched > BUCKETED else 1
    kinds = dict(rows.dtypes)
    bucket = ["label", "width", "table", "code"]
    spread = nodes.mapInArrow(_rows_of_buckets(tables, probes, seed, hashes), f"label {kinds['label']}, width int, table int, code long, home boolean, rep long, vector {kinds['vector']}, copies long, codes binary")
    sizes = spread.groupBy(*bucket).agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).where("rows > 1 AND homes > 0")
    dealt = spread.join(sizes.withColumn("blocks", F.ceil(F.col("rows") / block).cast("int")), bucket)
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    narrow = F.octet_length("codes") == 4 * tables * (1 + hashes * probes)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select(*bucket, "home", "rep", "vector", "copies", "codes", narrow.alias("narrow"), "mine", other)
    side = F.when(F.col("other") == F.col("mine"), 0).when(F.col("other") > F.col("mine"), 1).otherwise(2)
    dealt = dealt.withColumns({"side": side, "i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
    found = checkpoint(dealt.groupBy(*bucket, "i", "j").applyInArrow(_verify(tables, cosine), "a long, b long, n long").repartition(1 + searched // VECTORS_PER_FILE))
    comps = connected_components(found.where("b IS NOT NULL").select("a", "b"), about=searched).withColumnRenamed("node", "rep")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    known = checkpoint(reps.join(counts, "rep", "left").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("vector IS NOT NULL").join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return in_files(linked.union(alone), total).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
