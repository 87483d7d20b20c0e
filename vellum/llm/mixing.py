"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's words lie on one line per shard, documents in seeded order, and each line is cut
into blocks of `block_words` words. The blocks that the whole mix holds go to sources by highest
quotients target / (2 k + 1), a source's blocks to groups of its shards and a group's to its shards
in the same way, so that no place sees more than some thousand of them, and a shard takes
its quota as whole passes over its blocks plus a seeded choice among them for the rest. Only
identifiers and sizes are shuffled; a large source has as many shards as its size asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.text import WORD, release_memory, text_bytes, words
from vellum.session import BYTES_PER_FILE, checkpoint, in_files, small_batches

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 19
#: Shards of a source whose quotas are dealt in one place.
GROUP_SHARDS = 4096
SEED = 17


def fill_targets(sizes: np.ndarray, weights: np.ndarray, repeats: float = REPEATS) -> np.ndarray:
    """Shares of the sum of sizes by weight, none above `repeats` times its size."""
    total, capped = float(sizes.sum()), np.zeros(len(sizes), bool)
    target = np.zeros(len(sizes))
    while not capped.all():
        level = max(0.0, total - repeats * float(sizes[capped].sum())) / weights[~capped].sum()
        over = ~capped & (weights * level > repeats * sizes)
        target = np.where(capped, repeats * sizes, weights * level)
        if not over.any():
            break
        capped |= over
        target = np.where(capped, repeats * sizes, target)
    return target


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 k + 1), at most `most` each; ties to the earlier.

    The divisor is bisected until no more than the ties are open, so many seats cost no more
    than few.
    """
    seats = int(min(seats, most.sum()))
    if seats <= 0 or not (votes > 0).any():
        return np.zeros(len(votes), np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), np.where(votes > 0, most, 0)).astype(np.int64)

    seats = int(min(seats, most[votes > 0].sum()))
    low, high = float(votes[votes > 0].min()) / (4.0 * seats + 4), 4.0 * float(votes.max())
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if given(mid).sum() >= seats else (low, mid)
    got = given(high)  # at most `seats`; what is missing are ties at this divisor
    while got.sum() < seats:
        quotient = np.where(got < most, votes / (2 * got + 1), -1.0)
        got[int(np.argmax(quotient))] += 1
    return got


def _coprime(n: int, seed: int) -> int:
    a = seed % n or 1
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a


def _apportion_sources(block: int, shard_words: int, weights: tuple[float, ...]):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", key=lambda k: k.map(lambda x: (x == "", x.encode()))).reset_index(drop=True)
        size = part["source_size"].to_numpy(np.float64)
        target = fill_targets(size, np.resize(np.array(weights), len(part)))
        part["target"] = target
        part["quota"] = sainte_lague(target, round(target.sum() / block), REPEATS * np.ceil(size / block).astype(np.int64))
        part["shards"] = np.maximum(1, np.ceil(size / shard_words)).astype(np.int64)
        return part[["key", "source_size", "target", "quota", "shards"]]

    return run


def _apportion_groups(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("group").reset_index(drop=True)
    part["quota"] = sainte_lague(part["words"].to_numpy(np.float64), int(part["quota"].iloc[0]), REPEATS * part["blocks"].to_numpy(np.int64))
    return part[["key", "group", "quota"]]


def _apportion_shards(block: int, seed: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard").reset_index(drop=True)
        n = np.ceil(part["shard_size"].to_numpy(np.float64) / block).astype(np.int64)
        quota = sainte_lague(part["shard_size"].to_numpy(np.float64), int(part["quota"].iloc[0]), REPEATS * n)
        at_least_one = np.maximum(n, 1)
        part["blocks"], part["passes"], part["rest"] = n, quota // at_least_one, quota % at_least_one
        draw = np.random.default_rng([seed, len(part), int(part["group"].iloc[0])]).integers(1, 2**31, (2, len(part)))
        part["step"] = [_coprime(int(k), int(x)) for k, x in zip(at_least_one, draw[0])]
        part["shift"] = draw[1] % at_least_one
        return part[["key", "shard", "blocks", "passes", "rest", "step", "shift"]]

    return run


_SELECTION = ("start", "blocks", "passes", "rest", "step", "shift")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    """Each row's doc_id, source, size and, for a null id, what stands for it in the seeded order."""
    key = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col)))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), size.alias("size"), spread.alias("spread"), *more)


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], block_words: int, shard_words: int, seed: int, whole: bool) -> tuple[DataFrame, int]:
    """The rows of _sized with their place and their shard's quota, and their count.

    With `whole` every row carries all its columns as `row`, so nothing is joined by its id.
    """
    sized = checkpoint(_sized(docs, id_col, text_col, source_col))
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    plan = "key string, source_size long, target double, quota long, shards long"
    sources = sources.groupBy(F.lit(0).alias("_all")).applyInPandas(_apportion_sources(block_words, shard_words, weights), plan)
    sources = F.broadcast(checkpoint(sources.coalesce(1)))  # one group, one file; texts aren't dealt by source
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "spread"), "shards")
    shards = sized.join(sources, "key").withColumn("shard", shard).groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shards = shards.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS))
    groups = shards.groupBy("key", "group").agg(F.sum("shard_size").alias("words"), F.sum(F.ceil(F.col("shard_size") / block_words)).alias("blocks"), F.first("quota").alias("quota"))
    groups = groups.groupBy("key").applyInPandas(_apportion_groups, "key string, group long, quota long")
    shards = shards.drop("quota").join(groups, ["key", "group"])
    quotas = shards.groupBy("key", "group").applyInPandas(_apportion_shards(block_words, seed), "key string, shard long, blocks long, passes long, rest long, step long, shift long")
    rows = _sized(docs, id_col, text_col, source_col, F.struct(*(docs[c] for c in docs.columns)).alias("row")) if whole else sized
    dealt = rows.join(sources, "key").withColumn("shard", shard).repartition("key", "shard")
    order = [F.xxhash64(F.lit(seed + 1), "doc_id", "spread"), F.col("doc_id"), F.col("size"), *([F.col("row").getField(text_col)] if whole else [])]
    line = Window.partitionBy("key", "shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0).cast("long"))).join(quotas, ["key", "shard"]), sized.count()


def _taken(block_words: int) -> Column:
    """The words that the mix takes of a row."""
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")

    def of_block(b):
        times = F.col("passes") + F.when(F.pmod(F.col("step") * b + F.col("shift"), F.col("blocks")) < F.col("rest"), 1).otherwise(0)
        words_in = F.least((b + 1) * block_words, F.col("start") + F.col("size")) - F.greatest(b * block_words, F.col("start"))
        return times * words_in

    return F.when(F.col("size") > 0, F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, b: acc + of_block(b))).otherwise(F.lit(0).cast("long"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """What the mix takes of every row of `docs`.

    Returns doc_id, size, source_size, target and taken, and for the selection itself `start`
    (the row's place on its shard's line), blocks, passes, rest, step and shift: block b is taken
    passes + (1 if (step * b + shift) mod blocks < rest else 0) times. Null and empty texts have
    size zero and take nothing; null is a source of its own, last in order; rows that repeat an
    id are rows of their own, rows without one are dealt by their text; an empty table gives none;
    texts of any length are counted whole; extra columns are not read. One row a source meets in one task.
    """
    placed, rows = _placed(docs, id_col, text_col, source_col, weights, block_words, shard_words, seed, False)
    return in_files(placed, rows).select("doc_id", "size", "source_size", "target", _taken(block_words).alias("taken"), *_SELECTION)


def _rewrite(text_at: int, length_at: int | None, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-6]
            start, blocks, passes, rest, step, shift = (c.to_numpy(zero_copy_only=False) for c in batch.columns[-6:])
            raw, at = text_bytes(batch.column(text_at))
            texts = []
            for i in range(batch.num_rows):
                body = raw[at[i] : at[i + 1]]
                s, e, _ = words(body, np.array([0, len(body)]))
                b = (start[i] + np.arange(len(s))) // block
                times = passes[i] + ((step[i] * b + shift[i]) % blocks[i] < rest[i])
                whole, out = body.tobytes(), []
                for k in range(int(times.max(initial=0))):
                    live = times > k
                    if live.all():
                        out.append(whole)
                        continue
                    edge = np.flatnonzero(np.diff(np.r_[0, live.astype(np.int8), 0]))
                    out.append(b"\n".join(whole[s[x] : e[y - 1]] for x, y in zip(edge[::2], edge[1::2])))
                texts.append(b"\n\n".join(out).decode("utf-8", "replace"))
            columns[text_at] = pa.array(texts, pa.string())
            if length_at is not None:
                columns[length_at] = pa.array([len(t) for t in texts], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-6])
        release_memory()

    return run


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """`docs` as the mix takes them: texts are the taken blocks, a second and third pass following
    the first after an empty line; documents of which nothing is taken are left out. Every row goes
    by its own line of the plan, whether its id is repeated, null or neither."""
    small_batches(docs.sparkSession)
    placed, _ = _placed(docs, id_col, text_col, source_col, weights, block_words, shard_words, seed, True)
    chosen = placed.where(_taken(block_words) > 0).select("row.*", *(F.col(c).alias(f"_mix_{c}") for c in _SELECTION))
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return in_files(chosen, size, BYTES_PER_FILE).mapInArrow(_rewrite(docs.columns.index(text_col), length_at, block_words), docs.schema)
