"""Language identification by Bayesian fusion of evidence.

A text's likelihood under each language comes from hashed byte trigrams counted over the whole
corpus by declared language. What a document declares, the suffix of its address and its host speak
next to it: how often each language's texts declare each code and stand under each suffix, and how
a host's own texts divide, smoothed by its domain, that by its suffix and that by the corpus.
All of these are grouped counts over all rows. A flat background language takes what fits none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.text import text_bytes
from vellum.llm.text import pieces as cut
from vellum.session import checkpoint, in_files, small_batches

BUCKETS, BITS = 4096, 12
#: Pseudo-counts: of a trigram bucket, of a declared code or suffix, of a level of hosts on the next.
TRIGRAM_PRIOR, EVIDENCE_PRIOR, HOST_PRIOR = 0.5, 1.0, 20.0
#: The weight of n trigrams, which are far from independent: TEMPER * sqrt(n).
TEMPER = 2.0
MIN_POSTERIOR = 0.5
#: Declaring rows that make a code a language: so many at most, and in a small corpus this share of all.
LEAST_DOCS, LEAST_SHARE = 10, 0.001
UNKNOWN = "und"
_rng = np.random.default_rng(77)
_TABLES = _rng.integers(0, 2**32, (3, 256), dtype=np.uint64).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_PLAIN = _LETTER.copy()
_PLAIN[[9, 10, 13, 32]] = True
#: Share of texts that the background is taken to have beforehand.
UNKNOWN_PRIOR = 0.001


def _trigrams(raw: np.ndarray) -> np.ndarray:
    """The bucket of the three lowered bytes that start at each position.

    Those of other bytes than letters and white space, such as numbers, keys and addresses hold,
    say nothing of a language: they share bucket zero, which every language gives the same odds.
    """
    plain = _PLAIN[raw]
    h = _TABLES[0][raw[:-2]] + _TABLES[1][raw[1:-1]] + _TABLES[2][raw[2:]]
    found = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)) % np.uint32(BUCKETS - 1) + np.uint32(1)
    return np.where(plain[:-2] & plain[1:-1] & plain[2:], found, np.uint32(0))


def _count(languages: Sequence[str]):
    codes = {c: i for i, c in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in cut(batches, 1, 1 << 20):
            raw, at = text_bytes(batch.column(1))
            if len(raw) < 3:
                continue
            code = np.array([codes.get(c, -1) for c in batch.column(0).to_pylist()])
            own = np.repeat(code, np.diff(at))
            own[np.concatenate([at[1:] - 1, at[1:] - 2]).clip(0)] = -1  # these reach into the next text
            own = own[:-2]
            live = own >= 0
            total += np.bincount(own[live] * BUCKETS + _trigrams(_LOWER[raw])[live], minlength=len(total))
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])], ["cell", "n"])

    return run


def _likelihoods(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 3, 1 << 20):
            raw, at = text_bytes(batch.column(3))
            raw = _LOWER[raw]
            stop = np.maximum(at[1:] - 2, at[:-1])
            n = (stop - at[:-1]).astype(np.float64)
            means = np.zeros((batch.num_rows, len(table)))
            if len(raw) > 2:
                buckets, sums = _trigrams(raw), np.zeros(len(raw) - 1)
                np.cumsum(buckets > 0, out=sums[1:])
                n = (sums[np.minimum(stop, len(sums) - 1)] - sums[np.minimum(at[:-1], len(sums) - 1)]) * (n > 0)
                for k, row in enumerate(table):
                    np.cumsum(row[buckets], out=sums[1:])
                    some = n > 0
                    means[some, k] = (sums[stop[some]] - sums[at[:-1][some]]) / n[some]
            letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
            flat = pa.array((means * (TEMPER * np.sqrt(n))[:, None]).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(table)), pa.int32()), flat)
            has = pa.array(letters[at[1:]] > letters[at[:-1]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists, has], ["id", "declared", "host", "text", "letters"])

    return run


def declared_language(html: Column) -> Column:
    """The primary code of a page's <html lang>; null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def identify(rows: DataFrame, id_col: str, text: Column, declared: Column, host: Column | None = None, languages: Sequence[str] | None = None, min_posterior: float = MIN_POSTERIOR) -> DataFrame:
    """(id, declared, text_language, language, posterior, accepted) for every row.

    `languages` are the codes told apart; left open they are the declared codes of two or three
    letters that at least LEAST_DOCS rows declare, or LEAST_SHARE of the declaring rows where that is
    fewer. A row is rejected if the background fits it best, if no language's posterior reaches
    `min_posterior`, or if its text has no letter; but a text with letters whose code of two or three
    letters is none of those told apart is then taken at its word, with that code and posterior zero,
    as nothing was learnt of it. Nulls in any evidence say nothing. Rows that repeat an id are judged one by one. Without any declared
    language nothing can be learnt and all rows are unknown. Texts of any length are read whole; an empty
    table gives no rows; other columns are not read.
    """
    small_batches(rows.sparkSession)
    code = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    site = F.lower(F.coalesce(host, F.lit(None).cast("string")) if host is not None else F.lit(None).cast("string"))
    base = rows.select(F.col(id_col).alias("id"), F.nullif(code, F.lit("")).alias("declared"), site.alias("host"), text.alias("text"))
    if languages is None:
        known = base.groupBy("declared").count().where("declared IS NOT NULL")
        total = known.agg(F.sum("count")).first()[0] or 0
        languages = sorted(r[0] for r in known.where(F.col("count") >= min(LEAST_DOCS, LEAST_SHARE * total)).collect())  # codes of three letters at most
    languages = [c for c in languages if re.fullmatch("[a-z]{2,3}", c)]
    if not languages:
        none = F.lit(None).cast("string")
        return base.select("id", "declared", none.alias("text_language"), F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    cells = base.select("declared", "text").mapInArrow(_count(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS at most
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"]
    counts = counts.reshape(len(languages), BUCKETS) + TRIGRAM_PRIOR
    counts[:, 0] = 0.0
    table = np.log(np.maximum(counts, TRIGRAM_PRIOR) / counts.sum(1, keepdims=True))
    table = np.vstack([table, np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32)
    table[:, 0] = 0.0
    scored = checkpoint(base.mapInArrow(_likelihoods(table), f"id {dict(base.dtypes)['id']}, declared string, host string, text array<double>, letters boolean"))
    return _fuse(scored, languages, min_posterior)


def _fuse(scored: DataFrame, languages: Sequence[str], min_posterior: float) -> DataFrame:
    size = len(languages)
    best = F.array_position("text", F.array_max("text")) - 1  # `size` stands for the background
    labels = F.split("host", r"\.")
    scored = scored.withColumns({"best": best.cast("int"), "suffix": F.when(F.col("host").contains("."), F.element_at(labels, -1)), "domain": F.when(F.size(labels) > 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1)))})
    sure = scored.where((F.col("best") < size) & F.col("letters"))
    of = lambda c: [F.count_if(F.col("best") == k).alias(f"{c}{k}") for k in range(size)]
    whole = [float(x) for x in sure.agg(*of("n")).first()]
    n = sum(whole)
    prior = [(x + 1.0) / (n + size) for x in whole]
    said = {r["declared"]: [r[f"d{k}"] for k in range(size)] for r in sure.where(F.col("declared").isin(*languages)).groupBy("declared").agg(*of("d")).collect()}  # a known code each
    out = scored
    for key, c in (("suffix", "s"), ("domain", "m"), ("host", "h")):
        out = out.join(sure.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"{c}n"), *of(c)), key, "left")

    def level(c: str, above: list[Column]) -> list[Column]:
        """Shares at a level of hosts, each smoothed by the level above."""
        total = F.coalesce(F.col(f"{c}n"), F.lit(0))
        return [(F.coalesce(F.col(f"{c}{k}"), F.lit(0)) + HOST_PRIOR * above[k]) / (total + HOST_PRIOR) for k in range(size)]

    # the suffix speaks as evidence, so the hosts' priors start from it: P(lang) P(suffix | lang) ~ P(lang | suffix)
    host = level("h", level("m", level("s", [F.lit(p) for p in prior])))
    codes = [sum(v[k] for v in said.values()) + EVIDENCE_PRIOR * size for k in range(size)]
    shares = [(d, [float(np.log((v[k] + EVIDENCE_PRIOR) / codes[k])) for k in range(size)]) for d, v in said.items()]
    # one row a language
    out = out.join(F.broadcast(scored.sparkSession.createDataFrame(shares, "declared string, said array<double>")), "declared", "left")
    terms = [F.col("text")[k] + F.coalesce(F.col("said")[k], F.lit(0.0)) + F.log(host[k]) for k in range(size)]
    # the background declares nothing and lives nowhere: an even share of every evidence
    flat = F.col("text")[size] + F.when(F.col("declared").isin(*said), float(-np.log(max(1, size)))).otherwise(0.0) + float(np.log(UNKNOWN_PRIOR))
    out = out.withColumn("terms", F.array(*terms, flat)).withColumn("top", F.array_max("terms"))
    mass = F.aggregate("terms", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    at = (F.array_position("terms", F.col("top")) - 1).cast("int")
    name = F.array(*[F.lit(c) for c in languages], F.lit(UNKNOWN))
    out = out.withColumns({"posterior": 1.0 / mass, "guess": name[at], "text_language": name[F.col("best")]})
    accepted = (F.col("guess") != UNKNOWN) & (F.col("posterior") >= min_posterior) & F.col("letters")
    # of a code without texts enough nothing is known that could speak against it
    left_out = F.col("letters") & ~F.col("declared").isin(*languages) & ~accepted
    left_out = F.coalesce(left_out, F.lit(False))
    language = F.when(left_out, F.col("declared")).when(F.col("letters"), F.col("guess")).otherwise(UNKNOWN)
    return out.select("id", "declared", "text_language", language.alias("language"), F.when(left_out, 0.0).otherwise(F.col("posterior")).alias("posterior"), (accepted | left_out).alias("accepted"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source", broadcast_rows: int = 20_000) -> DataFrame:
    """`docs` without the documents that no language can be named for.

    Every row is judged by what it holds, whether its id is repeated, null or neither; equal rows stay or
    go together. An empty table stays empty; other columns come back as they are, whatever their names.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    rows = docs.withColumn(key, F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (id_col, text_col, declared_col, host_col))))
    found = identify(rows, key, F.col(text_col), F.col(declared_col), F.col(host_col))
    gone = found.where("NOT accepted").select(F.col("id").alias(key)).distinct()
    gone = checkpoint(in_files(gone, docs.count()))
    if gone.limit(broadcast_rows + 1).count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
