"""URL filtering by association rules that FP-growth mines from labelled addresses.

Every address is a set of tokens: its scheme, the suffixes of its host, its path's segments with
digits levelled, its ending and its query's keys. Parallel FP-growth finds the token sets that are
frequent under a label: tokens below the least support go first, equal sets are counted together,
each token's conditional base (what stands before it in order of frequency) is one group, and sets
grow in it to `max_tokens` tokens and no further, so a long address costs a polynomial and not, as
with the library's miner, which lists all frequent sets, a power of two. Sets that predict a label with
enough support, confidence and lift, and that no more general rule predicts as well, become rules.
An inverted index holds each rule under its rarest token, so an address meets only rules of which
it has that token. Explicit host and path rules go before mined ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.session import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MAX_TOKENS = 0.01, 0.7, 1.2, 4
BLOCK, ALLOW = "block", "allow"
#: Frequent tokens, and rules, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lowered; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting (host, path, verdict) of a short list as its string and its verdict, else nulls.

    A rule fits its host and all subdomains where the path starts with its own; of equal lengths
    the longer host wins, then the smaller string.
    """
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of an address; an empty array for null."""
    parts = F.split(host_of(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(parts, -i, i), ".")))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    levelled = F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(F.translate(s, UPPER, LOWER), r"\d+", "0")))
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    query = F.transform(keys, lambda k: F.concat(F.lit("key:"), k))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^(.*?)://", 1)), F.concat(F.lit("mark:"), F.when(url.contains("#"), "#").otherwise("")))
    return F.coalesce(F.array_distinct(F.concat(scheme, suffixes, levelled, query)), F.array().cast("array<string>"))


def _grow(of_label: dict[str, int], total: int, min_support: float, min_confidence: float, min_lift: float, max_tokens: int):
    """Rules whose least frequent token is the group's, from its conditional base (token, before, label, n)."""
    names = sorted(of_label)
    shares = np.array([of_label[x] / total for x in names])

    def sets(has: np.ndarray, weight: np.ndarray, live: np.ndarray, chosen: list[int], start: int) -> Iterator[tuple[list[int], np.ndarray]]:
        """The chosen tokens' counts by label, then those of all that they grow to, in one order of tokens."""
        counts = weight[live].sum(0)
        yield chosen, counts
        if len(chosen) + 1 < max_tokens:
            ahead = has[live, start:].T @ weight[live]
            for t in np.flatnonzero((ahead >= min_support * total).any(1)):
                yield from sets(has, weight, live[has[live, start + t] > 0], [*chosen, start + int(t)], start + int(t) + 1)

    def run(table: pa.Table) -> pa.Table:
        token = table.column("token")[0].as_py()
        before, label = table.column("before").to_pylist(), table.column("label").to_pylist()
        others = sorted({t for x in before for t in x})
        at, place = {t: i for i, t in enumerate(others)}, {x: i for i, x in enumerate(names)}
        has, weight = np.zeros((len(before), len(others))), np.zeros((len(before), len(names)))
        for i, (x, y, n) in enumerate(zip(before, label, table.column("n").to_pylist())):
            has[i, [at[t] for t in x]] = 1
            weight[i, place[y]] = n
        out = []
        for chosen, counts in sets(has, weight, np.arange(len(before)), [], 0):
            every = counts.sum()
            for k in np.flatnonzero((counts >= min_support * total) & (counts >= min_confidence * every)):
                lift = counts[k] / every / shares[k]
                if lift >= min_lift:
                    out.append((sorted([token, *(others[c] for c in chosen)]), names[k], counts[k] / total, counts[k] / every, lift))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.list_(pa.string()), pa.string(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["tokens", "verdict", "support", "confidence", "lift"])

    return run


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Rules (tokens, verdict, support, confidence, lift, key) from `labelled` (tokens, label).

    `key` is the rule's rarest token, under which the index holds it. No labelled rows: no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("label").isNotNull() & (F.size("tokens") > 0))
    whole = checkpoint(rows.groupBy(F.array_sort("tokens").alias("tokens"), "label").agg(F.count("*").alias("n")))
    of_label = {r["label"]: r["n"] for r in whole.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    n = sum(of_label.values())
    rule = "tokens array<string>, verdict string, support double, confidence double, lift double"
    if not n:
        return spark.createDataFrame([], rule + ", key string")
    # tokens below the least support can't be in a rule; those of all rows add nothing to one
    single = whole.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("all")).where(F.col("all") >= min_support * n)
    single = checkpoint(single.where(F.col("all") < n) if min_lift > 1 else single)
    few = F.broadcast(single) if single.count() <= BROADCAST_ROWS else single
    kept = whole.withColumn("id", F.monotonically_increasing_id()).select("id", "label", "n", F.explode("tokens").alias("token")).join(few, "token")
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("all")).alias("r"), "token"))), lambda x: x["token"])
    sets = kept.groupBy("id", "label", "n").agg(items.alias("items")).groupBy("items", "label").agg(F.sum("n").alias("n"))
    bases = sets.select("label", "n", "items", F.posexplode("items").alias("k", "token")).select("token", F.expr("slice(items, 1, k)").alias("before"), "label", "n")
    bases = bases.groupBy("token", "before", "label").agg(F.sum("n").alias("n"))
    rules = checkpoint(bases.groupBy("token").applyInArrow(_grow(of_label, n, min_support, min_confidence, min_lift, max_tokens), rule))
    # a rule goes where one with a part of its tokens predicts the same at least as surely
    subsets = F.transform(F.sequence(F.lit(1), F.expr("cast(pow(2, size(tokens)) as int) - 2")), lambda m: F.filter("tokens", lambda _, i: F.expr("1").cast("int") == F.pmod(F.floor(m / F.pow(F.lit(2), i)), F.lit(2))))
    larger = rules.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode(subsets).alias("part"))
    general = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("c"))
    spare = larger.join(general, ["part", "verdict"]).where("c >= confidence").select("tokens", "verdict").distinct()
    rules = rules.join(spare, ["tokens", "verdict"], "left_anti")
    rarest = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("all", "token")).alias("key"))
    return rules.join(rarest, ["tokens", "verdict"])


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, **limits: float) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for every row of `pages`.

    `labelled` has (url, label). `mined` is the deciding mined rule's tokens where one fits: that of
    the highest confidence, then support, then more tokens, then order. Null urls and those without
    :// have an empty host and path and no host rule; rows that repeat an id are judged one by one;
    addresses of any length are read whole; an empty table gives no rows; extra columns are not read.
    """
    found = mine_rules(labelled.select(tokens_of(F.col("url")).alias("tokens"), "label"), **limits)
    url = F.col(url_col)
    name, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumns({"rule": name, "fixed": verdict})
    # what a mined rule says depends on the url alone, so open urls are asked once each
    open_ = rows.where("rule IS NULL AND url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    index = checkpoint(found.select("key", F.col("tokens").alias("needs"), F.col("verdict").alias("says"), "confidence", "support"))
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    met = open_.withColumn("key", F.explode("tokens")).join(index, "key").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max_by(F.struct("says", "needs"), F.struct("confidence", "support", F.size("needs"), "says", F.array_join("needs", " ")))
    judged = met.groupBy("url").agg(best.alias("best"))
    out = rows.join(judged, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", "best.says", F.lit(default)).alias("verdict"), F.when(F.col("rule").isNull(), F.col("best.needs")).alias("mined"))
