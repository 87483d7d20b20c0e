"""Exact duplicates: fingerprints, canonical members, redirects and savings gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import checkpoint


def fingerprint(payload: Column, dictionary: Column | None = None, domain: str = "", ignored: Sequence[str] = ("Length",)) -> Column:
    """SHA-256 over a domain tag, the payload and a map's entries in key order.

    Every part goes in with its length, so parts can't run into one another; entries named in
    `ignored` count for nothing. A null payload has no fingerprint.
    """
    part = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    whole = F.concat(part(F.lit(domain)), F.octet_length(payload).cast("string"), F.lit(":"), F.hex(payload))
    if dictionary is not None:
        kept = F.array_sort(F.map_entries(F.map_filter(dictionary, lambda k, _: ~k.isin(*ignored))))
        whole = F.concat(whole, F.coalesce(F.array_join(F.transform(kept, lambda e: F.concat(part(e["key"]), part(F.coalesce(e["value"], F.lit("null"))))), ""), F.lit("")))
    return F.sha2(whole.cast("binary"), 256)


def duplicate_stats(df: DataFrame, payload: str) -> DataFrame:
    """One row: groups of equal payloads and the bytes that all but one of each waste; nulls left out."""
    per = df.where(F.col(payload).isNotNull()).select(F.sha2(F.col(payload).cast("binary"), 256).alias("d"), F.octet_length(payload).cast("long").alias("size"))
    groups = per.groupBy("d").agg(F.count("*").alias("n"), F.min("size").alias("size")).where("n > 1")
    return groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0).cast("long")).alias("wasted_bytes"))


def duplicate_roles(df: DataFrame, payload: str, role: str) -> DataFrame:
    """Duplicate groups and wasted bytes by role: a group's one role, `mixed`, or `other` without any."""
    per = df.where(F.col(payload).isNotNull()).select(F.sha2(F.col(payload).cast("binary"), 256).alias("d"), F.octet_length(payload).cast("long").alias("size"), F.col(role).alias("role"))
    # least and greatest tell none, one and several apart without collecting the roles
    groups = per.groupBy("d").agg(F.count("*").alias("n"), F.min("size").alias("size"), F.min("role").alias("low"), F.max("role").alias("high")).where("n > 1")
    name = F.when(F.col("low").isNull(), "other").when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed")
    return groups.groupBy(name.alias("role")).agg(F.count("*").alias("duplicate_groups"), F.sum((F.col("n") - 1) * F.col("size")).alias("wasted_bytes"))


def redirects(df: DataFrame, key: str, fp: str) -> DataFrame:
    """(key, canonical): the least key with the same fingerprint, for all but canonical rows themselves."""
    least = df.where(F.col(fp).isNotNull()).groupBy(fp).agg(F.min(key).alias("canonical"), F.count("*").alias("n")).where("n > 1").drop("n")
    return df.join(least, fp).where(F.col(key) != F.col("canonical")).select(key, "canonical")


def rewrite_references(edges: DataFrame, moved: DataFrame, dst: str = "dst", key: str = "key") -> DataFrame:
    """Edges whose targets follow redirects (key, canonical) to their end; others stay.

    Chains may have any length; redirects that run in a circle have no end and are an error.
    """
    closed = checkpoint(moved.select(F.col(key).alias("_k"), F.col("canonical").alias("_to")))
    for _ in range(2 + closed.count().bit_length()):  # every round doubles the length of the chains it has followed
        ahead = closed.select(F.col("_k").alias("_to"), F.col("_to").alias("_next"))
        longer = checkpoint(closed.join(ahead, "_to", "left").select("_k", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_moved")))
        closed = longer.drop("_moved")
        if longer.where("_moved").isEmpty():
            break
    else:
        raise ValueError("redirects run in a circle")
    return edges.join(closed, edges[dst] == closed["_k"], "left").withColumn(dst, F.coalesce("_to", dst)).drop("_k", "_to")


def scoped_duplicates(df: DataFrame, fp: str, scope: str, size: str, least_copies: int = 2, least_scopes: int = 2, least_bytes: int = 1024) -> DataFrame:
    """(fp, copies, scopes, saved): groups that recur in several scopes and would save enough."""
    by_scope = df.where(F.col(fp).isNotNull()).groupBy(fp, scope).agg(F.count("*").alias("n"), F.min(size).alias("size"))
    groups = by_scope.groupBy(fp).agg(F.sum("n").alias("copies"), F.count(scope).alias("scopes"), F.min("size").alias("size"))
    groups = groups.withColumn("saved", (F.col("copies") - 1) * F.col("size"))
    return groups.where((F.col("copies") >= least_copies) & (F.col("scopes") >= least_scopes) & (F.col("saved") >= least_bytes)).select(fp, "copies", "scopes", "saved")


def factor_groups(df: DataFrame, body: str, least_copies: int, least_saved: int, least_size: int = 0) -> DataFrame:
    """(body, copies, saved): bodies worth writing once, by copies, size and bytes saved."""
    size = F.octet_length(body).cast("long")
    groups = df.where(F.col(body).isNotNull() & (size >= least_size)).groupBy(body).agg(F.count("*").alias("copies"))
    groups = groups.withColumn("saved", (F.col("copies") - 1) * F.octet_length(body))
    return groups.where((F.col("copies") >= least_copies) & (F.col("saved") >= least_saved))


def fixed_point_canonical(nodes: DataFrame, edges: DataFrame, key: str = "key", body: str = "body", depth: int | None = None) -> DataFrame:
    """(key, canonical) of nodes that are equal with everything they refer to, or refer to in `depth` steps.

    Nodes start apart only by their bodies; each round splits a class by the classes its members
    point at, slot by slot, until no class splits: the coarsest partition that keeps equals together,
    cycles included. That is at most as many rounds as there are nodes.
    """
    links = edges.select(F.col("src").alias("_s"), F.col("slot").alias("_slot"), F.col("dst").alias("_d"))
    classes = checkpoint(nodes.select(F.col(key), F.sha2(F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary")), 256).alias("class")))
    count, steps = classes.agg(F.count_distinct("class")).first()[0], 0
    while depth is None or steps < depth:
        seen = links.join(classes, links["_d"] == classes[key], "left").select("_s", F.concat_ws("=", "_slot", F.coalesce("class", F.lit("null"))).alias("at"))
        told = seen.groupBy("_s").agg(F.array_join(F.array_sort(F.collect_list("at")), ";").alias("at"))
        joined = classes.join(told, classes[key] == told["_s"], "left")
        classes = checkpoint(joined.select(key, F.sha2(F.concat_ws("|", "class", F.coalesce("at", F.lit(""))), 256).alias("class")))
        now = classes.agg(F.count_distinct("class")).first()[0]
        if now == count:
            break
        count, steps = now, steps + 1
    least = classes.groupBy("class").agg(F.min(key).alias("canonical"))
    return classes.join(least, "class").select(key, "canonical")


def earliest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Each row with its group's first row's order columns, as first_<name>."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({f"first_{o}": F.first(o).over(w) for o in order})
