"""Queries of ordered analytics: runs, barriers, repetitions, batches and persistent members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.aggregate import mode_of_deltas
from vellum.operators.runs import batches, boundary_pairs, dead_duplicates, ordinal, persistent_members, prefix_runs, repeated_within, state_runs
from vellum.operators.spatial import merged_length
from vellum.plans.registry import query
from vellum.session import read_table, spread


@query(
    "state_runs",
    """
WITH o AS (SELECT user_id, event_type, ts, event_id, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, SUM(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, event_type, CAST(island AS BIGINT) AS island, COUNT(*) AS length FROM i GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3
""",
)
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_runs(read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"], ["event_type"], 3)


@query(
    "dedup_runs",
    """
WITH o AS (SELECT l_orderkey, l_returnflag AS f, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w OR row_number() OVER w = 1 AS new FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
i AS (SELECT *, SUM(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n, p, s ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT l_orderkey, sha256(f) AS digest, CAST(island AS BIGINT) AS island, COUNT(*) AS blocks, COUNT(*) - 1 AS saved FROM i GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2
""",
)
def dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_orderkey")
    return prefix_runs(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag", 2, 1, 1).drop("size")


@query(
    "dead_duplicates",
    """
WITH e AS (SELECT user_id, event_id, ts, event_type, SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events)
SELECT event_id FROM (SELECT event_id, lead(1) OVER (PARTITION BY user_id, epoch, event_type ORDER BY ts, event_id) AS later FROM e WHERE event_type <> 'signup') WHERE later IS NOT NULL
""",
)
def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return dead_duplicates(events, ["user_id"], ["ts", "event_id"], "event_type", F.col("event_type") == "signup").select("event_id")


@query(
    "boundary_coalesce",
    """
SELECT event_id FROM (SELECT event_id, event_type, lead(event_type) OVER w AS nt, event_id % 2 AS k, lead(event_id % 2) OVER w AS nk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view' AND nt = 'click' AND k = nk
""",
)
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").withColumn("key", F.col("event_id") % 2)
    return boundary_pairs(events, ["user_id"], ["ts", "event_id"], "event_type", "key", "view", "click").select("event_id")


@query(
    "batch_chunks",
    """
SELECT l_suppkey, CAST(floor((rn - 1) / 64) AS BIGINT) AS batch, COUNT(*) AS members, MIN(l_orderkey) AS low, MAX(l_orderkey) AS high FROM
(SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) GROUP BY 1, 2
""",
)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches(read_table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return rows.groupBy("l_suppkey", "batch").agg(F.count("*").alias("members"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@query(
    "mode_pitch",
    """
WITH d AS (SELECT CAST(round(abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) * 10000) AS BIGINT) AS k FROM lineitem),
c AS (SELECT k, COUNT(*) AS support FROM d WHERE k > 0 GROUP BY k)
SELECT k / 10000.0 AS pitch, support, CAST((SELECT SUM(support) FROM c) AS BIGINT) AS total FROM c WHERE support >= 32 AND support >= (SELECT SUM(support) FROM c) * 0.01 ORDER BY support DESC, k LIMIT 1
""",
)
def pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode_of_deltas(read_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity").withColumn("pitch", F.col("pitch").cast("double"))


@query(
    "persistent_objects",
    """
WITH n AS (SELECT COUNT(DISTINCT event_type) AS n FROM events), u AS (SELECT user_id, COUNT(DISTINCT event_type) AS support, MIN(event_type) AS first FROM events GROUP BY 1)
SELECT user_id, support, CASE WHEN support = n THEN 'all' ELSE 'after-first' END AS mode FROM u, n
WHERE support >= 3 AND (support = n OR (support = n - 1 AND first <> (SELECT MIN(event_type) FROM events)))
""",
)
def persistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").where("event_type IS NOT NULL").select("user_id", "event_type")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())  # the pages, a handful
    page = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")) - 1
    return persistent_members(events.withColumn("page", page), "user_id", "page", len(kinds))


@query(
    "repeated_in_page",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, line, length(line) >= 400 AS strong, length(line) >= 20 AS medium FROM l),
c AS (SELECT doc_id, line, COUNT(*) AS same FROM m WHERE medium GROUP BY 1, 2), p AS (SELECT doc_id, SUM(same) AS everything FROM c GROUP BY 1)
SELECT doc_id, COUNT(*) AS candidates FROM m LEFT JOIN c USING (doc_id, line) LEFT JOIN p USING (doc_id) WHERE strong OR (medium AND (same >= 3 OR everything >= 8)) GROUP BY 1
""",
)
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    rows = repeated_within(lines, "doc_id", "line", F.length("line") >= 400, F.length("line") >= 20)
    return rows.groupBy("doc_id").agg(F.count("*").alias("candidates"))


@query(
    "glyph_ordinals",
    "SELECT l_partkey, MAX(k) AS last, CAST(SUM(k * l_linenumber) AS BIGINT) AS digest FROM (SELECT l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) - 1 AS k FROM lineitem) GROUP BY 1",
)
def glyph_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordinal(read_table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"], "k").withColumn("k", F.col("k").cast("long"))
    return rows.groupBy("l_partkey").agg(F.max("k").alias("last"), F.sum(F.col("k") * F.col("l_linenumber")).cast("long").alias("digest"))


@query(
    "union_coverage_1d",
    """
WITH i AS (SELECT user_id, epoch_us(ts) / 1e6 AS low, epoch_us(ts) / 1e6 + value * 1000 AS high FROM events),
s AS (SELECT *, MAX(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i WHERE high > low),
p AS (SELECT *, SUM(CASE WHEN reach IS NULL OR low > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS piece FROM s),
g AS (SELECT user_id, piece, MAX(high) - MIN(low) AS length FROM p GROUP BY 1, 2)
SELECT user_id, COUNT(*) AS pieces, round(SUM(length), 3) AS length FROM g GROUP BY 1
""",
)
def union_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = read_table(spark, sf_dir, "events").select("user_id", start.alias("low"), (start + F.col("value") * 1000).alias("high"))
    return merged_length(rows, ["user_id"], "low", "high").withColumn("length", F.round("length", 3))
