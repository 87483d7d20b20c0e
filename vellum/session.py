"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "vellum-checkpoints-"


def get_spark(app: str = "vellum", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a temporary folder of this machine is
    taken instead, which is then also where checkpoints go.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            found = "file://" + tempfile.mkdtemp(prefix=LOCAL_CHECKPOINTS)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession)
    return _without_vast_size(df.checkpoint(eager))


def _without_vast_size(df: DataFrame) -> DataFrame:
    """`df`, a checkpoint, without the estimate of its size if no long can hold it.

    A checkpoint keeps the estimate of the plan it was made by, and a join's is the product of its
    sides', so over rounds of joins the estimate's digits multiply until they fill the driver.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution().logical()
    if plan.stats().sizeInBytes() < 1 << 63:
        return df
    none, sql = spark._jvm.scala.Option.empty(), spark._jvm.org.apache.spark.sql
    plan = sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none)
    return type(df)(sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


#: Rows that go to a Python worker at once where they hold whole texts.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lowers the session's Arrow batches to `rows` rows, unless they are smaller already.

    A batch of texts stands in memory twice, in the executor and in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


#: Rows of a few numbers that one file of a table holds at least, and bytes of text.
ROWS_PER_FILE, BYTES_PER_FILE = 100_000, 8 << 20


def in_files(df: DataFrame, rows: int, each: int = ROWS_PER_FILE) -> DataFrame:
    """`df`, known to have about `rows` rows, in no more partitions than these fill: no small files."""
    return df.coalesce(max(1, -(-int(rows) // each)))


#: Rows of a table that one task sorts.
ROWS_PER_TASK = 500_000


def spread(df: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """`df`, a table as it is read, dealt by `keys` over as many tasks as it has lots of `rows` rows.

    A task's share and memory then stay the same as the table grows, and a table that is few bytes but
    much work, which the engine would leave in one task, has as many tasks as there are cores at least.
    """
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) if rows >= ROWS_PER_TASK else 1)
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
