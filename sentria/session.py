"""Session defaults and lineage control."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # At test scale fact tables would fit the default limit; keep them shuffled, as on a cluster.
    "spark.sql.autoBroadcastJoinThreshold": "2MB",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sentria")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a temporary folder; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="sentria-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint, so that lost executors never lose the rows."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=eager)


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/sentria-{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Repartition a small-in-bytes, heavy-in-compute frame over all cores, into ``least`` tasks or more.

    An explicit partition number keeps adaptive execution from merging the rows
    back into a few tasks because they take up few bytes. Give ``least``, a number
    that follows the rows (``tasks_for``), where a task holds what it makes of them.
    """
    spark = df.sparkSession
    tasks = max(
        2 * spark.sparkContext.defaultParallelism,
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        least,
    )
    return df.repartition(tasks, *keys)


#: Rows that a task sorts or collects at a time, where the number of tasks follows the rows.
TASK_ROWS = 250_000


def tasks_for(*tables: DataFrame) -> int:
    """Number of tasks for the largest of some stored tables, whose rows are counted from file footers.

    Adaptive execution sizes partitions by their compressed bytes; rows of keys that
    compress well then take a task's memory many times over.
    """
    rows = max(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def spread_cells(df: DataFrame, *keys: str) -> DataFrame:
    """``spread``, with equal cells side by side in each task, so that kernels run once for them.

    Rows are dealt by ``keys``, the pair, and not by the cell: a cell that a third of
    all pairs share must not end up in one task.
    """
    return spread(df, *keys).sortWithinPartitions("n11", "n1_", "n_1", "N")


def settle(df: DataFrame, *keys: str) -> DataFrame:
    """Put an exchange on top of a frame that several parts of one plan consume.

    Spark then reuses its shuffle files for all of them. Without it each consumer
    would merge the partial aggregates below again, which at scale are many times
    the size of the result. Keep every column that consumers need among the keys
    or in all consumers, so that the exchanges stay identical. Adaptive execution
    still sizes the partitions.
    """
    return df.repartition(*keys)
