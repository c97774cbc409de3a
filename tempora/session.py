"""The Spark session that the command line, the benchmark and the tests share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Taken for the shared folder where spark.checkpoint.dir is unset and one machine does all the work, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/tempora"
#: Bytes of rows that travel to a Python worker in one Arrow batch, while an intermediate table is written.
BATCH_BYTES = 4 << 20


#: Intermediate tables that this process wrote and did not remove yet.
_written: list[str] = []


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Return a session pinned to UTC, with adaptive execution; an active session is reused."""
    return (
        SparkSession.builder.master(master)
        .appName("tempora")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it only a local session has one."""
    if set_to := spark.conf.get("spark.checkpoint.dir", None):
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: there is no folder that driver and executors share")
    return FALLBACK_DIR


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES at most, or less if the session says so; afterwards the session is as before.

    An executor holds a batch several times over, in its own buffers and in a worker. It bounds memory, not results.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = spark.conf.get(name, None)  # with a default given, a value that nobody set does not come back
    if 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if set_to is None else spark.conf.set(name, set_to)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to a table in the shared folder and return the reread table.

    This cuts the lineage like a checkpoint, but survives lost executors, is columnar and prunes columns.
    """
    path = f"{shared_dir(df.sparkSession)}/tempora-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many intermediate tables this process wrote and did not remove: a mark for `sweep`."""
    return len(_written)


def sweep(spark: SparkSession, *kept: DataFrame, since: int = 0) -> int:
    """Remove the intermediate tables written since a mark, but those that `kept` read; how many went.

    To be called when results that rest on them are written elsewhere.
    """
    wanted = {f.rstrip("/").rpartition("/")[0] for df in kept for f in df.inputFiles()}
    gone = [p for p in _written[since:] if not any(w.endswith(p.rpartition("/")[2]) for w in wanted)]
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in gone:
        path_of(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path_of(p), True)
        _written.remove(p)
    return len(gone)
