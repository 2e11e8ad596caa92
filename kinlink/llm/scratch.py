"""Shared working storage of multi-stage operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from kinlink.sources.shared import cut, shared_dir

__all__ = ["bound_batches", "cut", "fresh_path", "release", "shield", "stored", "type_of"]

#: Rows and bytes of text in a batch between the JVM and Python: what a task holds at once on either side.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_made: dict[str, SparkSession] = {}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES; texts are longer than the defaults expect."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, str(BATCH_BYTES))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; ``release`` deletes what is written there."""
    path = f"{shared_dir(spark).rstrip('/')}/kinlink-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its true size is then known to the planner.

    ``group_bytes``: size of a row group where rows are of megabytes; tasks hold a group at once.
    """
    path = fresh_path(df.sparkSession, name)
    write = df.write
    if group_bytes:
        write = write.option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 2).option("parquet.block.size.row.check.max", 8)
    write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*keep: str) -> None:
    """Delete the working tables made so far, but for the paths ``keep``, which from now on are the caller's.

    Results are lazy and read them, so call this when what was asked for is written.  It runs when the driver ends, too.
    """
    for path in [p for p in _made if p not in keep]:
        spark = _made.pop(path)
        if spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _at_exit() -> None:
    try:
        release()
    except Exception:  # the session may be gone already; the folder's owner then clears it
        _made.clear()


atexit.register(_at_exit)


def shield(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that could clash with an operator's working columns (a leading underscore) renamed, and the way back.

    ``own``: columns that the operator is told to use, which keep their names.
    """
    names = {c: f"in-{c}" for c in df.columns if c.startswith("_") and c not in own}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def type_of(df: DataFrame, column: str) -> str:
    """SQL type of a column, for schemas that carry ids of any type."""
    return df.schema[column].dataType.simpleString()
