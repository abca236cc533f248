"""What the training-data operators share: a durable work folder, numbering of rows, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to so many bytes, as counted rows times bytes a row.
BROADCAST_BYTES = 16 << 20
#: A key is hot if it has more than one in so many rows.
HOT_KEYS = 20_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, on one machine only, one under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the work folder, removed when the application ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Cuts lineage: writes df to the work folder and returns a scan of it.

    The files outlive any executor. free asks at once for the removal of the shuffle files behind df, which else waits for the driver's
    next collection of garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if work_dir(spark).rpartition("/")[2] in name:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes is within BROADCAST_BYTES, else df for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def split_join(rows: DataFrame, table: DataFrame, on: str, total: int, most: int, row_bytes: int = 32, how: str = "inner") -> DataFrame:
    """rows joined to table (on, n, others): one row a key, n the number of rows with that key, total their sum, most no fewer than table's rows.

    Within the bound the table is broadcast. Beyond it rows of hot keys meet a broadcast of these, of which there can be no more than
    HOT_KEYS, and only the others are shuffled, so no task gets the rows of a hot key together.
    """
    if most * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table.drop("n")), on, how)
    table = materialize(table, "table")
    hot = F.broadcast(table.where(F.col("n") > F.lit(total / HOT_KEYS)).drop("n"))
    plain = table.where(F.col("n") <= F.lit(total / HOT_KEYS)).drop("n")
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(plain, on, how))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that what a task makes of its texts is small however large a batch is. Workers outlive their tasks, so what is free goes back."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()
        _trim_heap()


def _trim_heap() -> None:
    """Hands free pages of the C heap back to the system, where its library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
