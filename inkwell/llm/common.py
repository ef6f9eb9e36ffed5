"""What several operators need: shared storage, safe column names, byte helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder and any other
    session a folder beside its warehouse; a warehouse on a machine's own disk
    is refused there, since other machines would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            found = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_inkwell"
            if found.startswith(("/", "file:")) and "cluster" not in spark.sparkContext.master:
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage is cut and
    a lost executor costs no recomputation.  The files go when the driver ends,
    or earlier through ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkwell_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove what ``stored`` wrote for ``df``; nothing may read it afterwards."""
    p, fs = _path(df.sparkSession, df._inkwell_path)
    fs.delete(p, True)


#: Bytes of rows that a Python worker gets at once.
WORKER_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``WORKER_BYTES``, since texts may be long
    and a worker holds a batch in several forms."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().strip()
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = now.rstrip("kmgb")
    if not digits.isdigit() or int(digits) * units.get(now[len(digits) : len(digits) + 1] or "b", 1) > WORKER_BYTES:
        spark.conf.set(key, f"{WORKER_BYTES}b")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def text_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text; null stays null."""
    return c.cast("string").cast("binary")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
