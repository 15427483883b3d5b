"""Staged tables: intermediate results written to the folder that all executors share.

A staged table cuts lineage, survives the loss of executors and is read back column by column. The folder is the one
named by ``spark.checkpoint.dir``; only where a local session names none (tests, notebooks) a local one is made.
What a result still reads stays until the driver's Python ends or ``sweep`` is called.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_BASES: set[tuple] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables, as the session names it."""
    at = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "lorekiln-stages")
        spark.conf.set(_SETTING, at)
    return at.rstrip("/")


class Stages:
    """Writes staged tables of one query and removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _BASES.add((spark.sparkContext, self.base))

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the table as read back."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path  # noqa: SLF001
        return out

    def put_bytes(self, data: bytes, name: str) -> str:
        """Write a small file and return its address."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        out = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
        try:
            for k in range(0, len(data), 1 << 20):
                out.write(bytearray(data[k : k + (1 << 20)]))
        finally:
            out.close()
        return p.toString()

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove staged tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = getattr(t, "_staged_at", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep() -> None:
    """Remove all staged tables of this process; results that still read them cannot be computed any more."""
    while _BASES:
        sc, base = _BASES.pop()
        if sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(base)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    try:
        sweep()
    except Exception:  # noqa: BLE001  # the JVM may be gone already
        pass


def spread(table: DataFrame) -> DataFrame:
    """A scanned table on at least as many partitions as tasks can run at once. Large tables come in enough splits and
    stay as they are; a table in one small file is dealt out, as work on its texts costs far more than moving them."""
    n = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(n) if table.rdd.getNumPartitions() < n else table
