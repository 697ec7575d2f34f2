"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronoweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one in the warehouse, which all executors share too."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


#: Paths of the tables written in each open scope, the innermost one last.
_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors.

    Shuffle files of the write go when it is done, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoweave/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that materialise() writes in this block when the block ends.

    Yields keep(df): the tables that df reads are left to the enclosing block, or, in
    the outermost one, to whoever reads df.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.update(p for p in made if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in files))
        return df

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.pop()
        if _scopes:
            _scopes[-1].extend(p for p in made if p in kept)
        for path in made:
            if path not in kept:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
