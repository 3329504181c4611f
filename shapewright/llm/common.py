"""What the operators share: the folder for written tables, lineage cuts, small literal tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows beyond which a table built from parameters is refused as a literal.
MAX_LITERAL_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder is made, for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(made := "file://" + tempfile.mkdtemp(prefix="shapewright-"))
    return made


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Paths that cut() wrote, a list for each scope that is open.
_scopes: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and lost executors lose nothing.

    The files go at the end of the innermost scratch(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/shapewright-{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def outside() -> Iterator[None]:
    """What cut() writes inside belongs to the scope around the innermost one."""
    held = _scopes.pop() if _scopes else None
    try:
        yield
    finally:
        if held is not None:
            _scopes.append(held)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes inside are deleted at the end: for a step whose result is written before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            fs, at = _at(spark, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of parameters as a plan literal: no RDD, no Python worker."""
    if len(rows) > MAX_LITERAL_ROWS:
        raise ValueError(f"{len(rows)} rows are too many for a literal; at most {MAX_LITERAL_ROWS}")
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("__row"))
    return made.select("__row.*")


#: Rows of an Arrow batch of texts at most. A batch is held in the JVM's direct memory and again in Python's; Spark's 10,000 rows of
#: texts are tens of megabytes for each running task.
TEXT_ROWS = 1_000


def text_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on rows of Arrow batches to TEXT_ROWS; a lower one stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
