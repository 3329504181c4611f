"""Checking files as they arrive: a file stream whose batches are checked and appended to a table of verdicts.

Each batch is checked by itself, so nothing is kept between batches but the stream's own list of files that it has seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shapewright.functions.codes import Extra, Mode
from shapewright.operators import diff as differ
from shapewright.operators.anomalies import file_findings
from shapewright.operators.baseline import Baseline
from shapewright.plans.scan import refusal_findings
from shapewright.sources import profile as prof


def checked(spark: SparkSession, files: list[tuple[int, str, int]], baseline: Baseline, mode: str, extra: str) -> DataFrame:
    """(path, bucket, partition, findings) of some files."""
    rows = prof.profile(spark, files, persist=False).withColumn("norm_names", F.coalesce("norm_names", F.array().cast("array<string>")))
    own = F.when(F.col("bucket").isin("profiled", "degraded"), differ.diff_findings(baseline, mode, extra)).otherwise(F.concat(file_findings(), refusal_findings()))
    found = rows.withColumn("findings", own)
    return found.select("path", "bucket", differ.partition(F.col("findings")).alias("partition"), "findings")


def watch(spark: SparkSession, folder: str, baseline: Baseline, out: str, checkpoint: str, mode: str = Mode.NAME, extra: str = Extra.STRICT, once: bool = False, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts the stream; verdicts go to Parquet under out, a folder for each batch, so that a batch that runs again replaces itself."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(folder).select("path", "length")

    def each(batch: DataFrame, number: int) -> None:
        # at most files_per_batch rows
        files = [(i, r.path.removeprefix("file:").replace("///", "/", 1) if r.path.startswith("file:") else r.path, r.length) for i, r in enumerate(batch.orderBy("path").collect())]
        checked(batch.sparkSession, files, baseline, Mode(mode), Extra(extra)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
