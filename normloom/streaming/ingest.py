"""Incremental ingest: a file stream of documents, each micro-batch's paragraphs appended as Parquet."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from normloom.sources.readers import paragraphs


def start(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string"):
    """A query that reads new files of `source` once and appends their paragraphs to `target`.

    A batch is written under its number and replaced if it is run again, so a
    restart after a failure leaves each batch once.
    """

    def write(batch: DataFrame, number: int) -> None:
        paragraphs(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(spark: SparkSession, source: str) -> DataFrame:
    """Paragraphs of all files now below `source`, by way of the stream.

    State and results are in the folder that `spark.checkpoint.dir` names; only
    a session of one machine without it, such as a test, uses a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ingest")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    folder = f"{base}/ingest-{uuid.uuid4().hex}"
    source = source.rstrip("/")
    # a stream reads folders or patterns: this pattern is the source itself, file or folder
    start(spark, f"{source[:-1]}[{source[-1]}]", f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", "pos", "raw")
