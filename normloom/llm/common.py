"""Session helpers of the corpus operators: tables, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have; beyond it the plans shuffle both sides.
BROADCAST_ROWS = 1_000_000
#: Keys that hold over 1 / HOT of all rows each, and LEAST_HOT rows, are joined by broadcast.
HOT, LEAST_HOT = 500, 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from there.

    The folder is the one that `spark.checkpoint.dir` names (or that the
    session was given by hand).  Without any, a session of one machine, such as
    a test, gets a temporary one; on a cluster that is refused, since executors
    could not reach it.
    """
    folder(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, set if it was not."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    own = context.getCheckpointDir()
    if own is None:
        if not given:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            given = tempfile.mkdtemp(prefix="checkpoint")
            atexit.register(shutil.rmtree, given, ignore_errors=True)
        context.setCheckpointDir(given)
    return given or own


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for broadcast if its counted rows are within the bound."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= most else df


def map_text(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to every batch of `df`."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def skew_join(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of `rows` with one row a key, of which a few may have a great share of the rows.

    keyed: the keys, values, and n, the rows of each key; n is not in the
    result.  Keys with over 1 / `HOT` of all rows are fewer than `HOT`, so they
    are broadcast and their rows stay where they are; the others are shuffled.
    Both inputs should be cut, since they are read twice.
    """
    sizes = keyed.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    bound = (sizes["total"] or 0) / HOT
    if (sizes["most"] or 0) <= max(bound, LEAST_HOT):
        return rows.join(keyed.drop("n"), keys)
    hot = F.col("n") > max(bound, LEAST_HOT)
    mild = rows.join(F.broadcast(keyed.where(hot).select(*keys)), keys, "left_anti").join(keyed.where(~hot).drop("n"), keys)
    return rows.join(F.broadcast(keyed.where(hot).drop("n")), keys).unionByName(mild)
