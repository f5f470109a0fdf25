"""Corpus pipeline: quality rules, near-dedup, decontamination, masking, encoding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of all rows of
`docs`; all but the last return the columns of documents, in their order, and
drop any others.  `run` writes each result as Parquet in the shared checkpoint
folder, reads it for the next, and deletes it once that one is written.

Edge cases: a null or empty text fails the quality rules, and passes the other
stages as it is; near-dedup keeps one of equal rows, and judges rows that share
an id each by its own text; a row without id is never a near duplicate; null
languages and sources stay null; texts of any length are whole; an empty table
gives an empty result at every stage, an empty benchmark removes nothing, and
without labels only the exact quality rules hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import op2_decontamination, op3_pii, op6_quality_rules, op7_byte_bpe, op8_minhash
from normloom.llm.common import cut, folder, small, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity from which documents are near duplicates here, in hundredths; the 85 of op8 is its own contract's.
NEAR_PERCENT = 80


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with own, which names a row together with its id."""
    return docs.select(*COLUMNS).withColumn("own", F.xxhash64(F.col("text").cast("string")))


def _is(other: DataFrame) -> F.Column:
    return F.col("doc_id").eqNullSafe(other["gone_id"]) & (F.col("own") == other["gone_own"])


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents that are not among the rows (doc_id, own) of `gone`."""
    gone = small(gone.toDF("gone_id", "gone_own").distinct())
    return _keyed(docs).join(gone, _is(gone), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return op6_quality_rules.kept_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each class of near duplicates, one row of it."""
    judged = cut(op8_minhash.near_duplicates(docs, NEAR_PERCENT).select("doc_id", "own", "kept", (F.col("n_shingles") > 0).alias("full")))
    out = _without(docs, judged.where("not kept").select("doc_id", "own"))
    again = cut(judged.where("kept and full and doc_id is not null").groupBy("doc_id", "own").count().where("count > 1").select(F.col("doc_id").alias("gone_id"), F.col("own").alias("gone_own")))
    if not again.head(1):
        return out
    again, keyed = small(again), _keyed(out)
    one = keyed.join(again, _is(again), "left_semi").dropDuplicates(["doc_id", "own"])
    return keyed.join(again, _is(again), "left_anti").unionByName(one).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in benchmark windows."""
    judged = op2_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, cut(judged.where("contaminated").select("doc_id", "own")))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kinds."""
    return op3_pii.mask(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of each document."""
    return op7_byte_bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", mask),
    ("byte_bpe", encode),
]

#: The stages are models, token merges and graph components, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of `sf_dir`."""
    own = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{own}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of whatever file system it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
