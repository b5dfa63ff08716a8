"""The corpus pipeline: documents without toxic ones, copies and near copies, mixed to target weights, as sampled piece ids.

STAGES are functions of (spark, docs, sf_dir); each result is written as Parquet to the shared folder and read again as the
next stage's documents. A result has to be written before the next stage is called, which deletes the tables it was made from.
Columns of the documents may have any names: those the stages add are made unique against them, and all but the last stage
return the columns they got. Empty tables give empty results.
"""

from __future__ import annotations

from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import exact_dedup, jaccard, mixing, pieces, toxicity
from tickweave.llm.common import dropped, free, scope, table, written
from tickweave.llm.q_labels import TOXIC
from tickweave.llm.q_rows import model_path


#: Intermediate tables of the last stage of each application.
_LEFT: dict[str, list[str]] = {}


def stage(f):
    """A stage deletes the intermediate tables of the one before it, whose result has been written by then."""
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        dropped(spark, left)
        with scope() as folders:
            out = f(spark, docs, sf_dir)
        left += folders
        return out

    return run_stage


@stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below the limit; labels of the training rows teach the scores."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=docs.columns, score=free(docs, "_score"))
    return scored.where(F.col(free(docs, "_score")) < TOXIC).select(*docs.columns)


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the one exact dedup keeps."""
    return exact_dedup.keep_rows(docs, exact_dedup.exact_dedup(docs).where("kept"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that numbers its rows, and the column's name: doc_id may be null, repeated, or stand on different texts.

    The files of a stage's result do not change, so a scan of them gives the same numbers each time it is read; anything but a plain
    scan is written first.
    """
    row = free(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018  only a plain scan has it
    except AnalysisException:
        rows = written(rows, "pipeline-rows")
    return rows, row


@stage
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row with the smallest doc_id (null last); all rows without words stay."""
    rows, row = numbered(docs)
    found = jaccard.jaccard_join(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))
    keep = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(first.alias("first")).select(f"first.{row}")
    return rows.join(written(keep, "pipeline-near"), row, "left_semi").select(*docs.columns)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (rounded to whole documents), in training order; repeated rows count one by one."""
    rows, row = numbered(docs)
    due = free(docs, "_due")
    plan = written(mixing.mix(rows.select("doc_id", "source", "text", F.col(row).alias("row_number")), keep=["row_number"]), "pipeline-mix").where("takes > 0")
    times = F.array(F.col("time_1"), F.coalesce("time_2", F.lit(2.0)))
    plan = plan.select(F.col("row_number").alias(row), F.explode(F.slice(times, F.lit(1), F.col("takes"))).alias(due))
    return rows.join(plan, row).orderBy(due, "doc_id", row).select(*docs.columns)


@stage
def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each row: doc_id, sample, log_prob, log_inclusion, n_tokens, ids."""
    return pieces.encode(docs, pieces.Vocabulary.load(model_path()), k=2)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing", mixed),
    ("SentencePiece encoding", as_pieces),
]

#: Hashed folds, labelled neighbours and sampling have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = written(f(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    dropped(spark, _LEFT.get(spark.sparkContext.applicationId, []))
    return docs
