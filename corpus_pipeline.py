"""The corpus pipeline: quality, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a frame that is written
as Parquet and read again as the next one's docs. All stages but the last return the columns of documents.

Defined results, for each stage: a null text is an empty one (and stays null where the stage keeps it); other columns than those of
documents are left out, whatever their names; repeated rows are judged each, and near-dedup keeps one of them; an empty table gives
no rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.llm import packing, quality, secrets, simhash, toxicity
from staffloom.llm.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.3
#: Near copies share so much of their shingles of so many words; fingerprints of so many differing bits are candidates.
NEAR = {"width": 5, "radius": 20, "similarity": 0.8}
#: Rows of whole texts that go to a Python worker at once; Spark's 10,000 would be held several times over, beside a full heap.
BATCH_ROWS = 1_000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose texts reach Python in batches of ``BATCH_ROWS`` at most. The session keeps that setting, as the returned frame is planned when it is used."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    found = quality.measured(docs.select(*COLUMNS))
    cutoffs = quality.fit_cutoffs(found.select("doc_id", "lang", "_m", "_md5", "_base_failed"), table(spark, sf_dir, "labels"))
    return quality.apply_cutoffs(found, cutoffs).where("kept").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once: of rows with that id the one with the smallest text.

    Rows with a null id can't be named, so all of them stay.
    """
    own = docs.select(*COLUMNS)
    first = simhash.near_duplicates(own.select("doc_id", "text"), **NEAR).where("doc_id = component_id").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(*COLUMNS[1:])
    named = own.join(first, "doc_id", "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*COLUMNS)
    return named.union(own.where(F.col("doc_id").isNull()))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets within the texts are masked; n_chars follows."""
    found = secrets.scan_documents(docs.select(*COLUMNS))
    masked = found.select("doc_id", F.when(F.col("text").isNotNull(), secrets.redacted(F.col("_text"), F.col("_spans"))).alias("text"), "lang", "source", F.when(F.size("_spans") > 0, F.lit(None)).otherwise(F.col("n_chars")).alias("n_chars"))
    return masked.withColumn("n_chars", F.coalesce("n_chars", F.char_length("text").cast("long"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]
STAGES = [(name, in_small_batches(stage)) for name, stage in STAGES]

#: The stages are fitted models, a graph search and a packing search: not for SQL. They are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
