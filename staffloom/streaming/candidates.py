"""A candidate table that follows a stream of intake rows: what a batch reads and writes follows the batch, not the table.

``<out>/candidates`` holds versions of rows by version and bucket (a hash of phone and name). Batch n is version 2n: it writes the candidates it changed or
added and reads the buckets of its own keys. A candidate is its row of the greatest version. ``<out>/commits`` has a row for each version that is
complete, with the greatest id so far; others are not seen. A batch that is run again reads what was there before it and replaces what
it wrote, so it counts once. ``compact`` merges the versions up to batch n into version 2n + 1, which stands for all before it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from staffloom.functions import text as x
from staffloom.operators.people import upsert_candidates

BUCKETS = 64
#: The bucket of rows without phone or name, which no intake row ever meets.
UNNAMED = -1


def bucket() -> Column:
    phone, name = x.clean(F.col("phone")), x.clean(F.col("name"))
    return F.when(phone.isNotNull() & name.isNotNull(), F.pmod(F.xxhash64(phone, name), F.lit(BUCKETS)).cast("int")).otherwise(UNNAMED)


def there(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


@dataclass
class Commits:
    """The complete versions that make up the table, in order, the greatest id of all, and the columns."""

    numbers: list[int]
    top: int = 0
    columns: str = ""


def committed(spark: SparkSession, out: str, below: int | None = None) -> Commits:
    """What is complete (below a number)."""
    if not there(spark, f"{out}/commits"):
        return Commits([])
    rows = spark.read.schema("top BIGINT, columns STRING, version BIGINT").parquet(f"{out}/commits")
    found = {r.version: r for r in (rows if below is None else rows.where(F.col("version") < below)).collect()}  # a row a version; compact keeps them few
    if not found:
        return Commits([])
    merged = max((v for v in found if v % 2), default=min(found))
    return Commits(sorted(v for v in found if v >= merged), max(r.top for r in found.values()), found[max(found)].columns)


def versions(spark: SparkSession, out: str, commits: Commits) -> DataFrame:
    columns = T.StructType.fromJson(json.loads(commits.columns)).add("version", T.LongType()).add("bucket", T.IntegerType())
    return spark.read.schema(columns).parquet(f"{out}/candidates").where(F.col("version").isin(commits.numbers))


def latest(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("candidate_id").orderBy(F.desc("version"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def current_candidates(spark: SparkSession, out: str) -> DataFrame | None:
    """The table after all complete batches; none before the first."""
    commits = committed(spark, out)
    return latest(versions(spark, out, commits)).drop("version", "bucket") if commits.numbers else None


def write_version(rows: DataFrame, out: str, number: int, top: int) -> None:
    spark = rows.sparkSession
    path = f"{out}/candidates/version={number}"
    rows.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    top = max(top, spark.read.schema(rows.schema).parquet(path).agg(F.coalesce(F.max("candidate_id"), F.lit(0))).first()[0])
    spark.createDataFrame([(top, rows.schema.json())], "top BIGINT, columns STRING").coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/version={number}")


def seed(existing: DataFrame, out: str) -> None:
    """Starts a table from candidates that are there already, unless it was started before."""
    if not committed(existing.sparkSession, out).numbers:
        write_version(existing, out, -2, 0)


def fold_batch(rows: DataFrame, out: str, number: int) -> None:
    """Folds intake rows into the table as batch ``number``, by the rules of ``upsert_candidates``."""
    spark = rows.sparkSession
    commits = committed(spark, out, 2 * number)
    if not commits.numbers:
        existing = rows.select(F.lit(None).cast("bigint").alias("candidate_id"), *[c for c in rows.columns if c not in ("seq", "error")]).limit(0)
    else:
        keys = rows.select(x.clean(F.col("phone")).alias("_p"), x.clean(F.col("name")).alias("_m"), bucket().alias("_b")).where(F.col("_b") != UNNAMED).distinct()
        touched = [r[0] for r in keys.select("_b").distinct().collect()]  # buckets, at most BUCKETS
        before = versions(spark, out, commits)
        own = before.where(F.col("bucket").isin(touched)) if touched else before.limit(0)
        own = own.withColumns({"_p": x.clean(F.col("phone")), "_m": x.clean(F.col("name"))}).join(keys.select("_p", "_m"), ["_p", "_m"], "left_semi")
        first = Window.partitionBy("_p", "_m").orderBy("candidate_id")  # of candidates with a key the smallest is the one that changes
        existing = latest(own).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_p", "_m", "version", "bucket")
    write_version(upsert_candidates(existing, rows.drop("error"), commits.top), out, 2 * number, commits.top)


def compact(spark: SparkSession, out: str) -> None:
    """Merges all versions but that of the last batch, which may be run again, and deletes those it merged. Cut off at any point, it can be run again."""
    commits = committed(spark, out)
    if len(commits.numbers) > 2:
        before = committed(spark, out, commits.numbers[-1])
        write_version(latest(versions(spark, out, before)).drop("version", "bucket"), out, before.numbers[-1] + 1, before.top)
    first = min(committed(spark, out).numbers, default=0)
    path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([out, *parts]))
    files = path("commits").getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in ("commits", "candidates"):
        for found in files.listStatus(path(folder)):
            name = found.getPath().getName()
            if name.startswith("version=") and int(name[8:]) < first:
                files.delete(path(folder, name), True)


def stream_candidates(stream: DataFrame, intake: Callable[[DataFrame], DataFrame], existing: DataFrame, out: str, checkpoint: str):
    """New resumes become intake rows as they come and are folded into the candidates; bad rows go to ``errors``, by batch."""
    seed(existing, out)

    def apply(batch: DataFrame, number: int) -> None:
        rows = intake(batch).persist()
        try:
            rows.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
            fold_batch(rows.where("error IS NULL"), out, number)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
