"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.sources.tables import shared_folder

#: A word is a run of characters other than ASCII white space.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back.

    Later jobs read the files, so that a lost executor costs nothing that was finished. Each
    call takes a folder of its own; the files go when the session's application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return spark.read.schema(df.schema).parquet(path)


def within(df: DataFrame, rows: int) -> bool:
    """Whether a frame has at most that many rows (reads no more than one row beyond)."""
    return df.limit(rows + 1).count() <= rows


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Marks a frame for broadcast if it proves small; else Spark joins it by shuffle."""
    return F.broadcast(df) if within(df, rows) else df


def words(text: Column) -> Column:
    """The words of a text as an array (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def dealt(*cols: Column | str, n: int) -> Column:
    """A bucket from 0 to n-1 by hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def gapless(df: DataFrame, keys: list[str], order: list[str], buckets: int, out: str) -> DataFrame:
    """Numbers the rows of each key from 0 without gaps, whatever the size of a key.

    Rows are dealt to hash buckets by ``order``; each (key, bucket) is numbered on its own and
    shifted by the rows of the key's earlier buckets. Only the counts meet per key, at most
    ``buckets`` of them. ``order`` should identify a row; equal rows are numbered in any order.
    """
    part = df.withColumn("_b", dealt(*order, n=buckets))
    counts = part.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    local = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    on = reduce(lambda a, b: a & b, [local[k].eqNullSafe(starts[f"_k_{k}"]) for k in keys] + [local["_b"] == starts["_kb"]])
    return local.join(starts, on).withColumn(out, (F.col("_start") + F.col("_r")).cast("long")).drop("_b", "_r", "_start", "_kb", *[f"_k_{k}" for k in keys])


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 64) -> int:
    """How many buckets keep each at about ``per_bucket`` rows."""
    return max(least, -(-rows // per_bucket))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it (within a lambda Spark would repeat it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
