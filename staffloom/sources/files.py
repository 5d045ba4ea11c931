"""Resume files, exports and JSON records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from staffloom.functions import text as x

TEXT_SUFFIXES = ["txt", "md"]
# The columns of the cumulative export, in order.
EXPORT_COLUMNS = ["id", "name", "birthDate", "contact", "email", "address", "originalJobRole", "finalEducation", "careerPeriod", "careerCompany", "careerRole", "fileType"]
# The parsed resume; unknown keys are ignored, missing ones null.
PERIOD = "STRUCT<raw: STRING, start_date: STRING, end_date: STRING>"
RESUME = f"""STRUCT<
 personal_info: STRUCT<name: STRING, birth_date: STRING, gender: STRING, address: STRING, phone: STRING, email: STRING, applied_position: STRUCT<raw: STRING, normalized: STRING>>,
 desired_conditions: STRUCT<desired_location: STRING, desired_salary: STRUCT<amount: BIGINT, raw: STRING>>,
 educations: ARRAY<STRUCT<school_name: STRING, department: STRING, completion_status: STRING, period: {PERIOD}, gpa: STRUCT<score: DOUBLE, max_score: DOUBLE, raw: STRING>>>,
 military_service: STRUCT<military_type: STRING, military_rank: STRING, period: {PERIOD}, exemption_reason: STRING>,
 careers: ARRAY<STRUCT<company_name: STRING, department: STRING, employment_type: STRING, position: STRING, period: {PERIOD}, responsibilities: ARRAY<STRING>, is_company_employment: BOOLEAN, exclusion_reason: STRING, resignation_reason: STRING>>,
 certifications: ARRAY<STRUCT<name: STRING, organization: STRING, acquired_date: STRING>>, job_related_activities: ARRAY<STRUCT<title: STRING, description: STRING, period: {PERIOD}>>,
 cover_letters: ARRAY<STRUCT<question: STRING, content: STRING>>, skills: ARRAY<STRING>>"""
ENVELOPE = f"STRUCT<parsed_json: {RESUME}, summary: STRING, ai_profile: STRUCT<target_position: STRING, skills: STRUCT<domains: ARRAY<STRING>>>>"


@F.pandas_udf(T.StringType())
def decoded(values: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 with or without a mark, else cp949, else UTF-8 without what can't be read."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8-sig", "cp949"):
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("utf-8", "ignore")

    return values.map(one)


def empty_paths(spark: SparkSession, path: str) -> list[str]:
    """The files of no bytes below a path, which Spark's reader skips; from the listing alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while files.hasNext():
        status = files.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            found.append(status.getPath().toString())
    return found


def read_resume_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, text, error) of all files below a path; other suffixes and blank files have an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    none = spark.createDataFrame([(p,) for p in empty_paths(spark, path)], "path string").withColumn("content", F.lit(b"").cast("binary"))
    files = files.union(none)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = suffix.isin(TEXT_SUFFIXES)
    rows = files.select("path", known.alias("_known"), x.normalize_text(decoded(F.when(known, F.col("content")))).alias("text"))
    error = F.when(~F.col("_known"), "unsupported file type").when(F.coalesce("text", F.lit("")) == "", "empty file")
    return rows.select("path", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


def write_csv_export(df: DataFrame, headers: dict[str, str], path: str) -> None:
    """The columns under their headers, null as empty, every cell quoted, quotes doubled."""
    cells = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in headers.items()])
    cells.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def cumulative_export(old: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Old rows, then new ones, in the export's columns; of rows with the same name and contact the last stays. order: row order in each."""

    def aligned(df: DataFrame, part: int) -> DataFrame:
        cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in EXPORT_COLUMNS]
        return df.select(*cols, F.struct(F.lit(part).alias("p"), F.col(order).cast("long").alias("o")).alias("_o"))

    both = aligned(old, 0).unionByName(aligned(new, 1))
    last = Window.partitionBy("name", "contact").orderBy(F.desc("_o"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_o")


def parse_resume_json(col: Column) -> Column:
    """struct(value, error): the record; text that isn't such JSON is an error. A blank summary is null."""
    value = F.from_json(col, ENVELOPE, {"mode": "PERMISSIVE"})
    bad = F.try_parse_json(col).isNull()
    cleaned = value.withField("summary", F.when(x.strip(value["summary"]) != "", x.strip(value["summary"])))
    return F.struct(F.when(~bad, cleaned).alias("value"), F.when(bad, F.lit("not a JSON record")).alias("error"))
