"""Typed loading of the recruiting tables, and the shared place for intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns by table, as SQL types; keys of the sources are not trusted, see operators.quality.audit_constraints.
SCHEMAS = {
    "positions": "position_id BIGINT, position_name STRING, created_at TIMESTAMP_NTZ",
    "candidates": "candidate_id BIGINT, position_id BIGINT, name STRING, date_of_birth DATE, gender STRING, address STRING, phone STRING, email STRING, experience_level STRING, application_status STRING, final_status STRING, meets_preferred_criteria ARRAY<STRING>, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "resumes": "resume_id BIGINT, candidate_id BIGINT, desired_location STRING, desired_salary BIGINT, file_path STRING, raw_text STRING, parsed_json STRING, summary STRING, ai_profile STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "questions": "question_id BIGINT, candidate_id BIGINT, position_id BIGINT, question_text STRING, question_type STRING, evaluation_intent STRING, generation_basis STRING, created_at TIMESTAMP_NTZ, created_by_user_id BIGINT, created_by_interviewer_id BIGINT",
    "question_generation_jobs": "job_id BIGINT, status STRING, candidate_id BIGINT, position_id BIGINT, created_by_user_id BIGINT, created_by_interviewer_id BIGINT, request_payload STRING, result_questions STRING, error_message STRING, created_at TIMESTAMP_NTZ, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ",
    "interview_slots": "slot_id BIGINT, position_id BIGINT, interview_round STRING, interview_starts_at TIMESTAMP_NTZ, interview_ends_at TIMESTAMP_NTZ, booking_deadline_at TIMESTAMP_NTZ, interview_location STRING, capacity INT, slot_status STRING, created_at TIMESTAMP_NTZ",
    "interview_bookings": "booking_id BIGINT, slot_id BIGINT, candidate_id BIGINT, created_at TIMESTAMP_NTZ, cancelled_at TIMESTAMP_NTZ",
    "interview_slot_interviewers": "id BIGINT, slot_id BIGINT, interviewer_id BIGINT",
    "interviewers": "interviewer_id BIGINT, email STRING, name STRING, position_id BIGINT, interview_round STRING, created_at TIMESTAMP_NTZ",
    "interview_booking_invitations": "invitation_id BIGINT, candidate_id BIGINT, token_hash STRING, expires_at TIMESTAMP_NTZ, allowed_slot_ids ARRAY<BIGINT>, revoked_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ",
    "interviewer_invites": "invite_id BIGINT, interviewer_id BIGINT, token_hash STRING, raw_token STRING, expires_at TIMESTAMP_NTZ, revoked_at TIMESTAMP_NTZ, last_used_at TIMESTAMP_NTZ, created_by_user_id BIGINT, created_at TIMESTAMP_NTZ",
    "users": "user_id BIGINT, user_email STRING, user_name STRING, role STRING, created_at TIMESTAMP_NTZ",
    "email_templates": "id BIGINT, name STRING, subject STRING, body STRING",
}
#: Columns that JDBC reads split on.
SPLIT_ON = {name: schema.split()[0] for name, schema in SCHEMAS.items()}


def arrays_read(df: DataFrame, schema: str) -> DataFrame:
    """Columns of the schema's types; arrays come as JSON text."""
    kinds = {c.split()[0]: c.split(maxsplit=1)[1] for c in schema.split(", ")}
    return df.select(*[(F.from_json(c, kind) if "ARRAY" in kind else F.col(c).cast(kind)).alias(c) for c, kind in kinds.items() if c in df.columns])


def key_bounds(spark: SparkSession, name: str, source: str, **options: str) -> tuple[int, int]:
    """The smallest and the greatest key of a table in a database, which is asked for these two numbers only."""
    key = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(source).quoteIdentifier(SPLIT_ON[name])
    row = spark.read.format("jdbc").option("url", source).option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {name}").options(**options).load().first()
    return row[0] or 0, row[1] or 0


def read_table(spark: SparkSession, name: str, source: str, kind: str = "parquet", partitions: int = 32, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """One table from a folder (parquet, csv, json) or a database (jdbc).

    A database is read in ``partitions`` ranges of the key between ``bounds``, by default its smallest and greatest one. Text formats are read
    by the schema; arrays come as JSON text from csv and databases; no types are inferred.
    """
    schema = SCHEMAS[name]
    if kind == "jdbc":
        low, high = bounds or key_bounds(spark, name, source, **options)
        ranges = {"partitionColumn": SPLIT_ON[name], "lowerBound": str(low), "upperBound": str(max(high, low + 1)), "numPartitions": str(partitions)}
        return arrays_read(spark.read.format("jdbc").option("url", source).option("dbtable", name).options(**ranges, **options).load(), schema)
    if kind == "csv":
        flat = schema.replace("ARRAY<STRING>", "STRING").replace("ARRAY<BIGINT>", "STRING")
        return arrays_read(spark.read.schema(flat).option("header", True).options(**options).csv(f"{source}/{name}.csv"), schema)
    return spark.read.schema(schema).options(**options).format(kind).load(f"{source}/{name}.{kind}")


def read_tables(spark: SparkSession, source: str, kind: str = "parquet", **options: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, name, source, kind, **options) for name in SCHEMAS}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); only a local session gets one of its own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="staffloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
