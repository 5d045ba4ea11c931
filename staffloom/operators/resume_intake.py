"""From parsed resumes to the rows that candidates are folded from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.functions import text as x
from staffloom.operators.people import employment_months
from staffloom.operators.resume_records import parse_resumes
from staffloom.operators.resume_text import experience_rows


def experience_of(records: DataFrame, key: str, now: str) -> DataFrame:
    """(key, experience_level) of the careers of parsed resumes."""
    rows = experience_rows(records, key, "careerPeriod", "careerCompany", "careerRole")
    current = F.when(F.col("start").isNotNull() & F.col("end").isNull(), "현재").otherwise(F.col("end"))
    careers = rows.select(F.col(key).alias("candidate_id"), F.col("company").alias("company_name"), F.lit("").alias("employment_type"), F.col("role").alias("position"), F.col("start").alias("start_date"), current.alias("end_date"))
    return employment_months(careers, now).select(F.col("candidate_id").alias(key), "experience_level")


def intake_of(docs: DataFrame, key: str, text: str, kind: str, now: str) -> DataFrame:
    """Texts as intake rows in the order of their key: seq, name, phone, gender, address, date_of_birth, email, position_id, experience_level, criteria; error.

    A text without any of name, phone and e-mail is an error and not to be folded.
    """
    records = parse_resumes(docs, key, text, kind)
    rows = records.join(experience_of(records, key, now), key, "left")
    given = lambda c, n: F.nullif(x.limit(F.col(c), n), F.lit(""))
    return rows.select(
        F.col(key).cast("long").alias("seq"), given("name", 50).alias("name"), given("contact", 20).alias("phone"), given("gender", 10).alias("gender"), given("address", 255).alias("address"), x.parse_date(F.col("birthDate")).alias("date_of_birth"),
        x.valid_email(F.col("email")).alias("email"), F.lit(None).cast("bigint").alias("position_id"), F.coalesce("experience_level", F.lit("신입")).alias("experience_level"), F.array().cast("array<string>").alias("meets_preferred_criteria"),
        F.when((F.col("name") == "") & (F.col("contact") == "") & (F.col("email") == ""), "no person found").alias("error"),
    )
