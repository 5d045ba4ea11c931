"""Rows that break the constraints of the recruiting tables, which Spark doesn't enforce.

The constraints are declared once, by table; each table's row rules are one pass over it, each key a count by key and each reference an anti-join.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The declared constraints.
#: The key of each table, and columns that must be given.
KEYS = {
    "positions": "position_id", "candidates": "candidate_id", "resumes": "resume_id", "questions": "question_id", "question_generation_jobs": "job_id", "interview_slots": "slot_id", "interview_bookings": "booking_id", "interview_slot_interviewers": "id",
    "interviewers": "interviewer_id", "interview_booking_invitations": "invitation_id", "interviewer_invites": "invite_id", "users": "user_id", "email_templates": "id",
}
REQUIRED = {
    "positions": ["position_name", "created_at"],
    "candidates": ["experience_level", "application_status", "final_status", "meets_preferred_criteria", "created_at", "updated_at"],
    "resumes": ["candidate_id", "created_at", "updated_at"],
    "questions": ["question_text", "question_type", "created_at"],
    "question_generation_jobs": ["status", "candidate_id", "request_payload", "created_at"],
    "interview_slots": ["interview_round", "interview_starts_at", "interview_ends_at", "capacity", "slot_status", "created_at"],
    "interview_bookings": ["slot_id", "candidate_id", "created_at"],
    "interview_slot_interviewers": ["slot_id", "interviewer_id", "created_at"],
    "interviewers": ["interviewer_email", "interviewer_name", "created_at"],
    "interview_booking_invitations": ["candidate_id", "token_hash", "expires_at", "created_at"],
    "interviewer_invites": ["interviewer_id", "token_hash", "expires_at", "created_at"],
    "users": ["user_email", "user_name", "role", "created_at"],
    "email_templates": ["name", "subject", "body"],
}
#: The most characters of a text.
LENGTHS = {
    "positions": {"position_name": 100},
    "candidates": {"name": 255, "gender": 100, "address": 2000, "phone": 100, "email": 255, "experience_level": 20, "application_status": 20, "final_status": 20},
    "resumes": {"desired_location": 100, "file_path": 500},
    "questions": {"question_type": 30},
    "question_generation_jobs": {"status": 20},
    "interview_slots": {"interview_round": 20, "interview_location": 255, "slot_status": 20},
    "interviewers": {"interview_round": 20},
    "interview_booking_invitations": {"token_hash": 64},
    "interviewer_invites": {"token_hash": 128, "raw_token": 256},
    "email_templates": {"name": 100, "subject": 255},
}
#: The values that a column may have, where it has one.
ALLOWED = {
    "interview_slots": {"slot_status": ["open", "full", "closed"], "interview_round": ["1차", "2차", "3차"]},
    "interviewers": {"interview_round": ["1차", "2차", "3차"]},
    "question_generation_jobs": {"status": ["queued", "running", "succeeded", "failed"]},
}
#: What must hold for a row (or be unknown).
CHECKS = {
    "interview_slots": {"time_order": "interview_starts_at < interview_ends_at", "deadline_before_start": "booking_deadline_at <= interview_starts_at"},
    "interview_bookings": {"cancel_after_create": "cancelled_at >= created_at"},
}
#: Columns that no two rows share, by name; and among which rows.
UNIQUE = {
    "interview_bookings": {"one_active_per_candidate": (["candidate_id"], "cancelled_at IS NULL")},
    "interview_slot_interviewers": {"unique_pair": (["slot_id", "interviewer_id"], None)},
    "question_generation_jobs": {"one_active_per_user": (["created_by_user_id"], "status IN ('queued', 'running')"), "one_active_per_interviewer": (["created_by_interviewer_id"], "status IN ('queued', 'running')")},
    "interview_booking_invitations": {"unique_token": (["token_hash"], None)},
    "interviewer_invites": {"unique_token": (["token_hash"], None)},
    "users": {"unique_email": (["user_email"], None)},
}
#: Columns that name a row of another table.
REFERENCES = {
    "candidates": {"position_id": "positions"},
    "resumes": {"candidate_id": "candidates"},
    "questions": {"candidate_id": "candidates", "position_id": "positions", "created_by_user_id": "users", "created_by_interviewer_id": "interviewers"},
    "question_generation_jobs": {"candidate_id": "candidates", "position_id": "positions", "created_by_user_id": "users", "created_by_interviewer_id": "interviewers"},
    "interview_slots": {"position_id": "positions"},
    "interview_bookings": {"slot_id": "interview_slots", "candidate_id": "candidates"},
    "interview_slot_interviewers": {"slot_id": "interview_slots", "interviewer_id": "interviewers"},
    "interviewers": {"position_id": "positions"},
    "interview_booking_invitations": {"candidate_id": "candidates"},
    "interviewer_invites": {"interviewer_id": "interviewers", "created_by_user_id": "users"},
}


def row_rules(table: str) -> dict[str, tuple[list[str], str]]:
    """The rules that a row breaks by itself: by name the columns they need and, as SQL, what is wrong."""
    found = {f"required:{c}": ([c], f"{c} IS NULL") for c in [KEYS[table], *REQUIRED[table]]}
    found |= {f"length:{c}": ([c], f"char_length({c}) > {n}") for c, n in LENGTHS.get(table, {}).items()}
    found |= {f"allowed:{c}": ([c], f"{c} NOT IN ({', '.join(repr(v) for v in values)})") for c, values in ALLOWED.get(table, {}).items()}
    return found | {name: (re.findall(r"\w+", condition), f"NOT ({condition})") for name, condition in CHECKS.get(table, {}).items()}


def unique_rules(table: str) -> dict[str, tuple[list[str], str | None]]:
    return {f"unique:{KEYS[table]}": ([KEYS[table]], None)} | UNIQUE.get(table, {})


def row_violations(df: DataFrame, table: str) -> DataFrame:
    wrong = [F.when(F.expr(bad), F.lit(name)) for name, (columns, bad) in row_rules(table).items() if set(columns) <= set(df.columns)]
    return df.select(F.lit(table).alias("table_name"), F.explode(F.array_compact(F.array(*wrong))).alias("rule"), F.col(KEYS[table]).cast("string").alias("key"))


def repeated(df: DataFrame, table: str, rule: str, keys: list[str], among: str | None) -> DataFrame:
    """The values that more than one row has; null is no value."""
    given = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    found = (df.where(among) if among else df).where(given).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return found.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("key"))


def orphans(df: DataFrame, table: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    ids = parent.select(F.col(parent_key).alias("_id"))
    return df.where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_id"), "left_anti").select(F.lit(table).alias("table_name"), F.lit(f"exists:{column}").alias("rule"), F.col(KEYS[table]).cast("string").alias("key"))


def audit_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, key): a row per violation; the key is the row's, or the repeated value. Rules on columns or tables that are not there are left out (see ``unchecked``)."""
    parts = []
    for table, df in tables.items():
        parts.append(row_violations(df, table))
        parts += [repeated(df, table, name, keys, among) for name, (keys, among) in unique_rules(table).items() if set(keys) <= set(df.columns)]
        parts += [orphans(df, table, column, tables[parent], KEYS[parent]) for column, parent in REFERENCES.get(table, {}).items() if column in df.columns and parent in tables]
    return reduce(DataFrame.unionByName, parts)


def rules(table: str) -> list[str]:
    """The names of all rules of a table."""
    return [*row_rules(table), *unique_rules(table), *(f"exists:{c}" for c in REFERENCES.get(table, {}))]


def unchecked(tables: dict[str, DataFrame]) -> list[tuple[str, str]]:
    """The (table, rule) that an audit of these tables leaves out."""
    needs = lambda t: {n: set(c) for n, (c, _) in row_rules(t).items()} | {n: set(c) for n, (c, _) in unique_rules(t).items()} | {f"exists:{c}": {c} for c, p in REFERENCES.get(t, {}).items() if p in tables}
    return [(t, rule) for t in KEYS for rule in rules(t) if t not in tables or rule not in needs(t) or not needs(t)[rule] <= set(tables[t].columns)]
