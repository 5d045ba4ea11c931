"""Queries on candidates, resumes and positions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.fixtures import NOW, Tables
from staffloom.operators import people as p
from staffloom.plans.catalog import joined, query
from staffloom.plans.scalars import ALIAS, IDENT, KEYS, masked
from staffloom.sources.tables import shared_folder
from staffloom.streaming import candidates

N = f"TIMESTAMP '{NOW}'"
CURRENT = "cur AS (SELECT candidate_id, max(booking_id) AS booking_id FROM bookings WHERE cancelled_at IS NULL GROUP BY candidate_id)"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY created_at DESC, resume_id DESC) AS rn FROM resumes) WHERE rn = 1)"


@query("d1_candidate_list", "SELECT candidate_id, position_id, position_name, name, array_to_string(meets_preferred_criteria, '|') AS criteria FROM candidates LEFT JOIN positions USING (position_id)")
def _(t: Tables) -> DataFrame:
    return p.candidate_list(t.candidates, t.positions).select("candidate_id", "position_id", "position_name", "name", joined("meets_preferred_criteria", "criteria"))


@query("d2_candidate_detail", f"""WITH {CURRENT}, sent AS (SELECT candidate_id, string_agg(CAST(invitation_id AS VARCHAR), '|' ORDER BY created_at DESC, invitation_id DESC) AS invitations FROM booking_invitations GROUP BY candidate_id)
 SELECT c.candidate_id, position_name, cur.booking_id, b.slot_id, s.interview_round, coalesce(invitations, '') AS invitations FROM candidates c LEFT JOIN positions USING (position_id) LEFT JOIN cur ON cur.candidate_id = c.candidate_id
 LEFT JOIN bookings b ON b.booking_id = cur.booking_id LEFT JOIN slots s ON s.slot_id = b.slot_id LEFT JOIN sent ON sent.candidate_id = c.candidate_id""")
def _(t: Tables) -> DataFrame:
    rows = p.candidate_detail(t.candidates, t.positions, t.slots, t.bookings, t.booking_invitations)
    return rows.select("candidate_id", "position_name", "booking_id", "slot_id", "interview_round", F.array_join(F.col("invitations").cast("array<string>"), "|").alias("invitations"))


@query("d9_blocking_positions", "SELECT position_id, position_name FROM positions WHERE position_id IN (SELECT position_id FROM candidates)")
def _(t: Tables) -> DataFrame:
    return p.blocking_positions(t.positions, t.candidates).select("position_id", "position_name")


@query("d10_delete_slots", "WITH gone AS (SELECT slot_id FROM slots WHERE slot_id % 2 = 0 AND slot_id NOT IN (SELECT slot_id FROM bookings WHERE cancelled_at IS NULL)) SELECT 'slots' AS tab, slot_id AS id FROM slots WHERE slot_id NOT IN (SELECT slot_id FROM gone) UNION ALL SELECT 'bookings', booking_id FROM bookings WHERE slot_id NOT IN (SELECT slot_id FROM gone)")
def _(t: Tables) -> DataFrame:
    out = p.delete_slots(t.slots, t.bookings, t.slot_interviewers, t.slots.where("slot_id % 2 = 0"))
    return out["slots"].select(F.lit("slots").alias("tab"), F.col("slot_id").alias("id")).union(out["bookings"].select(F.lit("bookings"), "booking_id"))


@query("d10_delete_positions", """SELECT 'candidates' AS tab, candidate_id AS id, CASE WHEN position_id % 3 = 0 THEN NULL ELSE position_id END AS position_id FROM candidates UNION ALL SELECT 'interviewers', interviewer_id, CASE WHEN position_id % 3 = 0 THEN NULL ELSE position_id END FROM interviewers
 UNION ALL SELECT 'slot_interviewers', slot_id, NULL FROM slot_interviewers JOIN interviewers USING (interviewer_id) WHERE position_id IS NULL OR position_id % 3 <> 0""")
def _(t: Tables) -> DataFrame:
    out = p.delete_positions(t.positions.where("position_id % 3 = 0"), t.positions, t.slot_interviewers, candidates=t.candidates, interviewers=t.interviewers)
    row = lambda name, key: out[name].select(F.lit(name).alias("tab"), F.col(key).alias("id"), "position_id")
    return row("candidates", "candidate_id").union(row("interviewers", "interviewer_id")).union(out["slot_interviewers"].select(F.lit("slot_interviewers"), "slot_id", F.lit(None).cast("int")))


@query("d10_delete_interviewers", """SELECT 'interviewers' AS tab, interviewer_id AS id FROM interviewers WHERE interviewer_id % 4 <> 0 UNION ALL SELECT 'slot_interviewers', slot_id * 1000000 + interviewer_id FROM slot_interviewers WHERE interviewer_id % 4 <> 0 OR interviewer_id NOT IN (SELECT interviewer_id FROM interviewers)
 UNION ALL SELECT 'interviewer_invites', invite_id FROM interviewer_invites WHERE interviewer_id % 4 <> 0 UNION ALL SELECT 'question_jobs', job_id FROM question_jobs WHERE created_by_interviewer_id IS NOT NULL AND (created_by_interviewer_id % 4 <> 0 OR created_by_interviewer_id NOT IN (SELECT interviewer_id FROM interviewers))""")
def _(t: Tables) -> DataFrame:
    questions = t.questions.withColumn("created_by_interviewer_id", F.col("question_id") % 5)
    out = p.delete_interviewers(t.interviewers.where("interviewer_id % 4 = 0"), t.interviewers, t.slot_interviewers, t.interviewer_invites, questions, t.question_jobs)
    row = lambda name, key: out[name].select(F.lit(name).alias("tab"), F.expr(key).alias("id"))
    jobs = out["question_jobs"].where("created_by_interviewer_id IS NOT NULL").select(F.lit("question_jobs"), "job_id")
    return row("interviewers", "interviewer_id").union(row("slot_interviewers", "slot_id * 1000000 + interviewer_id")).union(row("interviewer_invites", "invite_id")).union(jobs)


@query("d10_delete_candidates", """SELECT 'bookings' AS tab, booking_id AS id FROM bookings WHERE candidate_id % 3 <> 0 UNION ALL SELECT 'invitations', invitation_id FROM booking_invitations WHERE candidate_id % 3 <> 0 OR candidate_id NOT IN (SELECT candidate_id FROM candidates)
 UNION ALL SELECT 'resumes', resume_id FROM resumes WHERE candidate_id % 3 <> 0 UNION ALL SELECT 'questions', question_id FROM questions WHERE candidate_id % 3 <> 0""")
def _(t: Tables) -> DataFrame:
    out = p.delete_candidates(t.candidates.where("candidate_id % 3 = 0"), t.questions, bookings=t.bookings, invitations=t.booking_invitations, resumes=t.resumes)
    row = lambda name, key: out[name].select(F.lit(name).alias("tab"), F.col(key).alias("id"))
    return row("bookings", "booking_id").union(row("invitations", "invitation_id")).union(row("resumes", "resume_id")).union(out["questions"].where("candidate_id IS NOT NULL").select(F.lit("questions"), "question_id"))


ACCESS = "SELECT interviewer_id, candidate_id * 2 AS candidate_id FROM slot_interviewers JOIN bookings USING (slot_id)"


@query("d15_candidate_access", f"""WITH r AS ({ACCESS}) SELECT r.interviewer_id, r.candidate_id, CASE WHEN i.position_id IS NULL THEN 'forbidden' WHEN c.candidate_id IS NULL THEN 'not_found' WHEN i.position_id IS DISTINCT FROM c.position_id THEN 'forbidden' ELSE 'ok' END AS outcome
 FROM r LEFT JOIN interviewers i ON i.interviewer_id = r.interviewer_id LEFT JOIN candidates c ON c.candidate_id = r.candidate_id""")
def _(t: Tables) -> DataFrame:
    asked = t.slot_interviewers.join(t.bookings, "slot_id").select("interviewer_id", (F.col("candidate_id") * 2).alias("candidate_id"))
    return p.candidate_access(asked, t.interviewers, t.candidates)


@query("f7_sort_applicants", "SELECT candidate_id, position_id, CAST(row_number() OVER (PARTITION BY position_id ORDER BY CASE WHEN application_status <> '서류' THEN 1 ELSE 0 END DESC, candidate_id DESC) AS INTEGER) AS rank FROM candidates")
def _(t: Tables) -> DataFrame:
    order = [(F.col("application_status") != "서류").desc(), F.desc("candidate_id")]
    return p.ranked(p.sort_applicants(t.candidates), order, F.col("position_id")).select("candidate_id", "position_id", "rank")


@query("d15_candidates_for_interviewer", "SELECT interviewer_id, candidate_id FROM interviewers JOIN candidates USING (position_id)")
def _(t: Tables) -> DataFrame:
    return p.candidates_for_interviewer(t.interviewers, t.candidates).select("interviewer_id", "candidate_id")


@query("d16_resume_question_context", rf"""WITH {LATEST}, cut AS (SELECT candidate_id, resume_id, CASE WHEN length(raw_text) <= 6000 THEN raw_text ELSE regexp_replace(substr(raw_text, 1, 6000), '\s+$', '') END AS raw_text FROM latest)
 SELECT c.candidate_id, resume_id, position_name, CASE WHEN resume_id IS NULL THEN 'no_resume' WHEN position_name IS NULL THEN 'no_position' ELSE 'ok' END AS reason,
 regexp_replace({masked(f"array_to_string(list_filter(string_split(raw_text, chr(10)), lambda l: NOT regexp_matches(lower(l), '{KEYS}')), chr(10))")}, '^\s+|\s+$', '', 'g') AS context FROM candidates c LEFT JOIN cut USING (candidate_id) LEFT JOIN positions USING (position_id)""")
def _(t: Tables) -> DataFrame:
    return p.resume_question_context(t.candidates, t.resumes, t.positions).select("candidate_id", "resume_id", "position_name", "reason", "context")


LOOSE = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9가-힣]', '', 'g')"


def dup_sql(n: str, ph: str, e: str) -> str:
    return f"""WITH k AS (SELECT candidate_id, {n} AS n, {ph} AS p, {e} AS e FROM candidates), pairs AS (SELECT candidate_id, 'np' AS c, n AS a, p AS b FROM k UNION ALL SELECT candidate_id, 'ne', n, e FROM k UNION ALL SELECT candidate_id, 'pe', p, e FROM k),
 hit AS (SELECT candidate_id FROM (SELECT *, count(*) OVER (PARTITION BY c, a, b) AS cnt FROM pairs WHERE a <> '' AND b <> '') WHERE cnt > 1) SELECT candidate_id, candidate_id IN (SELECT candidate_id FROM hit) AS is_duplicate FROM candidates"""


IDENTITY_DUPS = dup_sql(IDENT.format(ALIAS), IDENT.format("phone"), IDENT.format("email"))


@query("e10_duplicates_identity", IDENTITY_DUPS)
def _(t: Tables) -> DataFrame:
    return p.duplicate_candidates(t.candidates).select("candidate_id", "is_duplicate")


@query("e10_duplicates_loose", dup_sql(LOOSE.format("name"), LOOSE.format("phone"), LOOSE.format("email")))
def _(t: Tables) -> DataFrame:
    return p.duplicate_candidates(t.candidates, "loose").select("candidate_id", "is_duplicate")


ISSUES = rf"""SELECT candidate_id, concat_ws('|', CASE WHEN regexp_replace({ALIAS}, '\s+', '', 'g') <> trim(name) THEN '이름 정제 필요' END, CASE WHEN position_name IS NULL THEN '지원 공고 미지정' END, CASE WHEN coalesce(phone, '') = '' AND coalesce(email, '') = '' THEN '연락처 누락' END) AS reasons FROM candidates LEFT JOIN positions USING (position_id)"""


@query("e9_applicant_issues", ISSUES)
def _(t: Tables) -> DataFrame:
    return p.applicant_issues(t.candidates, t.positions).select("candidate_id", joined("reasons"))


@query("e9_issue_totals", f"""WITH i AS ({ISSUES}), d AS ({dup_sql(LOOSE.format("name"), LOOSE.format("phone"), LOOSE.format("email"))}) SELECT (SELECT count(*) FROM i WHERE reasons <> '') AS with_issue, (SELECT count(*) FROM d WHERE is_duplicate) AS with_duplicate""")
def _(t: Tables) -> DataFrame:
    return p.issue_totals(t.candidates, t.positions)


@query("d22_applicant_filter", f"WITH dup AS ({IDENTITY_DUPS}) SELECT candidate_id FROM candidates JOIN dup USING (candidate_id) WHERE is_duplicate AND len(meets_preferred_criteria) > 0 AND (contains(lower(name), '0100') OR contains(replace(coalesce(phone, ''), '-', ''), '0100') OR contains(lower(coalesce(email, '')), '0100'))")
def _(t: Tables) -> DataFrame:
    return p.applicant_filter(p.applicant_issues(p.duplicate_candidates(t.candidates), t.positions), keyword="010-0", criteria="HAS", duplicates_only=True).select("candidate_id")


@query("d23_keyword_filter", "SELECT interviewer_id FROM interviewers WHERE contains(lower(concat_ws(' ', interviewer_name, interviewer_email)), '1@ex') AND interview_round = '2차'")
def _(t: Tables) -> DataFrame:
    return p.keyword_filter(t.interviewers, ["interviewer_name", "interviewer_email"], " 1@EX", interview_round="2차").select("interviewer_id")


THIS = int(NOW[:4]) * 12 + int(NOW[5:7])


@query("e12_employment_months", f"""WITH r AS (SELECT candidate_id, CAST(substr(start_date, 1, 4) AS INT) * 12 + CAST(substr(start_date, 6, 2) AS INT) AS a, least({THIS}, CASE WHEN end_date = 'present' THEN {THIS} ELSE CAST(substr(end_date, 1, 4) AS INT) * 12 + CAST(substr(end_date, 6, 2) AS INT) END) AS b
 FROM careers WHERE company_name <> '-' AND employment_type <> '인턴'), m AS (SELECT DISTINCT candidate_id, unnest(range(a, b + 1)) AS month FROM r WHERE a <= b)
 SELECT candidate_id, count(*) AS months, CASE WHEN count(*) >= 12 THEN '경력' ELSE '신입' END AS experience_level FROM m GROUP BY candidate_id""")
def _(t: Tables) -> DataFrame:
    return p.employment_months(t.careers, NOW)


@query("f1_latest_resume", f"WITH {LATEST} SELECT candidate_id, resume_id FROM latest")
def _(t: Tables) -> DataFrame:
    return p.latest_resume(t.resumes).select("candidate_id", "resume_id")


@query("f2_current_booking", f"WITH {CURRENT} SELECT candidate_id, booking_id FROM cur")
def _(t: Tables) -> DataFrame:
    return p.current_booking(t.bookings).select("candidate_id", "booking_id")


@query("f6_page", "SELECT interviewer_id, interviewer_name FROM interviewers WHERE interviewer_name ILIKE '%0%' ORDER BY interviewer_id DESC LIMIT 5 OFFSET 5")
def _(t: Tables) -> DataFrame:
    return p.page(t.interviewers.where(F.col("interviewer_name").ilike("%0%")), [F.desc("interviewer_id")], 2, 5)[0].select("interviewer_id", "interviewer_name")


@query("f6_page_after", "SELECT interviewer_id, interviewer_name FROM interviewers WHERE interviewer_name ILIKE '%0%' ORDER BY interviewer_id DESC LIMIT 5 OFFSET 5")
def _(t: Tables) -> DataFrame:
    rows, keys = t.interviewers.where(F.col("interviewer_name").ilike("%0%")), {"interviewer_id": True}
    last = p.page_after(rows, keys, 5).agg(F.min("interviewer_id").alias("interviewer_id")).first()
    return p.page_after(rows, keys, 5, last.asDict()).select("interviewer_id", "interviewer_name")


@query("f6_page_total", "SELECT count(*) AS total, CAST(ceil(count(*) / 5.0) AS BIGINT) AS pages FROM interviewers WHERE interviewer_name ILIKE '%0%'")
def _(t: Tables) -> DataFrame:
    return p.page(t.interviewers.where(F.col("interviewer_name").ilike("%0%")), [F.desc("interviewer_id")], 2, 5)[1]


@query("f7_sort_interviewers", "SELECT interviewer_id, position_id, CAST(row_number() OVER (PARTITION BY position_id ORDER BY CAST(substr(interview_round, 1, 1) AS INTEGER) DESC NULLS LAST, interviewer_id) AS INTEGER) AS rank FROM interviewers")
def _(t: Tables) -> DataFrame:
    return p.ranked(t.interviewers, p.interviewer_order("interview_round", descending=True), F.col("position_id")).select("interviewer_id", "position_id", "rank")


FOLD = "gender, address, date_of_birth, email, position_id, experience_level, array_to_string(meets_preferred_criteria, '|') AS criteria"
KEPT = "name, phone, gender, address, date_of_birth, email, position_id, experience_level, criteria"


FOLDED = rf"""WITH own AS (SELECT candidate_id, -1 AS seq, name, phone, {FOLD} FROM old_candidates), mx AS (SELECT max(candidate_id) AS top FROM own), inc AS (SELECT CAST(NULL AS BIGINT) AS candidate_id, seq, name, phone, {FOLD} FROM resume_intake),
 tgt AS (SELECT phone, name, min(candidate_id) AS target FROM own WHERE phone IS NOT NULL AND name IS NOT NULL GROUP BY ALL),
 un AS (SELECT * FROM own WHERE candidate_id NOT IN (SELECT target FROM tgt)),
 al AS (SELECT o.* FROM own o JOIN tgt ON tgt.target = o.candidate_id UNION ALL SELECT * FROM inc WHERE phone IS NOT NULL AND name IS NOT NULL),
 f AS (SELECT max(candidate_id) AS candidate_id, min(seq) AS first, name, phone, arg_max(gender, seq) FILTER (gender IS NOT NULL) AS gender, arg_max(address, seq) FILTER (address IS NOT NULL) AS address, arg_max(date_of_birth, seq) AS date_of_birth, arg_min(email, seq) FILTER (email IS NOT NULL) AS email,
  arg_min(position_id, seq) FILTER (position_id IS NOT NULL) AS position_id, arg_max(experience_level, seq) AS experience_level, arg_max(criteria, seq) AS criteria FROM al GROUP BY phone, name),
 nw AS (SELECT first, {KEPT} FROM f WHERE candidate_id IS NULL UNION ALL SELECT seq, {KEPT} FROM inc WHERE phone IS NULL OR name IS NULL),
 u AS (SELECT candidate_id, {KEPT} FROM un UNION ALL SELECT candidate_id, {KEPT} FROM f WHERE candidate_id IS NOT NULL UNION ALL SELECT row_number() OVER (ORDER BY first) + (SELECT top FROM mx), {KEPT} FROM nw)
 SELECT candidate_id, name, phone, gender, address, strftime(date_of_birth, '%Y-%m-%d') AS born, email, position_id, experience_level, criteria FROM u"""


def folded(out: DataFrame) -> DataFrame:
    return out.select("candidate_id", "name", "phone", "gender", "address", F.date_format("date_of_birth", "yyyy-MM-dd").alias("born"), "email", "position_id", "experience_level", joined("meets_preferred_criteria", "criteria"))


@query("f8_upsert_candidates", FOLDED)
def _(t: Tables) -> DataFrame:
    return folded(p.upsert_candidates(t.old_candidates, t.resume_intake))


@query("i1_candidate_batches", FOLDED)
def _(t: Tables) -> DataFrame:
    """The same intake in four batches, folded into the table as it stands after each; the third is run twice and the versions merged."""
    out = f"{shared_folder(t.spark)}/candidates-{uuid.uuid4().hex}"
    intake, top = t.resume_intake.withColumn("error", F.lit(None).cast("string")), t.count("customer")
    candidates.seed(t.old_candidates, out)
    for n in (0, 1, 2, 2, 3):
        candidates.fold_batch(intake.where((F.col("seq") > top * n // 4) & (F.col("seq") <= top * (n + 1) // 4)), out, n)
    candidates.compact(t.spark, out)
    return folded(candidates.current_candidates(t.spark, out))


ITEMS = "CASE WHEN candidate_id % 5 = 0 THEN 'Target ' || candidate_id % 9 WHEN candidate_id % 5 = 1 THEN '' END AS target_position, position_name AS matched_position, CASE WHEN candidate_id % 2 = 0 THEN 'Raw ' || candidate_id % 7 END AS raw_position"


@query("f9_parse_table_rows", dup_sql(LOOSE.format("name"), LOOSE.format("phone"), LOOSE.format("email")).replace("SELECT candidate_id, candidate_id IN (SELECT candidate_id FROM hit) AS is_duplicate FROM candidates", f"SELECT candidate_id, coalesce(nullif(target_position, ''), matched_position, raw_position, '미분류') AS position, len(meets_preferred_criteria) > 0 AS criteria_met, coalesce(email, '—') AS email, candidate_id IN (SELECT candidate_id FROM hit) AS is_duplicate FROM (SELECT *, {ITEMS} FROM candidates LEFT JOIN positions USING (position_id))"))
def _(t: Tables) -> DataFrame:
    items = t.candidates.join(t.positions.select("position_id", "position_name"), "position_id", "left").selectExpr("*", *ITEMS.replace(" || candidate_id", " || CAST(candidate_id").replace("% 9", "% 9 AS STRING)").replace("% 7", "% 7 AS STRING)").split(", "))
    return p.table_rows(items).select("candidate_id", "position", "criteria_met", "email", "is_duplicate")


@query("e13_parse_batch_summary", """SELECT batch_id, count(*) AS total, count(*) FILTER (NOT after_cancel) AS processed, count(*) FILTER (NOT after_cancel AND error IS NULL) AS items, count(error) FILTER (NOT after_cancel) AS errors, CASE WHEN bool_or(after_cancel) THEN 'cancelled' ELSE 'succeeded' END AS status,
 CAST(least(100, floor(count(*) FILTER (NOT after_cancel) * 100 / count(*) + 0.5)) AS INTEGER) AS percent FROM parse_files GROUP BY batch_id""")
def _(t: Tables) -> DataFrame:
    return p.parse_batch_summary(t.parse_files)


@query("e15_page_summaries", """SELECT (SELECT count(*) FROM candidates) AS applicants, (SELECT count(*) FROM candidates WHERE len(meets_preferred_criteria) > 0) AS with_criteria, (SELECT count(*) FROM candidates WHERE final_status = '진행중') AS in_progress, (SELECT count(*) FROM positions) AS positions,
 (SELECT count(*) FROM positions WHERE created_at >= TIMESTAMP '1996-01-20 10:00:00' - INTERVAL 7 DAY) AS recent_positions, (SELECT count(position_id) FROM interviewers) AS with_position, (SELECT count(interview_round) FROM interviewers) AS with_round""")
def _(t: Tables) -> DataFrame:
    return p.page_summaries(t.candidates, t.positions, t.interviewers, "1996-01-20 10:00:00")
