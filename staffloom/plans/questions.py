"""Queries on questions, jobs, invitations and mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.fixtures import NOW, NOW_EV, Tables
from staffloom.functions import text as x
from staffloom.operators import questions as q
from staffloom.operators.products import spread_join
from staffloom.operators.scheduling import available_slots
from staffloom.plans.catalog import query, stamp

NE = f"TIMESTAMP '{NOW_EV}'"
TS = "%Y-%m-%d %H:%M:%S"
ST = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("d14_questions_for_target", "SELECT question_id, q.candidate_id, name AS candidate_name FROM questions q LEFT JOIN candidates c USING (candidate_id) WHERE q.position_id = 3")
def _(t: Tables) -> DataFrame:
    return q.questions_for_target(t.questions, t.candidates, position_id=3).select("question_id", "candidate_id", "candidate_name")


@query("d15_questions_for_interviewer", "SELECT interviewer_id, question_id FROM interviewers JOIN questions USING (position_id)")
def _(t: Tables) -> DataFrame:
    return t.interviewers.where("position_id IS NOT NULL").select("interviewer_id", "position_id").join(t.questions.select("question_id", "position_id"), "position_id").select("interviewer_id", "question_id")


@query("e8_question_counts", "SELECT position_id, count(*) AS n_questions FROM questions WHERE position_id IS NOT NULL GROUP BY position_id")
def _(t: Tables) -> DataFrame:
    return q.question_counts(t.questions)


def batch_of(t: Tables) -> DataFrame:
    """Every question again as a batch, half of them changed, types left out for a third."""
    return t.questions.selectExpr("question_id AS seq", "candidate_id", "CASE WHEN question_id % 7 = 0 THEN NULL ELSE position_id END AS position_id", "concat(' ', question_text, CASE WHEN question_id % 2 = 0 THEN ' again' ELSE '' END) AS question_text", "CASE WHEN question_id % 3 = 0 THEN NULL ELSE question_type END AS question_type")


@query("g1_new_questions", rf"""WITH b AS (SELECT question_id AS seq, candidate_id, CASE WHEN question_id % 7 = 0 THEN NULL ELSE position_id END AS position_id, question_text || CASE WHEN question_id % 2 = 0 THEN ' again' ELSE '' END AS question_text, CASE WHEN question_id % 3 = 0 THEN NULL ELSE question_type END AS question_type FROM questions),
 r AS (SELECT seq, b.candidate_id, coalesce(c.position_id, b.position_id) AS position_id, {ST.format("question_text")} AS txt, question_type FROM b LEFT JOIN candidates c USING (candidate_id)),
 d AS (SELECT seq, candidate_id, position_id, txt, coalesce(question_type, CASE WHEN candidate_id IS NOT NULL AND position_id IS NOT NULL THEN 'candidate_job_fit_based' WHEN candidate_id IS NOT NULL THEN 'candidate_resume_based' ELSE 'position_based' END) AS question_type FROM r),
 f AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM questions e WHERE e.question_type = d.question_type AND {ST.format("e.question_text")} = d.txt AND (d.candidate_id IS NULL OR e.candidate_id = d.candidate_id) AND (d.position_id IS NULL OR e.position_id = d.position_id)))
 SELECT seq, question_type FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, position_id, question_type, txt ORDER BY seq) AS rn FROM f) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    return q.new_questions(batch_of(t), t.questions, t.candidates).select("seq", "question_type")


@query("g2_normalize_questions", rf"""WITH n AS (SELECT conv_id AS job_id, turn AS seq, {ST.format("text")} AS txt FROM conversations), u AS (SELECT *, row_number() OVER (PARTITION BY job_id, txt ORDER BY seq) AS k FROM n WHERE txt <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rank FROM u WHERE k = 1)
 SELECT job_id, seq, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.col("text").alias("question_text"))
    return q.normalize_questions(rows, 4).select("job_id", "seq", "rank")


OPEN = """open AS (SELECT 'user' AS owner_kind, created_by_user_id AS owner_id, job_id, created_at FROM question_jobs WHERE status IN ('queued', 'running') AND created_by_user_id IS NOT NULL UNION ALL SELECT 'interviewer', created_by_interviewer_id, job_id, created_at FROM question_jobs WHERE status IN ('queued', 'running') AND created_by_interviewer_id IS NOT NULL)"""


@query("f3_active_job_per_owner", f"WITH {OPEN} SELECT owner_kind, owner_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_kind, owner_id ORDER BY created_at DESC, job_id DESC) AS rn FROM open) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    return q.active_job_per_owner(t.question_jobs).select("owner_kind", "owner_id", "job_id")


JOB_REQUESTS = "SELECT candidate_id AS request_no, CASE WHEN candidate_id % 3 = 0 THEN 'interviewer' ELSE 'user' END AS owner_kind, CASE WHEN candidate_id % 3 = 0 THEN candidate_id % 130 + 1 ELSE candidate_id % 7000 + 1 END AS owner_id, candidate_id + CASE WHEN candidate_id % 11 = 0 THEN 1000000000 ELSE 0 END AS candidate_id, CASE WHEN candidate_id % 4 = 0 THEN candidate_id % 40 END AS position_id FROM candidates"


@query("h11_admit_jobs", f"""WITH {OPEN}, req AS ({JOB_REQUESTS}),
 v AS (SELECT r.*, i.position_id AS staff, c.candidate_id AS person, c.position_id AS own, CASE WHEN owner_kind = 'user' THEN coalesce(c.position_id, r.position_id) ELSE i.position_id END AS pos FROM req r LEFT JOIN interviewers i ON owner_kind = 'interviewer' AND i.interviewer_id = owner_id LEFT JOIN candidates c ON c.candidate_id = r.candidate_id),
 s AS (SELECT v.*, CASE WHEN owner_kind = 'interviewer' AND staff IS NULL THEN 'no_owner_position' WHEN EXISTS (SELECT 1 FROM open o WHERE o.owner_kind = v.owner_kind AND o.owner_id = v.owner_id) THEN 'already_running' WHEN person IS NULL THEN 'unknown_candidate'
  WHEN owner_kind = 'interviewer' AND own IS DISTINCT FROM staff THEN 'other_position' WHEN owner_kind = 'user' AND (pos IS NULL OR pos NOT IN (SELECT position_id FROM positions)) THEN 'unknown_position' END AS bad FROM v)
 SELECT request_no, owner_kind, owner_id, coalesce(bad, CASE WHEN n > 1 THEN 'second_in_batch' ELSE 'ok' END) AS reason, CASE WHEN bad IS NULL AND n = 1 THEN pos END AS position_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_kind, owner_id, bad IS NULL ORDER BY request_no) AS n FROM s)""")
def _(t: Tables) -> DataFrame:
    requests = t.candidates.selectExpr("candidate_id AS request_no", "CASE WHEN candidate_id % 3 = 0 THEN 'interviewer' ELSE 'user' END AS owner_kind", "CASE WHEN candidate_id % 3 = 0 THEN candidate_id % 130 + 1 ELSE candidate_id % 7000 + 1 END AS owner_id", "candidate_id + CASE WHEN candidate_id % 11 = 0 THEN 1000000000 ELSE 0 END AS candidate_id", "CASE WHEN candidate_id % 4 = 0 THEN candidate_id % 40 END AS position_id")
    return q.admit_jobs(requests, t.question_jobs, t.candidates, t.positions, t.interviewers)


@query("g2_question_shortfall", rf"""WITH n AS (SELECT conv_id AS job_id, count(DISTINCT {ST.format("text")}) FILTER ({ST.format("text")} <> '') AS k FROM conversations GROUP BY 1) SELECT conv_id AS job_id, 1 + conv_id % 9 AS n_wanted, coalesce(k, 0) AS n_questions, CASE WHEN coalesce(k, 0) < 1 + conv_id % 9 THEN 'too few questions' END AS error FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n ON job_id = conv_id""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.col("text").alias("question_text"))
    return q.question_shortfall(rows, rows.selectExpr("job_id", "1 + job_id % 9 AS n_wanted").distinct())


@query("h6_invite_requests", f"""WITH act AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interviewer_id ORDER BY created_at DESC, invite_id DESC) AS rn FROM interviewer_invites WHERE revoked_at IS NULL AND expires_at > {NE} AND raw_token IS NOT NULL) WHERE rn = 1),
 r AS (SELECT DISTINCT l_suppkey * 2 + 1 AS interviewer_id, CAST(1 + l_suppkey % 14 AS INTEGER) AS days FROM lineitem)
 SELECT r.interviewer_id, CASE WHEN invite_id IS NOT NULL THEN 'reused' WHEN i.interviewer_id IS NULL THEN 'not_found' ELSE 'created' END AS outcome, invite_id, strftime(CASE WHEN invite_id IS NOT NULL THEN expires_at WHEN i.interviewer_id IS NOT NULL THEN {NE} + to_days(days) END, '{TS}') AS expires_at FROM r LEFT JOIN act USING (interviewer_id) LEFT JOIN interviewers i ON i.interviewer_id = r.interviewer_id""")
def _(t: Tables) -> DataFrame:
    asked = t.raw("lineitem").selectExpr("l_suppkey * 2 + 1 AS interviewer_id", "CAST(1 + l_suppkey % 14 AS INT) AS expires_in_days").distinct()
    return q.invite_requests(asked, t.interviewer_invites, t.interviewers, NOW_EV).withColumn("expires_at", stamp("expires_at"))


@query("f4_active_booking_invitations", f"SELECT candidate_id, string_agg(CAST(invitation_id AS VARCHAR), '|' ORDER BY created_at DESC, invitation_id DESC) AS invitation_ids FROM booking_invitations WHERE revoked_at IS NULL AND expires_at > {NE} GROUP BY candidate_id")
def _(t: Tables) -> DataFrame:
    return q.active_booking_invitations(t.booking_invitations, NOW_EV).select("candidate_id", F.array_join(F.col("invitation_ids").cast("array<string>"), "|").alias("invitation_ids"))


@query("h7_check_saved_questions", """WITH i AS (SELECT j.*, job_id % 5 AS k FROM question_jobs j)
 SELECT job_id AS item_no, CASE WHEN k = 4 THEN 'unknown_job' WHEN created_by_user_id IS DISTINCT FROM candidate_id THEN 'other_owner' WHEN status <> 'succeeded' THEN 'not_finished' WHEN k = 3 THEN 'other_candidate' WHEN k = 2 THEN 'not_generated' ELSE 'ok' END AS reason FROM i""")
def _(t: Tables) -> DataFrame:
    jobs = t.question_jobs.withColumn("position_id", F.lit(None).cast("bigint")).withColumn("result_questions", F.to_json(F.array(F.struct(F.concat(F.lit(" Q"), F.col("job_id").cast("string")).alias("question_text")), F.struct(F.concat(F.lit("R"), F.col("job_id").cast("string")).alias("question_text")))))
    items = t.question_jobs.selectExpr("job_id AS item_no", "CASE WHEN job_id % 5 = 4 THEN -job_id ELSE job_id END AS job_id", "candidate_id AS owner_user_id", "CASE WHEN job_id % 5 = 3 THEN -1 ELSE candidate_id END AS candidate_id", "CAST(1 AS BIGINT) AS position_id", "'candidate_job_fit_based' AS question_type", "concat(CASE WHEN job_id % 5 = 2 THEN 'Z' ELSE 'Q' END, job_id, ' ') AS question_text")
    return q.check_saved_questions(items, jobs)


@query("h10_review_questions", rf"""WITH s AS (SELECT conv_id AS job_id, count(*) AS n, count(DISTINCT {ST.format("text")}) AS d, count(*) FILTER (NOT starts_with({ST.format("text")}, '[ ]')) AS bare FROM conversations WHERE turn >= 0 GROUP BY conv_id),
 v AS (SELECT r.*, n, d, bare, lower(trim(severity)) = 'critical' OR n <> question_count OR d < n AS fail, lower(trim(severity)) = 'major' OR bare > 0 AS rev FROM question_reviews r JOIN s USING (job_id))
 SELECT job_id, passed AND score >= 85 AND NOT fail AND NOT rev AS passed, CAST(CASE WHEN fail THEN least(score, 70) WHEN NOT (passed AND score >= 85 AND NOT rev) THEN least(score, 84) ELSE score END AS BIGINT) AS score, n - d AS n_duplicates, bare AS n_bare FROM v""")
def _(t: Tables) -> DataFrame:
    rows = t.raw("conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.col("text").alias("question_text"))
    return q.review_questions(t.question_reviews, rows)


@query("h5_booking_invitation_status", f"""WITH has AS (SELECT DISTINCT candidate_id FROM half_cancelled_bookings WHERE cancelled_at IS NULL) SELECT token_hash, invitation_id, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at <= {NE} THEN 'expired' WHEN candidate_id IN (SELECT candidate_id FROM has) THEN 'booked' ELSE 'usable' END AS status FROM booking_invitations
 UNION ALL SELECT sha256('x' || CAST(candidate_id AS VARCHAR)), NULL, 'unknown' FROM candidates""")
def _(t: Tables) -> DataFrame:
    tokens = t.booking_invitations.select("token_hash").union(t.candidates.select(F.sha2(F.concat(F.lit("x"), F.col("candidate_id").cast("string")), 256)))
    return q.booking_invitation_status(tokens, t.booking_invitations, t.half_cancelled_bookings, NOW_EV)


@query("h6_interviewer_invite_status", f"SELECT token_hash, invite_id, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at < {NE} THEN 'expired' ELSE 'ok' END AS status, CASE WHEN revoked_at IS NULL AND expires_at >= {NE} THEN strftime({NE}, '{TS}') END AS last_used_at FROM interviewer_invites UNION ALL SELECT sha256('x' || CAST(candidate_id AS VARCHAR)), NULL, 'unknown', NULL FROM candidates")
def _(t: Tables) -> DataFrame:
    tokens = t.interviewer_invites.select("token_hash").union(t.candidates.select(F.sha2(F.concat(F.lit("x"), F.col("candidate_id").cast("string")), 256)))
    return q.interviewer_invite_status(tokens, t.interviewer_invites, NOW_EV).withColumn("last_used_at", stamp("last_used_at"))


@query("f4_active_invites", f"SELECT interviewer_id, invite_id FROM (SELECT *, row_number() OVER (PARTITION BY interviewer_id ORDER BY created_at DESC, invite_id DESC) AS rn FROM interviewer_invites WHERE revoked_at IS NULL AND expires_at > {NE} AND raw_token IS NOT NULL) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    return q.active_invites(t.interviewer_invites, NOW_EV).select("interviewer_id", "invite_id")


@query("f4_supersede_invitations", f"SELECT invitation_id, strftime(CASE WHEN revoked_at IS NULL AND expires_at > nxt THEN nxt ELSE revoked_at END, '{TS}') AS revoked_at FROM (SELECT *, lead(created_at) OVER (PARTITION BY candidate_id ORDER BY created_at, invitation_id) AS nxt FROM booking_invitations)")
def _(t: Tables) -> DataFrame:
    return q.supersede_invitations(t.booking_invitations).select("invitation_id", stamp("revoked_at"))


def recipients(t: Tables) -> DataFrame:
    return t.candidates.select("candidate_id", "name", "email", F.concat(F.lit("https://x.example/"), F.col("candidate_id").cast("string")).alias("invitation_url"))


@query("d21_mail_merge", """SELECT candidate_id, email, CASE WHEN coalesce(email, '') <> '' THEN 'Interview for ' || name END AS subject, CASE WHEN coalesce(email, '') <> '' THEN 'Hello ' || name || ', pick a time: https://x.example/' || candidate_id END AS content, CASE WHEN coalesce(email, '') = '' THEN 'no e-mail' END AS error FROM candidates""")
def _(t: Tables) -> DataFrame:
    return q.mail_merge(recipients(t), t.email_templates.where("id = 1"))


FREE_SLOTS = """free AS (SELECT s.* FROM slots s LEFT JOIN (SELECT slot_id, count(*) AS n FROM bookings WHERE cancelled_at IS NULL GROUP BY 1) b USING (slot_id) WHERE slot_status = 'open' AND interview_starts_at > TIMESTAMP '1998-01-01 10:00:00' AND (booking_deadline_at IS NULL OR booking_deadline_at > TIMESTAMP '1998-01-01 10:00:00') AND capacity > coalesce(n, 0)),
 told AS (SELECT position_id, count(*) AS n, string_agg(strftime(interview_starts_at, '%Y-%m-%d %H:%M') || ' - ' || strftime(interview_ends_at, '%H:%M') || ' · ' || interview_round || ' · ' || interview_location, chr(10) ORDER BY interview_starts_at, slot_id) AS txt FROM free GROUP BY position_id)"""


@query("d21_mail_merge_slots", f"""WITH {FREE_SLOTS} SELECT c.candidate_id, sha256(CASE WHEN coalesce(email, '') <> '' THEN 'Hello ' || name || '. You have ' || coalesce(n, 0) || ' slots:' || coalesce(chr(10) || txt, '') || chr(10) || chr(10) || 'Interview booking link: https://x.example/' || candidate_id END) AS content FROM candidates c LEFT JOIN told ON told.position_id = c.position_id""")
def _(t: Tables) -> DataFrame:
    free = available_slots(t.slots, t.bookings, NOW)
    rows = spread_join(t.candidates, q.slot_summaries(free), "position_id", "candidate_id", "left").select("candidate_id", "name", "email", F.concat(F.lit("https://x.example/"), F.col("candidate_id").cast("string")).alias("invitation_url"), "slot_summary", "slot_count")
    template = t.spark.range(1).select(F.lit("Slots").alias("subject"), F.lit("Hello {candidate_name}. You have {slot_count} slots:\n{slot_summary}").alias("body"))
    return q.mail_merge(rows, template).select("candidate_id", F.sha2("content", 256).alias("content"))


@query("d21_interviewer_mail", "SELECT interviewer_id, interviewer_email AS email, 'Interviews' AS subject, 'Sign in: https://i.example/' || interviewer_id || ', or answer: https://i.example/' || interviewer_id || '/times' AS content, CAST(NULL AS VARCHAR) AS error FROM interviewers")
def _(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://i.example/"), F.col("interviewer_id").cast("string"))
    rows = t.interviewers.select("interviewer_id", F.col("interviewer_email").alias("email"), url.alias("invite_url"), F.concat(url, F.lit("/times")).alias("availability_url"))
    template = t.spark.range(1).select(F.lit("Interviews").alias("subject"), F.lit("Sign in: {access_link}, or answer: {availability_url}").alias("body"))
    return q.interviewer_mail_merge(rows, template)


@query("b22_include_link", "SELECT candidate_id, CASE WHEN coalesce(email, '') <> '' THEN 'Hello ' || name || '. You have 3 slots.' || chr(10) || chr(10) || 'Interview booking link: https://x.example/' || candidate_id END AS content FROM candidates")
def _(t: Tables) -> DataFrame:
    return q.mail_merge(recipients(t), t.email_templates.where("id = 2"), slot_count=3).select("candidate_id", "content")


@query("b20_missing_key", "SELECT candidate_id, CASE WHEN coalesce(email, '') = '' THEN 'no e-mail' ELSE 'missing: unknown_key' END AS error FROM candidates")
def _(t: Tables) -> DataFrame:
    return q.mail_merge(recipients(t), t.email_templates.where("id = 3")).select("candidate_id", "error")


@query("b20_render_template", """SELECT candidate_id, CASE candidate_id % 4 WHEN 0 THEN 'Dear ' || name || ' {x} ' || candidate_id WHEN 3 THEN 'No keys' END AS text, CASE candidate_id % 4 WHEN 1 THEN 'missing: absent' WHEN 2 THEN 'malformed' END AS error FROM candidates""")
def _(t: Tables) -> DataFrame:
    text = F.expr("CASE candidate_id % 4 WHEN 0 THEN 'Dear {name}{nothing} {{x}} {id}' WHEN 1 THEN '{name} and {absent}' WHEN 2 THEN 'stray { brace {name}' ELSE 'No keys' END")
    values = F.create_map(F.lit("name"), F.col("name"), F.lit("id"), F.col("candidate_id").cast("string"), F.lit("nothing"), F.lit(None).cast("string"))
    return t.candidates.select("candidate_id", x.render_template(text, values).alias("r")).select("candidate_id", "r.text", "r.error")
