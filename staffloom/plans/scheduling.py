"""Queries on slots, bookings and interviewers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.fixtures import NOW, Tables
from staffloom.operators import scheduling as s
from staffloom.plans.catalog import joined, query, stamp
from staffloom.sources.tables import saved

N = f"TIMESTAMP '{NOW}'"
D0, D1 = f"TIMESTAMP '{NOW[:10]} 00:00:00'", f"(TIMESTAMP '{NOW[:10]} 00:00:00' + INTERVAL 1 DAY)"
TS = "%Y-%m-%d %H:%M:%S"
BOOKED = "booked AS (SELECT slot_id, count(*) AS n FROM bookings WHERE cancelled_at IS NULL GROUP BY slot_id)"
OCCUPIED = f"""{BOOKED}, occupied AS (SELECT s.*, coalesce(n, 0) AS active_count, coalesce(n, 0) > 0 AS has_active, CAST(greatest(0, capacity - coalesce(n, 0)) AS BIGINT) AS remaining,
 CASE WHEN slot_status = 'closed' OR (booking_deadline_at IS NOT NULL AND booking_deadline_at <= {N}) THEN 'closed' WHEN capacity - coalesce(n, 0) <= 0 THEN 'full' ELSE 'open' END AS effective_status
 FROM slots s LEFT JOIN booked USING (slot_id))"""
FREE = f"""{BOOKED}, free AS (SELECT s.*, coalesce(n, 0) AS active_count, CAST(capacity - coalesce(n, 0) AS BIGINT) AS remaining FROM slots s LEFT JOIN booked USING (slot_id)
 WHERE slot_status = 'open' AND interview_starts_at > {N} AND (booking_deadline_at IS NULL OR booking_deadline_at > {N}) AND capacity > coalesce(n, 0))"""


@query("e4_available_slots", f"WITH {FREE} SELECT slot_id, position_id, active_count, remaining, strftime(interview_starts_at, '{TS}') AS starts_at FROM free")
def _(t: Tables) -> DataFrame:
    return s.available_slots(t.slots, t.bookings, NOW).select("slot_id", "position_id", "active_count", "remaining", stamp("interview_starts_at", "starts_at"))


@query("e5_slot_occupancy", f"WITH {OCCUPIED} SELECT slot_id, active_count, has_active, remaining, effective_status FROM occupied")
def _(t: Tables) -> DataFrame:
    return s.slot_occupancy(t.slots, t.bookings, NOW).select("slot_id", "active_count", "has_active", "remaining", "effective_status")


@query("e2_active_slot_count", f"SELECT count(*) AS active_slots FROM slots WHERE interview_ends_at > {N}")
def _(t: Tables) -> DataFrame:
    return s.active_slot_count(t.slots, NOW)


@query("e3_todays_interviewees", f"SELECT count(DISTINCT candidate_id) AS interviewees FROM bookings JOIN slots USING (slot_id) WHERE cancelled_at IS NULL AND interview_starts_at >= {D0} AND interview_starts_at < {D1}")
def _(t: Tables) -> DataFrame:
    return s.todays_interviewees(t.slots, t.bookings, NOW)


@query("d4_todays_schedule", f"""SELECT booking_id, slot_id, b.candidate_id, coalesce(name, '-') AS name, coalesce(position_name, '-') AS position_name, strftime(interview_starts_at, '%H:%M') || ' - ' || strftime(interview_ends_at, '%H:%M') AS time_label,
 CASE WHEN {N} < interview_starts_at THEN '응시 전' WHEN {N} >= interview_ends_at THEN '응시 완료' ELSE '응시 중' END AS status
 FROM bookings b JOIN slots s USING (slot_id) JOIN candidates c USING (candidate_id) LEFT JOIN positions p ON p.position_id = s.position_id WHERE b.cancelled_at IS NULL AND interview_starts_at >= {D0} AND interview_starts_at < {D1}""")
def _(t: Tables) -> DataFrame:
    return s.todays_schedule(t.slots, t.bookings, t.candidates, t.positions, NOW).drop("interview_starts_at")


@query("b16_time_label", f"SELECT slot_id, strftime(interview_starts_at, '%H:%M') || ' - ' || strftime(interview_ends_at, '%H:%M') AS time_label FROM slots")
def _(t: Tables) -> DataFrame:
    return t.slots.select("slot_id", s.time_label(F.col("interview_starts_at"), F.col("interview_ends_at")).alias("time_label"))


@query("b17_attendance_status", f"SELECT slot_id, CASE WHEN {N} < interview_starts_at THEN '응시 전' WHEN {N} >= interview_ends_at THEN '응시 완료' ELSE '응시 중' END AS status FROM slots")
def _(t: Tables) -> DataFrame:
    return t.slots.select("slot_id", s.attendance_status(s.at(NOW), F.col("interview_starts_at"), F.col("interview_ends_at")).alias("status"))


@query("b18_kst_month", "SELECT slot_id FROM slots WHERE interview_starts_at >= TIMESTAMP '1997-12-01 00:00:00' AND interview_starts_at < TIMESTAMP '1998-01-01 00:00:00'")
def _(t: Tables) -> DataFrame:
    return t.slots.where(s.kst_range("interview_starts_at", 1997, 12)).select("slot_id")


@query("d3_slot_details", f"""WITH {OCCUPIED}, names AS (SELECT slot_id, string_agg(interviewer_name, '|' ORDER BY interviewer_name) AS interviewer_names FROM slot_interviewers JOIN interviewers USING (interviewer_id) GROUP BY slot_id),
 people AS (SELECT slot_id, string_agg(name, '|' ORDER BY name) AS candidate_names FROM bookings JOIN candidates USING (candidate_id) WHERE cancelled_at IS NULL AND name IS NOT NULL GROUP BY slot_id)
 SELECT slot_id, position_name, coalesce(interviewer_names, '') AS interviewer_names, coalesce(candidate_names, '') AS candidate_names, remaining, effective_status FROM occupied LEFT JOIN positions USING (position_id) LEFT JOIN names USING (slot_id) LEFT JOIN people USING (slot_id)""")
def _(t: Tables) -> DataFrame:
    rows = s.slot_details(t.slots, t.bookings, t.slot_interviewers, t.interviewers, t.candidates, t.positions, NOW)
    return rows.select("slot_id", "position_name", joined("interviewer_names"), joined("candidate_names"), "remaining", "effective_status")


@query("d5_interviewer_conflicts", """SELECT DISTINCT r.batch_id, r.request_no, r.interviewer_id, s.slot_id AS conflict_slot_id FROM slot_requests r JOIN slot_interviewers b USING (interviewer_id) JOIN slots s ON s.slot_id = b.slot_id
 WHERE s.interview_starts_at < r.ends_at AND s.interview_ends_at > r.starts_at""")
def _(t: Tables) -> DataFrame:
    return s.interviewer_conflicts(t.slot_requests, t.slots, t.slot_interviewers).select("batch_id", "request_no", "interviewer_id", "conflict_slot_id")


CLASH = "SELECT DISTINCT a.batch_id, a.interviewer_id, a.request_no AS first_no, b.request_no AS second_no FROM slot_requests a JOIN slot_requests b ON a.batch_id = b.batch_id AND a.interviewer_id = b.interviewer_id AND a.request_no < b.request_no AND a.starts_at < b.ends_at AND a.ends_at > b.starts_at"


@query("d6_batch_conflicts", CLASH)
def _(t: Tables) -> DataFrame:
    return s.batch_conflicts(t.slot_requests)


@query("d7_assignment_check", "SELECT slot_id, interviewer_id, s.position_id IS NOT DISTINCT FROM i.position_id AND s.interview_round IS NOT DISTINCT FROM i.interview_round AS valid FROM slot_interviewers JOIN slots s USING (slot_id) JOIN interviewers i USING (interviewer_id)")
def _(t: Tables) -> DataFrame:
    return s.assignment_check(t.slots, t.slot_interviewers, t.interviewers)


@query("d7_assignable_interviewers", "SELECT slot_id, count(i.interviewer_id) AS assignable FROM slots s LEFT JOIN interviewers i ON s.position_id IS NOT DISTINCT FROM i.position_id AND s.interview_round IS NOT DISTINCT FROM i.interview_round GROUP BY slot_id")
def _(t: Tables) -> DataFrame:
    return s.assignable_interviewers(t.slots, t.interviewers)


@query("d8_missing_ids", "SELECT DISTINCT candidate_id FROM booking_requests WHERE candidate_id NOT IN (SELECT candidate_id FROM candidates)")
def _(t: Tables) -> DataFrame:
    return s.missing_ids(t.booking_requests, t.candidates, "candidate_id")


@query("d11_stale_assignments", "SELECT slot_id, interviewer_id FROM slot_interviewers JOIN slots s USING (slot_id) JOIN interviewers i USING (interviewer_id) WHERE NOT coalesce(s.position_id = i.position_id AND s.interview_round = i.interview_round, false)")
def _(t: Tables) -> DataFrame:
    return s.stale_assignments(t.slots, t.slot_interviewers, t.interviewers)


@query("d12_active_bookings_by_position", "SELECT candidate_id, booking_id, slot_id, s.position_id, position_name, interview_round FROM bookings JOIN slots s USING (slot_id) LEFT JOIN positions p ON p.position_id = s.position_id WHERE cancelled_at IS NULL")
def _(t: Tables) -> DataFrame:
    return s.active_bookings_by_position(t.slots, t.bookings, t.positions)


@query("d13_invitation_slots", f"""WITH {FREE}, people AS (SELECT invitation_id, allowed_slot_ids, c.position_id FROM booking_invitations JOIN candidates c USING (candidate_id))
 SELECT DISTINCT invitation_id, slot_id, remaining FROM people p JOIN free f ON f.position_id = p.position_id WHERE coalesce(len(allowed_slot_ids), 0) = 0 OR list_contains(allowed_slot_ids, slot_id)""")
def _(t: Tables) -> DataFrame:
    return s.invitation_slots(t.booking_invitations, t.candidates, t.slots, t.bookings, NOW)


@query("d13_unavailable_slots", f"""WITH {FREE}, named AS (SELECT DISTINCT invitation_id, position_id, unnest(allowed_slot_ids) AS slot_id FROM booking_invitations JOIN candidates USING (candidate_id))
 SELECT invitation_id, slot_id FROM named n WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.slot_id = n.slot_id AND f.position_id = n.position_id)""")
def _(t: Tables) -> DataFrame:
    return s.unavailable_slots(t.booking_invitations, t.candidates, t.slots, t.bookings, NOW)


@query("e1_department_status", f"""WITH running AS (SELECT * FROM slots WHERE slot_status IN ('open', 'full') AND interview_ends_at > {N}),
 a AS (SELECT position_id, count(*) FILTER (experience_level = '경력') AS ea, count(*) FILTER (experience_level <> '경력') AS na FROM candidates GROUP BY position_id),
 i AS (SELECT r.position_id, count(*) FILTER (experience_level = '경력') AS ei, count(*) FILTER (experience_level <> '경력') AS ni FROM bookings b JOIN running r USING (slot_id) JOIN candidates c USING (candidate_id) WHERE cancelled_at IS NULL GROUP BY r.position_id),
 p AS (SELECT position_id, max(interview_round) AS top FROM running WHERE booking_deadline_at IS NULL OR booking_deadline_at >= {N} OR interview_starts_at <= {N} GROUP BY position_id)
 SELECT position_id, position_name, coalesce(ea, 0) AS experienced_applicants, coalesce(na, 0) AS newcomer_applicants, coalesce(ei, 0) AS experienced_interviewees, coalesce(ni, 0) AS newcomer_interviewees, coalesce(top || ' 면접 진행중', '진행 중인 면접 없음') AS progress
 FROM positions LEFT JOIN a USING (position_id) LEFT JOIN i USING (position_id) LEFT JOIN p USING (position_id)""")
def _(t: Tables) -> DataFrame:
    return s.department_status(t.positions, t.candidates, t.slots, t.bookings, NOW)


@query("e6_dashboard_summary", f"""SELECT count(*) AS total_applicants, CAST(count(DISTINCT position_id) + max(CASE WHEN position_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS active_positions, count(DISTINCT coalesce(position_name, '미지정')) AS hiring_teams,
 (SELECT count(DISTINCT candidate_id) FROM bookings JOIN slots USING (slot_id) WHERE cancelled_at IS NULL AND interview_starts_at >= {D0} AND interview_starts_at < {D1}) AS interviewees FROM candidates LEFT JOIN positions USING (position_id)""")
def _(t: Tables) -> DataFrame:
    return s.dashboard_summary(t.candidates, t.slots, t.bookings, t.positions, NOW)


@query("e7_calendar_rollup", f"""WITH {OCCUPIED}, r AS (SELECT *, strftime(interview_starts_at, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY CAST(interview_starts_at AS DATE) ORDER BY interview_starts_at, slot_id) AS rn FROM occupied)
 SELECT day, count(*) AS n_slots, count(*) FILTER (effective_status = 'open') AS n_open, count(*) FILTER (effective_status = 'full') AS n_full, count(*) FILTER (effective_status = 'closed') AS n_closed,
 string_agg(CAST(slot_id AS VARCHAR), '|' ORDER BY rn) FILTER (rn <= 3) AS first_slots, CAST(greatest(0, count(*) - 3) AS BIGINT) AS n_rest FROM r GROUP BY day""")
def _(t: Tables) -> DataFrame:
    return s.calendar_rollup(t.slots, t.bookings, NOW).withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("first_slots", F.array_join(F.col("first_slots").cast("array<string>"), "|"))


@query("f5_upcoming_per_interviewer", f"SELECT interviewer_id, slot_id, CAST(rank AS INTEGER) AS rank FROM (SELECT interviewer_id, slot_id, row_number() OVER (PARTITION BY interviewer_id ORDER BY interview_starts_at, slot_id) AS rank FROM slot_interviewers JOIN slots USING (slot_id) WHERE interview_starts_at > {N}) WHERE rank <= 20")
def _(t: Tables) -> DataFrame:
    return s.upcoming_per_interviewer(t.slots, t.slot_interviewers, NOW).select("interviewer_id", "slot_id", "rank")


@query("h1_validate_slot_requests", f"""WITH held AS (SELECT DISTINCT r.request_no FROM slot_requests r JOIN slot_interviewers b USING (interviewer_id) JOIN slots s ON s.slot_id = b.slot_id WHERE s.interview_starts_at < r.ends_at AND s.interview_ends_at > r.starts_at),
 pairs AS ({CLASH}), clash AS (SELECT first_no AS request_no FROM pairs UNION SELECT second_no FROM pairs),
 staff AS (SELECT r.request_no, bool_or(i.interviewer_id IS NULL) AS missing, bool_or(i.interviewer_id IS NOT NULL AND (i.position_id IS DISTINCT FROM q.position_id OR i.interview_round IS DISTINCT FROM q.interview_round)) AS unfit
  FROM slot_requests r JOIN slot_plans q USING (request_no) LEFT JOIN interviewers i ON i.interviewer_id = r.interviewer_id GROUP BY 1),
 v AS (SELECT q.*, CASE WHEN coalesce(q.position_id, 0) <= 0 THEN 'bad_position' WHEN interview_round NOT IN ('1차', '2차', '3차') THEN 'bad_round' WHEN list_min(interviewer_ids) <= 0 OR len(list_distinct(interviewer_ids)) < len(interviewer_ids) THEN 'bad_ids'
  WHEN trim(interview_location) = '' THEN 'bad_location' WHEN capacity < 1 THEN 'bad_capacity' WHEN starts_at >= ends_at THEN 'time_order' WHEN q.request_no IN (SELECT request_no FROM clash) THEN 'batch_conflict' WHEN p.position_id IS NULL THEN 'unknown_position'
  WHEN missing THEN 'unknown_interviewer' WHEN unfit THEN 'not_eligible' WHEN q.request_no IN (SELECT request_no FROM held) THEN 'slot_conflict' ELSE 'ok' END AS reason FROM slot_plans q LEFT JOIN staff USING (request_no) LEFT JOIN positions p ON p.position_id = q.position_id)
 SELECT batch_id, request_no, reason, CASE WHEN reason = 'ok' THEN strftime(starts_at - INTERVAL 24 HOUR, '{TS}') END AS booking_deadline_at, CASE WHEN reason = 'ok' THEN trim(interview_location) END AS interview_location, CASE WHEN reason = 'ok' THEN 'open' END AS slot_status FROM v""")
def _(t: Tables) -> DataFrame:
    plans = saved(t.slot_plans, f"requests-{uuid.uuid4().hex}")
    return s.validate_slot_requests(plans, t.slots, t.slot_interviewers, t.interviewers, t.positions).withColumn("booking_deadline_at", stamp("booking_deadline_at"))


@query("e7_calendar_totals", f"""SELECT count(*) FILTER (CAST(interview_starts_at AS DATE) >= w AND CAST(interview_starts_at AS DATE) < w + 7) AS n_week, count(*) FILTER (strftime(interview_starts_at, '%Y-%m') = '{NOW[:7]}') AS n_month
 FROM slots, (SELECT DATE '{NOW[:10]}' - CAST(dayofweek(DATE '{NOW[:10]}') AS INT) AS w)""")
def _(t: Tables) -> DataFrame:
    return s.calendar_totals(t.slots, NOW[:10])


@query("b18_kst_year_and_day", """SELECT slot_id, 'year' AS kind FROM slots WHERE year(interview_starts_at) = 1996 UNION ALL SELECT slot_id, 'day' FROM slots WHERE CAST(interview_starts_at AS DATE) = DATE '1996-02-29'""")
def _(t: Tables) -> DataFrame:
    of = lambda kind, *day: t.slots.where(s.kst_range("interview_starts_at", *day)).select("slot_id", F.lit(kind).alias("kind"))
    return of("year", 1996).union(of("day", 1996, 2, 29))


@query("h2_validate_bookings", f"""WITH booked AS (SELECT slot_id, count(*) AS n FROM admission_bookings WHERE cancelled_at IS NULL GROUP BY slot_id), has AS (SELECT DISTINCT candidate_id FROM admission_bookings WHERE cancelled_at IS NULL)
 SELECT request_no, r.slot_id, r.candidate_id, CASE WHEN c.candidate_id IS NULL THEN 'unknown_candidate' WHEN c.position_id IS NULL THEN 'no_position' WHEN h.candidate_id IS NOT NULL THEN 'already_booked' WHEN s.slot_id IS NULL THEN 'unknown_slot'
 WHEN c.position_id IS DISTINCT FROM s.position_id THEN 'other_position' WHEN slot_status <> 'open' THEN 'not_open' WHEN booking_deadline_at <= {N} THEN 'deadline' WHEN interview_starts_at <= {N} THEN 'started' WHEN capacity - coalesce(n, 0) <= 0 THEN 'full' ELSE 'ok' END AS reason
 FROM booking_requests r LEFT JOIN candidates c ON c.candidate_id = r.candidate_id LEFT JOIN has h ON h.candidate_id = r.candidate_id LEFT JOIN slots s ON s.slot_id = r.slot_id LEFT JOIN booked b ON b.slot_id = r.slot_id""")
def _(t: Tables) -> DataFrame:
    return s.validate_bookings(t.booking_requests, t.candidates, t.slots, t.admission_bookings, NOW).drop("remaining")


@query("h3_admit_bookings")
def _(t: Tables) -> DataFrame:
    return s.admit_bookings(t.booking_requests, t.candidates, t.slots, t.admission_bookings, NOW, lambda df: saved(df, f"admission-{uuid.uuid4().hex}"))


@query("h4_validate_cancellations", f"""SELECT b.booking_id, b.candidate_id + CASE WHEN b.booking_id % 7 = 0 THEN 1 ELSE 0 END AS candidate_id,
 CASE WHEN b.cancelled_at IS NOT NULL THEN 'no_active_booking' WHEN b.booking_id % 7 = 0 THEN 'other_candidate' WHEN interview_starts_at <= {N} THEN 'started' ELSE 'ok' END AS reason FROM bookings b JOIN slots USING (slot_id)""")
def _(t: Tables) -> DataFrame:
    requests = t.bookings.select("booking_id", F.expr("candidate_id + CASE WHEN booking_id % 7 = 0 THEN 1 ELSE 0 END").alias("candidate_id"))
    return s.validate_cancellations(requests, t.slots, t.bookings, NOW).drop("cancelled_at")


@query("h9_generate_slot_grid", f"""SELECT strftime(day + to_hours(9) + to_minutes(CAST(i * 50 AS INT)), '{TS}') AS starts_at, strftime(day + to_hours(9) + to_minutes(CAST((i + 1) * 50 AS INT)), '{TS}') AS ends_at, 40 AS minutes_left
 FROM (SELECT DISTINCT CAST(interview_starts_at AS DATE) AS day FROM slots), (SELECT unnest(range(10)) AS i)""")
def _(t: Tables) -> DataFrame:
    days = t.slots.select(F.to_date("interview_starts_at").alias("day")).distinct()
    return s.generate_slot_grid(days, 9, 18, 50, 2).select(stamp("starts_at"), stamp("ends_at"), "minutes_left")


@query("h12_apply_slot_update", f"""WITH {BOOKED}, cur AS (SELECT slot_id, list_sort(list(DISTINCT interviewer_id)) AS cur FROM slot_interviewers GROUP BY 1),
 p AS (SELECT s.*, n, coalesce(cur, []) AS cur, q.* EXCLUDE (slot_id), coalesce(new_position_id, position_id) AS np, coalesce(new_interview_round, interview_round) AS nr, coalesce(new_starts_at, interview_starts_at) AS ns, coalesce(new_ends_at, interview_ends_at) AS ne FROM slots s JOIN slot_patches q USING (slot_id) LEFT JOIN booked USING (slot_id) LEFT JOIN cur USING (slot_id)),
 a AS (SELECT slot_id, np, nr, ns, ne, new_interviewer_ids IS NOT NULL AS chosen, new_position_id IS NOT NULL OR new_interview_round IS NOT NULL AS moved, unnest(coalesce(new_interviewer_ids, cur)) AS interviewer_id FROM p),
 m AS (SELECT a.*, i.interviewer_id IS NOT NULL AS known, i.interviewer_id IS NOT NULL AND i.position_id IS NOT DISTINCT FROM np AND i.interview_round IS NOT DISTINCT FROM nr AS fits FROM a LEFT JOIN interviewers i USING (interviewer_id)),
 st AS (SELECT slot_id, bool_or(NOT known) AS missing, bool_or(chosen) AS chosen, bool_or(NOT fits) AS unfit FROM m GROUP BY 1), k AS (SELECT * FROM m WHERE chosen OR NOT moved OR fits), pe AS (SELECT slot_id, list_sort(list(DISTINCT interviewer_id)) AS people FROM k GROUP BY 1),
 held AS (SELECT DISTINCT k.slot_id FROM k JOIN slot_interviewers b ON b.interviewer_id = k.interviewer_id AND b.slot_id <> k.slot_id JOIN slots s ON s.slot_id = b.slot_id WHERE s.interview_starts_at < k.ne AND s.interview_ends_at > k.ns),
 v AS (SELECT p.*, people, CASE WHEN coalesce(n, 0) > 0 THEN 'has_bookings' WHEN np IS NULL THEN 'no_position' WHEN ns >= ne THEN 'time_order' WHEN np NOT IN (SELECT position_id FROM positions) THEN 'unknown_position' WHEN missing THEN 'unknown_interviewer' WHEN chosen AND unfit THEN 'not_eligible'
  WHEN slot_id IN (SELECT slot_id FROM held) THEN 'slot_conflict' ELSE 'ok' END AS reason FROM p LEFT JOIN st USING (slot_id) LEFT JOIN pe USING (slot_id))
 SELECT slot_id, reason, CASE WHEN reason = 'ok' THEN np ELSE position_id END AS position_id, CASE WHEN reason = 'ok' THEN nr ELSE interview_round END AS interview_round, CASE WHEN reason = 'ok' THEN coalesce(new_capacity, capacity) ELSE capacity END AS capacity,
 CASE WHEN reason = 'ok' THEN coalesce(new_interview_location, interview_location) ELSE interview_location END AS interview_location, strftime(CASE WHEN reason = 'ok' THEN ns ELSE interview_starts_at END, '{TS}') AS starts_at, strftime(CASE WHEN reason = 'ok' THEN ne ELSE interview_ends_at END, '{TS}') AS ends_at,
 strftime(CASE WHEN reason = 'ok' THEN ns - INTERVAL 24 HOUR ELSE booking_deadline_at END, '{TS}') AS deadline, array_to_string(CASE WHEN reason = 'ok' THEN coalesce(people, []) ELSE cur END, '|') AS interviewer_ids FROM v""")
def _(t: Tables) -> DataFrame:
    rows = s.apply_slot_update(t.slots, t.slot_patches, t.bookings, t.slot_interviewers, t.interviewers, t.positions)
    return rows.select("slot_id", "reason", "position_id", "interview_round", "capacity", "interview_location", stamp("interview_starts_at", "starts_at"), stamp("interview_ends_at", "ends_at"), stamp("booking_deadline_at", "deadline"), F.array_join(F.col("interviewer_ids").cast("array<string>"), "|").alias("interviewer_ids"))
