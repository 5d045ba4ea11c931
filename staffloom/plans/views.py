"""The recruiting tables as SQL views over the given tables, for the queries' SQL twins."""

from __future__ import annotations

import re

VIEWS = {
    "positions": """
SELECT n_nationkey + 1 AS position_id,
  ['Backend Developer','백엔드 개발','Frontend Engineer','Data Analyst','데이터 분석 및 머신러닝',
   'DevOps','Mobile (Android)','QA Engineer','Product Designer','Product Manager',
   '국내영업팀','해외영업팀','물류팀','법무팀','인사팀','총무팀','디지털 마케팅','임베디드 S/W 개발',
   '영업관리','경영지원실장','AI Engineer','Full Stack Developer','회계','생산 관리','Zoologist'
  ][n_nationkey + 1] AS position_name,
  TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(n_nationkey AS INT)) AS created_at
FROM nation
""",
    "candidates": """
SELECT c_custkey + 1 AS candidate_id,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_nationkey + 1 END AS position_id,
  'Kim ' || CAST(pk % 500 AS VARCHAR) || CASE WHEN c_custkey % 11 = 0 THEN ' (alias)' ELSE '' END AS name,
  DATE '1970-01-01' + CAST((pk * 37) % 12000 AS INT) AS date_of_birth,
  CASE WHEN c_custkey % 13 = 0 THEN NULL
       ELSE '010-' || lpad(CAST(pk % 9000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(pk // 9000 AS VARCHAR), 4, '0') END AS phone,
  CASE WHEN c_custkey % 7 = 0 THEN NULL
       WHEN c_custkey % 2 = 0 THEN 'u' || CAST(pk AS VARCHAR) || '@example.com'
       ELSE 'U' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
  CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN '경력' ELSE '신입' END AS experience_level,
  CASE c_custkey % 4 WHEN 0 THEN '서류' WHEN 1 THEN '면접' WHEN 2 THEN '최종합격' ELSE '불합격' END AS application_status,
  CASE c_custkey % 3 WHEN 0 THEN '진행중' WHEN 1 THEN '합격' ELSE '불합격' END AS final_status,
  CASE WHEN c_custkey % 3 = 0 THEN [' SQL ','sql','','Spark'] ELSE CAST([] AS VARCHAR[]) END AS meets_preferred_criteria,
  TIMESTAMP '1997-01-01 00:00:00' + to_days(CAST(c_custkey % 300 AS INT)) AS created_at
FROM (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 60 ELSE c_custkey END AS pk FROM customer)
""",
    "slots": """
SELECT o_orderkey + 1 AS slot_id,
  CASE WHEN o_orderkey % 26 = 0 THEN NULL ELSE o_orderkey % 26 END AS position_id,
  CASE o_orderkey % 3 WHEN 0 THEN '1차' WHEN 1 THEN '2차' ELSE '3차' END AS interview_round,
  o_orderdate + to_hours(CAST(9 + o_orderkey % 9 AS INT)) AS interview_starts_at,
  o_orderdate + to_hours(CAST(9 + o_orderkey % 9 AS INT)) + to_minutes(CAST(30 * (1 + o_orderkey % 3) AS INT)) AS interview_ends_at,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL
       ELSE o_orderdate + to_hours(CAST(9 + o_orderkey % 9 - 24 AS INT)) END AS booking_deadline_at,
  'Room ' || CAST(o_orderkey % 12 AS VARCHAR) AS interview_location,
  CAST(1 + o_orderkey % 6 AS INT) AS capacity,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'full' END AS slot_status
FROM orders
""",
    "bookings": """
SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS booking_id,
  l_orderkey + 1 AS slot_id,
  l_partkey % (SELECT count(*) FROM customer) + 1 AS candidate_id,
  min(l_shipdate) AS created_at,
  min(CASE WHEN l_returnflag = 'R' THEN l_shipdate + to_days(1) END) AS cancelled_at
FROM lineitem GROUP BY 1, 2, 3
""",
    "interviewers": """
SELECT s_suppkey + 1 AS interviewer_id, s_name AS interviewer_name,
  lower(s_name) || '@example.com' AS interviewer_email,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_nationkey + 1 END AS position_id,
  CASE s_suppkey % 4 WHEN 0 THEN '1차' WHEN 1 THEN '2차' WHEN 2 THEN '3차' ELSE NULL END AS interview_round,
  TIMESTAMP '1997-01-01 00:00:00' + to_days(CAST(s_suppkey % 30 AS INT)) AS created_at
FROM supplier
""",
    "slot_interviewers": """
SELECT DISTINCT l_orderkey + 1 AS slot_id, l_suppkey + 1 AS interviewer_id FROM lineitem
""",
    "slot_plans": """
WITH g AS (
  SELECT l_orderkey % 20 AS batch_id, l_orderkey * 10 + l_linenumber AS request_no, list_sort(list(DISTINCT l_suppkey + 1)) AS ids,
    min(l_shipdate + to_hours(CAST(9 + l_linenumber AS INT))) AS starts_at, min(l_shipdate + to_hours(CAST(13 + l_linenumber AS INT))) AS e
  FROM lineitem GROUP BY 1, 2)
SELECT batch_id, request_no, starts_at, CASE WHEN request_no % 31 = 0 THEN starts_at ELSE e END AS ends_at,
  CASE WHEN request_no % 13 = 0 THEN request_no % 40 ELSE position_id END AS position_id,
  CASE WHEN request_no % 17 = 0 THEN '4차' ELSE coalesce(interview_round, '1차') END AS interview_round,
  CASE WHEN request_no % 23 = 0 THEN list_append(ids, ids[1]) WHEN request_no % 29 = 0 THEN list_append(ids, 0) WHEN request_no % 41 = 0 THEN list_append(ids, 1000000000) ELSE ids END AS interviewer_ids,
  CASE WHEN request_no % 19 = 0 THEN '   ' ELSE ' Room ' || CAST(request_no % 12 AS VARCHAR) END AS interview_location,
  CASE WHEN request_no % 37 = 0 THEN 0 ELSE 1 + request_no % 4 END AS capacity
FROM g LEFT JOIN interviewers ON interviewer_id = ids[1]
""",
    "slot_requests": """
SELECT DISTINCT batch_id, request_no, unnest(interviewer_ids) AS interviewer_id, starts_at, ends_at FROM slot_plans
""",
    "slot_patches": """
SELECT slot_id, CASE WHEN slot_id % 5 = 0 THEN slot_id % 28 + 1 END AS new_position_id, CASE WHEN slot_id % 11 = 0 THEN '2차' END AS new_interview_round,
  CASE WHEN slot_id % 3 = 0 THEN 9 END AS new_capacity, CASE WHEN slot_id % 2 = 0 THEN interview_starts_at + INTERVAL 1 HOUR END AS new_starts_at,
  CASE WHEN slot_id % 4 = 0 THEN interview_ends_at + INTERVAL 1 HOUR END AS new_ends_at, CASE WHEN slot_id % 6 = 0 THEN 'Hall ' || CAST(slot_id % 5 AS VARCHAR) END AS new_interview_location,
  CASE WHEN slot_id % 7 = 0 THEN [slot_id % (SELECT count(*) FROM supplier) + 1] WHEN slot_id % 53 = 0 THEN [1000000000] END AS new_interviewer_ids
FROM slots
""",
    "admission_bookings": """
SELECT booking_id, slot_id, candidate_id, created_at, CASE WHEN candidate_id % 3 <> 0 THEN created_at + INTERVAL 1 DAY END AS cancelled_at FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY booking_id) AS rn
  FROM bookings WHERE cancelled_at IS NULL) AS t WHERE rn = 1
""",
    "half_cancelled_bookings": """
SELECT booking_id, slot_id, candidate_id, created_at, CASE WHEN candidate_id % 2 = 1 THEN created_at ELSE cancelled_at END AS cancelled_at FROM bookings
""",
    "booking_requests": """
WITH pos AS (
  SELECT candidate_id, position_id,
    row_number() OVER (PARTITION BY position_id ORDER BY candidate_id) AS k,
    count(*) OVER (PARTITION BY position_id) AS n
  FROM candidates WHERE position_id IS NOT NULL),
req AS (
  SELECT l_orderkey * 10 + l_linenumber AS request_no, l_orderkey + 1 AS slot_id, min(l_partkey) AS pk
  FROM lineitem GROUP BY 1, 2)
SELECT r.request_no, r.slot_id,
  CASE WHEN r.request_no % 10 = 1 THEN (r.pk * 3) % (SELECT count(*) + 20 FROM customer) + 1
       ELSE coalesce(p.candidate_id, r.pk % (SELECT count(*) FROM customer) + 1) END AS candidate_id
FROM req r JOIN slots s ON s.slot_id = r.slot_id
LEFT JOIN pos p ON p.position_id = s.position_id AND p.k = r.pk % p.n + 1
""",
    "old_candidates": """
SELECT candidate_id, position_id, name || CASE WHEN candidate_id % 3 = 0 THEN '' ELSE ' (old)' END AS name, date_of_birth, phone, CASE WHEN candidate_id % 2 = 0 THEN email END AS email,
  experience_level, meets_preferred_criteria, CASE WHEN candidate_id % 7 = 0 THEN '여' END AS gender, 'Old Road' AS address
FROM candidates
""",
    "resume_intake": """
SELECT CASE WHEN candidate_id % 4 = 1 THEN '남' WHEN candidate_id % 4 = 2 THEN '여' END AS gender, CASE WHEN candidate_id % 5 < 3 THEN 'Street ' || CAST(candidate_id % 90 AS VARCHAR) END AS address, candidate_id AS seq, name, phone, date_of_birth,
  CASE WHEN candidate_id % 4 = 0 THEN NULL ELSE email END AS email, position_id,
  CASE WHEN candidate_id % 5 = 0 THEN '경력' ELSE '신입' END AS experience_level, meets_preferred_criteria
FROM candidates
""",
    "parse_files": """
SELECT doc_id % 10 AS batch_id, doc_id AS file_id, CASE WHEN n_chars < 200 THEN 'too short' END AS error,
  CASE WHEN doc_id % 10 IN (3, 7) THEN doc_id % 97 >= 60 ELSE false END AS after_cancel FROM documents
""",
    "question_reviews": """
SELECT conv_id AS job_id, 60 + conv_id % 41 AS score, conv_id % 6 <> 0 AS passed,
  CAST(CASE WHEN conv_id % 5 = 0 THEN 4 ELSE count(*) END AS BIGINT) AS question_count,
  CASE WHEN conv_id % 10 = 3 THEN ' Critical' WHEN conv_id % 10 = 4 THEN 'major' ELSE 'minor' END AS severity
FROM conversations GROUP BY conv_id
""",
    "resumes": """
SELECT doc_id + 1 AS resume_id,
  (doc_id * 7) % greatest(1, (SELECT count(*) FROM customer) // 3) + 1 AS candidate_id,
  text AS raw_text, CAST(NULL AS VARCHAR) AS summary,
  TIMESTAMP '1997-06-01 00:00:00' + to_days(CAST(doc_id % 50 AS INT)) AS created_at
FROM documents
""",
    "careers": """
SELECT o_custkey + 1 AS candidate_id, o_orderkey AS career_no,
  CASE WHEN o_orderkey % 19 = 0 THEN '-' ELSE 'Company ' || CAST(o_orderkey % 40 AS VARCHAR) END AS company_name,
  CASE WHEN o_orderkey % 7 = 0 THEN '인턴' ELSE '정규직' END AS employment_type,
  CASE WHEN o_orderkey % 8 = 0 THEN 'backend server' ELSE 'sales' END AS position,
  strftime(o_orderdate, '%Y-%m') AS start_date,
  CASE WHEN o_orderkey % 60 = 0 THEN 'present'
       ELSE strftime(o_orderdate + to_months(CAST(o_orderkey % 9 AS INT)), '%Y-%m') END AS end_date
FROM orders
""",
    "questions": """
SELECT conv_id * 1000 + turn + 1 AS question_id,
  CASE WHEN turn % 3 = 0 THEN NULL ELSE conv_id % (SELECT count(*) FROM customer) + 1 END AS candidate_id,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 25 + 1 END AS position_id,
  CASE WHEN turn % 2 = 0 THEN '[ ] ' ELSE '' END || text AS question_text,
  CASE role WHEN 'user' THEN 'position_based' WHEN 'assistant' THEN 'candidate_job_fit_based'
            ELSE 'candidate_resume_based' END AS question_type
FROM conversations
""",
    "question_jobs": """
SELECT event_id + 1 AS job_id,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status,
  user_id + 1 AS candidate_id,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id + 1 END AS created_by_user_id,
  CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE NULL END AS created_by_interviewer_id,
  ts AS created_at
FROM events
""",
    "job_events": """
SELECT user_id AS job_id, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status
FROM events
""",
    "booking_invitations": """
SELECT event_id + 1 AS invitation_id, user_id + 1 AS candidate_id,
  sha256('t' || CAST(event_id AS VARCHAR)) AS token_hash,
  ts + to_days(3) AS expires_at,
  CASE WHEN event_id % 4 = 0 THEN NULL
       ELSE [event_id % (SELECT count(*) FROM orders) + 1, (event_id * 7) % (SELECT count(*) FROM orders) + 1] END AS allowed_slot_ids,
  CASE WHEN event_id % 10 = 0 THEN ts + to_days(1) END AS revoked_at, ts AS created_at
FROM events
""",
    "interviewer_invites": """
SELECT event_id + 1 AS invite_id, user_id % (SELECT count(*) FROM supplier) + 1 AS interviewer_id,
  sha256('i' || CAST(event_id AS VARCHAR)) AS token_hash,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'i' || CAST(event_id AS VARCHAR) END AS raw_token,
  ts + to_days(7) AS expires_at, CASE WHEN event_id % 12 = 0 THEN ts + to_days(1) END AS revoked_at, ts AS created_at
FROM events
""",
    "availability_decisions": """
SELECT user_id AS token, event_id AS seq, ts AS decided_at,
  CASE event_type WHEN 'click' THEN ' Accepted ' WHEN 'purchase' THEN 'declined' ELSE event_type END AS decision
FROM events
""",
    "provider_fields": """
SELECT c_custkey AS doc_id, p AS provider_no, 'name' AS field,
  CASE WHEN (c_custkey + p) % 5 = 0 THEN '' WHEN (c_custkey * p) % 4 = 1 THEN c_name || ' Jr' ELSE c_name END AS value
FROM customer, (SELECT unnest([1, 2, 3]) AS p)
""",
    "resume_parts": """
SELECT k + 1 AS doc_id, k, ['text', 'pdf', 'hwp'][1 + CAST(k % 3 AS INT)] AS kind, ['김민수', '이서연', '박지훈', '최유진', '정하늘'][1 + CAST(k % 5 AS INT)] AS name,
  CAST(1970 + k % 25 AS VARCHAR) || '.0' || CAST(1 + k % 9 AS VARCHAR) || '.1' || CAST(k % 9 AS VARCHAR) AS birth,
  CASE WHEN k % 6 = 0 THEN '02-555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') ELSE '010-1234-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS phone, 'user' || CAST(k AS VARCHAR) || '@example.com' AS email,
  '서울시 강남구 ' || CAST(k % 300 AS VARCHAR) || '번지' AS address, ['백엔드 개발', '데이터 분석', '생산 관리', '국내영업'][1 + CAST(k % 4 AS INT)] AS role, CASE WHEN k % 5 <> 4 THEN 1 ELSE 0 END AS has_school, ['한국대학교', '서울대학교', '미래전문대학', '동서대학교'][1 + CAST(k % 4 AS INT)] AS school,
  ['컴퓨터공학과', '경영학과', '기계공학과'][1 + CAST(k % 3 AS INT)] AS major, CAST(2000 + k % 15 AS VARCHAR) || '.03~' || CAST(2004 + k % 15 AS VARCHAR) || '.02' AS studied, CAST(k % 3 AS INT) AS n_careers,
  ['한빛전자', '가온소프트', '누리산업'][1 + CAST(k % 3 AS INT)] AS company, ['펌웨어개발', '품질관리', '사업기획'][1 + CAST(k % 3 AS INT)] AS job, CASE WHEN k % 4 = 0 THEN '2019.05' END AS passed, CAST(k % 6 AS INT) AS served
FROM (SELECT *, c_custkey AS k FROM customer)
""",
    "written_templates": """
SELECT o_orderkey AS id, 'Hi {k' || CAST(o_orderkey % 7 AS VARCHAR) || '}' AS subject, '{k' || CAST(o_orderkey % 5 AS VARCHAR) || '} then {name_' || CAST(o_orderkey % 3 AS VARCHAR) || '} and {bad key} {k' || CAST(o_orderkey % 7 AS VARCHAR) || '}' AS body
FROM orders
""",
    "email_templates": """
SELECT * FROM (VALUES
  (1, 'invite', 'Interview for {candidate_name}', 'Hello {candidate_name}, pick a time: {invitation_url}'),
  (2, 'nolink', 'Notice', 'Hello {candidate_name}. You have {slot_count} slots.'),
  (3, 'broken', 'Hi {unknown_key}', 'Body {access_link}')) AS t(id, name, subject, body)
""",
}


def needed(sql: str) -> list[str]:
    """The views that a statement names, and those that they name, in order of definition."""
    found, new = set(), {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    while new:
        found |= new
        new = {v for n in new for v in VIEWS if v != n and re.search(rf"\b{v}\b", VIEWS[n])} - found
    return [v for v in VIEWS if v in found]


def with_views(sql: str) -> str:
    """A statement with the views it needs as common table expressions."""
    views = [f"{v} AS ({VIEWS[v].strip()})" for v in needed(sql)]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return f"WITH {own[1] or ''}" + ", ".join([*views, sql[own.end() :]])
    return (f"WITH {', '.join(views)} " if views else "") + sql
