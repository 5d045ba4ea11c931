"""The recruiting tables, derived from the given tables with the DataFrame API.

``NOW`` and ``NOW_EV`` are the clocks of the registered queries; every operator takes its time as a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.operators.products import dealt

NOW = "1998-01-01 10:00:00"
NOW_EV = "2024-01-20 00:00:00"
#: Position names by nation key, in key order.
POSITION_NAMES = [
    "Backend Developer", "백엔드 개발", "Frontend Engineer", "Data Analyst", "데이터 분석 및 머신러닝", "DevOps", "Mobile (Android)", "QA Engineer", "Product Designer",
    "Product Manager", "국내영업팀", "해외영업팀", "물류팀", "법무팀", "인사팀", "총무팀", "디지털 마케팅", "임베디드 S/W 개발", "영업관리", "경영지원실장", "AI Engineer",
    "Full Stack Developer", "회계", "생산 관리", "Zoologist",
]


class Tables:
    """Views of one folder of given tables; each is built on use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def count(self, name: str) -> int:
        return self.raw(name).count()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in BUILDERS:
            raise AttributeError(name)
        return BUILDERS[name](self)


BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}


def view(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    BUILDERS[f.__name__] = f
    return f


@view
def positions(t: Tables) -> DataFrame:
    names = F.lit(POSITION_NAMES)
    return t.raw("nation").select((F.col("n_nationkey") + 1).alias("position_id"), F.get(names, F.col("n_nationkey").cast("int")).alias("position_name"), F.expr("timestamp_ntz'1996-01-01 00:00:00' + make_dt_interval(n_nationkey)").alias("created_at"))


@view
def candidates(t: Tables) -> DataFrame:
    c = t.raw("customer").withColumn("pk", F.expr("CASE WHEN c_custkey % 9 = 0 THEN c_custkey % 60 ELSE c_custkey END"))
    return c.selectExpr(
        "c_custkey + 1 AS candidate_id",
        "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_nationkey + 1 END AS position_id",
        "concat('Kim ', pk % 500, CASE WHEN c_custkey % 11 = 0 THEN ' (alias)' ELSE '' END) AS name",
        "date_add(DATE'1970-01-01', CAST((pk * 37) % 12000 AS INT)) AS date_of_birth",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat('010-', lpad(pk % 9000, 4, '0'), '-', lpad(pk div 9000, 4, '0')) END AS phone",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN concat('u', pk, '@example.com') ELSE concat('U', c_custkey, '@example.com') END AS email",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '경력' ELSE '신입' END AS experience_level",
        "element_at(array('서류', '면접', '최종합격', '불합격'), CAST(c_custkey % 4 AS INT) + 1) AS application_status",
        "element_at(array('진행중', '합격', '불합격'), CAST(c_custkey % 3 AS INT) + 1) AS final_status",
        "CASE WHEN c_custkey % 3 = 0 THEN array(' SQL ', 'sql', '', 'Spark') ELSE CAST(array() AS ARRAY<STRING>) END AS meets_preferred_criteria",
        "timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(c_custkey % 300) AS created_at",
    )


@view
def slots(t: Tables) -> DataFrame:
    return t.raw("orders").selectExpr(
        "o_orderkey + 1 AS slot_id",
        "CASE WHEN o_orderkey % 26 = 0 THEN NULL ELSE o_orderkey % 26 END AS position_id",
        "element_at(array('1차', '2차', '3차'), CAST(o_orderkey % 3 AS INT) + 1) AS interview_round",
        "o_orderdate + make_dt_interval(0, 9 + o_orderkey % 9) AS interview_starts_at",
        "o_orderdate + make_dt_interval(0, 9 + o_orderkey % 9, 30 * (1 + o_orderkey % 3)) AS interview_ends_at",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + make_dt_interval(0, 9 + o_orderkey % 9 - 24) END AS booking_deadline_at",
        "concat('Room ', o_orderkey % 12) AS interview_location",
        "CAST(1 + o_orderkey % 6 AS INT) AS capacity",
        "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'full' END AS slot_status",
    )


@view
def bookings(t: Tables) -> DataFrame:
    n = t.count("customer")
    rows = t.raw("lineitem").selectExpr("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS booking_id", "l_orderkey + 1 AS slot_id", f"l_partkey % {n} + 1 AS candidate_id", "l_shipdate", "CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 1 DAY END AS gone")
    return rows.groupBy("booking_id", "slot_id", "candidate_id").agg(F.min("l_shipdate").alias("created_at"), F.min("gone").alias("cancelled_at"))


@view
def interviewers(t: Tables) -> DataFrame:
    return t.raw("supplier").selectExpr(
        "s_suppkey + 1 AS interviewer_id", "s_name AS interviewer_name", "concat(lower(s_name), '@example.com') AS interviewer_email",
        "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_nationkey + 1 END AS position_id",
        "element_at(array('1차', '2차', '3차', NULL), CAST(s_suppkey % 4 AS INT) + 1) AS interview_round",
        "timestamp_ntz'1997-01-01 00:00:00' + make_dt_interval(s_suppkey % 30) AS created_at",
    )


@view
def slot_interviewers(t: Tables) -> DataFrame:
    return t.raw("lineitem").selectExpr("l_orderkey + 1 AS slot_id", "l_suppkey + 1 AS interviewer_id").distinct()


@view
def slot_plans(t: Tables) -> DataFrame:
    """Requests for new slots, some of which break a rule."""
    rows = t.raw("lineitem").selectExpr("l_orderkey % 20 AS batch_id", "l_orderkey * 10 + l_linenumber AS request_no", "l_suppkey + 1 AS i", "l_shipdate + make_dt_interval(0, 9 + l_linenumber) AS s", "l_shipdate + make_dt_interval(0, 13 + l_linenumber) AS e")
    rows = rows.groupBy("batch_id", "request_no").agg(F.sort_array(F.collect_set("i")).alias("ids"), F.min("s").alias("starts_at"), F.min("e").alias("e")).withColumn("interviewer_id", F.get("ids", F.lit(0)))
    return rows.join(t.interviewers.select("interviewer_id", "position_id", "interview_round"), "interviewer_id", "left").selectExpr(
        "batch_id", "request_no", "starts_at", "CASE WHEN request_no % 31 = 0 THEN starts_at ELSE e END AS ends_at",
        "CASE WHEN request_no % 13 = 0 THEN request_no % 40 ELSE position_id END AS position_id",
        "CASE WHEN request_no % 17 = 0 THEN '4차' ELSE coalesce(interview_round, '1차') END AS interview_round",
        "CASE WHEN request_no % 23 = 0 THEN concat(ids, slice(ids, 1, 1)) WHEN request_no % 29 = 0 THEN concat(ids, array(0L)) WHEN request_no % 41 = 0 THEN concat(ids, array(1000000000L)) ELSE ids END AS interviewer_ids",
        "CASE WHEN request_no % 19 = 0 THEN '   ' ELSE concat(' Room ', request_no % 12) END AS interview_location", "CAST(CASE WHEN request_no % 37 = 0 THEN 0 ELSE 1 + request_no % 4 END AS INT) AS capacity",
    )


@view
def slot_requests(t: Tables) -> DataFrame:
    return t.slot_plans.select("batch_id", "request_no", F.explode("interviewer_ids").alias("interviewer_id"), "starts_at", "ends_at").distinct()


@view
def slot_patches(t: Tables) -> DataFrame:
    n = t.count("supplier")
    return t.slots.selectExpr(
        "slot_id", "CASE WHEN slot_id % 5 = 0 THEN slot_id % 28 + 1 END AS new_position_id", "CASE WHEN slot_id % 11 = 0 THEN '2차' END AS new_interview_round", "CAST(CASE WHEN slot_id % 3 = 0 THEN 9 END AS INT) AS new_capacity",
        "CASE WHEN slot_id % 2 = 0 THEN interview_starts_at + INTERVAL 1 HOUR END AS new_starts_at", "CASE WHEN slot_id % 4 = 0 THEN interview_ends_at + INTERVAL 1 HOUR END AS new_ends_at",
        "CASE WHEN slot_id % 6 = 0 THEN concat('Hall ', slot_id % 5) END AS new_interview_location", f"CASE WHEN slot_id % 7 = 0 THEN array(slot_id % {n} + 1) WHEN slot_id % 53 = 0 THEN array(1000000000L) END AS new_interviewer_ids",
    )


@view
def admission_bookings(t: Tables) -> DataFrame:
    """The first active booking of each candidate; two of three candidates have cancelled theirs."""
    w = Window.partitionBy("candidate_id").orderBy("booking_id")
    first = t.bookings.where("cancelled_at IS NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return first.withColumn("cancelled_at", F.expr("CASE WHEN candidate_id % 3 <> 0 THEN created_at + INTERVAL 1 DAY END"))


@view
def half_cancelled_bookings(t: Tables) -> DataFrame:
    return t.bookings.withColumn("cancelled_at", F.expr("CASE WHEN candidate_id % 2 = 1 THEN created_at ELSE cancelled_at END"))


@view
def booking_requests(t: Tables) -> DataFrame:
    n = t.count("customer")
    w = Window.partitionBy("position_id")
    pos = t.candidates.where("position_id IS NOT NULL").select("candidate_id", "position_id", F.row_number().over(w.orderBy("candidate_id")).alias("k"), F.count("*").over(w).alias("n"))
    req = t.raw("lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_no"), (F.col("l_orderkey") + 1).alias("slot_id")).agg(F.min("l_partkey").alias("pk"))
    sizes = pos.groupBy("position_id").agg(F.max("n").alias("n"))
    r = req.join(t.slots.select("slot_id", "position_id"), "slot_id").join(sizes, "position_id", "left").withColumn("k", F.expr("pk % n + 1"))
    r = r.join(pos.select("position_id", "k", F.col("candidate_id").alias("p")), ["position_id", "k"], "left")
    return r.selectExpr("request_no", "slot_id", f"CASE WHEN request_no % 10 = 1 THEN (pk * 3) % {n + 20} + 1 ELSE coalesce(p, pk % {n} + 1) END AS candidate_id")


EXTRA = ["CASE WHEN candidate_id % 4 = 1 THEN '남' WHEN candidate_id % 4 = 2 THEN '여' END AS gender", "CASE WHEN candidate_id % 5 < 3 THEN concat('Street ', candidate_id % 90) END AS address"]


@view
def old_candidates(t: Tables) -> DataFrame:
    """The candidates before the intake: two of three under another name."""
    return t.candidates.selectExpr("candidate_id", "position_id", "concat(name, CASE WHEN candidate_id % 3 = 0 THEN '' ELSE ' (old)' END) AS name", "date_of_birth", "phone", "CASE WHEN candidate_id % 2 = 0 THEN email END AS email", "experience_level", "meets_preferred_criteria", "CASE WHEN candidate_id % 7 = 0 THEN '여' END AS gender", "'Old Road' AS address")


@view
def resume_intake(t: Tables) -> DataFrame:
    return t.candidates.selectExpr(*EXTRA, "candidate_id AS seq", "name", "phone", "date_of_birth", "CASE WHEN candidate_id % 4 = 0 THEN NULL ELSE email END AS email", "position_id", "CASE WHEN candidate_id % 5 = 0 THEN '경력' ELSE '신입' END AS experience_level", "meets_preferred_criteria")


@view
def parse_files(t: Tables) -> DataFrame:
    return t.raw("documents").selectExpr("doc_id % 10 AS batch_id", "doc_id AS file_id", "CASE WHEN n_chars < 200 THEN 'too short' END AS error", "CASE WHEN doc_id % 10 IN (3, 7) THEN doc_id % 97 >= 60 ELSE false END AS after_cancel")


@view
def question_reviews(t: Tables) -> DataFrame:
    return t.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("n")).selectExpr(
        "conv_id AS job_id", "60 + conv_id % 41 AS score", "conv_id % 6 <> 0 AS passed", "CAST(CASE WHEN conv_id % 5 = 0 THEN 4 ELSE n END AS BIGINT) AS question_count",
        "CASE WHEN conv_id % 10 = 3 THEN ' Critical' WHEN conv_id % 10 = 4 THEN 'major' ELSE 'minor' END AS severity",
    )


@view
def resumes(t: Tables) -> DataFrame:
    n = max(1, t.count("customer") // 3)
    return t.raw("documents").selectExpr("doc_id + 1 AS resume_id", f"(doc_id * 7) % {n} + 1 AS candidate_id", "text AS raw_text", "CAST(NULL AS STRING) AS summary", "timestamp_ntz'1997-06-01 00:00:00' + make_dt_interval(doc_id % 50) AS created_at")


@view
def careers(t: Tables) -> DataFrame:
    return t.raw("orders").selectExpr(
        "o_custkey + 1 AS candidate_id", "o_orderkey AS career_no",
        "CASE WHEN o_orderkey % 19 = 0 THEN '-' ELSE concat('Company ', o_orderkey % 40) END AS company_name",
        "CASE WHEN o_orderkey % 7 = 0 THEN '인턴' ELSE '정규직' END AS employment_type",
        "CASE WHEN o_orderkey % 8 = 0 THEN 'backend server' ELSE 'sales' END AS position",
        "date_format(o_orderdate, 'yyyy-MM') AS start_date",
        "CASE WHEN o_orderkey % 60 = 0 THEN 'present' ELSE date_format(add_months(o_orderdate, CAST(o_orderkey % 9 AS INT)), 'yyyy-MM') END AS end_date",
    )


@view
def questions(t: Tables) -> DataFrame:
    n = t.count("customer")
    return t.raw("conversations").selectExpr(
        "conv_id * 1000 + turn + 1 AS question_id", f"CASE WHEN turn % 3 = 0 THEN NULL ELSE conv_id % {n} + 1 END AS candidate_id", "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 25 + 1 END AS position_id",
        "concat(CASE WHEN turn % 2 = 0 THEN '[ ] ' ELSE '' END, text) AS question_text",
        "CASE role WHEN 'user' THEN 'position_based' WHEN 'assistant' THEN 'candidate_job_fit_based' ELSE 'candidate_resume_based' END AS question_type",
    )


STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status"


@view
def question_jobs(t: Tables) -> DataFrame:
    return t.raw("events").selectExpr("event_id + 1 AS job_id", STATUS, "user_id + 1 AS candidate_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id + 1 END AS created_by_user_id", "CASE WHEN event_id % 3 = 0 THEN user_id + 1 ELSE NULL END AS created_by_interviewer_id", "ts AS created_at")


@view
def job_events(t: Tables) -> DataFrame:
    return t.raw("events").selectExpr("user_id AS job_id", "event_id AS seq", "ts", STATUS)


@view
def booking_invitations(t: Tables) -> DataFrame:
    n = t.count("orders")
    return t.raw("events").selectExpr(
        "event_id + 1 AS invitation_id", "user_id + 1 AS candidate_id", "sha2(concat('t', event_id), 256) AS token_hash", "ts + INTERVAL 3 DAY AS expires_at",
        f"CASE WHEN event_id % 4 = 0 THEN NULL ELSE array(event_id % {n} + 1, (event_id * 7) % {n} + 1) END AS allowed_slot_ids",
        "CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 1 DAY END AS revoked_at", "ts AS created_at",
    )


@view
def interviewer_invites(t: Tables) -> DataFrame:
    n = t.count("supplier")
    return t.raw("events").selectExpr("event_id + 1 AS invite_id", f"user_id % {n} + 1 AS interviewer_id", "sha2(concat('i', event_id), 256) AS token_hash", "CASE WHEN event_id % 8 = 0 THEN NULL ELSE concat('i', event_id) END AS raw_token", "ts + INTERVAL 7 DAY AS expires_at", "CASE WHEN event_id % 12 = 0 THEN ts + INTERVAL 1 DAY END AS revoked_at", "ts AS created_at")


@view
def availability_decisions(t: Tables) -> DataFrame:
    return t.raw("events").selectExpr("user_id AS token", "event_id AS seq", "ts AS decided_at", "CASE event_type WHEN 'click' THEN ' Accepted ' WHEN 'purchase' THEN 'declined' ELSE event_type END AS decision")


@view
def provider_fields(t: Tables) -> DataFrame:
    return t.raw("customer").withColumn("p", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).selectExpr("c_custkey AS doc_id", "p AS provider_no", "'name' AS field", "CASE WHEN (c_custkey + p) % 5 = 0 THEN '' WHEN (c_custkey * p) % 4 = 1 THEN concat(c_name, ' Jr') ELSE c_name END AS value")


@view
def email_templates(t: Tables) -> DataFrame:
    rows = [(1, "invite", "Interview for {candidate_name}", "Hello {candidate_name}, pick a time: {invitation_url}"), (2, "nolink", "Notice", "Hello {candidate_name}. You have {slot_count} slots."), (3, "broken", "Hi {unknown_key}", "Body {access_link}")]
    return t.spark.createDataFrame(rows, "id int, name string, subject string, body string")


@view
def written_templates(t: Tables) -> DataFrame:
    """A mail template per order, with keys that depend on it."""
    return t.raw("orders").selectExpr("o_orderkey AS id", "concat('Hi {k', o_orderkey % 7, '}') AS subject", "concat('{k', o_orderkey % 5, '} then {name_', o_orderkey % 3, '} and {bad key} {k', o_orderkey % 7, '}') AS body")


NAMES = ["김민수", "이서연", "박지훈", "최유진", "정하늘"]
ROLES = ["백엔드 개발", "데이터 분석", "생산 관리", "국내영업"]
SCHOOLS = ["한국대학교", "서울대학교", "미래전문대학", "동서대학교"]
MAJORS = ["컴퓨터공학과", "경영학과", "기계공학과"]
COMPANIES = ["한빛전자", "가온소프트", "누리산업"]
JOBS = ["펌웨어개발", "품질관리", "사업기획"]


@view
def resume_parts(t: Tables) -> DataFrame:
    """What the resume of each customer says; dealt over tasks, as a resume is much longer work than its row is to read."""
    c = dealt(t.raw("customer").select("c_custkey", F.col("c_custkey").alias("k")))
    of = lambda items, k: F.get(F.lit(items), F.expr(f"CAST({k} % {len(items)} AS INT)"))
    return c.select(
        (F.col("k") + 1).alias("doc_id"), "k", F.expr("element_at(array('text', 'pdf', 'hwp'), CAST(k % 3 AS INT) + 1)").alias("kind"), of(NAMES, "k").alias("name"), F.expr("concat(1970 + k % 25, '.0', 1 + k % 9, '.1', k % 9)").alias("birth"),
        F.expr("CASE WHEN k % 6 = 0 THEN concat('02-555-', lpad(k % 10000, 4, '0')) ELSE concat('010-1234-', lpad(k % 10000, 4, '0')) END").alias("phone"), F.expr("concat('user', k, '@example.com')").alias("email"), F.expr("concat('서울시 강남구 ', k % 300, '번지')").alias("address"), of(ROLES, "k").alias("role"),
        F.expr("CASE WHEN k % 5 <> 4 THEN 1 ELSE 0 END").alias("has_school"), of(SCHOOLS, "k").alias("school"), of(MAJORS, "k").alias("major"), F.expr("concat(2000 + k % 15, '.03~', 2004 + k % 15, '.02')").alias("studied"),
        F.expr("CAST(k % 3 AS INT)").alias("n_careers"), of(COMPANIES, "k").alias("company"), of(JOBS, "k").alias("job"), F.expr("CASE WHEN k % 4 = 0 THEN '2019.05' END").alias("passed"), F.expr("CAST(k % 6 AS INT)").alias("served"),
    )


LETTER = "저는 꾸준히 배우는 사람입니다. "


@view
def resume_texts(t: Tables) -> DataFrame:
    """A resume as text for each customer; schools stand in a line, or as a table that fell into lines."""
    return t.resume_parts.selectExpr("*", f"""concat_ws('\n', '이력서', concat('성명: ', name), concat('생년월일: ', birth), concat('연락처: ', phone), concat('E-mail: ', email), concat('주소: ', address), concat('지원직무: ', role), CASE WHEN k % 2 = 0 THEN '성별: 여' ELSE '성별: 남성' END,
     CASE WHEN k % 8 = 0 THEN '국가 보훈 대상: 비대상' END, CASE WHEN k % 3 = 0 THEN '희망 근무지: 서울' END, CASE WHEN k % 3 = 1 THEN concat('희망 연봉: ', 3000 + k % 50, '만원') END, '경력사항', CASE WHEN n_careers > 0 THEN concat('2015.03~2018.02 ', company, ' ', job) END, CASE WHEN n_careers > 1 THEN concat('2018.04~현재 ', company, '주식회사 ', job) END,
     '자격사항', '자격증', concat('정보처리기사', coalesce(concat(' ', passed), ''), ' 한국산업인력공단'), '학 교 명', '컴퓨터활용능력 1급', CASE WHEN served < 5 THEN '병역사항' END,
     CASE served WHEN 0 THEN '군필 육군 2012년 5월 ~ 2014년 2월' WHEN 1 THEN '면제 사유: 신체 등급 판정' WHEN 2 THEN '면제 (모름)' WHEN 3 THEN '병역사항 | 필 / 2012년 5월 ~ 2014년 2월 / 해군 / 병장' WHEN 4 THEN '복무기간: 2011년 1월 ~ 2012년 12월' END,
     '자기소개서', '1. 지원동기', repeat('{LETTER}', 20), '학력사항', CASE WHEN has_school = 0 THEN '서울고등학교' WHEN k % 2 = 0 THEN concat(school, ' ', major, ' 졸업 (', studied, ')') ELSE concat(studied, '\n', school, '\n', major, '\n졸업') END) AS text""")


@view
def resume_tables(t: Tables) -> DataFrame:
    """The tables of cells of each customer's resume: labels with values, education, careers, qualifications with a header or without."""
    cells = """array(
     array(array('사진', '사진', '성 명', name, '생년월일', birth), array('', '연락처', '전화', phone), array('E-mail', '주소'), array(email, address), array('병 역', CASE WHEN k % 2 = 0 THEN '군필' ELSE '확인' END, concat('필 / ', studied, ' / 공군 / 병장'))),
     array(array('학교명', '전공', '재학기간', '졸업구분', '소재지'), array('서울고등학교', '-', '1997.03~1999.02', '졸업', '서울'), CASE WHEN has_school = 1 THEN array(school, major, studied, '졸업', '부산') ELSE array('', '', '', '', '') END, CASE WHEN k % 7 = 0 THEN array(concat(school, ' ', major, ' 졸업 (2001.03~2003.02)'), '', '', '', '') ELSE array('없음', '', '', '', '') END),
     array(array('회사명', '재직기간', '담당업무'), array(company, '2015.03~2018.02', job), array('회사명', '없음', job)),
     CASE WHEN k % 2 = 0 THEN array(array('번호', '자격증명', '취득일', '발행처', '등록번호'), array('1', '정보처리기사', '2019년 5월', '한국산업인력공단', concat('N', k)), array('2', '등급', '', '', '')) ELSE array(array('2018.03', '토익 900', 'ETS'), array('2019.11', '정보처리기사'), array('2020.01', '등급')) END)"""
    return t.resume_parts.selectExpr("*", f"{cells} AS tables")
