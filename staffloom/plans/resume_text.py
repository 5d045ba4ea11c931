"""Queries on resume text, over whole texts of whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.fixtures import Tables
from staffloom.functions import text as x
from staffloom.operators import resume_grids as grids
from staffloom.operators import resume_intake as intake
from staffloom.operators import resume_records as records
from staffloom.operators import resume_text as r
from staffloom.plans.catalog import query
from staffloom.sources import files, tables

DOC = "documents"


BROKEN = "text || chr(10) || 'me@example.co' || chr(10) || ' m' || chr(10) || '010-1234-5' || chr(10) || '67' || chr(10) || '2019  ' || CAST(1 + doc_id % 9 AS VARCHAR) || chr(10) || '2018' || chr(10) || '03' || chr(10) || '2018.01' || chr(10) || '~' || chr(10) || '2019.02' || chr(10) || '2017.01 - 2018.' || CAST(1 + doc_id % 9 AS VARCHAR)"
# the SQL's patterns have no look ahead: what follows is taken and put back
SPLIT_EMAIL = r"regexp_replace({}, '([a-zA-Z0-9._%+\-가-힣]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2}})\s*\n\s*([a-zA-Z]{{1,3}})', '\1\2', 'g')"
SPLIT_RANGE = r"regexp_replace({}, '(\d{{4}}[.\-]\d{{1,2}})\s*\n\s*[-~]\s*\n\s*(\d{{4}}[.\-]\d{{1,2}})', '\1~\2', 'g')"
HWP = SPLIT_RANGE.format(r"regexp_replace({}, '(\d{{4}})\s*\n\s*(\d{{1,2}})(\s*(?:\n|$))', '\1.\2\3', 'g')".format(SPLIT_EMAIL.format(BROKEN)))
PDF = SPLIT_RANGE.format(r"regexp_replace(regexp_replace({}, '((?:010|011|016|017|018|019)[-\s]?\d{{3,4}}[-\s]?\d{{1,2}})\s*\n\s*(\d{{2,4}})', '\1\2', 'g'), '(\d{{4}})\s+(\d{{1,2}})(\s*(?:\n|$))', '\1.\2\3', 'g')".format(SPLIT_EMAIL.format(BROKEN)))
PDF = rf"regexp_replace({PDF}, '(\d{{4}}[.\-]\d{{1,2}})\s*[-~]\s*(\d{{4}}[.\-]\d{{1,2}})', '\1~\2', 'g')"


@query("b10_repair_broken_text", f"SELECT doc_id, sha256({HWP}) AS hwp, sha256({PDF}) AS pdf FROM documents")
def _(t: Tables) -> DataFrame:
    text = F.expr(BROKEN.replace("chr(10)", "'\\n'").replace("AS VARCHAR", "AS STRING"))
    return t.raw(DOC).select("doc_id", *[F.sha2(x.repair_broken_text(text, kind), 256).alias(kind) for kind in ("hwp", "pdf")])


@query("c1_extract_basic", "SELECT doc_id, name, birth, phone, email, address, role FROM resume_parts")
def _(t: Tables) -> DataFrame:
    return t.resume_texts.select("doc_id", r.extract_basic(F.col("text")).alias("b")).select("doc_id", "b.*")


@query("c1_extract_basic_documents", rf"""SELECT doc_id, trim(regexp_extract(text, '{r.BIRTH}', 1)) AS birth, CASE WHEN regexp_matches(text, '{r.MOBILE}') THEN trim(regexp_extract(text, '{r.MOBILE}', 1)) ELSE trim(regexp_extract(text, '{r.LANDLINE}', 1)) END AS phone, trim(regexp_extract(text, '{r.ADDRESS}', 1)) AS address FROM documents""")
def _(t: Tables) -> DataFrame:
    found = t.raw(DOC).select("doc_id", r.extract_basic(F.col("text")).alias("b"))
    return found.select("doc_id", "b.birth", "b.phone", "b.address")


EDUCATION = "CASE WHEN has_school = 1 THEN school || ' ' || major || ' 졸업 (' || studied || ')' ELSE '' END"


@query("c5_split_education", "SELECT doc_id, school, CASE WHEN k % 3 = 1 THEN '문헌정보' ELSE major END AS department, '학사' AS level, CASE WHEN k % 3 <> 2 THEN studied END AS period, CASE WHEN k % 3 <> 2 THEN split_part(studied, '~', 1) END AS starts, CASE WHEN k % 3 <> 2 THEN split_part(studied, '~', 2) END AS ends FROM resume_parts")
def _(t: Tables) -> DataFrame:
    blob = F.expr("CASE CAST(k % 3 AS INT) WHEN 0 THEN concat(school, ' ', major, ' 졸업 (', studied, ')') WHEN 1 THEN concat(studied, ' ', school, ' 재학  문헌정보') ELSE concat(school, '   ', major, ' 수료') END")
    return records.split_education(t.resume_parts, "doc_id", blob).select("doc_id", "education.school", "education.department", "education.level", "education.period", F.col("education.start").alias("starts"), F.col("education.end").alias("ends"))


@query("c6_final_education", f"SELECT doc_id, {EDUCATION} AS value, CASE WHEN has_school = 1 THEN studied ELSE '' END AS period FROM resume_parts")
def _(t: Tables) -> DataFrame:
    return t.resume_texts.select("doc_id", records.final_education(F.col("text")).alias("e")).select("doc_id", "e.*")


@query("c6_section_education", f"SELECT doc_id, kind, CASE WHEN k % 2 = 1 THEN {EDUCATION} ELSE '' END AS value FROM resume_parts, (SELECT unnest(['hwp', 'pdf']) AS variant) WHERE kind = variant")
def _(t: Tables) -> DataFrame:
    of = lambda kind: t.resume_texts.where(F.col("kind") == kind).select("doc_id", "kind", records.section_education(F.col("text"), kind)["value"].alias("value"))
    return of("hwp").union(of("pdf"))


CAREERS = "SELECT doc_id, 1 AS n, '2015.03~2018.02' AS period, company, job FROM resume_parts WHERE n_careers > 0 UNION ALL SELECT doc_id, 2, '2018.04~현재', company || '주식회사', job FROM resume_parts WHERE n_careers > 1"


@query("c7_career_entries", f"SELECT doc_id, period, company, job FROM ({CAREERS})")
def _(t: Tables) -> DataFrame:
    rows = t.resume_texts.select("doc_id", "text", records.final_education(F.col("text"))["period"].alias("studied_"))
    return rows.select("doc_id", F.explode(records.career_entries(F.col("text"), F.col("studied_"))).alias("e")).select("doc_id", "e.*")


@query("c7_section_career", "SELECT doc_id, CASE WHEN k % 2 = 0 THEN '2015.03~2018.02' ELSE '2016.05~2019.11' END AS period, company, job FROM resume_parts")
def _(t: Tables) -> DataFrame:
    text = F.expr("concat_ws('\\n', '경력사항', '회사명', CASE WHEN k % 2 = 0 THEN '2015.03 ~ 2018.02' ELSE '2016.05\\n201911' END, company, '부 서', job, '재직 회사', '해외경험', '2011.01 ~ 2012.02')")
    plain = F.regexp_replace(text, r"\s*~\s*", "~")
    kinds = F.when(F.col("k") % 2 == 0, records.section_career(plain, "pdf")).otherwise(records.section_career(plain, "hwp"))
    return t.resume_parts.select("doc_id", kinds.alias("c")).select("doc_id", "c.*")


SERVICE = """SELECT doc_id, CASE served WHEN 0 THEN '군필' WHEN 1 THEN '면제' WHEN 2 THEN '면제' ELSE '군필' END AS type, CASE served WHEN 0 THEN '육군' WHEN 3 THEN '해군' END AS service, CASE WHEN served IN (0, 3) THEN '2012.05' WHEN served = 4 THEN '2011.01' END AS starts,
 CASE WHEN served IN (0, 3) THEN '2014.02' WHEN served = 4 THEN '2012.12' END AS ends, CASE WHEN served = 3 THEN '병장' END AS rank, CASE served WHEN 1 THEN '신체 등급 판정' WHEN 2 THEN '담당자 확인 필요' END AS reason, 1 AS n FROM resume_parts WHERE served < 5
 UNION ALL SELECT doc_id, NULL, '해군', '2012.05', '2014.02', NULL, NULL, 2 FROM resume_parts WHERE served = 3 UNION ALL SELECT doc_id, NULL, NULL, '2011.01', '2012.12', NULL, NULL, 2 FROM resume_parts WHERE served = 4"""


@query("c9_military_rows", SERVICE)
def _(t: Tables) -> DataFrame:
    rows = t.resume_texts.select("doc_id", F.posexplode(records.military_rows(F.col("text"))).alias("n", "r"))
    return rows.select("doc_id", "r.type", "r.service", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"), "r.rank", F.col("r.exemption_reason").alias("reason"), (F.col("n") + 1).alias("n"))


@query("c8_longest_intro", "SELECT doc_id, '1. 지원동기' || chr(10) || trim(repeat('저는 꾸준히 배우는 사람입니다. ', 20)) AS letter FROM resume_parts")
def _(t: Tables) -> DataFrame:
    return t.resume_texts.select("doc_id", records.letter(F.col("text")).alias("letter"))


@query("c12_grid_records", """SELECT doc_id, name, phone, address, email, birth, CASE WHEN has_school = 1 THEN school || ' ' || major || ' 졸업 (' || studied || ')' WHEN k % 7 = 0 THEN school || ' 졸업 (2001.03~2003.02)' ELSE '' END AS education, 1 + has_school + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS n_education,
 '서울고등학교/고등학교/1997.03/1999.02' || CASE WHEN has_school = 1 THEN '|' || school || ' ' || major || '/학사/' || split_part(studied, '~', 1) || '/' || split_part(studied, '~', 2) ELSE '' END || CASE WHEN k % 7 = 0 THEN '|' || school || '/학사/2001.03/2003.02' ELSE '' END AS rows,
 '2015.03~2018.02/' || company || '/' || job AS careers, CASE WHEN k % 2 = 0 THEN '정보처리기사/한국산업인력공단/2019-05-01/N' || k ELSE '토익 900/ETS/2018-03-01/|정보처리기사//2019-11-01/' END AS qualifications,
 CASE WHEN k % 2 = 0 THEN '군필////|' ELSE '' END || '군필/공군/' || split_part(studied, '~', 1) || '/' || split_part(studied, '~', 2) || '/병장' AS service FROM resume_parts""")
def _(t: Tables) -> DataFrame:
    rows = grids.grid_records(t.resume_tables, "doc_id", "tables")
    shown = lambda c, *fields: F.array_join(F.transform(c, lambda r: F.concat_ws("/", *[F.coalesce(r[f], F.lit("")) for f in fields])), "|")
    education = F.array_join(F.transform("educationRows", lambda r: F.concat_ws("/", F.concat_ws(" ", r["school"], r["department"]), r["level"], r["start"], r["end"])), "|")
    return rows.select(
        "doc_id", "name", "phone", "address", "email", "birth", F.col("finalEducation").alias("education"), F.size("educationRows").alias("n_education"), education.alias("rows"), shown("careers", "period", "company", "job").alias("careers"),
        shown("qualificationRows", "certificate", "organization", "issued", "number").alias("qualifications"), shown("militaryRows", "type", "service", "start", "end", "rank").alias("service"),
    )


@query("c21_parse_resumes", f"""WITH car AS (SELECT doc_id, string_agg(period, chr(10) ORDER BY n) AS careerPeriod, string_agg(company, chr(10) ORDER BY n) AS careerCompany, string_agg(job, chr(10) ORDER BY n) AS careerRole FROM ({CAREERS}) GROUP BY doc_id), mil AS (SELECT doc_id, count(*) AS n FROM ({SERVICE}) GROUP BY doc_id)
 SELECT doc_id, name, birth AS birthDate, phone AS contact, email, address, role AS originalJobRole, CASE WHEN has_school = 1 THEN {EDUCATION} ELSE '기타' END AS finalEducation, coalesce(careerPeriod, '') AS careerPeriod, coalesce(careerCompany, '') AS careerCompany, coalesce(careerRole, '') AS careerRole, upper(kind) AS fileType,
 CASE WHEN k % 2 = 0 THEN '여' ELSE '남' END AS gender, CASE WHEN k % 8 = 0 THEN '비대상' ELSE '' END AS veteran, CASE WHEN k % 3 = 0 THEN '서울' ELSE '' END AS desired_location, CASE WHEN k % 3 = 1 THEN CAST(3000 + k % 50 AS VARCHAR) || '만원' ELSE '' END AS desired_salary, CAST(coalesce(mil.n, 0) AS INTEGER) AS n_military,
 '정보처리기사' || coalesce(' ' || passed, '') || ' 한국산업인력공단//한국산업인력공단//' || coalesce('2019-05-01', '') || '|컴퓨터활용능력 1급////' AS qualifications FROM resume_parts LEFT JOIN car USING (doc_id) LEFT JOIN mil USING (doc_id)""".replace("coalesce('2019-05-01', '')", "CASE WHEN passed IS NULL THEN '' ELSE '2019-05-01' END"))
def _(t: Tables) -> DataFrame:
    rows = records.parse_resumes(t.resume_texts, "doc_id", "text", "kind")
    shown = F.array_join(F.transform("qualificationRows", lambda q: F.concat(q["certificate"], F.lit("//"), F.coalesce(q["organization"], F.lit("")), F.lit("//"), F.coalesce(q["issued"], F.lit("")))), "|")
    return rows.select("doc_id", *records.RECORD, "fileType", "gender", "veteran", "desired_location", "desired_salary", F.size("militaryRows").alias("n_military"), shown.alias("qualifications"))


@query("c3_parse_period", """SELECT career_no, CASE WHEN career_no % 5 = 4 THEN NULL ELSE replace(start_date, '-', '.') END AS starts, CASE career_no % 5 WHEN 0 THEN CASE WHEN end_date <> 'present' THEN replace(end_date, '-', '.') END WHEN 1 THEN '2031.12' WHEN 3 THEN '2032.01' END AS ends FROM careers""")
def _(t: Tables) -> DataFrame:
    dotted = lambda c: F.replace(F.col(c), F.lit("-"), F.lit("."))
    korean = F.regexp_replace("start_date", r"(\d{4})-0?(\d{1,2})", "$1년 $2월")
    forms = [F.concat(F.lit("근무 "), dotted("start_date"), F.lit(" ~ "), F.when(F.col("end_date") == "present", "현재").otherwise(dotted("end_date"))), F.concat(dotted("start_date"), F.lit(" 2020.05 그리고 2031.12")), F.concat(F.lit("since "), dotted("start_date")), F.concat(korean, F.lit("부터 2032년 1월")), F.lit("기간 없음 2020")]
    text = F.get(F.array(*forms), (F.col("career_no") % 5).cast("int"))
    return t.careers.select("career_no", r.parse_period(text).alias("p")).select("career_no", F.col("p.start").alias("starts"), F.col("p.end").alias("ends"))


@query("c8_slice_section", """WITH a AS (SELECT doc_id, replace(text, chr(13), '') AS t FROM documents), p AS (SELECT *, strpos(t, 'the') AS a1, strpos(t, 'der') AS a2 FROM a),
 s AS (SELECT *, CASE WHEN a1 > 0 AND (a2 = 0 OR a1 <= a2) THEN a1 ELSE a2 END AS st FROM p), rest AS (SELECT doc_id, st, substr(t, st + 3) AS r FROM s), e AS (SELECT *, strpos(r, chr(10)) AS e1, strpos(r, '. ') AS e2 FROM rest)
 SELECT doc_id, CASE WHEN st = 0 THEN '' ELSE regexp_replace(CASE WHEN e1 = 0 AND e2 = 0 THEN r WHEN e1 = 0 THEN substr(r, 1, e2 - 1) WHEN e2 = 0 THEN substr(r, 1, e1 - 1) ELSE substr(r, 1, least(e1, e2) - 1) END, '^\\s+|\\s+$', '', 'g') END AS part FROM e""")
def _(t: Tables) -> DataFrame:
    return t.raw(DOC).select("doc_id", r.slice_section(F.col("text"), ["the", "der"], ["\n", ". "]).alias("part"))


HEADERS = ", ".join(f"'{h}'" for h in [*r.HEADERS, *r.TABLE_HEADERS])


@query("c10_qualification_rows", rf"""WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
 k AS (SELECT * FROM l WHERE length(line) >= 3 AND regexp_replace(line, '\s+', '', 'g') NOT IN ({HEADERS}) AND NOT regexp_full_match(line, '[\s\-.0-9]+')), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM k)
 SELECT doc_id, line_no, substr(line, 1, 500) AS certificate, CASE WHEN regexp_matches(line, '(20\d{{2}})[.\-/년]\s*(\d{{1,2}})') THEN regexp_extract(line, '(20\d{{2}})[.\-/년]\s*(\d{{1,2}})', 1) || '-' || lpad(regexp_extract(line, '(20\d{{2}})[.\-/년]\s*(\d{{1,2}})', 2), 2, '0') || '-01' END AS issued FROM n WHERE rn <= 30""")
def _(t: Tables) -> DataFrame:
    return r.qualification_rows(t.raw(DOC), "doc_id", "text").select("doc_id", "line_no", "certificate", "issued")


@query("c13_experience_rows", """WITH g AS (SELECT candidate_id, career_no, company_name, position, replace(start_date, '-', '.') AS starts, CASE WHEN end_date <> 'present' THEN replace(end_date, '-', '.') END AS ends, row_number() OVER (PARTITION BY candidate_id ORDER BY career_no) - 1 AS row_no FROM careers),
 n AS (SELECT candidate_id, max(row_no) AS top FROM g GROUP BY 1), l AS (SELECT g.candidate_id, top, starts AS ls, ends AS le FROM g JOIN n ON n.candidate_id = g.candidate_id AND row_no = greatest(top - 1, 0))
 SELECT g.candidate_id, CAST(row_no AS INTEGER) AS row_no, company_name AS company, position AS role, CASE WHEN row_no = top AND top > 0 THEN ls ELSE starts END AS starts, CASE WHEN row_no = top AND top > 0 THEN le ELSE ends END AS ends FROM g JOIN l ON l.candidate_id = g.candidate_id""")
def _(t: Tables) -> DataFrame:
    dotted = lambda c: F.replace(F.col(c), F.lit("-"), F.lit("."))
    period = F.concat(dotted("start_date"), F.lit("-"), F.when(F.col("end_date") == "present", "현재").otherwise(dotted("end_date")))
    lines = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("career_no", c.alias("v")))), lambda s: s["v"])
    merged = t.careers.groupBy("candidate_id").agg(lines(period).alias("p"), F.array_join(lines(F.col("company_name")), "\n").alias("c"), F.array_join(lines(F.col("position")), "\n").alias("r"))
    merged = merged.withColumn("p", F.array_join(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), "\n"))  # the last period is left out, so the one before it counts again
    return r.experience_rows(merged, "candidate_id", "p", "c", "r").select("candidate_id", "row_no", "company", "role", F.col("start").alias("starts"), F.col("end").alias("ends"))


@query("c14_finalize_record", "SELECT candidate_id, name, coalesce(phone, '') AS contact, '기타' AS role, '기타' AS education, CASE WHEN candidate_id % 2 = 0 THEN '기타' ELSE '' END AS company, CASE WHEN candidate_id % 3 = 0 THEN 1 ELSE 0 END AS n_education, 0 AS n_statements FROM candidates")
def _(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    lists = {"educationRows": F.when(F.col("candidate_id") % 3 == 0, F.array(F.lit("x"))), "statementRows": F.lit(None).cast("array<string>")}
    rows = t.candidates.select("candidate_id", "name", F.col("phone").alias("contact"), none.alias("originalJobRole"), F.lit("  ").alias("finalEducation"), F.when(F.col("candidate_id") % 2 == 0, " 2020.01~2021.01 ").alias("careerPeriod"), none.alias("careerCompany"), none.alias("careerRole")).withColumns(lists)
    return r.finalize_record(rows).select("candidate_id", "name", "contact", F.col("originalJobRole").alias("role"), F.col("finalEducation").alias("education"), F.col("careerCompany").alias("company"), F.size("educationRows").alias("n_education"), F.size("statementRows").alias("n_statements"))


@query("c15_grounded_merge", r"SELECT candidate_id, CASE WHEN candidate_id % 2 = 0 THEN 'kept' WHEN candidate_id % 3 = 0 THEN name ELSE NULL END AS name, CASE candidate_id % 4 WHEN 0 THEN '서울대학교' WHEN 1 THEN '한국대학교 (2010.03~2014.02)' WHEN 2 THEN '(2010)' ELSE '고교' END AS education FROM candidates")
def _(t: Tables) -> DataFrame:
    own = F.expr("CASE candidate_id % 4 WHEN 0 THEN '서울대학교' WHEN 1 THEN '' WHEN 2 THEN '(2010)' ELSE '고교' END")
    offered = F.expr("CASE candidate_id % 4 WHEN 3 THEN '한국대학교' WHEN 2 THEN '다른대학교 (2010.03~2014.02)' ELSE '한국대학교 (2010.03~2014.02)' END")
    source = F.concat(F.when(F.col("candidate_id") % 3 == 0, F.concat(F.lit("about "), F.upper(x.squeezed(F.col("name"))))).otherwise("nothing"), F.lit(" 한국 대학교(2010-03 ~ 2014-02)"))
    rows = t.candidates.select("candidate_id", F.when(F.col("candidate_id") % 2 == 0, "kept").alias("name"), F.col("name").alias("ai_name"), own.alias("finalEducation"), offered.alias("ai_finalEducation"), source.alias("source"))
    return r.grounded_merge(rows, ["name", "finalEducation"], "ai_", "source").select("candidate_id", "name", F.col("finalEducation").alias("education"))


VOTED = """v AS (SELECT doc_id, field, value, count(*) AS votes, min(provider_no) AS first FROM fields WHERE value <> '' GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY votes DESC, length(value) DESC, first) AS n FROM v),
 o AS (SELECT DISTINCT p.doc_id, p.field, CASE WHEN p.field = 'finalEducation' AND NOT regexp_matches(coalesce(b.value, ''), '대학.*\\(\\d{4}\\.\\d{1,2}~') THEN '' ELSE coalesce(b.value, '') END AS value, b.votes FROM fields p LEFT JOIN b ON b.doc_id = p.doc_id AND b.field = p.field AND n = 1)""".replace("\\\\", "\\")
EDUCATION_FIELD = "CASE WHEN doc_id % 3 = 0 THEN '한국대학교 (2010.03~2014.02)' WHEN doc_id % 3 = 1 THEN '한국대학교' ELSE '(2010.03~2014.02)' END"


def fields_of(t: Tables) -> DataFrame:
    return t.provider_fields.union(t.provider_fields.selectExpr("doc_id", "provider_no", "'finalEducation' AS field", f"{EDUCATION_FIELD} AS value"))


FIELDS = f"fields AS (SELECT * FROM provider_fields UNION ALL SELECT doc_id, provider_no, 'finalEducation', {EDUCATION_FIELD} FROM provider_fields)"


@query("c16_vote_fields", f"WITH {FIELDS}, {VOTED} SELECT * FROM o")
def _(t: Tables) -> DataFrame:
    return r.vote_fields(fields_of(t))


@query("c16_voted_records", f"WITH {FIELDS}, {VOTED} SELECT doc_id, max(value) FILTER (field = 'name') AS name, max(value) FILTER (field = 'finalEducation') AS education FROM o GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    return r.voted_records(r.vote_fields(fields_of(t)), ["name", "finalEducation"]).select("doc_id", "name", F.col("finalEducation").alias("education"))


EXPORTED = ", ".join(c if c in ("name", "contact", "email", "address") else f"'' AS {c}" for c in files.EXPORT_COLUMNS)


@query("a4_cumulative_export", f"""WITH o AS (SELECT 0 AS p, candidate_id AS o, coalesce(name, '') AS name, coalesce(phone, '') AS contact, coalesce(email, '') AS email, coalesce(address, '') AS address FROM old_candidates UNION ALL SELECT 1, seq, coalesce(name, ''), coalesce(phone, ''), coalesce(email, ''), coalesce(address, '') FROM resume_intake)
 SELECT {EXPORTED} FROM (SELECT *, row_number() OVER (PARTITION BY name, contact ORDER BY p DESC, o DESC) AS n FROM o) WHERE n = 1""")
def _(t: Tables) -> DataFrame:
    old = t.old_candidates.selectExpr("candidate_id AS seq", "name", "phone AS contact", "email", "address")
    return files.cumulative_export(old, t.resume_intake.selectExpr("seq", "name", "phone AS contact", "email", "address"))


@query("a5_parse_resume_json", """SELECT candidate_id, CASE WHEN candidate_id % 7 = 0 THEN 'not a JSON record' END AS error, CASE WHEN candidate_id % 7 <> 0 THEN name END AS name, CASE WHEN candidate_id % 7 <> 0 THEN 'C' || candidate_id END AS company, CASE WHEN candidate_id % 7 <> 0 AND candidate_id % 2 = 0 THEN 'kept' END AS summary,
 CASE WHEN candidate_id % 7 <> 0 THEN CAST(4000 + candidate_id AS BIGINT) END AS salary, CASE WHEN candidate_id % 7 <> 0 THEN 'SQL|Spark' END AS skills, CASE WHEN candidate_id % 7 <> 0 THEN 'Target' END AS target FROM candidates""")
def _(t: Tables) -> DataFrame:
    text = F.to_json(F.struct(
        F.struct(F.struct("name", F.lit("x").alias("unknown")).alias("personal_info"), F.struct(F.struct((F.col("candidate_id") + 4000).alias("amount")).alias("desired_salary")).alias("desired_conditions"), F.array(F.struct(F.concat(F.lit("C"), F.col("candidate_id").cast("string")).alias("company_name"))).alias("careers"), F.array(F.lit("SQL"), F.lit("Spark")).alias("skills")).alias("parsed_json"),
        F.when(F.col("candidate_id") % 2 == 0, " kept ").otherwise("  ").alias("summary"), F.struct(F.lit("Target").alias("target_position")).alias("ai_profile"),
    ))
    bad = F.expr("CASE WHEN candidate_id % 7 = 0 THEN 'no JSON {' END")
    v = t.candidates.select("candidate_id", files.parse_resume_json(F.coalesce(bad, text)).alias("p")).select("candidate_id", "p.error", "p.value.*")
    return v.select("candidate_id", "error", F.col("parsed_json.personal_info.name").alias("name"), F.get("parsed_json.careers", F.lit(0))["company_name"].alias("company"), "summary", F.col("parsed_json.desired_conditions.desired_salary.amount").alias("salary"), F.array_join("parsed_json.skills", "|").alias("skills"), F.col("ai_profile.target_position").alias("target"))


@query("c2_profile_scalars", "SELECT doc_id, CASE WHEN k % 2 = 0 THEN '여' ELSE '남' END AS gender, CAST(NULL AS VARCHAR) AS disability, CASE WHEN k % 8 = 0 THEN '비대상' END AS veteran, CASE WHEN k % 3 = 0 THEN '서울' END AS desired_location, CASE WHEN k % 3 = 1 THEN CAST(3000 + k % 50 AS VARCHAR) || '만원' END AS desired_salary FROM resume_parts")
def _(t: Tables) -> DataFrame:
    return t.resume_texts.select("doc_id", r.extract_profile_scalars(F.col("text")).alias("p")).select("doc_id", "p.*")


LEVEL_CASES = [("서울고등학교", "", "", "고등학교"), ("한국대학교", "컴퓨터공학 박사", "", "박사"), ("한국대학교", "Ph. D in CS", "", "박사"), ("한국대학교", "경영 석사", "", "석사"), ("X", "MBA", "", "석사"), ("한국대학원", "", "", r.UNCLEAR_GRADUATE), ("미래전문대", "", "", "학사"), ("동서 대학", "", "", "학사"), ("중앙중학교 고등학교", "", "", None), ("", "", "한국대학 (서울)", "학사"), ("학원", "", "", None)]


@query("c4_education_level", f"SELECT doc_id, CASE CAST(k % {len(LEVEL_CASES)} AS INT) " + " ".join(f"WHEN {i} THEN '{c[3]}'" for i, c in enumerate(LEVEL_CASES) if c[3]) + " END AS level FROM resume_parts")
def _(t: Tables) -> DataFrame:
    of = lambda n: F.get(F.lit([c[n] for c in LEVEL_CASES]), (F.col("k") % len(LEVEL_CASES)).cast("int"))
    return t.resume_parts.select("doc_id", r.education_level(of(0), of(1), F.lit(None).cast("string"), of(2)).alias("level"))


@query("a1_read_tables", "SELECT position_id, position_name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM positions")
def _(t: Tables) -> DataFrame:
    folder = f"{tables.shared_folder(t.spark)}/a1-{uuid.uuid4().hex}"
    t.positions.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")).write.option("header", True).csv(f"{folder}/positions.csv")
    return tables.read_table(t.spark, "positions", folder, "csv").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("a1_read_arrays", "SELECT candidate_id, name, array_to_string(meets_preferred_criteria, '|') AS criteria, strftime(date_of_birth, '%Y-%m-%d') AS born FROM candidates")
def _(t: Tables) -> DataFrame:
    folder = f"{tables.shared_folder(t.spark)}/a1-{uuid.uuid4().hex}"
    order = [c.split()[0] for c in tables.SCHEMAS["candidates"].split(", ")]
    rows = t.candidates.withColumn("meets_preferred_criteria", F.to_json("meets_preferred_criteria")).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in order]).write.option("header", True).option("escape", '"').csv(f"{folder}/candidates.csv")
    return tables.read_table(t.spark, "candidates", folder, "csv", escape='"').select("candidate_id", "name", F.array_join("meets_preferred_criteria", "|").alias("criteria"), F.date_format("date_of_birth", "yyyy-MM-dd").alias("born"))


@query("a3_write_csv_export", '''SELECT '"' || name || '","' || coalesce(phone, '') || '","say ""' || candidate_id || '"""' AS line FROM candidates''')
def _(t: Tables) -> DataFrame:
    folder = f"{tables.shared_folder(t.spark)}/a3-{uuid.uuid4().hex}"
    files.write_csv_export(t.candidates.withColumn("said", F.concat(F.lit('say "'), F.col("candidate_id").cast("string"), F.lit('"'))), {"name": "이름", "phone": "연락처", "said": "메모"}, folder)
    return t.spark.read.text(folder).where(~F.col("value").startswith('"이름"')).select(F.col("value").alias("line"))


@query("i1_resume_intake", f"""WITH car AS (SELECT doc_id, 36 AS months FROM ({CAREERS}) GROUP BY doc_id)
 SELECT doc_id AS seq, name, phone, CASE WHEN k % 2 = 0 THEN '여' ELSE '남' END AS gender, address, replace(birth, '.', '-') AS born, email, CASE WHEN months >= 12 AND job NOT LIKE '%교육%' THEN '경력' ELSE '신입' END AS experience_level, CAST(NULL AS VARCHAR) AS error FROM resume_parts LEFT JOIN car USING (doc_id)""")
def _(t: Tables) -> DataFrame:
    rows = intake.intake_of(t.resume_texts, "doc_id", "text", "kind", "2024-01-20 00:00:00")
    return rows.select("seq", "name", "phone", "gender", "address", F.date_format("date_of_birth", "yyyy-MM-dd").alias("born"), "email", "experience_level", "error")


@query("c11_split_cover_letter")
def _(t: Tables) -> DataFrame:
    return r.split_cover_letter(t.raw(DOC), "doc_id", "text")


@query("c17_resume_prompt_text", """SELECT candidate_id, '## Resume Summary' || chr(10) || '- Original job role text: ' || experience_level || chr(10) || '- Final education: ' || chr(10) || '- Desired location: ' || chr(10) || '- Desired salary: [phone]' || chr(10) || chr(10) || '## Career' || chr(10) || '- Period: ' || chr(10) || '- Company: ' || coalesce(CASE WHEN email IS NOT NULL THEN '[email]' END, '') || chr(10) || '- Role: ' || chr(10) || chr(10) || '### Experience' || chr(10) ||
 CASE WHEN candidate_id % 2 = 0 THEN '- Item 1: {"company":"C' || candidate_id || '"}' || chr(10) || '- Item 2: {"company":"D"}' ELSE '- Not extracted.' END AS prompt FROM candidates""")
def _(t: Tables) -> DataFrame:
    rows = F.when(F.col("candidate_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("C"), F.col("candidate_id").cast("string")).alias("company")), F.struct(F.lit("D").alias("company"))))
    return t.candidates.select("candidate_id", r.prompt_text({"originalJobRole": F.col("experience_level"), "desired_salary": F.lit("010-1234-5678"), "careerCompany": F.col("email")}, {"Experience": rows}).alias("prompt"))


FOCUS = r.FOCUS.replace("'", "''").replace("\n", "' || chr(10) || '")


@query("c17_resume_context", f"""SELECT candidate_id, '# Resume Context' || chr(10) || chr(10) || '## Target Position' || chr(10) || '- ' || coalesce(position_name, 'Not provided') || chr(10) || chr(10) || '## Resume Metadata' || chr(10) || '- Desired location: Not provided' || chr(10) || '- Desired salary: ' || candidate_id || chr(10) || chr(10) ||
 CASE candidate_id % 3 WHEN 0 THEN '## Summary' || chr(10) || 'Good' || chr(10) || chr(10) || '## Parsed Resume JSON' || chr(10) || '{{"level": "' || experience_level || '"}}' WHEN 1 THEN '## Raw Resume Text' || chr(10) || 'first line' || chr(10) || 'reach [email]' ELSE '## Resume Content' || chr(10) || '- No parsed resume content is stored.' END || chr(10) || chr(10) || '{FOCUS}' AS context
 FROM candidates LEFT JOIN positions USING (position_id)""")
def _(t: Tables) -> DataFrame:
    by = lambda n, value: F.when(F.col("candidate_id") % 3 == n, value)
    rows = t.candidates.join(t.positions.select("position_id", "position_name"), "position_id", "left").select(
        "candidate_id", "position_name", F.lit(" ").alias("desired_location"), F.col("candidate_id").alias("desired_salary"), F.lit(None).cast("string").alias("ai_profile"), by(0, F.lit(" Good ")).alias("summary"),
        by(0, F.to_json(F.struct(F.col("experience_level").alias("level"), F.col("name"), F.col("phone")))).alias("parsed_json"), F.when(F.col("candidate_id") % 3 < 2, F.lit("first line\nEmail: x@y.zz\nreach x@y.zz\nhome Address: Seoul")).alias("raw_text"),
    )
    return rows.select("candidate_id", r.resume_context().alias("context"))


@query("c20_split_job_descriptions")
def _(t: Tables) -> DataFrame:
    return r.split_job_descriptions(t.raw(DOC), "doc_id", "text")
