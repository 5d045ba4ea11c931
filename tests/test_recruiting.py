"""Rules that are easy to get wrong, on hand-built rows; and randomised checks against plain Python."""

from __future__ import annotations

import random
from datetime import datetime
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from staffloom.functions import text as x
from staffloom.operators import matching, people, questions, resume_text, scheduling, vectors
from staffloom.sources import files
from staffloom.sources.tables import saved
from staffloom.streaming import jobs


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("now", "status"), [("09:00", "응시 전"), ("10:30", "응시 중"), ("11:00", "응시 완료")])
def test_attendance_status(spark, now, status):
    at = lambda t: F.expr(f"timestamp_ntz'2026-05-18 {t}:00'")
    assert spark.range(1).select(scheduling.attendance_status(at(now), at("10:00"), at("11:00"))).first()[0] == status
    assert spark.range(1).select(scheduling.time_label(at("10:05"), at("11:45"))).first()[0] == "10:05 - 11:45"


@pytest.mark.parametrize(("raw", "clean"), [(" x ", "x"), ("N / A", None), ("없 음", None), ("", None), (None, None), ("　y", "y")])
def test_clean(spark, raw, clean):
    assert one(spark, raw, x.clean) == clean


def test_money_dates_and_emails(spark):
    rows = spark.createDataFrame([(None, "3,500 만원"), (40, "만"), (0, "9"), (None, "없음"), (200000, "만")], "a long, r string")
    assert [r[0] for r in rows.select(x.money_amount(F.col("a"), F.col("r"))).collect()] == [35000000, 400000, None, None, 200000]
    assert str(one(spark, "1999. 3. 7 생", x.parse_date)) == "1999-03-07" and one(spark, "2020.13.01", x.parse_date) is None
    assert one(spark, " a@b.c ", x.valid_email) == "a@b.c" and one(spark, "a@b", x.valid_email) is None


def test_lists_keep_the_first(spark):
    df = spark.createDataFrame([([" SQL ", "sql", "", "Spark", "SQL"],)], "v array<string>")
    assert df.select(x.normalize_list(F.col("v"), fold=True)).first()[0] == ["SQL", "Spark"]
    assert df.select(x.normalize_list(F.col("v"))).first()[0] == ["SQL", "sql", "Spark"]


def test_tokens_are_restored_and_masks_applied(spark):
    text = "kim a@b.co 010-1234-5678 and 010-1234-56789 a@b.co 2020-01-02 990101-1234567"
    r = spark.createDataFrame([(text, "kim")], "t string, n string").select(x.tokenize_pii("t", "n", F.lit(None).cast("string")).alias("p")).select("p.text", x.restore_tokens(F.col("p.text"), F.col("p.tokens")).alias("back"), F.size("p.tokens").alias("n")).first()
    assert r.back == text and "a@b.co" not in r.text and "kim" not in r.text and r.text.count("__EMAIL_1__") == 2
    assert one(spark, "990101-1234567 x 2020-01-02", x.mask_pii) == "[personal-id] x [date]"
    assert one(spark, "ok\nPhone: 1\nfine", x.redact_sensitive_lines) == "ok\nfine"
    assert one(spark, '{"a":[{"name":"x","b":1}],"email":2}', x.drop_sensitive_fields) == '{"a": [{"b": 1}]}'


def test_templates(spark):
    df = spark.createDataFrame([("Hi {a}, {{x}} {b}",), ("{zz}",), ("{a",)], "t string")
    values = F.create_map(F.lit("a"), F.lit("A"), F.lit("b"), F.lit(None).cast("string"))
    assert [tuple(r[0]) for r in df.select(x.render_template(F.col("t"), values)).collect()] == [("Hi A, {x} ", None), (None, "missing: zz"), (None, "malformed")]


def test_json_in_text(spark):
    assert one(spark, 'say {"a": 1} end', x.first_json_object) == '{"a": 1}' and one(spark, "none", x.first_json_object) == "{}"
    r = one(spark, '{"summary": " ", "parsed_json": {"skills": ["a"]}}', files.parse_resume_json)
    assert r.error is None and r.value.summary is None and r.value.parsed_json.skills == ["a"]
    assert one(spark, "{", files.parse_resume_json).error


def test_periods_and_education(spark):
    period = lambda v: tuple(one(spark, v, resume_text.parse_period))
    assert period("2020.03 ~ 현재") == ("2020.03", None) and period("2020.03-2021.04") == ("2020.03", "2021.04")
    assert period("2019년 3월부터 2020년 12월") == ("2019.03", "2020.12") and period("x") == (None, None)
    level = lambda s: spark.createDataFrame([(s,)], "s string").select(resume_text.education_level(F.col("s"), F.lit(None), F.lit(None), F.lit(None))).first()[0]
    assert [level(s) for s in ("서울고등학교", "한국대학교", "한국대학교 대학원", "석사", "Ph.D.", "한국대학", "x")] == ["고등학교", "학사", resume_text.UNCLEAR_GRADUATE, "석사", "박사", "학사", None]


def test_basic_fields_of_a_korean_resume(spark):
    text = "성 명 : 홍길동\n생년월일 1990.01.02\n연락처 010-1234-5678\n이메일 홍@ex.co.kr\n주소: 서울시 강남구\n지원직무: 백엔드 개발\n"
    assert tuple(one(spark, text, resume_text.extract_basic)) == ("홍길동", "1990.01.02", "010-1234-5678", "홍@ex.co.kr", "서울시 강남구", "백엔드 개발")


def test_job_descriptions(spark):
    doc = "# 1. All\ncommon\n# 3. Jobs\nintro\n## 3.1 Backend\nbody a\n## 3.2 Data \nbody b\n# 4. Guide\nask\n## 3.9 not a section"
    rows = {(r.kind, r.number, r.title, r.body) for r in resume_text.split_job_descriptions(spark.createDataFrame([(1, doc)], "id int, t string"), "id", "t").collect()}
    assert ("common", None, None, "# 1. All\ncommon") in rows and ("section", 1, "Backend", "## 3.1 Backend\nbody a") in rows
    assert ("section", 2, "Data", "## 3.2 Data \nbody b") in rows and len(rows) == 4


def test_position_match(spark):
    positions = spark.createDataFrame([(1, "Backend Developer"), (2, "서버 개발"), (3, "AI Engineer")], "position_id long, position_name string")
    texts = spark.createDataFrame([(1, "backend developer"), (2, "server"), (3, None), (4, "zzz"), (5, "AI Engineer, x")], "id long, text string")
    out = {r.id: (r.status, r.matched_position_id, r.score) for r in matching.match_positions(texts, positions).collect()}
    assert out == {1: ("matched", 1, 100), 2: ("ambiguous", None, 80), 3: ("notProvided", None, None), 4: ("noMatch", None, None), 5: ("matched", 3, 100)}
    fields = spark.createDataFrame([(1, ["-", "zzz", "Backend Developer"]), (2, ["x", "y", "AI Engineer"])], "id long, fields array<string>")
    out = {r.id: (r.status, r.score) for r in matching.match_resume_positions(fields, positions).collect()}
    assert out == {1: ("matched", 90), 2: ("lowConfidence", 75)}  # a blank first field promotes the next ones


def test_category_other_is_kept(spark):
    df = spark.createDataFrame([(1, "백엔드 개발"), (2, "Zoo")], "position_id long, position_name string")
    assert [r.category for r in matching.category_groups(df).collect()] == ["development", "other"]


def test_duplicates_match_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "", "c"]), rng.choice(["1", "2", "", None]), rng.choice(["x@y", "z@y", None])) for i in range(60)]
    out = {r.candidate_id: r.is_duplicate for r in people.duplicate_candidates(spark.createDataFrame(rows, "candidate_id long, name string, phone string, email string")).collect()}
    hit = set()
    for a, b in combinations(rows, 2):
        if sum(bool(p) and p == q for p, q in zip(a[1:], b[1:], strict=True)) >= 2:
            hit |= {a[0], b[0]}
    assert {i for i, d in out.items() if d} == hit


def test_employment_months_match_month_sets(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for i in range(200):
        c, a = i % 20, rng.randrange(24000, 24060)
        b = a + rng.randrange(-2, 14)
        text = lambda m: f"{(m - 1) // 12}-{(m - 1) % 12 + 1:02d}"
        kind = rng.choice(["정규직", "인턴", "International"])
        rows.append((c, rng.choice(["Co", "-"]), kind, "dev", text(a), "present" if i % 17 == 0 else text(b)))
        if rows[-1][1] == "Co" and kind == "정규직":
            expected.setdefault(c, set()).update(range(a, min(24072 if i % 17 == 0 else b, 24072) + 1))
    out = {r.candidate_id: r.months for r in people.employment_months(spark.createDataFrame(rows, "candidate_id long, company_name string, employment_type string, position string, start_date string, end_date string"), "2005-12-15 00:00:00").collect()}
    assert out == {c: len(m) for c, m in expected.items() if m}


@pytest.mark.parametrize("tail", [0, 20, 10_000])
def test_admission_matches_replay(spark, tail):
    rng = random.Random(4)
    t = datetime(2030, 1, 1)
    slots = [(s, 1, "open", t, None, rng.randrange(1, 4)) for s in range(12)]
    requests = [(n, rng.randrange(12), rng.randrange(40)) for n in range(150)]
    frames = (
        spark.createDataFrame(requests, "request_no long, slot_id long, candidate_id long"), spark.createDataFrame([(c, 1) for c in range(38)], "candidate_id long, position_id long"),
        spark.createDataFrame(slots, "slot_id long, position_id long, slot_status string, interview_starts_at timestamp_ntz, booking_deadline_at timestamp_ntz, capacity int"), spark.createDataFrame([(1, 0, 3, None)], "booking_id long, slot_id long, candidate_id long, cancelled_at timestamp_ntz"),
    )
    out = {r.request_no: r.decision for r in scheduling.admit_bookings(*frames, "2029-01-01 00:00:00", lambda df: saved(df, f"t-{random.random()}"), tail).collect()}
    used, booked, expected = {0: 1}, {3}, {}
    room = {s[0]: s[5] for s in slots}
    for n, s, c in sorted(requests):
        static = "unknown_candidate" if c >= 38 else "already_booked" if c == 3 else "full" if s == 0 and room[0] <= 1 else None
        if static or c in booked or used.get(s, 0) >= room[s]:
            expected[n] = static or ("already_booked" if c in booked else "full")
        else:
            expected[n] = "admitted"
            booked.add(c)
            used[s] = used.get(s, 0) + 1
    assert {n: d == "admitted" for n, d in out.items()} == {n: d == "admitted" for n, d in expected.items()}


def test_conflicts_match_a_plain_join(spark):
    rng = random.Random(5)
    stamp = lambda m: datetime(2024, 1, 1 + m // 1440, m % 1440 // 60, m % 60)
    make = lambda n: [(i, rng.randrange(4), (s := rng.randrange(4000)), s + rng.randrange(1, 2000)) for i in range(n)]
    slots, requests = make(60), make(40)
    sl = spark.createDataFrame([(i, stamp(a), stamp(b)) for i, _, a, b in slots], "slot_id long, interview_starts_at timestamp_ntz, interview_ends_at timestamp_ntz")
    bridge = spark.createDataFrame([(i, v) for i, v, *_ in slots], "slot_id long, interviewer_id long")
    rq = spark.createDataFrame([(0, i, v, stamp(a), stamp(b)) for i, v, a, b in requests], "batch_id long, request_no long, interviewer_id long, starts_at timestamp_ntz, ends_at timestamp_ntz")
    out = {(r.request_no, r.conflict_slot_id) for r in scheduling.interviewer_conflicts(rq, sl, bridge).collect()}
    assert out == {(i, j) for i, v, a, b in requests for j, w, c, d in slots if v == w and c < b and d > a}


def test_new_questions_wildcards(spark):
    stored = spark.createDataFrame([(1, 5, "t", " q1 "), (None, 6, "t", "q2")], "candidate_id long, position_id long, question_type string, question_text string")
    batch = spark.createDataFrame([(1, None, 5, "q1", "t"), (2, None, None, "q2", "t"), (3, None, 7, "q1", "t"), (4, None, 7, " q1", "t"), (5, 2, None, "q3", None)], "seq long, candidate_id long, position_id long, question_text string, question_type string")
    out = questions.new_questions(batch, stored, spark.createDataFrame([(2, 9)], "candidate_id long, position_id long")).collect()
    assert {r.seq for r in out} == {3, 5} and {r.question_type for r in out if r.seq == 5} == {questions.JOB_FIT}


def test_upsert_rules(spark):
    cols = "name string, phone string, date_of_birth date, email string, position_id long, experience_level string, meets_preferred_criteria array<string>"
    old = spark.createDataFrame([(1, "Kim", "1", None, None, None, "신입", []), (2, "Kim", "1", None, "k@x", 3, "신입", [])], f"candidate_id long, {cols}")
    new = spark.createDataFrame([(1, "Kim", "1", None, "a@x", 4, "경력", ["a"]), (2, "Kim", "1", None, "b@x", 5, "신입", ["b"]), (3, "Lee", None, None, None, None, "신입", []), (4, "Lee", None, None, None, None, "신입", [])], f"seq long, {cols}")
    out = {r.candidate_id: r for r in people.upsert_candidates(old, new).collect()}
    assert set(out) == {1, 2, 3, 4} and (out[1].email, out[1].position_id, out[1].experience_level, out[1].meets_preferred_criteria) == ("a@x", 4, "신입", ["b"])


def test_chunks():
    text = "\n\n".join(["word " * 60, "x" * 1300, "short one", "tail " * 30])
    out = vectors.chunks(text)
    assert all(0 < len(c) <= 500 for c in out) and "".join("".join(out).split()).count("x") >= 1300
    assert vectors.chunks("") == [] and vectors.chunks("a b") == ["a b"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("안녕\r\n\r\n\r\n\r\nx  y".encode("cp949"))
    (tmp_path / "b.md").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "c.txt").write_bytes(b" \n")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    out = {r.path[-5:]: (r.text, r.error) for r in files.read_resume_text(spark, str(tmp_path)).collect()}
    assert out == {"a.txt": ("안녕\n\nx y", None), "/b.md": ("hello", None), "c.txt": (None, "empty file"), "d.pdf": (None, "unsupported file type")}
    files.write_csv_export(spark.createDataFrame([("a\"b", None)], "p string, q string").coalesce(1), {"p": "이름", "q": "Q"}, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")) == '"이름","Q"\n"a""b",""\n'


def test_streams_match_batch(spark, tmp_path):
    rows = [(i % 3, i, datetime(2024, 1, 1, i), s) for i, s in enumerate(["queued", "queued", "running", "running", "failed", "succeeded", "succeeded", "running"])]
    schema = "job_id long, seq long, ts timestamp_ntz, status string"
    for n, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del n
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict = {}

    def keep(batch, _):
        seen.update({r.job_id: r.status for r in batch.collect()})

    jobs_out = jobs.stream_job_status(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    jobs_out.awaitTermination(120)
    assert seen == {r.job_id: r.status for r in jobs.job_status(spark.createDataFrame(rows, schema)).collect()}
    texts = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = jobs.stream_resume_intake(texts, lambda b: b.withColumn("error", F.when(F.col("status") == "failed", "bad")), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/parsed")).count() == 7 and spark.read.parquet(str(tmp_path / "out/errors")).count() == 1


def test_profile_scalars(spark):
    text = "성별: 여성\n보훈 여부: 비대상 | x\n장애인(등급): 해당없음\n희망 근무지: 서울 본사 취미/특기 독서\n희망 연봉: 4,000만원\n시스템 장애: 복구"
    assert tuple(one(spark, text, resume_text.extract_profile_scalars)) == ("여", "해당없음", "비대상", "서울 본사", "4,000만원")
    assert tuple(one(spark, "보훈: 대상 여부\n", resume_text.extract_profile_scalars)) == (None,) * 5


def test_cover_letters(spark):
    rows = [(1, "intro\n1. 지원 동기\n1. 지원 동기\n첫 답\n둘째 줄\n■\n■ [성장 과정]\n다른 답\n2) 빈 문항 제목\n\n"), (2, "just prose without any heading"), (3, "short"), (4, None), (5, "■ 하나의 문항\n본문 하나")]
    out = resume_text.split_cover_letter(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    assert sorted((r.id, r.row_no, r.question, r.answer) for r in out if r.question) == [(1, 1, "지원 동기", "첫 답\n둘째 줄"), (1, 2, "성장 과정", "다른 답"), (5, 1, "하나의 문항", "본문 하나")]
    assert [(r.id, r.question, r.answer) for r in out if not r.question] == [(2, None, "just prose without any heading")]
