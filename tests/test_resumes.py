"""Resume texts and tables of cells: edge cases, the stream into candidates, and decisions as a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from staffloom.operators import people, resume_grids, resume_intake, resume_records, scheduling
from staffloom.streaming import candidates, jobs

TEXT = "성명: 김민수\n생년월일: 1990.03.12\n연락처: 010-1234-5678\nE-mail: kim@example.com\n주소: 서울시 강남구\n지원직무: 백엔드 개발\n경력사항\n2015.03~2018.02 한빛전자 펌웨어개발\n자기소개서\n1. 지원동기\n" + "배우는 사람입니다. " * 30 + "\n학력사항\n한국대학교 컴퓨터공학과 졸업 (2010.03~2014.02)"
OTHER = TEXT.replace("김민수", "이서연").replace("5678", "0000").replace("kim@", "lee@")


def test_records_of_null_empty_and_long_texts(spark):
    rows = [(1, None, "pdf"), (2, "", "hwp"), (3, "x" * 50_000 + "\n" + TEXT, "text"), (4, "학교\n대학\n(주)\n2020.01~2021.02", None), (3, TEXT, "text")]
    out = resume_records.parse_resumes(spark.createDataFrame(rows, "id long, text string, kind string"), "id", "text", "kind").collect()
    by = {(r.id, r.fileType): r for r in out}
    assert len(out) == 5 and by[1, "PDF"].name == "" == by[2, "HWP"].careerPeriod and by[1, "PDF"].finalEducation == "기타" and by[2, "HWP"].militaryRows == []
    assert {(r.name, r.finalEducation, r.careerCompany) for r in out if r.id == 3} == {("김민수", "한국대학교 컴퓨터공학과 졸업 (2010.03~2014.02)", "한빛전자")}
    assert by[4, None].careerPeriod == ""  # what surrounds the range speaks of education
    assert resume_records.parse_resumes(spark.createDataFrame([], "id long, text string, kind string"), "id", "text", "kind").count() == 0


def test_a_graduate_school_counts_less_and_exemptions_are_checked(spark):
    text = "미래대학원 경영학과 졸업 2015.03~2017.02\n\n\n\n\n한국대학교 전자공학과 졸업 2009.03~2013.02\n병역사항\n면제 사유: 질병 4급\n어학"
    r = spark.createDataFrame([(text,)], "t string").select(resume_records.final_education(F.col("t")).alias("e"), resume_records.military_rows(F.col("t")).alias("m")).first()
    assert r.e.value == "한국대학교 전자공학과 졸업 (2009.03~2013.02)" and [(m.type, m.exemption_reason) for m in r.m] == [("면제", "질병 4급")]
    rows = spark.createDataFrame([("종교 기독교",), ("자기소개서",), ("氠瑢",), ("자기소개서: 신체 등급",)], "t string").select(resume_records.clean_reason(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == ["기독교", None, None, "신체 등급"]


def test_grids_with_nulls_and_odd_tables(spark):
    tables = [(1, None), (2, []), (3, [[], [[]], [["성명", None, " 홍길동 "]]]), (4, [[["회사명", "재직기간"], ["가나", "2015.03~2016.02", "남는 칸"], ["다라"]], [["이름"], ["박지훈"]]])]
    out = {r.id: r for r in resume_grids.grid_records(spark.createDataFrame(tables, "id long, t array<array<array<string>>>"), "id", "t").collect()}
    assert out[1].name == out[2].name == "" and out[1].careers == [] and out[3].name == "홍길동" and out[4].name == "박지훈"
    assert [tuple(e) for e in out[4].careers] == [("2015.03~2016.02", "가나", "")]


def test_stream_of_resumes_ends_in_candidates(spark, tmp_path):
    fields = "candidate_id long, name string, phone string, gender string, address string, date_of_birth date, email string, position_id long, experience_level string, meets_preferred_criteria array<string>"
    existing = spark.createDataFrame([(7, "김민수", "010-1234-5678", None, None, None, None, 3, "신입", [])], fields)
    for part in ([(1, TEXT, "text")], [(2, OTHER, "pdf"), (3, "nothing here", "text")]):
        spark.createDataFrame(part, "id long, text string, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    read = lambda b: resume_intake.intake_of(b, "id", "text", "kind", "2024-01-01 00:00:00")
    candidates.stream_candidates(stream, read, existing, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(300)
    found = {r.name: r for r in candidates.current_candidates(spark, str(tmp_path / "out")).collect()}
    assert {n: (r.candidate_id, r.email, r.position_id, r.experience_level) for n, r in found.items()} == {"김민수": (7, "kim@example.com", 3, "경력"), "이서연": (8, "lee@example.com", None, "경력")}
    assert spark.read.parquet(str(tmp_path / "out/errors")).count() == 1
    once = people.upsert_candidates(existing, read(spark.read.parquet(str(tmp_path / "in"))).where("error IS NULL"))
    assert {(r.candidate_id, r.name) for r in once.collect()} == {(7, "김민수"), (8, "이서연")}


def test_decisions_as_a_stream(spark, tmp_path):
    rows = [("a", 1, datetime(2024, 1, 1), " Accepted "), ("a", 2, datetime(2024, 1, 2), "declined"), ("a", 3, datetime(2024, 1, 3), "maybe"), ("b", 4, datetime(2024, 1, 1), "ACCEPTED")]
    schema = "token string, seq long, decided_at timestamp_ntz, decision string"
    for row in rows:
        spark.createDataFrame([row], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: dict = {}
    jobs.latest_decision(stream).writeStream.outputMode("update").foreachBatch(lambda b, _: seen.update({r.token: r.decision for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    assert seen == {r.token: r.decision for r in jobs.latest_decision(spark.createDataFrame(rows, schema)).collect()} == {"a": "declined", "b": "accepted"}


def test_admission_gives_the_reasons_of_a_replay_in_order(spark):
    import random

    rng = random.Random(4)
    now = "2024-01-01 00:00:00"
    slots = [(i, 1, "1차", datetime(2024, 2, 1 + i % 5), datetime(2024, 2, 1 + i % 5, 1), None, "r", 1 + i % 2, "open") for i in range(1, 5)]
    people_ = [(i, 1) for i in range(1, 21)]
    requests = [(n, rng.randrange(1, 6), rng.randrange(1, 23)) for n in range(60)]
    slot_frame = spark.createDataFrame(slots, "slot_id long, position_id long, interview_round string, interview_starts_at timestamp_ntz, interview_ends_at timestamp_ntz, booking_deadline_at timestamp_ntz, interview_location string, capacity int, slot_status string")
    bookings = spark.createDataFrame([(1, 1, 3, datetime(2023, 1, 1), None)], "booking_id long, slot_id long, candidate_id long, created_at timestamp_ntz, cancelled_at timestamp_ntz")
    out = scheduling.admit_bookings(spark.createDataFrame(requests, "request_no long, slot_id long, candidate_id long"), spark.createDataFrame(people_, "candidate_id long, position_id long"), slot_frame, bookings, now, lambda df: spark.createDataFrame(df.collect(), df.schema))
    left, booked, want = {s[0]: s[7] for s in slots}, {3}, {}
    left[1] -= 1
    full = {s for s, n in left.items() if n <= 0}
    for no, slot, who in requests:
        if who > 20:
            want[no] = "unknown_candidate"
        elif who == 3:
            want[no] = "already_booked"
        elif slot not in left:
            want[no] = "unknown_slot"
        elif slot in full:
            want[no] = "full"
        elif who in booked:
            want[no] = "already_booked"
        elif left[slot] <= 0:
            want[no] = "full"
        else:
            want[no] = "admitted"
            left[slot] -= 1
            booked.add(who)
    assert {r.request_no: r.decision for r in out.collect()} == want
