"""Resume extraction on texts and tables outside the generated shapes, expected by hand; decomposed characters as composed ones."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from staffloom.operators import resume_grids, resume_intake, resume_records

TEXT = "성명: 김민수\n생년월일: 1990.03.12\n연락처: 010-1234-5678\nE-mail: kim@example.com\n주소: 서울시 강남구\n지원직무: 백엔드 개발\n경력사항\n2015.03~2018.02 한빛전자 펌웨어개발\n학력사항\n한국대학교 컴퓨터공학과 졸업 (2010.03~2014.02)\n병역사항\n군필 육군 2012년 5월 ~ 2014년 2월"


@pytest.mark.parametrize("kind", ["text", "pdf", "hwp"])
def test_decomposed_texts_give_what_composed_ones_give(spark, kind):
    rows = [(1, TEXT, kind), (2, unicodedata.normalize("NFD", TEXT), kind)]
    assert rows[0][1] != rows[1][1]
    one, two = resume_records.parse_resumes(spark.createDataFrame(rows, "id long, text string, kind string"), "id", "text", "kind").orderBy("id").collect()
    assert one.asDict(recursive=True) | {"id": 0} == two.asDict(recursive=True) | {"id": 0} and one.name == "김민수" and "한국대학교" in one.finalEducation
    rows = resume_intake.intake_of(spark.createDataFrame(rows, "id long, text string, kind string"), "id", "text", "kind", "2024-01-01 00:00:00").orderBy("seq").collect()
    assert rows[0].name == rows[1].name == "김민수" and rows[0].experience_level == rows[1].experience_level


def test_decomposed_cells_and_blobs(spark):
    table = [[["성명", "김민수"], ["연락처", "010-1234-5678"]], [["학교명", "전공", "재학기간", "졸업구분"], ["한국대학교", "컴퓨터공학과", "2010.03~2014.02", "졸업"]], [["회사명", "재직기간", "담당업무"], ["한빛전자", "2015.03~2018.02", "펌웨어개발"]]]
    apart = [[[unicodedata.normalize("NFD", c) for c in row] for row in t] for t in table]
    apart[0][0].append(None)
    one, two = resume_grids.grid_records(spark.createDataFrame([(1, table), (2, apart)], "id long, t array<array<array<string>>>"), "id", "t").orderBy("id").collect()
    assert one.asDict(recursive=True) | {"id": 0} == two.asDict(recursive=True) | {"id": 0} and one.name == "김민수" and one.careers
    blob = "한국대학교 컴퓨터공학과 졸업 (2010.03~2014.02)"
    docs = spark.createDataFrame([(1, blob), (2, unicodedata.normalize("NFD", blob)), (3, None)], "id long, b string")
    out = {r.id: r.education for r in resume_records.split_education(docs, "id", F.col("b")).collect()}
    assert out[1] == out[2] and out[1].school == "한국대학교" and out[1].department == "컴퓨터공학과" and (out[1].start, out[1].end) == ("2010.03", "2014.02")


@pytest.mark.parametrize(
    ("blob", "school", "department", "level"),
    [
        ("서울고등학교 졸업 (1997.03~1999.02)", "서울고등학교", None, "고등학교"),
        ("한국대학교 대학원 전자공학과 수료 2015.03~2017.02", "한국대학교대학원", "전자공학과", None),
        ("경영학부 졸업", "경영학부", None, None),
        ("미래전문대학 기계과 졸업(2001.03 ~ 2003.02)", "미래전문대학", "기계과", None),
    ],
)
def test_blobs_of_other_shapes(spark, blob, school, department, level):
    out = resume_records.split_education(spark.createDataFrame([(1, blob)], "id long, b string"), "id", F.col("b")).first().education
    assert out.school == school and (department is None or out.department == department) and (level is None or out.level == level)


def test_service_in_tables_of_other_shapes(spark):
    """Each expected row worked out by the rules: which cell is the kind, which the period, what follows."""
    tables = [
        (1, [[["병역구분", "필", "2012.05 ~ 2014.02", "육군"]]]),
        (2, [[["성명", "홍길동"], ["기타", "면제 / 2012년 5월 / 질병 4급"]]]),
        (3, [[["병역구분", "복무기간", "군별", "계급"], ["필", "2012.05/2014.02", "해군", "병장"], ["", "", "", ""]]]),
        (4, [[["병 역", "만기 제대"], ["병역", "모름"]]]),
        (5, [[["병역", "군필"], ["비고", "필 / 2012.05 ~ 2014.02 / 공군 / 병장"]], [["x", "필/2012.05 ~ 2014.02/공군/병장"]]]),
        (6, [[["병역"]], [["2012/05/06", None, "3/4"]]]),
    ]
    out = {r.id: [tuple(m) for m in r.militaryRows] for r in resume_grids.grid_records(spark.createDataFrame(tables, "id long, t array<array<array<string>>>"), "id", "t").collect()}
    assert out[1] == [("병역구분", "2012.05 ~ 2014.02", None, None, "육군", None)]
    assert out[2] == [("면제", "질병 4급", "2012.05", None, None, "질병 4급")]
    assert out[3] == [("군필", "2014.02", "2012.05", None, "해군", None)]
    assert out[4] == []  # the first row is the head of a table of service
    assert out[5] == [("군필", "공군", "2012.05", "2014.02", "병장", None)]
    assert out[6] == []
