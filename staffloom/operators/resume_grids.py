"""Records from tables of cells: labels with their values, and tables of education, careers and qualifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffloom.functions import text as x
from staffloom.functions.text import once
from staffloom.operators.resume_records import DATE_RANGE, EDU_SKIP, GRADUATION, SCHOOL, YEAR_MONTH, any_of, best, candidate, cell_service, education_score, education_text, first_of, messy_school, education_parts, slash_service
from staffloom.operators.resume_text import LANDLINE, MOBILE, education_level, found, is_header_line, period_of

# Labels without white space in lower case, and marks of a photo's cell.
LABELS = {"name": ["성명", "이름", "name"], "phone": ["연락처", "휴대폰", "핸드폰", "mobile", "전화번호", "모바일", "휴대전화"], "address": ["주소", "거주지", "address"], "email": ["email", "e-mail", "이메일"], "birth": ["생년월일", "생년", "birthdate"]}
PHOTO = ["사진", "사  진", "사 진", "photo", "Photo"]
VALUES = {"name": r"([가-힣]{2,5})", "address": r"^(.*)$", "email": r"([a-zA-Z0-9._%+\-가-힣]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "birth": r"(\d{4}[.\-/]\d{2}[.\-/]\d{2})"}
# Words of the headers of each kind of table, and of their columns.
HEADERS = {
    "education": ["학교명", "재학기간", "학력구분", "전공", "졸업구분", "학력", "기간", "학과명"],
    "career": ["회사명", "재직기간", "담당", "직무", "경력", "업무", "재직부서"],
    "qualification": ["자격증", "자격명", "자격종류", "자격사항", "취득일", "합격일", "발행처", "certificate", "certification", "credential", "qualification", "license", "등급", "종류"],
}
CERTIFICATE = ["certification", "certificate name", "certificate", "qualification name", "qualification", "credential", "license name", "license", "자격증명", "자격증", "자격명", "자격종류", "합격종목", "종목"]
ISSUER = ["발행처", "발급처", "발급기관", "기관", "organization", "issuer", "issued by"]
ISSUED = ["취득일", "합격일", "발급일", "issue date", "date acquired", "acquired", "취득"]
NUMBER = ["자격증번호", "증서번호", "certificate number", "license number", "등록번호", "관리번호"]
CAREER_HEADERS = ["회사명", "재직기간", "담당", "직무", "경력", "업무", "재직부서", "부서", "직위", "직급", "기간", "회사", "기관명", "구분", "활동기간"]
MAX_GRID_ROWS = 50


def without_merged(tables: Column) -> Column:
    """Cells of one line, stripped; of neighbours that a merged cell repeats one stays."""
    plain = lambda c: x.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " "))
    kept = lambda row: once(F.transform(row, plain), lambda cells: F.filter(cells, lambda c, i: (i == 0) | (c != F.get(cells, i - 1))))
    return F.transform(tables, lambda rows: F.transform(rows, kept))


def column_of(header: Column, words: list[str]) -> Column:
    """The place of the first cell of a header in lower case with one of the words; -1 if there is none."""
    return (F.array_position(F.transform(header, lambda c: any_of(c, words)), F.lit(True)) - 1).cast("int")


def first_column(header: Column, *words: list[str]) -> Column:
    return F.coalesce(*[F.nullif(column_of(header, w), F.lit(-1)) for w in words], F.lit(-1))


def placed(header: Column, columns: dict[str, list[list[str]]], f: Callable[[Column], Column]) -> Column:
    """``f`` of the places of columns, each by its words, which are looked up once a table and not once a row."""
    return once(F.transform(header, F.lower), lambda low: once(F.struct(*[first_column(low, *words).alias(name) for name, words in columns.items()]), f))


def cell(row: Column, place: Column) -> Column:
    return F.coalesce(F.when(place >= 0, F.get(row, place)), F.lit(""))


def table_of(tables: Column, kind: str) -> Column:
    """The first table with two of a kind's words in its header; null if there is none."""
    score = lambda head: sum((head.contains(w).cast("int") for w in HEADERS[kind]), F.lit(0))
    return F.get(F.filter(tables, lambda rows: (F.size(rows) > 0) & once(F.lower(F.array_join(F.get(rows, F.lit(0)), " ")), lambda head: score(head) >= 2)), F.lit(0))


def body(rows: Column) -> Column:
    return F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))


def names_of(tables: Column) -> Column:
    """Cells without white space in lower case, as labels are told by."""
    return F.transform(tables, lambda rows: F.transform(rows, lambda row: F.transform(row, lambda c: F.lower(x.squeezed(c)))))


def label_value(tables: Column, kind: str, names: Column | None = None) -> Column:
    """The value beside the first label that has one: to the right, else below or above it, else beside those. names: the cells as labels are written, where they are known."""
    names = names_of(tables) if names is None else names
    labels = [w for words in LABELS.values() for w in words]
    noise = lambda c: (c == "") | any_of(c, PHOTO) | F.lower(x.squeezed(c)).isin(labels)
    right = lambda row, i: F.coalesce(F.slice(row, i + 2, F.greatest(F.size(row) - i - 1, F.lit(0))), F.array().cast("array<string>"))
    at = lambda row, i: F.array(F.coalesce(F.get(row, i), F.lit("")))

    def around(rows: Column, r: Column, row: Column, i: Column) -> Column:
        below, above = F.get(rows, r + 1), F.get(rows, r - 1)
        return F.struct(F.array_join(row, " ").alias("line"), F.concat(right(row, i), at(below, i), at(above, i), right(below, i), right(above, i)).alias("near"))

    named = lambda rows, own, r: once(F.get(rows, r), lambda row: F.filter(F.transform(F.get(own, r), lambda name, i: F.when(name.isin(LABELS[kind]), around(rows, r, row, i))), lambda v: v.isNotNull()))
    cells = lambda rows, t: once(F.get(names, t), lambda own: F.flatten(F.transform(F.filter(F.transform(own, lambda row, r: F.when(F.arrays_overlap(row, F.lit(LABELS[kind])), r)), lambda r: r.isNotNull()), lambda r: named(rows, own, r))))
    if kind == "phone":
        number = lambda v: F.coalesce(found(v, MOBILE), found(v, LANDLINE))
        value = lambda s: F.coalesce(number(s["line"]), number(F.get(F.filter(s["near"], lambda c: ~noise(c)), F.lit(0))))
    else:
        value = lambda s: F.get(F.filter(F.transform(F.filter(s["near"], lambda c: ~noise(c)), lambda c: F.regexp_extract(c, VALUES[kind], 1)), lambda v: v != ""), F.lit(0))
    given = F.get(F.filter(F.transform(F.flatten(F.transform(tables, cells)), value), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))
    return F.coalesce(x.strip(F.regexp_replace(given, r"(?i)\s*(?:사\s*진|photo).*$", "")) if kind == "address" else given, F.lit(""))


def period_in(row: Column, text: Column, place: Column) -> Column:
    """A row's period: its column, else a range in the row, else its first and last month."""
    own = cell(row, place)
    months = F.regexp_extract_all(text, F.lit(YEAR_MONTH), F.lit(0))
    ends = once(months, lambda m: F.when(F.size(m) > 1, F.concat(F.get(m, F.lit(0)), F.lit("~"), F.element_at(m, -1))).when(F.size(m) == 1, F.get(m, F.lit(0))))
    return F.coalesce(F.when((own != "") & ~own.isin(EDU_SKIP), own), found(text, DATE_RANGE), ends, F.lit(""))


def school_in(row: Column, text: Column, place: Column) -> Column:
    own = cell(row, place)
    named = lambda v: F.replace(F.regexp_extract(v, SCHOOL, 1), F.lit(" "), F.lit(""))
    return F.when((own == "") | own.isin(EDU_SKIP), named(text)).otherwise(F.coalesce(F.nullif(named(own), F.lit("")), own))


EDUCATION = "array<struct<school:string,department:string,level:string,period:string,location:string,grade:string,start:string,end:string>>"


def education_rows(rows: Column) -> Column:
    """Array of (school, department, level, period, location, grade, start, end) of an education table."""
    none = lambda c: F.nullif(c, F.lit(""))

    columns = {"major": [["전공", "학과명"]], "school": [["학교명", "학교"]], "period": [["재학기간", "기간"]], "level": [["학력구분", "구분"]], "location": [["소재지"]], "grade": [["학점", "평균학점"]]}

    def over(at: Column) -> Column:
        def fields(row: Column) -> Column:
            return once(F.array_join(row, " "), lambda text: once(cell(row, at["major"]), lambda major: named(row, text, major)))

        def named(row: Column, text: Column, major: Column) -> Column:
            return F.struct(
                text.alias("text"), school_in(row, text, at["school"]).alias("school"), F.when(~major.isin(EDU_SKIP), major).otherwise("").alias("major"), period_in(row, text, at["period"]).alias("period"),
                cell(row, at["level"]).alias("level"), cell(row, at["location"]).alias("location"), cell(row, at["grade"]).alias("grade"),
            )

        def made(f: Column) -> Column:
            plain = lambda ends: F.struct(none(f["school"]).alias("school"), none(f["major"]).alias("department"), education_level(f["school"], f["major"], none(f["level"]), f["text"]).alias("level"), none(f["period"]).alias("period"), none(f["location"]).alias("location"), none(f["grade"]).alias("grade"), ends["start"].alias("start"), ends["end"].alias("end"))
            whole = once(period_of(f["period"], f["text"]), plain)
            merged = F.concat_ws(" ", none(f["school"]), none(f["major"]), none(f["period"]))
            finer = lambda s: F.struct(F.coalesce(s["school"], f["school"]).alias("school"), F.coalesce(s["department"], none(f["major"])).alias("department"), s["level"].alias("level"), F.coalesce(s["period"], none(f["period"])).alias("period"), none(f["location"]).alias("location"), none(f["grade"]).alias("grade"), s["start"].alias("start"), s["end"].alias("end"))
            return F.when(messy_school(f["school"]), once(education_parts(merged), finer)).otherwise(whole)

        some = F.filter(body(rows), lambda row: any_of(F.array_join(row, " "), ["대학교", "대학원", "대학", "고등학교"]))
        return F.transform(F.transform(some, fields), made)

    return F.coalesce(placed(F.get(rows, F.lit(0)), columns, over), F.array().cast(EDUCATION))


def grid_education(rows: Column) -> Column:
    """struct(value, period) of the best row of an education table."""
    columns = {"major": [["전공", "학과명"]], "status": [["졸업구분"]], "school": [["학교명", "학교"]], "period": [["재학기간", "기간"]]}

    def over(at: Column) -> Column:
        def of(row: Column, i: Column) -> Column:
            return once(F.struct(F.array_join(row, " ").alias("text"), row.alias("row")), lambda r: made(r["row"], r["text"], i))

        def made(row: Column, text: Column, i: Column) -> Column:
            major, state = cell(row, at["major"]), cell(row, at["status"])
            status = F.coalesce(F.when((state != "") & (state != "-") & ~state.isin(EDU_SKIP) & ~state.rlike(YEAR_MONTH), state), first_of(text, GRADUATION), F.lit(""))
            parts = F.struct(school_in(row, text, at["school"]).alias("school"), F.when(~major.isin(EDU_SKIP), major).otherwise("").alias("major"), status.alias("status"), period_in(row, text, at["period"]).alias("period"))
            return once(parts, lambda p: candidate(any_of(text, ["대학교", "대학원", "대학"]) & (p["period"] != ""), education_score(p["school"], p["major"], p["status"]), i, education_text(p["school"], p["major"], p["status"], p["period"]), p["period"]))

        return best(F.transform(body(rows), of))

    none = F.struct(F.lit("").alias("value"), F.lit("").alias("period"))
    return F.coalesce(once(F.get(rows, F.lit(0)), lambda h: F.when(h.isNotNull(), placed(h, columns, over))), none)


def grid_careers(rows: Column) -> Column:
    """Array of (period, company, job) of the rows of a career table that have a period."""

    columns = {"period": [["재직기간", "기간", "활동기간"]], "company": [["회사명", "회사", "기관명"]], "job": [["직무", "담당"], ["업무"], ["부서", "재직부서"], ["직위", "직급"]]}

    def over(at: Column) -> Column:
        def of(row: Column) -> Column:
            own = cell(row, at["period"])
            period = F.coalesce(F.when(own.rlike(r"\d{4}") & ~own.isin(EDU_SKIP), own), found(F.array_join(row, " "), DATE_RANGE))
            value = lambda name: once(cell(row, at[name]), lambda v: F.when(v.isin(CAREER_HEADERS), "").otherwise(v))
            job = once(value("job"), lambda v: F.when(F.char_length(v) > 60, F.concat(F.substring(v, 1, 60), F.lit("…"))).otherwise(v))
            return F.struct(period.alias("period"), value("company").alias("company"), job.alias("job"))

        return F.filter(F.transform(body(rows), of), lambda e: e["period"].isNotNull())

    return F.coalesce(placed(F.get(rows, F.lit(0)), columns, over), F.array().cast("array<struct<period:string,company:string,job:string>>"))


QUALIFICATION = "array<struct<certificate:string,organization:string,issued:string,number:string>>"


def dated_rows(rows: Column) -> Column:
    """The rows of a table without header that begin with a month and a name."""
    return F.filter(rows, lambda row: (F.size(row) > 1) & F.get(row, F.lit(0)).rlike(r"^(20\d{2})\.(\d{1,2})$") & (F.get(row, F.lit(1)) != "") & ~is_header_line(F.get(row, F.lit(1))))


def qualification_row(certificate: Column, organization: Column, date: Column, number: Column) -> Column:
    pattern = r"(20\d{2})[.\-/년]\s*(\d{1,2})"
    issued = F.when(date.rlike(pattern), F.concat_ws("-", F.regexp_extract(date, pattern, 1), F.lpad(F.regexp_extract(date, pattern, 2), 2, "0"), F.lit("01")))
    return F.struct(F.substring(certificate, 1, 500).alias("certificate"), F.nullif(organization, F.lit("")).alias("organization"), issued.alias("issued"), F.nullif(number, F.lit("")).alias("number"))


def grid_qualifications(tables: Column) -> Column:
    """Array of (certificate, organization, issued, number), at most 50: of the table with such a header, else of the one with most rows that begin with a month."""

    def with_header(rows: Column) -> Column:
        def over(header: Column, at: Column) -> Column:
            short = F.get(header, F.lit(0))
            second = (F.size(header) > 1) & (any_of(F.lower(short), ["no", "#", "연번", "순번", "번호", "□"]) | (F.char_length(short) <= 2))
            row = lambda r, place: qualification_row(cell(r, place), cell(r, at["issuer"]), cell(r, at["issued"]), cell(r, at["number"]))
            return once(F.when(at["named"] >= 0, at["named"]).when(second, 1).otherwise(0), lambda place: F.transform(F.filter(body(rows), lambda r: (cell(r, place) != "") & ~is_header_line(cell(r, place))), lambda r: row(r, place)))

        return once(F.get(rows, F.lit(0)), lambda header: placed(header, {"named": [CERTIFICATE], "issuer": [ISSUER], "issued": [ISSUED], "number": [NUMBER]}, lambda at: over(header, at)))

    headless = lambda rows: F.transform(dated_rows(rows), lambda r: qualification_row(F.get(r, F.lit(1)), cell(r, F.lit(2)), F.get(r, F.lit(0)), F.lit("")))
    counted = F.filter(F.transform(tables, lambda rows, i: F.struct(F.size(dated_rows(rows)).alias("n"), (-i).alias("i"), rows.alias("rows"))), lambda c: c["n"] >= 2)
    most = F.element_at(F.array_sort(F.transform(counted, lambda c: F.struct(c["n"].alias("n"), c["i"].alias("i"), c["rows"].alias("rows")))), -1)["rows"]
    chosen = once(table_of(tables, "qualification"), lambda rows: F.when(rows.isNotNull(), with_header(rows)).otherwise(F.when(F.size(counted) > 0, headless(most))))
    return F.slice(F.coalesce(chosen, F.array().cast(QUALIFICATION)), 1, MAX_GRID_ROWS)


def row_service(row: Column) -> Column:
    """The first that the cells of a row say of military service: the cell beside 병역, the cells from 병역구분 on, or a cell with slashes and a year."""
    size = F.size(row)

    def told(c: Column, i: Column) -> Column:
        name = x.squeezed(c)
        slashed = once(F.when(c.contains("/") & c.rlike(r"\d{4}"), slash_service(x.strip(c))), lambda r: F.when(F.coalesce(r["service"], r["start"], r["type"]).isNotNull(), r))
        rest = F.array_join(F.filter(F.transform(F.slice(row, i + 1, size - i), x.strip), lambda v: v != ""), "/")
        return F.coalesce(F.when((name == "병역") & (i + 1 < size), cell_service(F.get(row, i + 1))), F.when((name == "병역구분") & (i + 1 < size), slash_service(rest)), slashed)

    return F.get(F.filter(F.transform(row, told), lambda r: r.isNotNull()), F.lit(0))


def grid_service(tables: Column) -> Column:
    """Rows of military service by table and row: by the columns of a table of it, by what the row's cells say, by cells with slashes; equal ones once."""
    def of(rows: Column) -> Column:
        header, words = F.get(rows, F.lit(0)), ("병역구분", "복무기간", "군별", "계급")
        has = any_of(x.squeezed(F.array_join(header, "")), ["병역", "군별", "계급"])

        def said(row: Column) -> Column:
            joined = lambda at: slash_service(F.array_join(F.filter(F.array(*[cell(row, at[w]) for w in words]), lambda v: v != ""), "/"))
            by_column = once(F.array_join(row, "|"), lambda line: F.when(line.contains("/") & line.rlike(r"\d{4}") & has, placed(F.transform(header, x.squeezed), {w: [[w]] for w in words}, joined)))
            slashed = F.transform(F.filter(row, lambda c: c.contains("/") & c.rlike(r"\d{4}") & c.rlike("육군|해군|공군|해병|군필|필")), slash_service)
            return F.concat(F.array(by_column, row_service(row)), slashed)

        return F.flatten(F.transform(F.when(has & (F.size(rows) > 1), F.slice(rows, 2, F.size(rows))).otherwise(rows), said))

    sign = lambda r: F.to_json(F.struct(r["type"], r["service"], r["start"], r["end"]))
    found = F.filter(F.flatten(F.transform(F.filter(tables, lambda rows: F.size(rows) > 0), of)), lambda r: r.isNotNull())
    return once(found, lambda rows: once(F.transform(rows, sign), lambda signs: F.filter(rows, lambda r, i: F.array_position(signs, F.get(signs, i)) == i + 1)))


def grid_records(docs: DataFrame, key: str, tables: str) -> DataFrame:
    """A row per document from its tables (tables of rows of cells): labelled values, best education, and rows of each kind; null tables give an empty record."""
    rows = docs.select(F.col(key), without_merged(F.coalesce(x.nfc_cells(F.col(tables)), F.array().cast("array<array<array<string>>>"))).alias("_t"))
    rows = rows.withColumns({"_n": names_of(F.col("_t")), "_e": table_of(F.col("_t"), "education"), "_c": table_of(F.col("_t"), "career")})
    return rows.select(
        key, *[label_value(F.col("_t"), kind, F.col("_n")).alias(kind) for kind in LABELS], grid_education(F.col("_e"))["value"].alias("finalEducation"), education_rows(F.col("_e")).alias("educationRows"), grid_careers(F.col("_c")).alias("careers"),
        grid_qualifications(F.col("_t")).alias("qualificationRows"), grid_service(F.col("_t")).alias("militaryRows"),
    )
