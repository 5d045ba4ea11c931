"""Education, careers and service of resume text, and whole records: column expressions over a table of texts.

Everything about a text is computed within its row by functions of arrays, so no stage shuffles but where rows are told apart.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffloom.functions import text as x
from staffloom.functions.text import once
from staffloom.operators.resume_text import MAX_QUALIFICATIONS, bad_education, education_level, extract_basic, extract_profile_scalars, found, is_header_line, parse_period, period_of, slice_section

# Schools, majors, states of graduation, date ranges.
SCHOOL = r"([가-힣]{2,}\s*(?:대학교|대학원|대학))"
SIGNS = r"[가-힣.·∙‧・•․．。･]"
MAJORS = [rf"({SIGNS}{{2,}}\s*(?:학과|학부|공학과|공학부|전공|계열))", rf"({SIGNS}{{2,}}(?:공학|과학|시스템|전자|기계|경영|경제|컴퓨터|소프트웨어|정보|통신|디자인|미디어|통계))"]
GRADUATION = ["졸업", "재학", "수료", "중퇴", "편입", "예정"]
DATE_RANGE = r"(\d{4}[.\-/]\d{1,2}\s*[~\-–—]\s*(?:\d{4}[.\-/]\d{1,2}|현재|재직|재학|중|진행))"
YEAR_MONTH = r"\d{4}[.\-]\d{1,2}"
# Words of headers that are no school, and headers cut out of a line.
EDU_SKIP = ["학력사항", "학력구분", "학교명", "전공", "재학기간", "소재지", "학점", "졸업구분", "입학", "구분", "기간", "학교", "학과명", "전공 및 학위구분", "-", "단과대학", "단과대학(학부)", "학부", "학 과", "평균학점", "연봉", "직급", "부서", "담당업무", "회사명", "기 간", "년", "월", "성명", "생년월일"]
CUT_HEADERS = ["학력사항", "학력구분", "학교명", "재학기간", "졸업구분", "학점", "소재지", "전공 및 학위구분"]
# Words around a date that speak for a career, and for education.
CAREER_WORDS = ["MCU", "펌웨어", "개발", "사원", "대리", "과장", "차장", "부장", "팀장", "엔지니어", "Engineer", "연구", "설계", "제어", "테크", "솔루션", "오토", "센서", "R&D", "시스템", "소프트웨어", "하드웨어", "매니저", "직원", "재직", "근무", "입사", "퇴사", "(주)", "㈜", "주식회사", "회사", "기업", "산업", "인턴", "계약직", "정규직", "선임", "수석", "책임"]
EDUCATION_WORDS = ["대학교", "대학원", "대학", "고등학교", "수료", "양성과정", "사관학교", "중학교"]
NOISE_WORDS = ["학력사항", "학력구분", "학교명", "단과대학", "단과대학(학부)", "학 과", "평균학점", "소재지", "경력사항", "회사명", "직 급", "부 서", "담당업무", "연 봉", "해외경험", "외국어", "자격사항", "병역사항", "자기소개", "기 간", "기간", "년", "월", "구분", "평가년월", "활 동  내 역", "자격종류", "등급", "기 관", "국가보훈", "대상여부"]
# Heads of a career table that fell into lines.
CAREER_HEADS = ["-", "회사명", "직급", "부서", "담당업무", "연봉", "년", "월"]
# Lines that fill an empty cell of a career table (the last one is how an amount of 8,000 is spelled there).
FILLERS = ["-", "/", "`8000"]
COMPANY = r"([가-힣]{2,}[\w가-힣]*)"
JOB = r"([가-힣/]{2,}(?:개발|분석|관리|기획|설계|마케팅|영업|연구|사원|대리|과장|팀장|엔지니어))"
JOB_WORDS = r"(?i)(개발|분석|관리|기획|설계|연구|엔지니어|담당|업무|부서|직무|QA|테스트)"
# Military service.
SERVICE_TYPES = ["복무완료", "군필", "만기제대", "전역자", "면제", "미필", "공익근무", "산업기능요원", "전역", "예비역", "복무 중", "면 제"]
BRANCHES = ["육군", "해군", "공군", "해병대", "의무경찰", "의무소방", "카투사", "상근"]
SECTION_WORDS = r"(?:자기소개(?:서)?|학력사항|경력사항|자격사항|병역사항)"
REASON_JUNK = ["자기소개", "자기소개서", "학력사항", "경력사항", "자격사항", "병역사항", "어학", "외국어", "해외경험", "수상", "종교"]
TRUSTED_REASON = r"신체|등위|등\s*위\s*판정|등급\s*판정|판정|질병|장애|중증|처분|병증|증명(?:서|원)?|면제증|사유서|외국|영주국|예술|예비역|복무\s*판정|종교|양심|선원|철회|[0-9]{1,2}\s*급|제\s*[0-9]+\s*급"
CHECK_BY_HAND = "담당자 확인 필요"
MAX_SERVICE_ROWS = 15
# Where the sections of a resume begin and end.
SECTION_ENDS = ["학력사항", "경력사항", "자격사항", "병역사항", "자기소개서", "자기소개", "어학", "외국어", "해외경험", "수상실적", "수상", "OA", "포트폴리오"]
LETTER_ENDS = [*SECTION_ENDS, "입사지원서", "[인적사항]", "상기 사항은"]
LETTER_STARTS = [["자기소개서", "자기소개", "[자기소개서]"], ["[자유서술]", "자유서술"]]


def any_of(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def first_of(text: Column, words: list[str]) -> Column:
    """The first word of a list that a text contains; null if none."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def part(items: Column, start: Column, end: Column) -> Column:
    """items[start:end], with bounds from 0 that may lie outside."""
    return F.slice(items, F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)))


def at_or_null(items: Column, i: int) -> Column:
    return F.get(items, F.lit(i))


def education_text(school: Column, major: Column, status: Column, period: Column) -> Column:
    named = [F.when((x.strip(F.coalesce(p, F.lit(""))) != "") & ~p.isin(EDU_SKIP), p) for p in (school, major, status)]
    return F.concat_ws(" ", *named, F.when(F.coalesce(period, F.lit("")) != "", F.concat(F.lit("("), period, F.lit(")"))))


def education_score(school: Column, major: Column, status: Column) -> Column:
    """A graduate school counts less than a university; a major and a state of graduation count one each."""
    rank = F.when(school.contains("대학원"), 1).when(school.contains("대학교") | school.endswith("대학"), 2).otherwise(0)
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0)
    return rank + some(major) + some(status)


def best(candidates: Column) -> Column:
    """struct(value, period) of the candidate with the greatest score, of equal ones the first."""
    top = F.array_max(F.filter(candidates, lambda c: c.isNotNull()))
    return F.struct(F.coalesce(top["value"], F.lit("")).alias("value"), F.coalesce(top["period"], F.lit("")).alias("period"))


def candidate(ok: Column, score: Column, i: Column, value: Column, period: Column) -> Column:
    return F.when(ok, F.struct(score.alias("score"), (-i).alias("order"), value.alias("value"), period.alias("period")))


def major_of(text: Column) -> Column:
    return F.coalesce(*[x.strip(found(text, p)) for p in MAJORS], F.lit(""))


def split_education(docs: DataFrame, key: str, blob: Column) -> DataFrame:
    """(key, education): of each merged cell, in composed characters, struct(school, department, level, period, start, end)."""
    return docs.select(key, x.nfc(blob).alias("_blob")).select(key, education_parts(F.col("_blob")).alias("education"))


def education_parts(blob: Column) -> Column:
    """struct(school, department, level, period, start, end) of one merged cell of composed characters: school, major, state and (period)."""
    period = F.regexp_extract(blob, DATE_RANGE, 1)
    bare = F.regexp_replace(blob, r"\(\s*" + DATE_RANGE + r"\s*\)", " ")
    cut = F.when(bare == blob, F.when(period != "", F.replace(blob, period, F.lit(" "))).otherwise(blob)).otherwise(bare)
    cut = F.regexp_replace(F.regexp_replace(cut, r"\(\s*[0-9\s.\-~/〜～∼]+\s*[~\-–—]\s*[0-9\s.\-~/〜～∼]+\s*\)", " "), r"\([^)]*[~〜～∼－][^)]*\)", " ")
    work = x.strip(F.regexp_replace(F.regexp_replace(cut, "|".join(GRADUATION), " "), r"\s+", " "))

    def split(w: Column) -> Column:
        raw = F.regexp_extract(w, SCHOOL, 1)
        after = x.strip(F.substring(w, F.position(raw, w) + F.char_length(raw), F.char_length(w)))
        school = F.when(raw != "", F.replace(raw, F.lit(" "), F.lit(""))).otherwise(F.regexp_extract(blob, r"^(\S+)", 1))
        department = F.when((raw != "") & (after != ""), after).otherwise(major_of(w))
        return F.struct(F.nullif(school, F.lit("")).alias("school"), F.nullif(department, F.lit("")).alias("department"))

    ends = period_of(period, blob)
    fields = once(work, split)
    made = once(fields, lambda s: F.struct(s["school"].alias("school"), s["department"].alias("department"), education_level(s["school"], s["department"], F.lit(None).cast("string"), blob).alias("level"), F.nullif(period, F.lit("")).alias("period"), ends["start"].alias("start"), ends["end"].alias("end")))
    return F.when(F.coalesce(x.strip(blob), F.lit("")).isin("", "기타"), F.lit(None)).otherwise(made)


def messy_school(school: Column) -> Column:
    """Whether a school's cell holds more than a school."""
    return school.contains("~") | (school.contains("(") & school.contains(")")) | ((school.contains("졸업") | school.contains("재학")) & (F.char_length(school) > 20)) | (F.char_length(school) > 55)


def final_education(text: Column) -> Column:
    """struct(value, period) from the lines that name a university and have a period nearby; the best score wins, of equal ones the first."""

    def over(lines: Column, dates: Column) -> Column:
        def of(line: Column) -> Column:
            i = line["i"]
            context = F.array_join(part(lines, i - 2, i + 4), " ")
            temp = reduce(lambda t, h: F.replace(t, F.lit(h), F.lit("")), CUT_HEADERS, line["line"])
            return once(F.struct(temp.alias("temp"), F.regexp_extract(temp, SCHOOL, 1).alias("raw"), context.alias("context"), i.alias("i")), made)

        def made(c: Column) -> Column:
            raw, temp, context = c["raw"], c["temp"], c["context"]
            school = F.replace(raw, F.lit(" "), F.lit(""))
            after = F.substring(temp, F.position(raw, temp) + F.char_length(raw), F.char_length(temp))
            major = major_of(F.when(after != "", after).otherwise(context))
            status = F.coalesce(first_of(context, GRADUATION), F.lit(""))
            far = lambda d: F.abs(F.position(d, text) - F.position(school, text))
            near = F.transform(F.filter(dates, lambda d: context.contains(d) | (far(d) < 250)), lambda d, k: F.struct(far(d).alias("far"), k.alias("k"), d.alias("d")))
            period = F.array_min(near)["d"]
            ok = (raw != "") & ~school.isin(EDU_SKIP) & ~school.contains("단과대학") & period.isNotNull()
            return candidate(ok, education_score(school, major, status), c["i"], education_text(school, major, status, period), period)

        numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), i.alias("i")))
        return best(F.transform(F.filter(numbered, lambda n: n["line"].contains("대학")), of))

    return once(F.regexp_extract_all(text, F.lit(DATE_RANGE), F.lit(1)), lambda dates: once(F.split(text, "\n"), lambda lines: over(lines, dates)))


ENTRY = "struct<period:string,company:string,job:string>"


def career_entries(text: Column, education_period: Column) -> Column:
    """Array of (period, company, job): date ranges whose surroundings of 200 characters speak of a career and not of education."""

    def entry(d: Column) -> Column:
        start = F.greatest(F.position(d, text) - 200, F.lit(1))
        context = F.substring(text, start, F.position(d, text) + 200 - start)
        return F.struct(d.alias("d"), context.alias("context"))

    def made(e: Column) -> Column:
        line = x.strip(F.get(F.filter(F.split(e["context"], "\n"), lambda v: v.contains(e["d"])), F.lit(0)))
        both = x.strip(F.concat(x.strip(F.substring(line, F.lit(1), F.position(e["d"], line) - 1)), F.lit(" "), x.strip(F.substring(line, F.position(e["d"], line) + F.char_length(e["d"]), F.char_length(line)))))
        return once(both, lambda b: F.struct(e["d"].alias("period"), F.coalesce(found(b, "(?U)" + COMPANY), F.lit("")).alias("company"), F.coalesce(found(b, JOB), F.lit("")).alias("job")))

    some = F.transform(F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(DATE_RANGE), F.lit(1))), lambda d: d != education_period), entry)
    any_case = "|".join(re.escape(w) if w.upper() == w.lower() else f"(?iu:{re.escape(w)})" for w in CAREER_WORDS)
    speaks = lambda e: e["context"].rlike(any_case) & ~any_of(e["context"], EDUCATION_WORDS)
    return F.transform(F.filter(some, speaks), made)


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), x.strip), lambda v: v != "")


def place_of(lines: Column, word: str) -> Column:
    """Where the first line with a word is, -1 if there is none."""
    return (F.array_position(F.transform(lines, lambda v: v.contains(word)), F.lit(True)) - 1).cast("int")


def between(lines: Column, start: Column, stop: Column) -> Column:
    """The lines after ``start`` up to ``stop`` where that comes later; all lines without a start."""
    return F.when(start >= 0, part(lines, start + 1, F.when(stop > start, stop).otherwise(F.size(lines)))).otherwise(lines)


def is_major_line(line: Column) -> Column:
    return F.char_length(line).between(2, 48) & (any_of(line, ["학과", "학부", "전공", "계열"]) | line.rlike(r"^[가-힣·・]{2,34}과\s*$"))


def section_education(text: Column, kind: str) -> Column:
    """struct(value, period) from the section of education whose table fell into lines; kind: ``hwp`` or ``pdf``."""

    def over(lines: Column) -> Column:
        def of(line: Column, i: Column) -> Column:
            if kind == "hwp":
                ok = line.rlike(r"^[가-힣A-Za-z0-9() ]{2,}\s*(?:대학교|대학원|대학)$") & ~line.isin(EDU_SKIP) & ~line.contains("단과대학")
            else:
                ok = line.rlike(r"(대학교|대학원|대학)$") & ~any_of(line, NOISE_WORDS) & ~line.isin(EDU_SKIP)
            major = F.coalesce(F.get(F.filter(part(lines, i + 1, i + 5), lambda v: ~any_of(v, NOISE_WORDS) & is_major_line(v)), F.lit(0)), F.lit(""))
            window, status = F.array_join(part(lines, i - 10, i + 2), " "), F.coalesce(first_of(F.array_join(part(lines, i, i + 8), " "), GRADUATION), F.lit(""))
            last = lambda a, n: F.get(a, F.size(a) - n)
            if kind == "hwp":
                months = F.transform(F.regexp_extract_all(window, F.lit(r"\b\d{4}[.\-]?\d{1,2}\b"), F.lit(0)), lambda m: F.regexp_replace(m, r"^(\d{4})[.\-]?(\d{1,2})$", "$1.$2"))
                period = F.when(F.size(months) >= 2, F.concat(last(months, 2), F.lit("~"), last(months, 1)))
            else:
                ranges, months = F.regexp_extract_all(window, F.lit(DATE_RANGE), F.lit(1)), F.regexp_extract_all(window, F.lit(YEAR_MONTH), F.lit(0))
                period = F.coalesce(last(ranges, 1), F.when(F.size(months) >= 2, F.concat(last(months, 2), F.lit("~"), last(months, 1))))
            school = F.replace(line, F.lit(" "), F.lit(""))
            return candidate(ok & period.isNotNull(), education_score(school, major, status), i, education_text(school, major, status, period), period)

        return best(F.transform(lines, of))

    return once(lines_of(text), lambda lines: once(between(lines, place_of(lines, "학력사항"), place_of(lines, "경력사항")), over))


def section_career(text: Column, kind: str) -> Column:
    """struct(period, company, job) of the first career in the section of careers; empty texts if there is none."""

    def over(lines: Column) -> Column:
        tail = lambda i: part(lines, i + 1, i + 12)
        speaks = lambda t: any_of(F.array_join(t, " "), [*CAREER_WORDS, "회사"])
        if kind == "hwp":
            numbered = F.filter(F.transform(lines, lambda v, i: F.struct(i.alias("i"), F.regexp_replace(v, r"^(\d{4})[.\-]?(\d{1,2})$", "$1.$2").alias("m"), v.rlike(r"^\d{4}[.\-]?\d{1,2}$").alias("ok"))), lambda n: n["ok"])
            pairs = once(numbered, lambda n: F.filter(F.transform(n, lambda a, k: F.struct(F.get(n, k + 1)["i"].alias("i"), F.concat(a["m"], F.lit("~"), F.get(n, k + 1)["m"]).alias("period"), (k % 2).alias("odd"))), lambda q: (q["odd"] == 0) & q["period"].isNotNull()))
            plain = lambda v: ~v.isin(*CAREER_HEADS) & ~any_of(v, NOISE_WORDS)
        else:
            pairs = F.filter(F.transform(lines, lambda v, i: F.struct(i.alias("i"), found(v, DATE_RANGE).alias("period"), F.lit(0).alias("odd"))), lambda q: q["period"].isNotNull())
            plain = lambda v: ~any_of(v, NOISE_WORDS) & ~v.isin(*FILLERS) & ~v.rlike(DATE_RANGE)

        def made(q: Column) -> Column:
            rest = F.filter(tail(q["i"]), plain)
            job = once(rest, lambda r: F.coalesce(F.get(F.filter(F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1))), lambda v: v.rlike(JOB_WORDS)), F.lit(0)), F.get(r, F.lit(1)), F.lit("")))
            return F.struct(q["period"].alias("period"), F.coalesce(F.get(rest, F.lit(0)), F.lit("")).alias("company"), job.alias("job"))

        none = F.struct(*[F.lit("").alias(c) for c in ("period", "company", "job")])
        return F.coalesce(once(F.get(F.filter(pairs, lambda q: speaks(tail(q["i"]))), F.lit(0)), lambda q: F.when(q.isNotNull(), made(q))), none)

    def section(lines: Column) -> Column:
        start, stop = place_of(lines, "경력사항"), place_of(lines, "해외경험")
        return once(between(lines, start, stop), over)

    return once(lines_of(text), section)


def service(type_: Column, branch: Column, start: Column, end: Column, rank: Column, reason: Column) -> Column:
    none = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.struct(none(type_).alias("type"), none(branch).alias("service"), none(start).alias("start"), none(end).alias("end"), none(rank).alias("rank"), none(reason).alias("exemption_reason"))


def service_type(squeezed: Column) -> Column:
    return F.coalesce(*[F.when(squeezed.contains(w.replace(" ", "")), F.lit(w)) for w in SERVICE_TYPES])


def slash_service(segment: Column) -> Column:
    """A row of ``type / period / branch / rank``; null if it has no such form."""
    none = F.lit(None).cast("string")

    def made(p: Column) -> Column:
        three = (F.size(p) == 3) & at_or_null(p, 1).rlike(r"\d{4}")
        kind = F.regexp_replace(at_or_null(p, 0), " ", "")
        plain = F.coalesce(*[F.when(kind.contains(w), F.lit(w)) for w in ("면제", "미필", "예비역")])
        type_ = F.coalesce(F.when(kind == "필", "군필").when(kind.isin("면제", "미필", "예비역", "복무중"), plain).otherwise(service_type(kind)), F.substring(at_or_null(p, 0), 1, 32))
        branch, rank = at_or_null(p, 2), F.substring(F.when(F.size(p) >= 4, at_or_null(p, 3)), 1, 50)
        tail = F.coalesce(branch, rank)
        reason = F.when((type_ == "면제") & ~tail.isin(REASON_JUNK), F.substring(tail, 1, 500))
        row = lambda ends: service(type_, F.coalesce(first_of(branch, BRANCHES), F.substring(branch, 1, 48)), ends["start"], ends["end"], rank, reason)
        return F.when(segment.contains("/") & ((F.size(p) >= 4) | three), once(parse_period(at_or_null(p, 1)), row))

    return once(F.filter(F.transform(F.split(F.coalesce(segment, none), r"\s*/\s*"), x.strip), lambda v: v != ""), made)


def cell_service(value: Column) -> Column:
    """A row of a cell that holds the kind of service alone; null if it doesn't."""
    none = F.lit(None).cast("string")
    v = x.strip(value)
    type_ = F.coalesce(service_type(F.regexp_replace(v, " ", "")), F.when(v.contains("만기"), "만기제대"))
    return F.when((v != "") & (F.char_length(v) <= 80) & type_.isNotNull(), service(type_, none, none, none, none, none))


def unreadable(text: Column) -> Column:
    """Chinese signs alone, as broken fonts give them."""
    core = F.regexp_replace(text, r"[\s0-9A-Za-z.,\-/+()°℃·:×÷%‰]+", "")
    return ~text.rlike("[가-힣]") & core.rlike("^[　㐀-鿿豈-﫿]+$")


def clean_reason(raw: Column) -> Column:
    """A reason of exemption without headers of sections; null if nothing sound is left."""
    s = x.strip(F.regexp_replace(x.strip(raw), rf"^(?:{SECTION_WORDS}(?:\s+|[:：])?\s*)+", ""))
    s = x.strip(F.regexp_replace(s, rf"(?s)\s+{SECTION_WORDS}(?:\s+|$).*", ""))
    return once(s, lambda v: F.when((v == "") | v.isin(REASON_JUNK) | unreadable(v), F.lit(None).cast("string")).when(v.startswith("종교 "), F.nullif(F.substring(x.strip(F.substring(v, 4, 10_000)), 1, 500), F.lit(""))).otherwise(F.substring(v, 1, 500)))


def trusted(reason: Column) -> Column:
    hangul = F.char_length(F.regexp_replace(reason, "[^가-힣]", ""))
    return (F.char_length(reason) > 1) & (reason.rlike(TRUSTED_REASON) | ((F.char_length(reason) >= 48) & (hangul >= 24)) | ((F.char_length(reason) >= 72) & (hangul >= 14)))


def block_service(section: Column) -> Column:
    """A row of the section of military service; null if the section says nothing."""
    reasons = (r"면제\s*사유\s*[\(:：]?\s*([^\n|]+)", r"면제\s*\(\s*([^)\n]+)\s*\)", r"면제\s*[\(:：]?\s*([^\n]+)")

    def made(block: Column, tight: Column, ends: Column) -> Column:
        raw = F.coalesce(*[found(block, p) for p in reasons])
        reason = F.when(tight.contains("면제"), once(clean_reason(raw), lambda v: F.when(v.isNotNull() & trusted(v), v).otherwise(F.lit(CHECK_BY_HAND))))
        type_ = F.coalesce(*[F.when(tight.contains(w), F.lit(w)) for w in SERVICE_TYPES])
        row = service(type_, first_of(block, BRANCHES), ends["start"], ends["end"], F.lit(None), reason)
        return once(row, lambda r: F.when(F.coalesce(r["type"], r["service"], r["start"], r["end"], r["exemption_reason"]).isNotNull(), r))

    whole = lambda b: once(F.regexp_replace(b, " ", ""), lambda tight: once(parse_period(b), lambda ends: made(b, tight, ends)))
    return once(section, lambda b: F.when(F.char_length(b) >= 2, whole(b)))


def military_rows(text: Column, from_tables: Column | None = None) -> Column:
    """Array of (type, service, start, end, rank, exemption_reason): rows of tables, of lines, of the section; each once, the fullest first, at most 15."""
    none = F.lit(None).cast("string")
    cells = F.regexp_extract_all(text, F.lit(r"(?m)[^\n]{0,48}병역(?:사항)?\s*[|｜]\s*([^\n]{3,420})"), F.lit(1))
    lines = F.transform(cells, lambda c: F.when(c.contains("/"), slash_service(x.strip(c))).otherwise(cell_service(F.regexp_extract(x.strip(c), r"^[^|]*", 0))))
    spans = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![가-힣])복무\s*기간\s*[:：]?\s*([^\n]{6,240})"), F.lit(1)), parse_period)
    served = F.transform(F.filter(spans, lambda p: F.coalesce(p["start"], p["end"]).isNotNull()), lambda p: service(F.lit("군필"), none, p["start"], p["end"], none, none))
    section = F.array(block_service(slice_section(text, ["병역사항", "병 역"], SECTION_ENDS)))
    every = F.concat(*([] if from_tables is None else [from_tables]), lines, served, section)
    sign = lambda r: F.to_json(F.struct(r["type"], r["service"], r["start"], r["end"]))
    given = lambda r: F.coalesce(r["type"], r["service"], r["start"], r["end"], r["rank"], r["exemption_reason"]).isNotNull()

    def merged(rows: Column) -> Column:
        first = F.filter(F.transform(rows, lambda r, i: F.when(F.array_position(F.transform(rows, sign), sign(r)) == i + 1, F.struct(r["start"].isNull().alias("a"), r["service"].isNull().alias("b"), r["type"].isNull().alias("c"), i.alias("i"), r.alias("r")))), lambda v: v.isNotNull())
        return F.slice(F.transform(F.array_sort(first), lambda v: v["r"]), 1, MAX_SERVICE_ROWS)

    return once(F.filter(every, lambda r: r.isNotNull() & given(r)), merged)


def qualifications(block: Column) -> Column:
    """Array of (certificate, organization, issued) of the lines of a section; the feature's limit is 30."""
    date = r"(20\d{2})[.\-/년]\s*(\d{1,2})"
    lines = F.filter(F.transform(F.split(F.coalesce(block, F.lit("")), "\n"), x.strip), lambda v: (F.char_length(v) >= 3) & ~is_header_line(v) & ~v.rlike(r"^[\s\-.0-9]+$"))
    row = lambda v: F.struct(
        F.substring(v, 1, 500).alias("certificate"), F.when(any_of(v, ["산업인력", "협회", "공단"]) & v.rlike(r"\S\s+\S"), F.substring(F.regexp_extract(v, r"(\S+)\s*$", 1), 1, 500)).alias("organization"),
        F.when(v.rlike(date), F.concat_ws("-", F.regexp_extract(v, date, 1), F.lpad(F.regexp_extract(v, date, 2), 2, "0"), F.lit("01"))).alias("issued"),
    )
    return F.slice(F.transform(lines, row), 1, MAX_QUALIFICATIONS)


def letter(text: Column) -> Column:
    """The longest section that may be the cover letter."""
    one_line = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"자\s*기\s*소\s*개(?:\s*서)?", "자기소개서"), r"입\s*사\s*지\s*원\s*서", "입사지원서")
    cut = lambda rest: once(rest, lambda r: x.strip(F.substring(r, F.lit(1), F.coalesce(F.array_min(F.filter(F.array(*[F.locate(e, r) for e in LETTER_ENDS]), lambda p: p > 0)) - 1, F.char_length(r)))))
    numbered = r"(?m)^\s*1\s*[.)]\s*[^\n]*(?:지원동기|지원\s*직무|입사\s*후)[^\n]*$"

    def some(plain: Column) -> Column:
        after_heading = F.when(plain.rlike(r"(?m)^\s*PR\s*$"), cut(F.regexp_extract(plain, r"(?ms)^\s*PR\s*$(.*)", 1))).otherwise("")
        from_number = F.when(plain.rlike(numbered), cut(F.regexp_extract(plain, "(?ms)(" + numbered.removeprefix("(?m)") + ".*)", 1))).otherwise("")
        return F.array(*[slice_section(plain, s, LETTER_ENDS) for s in LETTER_STARTS], after_heading, from_number)

    longest = lambda cuts: F.get(F.filter(cuts, lambda c: F.char_length(c) == F.array_max(F.transform(cuts, lambda v: F.char_length(v)))), F.lit(0))
    return once(one_line, lambda plain: once(some(plain), longest))


RECORD = ["name", "birthDate", "contact", "email", "address", "originalJobRole", "finalEducation", "careerPeriod", "careerCompany", "careerRole"]


def parse_resumes(docs: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """A row per document: the record's fields, and its rows of service, qualification and experience as arrays.

    kind: a column, ``pdf`` or ``hwp`` (tables that fell into lines; each has its repairs and its sections) or another. A null text has an empty
    record. Statements are rows of ``split_cover_letter`` over the column ``letter``. Other columns are left out.
    """
    source = F.coalesce(x.nfc(F.col(text)), F.lit(""))
    repaired = F.when(F.col(kind) == "pdf", x.repair_broken_text(source, "pdf")).when(F.col(kind) == "hwp", x.repair_broken_text(source, "hwp")).otherwise(source)
    rows = docs.select(F.col(key), F.col(kind).alias("fileType"), repaired.alias("_raw")).withColumn("_clean", F.regexp_replace("_raw", r"[ \t]+", " "))
    of_kind = lambda f: F.when(F.col("fileType") == "pdf", f(F.col("_raw"), "pdf")).when(F.col("fileType") == "hwp", f(F.col("_raw"), "hwp"))
    clean = F.col("_clean")
    rows = rows.withColumns({"_basic": extract_basic(clean), "_edu": final_education(clean), "_sec": of_kind(section_education), "_job": of_kind(section_career), "_more": extract_profile_scalars(clean)})
    rows = rows.withColumn("_careers", career_entries(clean, F.col("_edu.period")))
    has_major = lambda v: education_parts(v)["department"].isNotNull()
    section = F.coalesce(F.col("_sec.value"), F.lit(""))
    better = (section != "") & (bad_education(F.col("_edu.value")) | (~has_major(F.col("_edu.value")) & has_major(section)))
    joined = lambda c: F.array_join(F.transform("_careers", lambda e: e[c]), "\n")
    filled = lambda c: F.when(joined(c) != "", joined(c)).otherwise(F.coalesce(F.col(f"_job.{c}"), F.lit("")))
    other = lambda v: F.when(v == "", "기타").otherwise(v)
    rows = rows.withColumns({"finalEducation": F.when(better, section).otherwise(F.col("_edu.value")), "careerPeriod": filled("period"), "_company": filled("company"), "_role": filled("job")})
    beside = lambda c: F.when(F.col("careerPeriod") != "", other(x.strip(F.col(c)))).otherwise(x.strip(F.col(c)))
    return rows.select(
        key, F.col("_basic.name").alias("name"), F.col("_basic.birth").alias("birthDate"), F.col("_basic.phone").alias("contact"), F.col("_basic.email").alias("email"), F.col("_basic.address").alias("address"), other(F.col("_basic.role")).alias("originalJobRole"),
        other(F.col("finalEducation")).alias("finalEducation"), "careerPeriod", beside("_company").alias("careerCompany"), beside("_role").alias("careerRole"), F.upper("fileType").alias("fileType"),
        *[F.coalesce(F.col(f"_more.{c}"), F.lit("")).alias(c) for c in ("gender", "disability", "veteran", "desired_location", "desired_salary")], military_rows(clean).alias("militaryRows"),
        qualifications(slice_section(clean, ["자격사항", "자 격"], SECTION_ENDS)).alias("qualificationRows"), letter(clean).alias("letter"),
    )
