"""Fields, rows and sections of resume text, by column expressions over a table of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.functions import text as x

# Label patterns of basic fields.
NAME = r"(?:성\s*명|이\s*름|이름|Name)\s*(?:\([^)]*\))?\s*[:：]?\s*([가-힣]{2,5})"
BIRTH = r"(\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2})"
MOBILE = r"((?:010|011|016|017|018|019)[-\s]?\d{3,4}[-\s]?\d{4})"
LANDLINE = r"((?:02|031|032|033|041|042|043|044|051|052|053|054|055|061|062|063|064|070)[-\s]?\d{3,4}[-\s]?\d{4})"
EMAIL = r"([\w\-+.%가-힣]+@[a-zA-Z0-9](?:[a-zA-Z0-9.-]*[a-zA-Z0-9])?\.[a-zA-Z]{2,})"
ADDRESS = r"(?:주\s*소|거\s*주\s*지|Address)\s*[:：]?\s*([^\n]{5,})"
ROLE = r"(?:지\s*원\s*직\s*무|지\s*원\s*분\s*야|직\s*무|Position|지원직무)\s*[:：]?\s*([가-힣\s\w/.\(\)]+?)(?=\n|경력여부|희망연봉|희망|About|성명|생년|$)"
# Periods, and words for an open end.
RANGE = r"(\d{4}[.\-/]\d{1,2})\s*[~\-–—]\s*(\d{4}[.\-/]\d{1,2}|현재|재직|재학|중|진행)"
YEAR_MONTH, KOREAN_MONTH = r"\d{4}[.\-]\d{1,2}", r"(\d{4})\s*년\s*(\d{1,2})\s*월"
OPEN_ENDS = ["현재", "재직", "재학", "중", "진행"]
UNCLEAR_GRADUATE = "석사인지 박사인지 확인 필요"
# Lines of qualification tables that are headers.
HEADERS = ["자격사항", "자격증", "종류", "등급", "발행처", "취득일", "-", "기간", "활동내역", "자격종류", "평가년월", "구분", "자격증명", "합격번호", "합격증", "기관명", "발급기관", "언어점수"]
# Lines of any table that are headers.
TABLE_HEADERS = ["학력사항", "학력구분", "학교명", "단과대학", "단과대학(학부)", "학과", "평균학점", "소재지", "경력사항", "회사명", "직급", "부서", "담당업무", "연봉", "해외경험", "외국어", "병역사항", "자기소개", "년", "월", "기관", "국가보훈", "대상여부"]
MAX_QUALIFICATIONS = 30


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def extract_basic(text: Column) -> Column:
    """struct(name, birth, phone, email, address, role); empty texts where a label isn't found."""
    unicode = lambda p: "(?U)" + p
    get = lambda *patterns: x.strip(F.coalesce(*[found(text, unicode(p)) for p in patterns], F.lit("")))
    return F.struct(get(NAME).alias("name"), get(BIRTH).alias("birth"), get(MOBILE, LANDLINE).alias("phone"), get(EMAIL).alias("email"), get(ADDRESS).alias("address"), get(ROLE).alias("role"))


def parse_period(text: Column) -> Column:
    """struct(start, end): a range (an open end is null), else the first and last year.month, else 년/월."""
    pair = lambda start, end: F.struct(start.alias("start"), end.alias("end"))
    ends = lambda a: x.once(a, lambda v: F.when(F.size(v) > 0, pair(F.get(v, F.lit(0)), F.when(F.size(v) > 1, F.element_at(v, -1)))))
    months = F.regexp_extract_all(text, F.lit(YEAR_MONTH), F.lit(0))
    korean = F.transform(F.regexp_extract_all(text, F.lit(KOREAN_MONTH), F.lit(0)), lambda m: F.concat(F.regexp_extract(m, KOREAN_MONTH, 1), F.lit("."), F.lpad(F.regexp_extract(m, KOREAN_MONTH, 2), 2, "0")))
    end = F.regexp_extract(text, RANGE, 2)
    whole = F.when(text.rlike(RANGE), pair(F.regexp_extract(text, RANGE, 1), F.when(~end.isin(OPEN_ENDS), end)))
    none = F.lit(None).cast("string")
    return F.coalesce(whole, ends(months), ends(korean), pair(none, none))


def period_of(cell: Column, row: Column) -> Column:
    """The period of a cell, else of its whole row."""
    own, other = parse_period(F.coalesce(cell, F.lit(""))), parse_period(F.coalesce(row, F.lit("")))
    return x.once(own, lambda o: F.when(o["start"].isNotNull() | o["end"].isNotNull(), o).otherwise(other))


def education_level(school: Column, department: Column, level: Column, row: Column) -> Column:
    """고등학교, 학사, 석사, 박사, the note for an unclear graduate school, or null; the first rule that holds."""
    full = x.strip(F.concat_ws(" ", *[F.when(x.strip(c) != "", x.strip(c)) for c in (level, school, department, row)]))
    tight, low, own = x.squeezed(full), F.lower(full), x.squeezed(F.coalesce(school, F.lit("")))
    has = lambda w: tight.contains(w)
    return (
        F.when(~has("중학교") & ~has("초등학교") & (has("고등학교") | has("고교")), "고등학교").when(low.rlike(r"\bph\.?\s*d\.?|doctoral|\bdoctor\s+of\b") | has("박사"), "박사").when(has("석사") | low.rlike(r"\b(?:master(?:'s)?|mba)\b"), "석사")
        .when(has("대학원"), UNCLEAR_GRADUATE).when(has("전문대") | has("대학교") | own.endswith("대학"), "학사").when(full.rlike(r"[가-힣]{2,}대학\s*\("), "학사")
    )


def slice_section(text: Column, starts: list[str], ends: list[str]) -> Column:
    """What stands between the earliest start header and the nearest end header after it; empty without a start."""
    stops = [e for e in ends if e and e not in starts]

    def cut(rest: Column) -> Column:
        end = F.array_min(F.filter(F.array(*[F.locate(e, rest) for e in stops]), lambda p: p > 0)) if stops else F.lit(None).cast("int")
        return x.once(end, lambda e: x.strip(F.when(e.isNull(), rest).otherwise(F.substring(rest, F.lit(1), e - 1))))

    def after(plain: Column) -> Column:
        places = F.array(*[F.struct(F.locate(k, plain).alias("at"), F.lit(i).alias("i"), F.lit(len(k)).alias("n")) for i, k in enumerate(starts)])
        first = F.array_min(F.filter(places, lambda p: p["at"] > 0))
        return x.once(first, lambda p: F.when(p.isNull(), F.lit("")).otherwise(x.once(F.substring(plain, p["at"] + p["n"], F.char_length(plain)), cut)))

    return x.once(F.replace(text, F.lit("\r"), F.lit("")), after)


def longest_intro(text: Column, strategies: list[tuple[list[str], list[str]]]) -> Column:
    """The longest of several slices."""
    cuts = F.array(*[slice_section(text, a, b) for a, b in strategies])
    return F.array_max(F.transform(cuts, lambda c: F.struct(F.char_length(c).alias("n"), c.alias("c"))))["c"]


def is_header_line(line: Column) -> Column:
    """Whether a line is nothing but a table's header, whatever white space it holds."""
    return x.squeezed(line).isin([*HEADERS, *TABLE_HEADERS])


def qualification_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line_no, certificate, organization, issued) of lines that may be a qualification; the feature's limit is 30 per text."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "_raw")).select(key, "line_no", x.strip(F.col("_raw")).alias("line"))
    lines = lines.where((F.char_length("line") >= 3) & ~is_header_line(F.col("line")) & ~F.col("line").rlike(r"^[\s\-.0-9]+$"))
    date = r"(20\d{2})[.\-/년]\s*(\d{1,2})"
    body = F.regexp_extract("line", r"(\S+)\s*$", 1)
    named = F.col("line").contains("산업인력") | F.col("line").contains("협회") | F.col("line").contains("공단")
    order = Window.partitionBy(key).orderBy("line_no")
    rows = lines.select(key, "line_no", F.substring("line", 1, 500).alias("certificate"), F.when(named & F.col("line").rlike(r"\S\s+\S"), F.substring(body, 1, 500)).alias("organization"), F.when(F.col("line").rlike(date), F.concat_ws("-", F.regexp_extract("line", date, 1), F.lpad(F.regexp_extract("line", date, 2), 2, "0"), F.lit("01"))).alias("issued"))
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MAX_QUALIFICATIONS).drop("_n")


def experience_rows(df: DataFrame, key: str, periods: str, companies: str, roles: str) -> DataFrame:
    """Three lists of lines side by side up to the longest; a missing period repeats the last one."""
    items = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "\n"), x.strip), lambda v: v != "")
    rows = df.select(key, items(periods).alias("_p"), items(companies).alias("_c"), items(roles).alias("_r"))
    rows = rows.select("*", F.explode(F.expr("CASE WHEN greatest(size(_p), size(_c), size(_r)) > 0 THEN sequence(0, greatest(size(_p), size(_c), size(_r)) - 1) END")).alias("row_no"))
    period = parse_period(F.coalesce(F.get("_p", F.col("row_no")), F.get("_p", F.size("_p") - 1), F.lit("")))
    return rows.select(key, "row_no", F.get("_c", F.col("row_no")).alias("company"), F.get("_r", F.col("row_no")).alias("role"), period["start"].alias("start"), period["end"].alias("end"))


SCALARS = ["name", "birthDate", "contact", "email", "address", "originalJobRole", "finalEducation", "careerPeriod", "careerCompany", "careerRole"]
LISTS = ["educationRows", "militaryRows", "qualificationRows", "experienceRows", "statementRows"]


def finalize_record(df: DataFrame) -> DataFrame:
    """Fields stripped (null: empty); role and education default to 기타, company and career role only beside a period; lists to []."""
    df = df.withColumns({c: x.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in SCALARS if c in df.columns})
    other = lambda c, also: F.when((F.col(c) == "") & also, "기타").otherwise(F.col(c))
    period = F.col("careerPeriod") != ""
    df = df.withColumns({"originalJobRole": other("originalJobRole", F.lit(True)), "finalEducation": other("finalEducation", F.lit(True)), "careerRole": other("careerRole", period), "careerCompany": other("careerCompany", period)})
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in LISTS if c in df.columns})


def exists_in_source(value: Column, source: Column) -> Column:
    """Whether a value occurs in the source but for white space and case, or but for signs of periods as well."""
    tight = lambda c: F.lower(x.squeezed(c))
    bare = lambda c: F.regexp_replace(tight(c), "[~.-]", "")
    return F.coalesce((x.strip(value) != "") & (tight(source).contains(tight(value)) | bare(source).contains(bare(value))), F.lit(False))


def bad_education(value: Column) -> Column:
    """Blank, begins with a bracket, or names no university."""
    v = x.strip(F.coalesce(value, F.lit("")))
    return (v == "") | v.startswith("(") | ~v.contains("대학")


def valid_education(value: Column) -> Column:
    """A university with a closed period."""
    return ~bad_education(value) & value.rlike(r"\(\d{4}[.\-]\d{1,2}\s*[~\-]\s*\d{4}[.\-]\d{1,2}")


def grounded_merge(df: DataFrame, fields: list[str], proposed: str, source: str, education: str = "finalEducation") -> DataFrame:
    """Empty fields take the proposed ones (columns with a prefix) where those occur in the source.

    The education is taken where the own one is no good and the proposed one names a university and a period.
    """
    there = lambda c: exists_in_source(F.col(proposed + c), F.col(source))
    take = lambda c: there(c) & (bad_education(F.col(c)) & valid_education(F.col(proposed + c)) if c == education else F.coalesce(F.col(c), F.lit("")) == "")
    return df.withColumns({c: F.when(take(c), F.col(proposed + c)).otherwise(F.col(c)) for c in fields})


def vote_fields(values: DataFrame, education: str = "finalEducation") -> DataFrame:
    """values: doc_id, provider_no, field, value. The value most providers give, of equals the longest, then the first provider's.

    An education without university and period is blanked.
    """
    given = values.withColumn("value", x.strip(F.col("value"))).where("value <> ''")
    votes = given.groupBy("doc_id", "field", "value").agg(F.count("*").alias("votes"), F.min("provider_no").alias("_first"))
    order = Window.partitionBy("doc_id", "field").orderBy(F.desc("votes"), F.desc(F.char_length("value")), "_first")
    best = votes.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", "field", "value", "votes")
    every = values.select("doc_id", "field").distinct()
    rows = every.join(best, ["doc_id", "field"], "left").withColumn("value", F.coalesce("value", F.lit("")))
    return rows.withColumn("value", F.when((F.col("field") == education) & ~valid_education(F.col("value")), "").otherwise(F.col("value")))


def voted_records(votes: DataFrame, fields: list[str]) -> DataFrame:
    """A row per document with a column for each field."""
    return votes.groupBy("doc_id").pivot("field", fields).agg(F.first("value"))


def prompt_text(record: dict[str, Column], rows: dict[str, Column]) -> Column:
    """The text of a parsed resume for a prompt: its fields under headings, its rows as numbered JSON items, personal data masked.

    record: originalJobRole, finalEducation, desired_location, desired_salary, careerPeriod, careerCompany, careerRole. rows: arrays by title.
    """
    text = lambda c: F.coalesce(record[c], F.lit("")) if c in record else F.lit("")
    line = lambda label, c: F.concat(F.lit(f"- {label}: "), text(c))
    head = [F.lit("## Resume Summary"), line("Original job role text", "originalJobRole"), line("Final education", "finalEducation"), line("Desired location", "desired_location"), line("Desired salary", "desired_salary")]
    career = [F.lit("\n## Career"), line("Period", "careerPeriod"), line("Company", "careerCompany"), line("Role", "careerRole")]
    items = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, "- Not extracted.").otherwise(F.array_join(F.transform(c, lambda v, i: F.concat(F.lit("- Item "), (i + 1).cast("string"), F.lit(": "), F.to_json(v))), "\n"))
    listed = [part for title, c in rows.items() for part in (F.lit(f"\n### {title}"), items(c))]
    return x.mask_pii(x.strip(F.concat_ws("\n", *head, *career, *listed)))


FOCUS = """## Interview Focus
- Ask about verifiable job-related experience, skills, decisions, and outcomes.
- Do not ask about age, gender, family, religion, disability, veteran status, address, appearance, or other unrelated personal information.
- Use unclear resume content as a neutral confirmation question, not as an accusation."""


def resume_context(limit: int = 12_000) -> Column:
    """The context of a resume for questions, over columns position_name, desired_location, desired_salary, ai_profile, parsed_json (JSON texts), summary, raw_text.

    The raw text, without lines that name a personal field, stands only where there is nothing else.
    """
    given = lambda c: F.nullif(x.strip(F.col(c).cast("string")), F.lit(""))
    shown = lambda c: F.concat(F.lit("- "), F.coalesce(given(c), F.lit("Not provided")))
    labelled = lambda label, c: F.concat(F.lit(f"- {label}: "), F.coalesce(given(c), F.lit("Not provided")))
    section = lambda title, body: F.when(body.isNotNull(), F.concat(F.lit(f"\n## {title}\n"), body))
    parsed = lambda c: F.when(given(c).isNotNull(), x.truncate(x.drop_sensitive_fields(F.col(c)), 8_000))
    nothing = F.coalesce(given("ai_profile"), given("summary"), given("parsed_json")).isNull()
    raw = F.when(nothing & given("raw_text").isNotNull(), x.truncate(x.redact_sensitive_lines(given("raw_text")), 6_000))
    none = F.when(nothing & given("raw_text").isNull(), F.lit("\n## Resume Content\n- No parsed resume content is stored."))
    parts = [F.lit("# Resume Context\n\n## Target Position"), shown("position_name"), F.lit("\n## Resume Metadata"), labelled("Desired location", "desired_location"), labelled("Desired salary", "desired_salary")]
    parts += [section("AI Profile", parsed("ai_profile")), section("Summary", given("summary")), section("Parsed Resume JSON", parsed("parsed_json")), section("Raw Resume Text", raw), none, F.lit("\n" + FOCUS)]
    return x.truncate(F.concat_ws("\n", *parts), limit)


def split_job_descriptions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, kind, number, title, body): the common part before chapter 3, its sections, and the guide from chapter 4."""
    header = lambda p: F.col("line").rlike(p)
    section, chapter, guide = r"^##\s+3\.(\d+)\s+(.+?)\s*$", r"^#\s+3\.\s+", r"^#\s+4\.\s+"
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\n|\r")).alias("n", "line"))
    order = Window.partitionBy(key).orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_c", F.max(header(chapter).cast("int")).over(so_far)).withColumn("_g", F.max(header(guide).cast("int")).over(so_far)).withColumn("_s", F.sum(header(section).cast("int")).over(so_far))
    kind = F.when(F.col("_g") == 1, "guide").when(F.col("_s") > 0, "section").when(F.col("_c") == 0, "common")
    rows = marked.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("_s", F.when(F.col("kind") == "section", F.col("_s")).otherwise(0))
    body = x.strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda p: p["line"]), "\n"))
    out = rows.groupBy(key, "kind", "_s").agg(body.alias("body"))
    first = F.regexp_extract("body", r"^[^\n]*", 0)
    return out.select(key, "kind", F.when(F.col("kind") == "section", F.regexp_extract(first, section, 1).cast("int")).alias("number"), F.when(F.col("kind") == "section", F.regexp_extract(first, section, 2)).alias("title"), "body")




# Label patterns of profile fields; a value ends at a cell border or line end.
GENDER = r"성별\s*[:：]?\s*(남성|여성|남|여|男|女)"
DISABILITY = [r"보훈\s*[/／]\s*장애[^\n]{0,20}?\s*[：:|｜]?\s*([^\n|｜]{1,64})", r"(?<!시스템 )(?<!네트워크 )장애(?:\s*인(?:\([^)]*\))?)?\s*[:：]\s*([^\n\|｜]{1,64})"]
VETERAN = [r"(?:국가\s*)?보훈(?:\s*여부)?[^\n:：]{0,12}[：:｜│]\s*([^｜|\n]{1,64})", r"국가\s*보훈\s*(?:대상)?[^\n:：]{0,12}[：:｜│]\s*([^｜|\n]{1,64})", r"보훈(?:\s*등록)?(?:\s*번호)?[^\n:：]{0,8}[：:｜│]\s*([^｜|\n]{1,64})", r"보훈\s*(?:등록|증)?\s*번호\s*[：:]\s*(\d[\d\s\-]{5,16})"]
LOCATION = [r"희망\s*근무지\s*(?:[^\n\:：]{0,12}?)?[:：]\s*([^\n]{1,100})", r"희망근무[^\n]{0,12}?\s*[：:|｜]\s*([^｜|\n]{1,80})"]
SALARY = r"희망\s*연봉\s*[:：]?\s*([^\n]{1,100})"
HEADER_VALUES = ["대상여부", "1.대상2.비대상", "해당여부"]
PROSE_MARKS = ["저는", "입사 후", "지원하였", "예상치", "특히", "삼성전자는", "서비스", "복잡한"]
# A heading line of a cover letter, and bullets.
HEADING = r"^\s*(?:\d+[.)]\s+.{1,260}|[■▪●□▢▣]+\s*\S.{1,420})\s*$"
BULLETS = "■▪●□▢▣・‧•∙"
MAX_LETTER_ROWS, MAX_ANSWER = 30, 20_000


def clip_scalar(value: Column, most: int) -> Column:
    """One line up to a cell border or the hobby column, cut to a length."""
    line = F.regexp_replace(x.strip(value), r"(?U)\s+", " ")
    cell = x.strip(F.regexp_extract(line, r"^[^|｜]*", 0))
    before = F.when(cell.rlike("취미|특기"), F.regexp_replace(x.strip(F.regexp_extract(cell, r"^(.*?)(?:취미|특기)", 1)), r"[/\s]+$", "")).otherwise(cell)
    return x.strip(F.substring(before, 1, most))


def profile_value(value: Column, most: int = 120) -> Column:
    """A clipped value; null if it is a header, prose or empty."""
    prose = sum((value.contains(w).cast("int") for w in PROSE_MARKS), F.lit(0)) >= 2
    junk = x.squeezed(value).isin(HEADER_VALUES) | ((F.char_length(value) > 120) & prose)
    clipped = clip_scalar(value, most)
    return F.when(junk | (clipped == ""), None).otherwise(clipped)


def extract_profile_scalars(text: Column) -> Column:
    """struct(gender, disability, veteran, desired_location, desired_salary); null where a label isn't found or its value is noise."""
    plain = F.replace(text, F.lit("\r"), F.lit(""))
    first = lambda patterns: F.coalesce(*[profile_value(found(plain, p)) for p in patterns])
    gender = found(plain, GENDER)
    veteran = F.coalesce(*[F.when(~x.squeezed(v).rlike(r"^[\d.,·\[\]①②③]+$") | F.lit(i == 3), v) for i, v in enumerate(profile_value(found(plain, p)) for p in VETERAN)])
    location = first(LOCATION)
    mixed = (F.char_length(location) > 52) & location.rlike(r"보훈|장애\s*인|미해당\s*취미|취미\s*/\s*특기")
    return F.struct(
        F.when(gender.isin("여", "女", "여성"), "여").when(gender.isNotNull(), "남").alias("gender"), first(DISABILITY).alias("disability"), veteran.alias("veteran"),
        F.when(~F.coalesce(mixed, F.lit(False)), location).alias("desired_location"), F.when(found(plain, SALARY).isNotNull(), clip_scalar(found(plain, SALARY), 100)).alias("desired_salary"),
    )


def question_title(line: Column) -> Column:
    """A heading without number, bullets and outer brackets."""
    one = F.regexp_replace(x.strip(line), r"(?U)\s+", " ")
    bare = F.regexp_replace(F.regexp_replace(one, r"^[0-9]+\s*[.)．、]\s*", ""), rf"^[{BULLETS}]+\s*", "")
    return F.substring(F.regexp_replace(x.strip(bare), r"^\[(.+)\]$", "$1"), 1, 500)


def split_cover_letter(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, row_no, question, answer): a row per heading line and what follows it, at most 30; without a heading one row without question.

    A first line that repeats the heading and bullets left at the end go; rows without an answer go where there are several headings.
    Texts under 10 characters have no rows. Needs a unique key.
    """
    blocks = df.select(key, x.strip(F.replace(F.col(text), F.lit("\r"), F.lit(""))).alias("_t")).where(F.char_length("_t") >= 10)
    lines = blocks.select(key, F.posexplode(F.split("_t", "\n")).alias("n", "line")).withColumn("_h", F.col("line").rlike(HEADING))
    so_far = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_s", F.sum(F.col("_h").cast("int")).over(so_far)).withColumn("_all", F.sum(F.col("_h").cast("int")).over(Window.partitionBy(key)))
    body = F.transform(F.sort_array(F.collect_list(F.when(~F.col("_h"), F.struct("n", "line")))), lambda p: p["line"])
    rows = marked.where("_all = 0 OR _s > 0").groupBy(key, "_s", "_all").agg(question_title(F.max(F.when(F.col("_h"), F.col("line")))).alias("question"), F.array_join(body, "\n").alias("_b"))
    tight = lambda c: F.regexp_replace(x.squeezed(c), rf"^[{BULLETS}]+", "")
    start = F.regexp_replace("_b", r"^\s*\n", "")
    repeated = tight(question_title(F.regexp_extract(start, r"^[^\n]*", 0))) == tight(F.col("question"))
    rest = F.when(F.coalesce(repeated, F.lit(False)), F.regexp_replace(start, r"^[^\n]*\n?", "")).otherwise(F.col("_b"))
    answer = F.substring(x.strip(F.regexp_replace(rest, rf"(?:\s*\n\s*[{BULLETS}]+\s*)+$", "")), 1, MAX_ANSWER)
    kept = rows.withColumn("answer", answer).where("_all < 2 OR answer <> ''")
    order = Window.partitionBy(key).orderBy("_s")
    return kept.select(key, F.row_number().over(order).alias("row_no"), "question", "answer").where(F.col("row_no") <= MAX_LETTER_ROWS)
