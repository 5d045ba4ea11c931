"""Candidates, resumes and positions: lists, duplicates, issues, experience, upserts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.functions import text as x
from staffloom.operators.products import product_join
from staffloom.operators.scheduling import active

# What makes a career no company employment, and what says that a period goes on.
EXCLUDED_CAREERS = ["인턴", "아르바이트", "파트타임", "교육", "훈련", "부트캠프", "프로젝트", "포트폴리오", "intern", "internship", "parttime", "part-time", "bootcamp", "project", "training"]
PRESENT = ["현재", "재직중", "현재재직", "present", "current", "ongoing", "now"]


def newest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def candidate_list(candidates: DataFrame, positions: DataFrame, position_id: int | None = None) -> DataFrame:
    rows = candidates if position_id is None else candidates.where(F.col("position_id") == position_id)
    rows = rows.join(positions.select("position_id", "position_name"), "position_id", "left")
    return rows.withColumn("meets_preferred_criteria", F.coalesce("meets_preferred_criteria", F.array().cast("array<string>"))).orderBy(F.desc("candidate_id"))


def current_booking(bookings: DataFrame) -> DataFrame:
    """The latest active booking of each candidate."""
    return newest(active(bookings), "candidate_id", F.desc("booking_id"))


def latest_resume(resumes: DataFrame) -> DataFrame:
    return newest(resumes, "candidate_id", F.desc("created_at"), F.desc("resume_id"))


def candidate_detail(candidates: DataFrame, positions: DataFrame, slots: DataFrame, bookings: DataFrame, invitations: DataFrame) -> DataFrame:
    """Candidates with their current booking, its slot, and their invitations, newest first."""
    seat = current_booking(bookings).select("candidate_id", "booking_id", "slot_id").join(slots.select("slot_id", "interview_round", "interview_starts_at"), "slot_id", "left")
    sent = invitations.groupBy("candidate_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "invitation_id")), asc=False), lambda i: i["invitation_id"]).alias("invitations"))
    return candidate_list(candidates, positions).join(seat, "candidate_id", "left").join(sent, "candidate_id", "left").withColumn("invitations", F.coalesce("invitations", F.array().cast("array<bigint>")))


def blocking_positions(positions: DataFrame, candidates: DataFrame) -> DataFrame:
    return positions.join(candidates.where("position_id IS NOT NULL").select("position_id"), "position_id", "left_semi")


def delete_slots(slots: DataFrame, bookings: DataFrame, bridge: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting slots; those with active bookings stay, others go with their bookings and assignments."""
    gone = ids.select("slot_id").distinct().join(active(bookings).select("slot_id"), "slot_id", "left_anti")
    return {"slots": slots.join(gone, "slot_id", "left_anti"), "bookings": bookings.join(gone, "slot_id", "left_anti"), "slot_interviewers": bridge.join(gone, "slot_id", "left_anti")}


def delete_positions(ids: DataFrame, positions: DataFrame, bridge: DataFrame, **referring: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting positions: references become null, assignments of their interviewers go."""
    gone = ids.select("position_id").distinct()
    mark = gone.withColumn("_gone", F.lit(True))
    clear = lambda df: df.join(mark, "position_id", "left").withColumn("position_id", F.when(F.col("_gone").isNull(), F.col("position_id"))).drop("_gone").select(*df.columns)
    out = {"positions": positions.join(gone, "position_id", "left_anti")} | {name: clear(df) for name, df in referring.items()}
    people = referring["interviewers"].join(gone, "position_id", "left_semi").select("interviewer_id")
    return out | {"slot_interviewers": bridge.join(people, "interviewer_id", "left_anti")}


def delete_interviewers(ids: DataFrame, interviewers: DataFrame, bridge: DataFrame, invites: DataFrame, questions: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting interviewers: their assignments and invites go, questions and jobs lose their author."""
    gone = ids.select("interviewer_id").distinct()
    mark = gone.select(F.col("interviewer_id").alias("created_by_interviewer_id"), F.lit(True).alias("_gone"))
    clear = lambda df: df.join(mark, "created_by_interviewer_id", "left").withColumn("created_by_interviewer_id", F.when(F.col("_gone").isNull(), F.col("created_by_interviewer_id"))).select(*df.columns)
    out = {name: df.join(gone, "interviewer_id", "left_anti") for name, df in (("interviewers", interviewers), ("slot_interviewers", bridge), ("interviewer_invites", invites))}
    return out | {"questions": clear(questions), "question_jobs": clear(jobs)}


def delete_candidates(ids: DataFrame, questions: DataFrame, **owned: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting candidates: what belongs to them goes (bookings, invitations, resumes, jobs), questions lose their candidate."""
    gone = ids.select("candidate_id").distinct()
    cleared = questions.join(gone.withColumn("_gone", F.lit(True)), "candidate_id", "left").withColumn("candidate_id", F.when(F.col("_gone").isNull(), F.col("candidate_id"))).select(*questions.columns)
    return {name: df.join(gone, "candidate_id", "left_anti") for name, df in owned.items()} | {"questions": cleared}


def candidates_for_interviewer(interviewers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of each interviewer's position; an interviewer without one has none."""
    pairs = product_join(candidates.select("candidate_id", "position_id"), interviewers.select("interviewer_id", "position_id"), "position_id", "candidate_id")
    return pairs.select("position_id", "interviewer_id", "candidate_id")


def candidate_access(requests: DataFrame, interviewers: DataFrame, candidates: DataFrame) -> DataFrame:
    """requests: interviewer_id, candidate_id. What an interviewer gets who asks for a candidate: ok, forbidden (no position, or another one) or not_found."""
    staff = interviewers.select("interviewer_id", F.col("position_id").alias("_own"), F.lit(True).alias("_staff"))
    people = candidates.select("candidate_id", F.col("position_id").alias("_theirs"), F.lit(True).alias("_person"))
    rows = requests.join(staff, "interviewer_id", "left").join(people, "candidate_id", "left")
    outcome = F.when(F.col("_staff").isNull() | F.col("_own").isNull(), "forbidden").when(F.col("_person").isNull(), "not_found").when(~F.col("_own").eqNullSafe(F.col("_theirs")), "forbidden").otherwise("ok")
    return rows.select("interviewer_id", "candidate_id", outcome.alias("outcome"))


def duplicates(df: DataFrame, name: Column, phone: Column, email: Column) -> DataFrame:
    """Adds is_duplicate: another row shares two of name, phone and e-mail. The three are normalized keys, empty for none.

    A pair of keys is grouped and counted; rows are never paired, so a key that many share costs no more than others.
    """
    rows = df.withColumn("_k", F.array(F.struct(name.alias("a"), phone.alias("b"), F.lit("np").alias("c")), F.struct(name.alias("a"), email.alias("b"), F.lit("ne").alias("c")), F.struct(phone.alias("a"), email.alias("b"), F.lit("pe").alias("c"))))
    rows = rows.withColumn("_k", F.filter("_k", lambda k: (k["a"] != "") & (k["b"] != "")))
    shared = rows.select(F.explode("_k").alias("_key")).groupBy("_key").count().where("count > 1").select("_key")
    hit = rows.select("candidate_id", F.explode("_k").alias("_key")).join(shared, "_key", "left_semi").select("candidate_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "candidate_id", "left").withColumn("is_duplicate", F.col("_hit").isNotNull()).drop("_k", "_hit")


def duplicate_candidates(candidates: DataFrame, mode: str = "identity") -> DataFrame:
    """mode: ``identity`` (aliases, white space and hyphens removed) or ``loose`` (letters, digits and Hangul only)."""
    c = F.col
    keys = (x.identity_value(x.without_alias(c("name"))), x.identity_value(c("phone")), x.identity_value(c("email"))) if mode == "identity" else (x.loose_key(c("name")), x.loose_key(c("phone")), x.loose_key(c("email")))
    return duplicates(candidates, *keys)


def position_missing() -> Column:
    return F.coalesce(x.strip(F.col("position_name")), F.lit("")) == ""


def applicant_issues(candidates: DataFrame, positions: DataFrame) -> DataFrame:
    """Candidates with the reasons why their record wants attention."""
    rows = candidates.join(positions.select("position_id", "position_name"), "position_id", "left")
    blank = lambda c: F.coalesce(x.strip(F.col(c)), F.lit("")) == ""
    reasons = F.array_compact(F.array(F.when(x.name_changes(F.col("name")), "이름 정제 필요"), F.when(position_missing(), "지원 공고 미지정"), F.when(blank("phone") & blank("email"), "연락처 누락")))
    return rows.withColumn("reasons", reasons).withColumn("has_issue", F.size("reasons") > 0)


def applicant_filter(rows: DataFrame, keyword: str = "", criteria: str = "ALL", position: str | None = None, missing: bool = False, duplicates_only: bool = False, issues_only: bool = False) -> DataFrame:
    """rows: candidates with position_name and, where asked for, is_duplicate and has_issue."""
    word = keyword.lower().replace("-", "")
    if keyword.strip():
        has = lambda c: F.coalesce(c.contains(word), F.lit(False))
        rows = rows.where(has(F.lower("name")) | has(F.replace("phone", F.lit("-"), F.lit(""))) | has(F.lower("email")))
    if criteria != "ALL":
        rows = rows.where((F.coalesce(F.size("meets_preferred_criteria"), F.lit(0)) > 0) == F.lit(criteria == "HAS"))
    if missing:
        rows = rows.where(position_missing())
    elif position is not None:
        rows = rows.where(x.strip(F.col("position_name")) == position)
    if duplicates_only:
        rows = rows.where("is_duplicate")
    return rows.where("has_issue") if issues_only else rows


def keyword_filter(df: DataFrame, columns: list[str], keyword: str, **equal) -> DataFrame:
    """Lower-case substring over the space-joined columns, and equality on others."""
    for c, value in equal.items():
        df = df.where(F.col(c) == value)
    word = keyword.strip().lower()
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(word)) if word else df


def employment_months(careers: DataFrame, now: str) -> DataFrame:
    """Per candidate the number of months in company employment, overlaps once, and the experience level (12 or more: 경력).

    Ranges are merged by a running maximum of ends; months are never listed.
    """
    this = int(now[:4]) * 12 + int(now[5:7])
    # each text is made once, in a projection of its own that Spark keeps apart, and met by one pattern
    once = lambda c, of: F.get(F.transform(F.array(c), of), F.lit(0))
    company = x.clean(F.col("company_name")).isNotNull() & ~once(F.concat_ws(" ", "company_name", "employment_type", "position"), lambda v: F.lower(x.squeezed(v)).rlike("|".join(EXCLUDED_CAREERS)))
    going_on = lambda c: once(F.col(c), lambda v: x.clean(v).isNotNull() & F.lower(x.squeezed(v)).rlike("|".join(PRESENT)))

    def month(c: str) -> Column:
        part = lambda v, i: F.regexp_extract(v, r"(\d{4})\D{0,4}(\d{1,2})", i).try_cast("int")
        return once(F.col(c), lambda v: once(part(v, 2), lambda m: F.when(m.between(1, 12), part(v, 1) * 12 + m)))

    rows = careers.where(company).select("candidate_id", month("start_date").alias("a"), F.least(F.when(going_on("end_date"), this).otherwise(month("end_date")), F.lit(this)).alias("b")).where("a <= b")
    order = Window.partitionBy("candidate_id").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    months = rows.withColumn("_new", F.greatest(F.lit(0), F.col("b") - F.greatest(F.coalesce(before, F.lit(0)), F.col("a") - 1))).groupBy("candidate_id").agg(F.sum("_new").alias("months"))
    return months.withColumn("experience_level", F.when(F.col("months") >= 12, "경력").otherwise("신입"))


def upsert_candidates(existing: DataFrame, intake: DataFrame, top: int | None = None) -> DataFrame:
    """Candidates after folding intake rows, in order of ``seq``, by (phone, name).

    Of several candidates with the key the smallest id is updated. Name, phone, gender, address and birth date are those last given; e-mail and
    position are filled where empty, by the first given; experience level and criteria are the last. A row without phone or
    name is always a new candidate; new ids follow the greatest one (or ``top``, where ``existing`` is a part of the candidates) in order of first appearance.
    """
    fields = ["name", "phone", "gender", "address", "date_of_birth", "email", "position_id", "experience_level", "meets_preferred_criteria"]
    fields = [f for f in fields if f in existing.columns or f in intake.columns]
    existing, intake = (df.withColumns({f: F.lit(None).cast("string") for f in fields if f not in df.columns}) for df in (existing, intake))
    own = existing.select("candidate_id", F.lit(-1).cast("long").alias("seq"), *fields)
    new = intake.select(F.lit(None).cast("long").alias("candidate_id"), F.col("seq").cast("long"), *fields)
    keyed = lambda df: df.withColumn("_p", x.clean(F.col("phone"))).withColumn("_m", x.clean(F.col("name")))
    whole = F.col("_p").isNotNull() & F.col("_m").isNotNull()
    own, new = keyed(own), keyed(new)
    target = own.where(whole).groupBy("_p", "_m").agg(F.min("candidate_id").alias("_target"))
    touched = own.where(whole).join(target, ["_p", "_m"]).where("candidate_id = _target").drop("_target")
    untouched = own.join(touched.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id", *fields)
    last = lambda c, given: F.max_by(c, F.when(given, F.col("seq"))).alias(c)
    first = lambda c, given: F.min_by(c, F.when(given, F.col("seq"))).alias(c)
    folded = touched.unionByName(new.where(whole)).groupBy("_p", "_m").agg(
        F.max("candidate_id").alias("candidate_id"), F.min("seq").alias("_first"),
        last("name", F.col("name").isNotNull()), last("phone", F.col("phone").isNotNull()), last("date_of_birth", F.col("date_of_birth").isNotNull()),
        *[last(c, x.clean(F.col(c)).isNotNull()) for c in ("gender", "address") if c in fields],
        first("email", x.clean(F.col("email")).isNotNull()), first("position_id", F.col("position_id").isNotNull()),
        F.max_by("experience_level", "seq").alias("experience_level"), F.max_by("meets_preferred_criteria", "seq").alias("meets_preferred_criteria"),
    )
    kept = folded.where("candidate_id IS NOT NULL").select("candidate_id", *fields)
    added = folded.where("candidate_id IS NULL").select("_first", *fields).unionByName(new.where(~whole).select(F.col("seq").alias("_first"), *fields))
    top = existing.agg(F.coalesce(F.max("candidate_id"), F.lit(0)).alias("_top")).first()["_top"] if top is None else top
    return untouched.unionByName(kept).unionByName(with_new_ids(added, top, fields, range_bounds(intake, "seq", PER_RANGE)))


#: Intake rows to a range of new ids.
PER_RANGE = 10_000


def range_bounds(rows: DataFrame, column: str, per_range: int, most: int = 1_000) -> list[float]:
    """Values that cut the rows into ranges of about ``per_range`` rows, whatever the values' spread; ``most`` ranges at most."""
    n = min(most, -(-rows.count() // per_range))
    return sorted(set(rows.approxQuantile(column, [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []


def with_new_ids(added: DataFrame, top: int, fields: list[str], bounds: list[float]) -> DataFrame:
    """Ids after ``top`` in order of ``_first``: rows are numbered within the ranges between ``bounds``, shifted by the earlier ranges' counts (at most 1,000 numbers).

    The bounds are those of the intake rows that the added ones come from, so no range has more rows than of those.
    """

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, values, side="right"))

    ranged = added.withColumn("_range", place(F.col("_first").cast("double")) if bounds else F.lit(0))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_c"))
    starts = counts.select(F.col("_range"), F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy("_first", "name")))
    return local.join(F.broadcast(starts), "_range").select((F.col("_n") + F.col("_s") + top).cast("long").alias("candidate_id"), *fields)


def page_after(df: DataFrame, keys: dict[str, bool], size: int, after: dict | None = None) -> DataFrame:
    """The page that follows the row ``after`` (its values of ``keys``; none: the first page) in the order of ``keys``: column names, True for descending.

    The keys together identify a row. Rows up to that one are filtered away before the sort, the leading key by a plain comparison that a scan
    can be pruned by, so a deep page costs what the first one does. Nulls come last and are found as values.
    """
    if after is not None:
        beyond = lambda c, down: (F.col(c) < F.lit(after[c]) if down else F.col(c) > F.lit(after[c])) | F.col(c).isNull() if after[c] is not None else F.lit(False)
        wanted, same = F.lit(False), F.lit(True)
        for c, down in keys.items():
            wanted, same = wanted | (same & beyond(c, down)), same & F.col(c).eqNullSafe(F.lit(after[c]))
        lead, down = next(iter(keys.items()))
        if after[lead] is not None:
            df = df.where((F.col(lead) <= F.lit(after[lead]) if down else F.col(lead) >= F.lit(after[lead])) | F.col(lead).isNull())
        df = df.where(F.coalesce(wanted, F.lit(False)))
    return df.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys.items()]).limit(size)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows of a page, one row with total and pages). Deep pages sort all before them; ``page_after`` doesn't."""
    total = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), total


def interviewer_order(key: str, descending: bool = False) -> list[Column]:
    """By a key, rounds by their number; null and blank always last."""
    value = F.regexp_extract("interview_round", r"(\d+)", 1).try_cast("int") if key == "interview_round" else F.when(x.strip(F.col(key).cast("string")) != "", F.col(key))
    return [value.desc_nulls_last() if descending else value.asc_nulls_last(), F.col("interviewer_id").asc()]


def sort_interviewers(interviewers: DataFrame, key: str, descending: bool = False) -> DataFrame:
    return interviewers.orderBy(*interviewer_order(key, descending))


def sort_applicants(candidates: DataFrame) -> DataFrame:
    """Adds rank: those past the documents first, then the newest."""
    passed = (F.coalesce("application_status", F.lit("")) != "서류").cast("int")
    return candidates.withColumn("_passed", passed).orderBy(F.desc("_passed"), F.desc("candidate_id")).drop("_passed")


def ranked(df: DataFrame, order: list[Column], per: Column, name: str = "rank") -> DataFrame:
    """The place of each row in an order, from 1, within a part of the table."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(per).orderBy(*order)))


def issue_totals(candidates: DataFrame, positions: DataFrame) -> DataFrame:
    """One row: candidates with an issue, and with a duplicate."""
    issues = applicant_issues(candidates, positions).agg(F.count_if("has_issue").alias("with_issue"), F.lit(1).alias("_k"))
    twice = duplicate_candidates(candidates, "loose").agg(F.count_if("is_duplicate").alias("with_duplicate"), F.lit(1).alias("_k"))
    return issues.join(twice, "_k").drop("_k")


def table_rows(items: DataFrame) -> DataFrame:
    """items: candidates with target_position, matched_position and raw_position. Adds position (the first of them given, else 미분류), criteria_met, email, is_duplicate."""
    given = [F.nullif(c, F.lit("")) for c in ("target_position", "matched_position", "raw_position")]
    rows = duplicate_candidates(items, "loose").withColumn("position", F.coalesce(*given, F.lit("미분류")))
    return rows.withColumn("criteria_met", F.coalesce(F.size("meets_preferred_criteria"), F.lit(0)) > 0).withColumn("email", F.coalesce(F.nullif("email", F.lit("")), F.lit("—")))


def page_summaries(candidates: DataFrame, positions: DataFrame, interviewers: DataFrame, now: str) -> DataFrame:
    """One row of figures for the list pages."""
    people = candidates.agg(F.count("*").alias("applicants"), F.count_if(F.size("meets_preferred_criteria") > 0).alias("with_criteria"), F.count_if(F.col("final_status") == "진행중").alias("in_progress"))
    recent = F.expr(f"timestamp_ntz'{now}' - INTERVAL 7 DAY")
    jobs = positions.agg(F.count("*").alias("positions"), F.count_if(F.col("created_at") >= recent).alias("recent_positions"))
    staff = interviewers.agg(F.count_if(F.col("position_id").isNotNull()).alias("with_position"), F.count_if(F.col("interview_round").isNotNull()).alias("with_round"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(people).join(one(jobs), "_k").join(one(staff), "_k").drop("_k")


def parse_batch_summary(files: DataFrame) -> DataFrame:
    """files: batch_id, error, after_cancel (a cancel request came before the file's turn). Per batch: files, processed ones, items, errors, status, percent.

    A bad file doesn't fail its batch; a cancelled batch keeps what was done until then.
    """
    done = ~F.coalesce("after_cancel", F.lit(False))
    sums = files.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(done).alias("processed"), F.count_if(done & F.col("error").isNull()).alias("items"), F.count_if(done & F.col("error").isNotNull()).alias("errors"))
    percent = F.least(F.lit(100), F.floor(F.col("processed") * 100 / F.col("total") + 0.5)).cast("int")
    return sums.withColumn("status", F.when(F.col("processed") < F.col("total"), "cancelled").otherwise("succeeded")).withColumn("percent", percent)


def resume_question_context(candidates: DataFrame, resumes: DataFrame, positions: DataFrame, requested_position: int | None = None) -> DataFrame:
    """Each candidate's latest resume and position (own, else the requested), with what is missing."""
    latest = latest_resume(resumes).select("candidate_id", "resume_id", "raw_text")
    rows = candidates.select("candidate_id", F.coalesce("position_id", F.lit(requested_position)).alias("position_id")).join(latest, "candidate_id", "left").join(positions.select("position_id", "position_name"), "position_id", "left")
    reason = F.when(F.col("resume_id").isNull(), "no_resume").when(F.col("position_name").isNull(), "no_position").otherwise("ok")
    return rows.withColumn("reason", reason).withColumn("context", x.redact_sensitive_lines(x.truncate(F.col("raw_text"), 6000)))
