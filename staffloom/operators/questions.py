"""Interview questions, their generation jobs, reviews, invitations and mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.functions import text as x
from staffloom.operators.scheduling import active, at

JOB_FIT, RESUME, POSITION = "candidate_job_fit_based", "candidate_resume_based", "position_based"
PASS_SCORE, REVISION_CAP, FAILURE_CAP = 85, 84, 70
UNFINISHED = ["queued", "running"]


def questions_for_target(questions: DataFrame, candidates: DataFrame, position_id: int | None = None, candidate_id: int | None = None) -> DataFrame:
    for name, value in (("position_id", position_id), ("candidate_id", candidate_id)):
        if value is not None:
            questions = questions.where(F.col(name) == value)
    return questions.join(candidates.select("candidate_id", F.col("name").alias("candidate_name")), "candidate_id", "left").orderBy("question_id")


def question_counts(questions: DataFrame) -> DataFrame:
    return questions.where("position_id IS NOT NULL").groupBy("position_id").agg(F.count("*").alias("n_questions"))


def resolve_batch(batch: DataFrame, candidates: DataFrame) -> DataFrame:
    """A candidate's own position wins over the item's; the default type follows from what is known."""
    rows = batch.join(candidates.select("candidate_id", F.col("position_id").alias("_own")), "candidate_id", "left").withColumn("position_id", F.coalesce("_own", "position_id")).drop("_own")
    default = F.when(F.col("candidate_id").isNotNull() & F.col("position_id").isNotNull(), JOB_FIT).when(F.col("candidate_id").isNotNull(), RESUME).otherwise(POSITION)
    return rows.withColumn("question_type", F.coalesce("question_type", default))


def new_questions(batch: DataFrame, existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Batch rows whose (type, stripped text) isn't stored for their target yet; the first of equal ones in order of seq.

    A null in the target matches any stored value; in the batch itself null equals null. The wildcard is split by which of the two
    are null into four equi-joins.
    """
    rows = resolve_batch(batch, candidates).withColumn("_text", x.strip(F.col("question_text")))
    stored = existing.select(F.col("candidate_id").alias("_c"), F.col("position_id").alias("_p"), F.col("question_type").alias("_t"), x.strip(F.col("question_text")).alias("_q")).where("_q IS NOT NULL AND _q <> ''")
    parts = []
    for c in (True, False):
        for p in (True, False):
            part = rows.where(F.col("candidate_id").isNotNull() == F.lit(c)).where(F.col("position_id").isNotNull() == F.lit(p))
            on = (F.col("question_type") == F.col("_t")) & (F.col("_text") == F.col("_q"))
            on = on & (F.col("candidate_id") == F.col("_c")) if c else on
            parts.append(part.join(stored, on & (F.col("position_id") == F.col("_p")) if p else on, "left_anti"))
    fresh = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    order = Window.partitionBy("candidate_id", "position_id", "question_type", "_text").orderBy("seq")
    return fresh.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_text")


def normalize_questions(questions: DataFrame, limit: int | None = None) -> DataFrame:
    """Texts stripped, blanks dropped, the first of equal texts in a job kept, then the first N. Needs job_id, seq, question_text."""
    rows = questions.withColumn("question_text", x.strip(F.col("question_text"))).where("question_text <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("job_id", "question_text").orderBy("seq"))).where("_n = 1").drop("_n")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy("seq")))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def question_shortfall(questions: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: job_id, n_wanted. Per job how many different questions there are, and the error of having fewer than asked for."""
    have = normalize_questions(questions).groupBy("job_id").agg(F.count("*").alias("n_questions"))
    rows = wanted.join(have, "job_id", "left").withColumn("n_questions", F.coalesce("n_questions", F.lit(0)).cast("long"))
    return rows.withColumn("error", F.when(F.col("n_questions") < F.col("n_wanted"), "too few questions"))


def active_job_per_owner(jobs: DataFrame) -> DataFrame:
    """The latest queued or running job of each owner; owner_kind is user or interviewer."""
    open_ = jobs.where(F.col("status").isin(UNFINISHED))
    users = open_.where("created_by_user_id IS NOT NULL").select(F.lit("user").alias("owner_kind"), F.col("created_by_user_id").alias("owner_id"), "job_id", "created_at")
    staff = open_.where("created_by_interviewer_id IS NOT NULL").select(F.lit("interviewer").alias("owner_kind"), F.col("created_by_interviewer_id").alias("owner_id"), "job_id", "created_at")
    order = Window.partitionBy("owner_kind", "owner_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    return users.union(staff).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def admit_jobs(requests: DataFrame, jobs: DataFrame, candidates: DataFrame, positions: DataFrame, interviewers: DataFrame) -> DataFrame:
    """requests: request_no, owner_kind (user, interviewer), owner_id, candidate_id, position_id. The first rule that each fails, else ok with the job's position.

    A user's job takes the candidate's own position, else the requested one, which must exist. An interviewer's job takes the interviewer's, which
    must be the candidate's too. Refused while the owner has a job that isn't done; of several sound requests of an owner the first is admitted.
    """
    busy = active_job_per_owner(jobs).select("owner_kind", "owner_id").withColumn("_busy", F.lit(True))
    staff = interviewers.select(F.lit("interviewer").alias("owner_kind"), F.col("interviewer_id").alias("owner_id"), F.col("position_id").alias("_staff"))
    people = candidates.select("candidate_id", F.col("position_id").alias("_own"), F.lit(True).alias("_person"))
    rows = requests.join(busy, ["owner_kind", "owner_id"], "left").join(staff, ["owner_kind", "owner_id"], "left").join(people, "candidate_id", "left")
    rows = rows.withColumn("_position", F.when(F.col("owner_kind") == "user", F.coalesce("_own", "position_id")).otherwise(F.col("_staff")))
    rows = rows.join(positions.select(F.col("position_id").alias("_position"), F.lit(True).alias("_exists")), "_position", "left")
    inter = F.col("owner_kind") == "interviewer"
    reason = (
        F.when(inter & F.col("_staff").isNull(), "no_owner_position").when(F.col("_busy").isNotNull(), "already_running").when(F.col("_person").isNull(), "unknown_candidate")
        .when(inter & ~F.col("_own").eqNullSafe(F.col("_staff")), "other_position").when(~inter & F.col("_exists").isNull(), "unknown_position")
    )
    rows = rows.withColumn("_reason", reason)
    turn = F.row_number().over(Window.partitionBy("owner_kind", "owner_id", F.col("_reason").isNull()).orderBy("request_no"))
    rows = rows.withColumn("reason", F.coalesce("_reason", F.when(turn > 1, "second_in_batch").otherwise("ok")))
    return rows.select("request_no", "owner_kind", "owner_id", "reason", F.when(F.col("reason") == "ok", F.col("_position")).alias("position_id"))


GENERATED = "array<struct<question_text:string,questionText:string,question_type:string,questionType:string>>"


def check_saved_questions(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """items: item_no, job_id, owner_user_id, candidate_id, position_id, question_type, question_text. The first rule that fails, else ok.

    jobs: result_questions as JSON text, keys in either spelling, the type by default job fit.
    """
    about = jobs.select("job_id", "status", F.col("created_by_user_id").alias("_owner"), F.col("candidate_id").alias("_c"), F.col("position_id").alias("_p"), F.lit(True).alias("_job"))
    results = jobs.select("job_id", F.explode(F.from_json("result_questions", GENERATED)).alias("q"))
    known = results.select("job_id", x.strip(F.coalesce(F.nullif("q.question_type", F.lit("")), F.nullif("q.questionType", F.lit("")), F.lit(JOB_FIT))).alias("question_type"), x.strip(F.coalesce(F.nullif("q.question_text", F.lit("")), F.col("q.questionText"))).alias("_text")).distinct().withColumn("_known", F.lit(True))
    rows = items.withColumn("_text", x.strip(F.col("question_text"))).join(about, "job_id", "left").join(known, ["job_id", "question_type", "_text"], "left")
    reason = (
        F.when(F.col("job_id").isNull(), "ok").when(F.col("_job").isNull(), "unknown_job").when(~F.col("_owner").eqNullSafe(F.col("owner_user_id")), "other_owner").when(F.col("status") != "succeeded", "not_finished")
        .when(~F.col("_c").eqNullSafe(F.col("candidate_id")), "other_candidate").when(F.col("_p").isNotNull() & ~F.col("_p").eqNullSafe(F.col("position_id")), "other_position").when(F.col("_known").isNull(), "not_generated").otherwise("ok")
    )
    return rows.select("item_no", reason.alias("reason"))


def review_questions(reviews: DataFrame, questions: DataFrame) -> DataFrame:
    """reviews: job_id, score, passed, question_count, severity. questions: job_id, seq, question_text. One row per job.

    Critical severity, a wrong number and equal texts are failures; major severity and a text without ``[ ]`` want revision.
    """
    texts = questions.select("job_id", x.strip(F.col("question_text")).alias("q"))
    stats = texts.groupBy("job_id").agg(F.count("*").alias("n"), F.count_distinct("q").alias("n_distinct"), F.count_if(~F.startswith("q", F.lit("[ ]"))).alias("n_bare"))
    rows = reviews.join(stats, "job_id", "left").fillna(0, ["n", "n_distinct", "n_bare"])
    severity = F.lower(x.strip(F.col("severity")))
    failure = (severity == "critical") | (F.col("n") != F.col("question_count")) | (F.col("n_distinct") < F.col("n"))
    revision = (severity == "major") | (F.col("n_bare") > 0)
    passed = F.col("passed") & (F.col("score") >= PASS_SCORE) & ~failure & ~revision
    capped = F.when(failure, F.least("score", F.lit(FAILURE_CAP))).when(~passed, F.least("score", F.lit(REVISION_CAP))).otherwise(F.col("score"))
    return rows.select("job_id", passed.alias("passed"), capped.cast("long").alias("score"), (F.col("n") - F.col("n_distinct")).alias("n_duplicates"), "n_bare")


def booking_invitation_status(tokens: DataFrame, invitations: DataFrame, bookings: DataFrame, now: str) -> DataFrame:
    """unknown, revoked, expired (at its time already), booked, usable; by token hash."""
    has = active(bookings).select("candidate_id").distinct().withColumn("_has", F.lit(True))
    rows = tokens.join(invitations.select("token_hash", "invitation_id", "candidate_id", "expires_at", "revoked_at"), "token_hash", "left").join(has, "candidate_id", "left")
    status = F.when(F.col("invitation_id").isNull(), "unknown").when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= at(now), "expired").when(F.col("_has").isNotNull(), "booked").otherwise("usable")
    return rows.select("token_hash", "invitation_id", status.alias("status"))


def interviewer_invite_status(tokens: DataFrame, invites: DataFrame, now: str) -> DataFrame:
    """unknown, revoked, expired (after its time only), ok with last_used_at; by token hash."""
    rows = tokens.join(invites.select("token_hash", "invite_id", "expires_at", "revoked_at"), "token_hash", "left")
    status = F.when(F.col("invite_id").isNull(), "unknown").when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") < at(now), "expired").otherwise("ok")
    return rows.select("token_hash", "invite_id", status.alias("status"), F.when(status == "ok", at(now)).alias("last_used_at"))


def active_invites(invites: DataFrame, now: str) -> DataFrame:
    """The newest invite of each interviewer that can be shown: not revoked, not expired, its token kept."""
    usable = invites.where(F.col("revoked_at").isNull() & (F.col("expires_at") > at(now)) & F.col("raw_token").isNotNull())
    order = Window.partitionBy("interviewer_id").orderBy(F.desc("created_at"), F.desc("invite_id"))
    return usable.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def invite_requests(requests: DataFrame, invites: DataFrame, interviewers: DataFrame, now: str) -> DataFrame:
    """requests: interviewer_id, expires_in_days. The invite that can still be shown is used again; else one is created, for an interviewer that exists."""
    usable = active_invites(invites, now).select("interviewer_id", "invite_id", F.col("expires_at").alias("_until"))
    rows = requests.join(usable, "interviewer_id", "left").join(interviewers.select("interviewer_id", F.lit(True).alias("_known")), "interviewer_id", "left")
    outcome = F.when(F.col("invite_id").isNotNull(), "reused").when(F.col("_known").isNull(), "not_found").otherwise("created")
    until = F.when(outcome == "reused", F.col("_until")).when(outcome == "created", at(now) + F.expr("make_dt_interval(expires_in_days)"))
    return rows.select("interviewer_id", outcome.alias("outcome"), "invite_id", until.alias("expires_at"))


def active_booking_invitations(invitations: DataFrame, now: str) -> DataFrame:
    """Each candidate's invitations that are neither revoked nor expired, the newest first, as an array of ids."""
    usable = invitations.where(F.col("revoked_at").isNull() & (F.col("expires_at") > at(now)))
    newest = F.sort_array(F.collect_list(F.struct("created_at", "invitation_id")), asc=False)
    return usable.groupBy("candidate_id").agg(F.transform(newest, lambda i: i["invitation_id"]).alias("invitation_ids"))


def slot_summaries(slots: DataFrame) -> DataFrame:
    """Per position the number of its slots and a line for each: time, round and place, by start; made once, not per recipient."""
    line = F.concat_ws(" · ", F.concat(F.date_format("interview_starts_at", "yyyy-MM-dd HH:mm"), F.lit(" - "), F.date_format("interview_ends_at", "HH:mm")), "interview_round", F.coalesce("interview_location", F.lit("장소 미정")))
    rows = slots.select("position_id", F.struct("interview_starts_at", "slot_id", line.alias("line")).alias("s"))
    return rows.groupBy("position_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["line"]), "\n").alias("slot_summary"), F.count("*").cast("string").alias("slot_count"))


def supersede_invitations(invitations: DataFrame) -> DataFrame:
    """An invitation neither revoked nor expired when its candidate gets the next one is revoked then."""
    after = F.lead("created_at").over(Window.partitionBy("candidate_id").orderBy("created_at", "invitation_id"))
    return invitations.withColumn("_next", after).withColumn("revoked_at", F.when(F.col("revoked_at").isNull() & (F.col("expires_at") > F.col("_next")), F.col("_next")).otherwise(F.col("revoked_at"))).drop("_next")


def mail_merge(recipients: DataFrame, template: DataFrame, extra: Column | None = None, slot_summary: str = "", slot_count: int = 0, label: str = "Interview booking link", names: tuple[str, ...] = ("invitation_url", "access_link")) -> DataFrame:
    """recipients: candidate_id, name, email, invitation_url and, where they differ, slot_summary and slot_count. template: one row, small by nature.

    The caller's variables win over the defaults. Returns subject, content and error; a recipient without e-mail is an error.
    """
    own = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in recipients.columns else F.lit(default)
    values = {"candidate_id": F.col("candidate_id").cast("string"), "candidate_name": F.col("name"), "recipient_name": F.col("name"), "candidate_email": F.col("email"), "invitation_url": F.col("invitation_url"), "access_link": F.col("invitation_url"), "slot_count": own("slot_count", str(slot_count)), "slot_summary": own("slot_summary", slot_summary)}
    return merged(recipients, template, values, extra, "invitation_url", label, list(names), "candidate_id")


def interviewer_mail_merge(recipients: DataFrame, template: DataFrame, extra: Column | None = None, label: str = "Interviewer access link") -> DataFrame:
    """recipients: interviewer_id, email, invite_url, availability_url. As ``mail_merge``, with the variables of interviewers."""
    values = {"interviewer_id": F.col("interviewer_id").cast("string"), "interviewer_email": F.col("email"), "invite_url": F.col("invite_url"), "access_link": F.col("invite_url"), "availability_url": F.col("availability_url"), "interviewer_response_url": F.col("availability_url")}
    return merged(recipients, template, values, extra, "invite_url", label, ["invite_url", "access_link"], "interviewer_id")


def merged(recipients: DataFrame, template: DataFrame, values: dict[str, Column], extra: Column | None, url: str, label: str, names: list[str], key: str) -> DataFrame:
    defaults = F.create_map(*[v for k, c in values.items() for v in (F.lit(k), c)])
    variables = defaults if extra is None else F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(extra, k)), extra)
    rows = recipients.withColumn("_k", F.lit(1)).join(F.broadcast(template.limit(1).select(F.lit(1).alias("_k"), F.col("subject").alias("_s"), F.col("body").alias("_b"))), "_k")
    rows = rows.withColumn("_subject", x.render_template(F.col("_s"), variables)).withColumn("_content", x.render_template(F.col("_b"), variables))
    error = F.coalesce(F.when(F.coalesce(F.col("email"), F.lit("")) == "", F.lit("no e-mail")), F.col("_subject.error"), F.col("_content.error"))
    content = x.include_link(F.col("_content.text"), F.col(url), label, names)
    return rows.select(key, "email", F.when(error.isNull(), F.col("_subject.text")).alias("subject"), F.when(error.isNull(), content).alias("content"), error.alias("error"))
