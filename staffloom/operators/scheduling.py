"""Interview slots, bookings and interviewers: availability, occupancy, conflicts, validation, dashboards.

Times are KST wall clock; every operator takes ``now`` as text, so results repeat. Counts are aggregated before
joins, so no join multiplies rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.functions.text import strip
from staffloom.operators.intervals import clash_flags, overlapping
from staffloom.operators.products import product_join

ROUNDS = ["1차", "2차", "3차"]


def at(now: str) -> Column:
    return F.expr(f"timestamp_ntz'{now}'")


def day_of(now: str) -> tuple[Column, Column]:
    """The half-open KST day of a time."""
    return F.expr(f"timestamp_ntz'{now[:10]} 00:00:00'"), F.expr(f"timestamp_ntz'{now[:10]} 00:00:00' + INTERVAL 1 DAY")


def kst_range(column: str, year: int | None = None, month: int | None = None, day: int | None = None) -> Column:
    """Rows of a year, month or day (half-open). A month needs a year, a day both; a date that doesn't exist raises ValueError."""
    from datetime import date, timedelta

    if (month is not None and year is None) or (day is not None and month is None):
        raise ValueError("a month needs a year and a day needs a month")
    if year is None:
        return F.lit(True)
    start = date(year, month or 1, day or 1)
    end = start + timedelta(days=1) if day else date(year + month // 12, month % 12 + 1, 1) if month else date(year + 1, 1, 1)
    return (F.col(column) >= F.expr(f"timestamp_ntz'{start} 00:00:00'")) & (F.col(column) < F.expr(f"timestamp_ntz'{end} 00:00:00'"))


def attendance_status(now: Column, start: Column, end: Column) -> Column:
    return F.when(now < start, F.lit("응시 전")).when(now >= end, F.lit("응시 완료")).otherwise(F.lit("응시 중"))


def time_label(start: Column, end: Column) -> Column:
    return F.concat(F.date_format(start, "HH:mm"), F.lit(" - "), F.date_format(end, "HH:mm"))


def active(bookings: DataFrame) -> DataFrame:
    return bookings.where("cancelled_at IS NULL")


def booked(bookings: DataFrame) -> DataFrame:
    """Active bookings per slot."""
    return active(bookings).groupBy("slot_id").agg(F.count("*").alias("active_count"))


def effective_status(now: str) -> Column:
    """Closed if stored closed or past its deadline, full if nothing remains, else open; needs ``remaining``."""
    past = F.col("booking_deadline_at").isNotNull() & (F.col("booking_deadline_at") <= at(now))
    return F.when((F.col("slot_status") == "closed") | past, "closed").when(F.col("remaining") <= 0, "full").otherwise("open")


def slot_occupancy(slots: DataFrame, bookings: DataFrame, now: str) -> DataFrame:
    """All slots with active_count, has_active, remaining and effective_status."""
    joined = slots.join(booked(bookings), "slot_id", "left").withColumn("active_count", F.coalesce("active_count", F.lit(0)).cast("long"))
    sized = joined.withColumn("has_active", F.col("active_count") > 0).withColumn("remaining", F.greatest(F.lit(0), F.col("capacity") - F.col("active_count")).cast("long"))
    return sized.withColumn("effective_status", effective_status(now))


def available_slots(slots: DataFrame, bookings: DataFrame, now: str, position_id: int | None = None) -> DataFrame:
    """Open slots in the future whose deadline is open and that have room, by start and id."""
    wanted = slots.where((F.col("slot_status") == "open") & (F.col("interview_starts_at") > at(now)) & (F.col("booking_deadline_at").isNull() | (F.col("booking_deadline_at") > at(now))))
    if position_id is not None:
        wanted = wanted.where(F.col("position_id") == position_id)
    counted = wanted.join(booked(bookings), "slot_id", "left").withColumn("active_count", F.coalesce("active_count", F.lit(0)).cast("long"))
    return counted.withColumn("remaining", F.col("capacity") - F.col("active_count")).where("remaining > 0").orderBy("interview_starts_at", "slot_id")


def active_slot_count(slots: DataFrame, now: str) -> DataFrame:
    return slots.where(F.col("interview_ends_at") > at(now)).agg(F.count("*").alias("active_slots"))


def todays_bookings(slots: DataFrame, bookings: DataFrame, now: str) -> DataFrame:
    start, end = day_of(now)
    today = slots.where((F.col("interview_starts_at") >= start) & (F.col("interview_starts_at") < end))
    return active(bookings).select("booking_id", "slot_id", "candidate_id").join(today, "slot_id")


def todays_interviewees(slots: DataFrame, bookings: DataFrame, now: str) -> DataFrame:
    return todays_bookings(slots, bookings, now).agg(F.count_distinct("candidate_id").alias("interviewees"))


def todays_schedule(slots: DataFrame, bookings: DataFrame, candidates: DataFrame, positions: DataFrame, now: str) -> DataFrame:
    """The day's interviews with label and status, by start and booking."""
    rows = todays_bookings(slots, bookings, now).join(candidates.select("candidate_id", "name"), "candidate_id").join(positions.select("position_id", "position_name"), "position_id", "left")
    start, end = F.col("interview_starts_at"), F.col("interview_ends_at")
    return rows.select("booking_id", "slot_id", "candidate_id", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("position_name", F.lit("-")).alias("position_name"), time_label(start, end).alias("time_label"), attendance_status(at(now), start, end).alias("status"), "interview_starts_at").orderBy("interview_starts_at", "booking_id")


def slot_details(slots: DataFrame, bookings: DataFrame, bridge: DataFrame, interviewers: DataFrame, candidates: DataFrame, positions: DataFrame, now: str) -> DataFrame:
    """Slots with position, interviewer names, booked candidates and occupancy; children are gathered before they are joined."""
    names = bridge.join(interviewers.select("interviewer_id", "interviewer_name"), "interviewer_id").groupBy("slot_id").agg(F.sort_array(F.collect_list("interviewer_name")).alias("interviewer_names"))
    people = active(bookings).join(candidates.where("name IS NOT NULL").select("candidate_id", "name"), "candidate_id").groupBy("slot_id").agg(F.sort_array(F.collect_list("name")).alias("candidate_names"))
    none = F.array().cast("array<string>")
    rows = slot_occupancy(slots, bookings, now).join(positions.select("position_id", "position_name"), "position_id", "left").join(names, "slot_id", "left").join(people, "slot_id", "left")
    return rows.withColumn("interviewer_names", F.coalesce("interviewer_names", none)).withColumn("candidate_names", F.coalesce("candidate_names", none)).orderBy("interview_starts_at", "slot_id")


def interviewer_conflicts(requests: DataFrame, slots: DataFrame, bridge: DataFrame, own_slot: str | None = None) -> DataFrame:
    """Existing slots of the same interviewer that overlap a request (half-open), but for the request's own slot; intervals of any length."""
    held = bridge.join(slots.select("slot_id", F.col("interview_starts_at").alias("_held_from"), F.col("interview_ends_at").alias("_held_to")), "slot_id").withColumnRenamed("slot_id", "conflict_slot_id")
    pairs = overlapping(requests, held, ["interviewer_id"], ("starts_at", "ends_at"), ("_held_from", "_held_to"))
    if own_slot:
        pairs = pairs.where(~F.col("conflict_slot_id").eqNullSafe(F.col(own_slot)))
    return pairs.select(*requests.columns, "conflict_slot_id").distinct()


def batch_conflicts(requests: DataFrame) -> DataFrame:
    """Pairs within a batch with the same interviewer and overlapping times, the smaller request number first."""
    own = lambda n: requests.select("batch_id", "interviewer_id", F.col("request_no").alias(f"{n}_no"), F.col("starts_at").alias(f"_{n}_from"), F.col("ends_at").alias(f"_{n}_to"))
    pairs = overlapping(own("first"), own("second"), ["batch_id", "interviewer_id"], ("_first_from", "_first_to"), ("_second_from", "_second_to"))
    return pairs.where("first_no < second_no").select("batch_id", "interviewer_id", "first_no", "second_no").distinct()


def clashing_requests(times: DataFrame, slots: DataFrame, bridge: DataFrame) -> DataFrame:
    """times: batch_id, request_no, interviewer_id, starts_at, ends_at. Per request whether it overlaps another one of its batch (``_clash``), or an existing slot (``_held``), of one of its interviewers."""
    both = clash_flags(times, ["batch_id", "interviewer_id"], "starts_at", "ends_at", out="_clash").groupBy("request_no").agg(F.bool_or("_clash").alias("_clash"))
    held = bridge.join(slots.select("slot_id", F.col("interview_starts_at").alias("starts_at"), F.col("interview_ends_at").alias("ends_at")), "slot_id").select(F.lit(None).cast("bigint").alias("request_no"), "interviewer_id", "starts_at", "ends_at")
    rows = times.select("request_no", "interviewer_id", "starts_at", "ends_at").unionByName(held)
    taken = clash_flags(rows, ["interviewer_id"], "starts_at", "ends_at", F.col("request_no").isNotNull(), F.col("request_no").isNull(), "_held").groupBy("request_no").agg(F.bool_or("_held").alias("_held"))
    return both.join(taken, "request_no")


def assignment_check(slots: DataFrame, bridge: DataFrame, interviewers: DataFrame) -> DataFrame:
    """Assignments with ``valid``: the interviewer's position and round are the slot's (null equals null)."""
    people = interviewers.select("interviewer_id", F.col("position_id").alias("p"), F.col("interview_round").alias("r"))
    rows = bridge.join(slots.select("slot_id", "position_id", "interview_round"), "slot_id").join(people, "interviewer_id")
    return rows.select("slot_id", "interviewer_id", (F.col("position_id").eqNullSafe(F.col("p")) & F.col("interview_round").eqNullSafe(F.col("r"))).alias("valid"))


def assignable_interviewers(slots: DataFrame, interviewers: DataFrame) -> DataFrame:
    """For each slot how many interviewers have its position and round (null equals null)."""
    people = interviewers.groupBy("position_id", "interview_round").agg(F.count("*").alias("n"))
    people = people.withColumnsRenamed({"position_id": "_p", "interview_round": "_r"})
    rows = slots.select("slot_id", "position_id", "interview_round").join(people, F.col("position_id").eqNullSafe(F.col("_p")) & F.col("interview_round").eqNullSafe(F.col("_r")), "left")
    return rows.select("slot_id", F.coalesce("n", F.lit(0)).cast("long").alias("assignable"))


def missing_ids(requested: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(table.select(key), key, "left_anti")


def stale_assignments(slots: DataFrame, bridge: DataFrame, interviewers: DataFrame) -> DataFrame:
    """Assignments whose slot no longer has the interviewer's position and round, or where either is missing."""
    people = interviewers.select("interviewer_id", F.col("position_id").alias("p"), F.col("interview_round").alias("r"))
    rows = bridge.join(slots.select("slot_id", "position_id", "interview_round"), "slot_id").join(people, "interviewer_id")
    fits = F.coalesce((F.col("position_id") == F.col("p")) & (F.col("interview_round") == F.col("r")), F.lit(False))
    return rows.where(~fits).select("slot_id", "interviewer_id")


def active_bookings_by_position(slots: DataFrame, bookings: DataFrame, positions: DataFrame) -> DataFrame:
    rows = active(bookings).join(slots.select("slot_id", "position_id", "interview_round", "interview_starts_at"), "slot_id").join(positions.select("position_id", "position_name"), "position_id", "left")
    return rows.select("candidate_id", "booking_id", "slot_id", "position_id", "position_name", "interview_round").orderBy("candidate_id", "booking_id")


def invitation_slots(invitations: DataFrame, candidates: DataFrame, slots: DataFrame, bookings: DataFrame, now: str) -> DataFrame:
    """Per invitation the available slots of the candidate's position, cut to the allowed ones where any are named; without any each meets all of them."""
    free = available_slots(slots, bookings, now).select("slot_id", "position_id", "remaining")
    people = invitations.join(candidates.select("candidate_id", "position_id"), "candidate_id")
    named = people.where(F.size("allowed_slot_ids") > 0).withColumn("slot_id", F.explode(F.array_distinct("allowed_slot_ids"))).join(free, ["slot_id", "position_id"])
    every = product_join(people.where(F.coalesce(F.size("allowed_slot_ids"), F.lit(0)) <= 0).select("invitation_id", "position_id"), free, "position_id", "invitation_id")
    return named.select("invitation_id", "slot_id", "remaining").union(every.select("invitation_id", "slot_id", "remaining"))


def unavailable_slots(invitations: DataFrame, candidates: DataFrame, slots: DataFrame, bookings: DataFrame, now: str) -> DataFrame:
    """Slot ids named by an invitation that are not available to its candidate."""
    free = available_slots(slots, bookings, now).select("slot_id", "position_id")
    people = invitations.join(candidates.select("candidate_id", "position_id"), "candidate_id")
    return people.withColumn("slot_id", F.explode(F.array_distinct("allowed_slot_ids"))).join(free, ["slot_id", "position_id"], "left_anti").select("invitation_id", "slot_id")


def department_status(positions: DataFrame, candidates: DataFrame, slots: DataFrame, bookings: DataFrame, now: str) -> DataFrame:
    """Per position: applicants and booked interviews by experience, and the highest round in progress."""
    experienced = F.coalesce("experience_level", F.lit("신입")) == "경력"
    applicants = candidates.where("position_id IS NOT NULL").groupBy("position_id").agg(F.count_if(experienced).alias("experienced_applicants"), F.count_if(~experienced).alias("newcomer_applicants"))
    running = slots.where(F.col("slot_status").isin("open", "full") & (F.col("interview_ends_at") > at(now)))
    seats = active(bookings).select("slot_id", "candidate_id").join(running.select("slot_id", "position_id"), "slot_id").join(candidates.select("candidate_id", "experience_level"), "candidate_id")
    interviewees = seats.groupBy("position_id").agg(F.count_if(experienced).alias("experienced_interviewees"), F.count_if(~experienced).alias("newcomer_interviewees"))
    open_ = F.col("booking_deadline_at").isNull() | (F.col("booking_deadline_at") >= at(now)) | (F.col("interview_starts_at") <= at(now))
    rounds = running.where(open_ & F.col("interview_round").isin(ROUNDS)).groupBy("position_id").agg(F.max("interview_round").alias("_top"))
    rows = positions.select("position_id", "position_name").join(applicants, "position_id", "left").join(interviewees, "position_id", "left").join(rounds, "position_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("experienced_applicants", "newcomer_applicants", "experienced_interviewees", "newcomer_interviewees")]
    return rows.select("position_id", "position_name", *counts, F.coalesce(F.concat("_top", F.lit(" 면접 진행중")), F.lit("진행 중인 면접 없음")).alias("progress")).orderBy("position_id")


def dashboard_summary(candidates: DataFrame, slots: DataFrame, bookings: DataFrame, positions: DataFrame, now: str) -> DataFrame:
    """One row: applicants, distinct positions (none counts as one), today's interviewees, hiring teams."""
    teams = candidates.select("candidate_id", "position_id").join(positions.select("position_id", "position_name"), "position_id", "left")
    own = teams.agg(F.count("*").alias("total_applicants"), (F.count_distinct("position_id") + F.max(F.col("position_id").isNull().cast("int"))).cast("long").alias("active_positions"), F.count_distinct(F.coalesce("position_name", F.lit("미지정"))).alias("hiring_teams"))
    return own.withColumn("k", F.lit(1)).join(todays_interviewees(slots, bookings, now).withColumn("k", F.lit(1)), "k").drop("k")


def calendar_rollup(slots: DataFrame, bookings: DataFrame, now: str, shown: int = 3) -> DataFrame:
    """Per KST day: slots, numbers by status, the first three by start and how many more there are."""
    rows = slot_occupancy(slots, bookings, now).withColumn("day", F.to_date("interview_starts_at"))
    first = Window.partitionBy("day").orderBy("interview_starts_at", "slot_id")
    top = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= shown).groupBy("day").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "slot_id"))), lambda x: x["slot_id"]).alias("first_slots"))
    status = lambda s: F.count_if(F.col("effective_status") == s).alias(f"n_{s}")
    return rows.groupBy("day").agg(F.count("*").alias("n_slots"), status("open"), status("full"), status("closed")).join(top, "day").withColumn("n_rest", F.greatest(F.lit(0), F.col("n_slots") - shown).cast("long"))


def upcoming_per_interviewer(slots: DataFrame, bridge: DataFrame, now: str, limit: int = 20) -> DataFrame:
    """The next slots of each interviewer by start."""
    rows = bridge.join(slots.where(F.col("interview_starts_at") > at(now)).select("slot_id", "interview_starts_at"), "slot_id")
    order = Window.partitionBy("interviewer_id").orderBy("interview_starts_at", "slot_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fitness(each: DataFrame, interviewers: DataFrame, key: str) -> DataFrame:
    """Per request whether an interviewer is unknown, or has another position or round. each: key, interviewer_id, position_id, interview_round."""
    staff = interviewers.select("interviewer_id", F.col("position_id").alias("_p"), F.col("interview_round").alias("_r"), F.lit(True).alias("_known"))
    rows = each.join(staff, "interviewer_id", "left")
    fits = F.col("position_id").eqNullSafe(F.col("_p")) & F.col("interview_round").eqNullSafe(F.col("_r"))
    return rows.groupBy(key).agg(F.bool_or(F.col("_known").isNull()).alias("_missing"), F.bool_or(F.col("_known").isNotNull() & ~fits).alias("_unfit"))


def validate_slot_requests(requests: DataFrame, slots: DataFrame, bridge: DataFrame, interviewers: DataFrame, positions: DataFrame) -> DataFrame:
    """The first rule that a request fails, ``ok`` else, with the deadline (24 hours before the start) and the stripped location.

    requests: batch_id, request_no, position_id, interview_round, interviewer_ids, starts_at, ends_at, interview_location, capacity. Rules of
    the request itself come first, then conflicts within its batch, then what the tables say. They are read six times, so what is dear to derive is to be saved before.
    """
    each = requests.select("batch_id", "request_no", "position_id", "interview_round", F.explode(F.array_distinct("interviewer_ids")).alias("interviewer_id"), "starts_at", "ends_at")
    times = each.select("batch_id", "request_no", "interviewer_id", "starts_at", "ends_at")
    clash = clashing_requests(times, slots, bridge)
    known = positions.select("position_id", F.lit(True).alias("_position"))
    rows = requests.join(fitness(each, interviewers, "request_no"), "request_no", "left").join(clash, "request_no", "left").join(known, "position_id", "left")
    place, ids = strip(F.coalesce("interview_location", F.lit(""))), F.col("interviewer_ids")
    reason = (
        F.when(F.coalesce("position_id", F.lit(0)) <= 0, "bad_position").when(~F.coalesce(F.col("interview_round").isin(ROUNDS), F.lit(False)), "bad_round").when((F.array_min(ids) <= 0) | (F.size(F.array_distinct(ids)) < F.size(ids)), "bad_ids")
        .when((place == "") | (F.char_length("interview_location") > 255), "bad_location").when(F.coalesce("capacity", F.lit(0)) < 1, "bad_capacity").when(F.col("starts_at") >= F.col("ends_at"), "time_order").when(F.col("_clash"), "batch_conflict")
        .when(F.col("_position").isNull(), "unknown_position").when(F.col("_missing"), "unknown_interviewer").when(F.col("_unfit"), "not_eligible").when(F.col("_held"), "slot_conflict").otherwise("ok")
    )
    ok = reason == "ok"
    return rows.select("batch_id", "request_no", reason.alias("reason"), F.when(ok, F.col("starts_at") - F.expr("INTERVAL 24 HOUR")).alias("booking_deadline_at"), F.when(ok, place).alias("interview_location"), F.when(ok, "open").alias("slot_status"))


def validate_bookings(requests: DataFrame, candidates: DataFrame, slots: DataFrame, bookings: DataFrame, now: str) -> DataFrame:
    """The first rule that each booking request fails on its own, ``ok`` if none."""
    people = candidates.select("candidate_id", F.col("position_id").alias("_own"), F.lit(True).alias("_person"))
    has = active(bookings).select("candidate_id").distinct().withColumn("_has", F.lit(True))
    seats = slot_occupancy(slots, bookings, now).select("slot_id", "position_id", "slot_status", "booking_deadline_at", "interview_starts_at", "remaining", F.lit(True).alias("_slot"))
    rows = requests.join(people, "candidate_id", "left").join(has, "candidate_id", "left").join(seats, "slot_id", "left")
    past = F.col("booking_deadline_at") <= at(now)
    reason = (
        F.when(F.col("_person").isNull(), "unknown_candidate").when(F.col("_own").isNull(), "no_position").when(F.col("_has").isNotNull(), "already_booked").when(F.col("_slot").isNull(), "unknown_slot")
        .when(~F.col("_own").eqNullSafe(F.col("position_id")), "other_position").when(F.col("slot_status") != "open", "not_open").when(past, "deadline").when(F.col("interview_starts_at") <= at(now), "started").when(F.col("remaining") <= 0, "full").otherwise("ok")
    )
    return rows.select("request_no", "slot_id", "candidate_id", reason.alias("reason"), F.coalesce("remaining", F.lit(0)).alias("remaining"))


def replayed(pending: DataFrame) -> DataFrame:
    """Decisions of pending requests one after another, in one task."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        left, booked, told = {}, set(), []
        for row in rows.sort_values("request_no").itertuples():
            room = left.setdefault(row.slot_id, row.remaining)
            told.append("already_booked" if row.candidate_id in booked else "full" if room <= 0 else "admitted")
            if told[-1] == "admitted":
                booked.add(row.candidate_id)
                left[row.slot_id] -= 1
        return rows.sort_values("request_no")[["request_no", "slot_id", "candidate_id"]].assign(decision=told)

    kinds = dict(pending.dtypes)
    return pending.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(replay, ", ".join(f"{c} {kinds[c]}" for c in ("request_no", "slot_id", "candidate_id")) + ", decision string")


def admit_bookings(requests: DataFrame, candidates: DataFrame, slots: DataFrame, bookings: DataFrame, now: str, save, tail: int = 10_000) -> DataFrame:
    """Replays requests in order: one active booking per candidate, no more than a slot's capacity, earlier ones first. With the ``round`` of each decision.

    Rounds: a request is refused once its candidate is booked or its slot is full; it is admitted if it is its candidate's first
    pending one and among the pending of its slot stands within the room left. The earliest pending request is always decided, so
    the rounds end. A round reads and writes the pending requests only, with the room left of their slots; once no more than ``tail`` are pending, one task
    replays them in order, so long chains of a few requests take no rounds. save: writes a frame to shared storage and reads it back, which cuts the lineage.
    """
    said = ["request_no", "slot_id", "candidate_id", "decision"]
    checked = save(validate_bookings(requests, candidates, slots, bookings, now))
    done = [checked.where("reason <> 'ok'").select(*said[:3], F.col("reason").alias("decision"), F.lit(0).alias("round"))]
    pending = checked.where("reason = 'ok'").select(*said[:3], "remaining")
    number = 0
    while (count := pending.count()) > 0:
        number += 1
        if count <= tail:
            done.append(save(replayed(pending).withColumn("round", F.lit(number))))
            break
        most = pending.agg(F.max("remaining")).first()[0]
        first = pending.groupBy("candidate_id").agg(F.min("request_no").alias("request_no"))
        # of a slot no more than the most room of any is looked at, which each task cuts its rows to
        ranked = pending.withColumn("_rank", F.row_number().over(Window.partitionBy("slot_id").orderBy("request_no"))).where(F.col("_rank") <= F.lit(most)).where(F.col("_rank") <= F.col("remaining"))
        admitted = save(ranked.select("slot_id", "request_no", "candidate_id").join(first, ["candidate_id", "request_no"]))
        taken = admitted.select("candidate_id", F.col("request_no").alias("_by"))
        used = admitted.groupBy("slot_id").agg(F.count("*").alias("_used"))
        rest = pending.join(taken, "candidate_id", "left").join(used, "slot_id", "left").withColumn("remaining", F.col("remaining") - F.coalesce("_used", F.lit(0)))
        decision = F.when(F.col("_by") == F.col("request_no"), "admitted").when(F.col("_by").isNotNull(), "already_booked").when(F.col("remaining") <= 0, "full")
        step = save(rest.withColumn("decision", decision).select(*said, "remaining"))
        done.append(step.where("decision IS NOT NULL").select(*said, F.lit(number).alias("round")))
        pending = step.where("decision IS NULL").select(*said[:3], "remaining")
    return reduce(DataFrame.union, done)


def validate_cancellations(requests: DataFrame, slots: DataFrame, bookings: DataFrame, now: str) -> DataFrame:
    """requests: booking_id, candidate_id. Unknown or cancelled booking, other candidate, slot started, else ok with cancelled_at."""
    rows = requests.join(active(bookings).select("booking_id", F.col("candidate_id").alias("_owner"), "slot_id"), "booking_id", "left").join(slots.select("slot_id", "interview_starts_at"), "slot_id", "left")
    reason = F.when(F.col("_owner").isNull(), "no_active_booking").when(F.col("_owner") != F.col("candidate_id"), "other_candidate").when(F.col("interview_starts_at") <= at(now), "started").otherwise("ok")
    return rows.select("booking_id", "candidate_id", reason.alias("reason"), F.when(reason == "ok", at(now)).alias("cancelled_at"))


def generate_slot_grid(days: DataFrame, start_hour: int, end_hour: int, step: int, capacity: int) -> DataFrame:
    """Slots of ``step`` minutes (15 at least) that fit whole between two hours of each day; left-over minutes are reported."""
    if step < 15:
        raise ValueError("a step has 15 minutes at least")
    total = (end_hour - start_hour) * 60
    index = F.explode(F.sequence(F.lit(0), F.lit(total // step - 1)))
    base = F.col("day").cast("timestamp_ntz") + F.expr(f"INTERVAL {start_hour} HOUR")
    rows = days.select("day", index.alias("i"), base.alias("_b"))
    return rows.select("day", (F.col("_b") + F.expr(f"make_dt_interval(0, 0, i * {step})")).alias("starts_at"), (F.col("_b") + F.expr(f"make_dt_interval(0, 0, (i + 1) * {step})")).alias("ends_at"), F.lit(capacity).alias("capacity"), F.lit(total % step).alias("minutes_left"))


def apply_slot_update(slots: DataFrame, patches: DataFrame, bookings: DataFrame, bridge: DataFrame, interviewers: DataFrame, positions: DataFrame) -> DataFrame:
    """Slots after patches, with the first rule that a patch fails (the slot stays as it is then) and the assigned interviewers.

    patches: slot_id and new_<column> for position_id, interview_round, capacity, interview_location, starts_at, ends_at, interviewer_ids; null keeps the
    old. New interviewers must exist and have the slot's position and round; those that stay are cut to the ones that have it if position or
    round are patched. None may be busy in another slot at that time. The deadline follows the start by 24 hours.
    """
    now_ = bridge.groupBy("slot_id").agg(F.collect_set("interviewer_id").alias("_now"))
    rows = slots.join(patches, "slot_id").join(booked(bookings), "slot_id", "left").join(now_, "slot_id", "left").withColumn("_now", F.coalesce("_now", F.array().cast("array<bigint>")))
    news = {"_position": F.coalesce("new_position_id", "position_id"), "_round": F.coalesce("new_interview_round", "interview_round"), "_start": F.coalesce("new_starts_at", "interview_starts_at"), "_end": F.coalesce("new_ends_at", "interview_ends_at")}
    rows = rows.withColumns(news).withColumn("_set", F.col("new_interviewer_ids").isNotNull()).withColumn("_moved", F.col("new_position_id").isNotNull() | F.col("new_interview_round").isNotNull())
    asked = rows.select("slot_id", F.col("_position").alias("position_id"), F.col("_round").alias("interview_round"), "_start", "_end", "_set", "_moved", F.explode(F.coalesce("new_interviewer_ids", "_now")).alias("interviewer_id"))
    staff = interviewers.select("interviewer_id", F.col("position_id").alias("_p"), F.col("interview_round").alias("_r"), F.lit(True).alias("_known"))
    fits = F.col("position_id").eqNullSafe(F.col("_p")) & F.col("interview_round").eqNullSafe(F.col("_r"))
    marked = asked.join(staff, "interviewer_id", "left").withColumn("_fits", F.col("_known").isNotNull() & fits)
    state = marked.groupBy("slot_id").agg(F.bool_or(F.col("_known").isNull()).alias("_missing"), F.bool_or("_set").alias("_chosen"), F.bool_or(~F.col("_fits")).alias("_unfit"))
    kept = marked.where(F.col("_set") | ~F.col("_moved") | F.col("_fits"))
    people = kept.groupBy("slot_id").agg(F.sort_array(F.collect_set("interviewer_id")).alias("_people"))
    times = kept.where("_start < _end").select("interviewer_id", F.col("_start").alias("starts_at"), F.col("_end").alias("ends_at"), F.col("slot_id").alias("own"))
    held = interviewer_conflicts(times, slots, bridge, "own").select(F.col("own").alias("slot_id")).distinct().withColumn("_held", F.lit(True))
    known = positions.select(F.col("position_id").alias("_position"), F.lit(True).alias("_exists"))
    rows = rows.join(state, "slot_id", "left").join(people, "slot_id", "left").join(held, "slot_id", "left").join(known, "_position", "left")
    reason = (
        F.when(F.coalesce("active_count", F.lit(0)) > 0, "has_bookings").when(F.col("_position").isNull(), "no_position").when(F.col("_start") >= F.col("_end"), "time_order").when(F.col("_exists").isNull(), "unknown_position")
        .when(F.col("_missing"), "unknown_interviewer").when(F.col("_chosen") & F.col("_unfit"), "not_eligible").when(F.col("_held"), "slot_conflict").otherwise("ok")
    )
    keep = lambda new, old: F.when(reason == "ok", new).otherwise(F.col(old)).alias(old)
    capacity, place = F.coalesce(F.nullif("new_capacity", F.lit(0)), "capacity"), F.coalesce(F.nullif("new_interview_location", F.lit("")), "interview_location")
    none = F.array().cast("array<bigint>")
    return rows.select(
        "slot_id", reason.alias("reason"), keep(F.col("_position"), "position_id"), keep(F.col("_round"), "interview_round"), keep(capacity, "capacity"), keep(place, "interview_location"), keep(F.col("_start"), "interview_starts_at"),
        keep(F.col("_end"), "interview_ends_at"), keep(F.col("_start") - F.expr("INTERVAL 24 HOUR"), "booking_deadline_at"), F.coalesce(F.when(reason == "ok", F.col("_people")).otherwise(F.sort_array("_now")), none).alias("interviewer_ids"),
    )


def calendar_totals(slots: DataFrame, day: str) -> DataFrame:
    """One row: slots in the week (from Sunday) and in the month of a day."""
    date, start = F.to_date(F.lit(day)), F.to_date("interview_starts_at")
    week = F.date_sub(date, F.dayofweek(date) - 1)
    return slots.agg(F.count_if((start >= week) & (start < F.date_add(week, 7))).alias("n_week"), F.count_if(F.trunc(start, "MM") == F.trunc(date, "MM")).alias("n_month"))
