"""Interval joins and clash flags against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from staffloom.operators import scheduling
from staffloom.operators.intervals import clash_flags, height, overlapping

SCHEMA = "{0}_id long, key string, {0}_s timestamp_ntz, {0}_e timestamp_ntz"


def spans(rng, n, longest):
    out = []
    for i in range(n):
        s = datetime(2024, 1, 1) + timedelta(minutes=30 * rng.randrange(48 * 40))
        length = 0 if rng.random() < 0.1 else rng.randrange(1, int(longest ** rng.random()) + 2)
        out.append((i, rng.choice(["a", "a", "a", "b", None]), s, s + timedelta(minutes=30 * length)))
    # one interval is much longer than the others, but where all are to be short
    return [*out, (n, "a", None, None), *([(n + 1, "a", datetime(1960, 1, 1), datetime(2040, 1, 1))] if longest > 200 else [])]


def meets(a, b):
    return None not in (a[1], a[2], b[1], b[2]) and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]


@pytest.mark.parametrize("longest", [4, 100, 200, 5_000])
def test_overlaps(spark, longest):
    rng = random.Random(longest)
    left, right = spans(rng, 150, longest), spans(rng, 120, longest)
    a, b = spark.createDataFrame(left, SCHEMA.format("l")), spark.createDataFrame(right, SCHEMA.format("r"))
    out = [(r.l_id, r.r_id) for r in overlapping(a, b, ["key"], ("l_s", "l_e"), ("r_s", "r_e")).collect()]
    assert sorted(out) == sorted((x[0], y[0]) for x in left for y in right if meets(x, y))


def test_an_interval_takes_part_by_the_logarithm_of_its_length(spark):
    from staffloom.operators.intervals import over

    year = spark.createDataFrame([(1, "a", datetime(2001, 1, 2, 5), datetime(2009, 3, 4))], SCHEMA.format("l"))
    top = height((year, "l_s", "l_e"))
    assert year.select(F.size(over("l_s", "l_e", top)).alias("n")).first().n <= 2 * (top + 1) < 30


@pytest.mark.parametrize("longest", [3, 60, 3_000])
def test_clash_flags(spark, longest):
    rng = random.Random(longest)
    rows = spans(rng, 200, longest)
    df = spark.createDataFrame(rows, SCHEMA.format("l"))
    same = lambda a, b: a[1] == b[1] and None not in (a[2], b[2]) and a[2] < b[3] and b[2] < a[3]  # noqa: E731  keys that are null are equal here
    out = {r.l_id: r.clash for r in clash_flags(df, ["key"], "l_s", "l_e").collect()}
    assert out == {a[0]: any(same(a, b) for b in rows if b is not a) for a in rows}
    asks, holds = F.col("l_id") % 3 == 0, F.col("l_id") % 3 != 0
    out = {r.l_id: r.clash for r in clash_flags(df, ["key"], "l_s", "l_e", asks, holds).collect()}
    assert out == {a[0]: any(same(a, b) for b in rows if b[0] % 3) for a in rows if not a[0] % 3}


def test_requests_clash_as_their_pairs_do(spark):
    rng = random.Random(9)
    made = [(rng.randrange(3), i // 2, rng.randrange(4), s, e) for i, _, s, e in spans(rng, 120, 40)[:-1]]
    times = spark.createDataFrame(made, "batch_id long, request_no long, interviewer_id long, starts_at timestamp_ntz, ends_at timestamp_ntz").dropDuplicates(["request_no", "interviewer_id"])
    held = spans(rng, 40, 40)[:-1]
    slots = spark.createDataFrame([(i, s, e) for i, _, s, e in held], "slot_id long, interview_starts_at timestamp_ntz, interview_ends_at timestamp_ntz")
    bridge = spark.createDataFrame([(i, rng.randrange(4)) for i, *_ in held], "slot_id long, interviewer_id long")
    out = {r.request_no: (r["_clash"], r["_held"]) for r in scheduling.clashing_requests(times, slots, bridge).collect()}
    pairs = scheduling.batch_conflicts(times).collect()
    within = {r.first_no for r in pairs} | {r.second_no for r in pairs}
    # two rows of one request with an interviewer are one request, which doesn't clash with itself
    known = {r.request_no for r in scheduling.interviewer_conflicts(times, slots, bridge).collect()}
    assert {n for n, (_, h) in out.items() if h} == known and {n for n, (c, _) in out.items() if c} == within


def test_flags_look_at_each_row_once_and_deal_rows_once(spark):
    """A frame up to the end of a key would be gone through anew for each row; and the join behind the windows needs no shuffle of the rows of its own."""
    df = spark.createDataFrame(spans(random.Random(1), 50, 40), SCHEMA.format("l"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = clash_flags(df, ["key"], "l_s", "l_e")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "unboundedfollowing" not in plan.lower()
    # the rows once; their spans for the groups, for the windows (the same deal or another) and for the join
    assert plan.count("Exchange hashpartitioning") <= 4
