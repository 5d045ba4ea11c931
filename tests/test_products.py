"""Joins on keys of few values against plain ones, and that a key's work is spread over tasks."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from staffloom.functions import text as x
from staffloom.operators import people, products, questions


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(i, [1, 1, 1, 2, None, 9][i % 6]) for i in range(300)], "a long, k long")
    right = spark.createDataFrame([(i, [1, 2, 2, None, 7][i % 5], f"n{i % 3}") for i in range(200)], "b long, k long, c string")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_join(sides, how):
    left, right = sides
    out = products.spread_join(left, right, "k", "a", how)
    rows = lambda df: sorted(map(str, df.select("a", "k", "b", "c").collect()))
    assert rows(out) == rows(left.join(right, "k", how))
    tasks = {r.p for r in out.where("k = 1").select(F.spark_partition_id().alias("p")).distinct().collect()}
    assert len(tasks) > 1


def test_mail_keeps_braces_of_values(spark):
    """A value is no template: what it holds in braces stays as it is."""
    persons = spark.createDataFrame([(7, "{slot_count}", "a@b.cc", "http://z")], "candidate_id long, name string, email string, invitation_url string")
    template = spark.createDataFrame([("s", "{candidate_name} {{x}} {slot_count} 　")], "subject string, body string")
    assert questions.mail_merge(persons, template, slot_count=3).first().content == "{slot_count} {x} 3\n\nInterview booking link: http://z"


def test_links_and_long_texts(spark):
    texts = [("see {url} or", "U", "see U or"), ("ends \n", "U", "ends\n\nL: U"), ("has U in", "U", "has U in"), ("a{b", "U", "a{b\n\nL: U"), (None, "U", None), ("", "U", "\n\nL: U"), ("x" * 100_000 + " ", "U", "x" * 100_000 + "\n\nL: U")]
    df = spark.createDataFrame([(i, t, u) for i, (t, u, _) in enumerate(texts)], "i int, t string, u string")
    assert [r.r for r in df.select("i", x.include_link(F.col("t"), F.col("u"), "L", ["url"]).alias("r")).orderBy("i").collect()] == [e for *_, e in texts]


def test_every_recipient_gets_all_slots_of_the_position(spark):
    slots = spark.createDataFrame([(i, 1 + i % 2, datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 10), "1차", "Room") for i in range(40)], "slot_id long, position_id long, interview_starts_at timestamp_ntz, interview_ends_at timestamp_ntz, interview_round string, interview_location string")
    crowd = spark.createDataFrame([(i, [1, 2, 3, None][i % 4]) for i in range(50)], "candidate_id long, position_id long")
    out = {r.candidate_id: r.slot_count for r in products.spread_join(crowd, questions.slot_summaries(slots), "position_id", "candidate_id", "left").collect()}
    assert out == {i: "20" if i % 4 < 2 else None for i in range(50)}


def test_product_join_lists_all_pairs_from_blocks(sides, monkeypatch):
    left, right = sides
    monkeypatch.setattr(products, "BLOCK", 3)
    out = products.product_join(left.union(left.limit(5)), right.union(right.limit(5)), "k", "a")
    rows = lambda df: sorted(map(str, df.select("a", "k", "b", "c").collect()))
    assert rows(out) == rows(left.union(left.limit(5)).join(right.union(right.limit(5)), "k"))
    assert len({r.p for r in out.where("k = 2").select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1


def test_candidates_of_one_position_are_listed_by_several_tasks(spark):
    staff = spark.createDataFrame([(i, 1 if i % 5 else None) for i in range(30)], "interviewer_id long, position_id long")
    crowd = spark.createDataFrame([(i, 1 if i % 7 else 2) for i in range(90)], "candidate_id long, position_id long")
    out = people.candidates_for_interviewer(staff, crowd)
    assert sorted((r.interviewer_id, r.candidate_id) for r in out.collect()) == [(i, c) for i in range(30) if i % 5 for c in range(90) if c % 7]
    assert len({r.p for r in out.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1


def test_resumes_of_a_small_file_are_read_by_many_tasks(spark, tmp_path):
    from staffloom.fixtures import Tables

    spark.range(40).selectExpr("id AS c_custkey", "'FURNITURE' AS c_mktsegment").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    t = Tables(spark, str(tmp_path))
    for df in (t.resume_texts, t.resume_tables):
        assert df.count() == 40 and len({r.p for r in df.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1
