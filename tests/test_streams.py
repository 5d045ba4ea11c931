"""Streams with state: candidates by batches, job states with an end."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from staffloom.operators import people
from staffloom.streaming import candidates, jobs

FIELDS = "name string, phone string, gender string, address string, date_of_birth date, email string, position_id long, experience_level string, meets_preferred_criteria array<string>"


def person(rng):
    pick = lambda *values: rng.choice(values)
    return (pick("Kim", " Kim ", "Lee", "Park", None, "-"), pick("1", "2", "3", "4", None), pick("남", None), pick("a", "b", ""), None, pick("x@y", None), pick(1, 2, None), pick("신입", "경력"), [pick("s", "t")])


def told(df):
    return sorted((r.candidate_id, *map(str, (r.name, r.phone, r.gender, r.address, r.email, r.position_id, r.experience_level, r.meets_preferred_criteria))) for r in df.collect())


@pytest.fixture
def made(spark):
    rng = random.Random(8)
    existing = spark.createDataFrame([(i, *person(rng)) for i in range(1, 13)], f"candidate_id long, {FIELDS}")
    return existing, [(i, *person(rng), "bad" if i % 11 == 0 else None) for i in range(60)]


def test_batches_make_the_table_that_one_fold_makes(spark, tmp_path, made):
    existing, rows = made
    schema, out = f"seq long, {FIELDS}, error string", str(tmp_path / "out")
    for k in range(4):
        spark.createDataFrame(rows[15 * k : 15 * k + 15], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        candidates.stream_candidates(stream, lambda b: b, existing, out, str(tmp_path / "c")).awaitTermination(300)  # stopped and started again
    whole = people.upsert_candidates(existing, spark.createDataFrame(rows, schema).where("error IS NULL").drop("error"))
    assert told(candidates.current_candidates(spark, out)) == told(whole)
    assert spark.read.parquet(f"{out}/errors").count() == 6
    # the last batch once more, by itself and after a merge of the others
    last = spark.createDataFrame(rows[45:], schema).where("error IS NULL")
    candidates.fold_batch(last, out, 3)
    assert told(candidates.current_candidates(spark, out)) == told(whole)
    candidates.compact(spark, out)
    assert len(candidates.committed(spark, out).numbers) == 2 and told(candidates.current_candidates(spark, out)) == told(whole)
    candidates.fold_batch(last, out, 3)
    candidates.compact(spark, out)
    assert told(candidates.current_candidates(spark, out)) == told(whole)


def test_a_batch_writes_what_it_changes(spark, tmp_path):
    out = str(tmp_path)
    many = spark.range(1, 3001).select(F.col("id").alias("candidate_id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.col("id").cast("string").alias("phone"), *[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in FIELDS.split(", ")[2:])])
    candidates.seed(many, out)
    candidates.seed(many.limit(1), out)  # a second start changes nothing
    batch = many.where("candidate_id IN (5, 6)").drop("candidate_id").withColumns({"seq": F.lit(1).cast("long"), "email": F.lit("a@b"), "error": F.lit(None).cast("string")})
    candidates.fold_batch(batch, out, 0)
    assert spark.read.parquet(f"{out}/candidates/version=0").count() == 2
    assert candidates.current_candidates(spark, out).where("email = 'a@b'").count() == 2 and candidates.current_candidates(spark, out).count() == 3000


def test_a_version_without_a_commit_is_not_seen(spark, tmp_path, made):
    existing, rows = made
    out = str(tmp_path)
    batch = spark.createDataFrame(rows[:15], f"seq long, {FIELDS}, error string").where("error IS NULL")
    assert candidates.current_candidates(spark, out) is None
    candidates.seed(existing.limit(0), out)
    candidates.fold_batch(batch.limit(0), out, 0)
    assert candidates.current_candidates(spark, out).count() == 0
    candidates.fold_batch(batch, out, 1)
    want = told(candidates.current_candidates(spark, out))
    existing.withColumn("bucket", candidates.bucket()).write.partitionBy("bucket").parquet(f"{out}/candidates/version=4")
    assert told(candidates.current_candidates(spark, out)) == want == told(people.upsert_candidates(existing.limit(0), batch.drop("error")))


EVENTS = "job_id long, seq long, ts timestamp_ntz, status string"


def run_jobs(spark, folder, checkpoint, seen, **times):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)

    def keep(batch, _):
        for r in batch.collect():
            seen.setdefault(r.job_id, []).append(r.status)

    query = jobs.stream_job_status(stream, **times).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return query.lastProgress


def test_job_states_end_by_timers_and_survive_a_restart(spark, tmp_path):
    day = lambda d, h=0: datetime(2024, 1, 1) + timedelta(days=d, hours=h)
    parts = [
        [(1, 1, day(0), "queued"), (1, 2, day(0, 1), "running"), (2, 3, day(0, 2), "queued"), (4, 4, day(0, 2), "running")],
        [(1, 5, day(1), "succeeded"), (1, 6, day(1, 1), "running"), (4, 7, day(1), "failed")],
        [(1, 8, day(1, 3), "failed"), (3, 9, day(1, 4), "running")],  # the end of job 1 stands
        [(9, 10, day(60), "queued")],  # all others are over
        [(9, 11, day(60, 1), "running")],
    ]
    seen: dict = {}
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (1, 2, 4):  # three runs, each from the checkpoint of the one before
            progress = run_jobs(spark, str(tmp_path / "in"), str(tmp_path / "c"), seen, keep=timedelta(days=2), idle=timedelta(days=10))
    assert seen == {1: ["running", "succeeded"], 2: ["queued", "expired"], 3: ["running", "expired"], 4: ["running", "failed"], 9: ["queued", "running"]}
    assert progress.stateOperators[0].numRowsTotal <= 4  # job 9 alone: its state and its timer


def test_job_states_equal_the_batch_twin(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(40), i, datetime(2024, 1, 1) + timedelta(minutes=i), rng.choice(["queued", "running", "running", "failed", "succeeded"])) for i in range(400)]
    for k in range(0, 400, 150):
        spark.createDataFrame(rows[k : k + 150], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen: dict = {}
    run_jobs(spark, str(tmp_path / "in"), str(tmp_path / "c"), seen)
    assert {j: s[-1] for j, s in seen.items()} == {r.job_id: r.status for r in jobs.job_status(spark.createDataFrame(rows, EVENTS)).collect()}
