"""Reading from a database, and from text formats."""

from __future__ import annotations

import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from staffloom.sources.tables import key_bounds, read_table

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture
def base(spark):
    """An embedded database with bookings of sparse keys and invitations."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    bookings = spark.createDataFrame([(10 + 7 * i, i % 5, i, datetime(2024, 1, 1, i % 24), None if i % 3 else datetime(2024, 1, 2)) for i in range(300)], "booking_id long, slot_id long, candidate_id long, created_at timestamp_ntz, cancelled_at timestamp_ntz")
    invitations = spark.createDataFrame([(1, 5, "a", "[3, 4]"), (2, 6, "b", None)], "invitation_id long, candidate_id long, token_hash string, allowed_slot_ids string")
    for name, df in (("interview_bookings", bookings), ("interview_booking_invitations", invitations), ("positions", spark.createDataFrame([], "position_id long, position_name string"))):
        df.write.format("jdbc").option("url", url).option("dbtable", name).options(**DRIVER).save()
    return url, bookings


def test_database_tables_are_read_whole_in_ranges(spark, base):
    url, bookings = base
    df = read_table(spark, "interview_bookings", url, "jdbc", partitions=6, **DRIVER)
    assert key_bounds(spark, "interview_bookings", url, **DRIVER) == (10, 10 + 7 * 299) and df.rdd.getNumPartitions() == 6
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in bookings.collect()}
    sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 300 and max(sizes) <= 2 * min(sizes)
    narrow = read_table(spark, "interview_bookings", url, "jdbc", partitions=4, bounds=(100, 200), **DRIVER)
    assert narrow.count() == 300  # bounds cut ranges, not rows
    assert df.where("booking_id = 24").count() == 1 and "booking_id" in df.where("booking_id = 24")._jdf.queryExecution().executedPlan().toString()


def test_arrays_and_empty_tables_of_a_database(spark, base):
    url, _ = base
    rows = read_table(spark, "interview_booking_invitations", url, "jdbc", **DRIVER).orderBy("invitation_id").collect()
    assert [r.allowed_slot_ids for r in rows] == [[3, 4], None]
    assert read_table(spark, "positions", url, "jdbc", **DRIVER).count() == 0


def test_csv_by_the_schema(spark, tmp_path):
    (tmp_path / "interview_booking_invitations.csv").write_text('invitation_id,candidate_id,token_hash,expires_at,allowed_slot_ids,revoked_at,created_at\n1,2,x,2024-01-01 00:00:00,"[1,2]",,2024-01-01 00:00:00\nbad,2,y,,,,\n')
    rows = read_table(spark, "interview_booking_invitations", str(tmp_path), "csv").orderBy("token_hash").collect()
    assert [(r.invitation_id, r.allowed_slot_ids, r.expires_at) for r in rows] == [(1, [1, 2], datetime(2024, 1, 1)), (None, None, None)]
