"""Every declared constraint is broken by some row, and caught."""

from __future__ import annotations

from staffloom.fixtures import Tables
from staffloom.operators import quality as q
from staffloom.plans.audit import audited


def test_every_rule_is_broken_and_caught(spark):
    tables = audited(Tables(spark, "/root/testdata/sf0.001"))
    assert q.unchecked(tables) == [] and sum(len(q.rules(t)) for t in q.KEYS) == 129
    found = {(r.table_name, r.rule): r.n for r in q.audit_constraints(tables).groupBy("table_name", "rule").count().withColumnRenamed("count", "n").collect()}
    assert {(t, rule) for t in q.KEYS for rule in q.rules(t)} == set(found)


def test_rules_of_missing_columns_are_named(spark):
    users = spark.createDataFrame([(1, "a@b", None), (2, "a@b", "x")], "user_id long, user_email string, role string")
    tables = {"users": users}
    left_out = q.unchecked(tables)
    assert ("users", "required:user_name") in left_out and ("users", "required:role") not in left_out and ("positions", "unique:position_id") in left_out
    assert sorted(map(tuple, q.audit_constraints(tables).collect())) == [("users", "required:role", "1"), ("users", "unique_email", "a@b")]
    assert q.audit_constraints({"users": users.limit(0)}).count() == 0
