"""Pages by key, and ids in order whatever the spread of the numbers they follow."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from staffloom.operators import people


@pytest.mark.parametrize("down", [(True, False), (False, True)])
def test_pages_by_key_are_the_pages_by_offset(spark, down):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), i) for i in range(53)]
    df = spark.createDataFrame(rows, "name string, id long").repartition(3)
    keys = {"name": down[0], "id": down[1]}
    order = [F.desc_nulls_last(c) if d else F.asc_nulls_last(c) for c, d in keys.items()]
    whole, last, got = [tuple(r) for r in people.page(df, order, 1, 100)[0].collect()], None, []
    while part := people.page_after(df, keys, 7, last).collect():
        got += [tuple(r) for r in part]
        last = part[-1].asDict()
    assert got == whole and len(got) == 53
    assert people.page_after(df.limit(0), keys, 7).count() == 0


def test_a_deep_page_is_a_pushed_filter(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    plan = people.page_after(spark.read.parquet(str(tmp_path / "t")), {"id": False}, 5, {"id": 900})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,900)" in plan


@pytest.mark.parametrize("spread", ["dense", "sparse", "lump"])
def test_new_ids_follow_the_order_in_ranges_of_like_size(spark, spread):
    rng = random.Random(1)
    numbers = {"dense": range(600), "sparse": [i * 10**12 + rng.randrange(10**9) for i in range(600)], "lump": [*range(599), 10**15]}[spread]
    rows = [(n, f"n{i}") for i, n in enumerate(numbers)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "_first long, name string").repartition(5)
    bounds = people.range_bounds(df, "_first", 100)
    assert 4 <= len(bounds) <= 6
    sizes = [sum(a < n <= b for n, _ in rows) for a, b in zip([float("-inf"), *bounds], [*bounds, float("inf")], strict=True)]
    assert max(sizes) <= 200
    out = {r.name: r.candidate_id for r in people.with_new_ids(df, 1000, ["name"], bounds).collect()}
    assert out == {name: 1001 + i for i, (_, name) in enumerate(sorted(rows))}
    assert people.with_new_ids(df.limit(0), 5, ["name"], bounds).count() == 0
