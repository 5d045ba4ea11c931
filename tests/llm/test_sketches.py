from __future__ import annotations

import random

from pyspark.sql import functions as F

from staffloom.llm import sketches
from tests.llm.conftest import prose


def shingles(text: str) -> set:
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(1)
    pairs = []
    for i in range(60):
        a, b = prose(i, 900).split(), prose(1000 + i, 900).split()
        cut = rng.randrange(900)
        pairs.append((i, " ".join(a), " ".join(a[:cut] + b[cut:])))
    df = spark.createDataFrame(pairs, "doc_id long, a string, b string").withColumn("sa", sketches.sketch(F.col("a"))).withColumn("sb", sketches.sketch(F.col("b")))
    out = df.select("a", "b", sketches.resemblance(F.col("sa"), F.col("sb")).alias("r"), sketches.containment(F.col("sa"), F.col("sb")).alias("c"), sketches.distinct_shingles(F.col("sa")).alias("n")).collect()
    error = [abs(r.r - len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a) | shingles(r.b))) for r in out]
    inside = [abs(r.c - len(shingles(r.a) & shingles(r.b)) / len(shingles(r.a))) for r in out]
    assert sum(error) / 60 < 0.08 and max(error) < 0.25 and sum(inside) / 60 < 0.15
    assert all(0.55 < r.n / len(shingles(r.a)) < 1.6 for r in out)


def test_merging_parts_gives_the_whole(spark):
    df = spark.createDataFrame([(1, prose(1, 300), prose(2, 300))], "g long, a string, b string")
    whole = sketches.bottom(F.concat(sketches.shingle_hashes(F.col("a")), sketches.shingle_hashes(F.col("b"))))
    r = df.select(sketches.merge(sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))).alias("m"), whole.alias("w")).first()
    assert r.m == r.w
    parts = spark.createDataFrame([(1, prose(i, 100)) for i in range(50)] + [(2, "x")], "g long, t string").select("g", sketches.sketch(F.col("t")).alias("s"))
    merged = {x.g: x.s for x in sketches.merge_groups(parts, ["g"], "s").collect()}
    every = sorted({h for x in parts.where("g = 1").collect() for h in x.s})
    assert merged[1] == every[:64] and len(merged[2]) == 1


def test_next_rows_in_order_with_ties_gaps_and_one_row(spark):
    rows = [(i, f"t{i}") for i in (5, 1, 9_999, 10_000, 77_000, 3)] + [(3, "t3b"), (3, "t3b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.text, r.next_text) for r in sketches.with_next(df, "doc_id", ["text"], per_range=10).collect())
    ordered = sorted(rows)
    assert out == sorted((a[0], a[1], b[1]) for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True))
    assert sketches.with_next(df.limit(0), "doc_id", ["text"]).count() == 0
    wide = spark.createDataFrame([(i * 10**12, f"w{i}") for i in range(50)] + [(None, "none")], "doc_id long, text string")
    found = {r.text: r.next_text for r in sketches.with_next(wide, "doc_id", ["text"], per_range=5).collect()}
    assert found == {f"w{i}": f"w{i + 1}" for i in range(49)} | {"w49": "none", "none": "w0"}
    clustered = spark.createDataFrame([(i, f"w{i}", "r", True) for i in [*range(400), 10**15]] + [(None, f"n{i}", "r", True) for i in range(30)], "doc_id long, text string, _range string, _copy boolean")
    found = sketches.with_next(clustered, "doc_id", ["text"], per_range=10)
    assert found.columns == [*clustered.columns, "next_text"]
    assert found.withColumn("part", F.spark_partition_id()).where("doc_id is null or doc_id < 400").groupBy("part").count().agg(F.max("count")).first()[0] < 300
    after = {r.text: r.next_text for r in found.collect()}
    assert len(after) == 431 and all(after[f"w{i}"] == f"w{i + 1}" for i in range(399)) and after["w399"] == f"w{10**15}" and after[f"w{10**15}"][0] == "n"
    assert sorted(after.values()) == sorted(after)  # a ring
    one = sketches.with_next(df.where("doc_id = 1"), "doc_id", ["text"]).collect()
    assert [(r.text, r.next_text) for r in one] == [("t1", "t1")]


def test_edges(spark, docs, texts):
    out = {r.doc_id: r.s for r in docs.select("doc_id", sketches.sketch(F.col("text")).alias("s")).collect()}
    assert out[100] == out[101] == out[102] == [] and len(out[103]) == 1 and out[105] == out[106] == out[5] if texts[5] == texts[105] else True
    df = spark.createDataFrame([(1, "", "abc"), (2, "abcde", "xy"), (3, "中文\U0001f600d", "é")], "i long, t string, n string")
    assert [r[0] for r in df.orderBy("i").select(sketches.edited(F.col("t"), F.col("n"))).collect()] == ["", "abcxy", "中文é"]
