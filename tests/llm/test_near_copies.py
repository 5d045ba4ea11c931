from __future__ import annotations

import random

import corpus_pipeline
from staffloom.llm import simhash

from .conftest import prose

SF = "/root/testdata/sf0.001"


def own_shingles(text: str | None) -> frozenset:
    found = (text or "").lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(len(found) - 5, 0) + 1)) if found else frozenset()


def near(a: frozenset, b: frozenset) -> bool:
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def planted(n: int) -> dict[int, str | None]:
    """Texts with copies in which some words are changed: similarities on both sides of 0.8; and blank and short ones."""
    rng, rows = random.Random(11), {}
    for i in range(n):
        first = prose(1000 + i, rng.choice([12, 40, 120, 400])).split()
        rows[10 * i] = " ".join(first)
        for j in range(1, 5):
            copy = list(first)
            for at in rng.sample(range(len(copy)), 1 + rng.randrange(max(1, len(copy) // 25))):
                copy[at] += "x"
            rows[10 * i + j] = " ".join(copy)
    return rows | {9001: None, 9002: " \n", 9003: "one two", 9004: "One  two", 9005: "one two three"}


def groups(sets: dict[int, frozenset]) -> dict[int, int]:
    ids, up = sorted(sets), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if near(sets[a], sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_the_stage_keeps_one_of_each_group_of_near_copies(spark):
    rows = planted(60)
    own = groups({i: own_shingles(t) for i, t in rows.items()})
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), SF).collect()}
    assert kept == set(own.values()) and 65 < len(kept) < 250


def test_recall_and_no_false_link(spark):
    rows = planted(60)
    sets = {i: own_shingles(t) for i, t in rows.items()}
    own = groups(sets)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(spark, rows), **corpus_pipeline.NEAR).collect()}
    assert found.keys() == own.keys()
    assert all(own[i] == own[c] for i, c in found.items())  # nothing that brute force holds apart
    pairs = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    assert len(pairs) > 100
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_a_large_group_in_shards_loses_no_link(spark):
    rng, base = random.Random(3), prose(1, 100).split()
    rows = {}
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(100), rng.randrange(1, 5)):
            copy[at] += str(i)
        rows[i] = " ".join(copy)
    own = groups({i: own_shingles(t) for i, t in rows.items()})
    docs = frame(spark, rows)
    values = docs.select("doc_id", simhash.summaries(docs.text, 5).alias("s")).selectExpr("doc_id AS least", "s.*")
    names = {r.value: r.least for r in values.collect()}
    for shard in (1024, 32):
        found = simhash.verified_links(values, docs.selectExpr("doc_id AS key", "text"), 20, 0.8, 5, shard).collect()
        assert all(near(own_shingles(rows[names[r.a]]), own_shingles(rows[names[r.b]])) for r in found)
        edges = spark.createDataFrame([(names[r.a], names[r.b]) for r in found], "a long, b long")
        labels = {r.node: r.component for r in simhash.components(edges).collect()}
        assert {i: labels.get(i, i) for i in rows} == own


def test_members_outside_the_largest_component_meet_all_shards(spark):
    """Two families share a search group; in shards of few members some links can only be found across shards."""
    rng, rows = random.Random(8), {}
    for family in range(3):
        base = prose(50 + family, 60).split()
        for i in range(30):
            copy = list(base)
            for at in rng.sample(range(60), rng.randrange(1, 3)):
                copy[at] += f"{family}x{i}"
            rows[100 * family + i] = " ".join(copy)
    own = groups({i: own_shingles(t) for i, t in rows.items()})
    docs = frame(spark, rows)
    values = docs.select("doc_id", simhash.summaries(docs.text, 5).alias("s")).selectExpr("doc_id AS least", "s.*")
    names = {r.value: r.least for r in values.collect()}
    sets = docs.select(simhash.shingle_bytes(docs.text, 5).alias("s")).select("s.*")
    one_group = values.selectExpr("0 AS b", "0L AS v", f"{len(names)}L AS n", "value", "fp")
    for bound in (64 << 20, 0):  # trees broadcast, and joined by shuffle
        found = simhash.searched(one_group, sets, 64, 0.8, 8, bound, per_pack=4).collect()
        edges = spark.createDataFrame([(names[r.a], names[r.b]) for r in found], "a long, b long")
        labels = {r.node: r.component for r in simhash.components(edges).collect()}
        assert {i: labels.get(i, i) for i in rows} == own


def test_the_stage_with_nulls_repeats_clashing_columns_and_empty(spark):
    text = prose(77, 80)
    rows = [(1, text, "en", "s", 1, "x"), (1, text + " more words", "en", "s", 1, "x"), (2, text, None, None, None, "x"), (None, text, "en", "s", 1, "x"), (None, prose(78, 50), "en", "s", 1, "x"), (3, None, "en", "s", 0, "x"), (4, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, text), (0, text), (0, prose(78, 50)), (3, "")])
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), SF).count() == 0
