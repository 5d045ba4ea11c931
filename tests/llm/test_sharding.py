from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from staffloom.llm import sharding


def check(rows, n, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(by[s]) == list(range(len(by[s]))) for s in by)


def test_sizes_slots_and_groups(docs, texts):
    rows = sharding.place(docs.union(docs.where("doc_id = 7")), shards=5).collect()
    check(rows, len(texts) + 1, 5)
    where = defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        where[raw].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_larger_than_a_shard_is_cut_no_more_than_needed(spark):
    rows = [(i, "same" if i < 400 else f"t{i}") for i in range(1200)]
    out = sharding.place(spark.createDataFrame(rows, "doc_id long, text string"), shards=12).collect()
    check(out, 1200, 12)
    used = Counter(r.shard for r in out if r.doc_id < 400)
    assert len(used) <= 6  # at random all twelve; four can hold it


def test_all_linked_documents_move_by_even_exchange(spark):
    rows = [(i, f"pair {i // 2}") for i in range(960)]
    out = sharding.place(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    check(out, 960, 8)
    shard = {r.doc_id: r.shard for r in out}
    cut = sum(shard[2 * k] != shard[2 * k + 1] for k in range(480))
    assert cut < 96  # a random start cuts seven of eight


def test_whole_groups_where_there_is_room(spark):
    rows = [(i, f"group {i % 40}" if i < 240 else f"t{i}") for i in range(1000)]
    out = sharding.place(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    check(out, 1000, 6)
    where = defaultdict(set)
    for r in out:
        where[rows[r.doc_id][1]].add(r.shard)
    assert all(len(w) == 1 for w in where.values())


def test_few_rows_and_empty_table(spark, empty):
    assert sharding.place(empty, shards=4).count() == 0
    check(sharding.place(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), shards=4).collect(), 2, 4)


def test_quotas_exchange_evenly_and_fill_room():
    assert sharding.quotas({(0, 1): 5, (1, 0): 3}, {0: 0, 1: 1}) == {(0, 1): 4, (1, 0): 3}
