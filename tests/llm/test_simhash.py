from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from staffloom.llm import simhash


def brute(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps: dict[int, int], radius: int) -> dict[int, int]:
    ids, up = sorted(fps), {i: i for i in fps}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_table_matches_brute_force(docs, texts):
    rows = simhash.near_duplicates(docs.union(docs.where("doc_id = 9"))).collect()
    fps = {i: brute(t) for i, t in texts.items()}
    assert all(r.fp % (1 << 64) == fps[r.doc_id] for r in rows) and len(rows) == len(texts) + 1
    own = groups(fps, 2)
    assert all(r.component_id == own[r.doc_id] for r in rows)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:60]:  # chains of near ones
        for _ in range(4):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(v)
    values = sorted(values)
    own = groups(dict(enumerate(values)), 2)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    place = {v: i for i, v in enumerate(values)}
    for shard in (4096, 16):  # whole groups, and groups cut into shards
        up = list(range(len(values)))

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for r in simhash.links(frame, 2, shard).collect():
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            assert (a ^ b).bit_count() <= 2
            x, y = root(place[a]), root(place[b])
            up[max(x, y)] = min(x, y)
        assert {i: root(i) for i in range(len(values))} == own


def test_a_hot_block_loses_no_link(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = sorted({base ^ rng.getrandbits(22) for _ in range(1500)})  # all share two blocks
    own = groups(dict(enumerate(values)), 2)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    rows = [(r.a, r.b) for r in simhash.links(frame, 2, 128).collect()]
    assert len(rows) < 40 * len(values)  # a forest per pair of shards, not all pairs
    labels = {r.node: r.component for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    signed = {v: (v - (1 << 64) if v >> 63 else v) for v in values}
    same = {}
    for i, v in enumerate(values):
        same.setdefault(own[i], set()).add(labels.get(signed[v], signed[v]))
    assert all(len(s) == 1 for s in same.values()) and len({next(iter(s)) for s in same.values()}) == len(same)


def test_bk_tree_search_matches_scan():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 12, 500).astype(np.uint64))
    queries = rng.integers(0, 1 << 12, 200).astype(np.uint64)
    found = {(int(q), int(t)) for a, b in simhash.search(simhash.bk_tree(values), queries, 2) for q, t in zip(a, b, strict=True)}
    assert found == {(i, j) for i, q in enumerate(queries) for j, v in enumerate(values) if int(q ^ v).bit_count() <= 2}


def test_components_of_a_long_path_and_empty(spark, empty):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {(r.component) for r in simhash.components(path).collect()} == {0}
    assert simhash.near_duplicates(empty).count() == 0
