"""The vector index against the exact search; the splitter against one written plainly."""

from __future__ import annotations

import random

import numpy as np
import pytest

from staffloom.operators import vectors
from staffloom.registry import queries


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    near = rng.normal(size=(40, 12))
    rows = [(i, (near[i % 40] + 0.3 * rng.normal(size=12)).tolist()) for i in range(1500)] + [(1500, None), (1501, (near[0]).tolist()), (1502, (near[0]).tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_all_probes_give_the_exact_result(corpus, metric):
    asked = corpus.where("vec_id % 50 = 0 OR vec_id > 1499")
    centres = vectors.fit_cells(corpus, 10, metric)
    found = vectors.search_index(asked, vectors.build_index(corpus, centres, metric), centres, 5, 10, metric, per_task=40)
    told = lambda df: {(r.query_id, r["rank"]): round(r.score, 4) for r in df.collect()}
    assert told(found) == told(vectors.topk_similar(asked, corpus, 5, metric)) and len(told(found)) == 32 * 5


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_recall_with_few_probes(corpus, metric):
    asked = corpus.where("vec_id % 50 = 0")
    centres = vectors.fit_cells(corpus, metric=metric)
    index = vectors.build_index(corpus, centres, metric)
    assert index.count() == 1502 and len(centres) == 39
    found = vectors.search_index(asked, index, centres, 5, 4, metric)
    assert vectors.recall(found, vectors.topk_similar(asked, corpus, 5, metric)) >= 0.9


def test_recall_on_the_given_vectors(spark):
    folder = "/root/testdata/sf0.01"
    assert vectors.recall(queries()["c19_topk_index"](spark, folder), queries()["c19_topk_similar"](spark, folder)) >= 0.9


def test_nothing_to_search(corpus):
    none = corpus.limit(0)
    centres = vectors.fit_cells(corpus, 4)
    assert vectors.search_index(none, vectors.build_index(corpus, centres), centres).count() == 0
    assert vectors.search_index(corpus, vectors.build_index(none, centres), centres).count() == 0
    assert len(vectors.fit_cells(none)) == 0


def split_plainly(text, size, overlap, separators):
    """The rules of the splitter as a list of steps, without its code: cut at the coarsest separator, cut long pieces finer, merge runs of short ones."""
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    pieces = [p for p in (text.split(sep) if sep else list(text)) if p]
    runs, out = [[]], []
    for p in pieces:
        if len(p) > size:
            runs += [p, []]
        else:
            runs[-1].append(p)
    for run in runs:
        if isinstance(run, str):
            out += split_plainly(run, size, overlap, rest)
            continue
        start = 0
        while start < len(run):
            end = start + 1
            while end < len(run) and len(sep.join(run[start : end + 1])) <= size:
                end += 1
            out.append(sep.join(run[start:end]).strip())
            if end == len(run):
                break
            # the next piece begins with as many of the last parts as fit the overlap, and leave room for the part that follows
            back = end
            while back > start and len(sep.join(run[back - 1 : end])) <= overlap and len(sep.join(run[back - 1 : end + 1])) <= size:
                back -= 1
            start = back if back > start else end
    return [o for o in out if o]


@pytest.mark.parametrize("seed", range(60))
def test_chunks_equal_a_plain_splitter(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.choice([1, 2, 3, 5, 9, 30 if seed % 3 == 0 else 4])))
    text = "".join(word() + rng.choice([" ", " ", " ", " ", "\n", "\n\n", "  "]) for _ in range(rng.randrange(80)))
    size = rng.choice([8, 20, 50, 120])
    overlap = rng.choice([0, 3, size // 4, size // 2])
    got = vectors.chunks(text, size, overlap)
    assert got == split_plainly(text, size, overlap, vectors.SEPARATORS)
    assert all(0 < len(c) <= size for c in got) and set("".join(got)) - {" ", "\n"} == set(text) - {" ", "\n"}
