from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from staffloom.llm import collocations

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, absorbed=80, top=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        kept = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            if not inside[p] or 100 * inside[p] < absorbed * a:
                kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    few = [f"w{i}" for i in range(12)] + ["É", "Ünï", "中文", "\U0001f600"]
    said = ["New York City hall", "in spite of", "w1 w1 w1 w1 w1", "a\tb  c"]
    rows = [(None, "en"), ("", "en"), (" .,;\n", None), ("one", None)]
    for i in range(400):
        words = [rng.choice(said) if rng.random() < 0.3 else rng.choice(few) for _ in range(rng.randrange(1, 40))]
        rows.append(("".join(w + rng.choice([" ", " ", " ", ". ", "\n", "\t"]) for w in words), rng.choice(["en", "en", "en", "de", None])))
    return rows + [rows[10]] * 30


@pytest.mark.parametrize(("shard_words", "broadcast"), [(collocations.SHARD_WORDS, 1_000_000), (500, 0), (60, 0)])
def test_equal_to_brute_force(spark, corpus, shard_words, broadcast, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_PHRASES", broadcast)
    monkeypatch.setattr(collocations, "SLICE", 200 if shard_words == 60 else collocations.SLICE)  # shards of a few texts, many without a frequent triple
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in corpus], "text string, lang string, shard string, n int, pre int").repartition(5)
    assert rows_of(collocations.collocations(docs, shard_words=shard_words)) == brute(corpus, 30)
    assert rows_of(collocations.collocations(docs, least=3, top=50, shard_words=shard_words)) == brute(corpus, 3, top=50)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    assert rows_of(collocations.collocations(docs)) == brute([tuple(r) for r in docs.collect()], 30)


def test_nothing_to_find(spark, empty, docs):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs, least=10**6).count() == 0
    found, total = collocations.phrases(docs, least=10**6)
    assert found.count() == 0 and {r.lang for r in total.collect()} == {"en", "und"}


def test_intervals_of_both_transforms_stay_in_step():
    rng = np.random.default_rng(2)
    text = collocations.tight(np.where(rng.random(3000) < 0.1, 0, rng.integers(1, 6, 3000)))
    index = collocations.FMIndex(text, 6)
    found = index.grown(index.grown(index.grown(index.singles(), left=True), left=False), left=True)
    told = {tuple(w): n for w, n in zip(found.words.tolist(), found.count.tolist(), strict=True)}
    assert told == {p: n for p, n in Counter(zip(*(text[i:].tolist() for i in range(4)), strict=False)).items() if 0 not in p}
    for words, n, ahead, back in zip(found.words, found.count, found.ahead, found.back, strict=True):
        for rows, start, want in ((collocations.ordered(text, 4), ahead, words), (collocations.ordered(text[::-1], 4), back, words[::-1])):
            own = text if want is words else text[::-1]
            assert all((own[i : i + 4] == want).all() for i in rows[start : start + n])


@pytest.mark.parametrize("left", [True, False])
def test_phrases_that_grow_no_further_are_counted_without_intervals(left):
    rng = np.random.default_rng(4)
    text = collocations.tight(np.where(rng.random(2000) < 0.1, 0, rng.integers(1, 6, 2000)))
    index, plain = collocations.FMIndex(text, 6), collocations.FMIndex(text, 6)
    found, whole = index.grown(index.singles(), left, final=True), plain.grown(plain.singles(), left)
    assert (found.words == whole.words).all() and (found.count == whole.count).all()
    assert "pairs" not in vars(index.forward if left else index.reverse) and not len(found.ahead) and not len(found.back)
