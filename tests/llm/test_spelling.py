from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from staffloom.llm import queries, spelling

ALPHABET = "abcdeéz"


def neighbours(word, alphabet):
    cut = {word[:i] + word[i + 1 :] for i in range(len(word))}
    put = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return (cut | put | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}) - {word}


def brute(counts, ratio=5):
    alphabet, out = {c for w in counts for c in w}, {}
    for word, n in counts.items():
        near = [w for w in neighbours(word, alphabet) if w in counts]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        out[word] = [best if best and counts[best] >= ratio * n else None, word, n, len(near)]
    for word, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
        row.append(counts[row[0]] if row[0] else None)
    return {w: tuple(r) for w, r in out.items()}


def told(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def some_words(rng, n):
    out = {}
    while len(out) < n:
        word = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([6, 6, 7, 7, 8, 9, 10, 11, 12, 15, 40])))
        for _ in range(rng.randrange(6)):
            out[word] = int(5 * 4 ** (rng.random() * 6))
            word = rng.choice(sorted(w for w in neighbours(word, ALPHABET) if len(w) >= 6))
    return out


@pytest.mark.parametrize(("share", "long_list"), [(spelling.SHARE, spelling.LONG_LIST), (1 / 50, 3), (1 / 2000, 1)])
def test_equal_to_brute_force(spark, share, long_list):
    counts = some_words(random.Random(share), 1500) | {"aaaaaa": 10**9, "aaaaab": 5, "aaaaabc": 5, "aaaaaaaa": 5}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert told(spelling.variants(words, share=share, long_list=long_list)) == brute(counts)


def test_dense_words_and_long_lists(spark):
    """All words of six letters out of three: every list is long."""
    counts = {"".join(ALPHABET[(i // 3**k) % 3] for k in range(6)): 5 + i for i in range(3**6)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert told(spelling.variants(words, long_list=2)) == brute(counts)


@pytest.mark.parametrize("seed", range(40))
def test_bounds_leave_a_gram_that_no_edit_affects(seed):
    rng = random.Random(seed)
    inner = {"".join(rng.choice(ALPHABET + "^$") for _ in range(rng.randrange(2, 6))): 9 for _ in range(rng.choice([0, 200, 5000]))}
    for _ in range(40):
        word = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(6, 16)))
        whole, longest = spelling.bordered(word), spelling.reach(len(word))
        grams = spelling.decomposed(whole, inner, longest)
        replaced, inserted = spelling.affected(grams, len(whole), longest)
        assert replaced < len(grams) and inserted < len(grams)
        own = {(p, whole[p : p + q]) for p, q in grams}
        for other in rng.sample(sorted(neighbours(word, ALPHABET)), 30):
            if len(other) < len(word):
                continue
            theirs = {(p, spelling.bordered(other)[p : p + q]) for p, q in spelling.decomposed(spelling.bordered(other), inner, longest)}
            kept = own & theirs if len(other) == len(word) else {(p, g) for p, g in own if {(p, g), (p + 1, g)} & theirs}
            assert len(kept) >= len(grams) - (replaced if len(other) == len(word) else inserted)


def brute_words(rows, least=5):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{key}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= least}


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert told(queries.queries()["op13_spelling_variants"](spark, "/root/testdata/sf0.001")) == brute(brute_words(rows))


def test_nulls_empties_and_clashing_columns(spark, docs, empty, texts):
    more = docs.withColumns({"word": F.lit("x"), "n": F.lit(1), "key": F.lit(2)})
    found = {r.word: r.n for r in spelling.counted_words(more, least=1, thinned=199).collect()}
    assert found == brute_words([(i, t) for i, t in texts.items()], 1) and len(found) == 6
    assert spelling.variants(spelling.counted_words(empty)).count() == 0
    assert {r.word for r in spelling.counted_words(more.withColumn("doc_id", F.lit(None).cast("long")), least=1, thinned=199).collect()} == set(brute_words([("", t) for t in texts.values()], 1))
