from __future__ import annotations

import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from staffloom.llm import quality


def brute(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


CASES = ["", None, "a b", "x\ny\nx\n\n \n \n", "a b c d e a b c d e f", "a a a a a a a", "#*$ é ü | <>\x1c", "p q r s t u " * 40, "ab\x85cd\vef"]


@pytest.mark.parametrize("text", CASES)
def test_measures_match_brute_force(text):
    assert quality.measure_text(text)[:5] == brute(text)


def test_measures_match_over_table(docs, texts):
    for r in quality.measured(docs).select("doc_id", "_m", "_base_failed").collect():
        own = brute(texts[r.doc_id])
        assert tuple(r._m)[:5] == own
        assert r._base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])


def test_binomial_cdf_is_exact():
    for n, k, p in [(10, 0, 0.1), (50, 3, 0.05), (7, 7, 0.5), (0, 0, 0.1)]:
        assert quality.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_long_texts_are_counted_by_numbers(monkeypatch):
    texts = [t for t in CASES if t] + ["q w e r t y " * 9 + "z " * 3, " ".join(str(i % 97) for i in range(500))]
    plain = [quality.measure_text(t) for t in texts]
    monkeypatch.setattr(quality, "LONG", 0)
    assert [quality.measure_text(t) for t in texts] == plain


def test_cutoffs_bound_false_rejection():
    cuts = quality.proposals({i: (0, 100) for i in range(10)} | {20: (0, 2), 50: (90, 0)}, 0.01)
    assert cuts == sorted(cuts, reverse=True) and cuts[quality.PATH.index(("above", 20))] == 40 and cuts[quality.PATH.index(("share", 5))] == 9
    assert set(quality.proposals({3: (5, 20), 2: (5, 20)}, 0.01)[:5]) == {quality.STEPS}  # no gain: off
    assert quality.proposals({}, 0.01) == [quality.STEPS] * len(quality.PATH)
    n = len(quality.PATH)
    assert quality.chosen([0] * 4 + [9] * (n - 4), [10, 20, 30, 40] + [90] * (n - 4), 100, 100, 0.05, 0.0125, 0.01) == 3  # the ninth good text ends the walk
    assert quality.chosen([0] * n, [90] * n, 84, 100, 0.05, 0.0125, 0.01) == 0 - 1  # too few to certify anything
    assert quality.chosen([0] * n, [90] * n, 86, 100, 0.05, 0.0125, 0.01) == 0


def test_good_texts_kept_apart_stay(spark):
    """Rejection of good texts that no cutoff has seen stays under the limit in every stratum; copies don't count as evidence."""
    import random

    rng = random.Random(5)
    text = lambda noise: " ".join(w + ("$" if rng.random() < noise else "") for w in rng.choices([f"w{i}" for i in range(400)], k=60))
    rows = [(i, text(0.02 + 0.3 * (i % 5 == 0) * rng.random()), "ab"[i % 2], int(i % 5 > 0)) for i in range(3000)]
    docs = spark.createDataFrame([r[:3] for r in rows] + [(10_000 + i, rows[1][1], "c") for i in range(500)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows[:2000]] + [(10_000 + i, 1) for i in range(500)], "doc_id long, quality int")
    found = quality.measured(docs)
    cutoffs = quality.fit_cutoffs(found, labels)
    assert {r.stratum for r in cutoffs.collect()} <= {"a", "b"}
    kept = {r.doc_id for r in quality.apply_cutoffs(found, cutoffs).where("kept").collect()}
    for lang in "ab":
        apart = [r for r in rows[2000:] if r[2] == lang]
        good, bad = [r for r in apart if r[3]], [r for r in apart if not r[3]]
        assert sum(r[0] not in kept for r in good) <= 0.05 * len(good) and sum(r[0] not in kept for r in bad) > 0.4 * len(bad)


def test_rules_reject_what_labels_call_bad(spark):
    clean = [(i, f"clean words number {i} of plain prose that goes on for a while here", "en") for i in range(1500)]
    noisy = [(5000 + i, f"noisy$$ words## number&& {i} of|| junk** prose%% that<< goes>> on## for$$ a", "en") for i in range(200)]
    docs = spark.createDataFrame(clean + noisy, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in clean] + [(i, 0) for i, *_ in noisy] + [(9, None)], "doc_id long, quality int")
    found = quality.measured(docs)
    kept = {r.doc_id for r in quality.apply_cutoffs(found, quality.fit_cutoffs(found, labels)).where("kept").collect()}
    assert kept == {i for i, *_ in clean}


def test_null_strata_empty_tables_and_no_labels(spark, docs, empty):
    found, none = quality.measured(docs), spark.createDataFrame([], "doc_id long, quality int")
    out = quality.apply_cutoffs(found, quality.fit_cutoffs(found, none))
    assert out.count() == docs.count() and out.where(F.col("kept") == F.col("_base_failed")).count() == 0
    assert quality.apply_cutoffs(quality.measured(empty), quality.fit_cutoffs(quality.measured(empty), none)).count() == 0
