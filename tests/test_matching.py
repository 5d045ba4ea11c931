"""Matches of terms and positions by joins of pieces, against the rules written out."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from staffloom.operators import matching

WORDS = ["backend", "서버", "data", "analyst", "developer", "react", "웹프론트", "qa", "engineer", "cloudops", "sales", "manager", "개발", "front", "test", "product"]


def pair(term, name):
    """(score, kind) of the rules, the first of equal ones."""
    if not name:
        return 0, ""
    if term == name:
        return 100, "exact"
    found = []
    if term not in matching.BROAD:
        if name in term and len(name) >= 4:
            found.append((95 if len(name) >= 8 else 90, "contains"))
        if term in name and len(term) >= 4:
            found.append((95 if len(term) >= 8 else 85, "contained"))
    if any(any(a in term for a in g) and any(a in name for a in g) for g in matching.SYNONYMS):
        found.append((80, "synonym"))
    return max(found, key=lambda f: f[0], default=(0, ""))


def normal(text):
    return re.sub("[^0-9a-z가-힣]+", "", text.lower())


def terms_of(text):
    return {t for t in (normal(p) for p in [text, *re.split(r"[,/|&()\[\]\n\r]+|\s+\+\s+|\s+및\s+", text.lower())]) if t}


def decided(fields, positions, least, best_only):
    best = defaultdict(lambda: 0)
    for index, text in enumerate(fields):
        for term in terms_of(text):
            for pid, name in positions:
                best[pid] = max(best[pid], min(pair(term, normal(name))[0], 100 if index == 0 else 90 if index == 1 else 75))
    ranked = sorted((-s, p) for p, s in best.items() if s)
    if not fields or not ranked:
        return ("noMatch" if fields else "notProvided"), None, None, []
    top = -ranked[0][0]
    tied = [p for s, p in ranked if -s == top]
    status = "lowConfidence" if top < least else "ambiguous" if len(tied) > 1 else "matched"
    return status, tied[0] if status == "matched" else None, top, (tied if best_only else [p for _, p in ranked])[:5]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(12)
    some = lambda n: rng.choice([" ", "", "/", " + "]).join(rng.choice(WORDS) for _ in range(rng.randrange(1, n)))
    positions = [(i, some(4) if i % 17 else "()") for i in range(1, 60)]
    resumes = [(i, [some(4) for _ in range(rng.randrange(5))]) for i in range(120)] + [(900, ["zzz", "yyy", "backend"])]
    return positions, resumes, spark.createDataFrame(positions, "position_id long, position_name string")


def test_resume_positions(spark, made):
    positions, resumes, frame = made
    out = {r.id: (r.status, r.matched_position_id, r.score, r.candidates) for r in matching.match_resume_positions(spark.createDataFrame(resumes, "id long, fields array<string>"), frame).collect()}
    assert out == {i: decided(f, positions, 80, False) for i, f in resumes} and {"matched", "ambiguous", "lowConfidence", "notProvided"} <= {o[0] for o in out.values()}


def test_one_text_lists_the_best_only(spark, made):
    positions, resumes, frame = made
    texts = [(i, f[0] if f else None) for i, f in resumes]
    out = {r.id: (r.status, r.matched_position_id, r.score, r.candidates) for r in matching.match_positions(spark.createDataFrame(texts, "id long, text string"), frame).collect()}
    assert out == {i: decided([t] if t else [], positions, 0, True) for i, t in texts}


def test_reasons_and_all_scores(spark, made):
    positions, resumes, frame = made
    evidence = [(i, 0, f[0]) for i, f in resumes if f]
    out = {(r.id, r.position_id): (r.score, r.reason) for r in matching.scores(spark.createDataFrame(evidence, "id long, index int, text string"), frame).collect()}
    want = {}
    for i, _, text in evidence:
        for pid, name in positions:
            score, term, kind = min(((-pair(t, normal(name))[0], t, pair(t, normal(name))[1]) for t in terms_of(text)), default=(0, "", ""))
            if score:
                want[i, pid] = (-score, f"{kind}: {term}")
    assert out == want


def test_job_descriptions_are_selected_as_by_all_pairs_but_without_pairing(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab 개") for _ in range(rng.randrange(0, 9)))
    names = [(i, word(), rng.choice([None, None, "3.4", " 7 ", "99"])) for i in range(120)]
    heads = [(rng.randrange(1, 60), word()) for _ in range(25)] + [(61, None)]
    positions, sections = spark.createDataFrame(names, "position_id long, position_name string, section_number string"), spark.createDataFrame(heads, "number int, title string")
    out = matching.select_job_description(positions, sections)
    tight = lambda v: "".join((v or "").split()).lower()

    def expected(i, name, asked):
        asked = asked and asked.strip().removeprefix("3.").strip()
        if asked:
            return min((n for n, _ in heads if str(n) == asked), default=None)
        named = [n for n, h in heads if tight(h) in tight(name) or tight(name) in tight(h)]
        return min(named or [n for n, _ in heads if n == i], default=None)

    assert {r.position_id: r.section for r in out.collect()} == {i: expected(i, n, a) for i, n, a in names}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
