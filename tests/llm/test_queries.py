"""The registered queries over a whole small folder: rows, columns and the contracted values by brute force."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from staffloom.llm import queries, sketches

from .test_secrets import brute as brute_spans
from .test_simhash import brute as brute_fingerprint
from .test_simhash import groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name, *columns):
    out = queries.queries()[name](spark, SF)
    assert set(columns) <= set(out.columns)
    return out.collect()


def test_op2(spark, given):
    rows = run(spark, "op2_shards", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(r.doc_id for r in rows) == sorted(given) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(r["size"] == len((given[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((given[r.doc_id] or "").encode()) for r in rows)


def test_op3(spark, given):
    rows = run(spark, "op3_license_scan", "doc_id", "license", "effective_license")
    assert sorted(r.doc_id for r in rows) == sorted(given)
    assert {r.doc_id for r in rows if r.license} == {i for i, t in given.items() if t and ("icensed under" in t or "MIT License" in t)}


def test_op6(spark, given):
    rows = run(spark, "op6_toxicity", "doc_id", "held_out", "score", "predicted")
    assert sorted(r.doc_id for r in rows) == sorted(given)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_op8(spark, given):
    rows = run(spark, "op8_simhash_components", "doc_id", "fingerprint", "component_id")
    own = {i: brute_fingerprint(t) for i, t in given.items()}
    component = groups(own, 2)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{own[i]:016x}", component[i]) for i in given}


def test_op9(spark, given):
    names = ["assign", "access", "hex"]
    text = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    rows = run(spark, "op9_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert sorted(r.doc_id for r in rows) == sorted(given)
    for r in rows:
        spans = brute_spans(given[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(text(spans).encode()).hexdigest()
        assert {x for x in r.spans.split(",") if not x.startswith("markov")} - {""} == set(text(spans).split(",")) - {""}


def test_op10(spark, given):
    rows = run(spark, "op10_fingerprints", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    ids = sorted(given)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    assert sorted(r.doc_id for r in rows) == ids

    def shingles(text):
        words = text.split()
        return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    far = 0.0
    for r in rows:
        text, following = given[r.doc_id] or "", given[after[r.doc_id]] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b = shingles(text), shingles(changed)
        far += abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
    assert far / len(rows) < 0.06
    one = spark.range(1).select(sketches.text_of(sketches.sketch(F.lit(given[ids[0]]))).alias("s")).first().s
    assert next(r.fingerprint for r in rows if r.doc_id == ids[0]) == one
