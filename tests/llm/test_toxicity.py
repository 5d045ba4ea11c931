from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffloom.llm import toxicity


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            bad = ["wretch", "louse", "vermin"] if i % 12 else ["blorg" + "".join(rng.choice("abcdefgh") for _ in range(6))]
            words[5:7] = [rng.choice(bad), rng.choice(bad)]
        rows.append((i, " ".join(words), "xx", 0.5))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y double")
    return docs, spark.createDataFrame(labels + [(3, None)], "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(corpus):
    docs, labels, truth = corpus
    model = toxicity.train(docs, labels)
    out = [r for r in toxicity.scored(docs, model).collect() if held(r.doc_id)]
    right = sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in out)
    assert right / len(out) > 0.98 and all(0 <= r.score <= 1 for r in out)
    assert {"=wretch", "=louse", "=vermin"} <= set(model.voters) and any(v.startswith("^blo") for v in model.voters)


def test_held_out_labels_are_not_used(spark, corpus):
    docs, labels, truth = corpus
    flipped = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, t in truth.items()], "doc_id long, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.voters == b.voters and np.allclose(a.weights, b.weights)


def test_nulls_empties_and_no_toxic_labels(spark, docs, corpus):
    model = toxicity.train(corpus[0], corpus[1])
    out = {r.doc_id: r._s for r in toxicity.scored(docs, model, out="_s").collect()}
    assert out[100] == out[101] and 0 <= out[100] < 0.3
    none = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {r.score2 for r in toxicity.scored(docs, none, out="score2").collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_label_model_learns_rates_and_correlations_without_labels():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.15
    fire = lambda on, off: np.where(y, rng.random(6000) < on, rng.random(6000) < off)
    a, b, c = fire(0.6, 0.002), fire(0.6, 0.002), fire(0.5, 0.03)
    once = np.stack([a, b, c, ~(a | b | c)], 1).astype(float)
    twice = np.hstack([a[:, None], once]).astype(float)  # one voter says what another says
    first, rates, _ = toxicity.label_model(once, 3)
    second, _, parents = toxicity.label_model(twice, 4)
    assert parents[1] == 0 or parents[0] == 1  # the copy depends on its twin
    assert np.abs(first - second).mean() < 0.01  # and isn't counted twice
    assert np.allclose(rates[1, :3], [(y & v).sum() / y.sum() for v in (a, b, c)], atol=0.15) and (rates[0, :3] < 0.05).all()
    assert (first[a | b] > 0.5).mean() > 0.97 and ((first > 0.5) == y)[a | b | ~c].mean() > 0.95


def test_the_sample_is_bounded_in_rows(corpus):
    docs, labels, _ = corpus
    assert toxicity.labelled(docs.union(docs).union(docs), labels, "doc_id", "text", 100).count() == 100


def test_all_labelled_rows_teach_and_tasks_can_fit(spark, monkeypatch):
    """The texts of a quarter of the ids, those with the largest hashes, have a word of their own; 20,000 rows in order of hashes would leave it out."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 20 == 0).cast("int").alias("toxic"), (F.xxhash64("id") > 1 << 62).alias("_late"))
    docs = rows.select("doc_id", F.concat(F.lit("some plain words "), F.when(F.col("toxic") == 0, F.concat(F.lit("x"), F.col("doc_id") % 7)).when(F.col("_late"), "vileness").otherwise("badness")).alias("text"))
    model = toxicity.train(docs, rows.select("doc_id", "toxic"))
    assert {"=vileness", "=badness"} <= {v if v.startswith("=") else f"={w}" for v in model.voters for w in ("vileness", "badness") if w.startswith(v[1:])}
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 0)
    other = toxicity.train(docs, rows.select("doc_id", "toxic"))
    texts = ["some vileness", "badness", "plain words", None]
    assert other.voters == model.voters and np.allclose(model.scores(texts), other.scores(texts)) and (model.scores(texts[:2]) > 0.3).all()


def test_marks_of_many_texts():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 10))) for _ in range(rng.randrange(30))) for _ in range(300)]
    toxic = np.array([rng.random() < 0.3 for _ in texts])
    want = {m: [0, 0] for t in texts for m in toxicity.marks(t)}
    for text, y in zip(texts, toxic, strict=True):
        for m in toxicity.marks(text):
            want[m][0 if y else 1] += 1
    found = toxicity.mark_counts([toxicity.WORD.findall(t) for t in texts], toxic)
    assert len(found) == len(want) and {r.mark: [r.pos, r.neg] for r in found.itertuples()} == want
