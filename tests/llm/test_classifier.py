from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from staffloom.llm import classifier, queries


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    plain = [f"{a}{b}" for a in "the of and with some more great small".split() for b in "ab cd ef gh".split()]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        kind = rng.randrange(8)
        if kind == 0:
            words = [words[0]] * len(words)
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 2:
            words = [w + "#%" for w in words]
        rows.append((i, " ".join(words), "en", "x"))
        labels.append((i, int(kind > 2)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, words string").repartition(4), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int"), dict(labels)


@pytest.fixture(scope="module")
def model(corpus):
    return classifier.train(corpus[0], corpus[1])


def test_held_out_accuracy_and_calibration(corpus, model):
    docs, _, truth = corpus
    out = [(r.score, truth[r.doc_id]) for r in classifier.scored(docs, model).collect() if held(r.doc_id)]
    assert sum((s >= 0.3) == bool(y) for s, y in out) / len(out) > 0.98 and all(0 <= s <= 1 for s, _ in out)
    assert abs(np.mean([s for s, _ in out]) - np.mean([y for _, y in out])) < 0.03


def test_held_out_labels_are_not_used(spark, corpus, model):
    docs, _, truth = corpus
    flipped = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, t in truth.items()], "doc_id long, quality int")
    other = classifier.train(docs, flipped)
    assert np.allclose(model.network.inner, other.network.inner) and model.network.temperature == other.network.temperature


def test_context_sums_equal_those_of_a_loop(spark):
    texts = ["a b c a b  c d", "b b\tb", "", "c d É é D. 12,", "a"]
    docs = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    counts = Counter(w for t in texts for w in t.encode().split())
    words = classifier.frequent_words(docs, "text", 0.1)
    assert words == sorted(w for w, n in counts.items() if n >= 0.1 * sum(counts.values()))
    vocabulary = classifier.Vocabulary({w: i for i, w in enumerate(words)})
    places, signs = vocabulary.index_vectors()
    want = np.zeros((vocabulary.size, classifier.DIMS))
    for text in texts:
        ids = [vocabulary.words.get(w, len(words) + classifier.shape(w)) for w in text.encode().split()]
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if 0 < abs(i - j) <= classifier.WINDOW:
                    for p, s in zip(places[b], signs[b], strict=True):
                        want[a, (p + (j > i)) % classifier.DIMS] += s
    assert (classifier.context_sums(docs, "text", vocabulary) == want).all()


def test_pooling_is_that_of_each_text_alone(corpus, model):
    texts = [r.text for r in corpus[0].limit(40).collect()] + [None, "", " ", "one", "x " * 30_000]
    together = classifier.pooled(texts, model.vocabulary, model.vectors)
    alone = np.vstack([classifier.pooled([t], model.vocabulary, model.vectors) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    ids = [model.vocabulary.words.get(w, len(model.vocabulary.words) + classifier.shape(w)) for w in texts[0].encode().split()]
    own = model.vectors[ids]
    assert np.allclose(together[0, : classifier.DIMS], own.mean(0), atol=1e-5) and np.allclose(together[0, classifier.DIMS : 2 * classifier.DIMS], own.std(0), atol=1e-3)


def test_nulls_empties_clashes_and_missing_labels(spark, docs, empty, corpus, model):
    more = docs.withColumns({"_key": F.lit(1), "y": F.lit("q")})
    out = {r.doc_id: r._s for r in classifier.scored(more, model, out="_s").collect()}
    assert out[100] == out[101] and out[105] == out[106] and all(0 <= s <= 1 for s in out.values())
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert classifier.scored(more, classifier.train(more, labels)).count() == len(out)
    for given, share in (([(1, 1)], 1.0), ([], 0.5)):
        none = classifier.train(more, spark.createDataFrame(given, "doc_id long, quality int"))
        assert {r.score for r in classifier.scored(more, none).collect()} == {share}
    assert classifier.scored(empty, classifier.train(empty, labels)).count() == 0


def test_the_sample_is_bounded_and_gradients_are_right(corpus):
    docs, labels, _ = corpus
    assert classifier.labelled(docs.union(docs), labels, "doc_id", "text", "quality", 100).count() == 100
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no single layer can tell
    network = classifier.fitted(x, y, np.arange(400) % 5 == 0)
    assert ((network.scores(x) > 0.5) == y).mean() > 0.93
    assert classifier.calibrated(np.array([5.0, -5.0, 5.0, -5.0]), np.array([1.0, 0.0, 0.0, 1.0])) == pytest.approx(10)


def test_query(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()
    rows = queries.queries()["op11_quality_classifier"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in given)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
