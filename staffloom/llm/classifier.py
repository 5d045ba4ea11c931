"""Quality by random-indexing word vectors and a small network.

1. Words. A word is a run of characters other than ASCII white space, as it stands. Those with a share of ``SHARE`` or more of all words of the corpus, at most
   1 / ``SHARE`` of them, have vectors of their own; all others share one by their shape (case, first and last character, length).
2. Random indexing. Each word and shape has a fixed sparse index vector, ``SPOKES`` random signs among ``DIMS`` places. Its context vector is the sum of
   the index vectors of its neighbours, two on either side and those on the right turned by a place, over the whole corpus; whole numbers, so the
   sum is the same in any order. The word vector is the context vector less the corpus mean, at length 1.
3. Documents. The word vectors of a text are pooled by mean and by spread. Beside them stand the length, and how much the text repeats itself: the
   words that follow themselves, the distinct ones, and the squared length of the mean of exact index vectors (the chance that two words are one).
4. Network. Two layers of numpy (tanh, then a logit), trained by Adam on the labelled sample; a fifth of the sample is kept from
   training and sets the temperature by which logits are divided, so that scores are calibrated.

Counts and vectors come from all texts, without labels. ``max_labelled`` (20,000) bounds the fit in rows: the labelled ids with the smallest hashes, a text each.

Defined results: a null text is an empty one and gets the score of one; without labels of both kinds every score is the share of label 1 (0.5 without any);
rows with a null id are scored, but not sampled; of several labels of an id the smallest counts, of several texts of an id the smallest is sampled; repeated
rows get equal scores; texts are read whole; an empty table gives no rows; other columns pass by, but for one named as the score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffloom.llm.shared import written

SHARE = 1e-4
DIMS, SPOKES, WINDOW = 64, 4, 2
HIDDEN = 32
MAX_LABELLED = 20_000
SLICE = 1 << 20
HELD = 200_000
#: The kind of a byte at a word's start or end: letter or beyond ASCII, full stop, comma, digit, other.
KIND = bytes(0 if b >= 128 or chr(b).isalpha() else 1 if b == 46 else 2 if b == 44 else 3 if chr(b).isdigit() else 4 for b in range(256))
SHAPES = 4 * 5 * 5 * 4
EXTRA = 4


def held_out(key: Column) -> Column:
    """Rows whose labels nothing is learned from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def shape(word: bytes) -> int:
    case = 0 if word.islower() else 1 if word.isupper() else 2 if word.istitle() else 3
    return ((case * 5 + KIND[word[0]]) * 5 + KIND[word[-1]]) * 4 + min(len(word) // 4, 3)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


@dataclass
class Words:
    """The texts' words one after another: their numbers in ``distinct``, and the text of each."""

    distinct: list[bytes]
    number: np.ndarray
    text: np.ndarray


def slices(texts: list[str | None]) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) of runs of texts of about a megabyte, a text at least."""
    start, size, held = 0, 0, []
    for i, text in enumerate([*texts, None]):
        if i == len(texts) or size >= SLICE:
            numbers = Numbers()
            number = np.fromiter((numbers[w] for words in held for w in words), np.int64, sum(map(len, held)))
            yield start, i, Words(list(numbers), number, np.repeat(np.arange(i - start), [len(w) for w in held]))
            start, size, held = i, 0, []
        if i < len(texts):
            held.append((text or "").encode("utf-8", "replace").split())
            size += len(text or "")


def frequent_words(docs: DataFrame, text: str, share: float) -> list[bytes]:
    """The words with that share of all words or more, in order; at most 1 / share."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for _, _, words in slices(list(batch["text"])):
                times = np.bincount(words.number, minlength=len(words.distinct))
                counts.update(dict(zip(words.distinct, times.tolist(), strict=True)))
                if len(counts) >= HELD:
                    yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})
                    counts.clear()
        yield pd.DataFrame({"word": list(counts.keys()), "n": list(counts.values())})

    counts = written(docs.select(F.col(text).alias("text")).where("text <> ''").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "classifier-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return sorted(bytes(r.word) for r in counts.where(F.col("n") >= total * share).select("word").collect())


@dataclass
class Vocabulary:
    words: dict[bytes, int]

    @property
    def size(self) -> int:
        return len(self.words) + SHAPES

    def ids(self, words: Words) -> np.ndarray:
        own, n = self.words.get, len(self.words)
        table = np.fromiter((i if (i := own(w)) is not None else n + shape(w) for w in words.distinct), np.int64, len(words.distinct))
        return table[words.number] if len(table) else words.number

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and signs of each index vector's spokes, by a hash of the word or shape."""
        names = [*sorted(self.words, key=self.words.get), *(b"\x00%d" % s for s in range(SHAPES))]
        drawn = [np.random.default_rng(zlib.crc32(name)) for name in names]
        places = np.stack([g.choice(DIMS, SPOKES, replace=False) for g in drawn])
        return places, np.stack([g.choice([-1.0, 1.0], SPOKES) for g in drawn])


def context_sums(docs: DataFrame, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """The context vectors of all words and shapes, over the whole corpus; at most (1 / SHARE + SHAPES) x DIMS numbers meet in the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        places, signs = known.index_vectors()
        sums = np.zeros(known.size * DIMS)
        for batch in batches:
            for _, _, words in slices(list(batch["text"])):
                ids = known.ids(words)
                for away in range(1, WINDOW + 1):
                    same = words.text[away:] == words.text[:-away]
                    left, right = ids[:-away][same], ids[away:][same]
                    for spoke in range(SPOKES):
                        sums += np.bincount(right * DIMS + places[left, spoke], signs[left, spoke], len(sums))
                        sums += np.bincount(left * DIMS + (places[right, spoke] + 1) % DIMS, signs[right, spoke], len(sums))
        sums = sums.astype(np.int64).reshape(-1, DIMS)
        told = np.flatnonzero(sums.any(1))
        yield pd.DataFrame(sums[told], columns=names).assign(id=told)

    names = [f"c{k}" for k in range(DIMS)]
    rows = docs.select(F.col(text).alias("text")).where("text <> ''").mapInPandas(add, ", ".join(f"{c} long" for c in names) + ", id long")
    found = rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    out = np.zeros((vocabulary.size, DIMS))
    out[found["id"].to_numpy(np.int64)] = found[names].to_numpy(np.float64)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def pooled(texts: list[str | None], vocabulary: Vocabulary, vectors: np.ndarray) -> np.ndarray:
    """The features of each text."""
    out = np.zeros((len(texts), 2 * DIMS + EXTRA), np.float32)
    squares, size = vectors**2, vocabulary.size
    for start, end, words in slices(texts):
        if not len(words.number):
            continue
        n = np.bincount(words.text, minlength=end - start)
        there = np.flatnonzero(n)
        key, times = np.unique(words.text * size + vocabulary.ids(words), return_counts=True)
        edge = np.searchsorted(key, there * size)
        weight = (times / n[key // size])[:, None]
        mean = np.add.reduceat(vectors[key % size] * weight, edge)
        spread = np.add.reduceat(squares[key % size] * weight, edge) - mean**2
        most = len(words.distinct)
        own, times = np.unique(words.text * most + words.number, return_counts=True)
        edge = np.searchsorted(own, there * most)
        again = np.bincount(words.text[1:][(words.text[1:] == words.text[:-1]) & (words.number[1:] == words.number[:-1])], minlength=end - start)
        total = n[there].astype(float)
        distinct = np.diff(np.append(edge, len(own)))
        meets = np.add.reduceat(times.astype(float) ** 2, edge) / total**2
        out[start + there] = np.column_stack([mean, np.sqrt(np.maximum(spread, 0)), np.log1p(total), again[there] / total, distinct / total, np.log(meets * total)])
    return out


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.shift) / self.scale, -8, 8) @ self.inner + self.inner_bias) @ self.outer + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss, between a tenth and ten. The labels are smoothed by one of either kind, so that few rows that are told apart claim no certainty."""
    grid, ones = 10 ** np.linspace(-1, 1, 201), y.sum()
    smooth = np.where(y > 0.5, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    return float(grid[int(np.argmin([loss(logits / t, smooth) for t in grid]))])


def fitted(x: np.ndarray, y: np.ndarray, apart: np.ndarray, hidden: int = HIDDEN, steps: int = 1_500, batch: int = 512, rate: float = 5e-3, penalty: float = 1e-3, seed: int = 0) -> Network:
    """Trained on the rows that are not ``apart``; those set the temperature."""
    rng = np.random.default_rng(seed)
    own, target = x[~apart].astype(np.float64), y[~apart]
    shift, scale = own.mean(0), own.std(0) + 1e-3
    own = np.clip((own - shift) / scale, -8, 8)
    weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.full(1, np.log((target.sum() + 1) / (len(target) - target.sum() + 1)))]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(own), min(batch, len(own)))
        h = np.tanh(own[rows] @ weights[0] + weights[1])
        error = (sigmoid(h @ weights[2] + weights[3]) - target[rows]) / len(rows)
        back = np.outer(error, weights[2]) * (1 - h**2)
        slopes = [own[rows].T @ back + penalty * weights[0], back.sum(0), h.T @ error + penalty * weights[2], np.array([error.sum()])]
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            weights[k] = weights[k] - rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    network = Network(shift, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    if apart.any():
        network.temperature = calibrated(network.logits(x[apart]), y[apart])
    return network


@dataclass
class Model:
    vocabulary: Vocabulary
    vectors: np.ndarray
    network: Network | None
    share: float  # of label 1, where there is no network

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.scores(pooled(texts, self.vocabulary, self.vectors))


def word_vectors(docs: DataFrame, text: str = "text", share: float = SHARE) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of a corpus and its word vectors."""
    vocabulary = Vocabulary({w: i for i, w in enumerate(frequent_words(docs, text, share))})
    sums = context_sums(docs, text, vocabulary)
    mean = unit(sums.sum(0))  # the corpus's common direction
    vectors = unit(sums)
    return vocabulary, unit(vectors - np.outer(vectors @ mean, mean)).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_labelled: int) -> DataFrame:
    """(_key, text, y) of the sampled labelled rows. The labels are cut to the sample before they meet the texts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.min(label).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("_key"), "_key").limit(max_labelled)  # at most max_labelled rows of two numbers
    return docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "_key").groupBy("_key").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, share: float = SHARE) -> Model:
    """The model of the labels; labels of ``held_out`` rows are not used."""
    vocabulary, vectors = word_vectors(docs, text, share)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, vectors))

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pooled(list(batch["text"]), *shared.value)
            yield pd.DataFrame({"name": batch["_key"].astype(str), "x": [r.tobytes() for r in rows], "y": batch["y"]})

    sample = labelled(docs, labels, key, text, label, max_labelled).mapInPandas(pool, "name string, x binary, y int").toPandas().sort_values("name")  # at most max_labelled rows
    y = sample["y"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return Model(vocabulary, vectors, None, float(y.mean()) if len(y) else 0.5)
    x = np.stack([np.frombuffer(r, np.float32) for r in sample["x"]])
    apart = np.array([zlib.crc32(f"apart {name}".encode()) % 5 == 0 for name in sample["name"]])
    if not 0 < y[~apart].sum() < (~apart).sum():
        apart[:] = False
    return Model(vocabulary, vectors, fitted(x, y, apart), 0.5)


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every text, from 0 to 1; other columns pass by."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(list(texts)))

    return docs.withColumn(out, score(F.col(text)))
