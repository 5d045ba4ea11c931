"""Toxicity by weak supervision.

1. Voters. In all labelled rows, words and word beginnings are counted by document and label; those
   far commoner in toxic texts become voters (the lexicon and the patterns), each of which fires on a text or abstains.
   One more voter speaks for clean texts: it fires where no word of the lexicon and no pattern does.
2. Label model. A generative model of the votes of the labelled texts, which sees no labels: a hidden label, for each voter its rates of
   firing under either label (its accuracies), and correlations as parameters: each voter's rates depend on another
   voter as well, the one that it shares most information with given the label (a tree over the voters). All is estimated by expectation
   maximisation from the start that texts with a toxic vote are toxic. A voter that doesn't fire abstains, which is no evidence.
3. Classifier. A logistic regression on the voters' firings and rates is trained on the label model's posterior labels and
   scores every text.

All labelled texts take part, one for each id. Both fits need sums over the texts' votes only: where more than ``MAX_LABELLED`` texts fire differently, tasks add
them up, a job for each round, and only sums reach the driver. ``max_labelled`` can bound the rows (the labelled ids with the smallest hashes); the
queries leave it open. Scores read nothing but the text.

Defined results: a null or empty text fires no toxic voter and gets the score of such a text; without toxic
labels every score is 0; rows with a null id are scored, but teach nothing; of several texts of an id the smallest teaches; repeated rows
get equal scores; an empty table gives no rows; other columns pass by, but for one named as the score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffloom.llm.shared import within, written

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 8)
MAX_VOTERS = 192
#: Labelled texts that fire differently up to which the models are fitted in the driver; beyond, by sums of tasks. No labelled text is left out.
MAX_LABELLED = 20_000
#: Words after which a task hands on its counts of marks; words whose voters a task remembers.
COUNTED_WORDS, REMEMBERED = 1 << 20, 100_000
#: Marks in fewer labelled texts are not tested; of the marks taken, the share that may be there by chance.
LEAST_TEXTS, BY_CHANCE = 3, 0.05


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def marks(text: str | None) -> Counter:
    """Words (as =word) and word beginnings (as ^pre) of a text, with the number of words that bear each."""
    found: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        found[f"={word}"] += n
        for k in PREFIXES:
            if len(word) < k:
                break
            found[f"^{word[:k]}"] += n
    return found


class Places(dict):
    """The places of the voters that a word fires, looked up once a word; most words fire none."""

    def __init__(self, voters: list[str]) -> None:
        super().__init__()
        self.voters = {v: i for i, v in enumerate(voters)}

    def __bool__(self) -> bool:
        return True

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = tuple(self.voters[m] for m in (f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k)) if m in self.voters)
        return found


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray  # of firings, then of rates
    bias: float
    accuracies: np.ndarray  # firing rates of all voters under label 0 and 1, that for clean texts last
    parents: np.ndarray  # the voter that each one depends on, -1 for the root

    def features(self, texts: list[str | None]) -> np.ndarray:
        return features(texts, Places(self.voters))

    def scores(self, texts: list[str | None], places: Places | None = None) -> np.ndarray:
        return sigmoid(features(texts, places or Places(self.voters)) @ self.weights + self.bias) if self.voters else np.zeros(len(texts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(texts: list[str | None], places: Places) -> np.ndarray:
    """Firings and log rates per thousand words of each voter."""
    n = len(places.voters)
    out, total = np.zeros((len(texts), 2 * n)), np.ones((len(texts), 1))
    for row, text in enumerate(texts):
        words = WORD.findall((text or "").lower())
        total[row] = max(len(words), 1)
        for i in chain.from_iterable(filter(None, map(places.__getitem__, words))):
            out[row, i] += 1
    out[:, n:] = np.log1p(1000 * out[:, :n] / total)
    out[:, :n] = out[:, :n] > 0
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of features as the places and rates of the voters that fire."""
    n, found = x.shape[1] // 2, []
    for row in x:
        at = np.flatnonzero(row[:n])
        found.append(at.astype("<u2").tobytes() + row[n + at].astype("<f4").tobytes())
    return found


def unpacked(rows: list[bytes], n: int) -> np.ndarray:
    x = np.zeros((len(rows), 2 * n))
    for row, value in zip(x, rows, strict=True):
        k = len(value) // 6
        at = np.frombuffer(value, "<u2", k).astype(int)
        row[at], row[n + at] = 1, np.frombuffer(value, "<f4", k, 2 * k)
    return x


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, max_labelled: int | None = None) -> DataFrame:
    """(text, y) of the labelled rows. max_labelled: only so many, by hash of the id; then the labels are cut before they meet the texts."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.max("toxic").cast("int").alias("y"))
    if max_labelled is not None:
        known = F.broadcast(known.orderBy(F.xxhash64("_key"), "_key").limit(max_labelled))  # at most max_labelled rows of two numbers
    own = docs.where(~held_out(F.col(key))).select(F.col(key).alias("_key"), F.col(text).alias("text"))
    return own.join(known, "_key").groupBy("_key").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def mark_counts(texts: list[list[str]], toxic: np.ndarray) -> pd.DataFrame:
    """(mark, pos, neg): in how many toxic and other texts a word or a word beginning is. texts: the words of each.

    Words are numbered in order, so beginnings are runs of numbers: in a text's sorted words, equal beginnings are neighbours.
    """
    number: defaultdict[str, int] = defaultdict(count().__next__)
    code = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64)
    words = sorted(number)
    rank = np.empty(len(words), np.int64)
    rank[np.fromiter(map(number.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
    of, word = np.divmod(np.unique(np.repeat(np.arange(len(texts)), [len(t) for t in texts]) * len(words) + rank[code]), max(len(words), 1))
    marks_, times = [f"={w}" for w in words], [(np.bincount(word[toxic[of]], minlength=len(words)), np.bincount(word, minlength=len(words)))]
    for k in PREFIXES:
        heads = [w[:k] for w in words]
        first = np.fromiter((i == 0 or h != heads[i - 1] for i, h in enumerate(heads)), bool, len(heads))
        run = np.cumsum(first) - 1
        whole = np.fromiter((len(heads[i]) == k for i in np.flatnonzero(first)), bool)
        own = run[word]
        once = np.concatenate([[True], (of[1:] != of[:-1]) | (own[1:] != own[:-1])])[: len(own)]
        marks_ += [f"^{heads[i]}" for i in np.flatnonzero(first)[whole]]
        times.append((np.bincount(own[once & toxic[of]], minlength=len(whole))[whole], np.bincount(own[once], minlength=len(whole))[whole]))
    pos, every = (np.concatenate(part) for part in zip(*times, strict=True))
    return pd.DataFrame({"mark": marks_, "pos": pos, "neg": every - pos})


def find_voters(sample: DataFrame, toxic: int, clean: int, max_voters: int = MAX_VOTERS, least_precision: float = 0.97) -> list[str]:
    """The marks whose document frequency speaks most for the toxic label.

    A mark's chance is bounded by Chernoff's bound; of all marks in ``LEAST_TEXTS`` texts or more those are taken that keep the share of chance ones among them at
    ``BY_CHANCE`` (Benjamini and Hochberg), so that with few labels, and so few marks, less is asked of each.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, toxic_, words = [], [], 0
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                texts.append(WORD.findall((text or "").lower()))
                toxic_.append(y == 1)
                words += len(texts[-1])
                if words >= COUNTED_WORDS:
                    yield mark_counts(texts, np.array(toxic_))
                    texts, toxic_, words = [], [], 0
        if texts:
            yield mark_counts(texts, np.array(toxic_))

    counts = sample.mapInPandas(counted, "mark string, pos long, neg long").groupBy("mark").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    tested = written(counts.where(F.col("pos") + F.col("neg") >= LEAST_TEXTS), "toxicity-marks")
    n, mean = F.col("pos") + F.col("neg"), toxic / (toxic + clean)
    share = F.col("pos") / n  # of toxic texts
    unlikely = F.col("pos") * F.log(share / mean) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - mean) if clean else F.lit(1.0))).otherwise(0.0)
    strong = tested.where((F.col("pos") > 0) & (share >= least_precision) & (share > mean)).withColumn("gain", unlikely)
    rows, m = strong.orderBy(F.desc("gain"), "mark").limit(8 * max_voters).collect(), tested.count()
    rows = rows[: max((k for k, r in enumerate(rows, 1) if np.exp(-r["gain"]) <= BY_CHANCE * k / m), default=0)]
    numbers = {r["mark"]: (r["pos"], r["neg"]) for r in rows}
    longer = {m[:-1] if m[0] == "^" else f"^{m[1:]}" for m, c in numbers.items() if numbers.get(m[:-1] if m[0] == "^" else f"^{m[1:]}") == c}
    return [r["mark"] for r in rows if r["mark"] not in longer][:max_voters]  # a mark that a longer one says as well is left out


def tree(totals: np.ndarray, ones: np.ndarray, boths: np.ndarray) -> np.ndarray:
    """The parent of each voter in the tree of most mutual information given the label (-1: the root), from a label's texts, firings and common firings."""
    gain = np.zeros(boths.shape[1:])
    for total, one, both in zip(totals + 1e-9, ones, boths, strict=True):
        one, both = one / total, both / total
        for a, b, joint in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None, :] - both), (0, 0, 1 - one[:, None] - one[None, :] + both)):
            apart = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
            joint = np.clip(joint, 1e-12, None)
            gain += total * joint * np.log(joint / np.clip(apart, 1e-12, None))
    parent, best, link, left = np.full(len(gain), -1), gain[0].copy(), np.zeros(len(gain), int), np.ones(len(gain), bool)
    left[0] = False
    while left.any():
        j = int(np.flatnonzero(left)[best[left].argmax()])
        parent[j], left[j] = link[j], False
        better = left & (gain[j] > best)
        best[better], link[better] = gain[j][better], j
    return parent


@dataclass
class Rates:
    """What the labels' shares say, and each voter's rates of firing under labels 0 and 1, where its parent fires and where it doesn't."""

    odds: float
    parent: np.ndarray
    beside: np.ndarray
    alone: np.ndarray


def chances(own: np.ndarray, model: Rates | None, clean: float) -> np.ndarray:
    """Posterior labels by the toxic voters' firings; without a model, those of the start."""
    told = own.any(1)
    if model is None:
        return np.where(told, 0.9, clean)
    of = own[:, np.maximum(model.parent, 0)] * (model.parent >= 0)
    logit = np.full(len(own), model.odds)
    for y, sign in ((0, -1), (1, 1)):
        logit += sign * (own * np.log(np.clip(np.where(of > 0, model.beside[y], model.alone[y]), 1e-6, 1))).sum(1)
    return np.where(told, sigmoid(logit), clean)


def vote_sums(own: np.ndarray, times: np.ndarray, old: Rates | None, new: Rates | None, clean: float) -> np.ndarray:
    """What the label model needs of some texts: how far a posterior moves, then by label the texts, those without a firing, firings and common firings."""
    posterior = chances(own, new, clean)
    weight = np.stack([1 - posterior, posterior]) * times
    both = np.stack([(own * w[:, None]).T @ own for w in weight])
    return np.concatenate([[np.abs(posterior - chances(own, old, clean)).max(initial=0)], weight.sum(1), weight @ ~own.any(1), (weight @ own).ravel(), both.ravel()])


def fit_label_model(gather: Callable[[Rates | None, Rates | None], np.ndarray], toxic: int, prior: float, rounds: int) -> tuple[Rates | None, np.ndarray]:
    """The model and the firing rates of all voters, that for clean texts last. gather: ``vote_sums`` over all texts."""

    def parts(sums: np.ndarray) -> tuple[np.ndarray, ...]:
        return sums[1:3], sums[3:5], sums[5 : 5 + 2 * toxic].reshape(2, toxic), sums[5 + 2 * toxic :].reshape(2, toxic, toxic)

    model, sums = None, gather(None, None)
    for step in range(rounds):
        total, _, one, both = parts(sums)
        if step % 4 == 0:
            parent = tree(total, one, both)
        rate, above = (one + 0.1) / (total[:, None] + 1), one[:, np.maximum(parent, 0)] * (parent >= 0)
        common = both[:, np.arange(toxic), np.maximum(parent, 0)] * (parent >= 0)
        old, model = model, Rates(float(np.log((total[1] + 1) / (total[0] + 1))), parent, (common + prior * rate) / (above + prior), (one - common + prior * rate) / (total[:, None] - above + prior))
        sums = gather(old, model)
        if sums[0] < 1e-3:
            break
    total, untold, one, _ = parts(sums)
    return model, (np.column_stack([one, untold]) + 0.1) / (total[:, None] + 1)


def label_model(votes: np.ndarray, toxic: int, prior: float = 5.0, clean: float = 0.02, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior labels, firing rates under labels 0 and 1, and the tree of the voters, without any label.

    votes: firings; the first ``toxic`` voters speak for label 1, the one after them for label 0. Only firings are evidence: who abstains says nothing.
    Where only the voter for clean texts fires nothing else bears on the label, so its accuracy can't be learned from votes: it is the parameter ``clean``,
    the chance that such a text is toxic after all. prior: how many texts a voter's rate counts for where its parent changes it.
    """
    own = votes[:, :toxic]
    model, rates = fit_label_model(lambda old, new: vote_sums(own, np.ones(len(own)), old, new, clean), toxic, prior, rounds)
    return chances(own, model, clean), rates, model.parent


def slope_sums(x: np.ndarray, y: np.ndarray, times: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a step of the regression needs of some texts: a zero, their number, the slope and the curvature."""
    wide = np.hstack([x, np.ones((len(x), 1))])
    p = sigmoid(wide @ w)
    curve = (wide * (times * (p * (1 - p) + 1e-9))[:, None]).T @ wide
    return np.concatenate([[0, times.sum()], wide.T @ (times * (p - y)), curve.ravel()])


def fit_logistic(gather: Callable[[np.ndarray], np.ndarray], size: int, penalty: float = 1e-4, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method. gather: ``slope_sums`` over all texts."""
    w = np.zeros(size + 1)
    for _ in range(rounds):
        _, n, *_ = sums = gather(w)
        ridge = np.full(size + 1, penalty * n)
        ridge[-1] = 1e-6
        step = np.linalg.solve(sums[size + 3 :].reshape(size + 1, size + 1) + np.diag(ridge), sums[2 : size + 3] + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def gatherer(rows: DataFrame, n: int) -> Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]:
    """Adds up what a function makes of features and their numbers of texts; the first place takes the greatest. rows: x (packed), times."""
    if within(rows, MAX_LABELLED):
        held = rows.collect()
        x, times = unpacked([r["x"] for r in held], n), np.array([r["times"] for r in held], float)
        return lambda of: of(x, times)

    def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([[max(a[0], b[0])], a[1:] + b[1:]])

    def gather(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = None
            for batch in batches:
                for i in range(0, len(batch), 4096):
                    own = batch.iloc[i : i + 4096]
                    more = of(unpacked(list(own["x"]), n), own["times"].to_numpy(float))
                    found = more if found is None else added(found, more)
            if found is not None:
                yield pd.DataFrame({"sums": [found.tobytes()]})

        return reduce(added, (np.frombuffer(r["sums"]) for r in rows.mapInPandas(part, "sums binary").toLocalIterator()))

    return gather


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int | None = None, max_voters: int = MAX_VOTERS, prior: float = 5.0, clean: float = 0.02, rounds: int = 12) -> Model:
    sample = written(labelled(docs, labels, key, text, max_labelled), "toxicity-labelled")
    times = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    voters = find_voters(sample, times.get(1, 0), times.get(0, 0), max_voters) if times.get(1) else []
    if not voters:
        return Model([], np.zeros(0), 0.0, np.zeros((2, 0)), np.zeros(0, int))
    n = len(voters)

    def fire(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(voters)
        for batch in batches:
            yield pd.DataFrame({"x": list(chain.from_iterable(packed(features(list(batch["text"].iloc[i : i + 512]), places)) for i in range(0, len(batch), 512)))})

    # texts that fire alike are one row; most fire nothing
    rows = written(sample.select("text").mapInPandas(fire, "x binary").groupBy("x").agg(F.count(F.lit(1)).alias("times")), "toxicity-votes")
    gather = gatherer(rows, n)
    model, rates = fit_label_model(lambda old, new: gather(lambda x, times: vote_sums(x[:, :n], times, old, new, clean)), n, prior, rounds)
    weights, bias = fit_logistic(lambda w: gather(lambda x, times: slope_sums(x, chances(x[:, :n], model, clean), times, w)), 2 * n)
    return Model(voters, weights, bias, rates, model.parent)


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of every text, from 0 to 1; other columns pass by."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = Places(model.voters)
        for texts in batches:
            values = [model.scores(list(texts.iloc[i : i + 512]), places) for i in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(values) if values else np.zeros(0))

    return docs.withColumn(out, score(F.col(text)))
