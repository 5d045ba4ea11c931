"""Collocations by FM-indexes over word ids, one for each shard of a language's texts.

1. Shards. Each task deals the words of its texts to shards by language, about ``SHARD_WORDS`` words each: numbers of words, with a break (0)
   at each end of a piece. Shards are a written table.
2. Words. Their counts are summed over the shards; those with ``least`` occurrences or more get a number, all others become breaks.
3. Phrases. ``FMIndex`` holds a shard's text as the Burrows-Wheeler transform of the text and of its reverse. A phrase is an interval of
   either, and the two are kept in step, so that it can grow by a word on either side. Singles grow to the left, pairs to the right,
   triples to the left, level by level: a shard's counts of a level are summed over all shards, and only phrases whose
   parts of one word less are both frequent everywhere are counted at the next. What a phrase grows to are its left and right extensions.

Phrases go by number: a level's phrase is the pair of the numbers of its first and its last words but one, so rows of counts are three
numbers. All shuffles are by word, by phrase or by shard. A level's frequent phrases go back to the shards that have them by a join, or, where they
prove to be ``BROADCAST_PHRASES`` at most (24 bytes each), to all of them by broadcast.

Defined results: a null text is empty and adds nothing; a null language is ``und``; repeated rows count each; pieces of any length are
read whole; ties are broken by the phrase's bytes; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.llm.shared import broadcast_within, buckets_for, dealt, within, written

LEAST = 30
SHARD_WORDS = 1_000_000
SLICE = 1 << 20
#: Frequent phrases of the levels so far up to which their numbers are broadcast; beyond, a join brings each shard its own.
BROADCAST_PHRASES = 1_000_000
BREAKS = b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + b"\n" * len(BREAKS) + b" ")
BREAK, NOTHING = 0, 1


class Numbers(dict):
    """Numbers for words in order of first sight; 0 is a break and 1 stands for what lies between two spaces."""

    def __init__(self) -> None:
        super().__init__({b"\n": BREAK, b"": NOTHING})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


@dataclass
class Shard:
    """The words of some texts of one language."""

    numbers: Numbers = field(default_factory=Numbers)
    parts: list[np.ndarray] = field(default_factory=list)
    size: int = 0

    def add(self, texts: list[bytes]) -> None:
        found = b" \n ".join([*texts, b""]).translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        ids = ids[ids != NOTHING]
        self.parts.append(ids)
        self.size += len(ids)

    def row(self, number: int, lang: str) -> dict:
        text = np.concatenate(self.parts)
        counts = np.bincount(text, minlength=len(self.numbers))
        return {"shard": number, "lang": lang, "words": [w.decode("utf-8", "replace") for w in self.numbers][2:], "counts": counts[2:].tolist(), "ids": tight(np.maximum(text - 1, 0)).tobytes()}


def tight(text: np.ndarray) -> np.ndarray:
    """A text of numbers with a break at its start and single breaks elsewhere."""
    text = np.concatenate([[BREAK], text, [BREAK]]).astype(np.int32)
    return text[np.concatenate([[True], (text[1:] != BREAK) | (text[:-1] != BREAK)])]


def shards_of(docs: DataFrame, lang: str, text: str, shard_words: int) -> DataFrame:
    """(shard, lang, words, counts, ids): word i of ``words`` is number i + 1 in ``ids``."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Shard] = {}
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for name, rows in batch.groupby("lang", sort=True):
                waiting, size = [], 0
                for value in rows["text"]:
                    waiting.append(value.encode("utf-8", "replace"))
                    size += len(waiting[-1])
                    if size >= SLICE:
                        held.setdefault(name, Shard()).add(waiting)
                        waiting, size = [], 0
                        if held[name].size >= shard_words:
                            yield pd.DataFrame([held.pop(name).row(number, name)])
                            number += 1
                if waiting:
                    held.setdefault(name, Shard()).add(waiting)
        for name, shard in held.items():
            yield pd.DataFrame([shard.row(number, name)])
            number += 1

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text <> ''")
    return rows.mapInPandas(deal, "shard long, lang string, words array<string>, counts array<long>, ids binary")


def dense(key: np.ndarray) -> np.ndarray:
    """The rank of each number among the distinct ones."""
    order = np.argsort(key)
    own, rank = key[order], np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))
    return rank


def ordered(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of a text by their next ``depth`` numbers (a power of two), by doubling; equal ones in any order."""
    rank, width = text.astype(np.int64), 1
    while True:
        ahead = np.concatenate([rank[width:] + 1, np.zeros(min(width, len(rank)), np.int64)])
        key = rank * (int(rank.max()) + 2) + ahead
        width *= 2
        if width >= depth:
            return np.argsort(key)
        rank = dense(key)


@dataclass
class Transform:
    """The Burrows-Wheeler transform of a text whose rows are sorted by their first ``depth`` numbers, and its sorted (number, row) pairs.

    The pairs count: those before (c, row) are all smaller numbers and the occurrences of c above the row, which is where the rows that
    begin with c and go on as ``row`` does begin.
    """

    text: np.ndarray
    depth: int

    def __post_init__(self) -> None:
        self.last = self.text[ordered(self.text, self.depth) - 1].astype(np.int64)

    @cached_property
    def pairs(self) -> np.ndarray:
        return np.sort(self.last * len(self.last) + np.arange(len(self.last)))

    def step(self, number: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, number * len(self.pairs) + row)


@dataclass
class Phrases:
    """Phrases of one length: their words (a row each), their counts and where their intervals begin in both transforms."""

    words: np.ndarray
    count: np.ndarray
    ahead: np.ndarray
    back: np.ndarray

    def where(self, kept: np.ndarray) -> Phrases:
        return Phrases(self.words[kept], self.count[kept], self.ahead[kept], self.back[kept])


@dataclass
class FMIndex:
    """A text of numbers from 0 (breaks) to ``size - 1`` that begins and ends with a break, indexed both ways for phrases of ``depth`` words."""

    text: np.ndarray
    size: int
    depth: int = 4

    @cached_property
    def forward(self) -> Transform:
        return Transform(self.text, self.depth)

    @cached_property
    def reverse(self) -> Transform:
        return Transform(self.text[::-1], self.depth)

    def singles(self) -> Phrases:
        count = np.bincount(self.text, minlength=self.size)
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        words = np.flatnonzero(count[1:]) + 1
        return Phrases(words[:, None], count[words], start[words], start[words])

    def grown(self, phrases: Phrases, left: bool, final: bool = False) -> Phrases:
        """All phrases that are longer by a word on the left (or right). final: they grow no further, so their intervals are left out."""
        own, other = (phrases.ahead, phrases.back) if left else (phrases.back, phrases.ahead)
        index = self.forward if left else self.reverse
        of = np.repeat(np.arange(len(own)), phrases.count)
        within = np.arange(len(of)) - np.repeat(np.cumsum(phrases.count) - phrases.count, phrases.count)
        key, count = np.unique(of * self.size + index.last[own[of] + within], return_counts=True)
        of, word = np.divmod(key, self.size)
        real = word != BREAK
        if not final:
            before = np.cumsum(count) - count  # rows of the same phrase with a smaller word move the other interval
            start = (other[of] + before - before[np.searchsorted(of, of)])[real]
        of, word, count = of[real], word[real], count[real]
        words = np.column_stack([word, phrases.words[of]] if left else [phrases.words[of], word])
        if final:
            return Phrases(words, count, *[np.empty(0, np.int64)] * 2)
        at = index.step(word, own[of])
        return Phrases(words, count, at, start) if left else Phrases(words, count, start, at)


@dataclass
class Known:
    """Numbers of pairs of numbers."""

    pre: np.ndarray
    suf: np.ndarray
    number: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.suf, self.pre))
        self.pre, self.suf, self.number = self.pre[order], self.suf[order], self.number[order]
        self.names = np.unique(np.concatenate([self.pre, self.suf, [0]]))
        self.keys = self.place(self.pre) * len(self.names) + self.place(self.suf)

    def place(self, numbers: np.ndarray) -> np.ndarray:
        """Where numbers stand among those of the pairs, -1 where they don't."""
        at = np.minimum(np.searchsorted(self.names, numbers), len(self.names) - 1)
        return np.where(self.names[at] == numbers, at, -1)

    def at(self, pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
        """The number of each pair of places, 0 where it has none."""
        if not len(self.keys):
            return np.zeros(len(pre), np.int64)
        key = pre * len(self.names) + suf
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((pre >= 0) & (suf >= 0) & (self.keys[at] == key), self.number[at], 0)

    def of(self, pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
        """The number of each pair, 0 where it has none."""
        return self.at(self.place(pre), self.place(suf))


COUNTED = "shard long, pre long, suf long, n long, ids binary, alphabet binary"


def counted(shard: int, pre: np.ndarray, suf: np.ndarray, n: np.ndarray, text: np.ndarray, alphabet: np.ndarray) -> pd.DataFrame:
    """A shard's counts of a level, and a row with its text."""
    rows = pd.DataFrame({"shard": shard, "pre": pre, "suf": suf, "n": n, "ids": None, "alphabet": None}).astype({"pre": "int64", "suf": "int64", "n": "int64"})
    return pd.concat([rows, pd.DataFrame([{"shard": shard, "pre": 0, "suf": 0, "n": 0, "ids": text.astype(np.int32).tobytes(), "alphabet": alphabet.astype(np.int64).tobytes()}])])


def narrowed(text: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A tight text over its own words only, numbered from 1 in order of their numbers everywhere (``alphabet``, 0 first)."""
    text = tight(text)
    there = np.bincount(text, minlength=1) > 0
    there[BREAK] = True
    return (np.cumsum(there) - 1)[text], alphabet[np.flatnonzero(there)]


def count_pairs(shards: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Level 2 of a shard. words: place (in the shard's words, from 0), number; those of frequent words."""
    if not len(shards) or not len(words):
        return nothing()
    text, shard = np.frombuffer(shards["ids"].iloc[0], np.int32), int(shards["shard"].iloc[0])
    alphabet, place = np.unique(np.concatenate([[0], words["number"].to_numpy(np.int64)]), return_inverse=True)
    to = np.zeros(max(int(text.max()), int(words["place"].max()) + 1) + 1, np.int64)
    to[words["place"].to_numpy(np.int64) + 1] = place[1:]
    text, alphabet = narrowed(to[text], alphabet)
    index = FMIndex(text, len(alphabet), depth=2)
    pairs = index.grown(index.singles(), left=True, final=True)
    return counted(shard, *alphabet[pairs.words.T], pairs.count, text, alphabet)


def known_of(phrases: pd.DataFrame) -> tuple[Known, Known]:
    """The numbers of frequent pairs and triples. phrases: level, pre, suf, number."""
    two, three = (Known(*(part[c].to_numpy(np.int64) for c in ("pre", "suf", "number"))) for part in (phrases[phrases["level"] == k] for k in (2, 3)))
    return two, three


def nothing() -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: [] for c in COUNTED.split(", ")})


def count_longer(shards: pd.DataFrame, size: int, two: Known, three: Known) -> pd.DataFrame:
    """Level 3 or 4 (``size``) of a shard."""
    if not len(shards) or not len(two.keys if size == 3 else three.keys):
        return nothing()
    text, alphabet, shard = (*(np.frombuffer(shards[c].iloc[0], t) for c, t in (("ids", np.int32), ("alphabet", np.int64))), int(shards["shard"].iloc[0]))
    place = two.place(alphabet)[text]
    linked = two.at(place[:-1], place[1:]) > 0
    text, alphabet = narrowed(np.where(np.concatenate([linked, [False]]) | np.concatenate([[False], linked]), text, BREAK), alphabet)
    index, place = FMIndex(text, len(alphabet)), two.place(alphabet)
    number = lambda found, k: two.at(place[found.words[:, k]], place[found.words[:, k + 1]])
    pairs = index.grown(index.singles(), left=True)
    found = index.grown(pairs.where(number(pairs, 0) > 0), left=False, final=size == 3)
    pre, suf = number(found, 0), number(found, 1)
    if size == 4:
        own = three.of(pre, suf)
        kept = own > 0
        found, inner = index.grown(found.where(kept), left=True, final=True), Known(pre[kept], suf[kept], own[kept])
        first, middle, last = (number(found, k) for k in range(3))
        pre, suf = inner.of(first, middle), inner.of(middle, last)
    kept = (pre > 0) & (suf > 0)
    return counted(shard, pre[kept], suf[kept], found.count[kept], text, alphabet)


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``number``: distinct ones from 1, near the number of rows. The rows, which ``keys`` identify, are dealt to buckets and numbered in each."""
    buckets = buckets_for(df.count())
    return df.withColumn("_b", dealt(*keys, n=buckets)).withColumn("number", (F.row_number().over(Window.partitionBy("_b").orderBy(*keys)) - 1).cast("long") * buckets + F.col("_b") + 1).drop("_b")


def level(rows: DataFrame, count, given: DataFrame, label: str) -> DataFrame:
    """A level's counts by shard, with the shards' texts. given: shard and what the shard is to know."""
    return written(rows.groupBy("shard").cogroup(given.withColumnRenamed("shard", "_of").groupBy("_of")).applyInPandas(count, COUNTED), label)


def longer(counts: DataFrame, known: list[tuple[int, DataFrame, DataFrame]], label: str) -> DataFrame:
    """The counts of the next level. counts: the level before; known: (level, its counts, its frequent phrases) of levels 2 and above."""
    texts, size = counts.where("ids IS NOT NULL").select("shard", "ids", "alphabet"), known[-1][0] + 1
    whole = reduce(DataFrame.unionByName, [found.select(F.lit(k).alias("level"), "pre", "suf", "number") for k, _, found in known])
    if not within(whole, BROADCAST_PHRASES):
        own = [rows.where("ids IS NULL").select("shard", "pre", "suf").join(found.select("pre", "suf", "number"), ["pre", "suf"]).select("shard", F.lit(k).alias("level"), "pre", "suf", "number") for k, rows, found in known]
        return level(texts, lambda shard, phrases: count_longer(shard, size, *known_of(phrases)), reduce(DataFrame.unionByName, own), label)
    shared = counts.sparkSession.sparkContext.broadcast(whole.toPandas())  # at most BROADCAST_PHRASES rows of four numbers

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = known_of(shared.value)
        for batch in batches:
            for i in range(len(batch)):
                yield count_longer(batch.iloc[i : i + 1], size, *here)

    return written(texts.mapInPandas(each, COUNTED), label)


def frequent(counts: DataFrame, least: int, label: str) -> DataFrame:
    """(pre, suf, n, number) of the phrases that are frequent over all shards."""
    sums = counts.where("ids IS NULL").groupBy("pre", "suf").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return written(numbered(written(sums, f"{label}-sums"), ["pre", "suf"]), label)


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to 4 words with ``least`` occurrences or more, and the number of words by language.

    Phrases: lang, phrase, size, a (occurrences), and of those with two words or more: cuts, an array of (k, l, r): occurrences of the first
    k words and of the rest; longer: the most occurrences of a phrase that has a word more on the left or the right (0: none is frequent).
    """
    shards = written(shards_of(docs, lang, text, shard_words), "phrases-shards")
    own = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "_w")).select("shard", "lang", "place", "_w.*")
    sums = written(own.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("n")), "phrases-words")
    total = sums.groupBy("lang").agg(F.sum("n").alias("words_total"))
    one = written(numbered(written(sums.where(F.col("n") >= least), "phrases-1-sums"), ["lang", "word"]), "phrases-1")
    places = own.select("shard", "lang", "place", F.col("words").alias("word")).join(one.select("lang", "word", "number"), ["lang", "word"]).select("shard", "place", "number")
    pairs = level(shards.select("shard", "ids"), count_pairs, places, "phrases-2-counts")
    two = frequent(pairs, least, "phrases-2")
    triples = longer(pairs, [(2, pairs, two)], "phrases-3-counts")
    three = frequent(triples, least, "phrases-3")
    fours = longer(triples, [(2, pairs, two), (3, triples, three)], "phrases-4-counts")
    four = frequent(fours, least, "phrases-4")
    return spelled(one, two, three, four), total


def spelled(one: DataFrame, two: DataFrame, three: DataFrame, four: DataFrame) -> DataFrame:
    """The levels' phrases as text, with the counts of their parts; each level is joined to the one before by the numbers of its two parts."""
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
    # ends: occurrences of the first one, and two, words and of the last ones
    before = one.select("number", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("a"), F.array("n").alias("firsts"), F.array("n").alias("lasts"))
    found = [before.select("lang", "phrase", F.lit(1).alias("size"), "number", "a", F.array().cast("array<struct<k:int,l:bigint,r:bigint>>").alias("cuts"))]
    for size, rows in ((2, two), (3, three), (4, four)):
        head = before.select(F.col("number").alias("pre"), "lang", F.col("phrase").alias("_head"), F.col("firsts").alias("_firsts"))
        tail = before.select(F.col("number").alias("suf"), "last", F.col("lasts").alias("_lasts"))
        joined = rows.join(head, "pre").join(tail, "suf")
        cuts = F.array(*[cut(k, F.get("_firsts", F.lit(k - 1)), F.get("_lasts", F.lit(size - k - 1))) for k in range(1, size)])
        before = written(joined.select("number", "pre", "suf", "lang", F.concat_ws(" ", "_head", "last").alias("phrase"), "last", F.col("n").alias("a"), F.concat("_firsts", F.array("n")).alias("firsts"), F.concat("_lasts", F.array("n")).alias("lasts"), cuts.alias("cuts")), f"phrases-{size}-text")
        grown = before.select(F.explode(F.array("pre", "suf")).alias("number"), "a").groupBy("number").agg(F.max("a").alias("longer"))
        found[-1] = found[-1].join(grown, "number", "left")
        found.append(before.select("lang", "phrase", F.lit(size).alias("size"), "number", "a", "cuts"))
    found[-1] = found[-1].withColumn("longer", F.lit(None).cast("long"))
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    return rows.withColumn("longer", F.coalesce("longer", F.lit(0))).drop("number")


def wide(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, absorbed: int = 80, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The best phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase scores by its weakest cut, floor(2,000,000 a / (l + r)), in exact arithmetic. It is left out if ``absorbed`` percent or more of its
    occurrences lie in one longer frequent phrase; a phrase longer by two words occurs no more often than one longer by one, so those decide.
    """
    found, total = phrases(docs, lang, text, least, shard_words)
    rows = found.where((F.col("size") > 1) & ((F.col("longer") == 0) | (wide(F.col("longer")) * 100 < wide(F.col("a")) * absorbed)))
    exact = F.expr("transform(cuts, c -> struct((CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(c.l AS DECIMAL(20,0)) + CAST(c.r AS DECIMAL(20,0))) AS score, c.k AS k, c.l AS l, c.r AS r))")
    scored = rows.withColumn("_cut", F.array_min(exact)).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(broadcast_within(total, 10_000), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words_total").alias("n"), F.col("score").cast("long").alias("score"))
