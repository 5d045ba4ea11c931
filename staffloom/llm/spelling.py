"""Spelling variants of a corpus's words: near words by a variable-length gram index, forms and roots.

1. Dictionary. All grams of the distinct words, each bordered by ``^`` and ``$``, are counted. Those of 2 to 5 characters that are more frequent than ``SHARE`` of
   all grams of their length (under 1 / ``SHARE`` a length, so the dictionary is small at any size) are the inner nodes of the gram tree; all
   rarer nodes are pruned to leaves.
2. Decomposition. At each place of a word stands the gram that the tree's walk ends with: it grows while it is an inner node, to half of the bordered
   word at most. Grams within another are left out. A gram depends on its own characters alone.
3. Bounds. For each word the most grams that one replaced, or one inserted, character can affect: those that hold its place, and those that a new gram from
   before it could come to hold. As grams reach over half of a word at most, at least one gram is never affected.
4. Lists. Of a word's grams the rarest, one more than can be affected, meet the words of the same length, and of one more, that have the gram at the
   same place (or a place later): a near word has at least one of them. A list of more than ``LONG_LIST`` words is split by what must be equal as well: one
   side of the gram, and a half of the other side.
5. Candidates are verified by their edit distance.

Shorter words ask for longer ones, so deletions need no bounds. Defined results: a null text has no words, a null id counts as an empty one; repeated rows count each; words of any length
are read whole; of equal near words the first in code-point order is the form; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffloom.llm.shared import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(65, 91)}
LEAST_CHARS, LEAST_COUNT = 6, 5
SHORTEST, LONGEST = 2, 6
SHARE = 1 / 20_000
FEW = 8
LONG_LIST = 400
#: Distinct words that a task holds before it hands on their counts.
HELD = 200_000


def fold(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(FOLD)


def handed(counts: Counter, column: str) -> pd.DataFrame:
    rows = pd.DataFrame({column: pd.Series(list(counts.keys()), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})
    counts.clear()
    return rows


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least: int = LEAST_COUNT, thinned: int = 0) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A to Z lower-cased.

    thinned: where that number divides the crc32 h of ``<key>:<run>``, the run's character h % length is left out before it counts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for name, value in zip(batch["key"], batch["text"], strict=True):
                start = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(RUN.findall(value)).items():
                    word = fold(run)
                    if thinned and not (h := zlib.crc32(word.encode(), start)) % thinned:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                    if len(word) >= least_chars:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield handed(counts, "word")
        yield handed(counts, "word")

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text")).where("text <> ''")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def bordered(word: str) -> str:
    return f"^{word}$"


def reach(chars: int) -> int:
    """The longest gram of a word of so many characters: half of the bordered word."""
    return min(LONGEST, (chars + 2) // 2)


def gram_dictionary(words: DataFrame, share: float = SHARE) -> dict[str, int]:
    """The frequent grams and their counts: under 1 / share of each length."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch["word"]:
                whole = bordered(word)
                for q in range(SHORTEST, LONGEST):
                    counts.update(whole[p : p + q] for p in range(len(whole) - q + 1))
                if len(counts) >= HELD:
                    yield handed(counts, "gram")
        yield handed(counts, "gram")

    grams = words.select("word").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = written(grams, "spelling-grams")
    totals = grams.groupBy(F.char_length("gram").alias("_q")).agg(F.greatest(F.sum("n") * F.lit(share), F.lit(float(FEW))).alias("_more_than"))
    found = grams.join(F.broadcast(totals), F.char_length("gram") == F.col("_q")).where(F.col("n") > F.col("_more_than"))
    return {r["gram"]: r["n"] for r in found.select("gram", "n").toLocalIterator()}


def decomposed(whole: str, inner: dict[str, int], longest: int) -> list[tuple[int, int]]:
    """The variable grams of a bordered word as (place, length)."""
    found, end, size = [], 0, len(whole)
    for p in range(size - SHORTEST + 1):
        q = SHORTEST
        while q < longest and p + q < size and whole[p : p + q] in inner:
            q += 1
        if p + q > end:
            found.append((p, q))
            end = p + q
    return found


def affected(grams: list[tuple[int, int]], size: int, longest: int) -> tuple[int, int]:
    """The most grams that one replaced, and one inserted, character can affect."""
    replaced = max(sum(p <= i < p + q or (i < p and p + q - i <= longest) for p, q in grams) for i in range(1, size - 1))
    inserted = max(sum(p < j < p + q or (j <= p and p + q + 1 - j <= longest) for p, q in grams) for j in range(1, size))
    return replaced, inserted


LISTED = "word string, n long, reach int, gram string, length int, place int, asked int"
#: What a row of a list asks for (or, of the index, nothing): the same length, one more after the gram, one more before it.
INDEXED, SAME, AFTER, BEFORE = -1, 0, 1, 2


def listed(words: DataFrame, inner: dict[str, int]) -> DataFrame:
    """Rows of the gram lists: each word's own grams under the reach of words of its length and one less, and the grams by which it asks."""
    shared = words.sparkSession.sparkContext.broadcast(inner)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            for start in range(0, len(batch), 5_000):
                out = []
                part = batch.iloc[start : start + 5_000]
                for word, n in zip(part["word"], part["n"], strict=True):
                    whole, chars = bordered(word), len(word)
                    for longest in {reach(chars), reach(chars - 1)}:
                        grams = decomposed(whole, known, longest)
                        out += [(word, n, longest, whole[p : p + q], chars, p, INDEXED) for p, q in grams]
                        if longest == reach(chars):
                            own = sorted(grams, key=lambda g: (known.get(whole[g[0] : g[0] + g[1]], 0), -g[1], g[0]))
                            replaced, inserted = affected(grams, len(whole), longest)
                            out += [(word, n, longest, whole[p : p + q], chars, p, SAME) for p, q in own[: replaced + 1]]
                            for p, q in own[: inserted + 1]:
                                out += [(word, n, longest, whole[p : p + q], chars + 1, p, AFTER), (word, n, longest, whole[p : p + q], chars + 1, p + 1, BEFORE)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in LISTED.split(", ")], dtype=object)

    return words.select("word", "n").mapInPandas(rows, LISTED)


LIST = ["reach", "gram", "length", "place"]


def split_lists(rows: DataFrame, long: DataFrame) -> DataFrame:
    """Adds ``rest``: empty, or for words of a long list, by row, what must be equal besides the gram: a side of it and a half of the other side."""
    marked = rows.join(long, LIST, "left")
    whole, at = F.concat(F.lit("^"), "word", F.lit("$")), F.col("place") - (F.col("asked") == BEFORE).cast("int")
    head, tail = F.substring(whole, F.lit(1), at), F.substring(whole, at + F.char_length("gram") + 1, F.char_length(whole))
    index = F.col("asked") == INDEXED

    def halves(kind: int, same, other, longer: bool):
        """longer: the other side of an indexed word has a character more than that of the word that asks."""
        more = F.when(index, F.lit(int(longer))).otherwise(0)
        half = F.floor((F.char_length(other) - more) / 2).cast("int")
        first, last = F.substring(other, F.lit(1), half), F.substring(other, half + more + 1, F.char_length(other))
        return F.array(*[F.concat(F.lit(f"{kind}{k}|"), same, F.lit("|"), part) for k, part in ((1, first), (2, last))])

    same = F.concat(halves(0, head, tail, False), halves(1, tail, head, False))
    after, before = halves(2, head, tail, True), halves(3, tail, head, True)
    keys = F.when(index, F.concat(same, after, before)).when(F.col("asked") == SAME, same).when(F.col("asked") == AFTER, after).otherwise(before)
    return marked.select("word", "n", *LIST, "asked", F.explode(F.when(F.col("_long"), keys).otherwise(F.array(F.lit("")))).alias("rest"))


def near_words(words: DataFrame, share: float = SHARE, long_list: int = LONG_LIST) -> DataFrame:
    """Pairs (word, n, other, other_n) of words that differ by one replaced, inserted or deleted character, each once, the shorter or smaller word first. words: word, n."""
    rows = written(listed(words, gram_dictionary(words, share)), "spelling-lists")
    index, asking = F.col("asked") == INDEXED, F.col("asked") != INDEXED
    long = written(rows.where(index).groupBy(*LIST).count().where(F.col("count") > long_list).select(*LIST, F.lit(True).alias("_long")), "spelling-long")
    keyed = split_lists(rows, long)
    held = keyed.where(index).select(F.col("word").alias("other"), F.col("n").alias("other_n"), *LIST, "rest")
    pairs = keyed.where(asking).join(held, [*LIST, "rest"]).where((F.col("asked") != SAME) | (F.col("word") < F.col("other")))
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()


def variants(words: DataFrame, ratio: int = 5, share: float = SHARE, long_list: int = LONG_LIST) -> DataFrame:
    """word, form, root, n, n_near, form_n. words: word, n, distinct.

    The form is the most frequent near word if it occurs ``ratio`` times as often; the root is the last of a word's forms.
    """
    words = written(words, "spelling-words")
    pairs = written(near_words(words, share, long_list), "spelling-near")
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    rows = words.join(found, "word", "left").withColumn("form", F.when(-F.col("_best.less") >= F.col("n") * ratio, F.col("_best.form")))
    rows = written(rows.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), -F.col("_best.less")).alias("form_n")), "spelling-forms")
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(rows: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. Each round doubles the steps; forms are ``ratio`` times as frequent, so there are few."""
    found = written(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = written(found.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        found = further.select("word", "root")
        if further.where("_moved").isEmpty():
            return found
