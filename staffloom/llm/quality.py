"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose measure lies above a cutoff. Cutoffs come from labelled texts, each distinct text of a stratum
counted once, as copies are no independent draws. The texts of a stratum are halved by a hash of the text:

- The design half proposes sets of cutoffs, one for each rule, from lax to strict (``PATH``): some steps above the
  largest measure of any good text, then those that reject up to so many in a thousand good texts by a rule. A rule that gains no more
  than ``slack`` in the design half (share of bad texts rejected less share of good ones) is off in that set.
- The holdout half tests the sets in that order, each by the exact binomial test of "the rules together reject good texts at
  a rate above the limit". The walk ends with the first that isn't refuted (fixed-sequence testing, which needs no correction along
  the path), and the level is split evenly over the strata (Bonferroni). So with probability ``1 - delta`` no
  stratum loses more than ``limit`` of its good texts to all rules together. Of the sets found safe the laxest one is taken whose gain
  in the holdout half is within ``slack`` of the best; a stratum without a gain, or with fewer good texts in
  the holdout half than ln(delta / strata) / ln(1 - limit) (85 for four strata), rejects by the base rules only.

Defined results: a null or empty text has no words and fails the base rules; a null stratum is a stratum; rows with a null
id or without a label are judged like others but teach nothing; of several labels of a text the worst counts; repeated rows get
equal verdicts; an empty table gives no rows. Other columns pass by; one named ``_m``, ``_md5``, ``_base_failed`` or ``kept`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffloom.llm.shared import broadcast_within, written

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
MEASURES = T.StructType([T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")])

#: Rules and what they measure, from 0 to 1.
RULES = {
    "symbols": lambda m: m["n_symbols"] / F.greatest(m["word_chars"], F.lit(1)),
    "duplicate_lines": lambda m: m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
    "repeated_words": lambda m: m["n_repeat_words"] / F.greatest(m["n_words"], F.lit(1)),
    "upper_case": lambda m: m["n_upper"] / F.greatest(m["word_chars"], F.lit(1)),
    "long_words": lambda m: F.least(m["word_chars"] / F.greatest(m["n_words"], F.lit(1)) / 40, F.lit(1.0)),
}
STEPS = 100
#: Sets of cutoffs, from lax to strict: steps above the design half's largest good one, then its good texts in a thousand that go.
PATH = [("above", 30), ("above", 20), ("above", 10), ("above", 5), ("above", 0), ("share", 5), ("share", 10), ("share", 20), ("share", 30), ("share", 40), ("share", 50), ("share", 75), ("share", 100)]
#: Windows from which a text's repeats are counted by numbers instead of tuples.
LONG = 20_000
#: Strata up to which the cutoffs are broadcast; beyond, the join shuffles.
BROADCAST_STRATA = 10_000


def repeated_words(found: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    n = len(found) - width + 1
    if n < 2:
        return 0
    if n < LONG:
        windows = list(zip(*(found[i:] for i in range(width)), strict=False))
        if len(set(windows)) == n:
            return 0
        times = Counter(windows)
        twice = np.fromiter((times[w] > 1 for w in windows), bool, n)
    else:  # numbers for words, then for windows one word longer, so that memory stays at some integers a word
        number: dict[bytes, int] = {}
        words = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
        own = words[:n]
        for i in range(1, width):
            own = np.unique(own * len(number) + words[i : i + n], return_inverse=True)[1]
        twice = np.bincount(own)[own] > 1
    edges = np.zeros(len(found) + 1, np.int64)
    edges[:n] += twice
    edges[width : width + n] -= twice
    return int((np.cumsum(edges)[: len(found)] > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measures of one text, null counting as empty; see MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()  # bytes split at ASCII white space only
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            duplicates += line in seen
            seen.add(line)
    repeated = repeated_words(found)
    return len(found), chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicates, repeated, len(raw) - len(raw.translate(None, UPPER)), lines


@F.pandas_udf(MEASURES)
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=MEASURES.names)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_m`` (the measures), ``_md5`` (of the text) and ``_base_failed``: under 10 words, or over a fifth of them in repeats."""
    found = docs.withColumn("_m", measures(F.col(text))).withColumn("_md5", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return found.withColumn("_base_failed", (F.col("_m.n_words") < 10) | (100 * F.col("_m.n_repeat_words") > 20 * F.col("_m.n_words")))


def steps(m: Column) -> list[Column]:
    """The step of each rule, in the order of RULES: a cutoff below it rejects."""
    return [F.ceil(rule(m) * STEPS).cast("int") for rule in RULES.values()]


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws at rate p."""
    if k >= n:
        return 1.0
    top = lgamma(n + 1)
    return min(1.0, sum(exp(top - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p)) for i in range(k + 1)))


def proposals(counts: dict[int, tuple[int, int]], slack: float) -> list[int]:
    """A rule's cutoff at each place of PATH, as a step (STEPS: the rule is off). counts: bad and good texts of the design half by step."""
    bad, good = (sum(c[i] for c in counts.values()) for i in (0, 1))
    if not good:
        return [STEPS] * len(PATH)
    above = lambda cut, i: sum(c[i] for step, c in counts.items() if step > cut)
    most = max(step for step, c in counts.items() if c[1])
    found = []
    for kind, value in PATH:
        cut = min(STEPS, most + value) if kind == "above" else next(c for c in range(STEPS + 1) if 1000 * above(c, 1) <= value * good)
        found.append(cut if above(cut, 0) / max(bad, 1) - above(cut, 1) / good > slack else STEPS)
    return found


def chosen(lost: list[int], caught: list[int], good: int, bad: int, limit: float, level: float, slack: float) -> int:
    """The place of PATH to take, -1 for none, by the good and bad texts of the holdout half that each rejects."""
    safe = []
    for n in range(len(PATH)):
        if not good or binomial_cdf(lost[n], good, limit) > level:
            break
        safe.append(caught[n] / max(bad, 1) - lost[n] / good)
    best = max(safe, default=0.0)
    return next(n for n, gain in enumerate(safe) if gain >= best - slack) if best > slack else -1


def fit_cutoffs(found: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", limit: float = 0.05, delta: float = 0.05, slack: float = 0.01) -> DataFrame:
    """Cutoffs by stratum from all labelled texts that pass the base rules.

    found: rows of ``measured``. labels: key, quality (1 good, 0 bad; null is no label). Returns one row per stratum and
    rule: stratum, rule, cutoff, n_good, n_rejected (good texts of the holdout half, and those that all rules reject). Only counts meet in
    one place, at most 101 a rule and stratum, or one for each set of PATH.
    """
    marks = labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("_good"))
    rows = found.where(~F.col("_base_failed")).select(F.col(key).alias("_key"), F.col(stratum).cast("string").alias("stratum"), F.col("_md5").alias("md5"), F.array(*steps(F.col("_m"))).alias("steps"))
    texts = rows.join(marks, "_key").groupBy("stratum", "md5").agg(F.min("_good").alias("good"), F.first("steps").alias("steps"))
    texts = written(texts.where(F.col("good").isin(0, 1)).withColumn("design", F.substring("md5", 1, 1) < "8"), "quality-texts")
    level = delta / max(1, texts.select("stratum").distinct().count())
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.get("steps", F.lit(i)).alias("step")) for i, k in enumerate(RULES)])
    counts = texts.where("design").select("stratum", "good", F.explode(rules).alias("r")).groupBy("stratum", "r.rule", "r.step").agg(F.count_if(F.col("good") == 0).alias("bad"), F.count_if(F.col("good") == 1).alias("good"))

    def propose(group: pd.DataFrame) -> pd.DataFrame:
        cuts = proposals({int(r.step): (int(r.bad), int(r.good)) for r in group.itertuples()}, slack)
        return pd.DataFrame({"stratum": group["stratum"].iloc[0], "rule": group["rule"].iloc[0], "place": range(len(PATH)), "cut": cuts})

    cuts = written(counts.groupBy("stratum", "rule").applyInPandas(propose, "stratum string, rule string, place int, cut int"), "quality-proposals")
    wide = cuts.groupBy(F.col("stratum").alias("_of"), "place").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cut"))
    sets = wide.select("_of", "place", F.array(*[F.col("cut")[k] for k in RULES]).alias("cut"))
    holdout = texts.where("not design").join(broadcast_within(sets, BROADCAST_STRATA * len(PATH)), F.col("stratum").eqNullSafe(F.col("_of")))
    goes = reduce(lambda a, b: a | b, [F.get("steps", F.lit(i)) > F.get("cut", F.lit(i)) for i in range(len(RULES))])
    is_good = F.col("good") == 1
    tested = holdout.groupBy("stratum", "place").agg(F.count_if(goes & is_good).alias("lost"), F.count_if(goes & ~is_good).alias("caught"), F.count_if(is_good).alias("n_good"), F.count_if(~is_good).alias("n_bad"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("place")
        good, bad = int(rows["n_good"].iloc[0]), int(rows["n_bad"].iloc[0])
        place = chosen(rows["lost"].tolist(), rows["caught"].tolist(), good, bad, limit, level, slack)
        return pd.DataFrame([(rows["stratum"].iloc[0], place, good, int(rows["lost"].iloc[place]) if place >= 0 else 0)], columns=["_of", "place", "n_good", "n_rejected"])

    taken = tested.groupBy("stratum").applyInPandas(choose, "_of string, place int, n_good long, n_rejected long")
    return written(cuts.join(taken, F.col("stratum").eqNullSafe(F.col("_of")) & (cuts["place"] == taken["place"])).select("stratum", "rule", (F.col("cut") / STEPS).alias("cutoff"), "n_good", "n_rejected"), "quality-cutoffs")


def apply_cutoffs(found: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``kept``: false if the base rules or a cutoff of the row's stratum reject it."""
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut")).withColumnRenamed("stratum", "_stratum")
    joined = found.join(broadcast_within(wide, BROADCAST_STRATA), found[stratum].cast("string").eqNullSafe(F.col("_stratum")), "left")
    fails = reduce(lambda a, b: a | b, [F.coalesce(step > F.round(F.col("_cut")[k] * STEPS), F.lit(False)) for k, step in zip(RULES, steps(F.col("_m")), strict=True)])
    return joined.withColumn("kept", ~F.col("_base_failed") & ~fails).drop("_stratum", "_cut")
