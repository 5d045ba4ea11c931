"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions only.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's five-word shingles (a text with fewer
words is one shingle; one without words has none), sorted. Sketches of parts merge into the sketch of the
whole, and two of them estimate resemblance, containment and numbers of distinct shingles.

Defined results: a null text counts as empty; equal texts have equal sketches; two empty sketches are
alike (1.0), an empty one and another are not (0.0); a table of one row has itself as the next; an empty table gives no rows; other
columns pass by, but for one named as a column that is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from staffloom.llm.shared import let, words, written

K = 64
WIDTH = 5


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles, repeats included. Words are hashed once each, shingles from those."""
    shingles = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, width)))
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(shingles(h)))


def bottom(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return bottom(shingle_hashes(text, width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom(F.concat(a, b), k)


def merge_groups(df: DataFrame, keys: list[str], column: str, k: int = K, salts: int = 32) -> DataFrame:
    """Merges the sketches of each group; a group of any size is cut down to k hashes per salt first."""
    hashes = df.select(*keys, F.explode(column).alias("_h")).distinct()
    first = Window.partitionBy(*keys, "_salt").orderBy("_h")
    cut = hashes.withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts))).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    return cut.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of either text."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common.cast("double") / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k-1) over the part of the hash range in use."""
    part = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(part, F.lit(1e-18)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has as well."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    common = resemblance(a, b, k) * distinct_shingles(both, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def text_of(sketched: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, key: str, carried: list[str], per_range: int = 4_000, most_ranges: int = 100_000) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: that of the next row by key, the first row's for the last.

    Rows are ordered by key and, where keys are equal or null (nulls first), by the carried columns. Spark's range
    partitioning of the key and the first 64 characters of the first carried column gives ranges of about ``per_range`` rows whatever the spread of keys (of more, once there are
    ``most_ranges``); the ranges' first places are written down, and every row finds its range by bisecting them. Each range is
    sorted on its own. The first row of a range is copied to the end of the range before, so that texts are shuffled once.
    """
    place = F.struct(F.col(key).alias("k"), F.substring(F.col(carried[0]).cast("string"), 1, 64).alias("t"))
    n = max(1, min(most_ranges, -(-docs.count() // per_range)))
    first = docs.select(place.alias("p")).repartitionByRange(n, "p").groupBy(F.spark_partition_id().alias("part")).agg(F.min("p").alias("low"))
    ranges = written(first, "next-ranges")
    lows = ranges.agg(F.sort_array(F.collect_list("low")).alias("lows")).scalar()  # at most most_ranges keys and short strings
    m = ranges.count()
    bits = F.lit([1 << i for i in reversed(range(max(m, 1).bit_length()))])
    bisected = F.aggregate(bits, F.lit(0), lambda at, bit: F.when(F.get(F.col("_lows"), at + bit) <= F.col("_p"), at + bit).otherwise(at))
    own = [c for c in docs.columns if c not in {f"next_{c}" for c in carried}]
    placed = docs.select(F.struct(*own).alias("_row"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)], place.alias("_p"), lows.alias("_lows")).withColumn("_range", bisected)
    names = [f"_c{i}" for i in range(len(carried))]
    heads = placed.where(F.get("_lows", F.col("_range")) == F.col("_p")).groupBy("_range").agg(F.min(F.struct("_p", *names)).alias("h")).select("_range", "h.*")
    copies = heads.select(F.pmod(F.col("_range") - 1, F.lit(max(m, 1))).alias("_range"), F.lit(True).alias("_copy"), F.col("_p"), *names)
    rows = placed.select("_range", F.lit(False).alias("_copy"), "_p", *names, "_row").unionByName(copies, allowMissingColumns=True)
    inside = Window.partitionBy("_range").orderBy("_copy", "_p", *names)
    following = rows.select("_copy", "_row", *[F.lead(c).over(inside).alias(f"next_{own_c}") for c, own_c in zip(names, carried, strict=True)])
    return following.where(~F.col("_copy")).select("_row.*", *[f"next_{c}" for c in carried])


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the following one."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half))
