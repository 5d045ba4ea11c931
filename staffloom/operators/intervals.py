"""Joins and clash flags of half-open intervals within a key, whatever their lengths. Times are timestamp_ntz.

Two intervals overlap if each begins before the other ends; so an empty one, which ends where it begins, overlaps those that have its time inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The width of a unit of time: times within one are told apart by comparison only.
UNIT = 86_400 * 1_000_000


def micros(time: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)")


def unit(time: str) -> Column:
    return F.floor(micros(time) / UNIT).cast("long")


def height(*spans: tuple[DataFrame, str, str]) -> int:
    """The level of the tree of units at which the longest of some intervals is a few nodes wide."""
    longest = [df.agg(F.max(unit(end) - unit(start))).first()[0] for df, start, end in spans]
    return (max([0, *(n for n in longest if n)]) + 1).bit_length() - 1


def node(level: int, number: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), number.alias("node"))


def over(start: str, end: str, top: int) -> Column:
    """The largest nodes that together are the units an interval touches; at level k a node is 2^k units.

    Going up, a border within a parent leaves the node beside it: two a level at most, and at the top what is left.
    """
    first, after, found = unit(start), F.greatest(unit(start), unit(end)) + 1, []
    for k in range(top + 1):
        low, high = F.ceil(first / (1 << k)).cast("long"), F.floor(after / (1 << k)).cast("long")
        if k == top:
            found.append(F.when(low < high, F.transform(F.sequence(low, high - 1), lambda n: node(top, n))))
        else:
            found += [F.when((low < high) & (F.pmod(border, F.lit(2)) == border_is), F.array(node(k, at))) for border, border_is, at in ((low, 1, low), (high, 1, high - 1))]
    return F.flatten(F.array_compact(F.array(*found)))


def above(time: str, top: int) -> Column:
    """The nodes that hold a time, one a level."""
    return F.array(*[node(k, F.floor(unit(time) / (1 << k)).cast("long")) for k in range(top + 1)])


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows of equal keys whose intervals overlap, each once; but for the keys, columns have different names.

    One of two overlapping intervals begins within the other, so a begin meets the nodes of the other interval: an equi-join, in which an interval
    takes part by the logarithm of its length. Columns of both sides are kept.
    """
    top = height((left, *left_span), (right, *right_span))
    tagged = lambda nodes, kind: F.transform(nodes, lambda n: F.struct(F.lit(kind).alias("kind"), n["level"].alias("level"), n["node"].alias("node")))
    # kind 0: the left one begins in the right one, or with it; kind 1: the right one begins later
    a = left.withColumn("_at", F.explode(F.concat(tagged(above(left_span[0], top), 0), tagged(over(*left_span, top), 1))))
    b = right.withColumn("_at", F.explode(F.concat(tagged(over(*right_span, top), 0), tagged(above(right_span[0], top), 1))))
    pairs = a.join(b, [*keys, "_at"])
    later = F.col(right_span[0]) > F.col(left_span[0])
    return pairs.where((F.col(right_span[0]) < F.col(left_span[1])) & (F.col(right_span[1]) > F.col(left_span[0])) & (later == (F.col("_at.kind") == 1))).drop("_at")


#: The width of a span of time within which ``clash_flags`` sorts the rows of a key, in units.
SPAN = 256


def clash_flags(rows: DataFrame, keys: list[str], start: str, end: str, asks: Column | None = None, holds: Column | None = None, out: str = "clash") -> DataFrame:
    """The rows that ask, with whether another row of their keys that holds overlaps them; rows are never paired.

    By begin, a row overlaps an earlier one if the latest end so far lies behind its begin, and a later one if the next begin lies before its end.
    A key's rows are sorted by spans of ``SPAN`` days; of other spans only the extremes count, so a busy key is spread over tasks and the rows of a calm one
    stay together. Each row is looked at once: what comes next is the next value that there is, not a minimum over all that follow. An interval that ends
    before it begins counts as empty; one without times clashes with none.
    """
    asks, holds = (F.lit(True) if c is None else c for c in (asks, holds))
    timed = rows.withColumns({"_s": micros(start), "_e": F.greatest(micros(start), micros(end)), "_span": F.floor(unit(start) / SPAN)})
    real, instant = holds & (F.col("_e") > F.col("_s")), holds & (F.col("_e") == F.col("_s"))
    ends, begins, instants = F.when(real, F.col("_e")), F.when(real, F.col("_s")), F.when(instant, F.col("_s"))
    by_key = ", ".join(f"`{k}`" for k in keys)
    following = lambda c, by, order: F.expr(f"lead({c}) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY {order})")
    spans = timed.groupBy(*keys, "_span").agg(F.max(ends).alias("_ends"), F.min(begins).alias("_begins"), F.min(instants).alias("_instants"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_span", F.max("_ends").over(before).alias("_before"), following("_begins", by_key, "_span").alias("_behind"), following("_instants", by_key, "_span").alias("_instant"))
    # rows are dealt once, by a key that is never null, for the windows and the join; what follows from their columns is computed behind that
    placed = F.struct(*keys, "_span").alias("_key")
    dealt = timed.select(placed, *[c for c in timed.columns if c not in (*keys, "_span")]).repartition("_key").withColumns({k: F.col("_key")[k] for k in keys})
    # of equal begins empty intervals come first: so what is before an empty one begins before it, and the next empty one begins after a real one
    dealt = dealt.withColumns({"_long": F.col("_e") > F.col("_s"), "_begin": begins, "_point": instants})
    earlier = Window.partitionBy("_key").orderBy("_s", "_long").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c: following(c, "_key", "_s, _long")
    seen = dealt.withColumns({"_ends_1": F.max(ends).over(earlier), "_begins_1": own("_begin"), "_instants_1": own("_point")})
    joined = seen.where(asks).join(spans.select(placed, "_before", "_behind", "_instant"), "_key", "left")
    at, until = F.col("_s"), F.col("_e")
    past = F.greatest("_ends_1", "_before") > at
    meets = past | (F.least("_begins_1", "_behind") < until) | (F.least("_instants_1", "_instant") < until)
    return joined.withColumn(out, F.coalesce(F.when(until > at, meets).otherwise(past), F.lit(False))).select(*rows.columns, out)
