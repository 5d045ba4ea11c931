"""Balanced label propagation: documents move towards the shards of the documents they are linked to.

Links join documents with equal texts. All members of a group are linked to each other, so a document's
neighbours by shard are its group's numbers by shard, and documents of one group and shard are alike: the state of the
propagation is one row (a cell) per group and shard, at most ``shards`` rows for a group of any size, and no pair of
documents is ever made.

Each round looks at the cells of each group: a cell wants to move to a larger cell of its group, to one in a shard with
room if there is one. Wishes are summed by pair of shards and size, quotas are set on those sums, and the cells are joined with what is
granted. Quotas between two shards are what they exchange evenly, and beyond that the room of the target. Where more
want to move than may, each cell moves in part, those with the most neighbours at the target first. Rounds end when nothing may
move, when the number of links within shards has not risen in two rounds, or after ``rounds`` (24) of them.
The last step turns cells into documents: members of a group are numbered and take the cells' places in turn; what a shard
can't hold and documents without links fill the room that is left. So the law ``rows`` holds exactly: shard sizes differ by one
at most, and only groups that no shard can hold whole, or that quotas kept apart, are cut.

Defined results: a null text has no bytes and is grouped with empty texts; a null key is a key; repeated rows are placed each; an
empty table gives no rows; other columns are left out. With fewer rows than shards the first shards get one row each.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffloom.llm.shared import buckets_for, dealt, gapless, written


def base(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, size, text_crc32 and the group: narrow rows, all that is ever shuffled."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), F.monotonically_increasing_id().alias("_u"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64(raw).alias("_g"))


def capacity(shard: Column, rows: int, shards: int) -> Column:
    return F.lit(rows // shards) + (shard < rows % shards).cast("long")


def first_cells(groups: DataFrame, shards: int) -> DataFrame:
    """Members dealt round-robin from a shard of the group's own: the random but even start."""
    start = dealt("_g", F.lit("start"), n=shards)
    used = F.least(F.col("n"), F.lit(shards)).cast("int")
    each = F.floor(F.col("n") / shards)
    cell = lambda i: F.struct((each + (i < F.col("n") % shards).cast("long")).cast("long").alias("m"), ((F.col("at") + i) % shards).cast("int").alias("shard"))
    return groups.withColumn("at", start).select("_g", F.col("text_crc32").alias("_c"), F.transform(F.sequence(F.lit(0), used - 1), cell).alias("cells"))


def quotas(wants: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many may move between two shards: even exchanges, then the target's room in turn (at most shards^2 numbers)."""
    allowed = {p: min(n, wants.get((p[1], p[0]), 0)) for p, n in wants.items()}
    left = dict(room)
    for (s, t), n in sorted(wants.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - allowed[s, t], max(left.get(t, 0), 0))
        allowed[s, t] += more
        left[t] = left.get(t, 0) - more
    return allowed


def wishes(cells: DataFrame, open_: list[int], step: int) -> DataFrame:
    """A row per cell: its group, shard, number m, the shard it wants to move to (null: none) and the log of that one's number."""
    # equal cells are ordered by a hash of the round, so that they flow both ways
    lots = F.transform("cells", lambda c: F.struct(c["m"].alias("m"), F.xxhash64("_g", "_c", c["shard"], F.lit(step)).alias("r"), c["shard"].alias("shard")))
    all_ = cells.select("_g", "_c", F.sort_array(lots, asc=False).alias("all"))
    larger = F.slice("all", F.lit(1), F.col("i"))
    target = F.coalesce(F.get(F.filter(larger, lambda c: c["shard"].isin(open_ or [-1])), F.lit(0)), F.get(larger, F.lit(0)))
    each = all_.select("_g", "_c", "all", F.posexplode("all").alias("i", "cell")).select("_g", "_c", "cell", F.when(F.col("i") > 0, target).alias("t"))
    return each.select("_g", "_c", "cell.shard", "cell.m", F.col("t.shard").alias("to"), F.floor(F.log2(F.col("t.m").cast("double"))).cast("int").alias("gain"))


def propagate(cells: DataFrame, rows: int, shards: int, rounds: int = 24) -> DataFrame:
    """Groups with their cells (number of members, shard) after the moves."""
    caps = {s: rows // shards + (s < rows % shards) for s in range(shards)}
    open_, best, idle = list(range(shards)), -1.0, 0
    for step in range(rounds):
        wanted = wishes(cells, open_, step)
        square = (F.col("m").cast("double") * F.col("m")).alias("square")
        sums = wanted.select("*", square).groupBy("shard", "to", "gain").agg(F.sum("m").alias("m"), F.sum("square").alias("square")).collect()  # at most shards^2 x 64 rows
        asked = [r for r in sums if r["to"] is not None]
        inside = sum(r["square"] for r in sums)
        idle = 0 if inside > best else idle + 1
        best = max(best, inside)
        if not asked or idle == 2:
            break
        loads, wants = Counter(), Counter()
        for r in sums:
            loads[r["shard"]] += r["m"]
        for r in asked:
            wants[r["shard"], r["to"]] += r["m"]
        left, share = quotas(wants, {s: caps[s] - loads[s] for s in range(shards)}), []
        for r in sorted(asked, key=lambda r: (-r["gain"], r["shard"], r["to"])):
            n = min(r["m"], left[r["shard"], r["to"]])
            left[r["shard"], r["to"]] -= n
            loads[r["shard"]] -= n
            loads[r["to"]] += n
            share.append((r["shard"], r["to"], r["gain"], n / r["m"]))
        if not any(part for *_, part in share):
            break
        open_ = [s for s in range(shards) if caps[s] > loads[s]]
        granted = F.broadcast(cells.sparkSession.createDataFrame(share, "shard int, to int, gain int, part double"))
        chance = dealt("_g", "_c", "shard", F.lit(step), n=1 << 20) / float(1 << 20)
        moved = wanted.join(granted, ["shard", "to", "gain"], "left").withColumn("k", F.least(F.col("m"), F.floor(F.col("m") * F.coalesce("part", F.lit(0.0)) + chance).cast("long")))
        ends = F.array(F.struct((F.col("m") - F.col("k")).alias("m"), "shard"), F.struct(F.col("k").alias("m"), F.col("to").alias("shard")))
        parts = moved.select("_g", "_c", F.explode(F.filter(ends, lambda e: e["m"] > 0)).alias("e")).groupBy("_g", "_c").agg(F.collect_list("e").alias("e"))  # at most 2 x shards entries
        together = lambda s: F.struct(F.aggregate(F.filter("e", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda a, x: a + x["m"]).alias("m"), s.alias("shard"))
        cells = written(parts.select("_g", "_c", F.transform(F.array_distinct(F.col("e.shard")), together).alias("cells")), "shard-cells")
    return cells


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, rounds: int = 24) -> DataFrame:
    """Returns key, size, text_crc32, shard, slot (from 0 within the shard) and n_equal (rows with the same text)."""
    found = written(base(docs, key, text), "shard-rows")
    rows = found.count()
    if not rows:
        return found.select(key, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(1).cast("long").alias("n_equal"))
    buckets = buckets_for(rows)
    groups = written(found.groupBy("_g", "text_crc32").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-groups")
    cells = propagate(written(first_cells(groups, shards), "shard-cells"), rows, shards, rounds)
    sized = found.join(groups, ["_g", "text_crc32"], "left")
    # linked documents take the places of their group's cells in turn, the largest cell first
    ordered = cells.select("_g", F.col("_c").alias("text_crc32"), F.sort_array("cells", asc=False).alias("cells"))
    upto = lambda i: F.aggregate(F.slice("cells", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["m"])
    ends = ordered.select("_g", "text_crc32", F.transform("cells", lambda x, i: F.struct(upto(i).alias("end"), x["shard"].alias("shard"))).alias("ends"))
    members = gapless(sized.where("n is not null"), ["_g", "text_crc32"], [key, "_u"], buckets, "_nth")
    linked = members.join(ends, ["_g", "text_crc32"]).withColumn("shard", F.get(F.filter("ends", lambda e: e["end"] > F.col("_nth")), F.lit(0))["shard"])
    placed = written(gapless(linked.select(key, "_u", "size", "text_crc32", "n", "shard"), ["shard"], [key, "_u"], buckets, "slot"), "shard-linked")
    kept = placed.where(F.col("slot") < capacity(F.col("shard"), rows, shards))
    excess = placed.where(F.col("slot") >= capacity(F.col("shard"), rows, shards)).select(key, "_u", "size", "text_crc32", "n")
    taken = {r["shard"]: r["k"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("k")).collect()}
    free = [(s, rows // shards + (s < rows % shards) - taken.get(s, 0)) for s in range(shards)]
    pool = gapless(sized.where("n is null").select(key, "_u", "size", "text_crc32", "n").union(excess), [], [key, "_u"], buckets, "_p")
    starts = [sum(n for _, n in free[:s]) for s in range(shards)]  # the pool fills the shards' room in their order
    found_at = F.size(F.filter(F.lit([a + n for a, (_, n) in zip(starts, free, strict=True)]), lambda end: end <= F.col("_p")))
    first = F.get(F.lit([taken.get(s, 0) - a for s, a in enumerate(starts)]), F.col("shard"))
    filled = pool.withColumn("shard", found_at).select(key, "size", "text_crc32", "n", "shard", (F.col("_p") + first).alias("slot"))
    both = kept.select(key, "size", "text_crc32", "n", "shard", "slot").union(filled)
    return both.select(key, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.coalesce("n", F.lit(1)).alias("n_equal"))
