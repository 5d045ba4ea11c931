"""SimHash near-duplicate detection with BK-trees.

Fingerprints are linked at up to ``radius`` differing bits. Equal fingerprints are taken together first. Then the
64 bits are split into radius + 2 blocks: linked fingerprints agree on two blocks at least, so the fingerprints with the
same values of two blocks make one search group (a fingerprint is in one group for each two blocks; with 16-bit blocks a group is what
32 bits have in common, so that groups stay small in large tables). Groups with the same members are searched once.

A group of more than ``shard`` fingerprints is cut into shards by a hash that differs from group to group. A shard's BK-tree (children
keyed by their distance to the parent) is first searched by the shard's own members, which follow only edges within the radius. As the
shards of different groups overlap, what is in one component mostly is in one component by then. For the rest, the members of a
large group outside its largest component, the group's shard trees are built once and broadcast to packs of those members (behind
a check of their bytes; a larger set of trees is joined by shuffle). So no link between different components is missed, a hot group of one
component costs no more than its rows, and no pairs of all members are ever made. A search returns the links of a spanning forest of
what it found.

With a ``similarity``, texts are near copies from that Jaccard similarity of their word shingles on. A radius wide enough for
0.8 (20 of 64 bits: at 0.8 about 10 differ, more than 20 in about one pair of 3,000) has no blocks that all linked fingerprints
share, so the search groups are the values of 16 bands of 4 minhashes there (at 0.8 a pair misses all of them with probability
0.0002). The BK-trees search within the groups as before, and what they find is verified on the shingles themselves, so every
link has the similarity; texts with the same shingles are one value. These fingerprints take each shingle once, as the similarity does.

Connected components of the links are found by alternating large-star and small-star steps, written to the shared folder
in each round; they settle in a number of rounds that grows with the logarithm of the longest path, and after ``rounds`` (40) without
settling an error is raised, never a wrong result given.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; a row with a null key gets
the component of its text, or a null one where no row with a key is in it; repeated rows get a row each; an empty table gives no rows;
other columns are left out; fingerprints and components don't depend on the order or the partitioning of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staffloom.llm.shared import written

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Minhashes: bands of so many rows, and what each one mixes into a shingle's hash.
BANDS, ROWS = 16, 4
MIX = np.random.default_rng(42).integers(0, 1 << 64, (BANDS * ROWS, 2), np.uint64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; bit set if more than half of the hashes have it."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    last = max(len(found) - width, 0) + 1
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), 0
    for at in range(0, last, 1 << 16):
        stop = min(at + (1 << 16), last)
        hashes = np.array([digest(b" ".join(found[i : i + width]), seed) for i in range(at, stop)], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += stop - at
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(text: Column, width: int = 3) -> Column:
    """Fingerprints as signed longs."""

    @F.pandas_udf(T.LongType())
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return found(text)


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; a shorter text is one shingle, a blank one has none."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(found[i : i + width]), seed) for i in range(max(len(found) - width, 0) + 1)] if found else [], np.uint64))


def summary(found: np.ndarray) -> tuple[int, int, list[int]]:
    """(value, fingerprint, bands) of a text's distinct shingles: a hash of all of them, their SimHash, and hashes of minhashes."""
    value = xxhash.xxh64_intdigest(found.astype("<u8").tobytes())
    if not len(found):
        return value, 0, []
    ones, least = np.zeros(64, np.int64), np.full(len(MIX), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1 << 12):
        part = found[at : at + (1 << 12)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        least = np.minimum(least, ((part[None, :] ^ MIX[:, :1]) * (MIX[:, 1:] | np.uint64(1))).min(1))
    fp = int(np.packbits(2 * ones > len(found)).view(">u8")[0])
    return value, fp, [xxhash.xxh64_intdigest(band.astype("<u8").tobytes()) for band in least.reshape(-1, ROWS)]


def summaries(text: Column, width: int) -> Column:
    """The summaries as structs of signed longs."""

    @F.pandas_udf("value long, fp long, bands array<long>")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [summary(shingles(t, width)) for t in texts]
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return pd.DataFrame({"value": signed([r[0] for r in rows]), "fp": signed([r[1] for r in rows]), "bands": [signed(r[2]) for r in rows]})

    return found(text)


def shingle_bytes(text: Column, width: int) -> Column:
    """(value, shingles): a text's distinct shingles as bytes."""

    @F.pandas_udf("value long, shingles binary")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [shingles(t, width).astype("<u8").tobytes() for t in texts]
        return pd.DataFrame({"value": np.array([xxhash.xxh64_intdigest(r) for r in rows], np.uint64).view(np.int64), "shingles": rows})

    return found(text)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two ascending arrays of distinct hashes."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(len(both) - shared, 1)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def bk_tree(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, parent, distance to the parent), built for all values level by level; parents come first.

    A value goes down from the root to the child at its distance; the first value to reach a free place becomes the child.
    """
    n = len(values)
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    at, waiting = np.zeros(n, np.int64), np.arange(1, n)
    child: dict[int, int] = {}
    while len(waiting):
        key = at[waiting] * 65 + popcount(values[waiting] ^ values[at[waiting]])
        unique, first, back = np.unique(key, return_index=True, return_inverse=True)
        new = []
        for k, f in zip(unique.tolist(), first.tolist(), strict=True):
            if k not in child:
                node = int(waiting[f])
                child[k], parent[node], edge[node] = node, k // 65, k % 65
                new.append(f)
        at[waiting] = np.array([child[k] for k in unique.tolist()])[back]
        keep = np.ones(len(waiting), bool)
        keep[new] = False
        waiting = waiting[keep]
    return values, parent, edge


def search(tree: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, radius: int, at_once: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query number, tree number) within the radius.

    All queries go down together: from a node at distance d only edges from d - radius to d + radius are followed.
    """
    values, parent, edge = tree
    order = np.lexsort((edge, parent))
    keys = (parent[order] + 1) * 65 + edge[order]  # children sorted by parent, then edge
    waiting = [(np.arange(i, min(i + 4096, len(queries))), None) for i in range(0, len(queries), 4096)]
    while waiting:
        query, node = waiting.pop()
        node = np.zeros(len(query), np.int64) if node is None else node
        distance = popcount(queries[query] ^ values[node])
        near = distance <= radius
        if near.any():
            yield query[near], node[near]
        low = np.searchsorted(keys, (node + 1) * 65 + np.maximum(distance - radius, 0), "left")
        high = np.searchsorted(keys, (node + 1) * 65 + np.minimum(distance + radius, 64), "right")
        n = high - low
        if not n.sum():
            continue
        query, low, n = query[n > 0], low[n > 0], n[n > 0]
        for part in np.array_split(np.arange(len(query)), max(1, int(n.sum()) // at_once + 1)):
            if len(part):
                count = n[part]
                steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                waiting.append((np.repeat(query[part], count), order[np.repeat(low[part], count) + steps]))


class Forest:
    """Disjoint sets over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins the pairs; those that joined two sets."""
        open_ = self.up[a] != self.up[b]
        new = []
        for i, j in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                new.append((i, j))
        for _ in range(64):  # flatten, so that the next pairs are told at once
            flat = self.up[self.up]
            if (flat == self.up).all():
                break
            self.up = flat
        return new


Shingles = list[np.ndarray] | None


def found_links(tree: tuple[np.ndarray, np.ndarray, np.ndarray], fp: np.ndarray, value: np.ndarray, own: Shingles, start: int, radius: int, similarity: float | None) -> list[tuple[int, int]]:
    """Links (value, value) between the tree's members, which come first, and those from ``start`` on, as a spanning forest."""
    forest, out = Forest(len(fp)), []
    if own is None:
        for q, t in search(tree, fp[start:], radius):
            out += forest.add(q + start, t)
        return [(value[i], value[j]) for i, j in out]
    size, found = np.array([len(s) for s in own]), []
    for q, t in search(tree, fp[start:], radius, 1 << 20):
        q = q + start
        near = (q > t) & (np.minimum(size[q], size[t]) >= similarity * np.maximum(size[q], size[t]) - 1e-9)
        found.append(np.stack((q[near], t[near])))
    if found:
        q, t = np.concatenate(found, 1)
        order = np.argsort(popcount(fp[q] ^ fp[t]), kind="stable")  # nearest first: most others are in one set by then
        for at in range(0, len(order), 1024):
            some = order[at : at + 1024]
            some = some[forest.up[q[some]] != forest.up[t[some]]]
            for i, j in zip(q[some].tolist(), t[some].tolist(), strict=True):
                if forest.root(i) != forest.root(j) and jaccard(own[i], own[j]) >= similarity - 1e-9:
                    out += forest.add(np.array([i]), np.array([j]))
    return [(value[i], value[j]) for i, j in out]


def as_frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(pairs, np.int64).reshape(-1, 2), columns=["a", "b"])


def sets_of(shingles: Iterable) -> Shingles:
    found = list(shingles)
    return None if not found or found[0] is None else [np.frombuffer(s, "<u8") for s in found]


def links_within(members: DataFrame, radius: int, similarity: float | None) -> DataFrame:
    """Links (a, b) within each shard (b, v, s) of members: b, v, s, value, fp, shingles."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:  # sorted by shard: all shards but the last are whole
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            ids = held[["b", "v", "s"]].to_numpy()
            last = np.flatnonzero((ids[1:] != ids[:-1]).any(1))
            if len(last):
                yield shards(held.iloc[: last[-1] + 1])
                held = held.iloc[last[-1] + 1 :].reset_index(drop=True)
        if held is not None and len(held):
            yield shards(held)

    def shards(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows[["b", "v", "s"]].to_numpy()
        ends = [*(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(rows)]
        fp, value, shingle = rows["fp"].to_numpy().view(np.uint64), rows["value"].to_numpy(), rows["shingles"].to_numpy()
        out: list[tuple[int, int]] = []
        for at, end in zip([0, *ends], ends, strict=False):
            if end - at == 2 and int(fp[at] ^ fp[at + 1]).bit_count() > radius:
                continue
            if end - at > 1:
                out += found_links(bk_tree(fp[at:end]), fp[at:end], value[at:end], sets_of(shingle[at:end]), 0, radius, similarity)
        return as_frame(out)

    n = max(12, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    units = members.select(F.xxhash64("b", "v", "s").alias("unit"), "b", "v", "s", "value", "fp", "shingles")
    return units.repartition(n, "unit").sortWithinPartitions("unit", "b", "v", "s").select("b", "v", "s", "value", "fp", "shingles").mapInPandas(find, "a long, b long")


TREE = "b int, v long, s int, nodes binary, parents binary, edges binary, ids binary, sets array<binary>"


def shard_trees(members: DataFrame) -> DataFrame:
    """The BK-tree of each shard as a row, with its members' values and shingles."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, parent, edge = bk_tree(rows["fp"].to_numpy().view(np.uint64))
        first, sets = rows.iloc[0], None if rows["shingles"].iloc[0] is None else list(rows["shingles"])
        return pd.DataFrame([(first.b, first.v, first.s, nodes.tobytes(), parent.astype("<i8").tobytes(), edge.astype("<i8").tobytes(), rows["value"].to_numpy().tobytes(), sets)], columns=["b", "v", "s", "nodes", "parents", "edges", "ids", "sets"])

    return members.select("b", "v", "s", "value", "fp", "shingles").groupBy("b", "v", "s").applyInPandas(build, TREE)


def links_across(packs: DataFrame, trees: DataFrame, radius: int, similarity: float | None, broadcast_bytes: int) -> DataFrame:
    """Links (a, b) between packs of members (b, v, s: the shard to search, pack) and that shard's tree."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                nodes = np.frombuffer(row.nodes, np.uint64)
                tree = (nodes, np.frombuffer(row.parents, "<i8"), np.frombuffer(row.edges, "<i8"))
                asked = [(p["value"], p["fp"], p["shingles"]) for p in row.pack]
                fp = np.concatenate([nodes, np.array([p[1] for p in asked], np.int64).view(np.uint64)])
                value = np.concatenate([np.frombuffer(row.ids, np.int64), np.array([p[0] for p in asked], np.int64)])
                own = sets_of([*([None] * len(nodes) if row.sets is None else row.sets), *(p[2] for p in asked)])
                yield as_frame(found_links(tree, fp, value, own, len(nodes), radius, similarity))

    size = trees.agg(F.sum(F.octet_length("nodes") * 4 + F.coalesce(F.aggregate("sets", F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s)), F.lit(0)))).first()[0]
    built = F.broadcast(trees) if (size or 0) <= broadcast_bytes else trees
    return packs.join(built, ["b", "v", "s"]).select("nodes", "parents", "edges", "ids", "sets", "pack").mapInPandas(walk, "a long, b long")


def searched(groups: DataFrame, sets: DataFrame | None, radius: int, similarity: float | None, shard: int, broadcast_bytes: int = 64 << 20, per_pack: int = 256) -> DataFrame:
    """Links (a, b) between values that keep the components of all groups together.

    groups: a row per group and member, written: b, v, n (of members), value, fp. sets: value, shingles, for a similarity.
    """
    parts = F.when(F.col("n") <= shard, F.lit(1)).otherwise(F.ceil(F.col("n") * 2 / shard)).cast("int")
    placed = groups.withColumn("parts", parts).withColumn("s", F.pmod(F.xxhash64("value", "b", "v"), F.col("parts")).cast("int"))
    with_sets = lambda rows: rows.withColumn("shingles", F.lit(None).cast("binary")) if sets is None else rows.join(sets, "value")
    near = written(links_within(with_sets(placed), radius, similarity), "near-links")
    hot = placed.where("parts > 1")
    if hot.isEmpty():
        return near
    named = hot.join(components(near).select(F.col("node").alias("value"), "component"), "value", "left").withColumn("component", F.coalesce("component", "value"))
    named = written(named, "near-hot")
    sizes = named.groupBy("b", "v", "component").agg(F.count(F.lit(1)).alias("k"))
    open_ = sizes.groupBy("b", "v").agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("all"), F.count(F.lit(1)).alias("c")).where("c > 1").select("b", "v", F.col("main.component").alias("main"), (F.col("all") - F.col("main.k")).alias("rest"))
    open_ = written(open_, "near-open")
    if open_.isEmpty():
        return near
    rows = with_sets(named.join(open_, ["b", "v"]))
    trees = written(shard_trees(rows), "near-trees")
    asked = rows.where("component <> main").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("t <> s")
    dealt_to = F.pmod(F.xxhash64("value"), F.ceil(F.col("rest") / per_pack)).cast("int")
    packs = asked.groupBy("b", "v", F.col("t").alias("s"), dealt_to.alias("_p")).agg(F.collect_list(F.struct("value", "fp", "shingles")).alias("pack"))  # about per_pack entries
    return near.union(written(links_across(packs, trees, radius, similarity, broadcast_bytes), "near-links"))


def sized_groups(grouped: DataFrame) -> DataFrame:
    """b, v, n, value, fp of groups of two or more; of groups with the same members one is left."""
    member = [F.bit_xor(F.xxhash64("value", F.lit(i))).alias(f"x{i}") for i in range(2)]
    counts = grouped.groupBy("b", "v").agg(F.count(F.lit(1)).alias("n"), *member).where(F.col("n") > 1)
    counts = counts.groupBy("n", "x0", "x1").agg(F.min(F.struct("b", "v")).alias("g")).select("g.b", "g.v", "n")
    return written(grouped.join(counts, ["b", "v"]).select("b", "v", "n", "value", "fp"), "near-groups")


def links(values: DataFrame, radius: int = 2, shard: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` that keep their components together."""
    k = radius + 2
    cuts = [64 * i // k for i in range(k + 1)]
    block = lambda i: F.shiftrightunsigned(F.shiftleft("fp", cuts[i]), 64 - cuts[i + 1] + cuts[i])
    two = [F.struct(F.lit(n).alias("b"), F.shiftleft(block(i), cuts[j + 1] - cuts[j]).bitwiseOR(block(j)).alias("v")) for n, (i, j) in enumerate(combinations(range(k), 2))]
    grouped = values.select("fp", F.explode(F.array(*two)).alias("g")).select("g.b", "g.v", F.col("fp").alias("value"), "fp")
    return searched(sized_groups(grouped), None, radius, None, shard)


def verified_links(values: DataFrame, texts: DataFrame, radius: int, similarity: float, width: int, shard: int = 1024) -> DataFrame:
    """Links (a, b) between values, each of at least that similarity, that keep the components of their groups together.

    values: value, fp, bands, least (a key of the value); texts: key, text.
    """
    groups = sized_groups(values.select("value", "fp", F.posexplode("bands").alias("b", "v")))
    wanted = values.join(groups.select("value").distinct(), "value", "left_semi").select(F.col("least").alias("key")).distinct()
    sets = texts.join(wanted, "key", "left_semi").select(shingle_bytes(F.col("text"), width).alias("s")).select("s.*").groupBy("value").agg(F.first("shingles").alias("shingles"))
    return searched(groups, written(sets, "near-shingles"), radius, similarity, shard)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of every node with a link; a component is its smallest node. edges: a, b.

    Large-star links every larger neighbour of a node to its smallest one, small-star the rest; the rounds end when the links
    don't change. What a node gathers is one smallest neighbour by aggregation, never its list.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = None
    for _ in range(rounds):
        both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        pairs = written(small, "links")
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3, similarity: float | None = None) -> DataFrame:
    """Returns key, fp (signed), component_id (the smallest key reachable) of every row.

    Without a similarity, fingerprints within the radius are linked, whatever the texts share. With one, the radius only chooses
    the candidates, and texts of that Jaccard similarity of their shingles are linked.
    """
    keyed = F.col("least").isNotNull()
    if similarity is None:
        found = written(docs.select(F.col(key).alias("key"), fingerprints(F.col(text), width).alias("fp")).withColumn("value", F.col("fp")), "fingerprints")
        values = written(found.groupBy("value").agg(F.min("key").alias("least"), F.first("fp").alias("fp")), "fingerprint-values")
        edges = links(values.where(keyed).select("fp"), radius)
    else:
        found = written(docs.select(F.col(key).alias("key"), summaries(F.col(text), width).alias("s")).select("key", "s.*"), "fingerprints")
        values = written(found.groupBy("value").agg(F.min("key").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "fingerprint-values")
        edges = verified_links(values.where(keyed), docs.select(F.col(key).alias("key"), F.col(text).alias("text")), radius, similarity, width)
    names = values.select("value", "least")
    edges = edges.join(names, F.col("a") == F.col("value")).select(F.col("least").alias("a"), "b").join(names, F.col("b") == F.col("value")).select("a", F.col("least").alias("b"))
    labels = values.join(components(edges), F.col("least") == F.col("node"), "left").select("value", F.coalesce("component", "least").alias("component_id"))
    return found.select("key", "value", "fp").join(labels, "value").select(F.col("key").alias(key), "fp", "component_id")
