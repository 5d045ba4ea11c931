"""Text chunks and nearest chunks by embedding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SEPARATORS = ["\n\n", "\n", " ", ""]


def chunks(text: str, size: int = 500, overlap: int = 50, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: split at the coarsest separator that occurs, joined again up to the size, each
    new piece beginning with what fits of the last one's end; parts that are too long are split by the finer separators.
    """
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for i, p in enumerate(text.split(sep))]
    out: list[str] = []
    held: list[str] = []
    length = lambda items: sum(map(len, items)) + len(sep) * max(len(items) - 1, 0)

    def close() -> None:
        if held and (joined := sep.join(held).strip()):
            out.append(joined)

    for part in parts:
        if not part:
            continue
        if len(part) > size:
            close()
            held.clear()
            out += chunks(part, size, overlap, finer)
            continue
        if held and length([*held, part]) > size:
            close()
            while held and (length(held) > overlap or length([*held, part]) > size):
                held.pop(0)
        held.append(part)
    close()
    return out


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """Rows (key, chunk_no, chunk); a null or blank text has none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t, size, overlap) if t else [])

    return docs.select(key, F.posexplode(split(F.col(text))).alias("chunk_no", "chunk"))


def topk_similar(queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", per_block: int = 4_096) -> DataFrame:
    """The k nearest corpus vectors of each query: (query_id, key, rank, score); ties go to the smaller key.

    Queries of any number are worked through in blocks of about ``per_block`` by a hash of their key; a block goes to every task. Each batch of
    the corpus is one matrix product whose best k per query are kept, so only k rows per query and batch are shuffled. Null vectors have no rank.
    """
    asked = queries.select(key, vector).where(F.col(vector).isNotNull())
    n = max(1, -(-asked.count() // per_block))
    return reduce(DataFrame.union, [nearest(asked.where(F.pmod(F.xxhash64(key), F.lit(n)) == i), corpus, k, metric, key, vector) for i in range(n)])


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str, key: str, vector: str) -> DataFrame:
    """``topk_similar`` of one block of queries."""
    rows = queries.collect()  # a block
    ids, wanted = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    scaled = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if metric == "cosine" and len(m) else m
    shared = queries.sparkSession.sparkContext.broadcast((np.array(ids), scaled(wanted)))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        for batch in batches:
            batch = batch[batch[vector].notna()]
            if not len(batch) or not len(names):
                continue
            block, own = scaled(np.stack(batch[vector].to_numpy()).astype(np.float64)), batch[key].to_numpy()
            by_key = np.argsort(own, kind="stable")
            block, own = block[by_key], own[by_key]
            score = q @ block.T if metric == "cosine" else -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (block**2).sum(1)[None, :] - 2 * q @ block.T, 0))
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ties by key
            yield pd.DataFrame({"query_id": np.repeat(names, best.shape[1]), key: own[best.ravel()], "score": np.take_along_axis(score, best, 1).ravel()})

    found = corpus.select(key, vector).mapInPandas(near, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows that an index's cells are fitted on, and of either side that meet in one task.
SAMPLE, PER_TASK = 20_000, 10_000


def scaled_rows(rows: pd.Series, metric: str) -> np.ndarray:
    found = np.stack(rows.to_numpy()).astype(np.float64)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300) if metric == "cosine" else found


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return (rows**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * rows @ centres.T


def fit_cells(corpus: DataFrame, cells: int | None = None, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Centres of cells by k-means over the ``sample`` rows with the smallest hashes; as many as the root of the number of rows, if not given, 4,096 at most."""
    there = corpus.where(F.col(vector).isNotNull())
    cells = cells or min(4_096, max(1, round(there.count() ** 0.5)))
    rows = there.select(key, vector).orderBy(F.xxhash64(key), key).limit(sample).toPandas()
    if not len(rows):
        return np.zeros((0, 0))
    own = scaled_rows(rows[vector], metric)
    rng = np.random.default_rng(0)
    centres = own[np.sort(rng.choice(len(own), min(cells, len(own)), replace=False))]
    for _ in range(rounds):
        near = distances(own, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, own)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def with_cells(df: DataFrame, centres: np.ndarray, probes: int, metric: str, key: str, vector: str) -> DataFrame:
    """(cell, key, vector): each row in its ``probes`` nearest cells; rows without a vector are left out."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # cells x dimensions numbers

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1_000):
                part = batch.iloc[start : start + 1_000]
                far = distances(scaled_rows(part[vector], metric), shared.value)
                n = min(probes, far.shape[1])
                cells = np.argsort(far, axis=1, kind="stable")[:, :n] if n > 1 else far.argmin(1)[:, None]
                yield pd.DataFrame({"cell": cells.ravel(), key: np.repeat(part[key].to_numpy(), n), vector: np.repeat(part[vector].to_numpy(), n)})

    return df.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(assign, f"cell int, {key} long, {vector} array<float>")


def build_index(corpus: DataFrame, centres: np.ndarray, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every row of the corpus under the cell of its nearest centre; write it (partitioned by cell, if it is to be searched often) and search what was written."""
    return with_cells(corpus, centres, 1, metric, key, vector)


def search_index(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 3, probes: int = 8, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", per_task: int = PER_TASK) -> DataFrame:
    """The k best rows of each query among those of its ``probes`` nearest cells, by exact scores: (query_id, key, rank, score); ties go to the smaller key.

    Queries and rows of a cell meet in blocks of about ``per_task`` of either, so a large cell is spread over tasks. With as many probes as cells the result is that of
    ``topk_similar``; with fewer, rows of other cells are missed, which ``recall`` measures.
    """
    asked = with_cells(queries, centres, probes, metric, key, vector)
    blocks = lambda c: F.ceil(F.col(c) / per_task).cast("int")
    sizes = index.groupBy("cell").agg(F.count("*").alias("_n")).join(asked.groupBy("cell").agg(F.count("*").alias("_m")), "cell").select("cell", blocks("_n").alias("_rows"), blocks("_m").alias("_asked"))  # a row a cell
    spread = lambda df, own, n, other, m: df.join(F.broadcast(sizes), "cell").select("cell", key, vector, F.pmod(F.xxhash64(key), F.col(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other))
    rows, wanted = spread(index, "_r", "_rows", "_q", "_asked"), spread(asked, "_q", "_asked", "_r", "_rows")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], key: [], "score": []})
        right = right.sort_values(key)
        own, found = scaled_rows(right[vector], metric), []
        for start in range(0, len(left), 500):
            part = left.iloc[start : start + 500]
            ask = scaled_rows(part[vector], metric)
            score = ask @ own.T if metric == "cosine" else -np.sqrt(np.maximum(distances(ask, own), 0))
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found.append(pd.DataFrame({"query_id": np.repeat(part[key].to_numpy(), top.shape[1]), key: right[key].to_numpy()[top.ravel()], "score": np.take_along_axis(score, top, 1).ravel()}))
        return pd.concat(found)

    met = wanted.groupBy("cell", "_q", "_r").cogroup(rows.withColumnsRenamed({"cell": "_cell", "_q": "_q2", "_r": "_r2"}).groupBy("_cell", "_q2", "_r2")).applyInPandas(best, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact neighbours that were found."""
    both = exact.select("query_id", key).join(found.select("query_id", F.col(key), F.lit(1).alias("_hit")), ["query_id", key], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0))).first()[0]
