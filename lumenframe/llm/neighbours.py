"""Nearest neighbours by a hash-prefix forest.

Rows are dealt into blocks of bounded size, and each block is indexed by a forest: for each
tree the rows' long hash strings (signs of random projections), sorted. A query descends in
each tree to its longest prefix match and then ascends in all trees at once, one bit after
another, until enough candidates were met; these are ranked by exact distances. Every block
is searched for every query, and the blocks' best are merged.

Defined results: vectors that are null, all zero, or hold null or non-finite components take
no part, as candidate or as query; vectors meet only vectors of as many components; rows that
share an id count once, with the smallest vector; ties go to the smaller id; a query with
fewer candidates than asked for gets them all; an empty table gives an empty table; other
columns don't matter, whatever their names.

Vectors without structure have neighbours hardly nearer than the rest, so a forest must look
at a large share of a block to find them: ``share`` is that share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLOCK_ROWS, TREES, BITS, SHARE, LEAST = 16_384, 32, 32, 0.5, 256
#: Queries that a task handles at once.
QUERY_ROWS = 4_096


def planes(dim: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * bits))


def hash_strings(x: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """(trees, rows): each string as a number, its first bit highest."""
    weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    out = np.empty((trees, len(x)), np.uint64)
    h = planes(x.shape[1], trees, bits, seed)
    for at in range(0, len(x), 2048):
        signs = (x[at : at + 2048] @ h > 0).reshape(-1, trees, bits)
        out[:, at : at + 2048] = (signs * weights).sum(2, dtype=np.uint64).T
    return out


class Forest:
    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 3):
        self.ids, self.x, self.trees, self.bits, self.seed = ids, x, trees, bits, seed
        codes = hash_strings(x, trees, bits, seed)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, 1)

    def candidates(self, strings: np.ndarray, least: int) -> np.ndarray:
        """Rows that share the longest prefixes with the query, at least so many if there are."""
        n = len(self.ids)
        if least >= n:
            return np.arange(n)
        low, high = np.zeros((self.bits + 1, self.trees), np.int64), np.full((self.bits + 1, self.trees), n)
        for t in range(self.trees):
            q = int(strings[t])
            starts = np.array([q >> (self.bits - d) << (self.bits - d) for d in range(self.bits + 1)], np.uint64)
            ends = np.array([(q >> (self.bits - d) << (self.bits - d)) + (1 << (self.bits - d)) - 1 for d in range(self.bits + 1)], np.uint64)
            low[:, t] = np.searchsorted(self.codes[t], starts, "left")
            high[:, t] = np.searchsorted(self.codes[t], ends, "right")
        met = np.zeros(n, bool)
        reach = (high - low).sum(1)
        for d in range(self.bits, -1, -1):
            if reach[d] < least:
                continue
            for t in range(self.trees):
                met[self.order[t, low[d, t] : high[d, t]]] = True
            if met.sum() >= least:
                break
        return np.flatnonzero(met)

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the k nearest candidates of each query, its own id left out."""
        strings, out = hash_strings(q, self.trees, self.bits, self.seed), []
        least = max(LEAST, int(np.ceil(share * len(self.ids))))
        for j in range(len(qid)):
            rows = self.candidates(strings[:, j], least)
            rows = rows[self.ids[rows] != qid[j]]
            distance = np.sqrt(((self.x[rows] - q[j]) ** 2).sum(1))
            if len(rows) > k:
                edge = np.partition(distance, k - 1)[k - 1]
                keep = distance <= edge
                rows, distance = rows[keep], distance[keep]
            best = np.lexsort((self.ids[rows], distance))[:k]
            out.append((np.full(len(best), qid[j]), self.ids[rows[best]], distance[best]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, x, dim): one row for each id, vectors in double precision."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.col(ident).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return df.filter(fine).select(F.col(ident).cast("long").alias("id"), x.alias("x")).groupBy("id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))


def nearest(vectors: DataFrame, is_query, k: int, ident: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, trees: int = TREES, bits: int = BITS, share: float = SHARE, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: condition on the column ``id``."""
    rows = usable(vectors, ident, vector)
    n = vectors.count()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-n // (100 * QUERY_ROWS)))
    index = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(blocks)))
    asked = rows.filter(is_query).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(parts)))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    # With many queries a block is indexed once for each part of them.
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(block) or not len(queries):
            return empty
        block = block.sort_values("id")
        forest = Forest(block["id"].to_numpy(), np.stack(block["x"].to_list()), trees, bits, seed)
        q, v, s = forest.search(queries["id"].to_numpy(), np.stack(queries["x"].to_list()), k, share)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    keys = ["block", "part", "dim"]
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest_first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_hash_prefix_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)
