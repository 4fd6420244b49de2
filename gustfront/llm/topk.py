"""Exact top-k by inner product: columnar branch and bound.

Components become integers, floor(scale * x), so scores are exact. Candidates are cut into blocks held in vertical
layout, one array per dimension. A stated set of query rows visits every block: queries are dealt into groups and each
group is paired with each block by an equi-join on block numbers. In a block, products are accumulated for a few
dimensions at a time. After each step a candidate's score lies within partial +- |rest of query| * |rest of candidate|
(Cauchy-Schwarz on the remaining mass); the k-th largest lower bound is a floor, candidates whose upper bound lies
below it are dropped and the surviving columns are compacted. The k best of every block meet in a small ranking per query.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; vectors are
compared with those of equal length only; every row but the query's own is a candidate, so repeats of a row and other rows of the
query's id count each, and each of several query rows with one id is answered; ties go to the smaller id, then the row read
first; scores beyond 64 bits are held at the end of the range; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustfront.llm.common import stored

K, SCALE, STEP, BLOCK, GROUP = 5, 256, 8, 2048, 2048
_TOP = np.iinfo(np.int64).max


def _matrix(column: pd.Series, scale: float) -> np.ndarray:
    """Rows x dimensions; Python numbers where the products could leave 64 bits."""
    values = np.floor(np.stack(column.to_numpy()).astype(np.float64) * scale)
    limit = math.sqrt(2.0**62 / max(1, values.shape[1]))
    if values.size and np.abs(values).max() >= limit:
        return np.array([[int(x) for x in row] for row in values], dtype=object)
    return values.astype(np.int64)


def best_in_block(queries: np.ndarray, columns: np.ndarray, k: int, step: int = STEP) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (positions, scores) of candidates that may be among the k best, exact scores, with all ties.

    ``columns`` is vertical: dimensions x candidates.
    """
    dims, count = columns.shape
    if columns.dtype == object or queries.dtype == object:
        return [(np.arange(count), np.array([sum(int(a) * int(b) for a, b in zip(q, columns[:, j], strict=True)) for j in range(count)], dtype=object)) for q in queries]
    edges = list(range(0, dims, step)) + [dims]

    def rest(x: np.ndarray) -> np.ndarray:
        """Length of what is left from each edge on, rounded up; edges x vectors."""
        squares = np.add.reduceat(x.astype(np.float64) ** 2, edges[:-1], axis=0) if dims else np.zeros((0, x.shape[1]))
        tail = np.vstack([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros(x.shape[1])])
        return np.sqrt(tail) * (1 + 1e-9)

    mass, query_mass = rest(columns), rest(queries.T)
    found = []
    first = queries[:, : edges[1]] @ columns[: edges[1]] if dims else np.zeros((len(queries), count), dtype=np.int64)
    for i, query in enumerate(queries):
        alive, partial = np.arange(count), first[i]
        for e in range(1, len(edges)):
            if len(alive) > k:
                slack = query_mass[e, i] * mass[e, alive] + 1e-6
                floor = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
                keep = partial + slack >= floor
                alive, partial = alive[keep], partial[keep]
            if e + 1 < len(edges):
                partial = partial + query[edges[e] : edges[e + 1]] @ columns[edges[e] : edges[e + 1]][:, alive]
        found.append((alive, partial))
    return found


def _search(k: int, scale: float):
    def search(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for dims, asked in queries.groupby(queries["vector"].map(len)):
            held = block[block["vector"].map(len) == dims].sort_values(["vec_id", "rid"]) if len(block) else block
            if not len(held):
                continue
            ids, rows = held["vec_id"].to_numpy(), held["rid"].to_numpy()
            columns = np.ascontiguousarray(_matrix(held["vector"], scale).T)
            for (query_id, rid), (where, scores) in zip(asked[["vec_id", "rid"]].itertuples(index=False), best_in_block(_matrix(asked["vector"], scale), columns, k + 1), strict=True):
                order = np.lexsort((rows[where], ids[where], [-s for s in scores] if scores.dtype == object else -scores))
                best = [j for j in order[: k + 1] if rows[where[j]] != rid][:k]
                out += [(query_id, rid, ids[where[j]], rows[where[j]], int(max(-_TOP - 1, min(_TOP, scores[j])))) for j in best]
        return pd.DataFrame(out, columns=["query_id", "query_rid", "vec_id", "rid", "score"])

    return search


def top_k(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, scale: float = SCALE) -> DataFrame:
    """Per query row its ``k`` largest integer inner products: query_id, rank, vec_id, score."""
    sound = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    )
    rows = stored(sound.withColumn("rid", F.monotonically_increasing_id()), "vectors")  # queries and candidates name rows alike
    asked = rows.where(is_query)
    blocks, groups = max(1, math.ceil(rows.count() / BLOCK)), max(1, math.ceil(asked.count() / GROUP))
    # Rows are dealt out evenly by hash; a query group visits all blocks, as it must.
    held = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    dealt = asked.withColumn("grp", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(groups)).cast("int"))
    pairs = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    copies = held.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = pairs.groupBy("grp", "block").cogroup(copies.groupBy("grp", "block")).applyInPandas(_search(k, scale), "query_id long, query_rid long, vec_id long, rid long, score long")
    place = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
