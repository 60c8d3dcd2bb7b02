"""Nearest neighbours by collision counting (query-aware hashing).

Every vector is projected on the same random directions, and each projection is kept as one sorted array. A query opens
a window around its own projection in each array and widens all windows together (virtual rehashing: no table is built
for a radius). A vector seen in enough windows at once is verified by its exact distance. The search stops when the
k-th verified distance lies within the radius that the windows stand for.

Rows are dealt to shards and queries to blocks of equal size; each (block, shard) cell is searched alone and the best k
of each query are merged, so nothing is held whole. A row travels once for each 8,192 queries and a query once for each
8,192 rows; a cell sorts its arrays once, which is under a hundredth of the work for its queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = 64
#: Half-width of a window in units of the radius; share of a vector's windows that must hold it.
HALF_WIDTH, THRESHOLD = 1.0, 0.56
#: Step of the radius; the search stops when the k-th verified distance is at most SLACK radii.
GROWTH, SLACK = 1.1, 1.1
SHARD_ROWS, BLOCK_QUERIES = 8192, 8192


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array of double) of rows that take part: not null, not zero, all components finite."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(ok)


def directions(dim: int, n: int = 0, seed: int = 7) -> np.ndarray:
    """The same random directions wherever they are asked for."""
    return np.random.default_rng([seed, dim]).standard_normal((n or DIRECTIONS, dim))


def distances(vecs: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; differences are scaled by a power of two, which is exact, so that no square overflows."""
    with np.errstate(over="ignore", under="ignore"):
        diff = vecs - q
        power = np.frexp(np.abs(diff).max(axis=1, initial=0.0))[1]
        power = np.where(np.isfinite(diff).all(axis=1), power, 0)
        diff = np.ldexp(diff, -power[:, None])
        return np.ldexp(np.sqrt((diff * diff).sum(axis=1)), power)


def search_cell(ids: np.ndarray, vecs: np.ndarray, q_ids: np.ndarray, q_vecs: np.ndarray, k: int, found: list | None = None):
    """Rows (query id, id, distance) of the k nearest found in one cell for each query, itself left out.

    Projections and radii are of vectors scaled by one power of two, so that all are finite and the windows come to hold
    every row of the cell at last. ``found`` gathers how many rows were verified, if given.
    """
    n, a = len(ids), directions(vecs.shape[1])
    power = int(np.frexp(max(np.abs(vecs).max(), np.abs(q_vecs).max()))[1])
    with np.errstate(under="ignore"):
        small, q_small = np.ldexp(vecs, -power), np.ldexp(q_vecs, -power)
    proj, q_proj = (small @ a.T).T, (q_small @ a.T).T
    order = np.argsort(proj, axis=1, kind="stable").astype(np.int32)
    sorted_ = np.take_along_axis(proj, order, axis=1)
    need = int(np.ceil(THRESHOLD * len(a)))
    out = []
    for j, (qid, q) in enumerate(zip(q_ids, q_vecs)):
        with np.errstate(under="ignore"):
            near = np.sort(np.linalg.norm(small[:: max(1, n // 64)] - q_small[j], axis=1))
        radius = max(float(near[min(k, len(near) - 1)]) / (2 * SLACK), 1e-12)  # only where the windows start
        cand_ids, cand_d = np.zeros(0, np.int64), np.zeros(0)
        done, seen = ids == qid, np.zeros(n, np.int64)  # seen: in how many of its windows a row lies
        left = right = np.array([s.searchsorted(c) for s, c in zip(sorted_, q_proj[:, j])])
        while True:
            lo = np.array([s.searchsorted(c - HALF_WIDTH * radius, "left") for s, c in zip(sorted_, q_proj[:, j])])
            hi = np.array([s.searchsorted(c + HALF_WIDTH * radius, "right") for s, c in zip(sorted_, q_proj[:, j])])
            fresh = [o[i:m] for o, i, m in zip(order, lo, left)] + [o[m:i] for o, m, i in zip(order, right, hi)]
            seen += np.bincount(np.concatenate(fresh), minlength=n)  # only what the wider windows add is read
            left, right = lo, hi
            new = np.flatnonzero((seen >= need) & ~done)
            if len(new):
                done[new] = True
                cand_ids = np.concatenate([cand_ids, ids[new]])
                cand_d = np.concatenate([cand_d, distances(vecs[new], q)])
                best = np.lexsort((cand_ids, cand_d))[:k]
                if found is not None:
                    found.append(len(new))
                cand_ids, cand_d = cand_ids[best], cand_d[best]
            if len(cand_d) >= k and np.ldexp(cand_d[-1], -power) <= SLACK * radius or done.all():
                break
            radius *= GROWTH
        out += [(qid, i, d) for i, d in zip(cand_ids, cand_d)]
    return out


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), <id_col>, score: the k nearest found of each query by Euclidean distance.

    Ties go to the smaller id. Null, zero and non-finite vectors take no part, nor do rows without an id; vectors are
    compared within their own dimension. Copies of one vector are candidates like any other; repeated ids keep one row
    each per copy. A query never finds rows with its own id. Components may be of any finite size; only a distance above
    the largest double is infinite. Empty in, empty out; other columns are ignored.
    """
    data, asked = usable(rows, id_col, vec_col), usable(queries, id_col, vec_col)
    n_rows, n_queries = data.count(), asked.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_queries // BLOCK_QUERIES))
    data = data.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int"))
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cell = ["dim", "block", "shard"]
    data, asked = (x.withColumn("dim", F.size("vec")) for x in (data, asked))

    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if a.empty or q.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        got = search_cell(a["id"].to_numpy(np.int64), np.stack(a["vec"].to_numpy()).astype(float), q["id"].to_numpy(np.int64), np.stack(q["vec"].to_numpy()).astype(float), k)
        return pd.DataFrame(got, columns=["query_id", "id", "score"])

    near = data.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(run, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
