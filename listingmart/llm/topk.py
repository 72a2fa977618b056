"""Exact top-k by inner product through a pivot table.

Inner products become distances: a vector c is lifted to (c, sqrt(M - |c|^2)), M the largest squared
norm, and a query q to (q, 0); then |q' - c'|^2 = |q|^2 + M - 2 q.c. Distances of every row to the pivots
are computed once. The greatest lower bound that two rows' distances to the pivots allow is the distance of the
tips of two simplices over the pivots with these distances as edges; no single difference of distances exceeds it.
So each query has an upper bound of every candidate's score. Candidates are evaluated in bound order, in growing
steps, until no bound left reaches the k-th score so far; scores are exact integers.

The k-th score does not start from nothing: each query is first scored against the bounded sample that the pivots
come from. Work is dealt in (query block, candidate block) pairs of bounded size. With more than one query block,
queries of a block are near one pivot, and a candidate goes only to blocks where some query's bound can reach
the block's lowest k-th score. A pair returns at most k rows a query, none below its k-th score of the sample, which
a window cuts to k.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part;
vectors of different lengths don't pair; of rows with one id the smallest vector is the query, and none
of them is its candidate; ties go to the smaller id; components and scores are held to 64-bit integers; an empty
table gives an empty result; further columns are not looked at. Where squared norms overflow there are no bounds
and all is evaluated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Pivots at most (an eighth of the dimensions fewer than these), the sample they come from, candidate blocks at least.
PIVOTS, SAMPLE, LEAST_BLOCKS = 256, 2048, 8
#: A score that every one reaches.
NONE = -(2**63)


def choose_pivots(rows: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first over a bounded sample."""
    if not len(rows):
        return rows
    chosen, gap = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


@dataclass(frozen=True)
class Pivots:
    """Lifted pivots in general position, and what turns distances to them into a simplex's tip."""

    points: np.ndarray
    solve: np.ndarray
    gaps: np.ndarray
    top: float

    @classmethod
    def of(cls, sample: np.ndarray, count: int, top: float) -> Pivots | None:
        """None where there is nothing to bound with: no sample, or norms beyond doubles."""
        if not len(sample) or not np.isfinite(top) or not 0 < top < 1e150:
            return None
        points = choose_pivots(np.hstack([sample, np.sqrt(np.maximum(0.0, top - (sample**2).sum(axis=1)))[:, None]]), count)
        base = np.linalg.qr((points[1:] - points[0]).T)[1] if len(points) > 1 else np.zeros((0, 0))
        # a pivot in the span of those before it adds no edge
        own = np.concatenate([[True], np.abs(np.diag(base)) > 1e-3 * np.sqrt(top)]) if len(base) else np.ones(1, bool)
        points = points[: len(own)][own]
        edges = points[1:] - points[0]
        base = np.linalg.qr(edges.T)[1] if len(edges) else np.zeros((0, 0))
        return cls(points, np.linalg.inv(base) if len(base) else base, (edges**2).sum(axis=1), top)

    def distances(self, v: np.ndarray, lifted: bool) -> np.ndarray:
        """Squared distances of the vectors, lifted or with a last component of 0, to the pivots."""
        norm = (v * v).sum(axis=1)
        last = np.sqrt(np.maximum(0.0, self.top - norm)) if lifted else np.zeros(len(v))
        dots = v @ self.points[:, :-1].T + last[:, None] * self.points[:, -1]
        return np.maximum(0.0, (norm + last**2)[:, None] + (self.points**2).sum(axis=1) - 2 * dots)

    def tips(self, far: np.ndarray) -> np.ndarray:
        """Coordinates of the tips; the last one is the height over the pivots' span."""
        flat = ((far[:, :1] + self.gaps - far[:, 1:]) / 2) @ self.solve
        height = np.sqrt(np.maximum(0.0, far[:, 0] - (flat**2).sum(axis=1)))
        return np.hstack([flat, height[:, None]])

    def bounds(self, q_norm: np.ndarray, q_tips: np.ndarray, c_tips: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, with slack for rounding."""
        apart = (q_tips**2).sum(axis=1)[:, None] + (c_tips**2).sum(axis=1) - 2 * (q_tips @ c_tips.T)
        return (q_norm[:, None] + self.top - np.maximum(0.0, apart)) / 2 + 1e-6 * (q_norm[:, None] + self.top) + 0.5


def _wide_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Through Python's integers, held to 64 bits at the end."""
    whole = np.vectorize(int, otypes=[object])
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in whole(a) @ whole(b)], dtype=np.int64) if len(a) else np.empty(0, np.int64)


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the vector b, as integers."""
    wide = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * a.shape[1] >= 2**53
    return _wide_products(a, b) if wide else (a @ b).astype(np.int64)


def floor_of(q: np.ndarray, q_id: int, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> int:
    """The query's k-th score over the sample; NONE if the sample has fewer candidates."""
    found = scores_of(sample[sample_ids != q_id], q)
    return int(np.partition(found, -k)[-k]) if len(found) >= k else NONE


def search_block(
    q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, c: np.ndarray, c_ids: np.ndarray, pivots: Pivots | None, q_far: np.ndarray,
    c_far: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query's place, candidate ids, scores, candidates evaluated) of the k best of the block that reach the query's floor,
    ties to smaller ids. *_far: squared distances to the pivots."""
    step_of = max(1, (1 << 23) // max(1, len(c)))
    c_tips = pivots.tips(c_far) if pivots else None
    for lo in range(0, len(q), step_of):
        some = slice(lo, min(lo + step_of, len(q)))
        bounds = pivots.bounds((q[some] ** 2).sum(axis=1), pivots.tips(q_far[some]), c_tips) if pivots else None
        for i in range(some.start, some.stop):
            bound = bounds[i - lo] if pivots else np.full(len(c), np.inf)
            able = np.flatnonzero(bound >= float(floors[i]))
            order, at, step = able[np.argsort(-bound[able], kind="stable")], 0, max(4 * k, 64)
            best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
            while at < len(order):
                if len(best) == k and bound[order[at]] < best[-1]:
                    break
                take = order[at : at + step]
                at, step = at + len(take), step * 2
                take = take[c_ids[take] != q_ids[i]]
                found = scores_of(c[take], q[i])
                ids, scores = np.concatenate([best_ids, c_ids[take]]), np.concatenate([best, found])
                ids, scores = ids[scores >= floors[i]], scores[scores >= floors[i]]
                keep = np.lexsort((ids, -scores))[:k]
                best_ids, best = ids[keep], scores[keep]
            yield i, best_ids, best, at


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, block: int = 131_072, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    rows = vectors.select("vec_id", "embedding").filter(F.coalesce(whole, F.lit(False)))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    rows = rows.withColumn("dim", F.size("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    tops = {
        r["dim"]: r for r in rows.groupBy("dim").agg(
            F.max("norm").alias("top"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(is_query, F.col("vec_id"))).alias("q")
        ).collect()
    }
    shape = "query_id long, rank int, vec_id long, score long"
    found = [
        _top_k_of(rows.filter(F.col("dim") == dim), is_query, k, block, pivots, r["n"], r["q"], r["top"]) for dim,
        r in sorted(tops.items()) if r["q"] and dim
    ]
    if not found:
        return spark.createDataFrame([], shape)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _top_k_of(rows: DataFrame, is_query: Column, k: int, block: int, most: int, n: int, n_query: int, top: float) -> DataFrame:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    some, some_ids = np.array([r["v"] for r in sample], dtype=np.float64), np.array([r["vec_id"] for r in sample], dtype=np.int64)
    dim = some.shape[1]
    pivots = Pivots.of(some, min(most, max(2, dim - dim // 8)), top)
    q_blocks, c_blocks = -(-n_query // block), max(LEAST_BLOCKS, -(-n // block))
    groups = min(q_blocks, len(pivots.points)) if pivots else 1

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            v, ids, asked = np.array(b["v"].tolist(), dtype=np.float64), b["vec_id"].to_numpy(np.int64), b["asked"].to_numpy(bool)
            far_c = pivots.distances(v, True) if pivots else np.zeros((len(v), 0))
            far_q = pivots.distances(v, False) if pivots else far_c
            near = far_q[:, :groups].argmin(axis=1) if groups > 1 else np.zeros(len(v), int)
            floors = np.array([floor_of(x, i, some, some_ids, k) if a else NONE for x, i, a in zip(v, ids, asked, strict=True)], dtype=np.int64)
            yield pd.DataFrame({
                "vec_id": ids, "asked": asked, "v": [x.tobytes() for x in v], "far_c": [x.tobytes() for x in far_c],
                "far_q": [x.tobytes() if a else None for x, a in zip(far_q, asked, strict=True)],
                "floor": floors, "norm": (v * v).sum(axis=1), "near": near.astype(np.int32),
                "low": [x.tolist() if a else None for x, a in zip(np.sqrt(far_q), asked, strict=True)]})

    shape = "vec_id long, asked boolean, v binary, far_c binary, far_q binary, floor long, norm double, near int, low array<double>"
    found = rows.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asked")).mapInPandas(measured, shape)
    pivot_table = materialize(found, "pivot-table")
    asked = pivot_table.filter("asked").groupBy("vec_id").agg(
        F.min(F.struct("v", "far_q", "floor", "norm", "near", "low")).alias("s")
    ).select("vec_id", "s.*")
    spread = lambda count, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), count).cast("int")
    sizes = asked.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.min("floor").alias("floor"), F.max("norm").alias("norm"))
    if groups > 1:  # a row a group, a number a pivot
        wide = [
            F.array(*(f(F.get("low", F.lit(j))) for j in range(len(pivots.points)))).alias(name) for name, f in (("least", F.min), ("most", F.max))
        ]
        sizes = sizes.join(asked.groupBy("near").agg(*wide), "near")
    held = {r["near"]: r for r in sizes.collect()}
    parts = {g: -(-r["n"] // block) for g, r in held.items()}
    blocks_of = F.create_map(*[F.lit(x) for g, p in sorted(parts.items()) for x in (g, p)])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Candidates to the query groups that they may serve."""
        for b in batches:
            far = np.sqrt(np.array([np.frombuffer(x) for x in b["far_c"]])) if len(b) else np.zeros((0, 0))
            for g, r in sorted(held.items()):
                able = np.ones(len(b), bool)
                if groups > 1 and len(b):
                    apart = np.maximum(0.0, np.maximum(far - np.array(r["most"]), np.array(r["least"]) - far)).max(axis=1)
                    whole = r["norm"] + top
                    able = (whole - apart**2) / 2 + 1e-6 * whole + 0.5 >= r["floor"]
                for part in range(parts[g]):
                    yield b[able].assign(near=np.int32(g), qb=np.int32(part))

    c = pivot_table.select(spread(F.lit(c_blocks), 1).alias("cb"), "vec_id", "v", "far_c").mapInPandas(
        dealt, "near int, qb int, cb int, vec_id long, v binary, far_c binary"
    )
    c = c.select("cb", "near", "qb", F.lit(False).alias("asked"), "vec_id", "v", F.col("far_c").alias("far"), F.lit(0).cast("long").alias("floor"))
    every = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb")
    q = asked.select(
        every, "near", spread(F.element_at(blocks_of, F.col("near")), 2).alias("qb"), F.lit(True).alias("asked"), "vec_id", "v",
        F.col("far_q").alias("far"), "floor"
    )
    # equal rows would share a block by their hash; a block's share of one id is as large as the id's rows

    def search(g: pd.DataFrame) -> pd.DataFrame:
        def side(s: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return tuple(
                np.frombuffer(b"".join(s[x]), dtype=np.float64).reshape(len(s), -1) for x in ("v", "far")
            ) + (s["vec_id"].to_numpy(np.int64),)

        if g["asked"].all() or not g["asked"].any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        g = g.sort_values("vec_id", kind="stable")
        asks = g[g["asked"]]
        (qv, qf, qi), (cv, cf, ci) = side(asks), side(g[~g["asked"]])
        parts = [
            (np.full(len(ids), qi[i]), ids, scores) for i, ids, scores,
            _ in search_block(qv, qi, asks["floor"].to_numpy(np.int64), cv, ci, pivots, qf, cf, k)
        ]
        return pd.DataFrame({name: np.concatenate([p[j] for p in parts]) for j, name in enumerate(("query_id", "vec_id", "score"))})

    return q.unionByName(c).groupBy("cb", "near", "qb").applyInPandas(search, "query_id long, vec_id long, score long")


def op10_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH e AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
