"""Exact top-k by inner product: a Voronoi kNN join.

Vectors are grouped by their nearest pivot; there are about as many pivots as the root
of the number of rows. A summary of each group (how many, how far from the pivot at
least and at most, how long) bounds every inner product with a member. For a query q, a
pivot p, distances r to R from it and lengths up to M, the least of three bounds holds:
``q.p + |q| R``, ``|q| M``, and ``(|q|^2 + M^2 - d^2) / 2`` where ``d = max(0, |q - p| - R,
r - |q - p|)`` is how far q is from all members at least.

1. Each query is solved in its own group. The k-th best score there is a floor for
   its final k-th score.
2. The query goes on only to groups whose bound reaches that floor, and is solved
   there too. What is sent is the queries, not the candidates, which stay in their
   groups; the best of both rounds are the answer.

Groups are dealt in blocks of ``BLOCK`` candidates and the queries of a group in sets
of ``QUERIES``, so no task holds a whole group, however large; a group is copied once for
each set of its own queries and not at all if it has none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamledger.llm.common import stage

#: Bounds of the number of pivots, which are sent to every task.
LEAST_PIVOTS, MOST_PIVOTS = 16, 2_048
BLOCK, QUERIES = 8_192, 8_192
SCALE = 1024
#: The least score there is.
NO_FLOOR = -(2**63)


def scaled(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: vectors whose components are ``floor(1024 * x)``, kept as doubles.

    Vectors that are null or hold a null or non-finite component, and rows without an
    id, take no part. Rows that share an id count once, by the smallest vector.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    # products of components up to 2^53 / 1024 are exact; larger ones are already whole in double
    rows = rows.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**43, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, width: int | None = None) -> np.ndarray:
    """Rows of one length; shorter vectors are filled up with zeros."""
    rows = [np.asarray(x, float) for x in column]
    width = max([width or 0, *map(len, rows)])
    out = np.zeros((len(rows), width))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles while every sum stays below 2^53, else in whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    if most < 2**63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    # beyond a long, scores stop at its ends
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    p = np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1])))
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)))


def _assigned(pivots: np.ndarray):
    def run(it):
        for pdf in it:
            for first in range(0, len(pdf), 1024):
                part = pdf.iloc[first : first + 1024]
                x = _matrix(part["v"], pivots.shape[1])
                distance = _distances(x, pivots)
                yield part.assign(cell=distance.argmin(1).astype(np.int32), distance=distance.min(1), norm=np.sqrt((x**2).sum(1)))

    return run


@dataclass
class Summary:
    """Of each cell: its pivot, how many members it has, their least and largest distance from it and their largest length."""

    pivots: np.ndarray
    count: np.ndarray
    nearest: np.ndarray
    radius: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, cells: DataFrame, pivots: np.ndarray) -> Summary:
        columns = np.zeros((4, len(pivots)))
        # one row for each pivot
        for r in cells.groupBy("cell").agg(F.count(F.lit(1)), F.min("distance"), F.max("distance"), F.max("norm")).collect():
            columns[:, r["cell"]] = r[1:]
        return cls(pivots, *columns)

    def reached(self, q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """For each query and cell, whether a member can score at least ``floor``; the slack covers rounding."""
        width = self.pivots.shape[1]
        length = np.sqrt((q**2).sum(1))[:, None]
        away = _distances(q, self.pivots)
        # components beyond the pivots' width meet zeros in the pivots
        by_pivot = q[:, :width] @ self.pivots.T + length * self.radius
        least = np.maximum(0, np.maximum(away - self.radius, self.nearest - away))
        # distances carry rounding errors about the root of those of the squares
        size = length + np.sqrt((self.pivots**2).sum(1)) + self.radius
        by_distance = (length**2 + self.norm**2 - np.maximum(0, least - 1e-6 * size) ** 2) / 2
        bound = np.minimum(np.minimum(by_pivot, length * self.norm), by_distance)
        # a bound that overflowed to no number rules nothing out
        return (self.count > 0) & ~(bound + 1e-6 * length * size + 1 < floor[:, None])


def _solve(k: int):
    def run(key, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if candidates.empty or queries.empty:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in names})
        candidates = candidates.sort_values("vec_id")
        x, q = _matrix(candidates["v"]), _matrix(queries["v"])
        width = max(x.shape[1], q.shape[1])
        x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
        ids, own, floor = candidates["vec_id"].to_numpy(), queries["query_id"].to_numpy(), queries["floor"].to_numpy()
        out = []
        for first in range(0, len(q), 256):
            rows = slice(first, first + 256)
            score = _scores(q[rows], x)
            least = floor[rows]
            if score.shape[1] > k + 1:  # one more, as the query itself may be among them; all that tie with the last place stay
                least = np.maximum(least, np.partition(score, score.shape[1] - k - 1, axis=1)[:, score.shape[1] - k - 1])
            row, at = np.nonzero((score >= least[:, None]) & (ids != own[rows, None]))
            # by query, score and id; the complement turns the order round without overflow
            order = np.lexsort((ids[at], ~score[row, at], row))
            row, at = row[order], at[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, at = row[place < k], at[place < k]
            out.append(pd.DataFrame({"query_id": own[rows][row], "vec_id": ids[at], "score": score[row, at]}))
        return pd.concat(out)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _others(asked: DataFrame, floor: DataFrame, summary: Summary) -> DataFrame:
    """``query_id, v, floor, cell``: the cells other than its own that each query must see."""

    def run(it):
        for pdf in it:
            for first in range(0, len(pdf), 1024):
                part = pdf.iloc[first : first + 1024]
                near = summary.reached(_matrix(part["v"], summary.pivots.shape[1]), part["floor"].to_numpy(float))
                near[np.arange(len(part)), part["cell"]] = False
                yield pd.DataFrame({"query_id": part["query_id"], "v": part["v"], "floor": part["floor"], "cells": [np.flatnonzero(x).astype(np.int32) for x in near]})

    known = asked.select("query_id", "v", "cell").join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR)))
    return known.mapInPandas(run, "query_id long, v array<double>, floor long, cells array<int>").select("query_id", "v", "floor", F.explode("cells").alias("cell"))


def _solved(cells: DataFrame, wanted: DataFrame, summary: Summary, k: int) -> DataFrame:
    """The best of ``wanted(query_id, v, floor, cell)`` in every block of the cell, as far as they reach the floor."""
    blocks = np.maximum(1, np.ceil(summary.count / BLOCK)).astype(int)
    # one row for each pivot
    sets = np.zeros(len(blocks), int)
    for r in wanted.groupBy("cell").count().collect():
        sets[r["cell"]] = -(-r["count"] // QUERIES)
    at = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("cell") + 1)
    candidates = cells.withColumn("sets", at(sets)).where("sets > 0").select(
        "cell", F.pmod(F.xxhash64("vec_id"), at(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("part"), "vec_id", "v"
    )
    dealt = wanted.select("cell", F.explode(F.sequence(F.lit(0), at(blocks) - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), at(sets)).cast("int").alias("part"), "query_id", "v", "floor")
    keys = ("cell", "block", "part")
    found = candidates.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    return _best(found, k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int | None = None) -> DataFrame:
    """For each of ``queries(vec_id)``, the ``k`` rows of ``vectors(vec_id, v)`` with the largest inner products.

    A query is itself a row of ``vectors`` and never its own answer. Ties go to the
    smaller id. Fewer than ``k`` candidates give all. Shorter vectors count as filled
    up with zeros. ``pivots`` sets their number. Returns ``query_id, rank, vec_id, score``.
    """
    vectors = stage(vectors, "vectors")
    spark = vectors.sparkSession
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(vectors.count())))
    # spread by a hash of their ids; a bounded number
    chosen = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    p = _matrix(chosen)
    cells = stage(vectors.mapInPandas(_assigned(p), "vec_id long, v array<double>, cell int, distance double, norm double"), "cells")
    summary = Summary.of(cells, p)
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asked = stage(cells.join(asked, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "v", "cell"), "queries")
    own = stage(_solved(cells, asked.withColumn("floor", F.lit(NO_FLOOR)), summary, k), "own")
    floor = own.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    others = stage(_others(asked, floor, summary), "others")
    found = own.drop("rank").unionByName(_solved(cells, others, summary, k).drop("rank"))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
