"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each the mean and the deviation (root of the
sum of squared differences from the mean) are kept. By the Cauchy-Schwarz
inequality, the inner product of two vectors is at most the sum over segments
of ``length * mean * mean + deviation * deviation``: a lower bound on their
distance, since ``|q - x|^2 = |q|^2 + |x|^2 - 2 q.x``. Segments are halved from
level to level; a candidate is dropped at the first level whose bound lies under
the query's k-th best score so far, and only survivors are multiplied out.

Queries are a stated set of rows. They and the candidates are dealt by hash to
blocks of a fixed size; every pair of a block of queries and a block of
candidates meets in a group of its own, which returns the k best of its
candidates for each of its queries. What a task holds doesn't grow with the
table, and no vector passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

SCALE = 256
K = 5
#: Rows of one block of queries and of one block of candidates: what a task holds.
QUERY_ROWS, CANDIDATE_ROWS = 2048, 4096
#: Rows of candidates that are bounded at once.
CHUNK = 512

_EXACT = 2.0 ** 53


def whole(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of all components as doubles; null if the vector or
    a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine, F.transform(x, lambda v: _floor(v * scale)))


def _floor(v: Column) -> Column:
    """Floor that stays a double beyond the range of a long."""
    return F.when(F.abs(v) < 2.0 ** 52, F.floor(v).cast("double")).otherwise(v)


def segments(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``sqrt(length) * mean`` and deviation of each of ``parts`` segments, a
    row of ``2 * parts`` numbers whose inner product with another is the bound."""
    cuts = np.linspace(0, x.shape[1], parts + 1).astype(int)
    out = np.empty((len(x), 2 * parts))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        s = x[:, a:b]
        mean = s.mean(axis=1)
        out[:, i] = math.sqrt(b - a) * mean
        out[:, parts + i] = np.sqrt(np.maximum(0, ((s - mean[:, None]) ** 2).sum(axis=1)))
    return out


def levels(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 1, 4, 16 ... as long as segments have two components."""
    out = [1]
    while out[-1] * 8 <= dim:
        out.append(out[-1] * 4)
    return out


class TopK:
    """The k best candidates of each query of a block, over rows as they come."""

    def __init__(self, ids: list, own: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.own, self.q, self.k = ids, own, q, k
        self.levels = levels(q.shape[1])
        self.bounds = [segments(q, p) for p in self.levels]
        self.size = np.abs(q).sum(axis=1).max(initial=0)
        self.best: list[list[tuple]] = [[] for _ in ids]  # (-score, id is null, id)
        self.least = np.full(len(ids), -np.inf)
        self.exact_pairs = self.pairs = 0

    def add(self, ids: list, rows: np.ndarray, x: np.ndarray) -> None:
        small = self.size * np.abs(x).max(initial=0) < _EXACT
        slack = 1e-9 * (1 + np.linalg.norm(x, axis=1).max(initial=0) * np.linalg.norm(self.q, axis=1).max(initial=0))
        self.pairs += len(ids) * len(self.ids)
        qs, xs = None, None
        for level, p in enumerate(self.levels if small else []):
            stats = segments(x, p)
            if qs is None:
                qs, xs = np.nonzero(self.bounds[level] @ stats.T >= self.least[:, None] - slack)
            else:
                bound = np.einsum("ij,ij->i", self.bounds[level][qs], stats[xs])
                live = bound >= self.least[qs] - slack
                qs, xs = qs[live], xs[live]
            if len(qs) * (2 * p) > len(self.ids) * len(ids) * 2:  # hardly any is dropped: multiply out
                break
        if qs is None:
            qs, xs = (a.ravel() for a in np.indices((len(self.ids), len(ids))))
        other = self.own[qs] != rows[xs]
        qs, xs = qs[other], xs[other]
        self.exact_pairs += len(qs)
        if not small:
            score = np.array([sum(int(a) * int(b) for a, b in zip(self.q[i], x[j], strict=True))
                              for i, j in zip(qs, xs, strict=True)], object)
        elif len(qs) * 4 > len(self.ids) * len(ids):
            score = np.rint(self.q @ x.T)[qs, xs]
        else:
            score = np.rint(np.einsum("ij,ij->i", self.q[qs], x[xs]))
        good = score >= self.least[qs] if small else np.ones(len(qs), bool)
        qs, xs, score = qs[good], xs[good], score[good]
        for i in np.unique(qs):
            mine = qs == i
            found = [(-int(s), ids[j] is None, ids[j] or 0) for s, j in zip(score[mine], xs[mine], strict=True)]
            self.best[i] = sorted(self.best[i] + found)[:self.k]
            if len(self.best[i]) == self.k:
                self.least[i] = -float(self.best[i][-1][0])


def _by_dim(rows: pa.Table) -> dict[int, list[tuple]]:
    """``id, row, vector`` of a table, by the vectors' length."""
    out: dict[int, list[tuple]] = {}
    for i, r, v in zip(rows["id"].to_pylist(), rows["row"].to_pylist(), rows["v"].to_pylist(), strict=True):
        out.setdefault(len(v) // 8, []).append((i, r, np.frombuffer(v)))
    return out


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        """The k best of a block of candidates for each query of a block."""
        out, asked = [], _by_dim(queries)
        for dim, found in _by_dim(candidates).items():
            if dim not in asked:
                continue
            ids, rows, q = zip(*asked[dim], strict=True)
            top = TopK(list(ids), np.array(rows), np.stack(q), k)
            for lo in range(0, len(found), CHUNK):
                ids, rows, x = zip(*found[lo:lo + CHUNK], strict=True)
                top.add(list(ids), np.array(rows), np.stack(x))
            out += [(int(top.own[i]), top.ids[i], None if null else cid, max(-2 ** 63, min(2 ** 63 - 1, -neg)))
                    for i in range(len(top.ids)) for neg, null, cid in top.best[i]]
        return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in range(4)],
                        names=["q", "query_id", "vec_id", "score"])
    return run


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.array(v, float).tobytes() for v in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), batch.column(3)],
                                         names=["id", "row", "v", "q"])


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` the
    ``k`` rows with the largest inner product of ``floor(scale * x)``, the row
    itself aside; ties go to the smaller id (null last).

    Null vectors, empty ones and those with a null or non-finite component take
    no part; vectors meet only vectors of their own length. Repeated rows are
    rows of their own. Scores are exact whole numbers; those beyond a long are
    cut to its range after ranking. Other columns are ignored.
    """
    prepare(vectors.sparkSession)
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                           whole(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
                   .where("v is not null and size(v) > 0"))
    table = materialize(rows.mapInArrow(_bytes, "id bigint, row bigint, v binary, q boolean"), "vectors")
    n, n_asked = table.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, parts = max(1, math.ceil(n_asked / QUERY_ROWS)), max(1, math.ceil(n / CANDIDATE_ROWS))
    place = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = table.where("q").select("id", "row", "v", place(blocks).alias("block"), every(parts).alias("part"))
    offered = table.select("id", "row", "v", place(parts).alias("part"), every(blocks).alias("block"))
    out = (asked.groupBy("block", "part").cogroup(offered.groupBy("block", "part"))
                .applyInArrow(_search(k), "q bigint, query_id bigint, vec_id bigint, score bigint"))
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").isNull().alias("n"),
                                                F.col("vec_id").alias("vec_id"), F.col("score").alias("score"))))
    return (out.groupBy("q", "query_id").agg(F.slice(best, 1, k).alias("best"))
               .select("query_id", F.posexplode("best").alias("at", "b"))
               .select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score"))
