"""Hard-negative mining with Strassen products of whole-number tiles.

Scores of anchors against candidates are inner products of int64 vectors, taken
tile by tile: a block of anchors times a block of candidates, multiplied by
Strassen's recursion (seven half-size products instead of eight, all three
sides padded with zeros to a common multiple). Sums and products are whole
numbers and wrap around like the ring of 64-bit numbers, so the product is
exact whenever the scores themselves fit; a tile whose scores may not fit is
multiplied in Python's unbounded integers by the same recursion.

Two passes over the tiles. The first multiplies the rows of each label that a
tile's two blocks share, and keeps a heap of the best positives of each anchor.
The second multiplies whole tiles and keeps, for every positive of an anchor,
the heap of best negatives inside its score window. Heaps of different tiles
merge by ranking; a tile hands on at most ``k`` rows an anchor and positive.

Blocks are dealt by hash and have a fixed size, whatever the labels: a label may
hold any share of the rows. No vector passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare
from .segment_search import whole

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between ``LOW`` and ``HIGH`` hundredths of its positive's.
LOW, HIGH = 80, 100
#: Rows of a block of anchors and of a block of candidates: what a task holds.
ANCHOR_ROWS, CANDIDATE_ROWS = 2048, 8192
#: The recursion ends where the inner side is no longer than this.
LEAF = 8

_MAX = 2 ** 63 - 1


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of whole numbers (int64, or objects for unbounded ones)."""
    rows, inner, cols = a.shape[0], a.shape[1], b.shape[1]
    depth = max(0, math.ceil(math.log2(max(1, inner) / leaf)))
    depth = min(depth, max(0, int(math.log2(max(1, min(rows, cols)) / leaf)) if min(rows, cols) >= leaf else 0))
    step = 2 ** depth
    up = lambda n: -(-n // step) * step
    if (up(rows), up(inner), up(cols)) == (rows, inner, cols):
        return _strassen(a, b, depth)
    wide_a = np.zeros((up(rows), up(inner)), a.dtype)
    wide_b = np.zeros((up(inner), up(cols)), b.dtype)
    wide_a[:rows, :inner], wide_b[:inner, :cols] = a, b
    return _strassen(wide_a, wide_b, depth)[:rows, :cols]


def _strassen(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if depth == 0:
        return a @ b
    r, n, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :n], a[:r, n:], a[r:, :n], a[r:, n:]
    b11, b12, b21, b22 = b[:n, :c], b[:n, c:], b[n:, :c], b[n:, c:]
    mul = lambda x, y: _strassen(x, y, depth - 1)
    out = np.empty((2 * r, 2 * c), a.dtype)
    p = mul(a11 + a22, b11 + b22)
    out[:r, :c] = p
    out[r:, c:] = p
    p = mul(a21 + a22, b11)
    out[r:, :c] = p
    out[r:, c:] -= p
    p = mul(a11, b12 - b22)
    out[:r, c:] = p
    out[r:, c:] += p
    p = mul(a22, b21 - b11)
    out[:r, :c] += p
    out[r:, :c] += p
    p = mul(a11 + a12, b22)
    out[:r, :c] -= p
    out[:r, c:] += p
    out[r:, c:] += mul(a21 - a11, b11 + b12)
    out[:r, :c] += mul(a12 - a22, b21 + b22)
    return out


def _best(score: np.ndarray, at: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Of the columns ``at``, the ``k`` with the highest scores, ties by ``order``."""
    if len(at) > 4 * k:
        s = score[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.lexsort((order[at], -score[at].astype(object) if score.dtype == object else ~score[at]))][:k]


class Block:
    """Rows of one vector length: ids, row numbers, labels, vectors."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.x = np.stack([np.frombuffer(r["v"], np.float64) for r in rows])
        # place in order of id, null last: breaks ties
        ids = [(r["id"] is None, r["id"] or 0) for r in rows]
        self.order = np.empty(len(ids), np.int64)
        self.order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        self.size = np.abs(self.x).sum(axis=1).max(initial=0), np.abs(self.x).max(initial=0)


def _matrices(a: Block, c: Block) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and turned candidates as int64, or as unbounded integers if a score may not fit."""
    if a.size[0] * c.size[1] < 2.0 ** 62 and max(a.size[1], c.size[1]) < 2.0 ** 62:
        return a.x.astype(np.int64), np.ascontiguousarray(c.x.astype(np.int64).T)
    whole_numbers = np.vectorize(int, otypes=[object])
    return whole_numbers(a.x), whole_numbers(c.x).T


def _blocks(rows: pa.Table) -> dict[int, Block]:
    """A block for every vector length."""
    out: dict[int, list[dict]] = {}
    for r in rows.to_pylist():
        out.setdefault(len(r["v"]), []).append(r)
    return {n: Block(r) for n, r in out.items()}


def _positives(k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out, cands = [], _blocks(candidates)
        for n, a in _blocks(anchors).items():
            c = cands.get(n)
            if c is None:
                continue
            q, x = _matrices(a, c)
            for label in np.intersect1d(a.label, c.label):
                mine, theirs = np.flatnonzero(a.label == label), np.flatnonzero(c.label == label)
                score = strassen(q[mine], np.ascontiguousarray(x[:, theirs]))
                for i, s in zip(mine, score, strict=True):
                    other = np.flatnonzero(c.row[theirs] != a.row[i])
                    for j in _best(s, other, c.order[theirs], k):
                        out.append((int(a.row[i]), c.rows[theirs[j]]["id"], int(c.row[theirs[j]]), str(int(s[j]))))
        return _table(out, ["row", "positive_id", "positive_row"], ["score"])
    return run


def _negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out, cands = [], _blocks(candidates)
        for n, a in _blocks(anchors).items():
            c = cands.get(n)
            if c is None:
                continue
            score = strassen(*_matrices(a, c))
            for i, s in enumerate(score):
                stranger = c.label != a.label[i]
                for p in a.rows[i]["positives"]:
                    least, most = -(-low * int(p["score"]) // 100), high * int(p["score"]) // 100
                    if least > most:
                        continue
                    if s.dtype != object:
                        if least > _MAX or most < -_MAX - 1:
                            continue
                        least, most = max(least, -_MAX - 1), min(most, _MAX)
                    for j in _best(s, np.flatnonzero(stranger & (s >= least) & (s <= most)), c.order, k):
                        out.append((int(a.row[i]), p["positive_row"], c.rows[j]["id"], int(c.row[j]), str(int(s[j]))))
        return _table(out, ["row", "positive_row", "negative_id", "negative_row"], ["score"])
    return run


def _table(rows: list[tuple], longs: list[str], texts: list[str]) -> pa.Table:
    types = [pa.int64()] * len(longs) + [pa.string()] * len(texts)
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=longs + texts)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = pa.array([np.array(x, float).tobytes() for x in batch.column(3).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], v, batch.column(4)], names=["id", "row", "label", "v", "anchor"])


def _ranked(found: DataFrame, by: list[str], id_col: str, row_col: str, k: int) -> DataFrame:
    """The ``k`` best of each group, ``rank`` from 1. Scores are decimal texts here, since they
    may be beyond a long: their order is that of decimals, and beyond these of doubles."""
    number = F.col("score").cast("double"), F.expr("try_cast(score AS decimal(38, 0))")
    w = Window.partitionBy(*by).orderBy(number[0].desc(), number[1].desc_nulls_last(), F.col(id_col).asc_nulls_last(), row_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``:
    for each row with ``is_anchor`` and each of its ``positives`` best other rows
    of the same ``label``, the ``negatives`` best rows of another label whose score is
    between ``low`` and ``high`` hundredths of the positive's (none where that
    score is negative). Scores are inner products of ``floor(scale * x)``, higher ones
    first, ties by the smaller id (null last).

    Rows with a null label or vector, or a null or non-finite component, take no
    part; vectors meet only vectors of their own length. Repeated rows are rows of
    their own, as positives, negatives and anchors. Scores are exact; those
    beyond a long are cut to its range at the end. An empty table gives an empty
    result; other columns are ignored.
    """
    prepare(vectors.sparkSession)
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                           label.cast("long").alias("label"), whole(F.col(vector_col), scale).alias("v"),
                           F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
                   .where("v is not null and label is not null"))
    table = materialize(rows.mapInArrow(_packed, "id bigint, row bigint, label bigint, v binary, anchor boolean"), "vectors")
    n, n_anchors = table.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    blocks, parts = max(1, math.ceil(n_anchors / ANCHOR_ROWS)), max(1, math.ceil(n / CANDIDATE_ROWS))
    place = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # aliased: cogroup loses columns that both of its sides have from the same scan
    offered = table.select(*[F.col(c).alias(c) for c in ("id", "row", "label", "v")], place(parts).alias("part"),
                           every(blocks).alias("block")).groupBy("block", "part")
    anchors = table.where("anchor")

    asked = anchors.select("id", "row", "label", "v", place(blocks).alias("block"), every(parts).alias("part"))
    found = asked.groupBy("block", "part").cogroup(offered).applyInArrow(
        _positives(positives), "row bigint, positive_id bigint, positive_row bigint, score string")
    near = materialize(_ranked(found, ["row"], "positive_id", "positive_row", positives).drop("rank"), "positives")

    # at most `positives` entries a row
    windows = near.groupBy("row").agg(F.collect_list(F.struct("positive_row", "score")).alias("positives"))
    asked = anchors.join(windows, "row").select("id", "row", "label", "v", "positives", place(blocks).alias("block"),
                                                every(parts).alias("part"))
    found = asked.groupBy("block", "part").cogroup(offered).applyInArrow(
        _negatives(negatives, low, high), "row bigint, positive_row bigint, negative_id bigint, negative_row bigint, score string")
    best = _ranked(found, ["row", "positive_row"], "negative_id", "negative_row", negatives)
    inside = lambda c: F.coalesce(F.expr(f"try_cast({c} AS bigint)"),
                                  F.when(F.col(c).startswith("-"), F.lit(-_MAX - 1)).otherwise(F.lit(_MAX)))
    return (best.withColumnRenamed("score", "less").join(near, ["row", "positive_row"])
                .join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
                .select("anchor_id", "positive_id", "rank", "negative_id", inside("score").alias("positive_score"),
                        inside("less").alias("negative_score")))


#: DuckDB SQL of the registered query.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id,
             CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v AS a JOIN v AS c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.e) = len(a.e)),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS n
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE n <= 5
"""
