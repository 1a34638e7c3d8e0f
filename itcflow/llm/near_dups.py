"""Near-duplicate classes: DartMinHash signatures, banded join, exact check.

Null, empty and white-space texts have no shingles: each such row is a class
of its own. Texts with the same words (case and white space aside) are one
class from the start and take part once, however many copies there are. Rows
with the same id and text are copies like any other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dartminhash as D
from .common import materialize, passing, prepare, spare, tidy, utf8
from .components import components

#: Bounds of one block of a bucket's members; a larger bucket is cut into
#: blocks, and every pair of its blocks is tested.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20

#: Bytes of text whose signatures are made at once.
TEXT_BYTES = 1 << 20


def _packed(el: np.ndarray, count: np.ndarray, weighting: str) -> np.ndarray:
    """Sorted 32-bit elements of the exact check. By count, an element that
    occurs m times is m elements, so that set overlap is weighted overlap."""
    if weighting == "count" and len(count) and count.max() > 1:
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        el = D.mix(np.repeat(el, count) + number.astype(np.uint64))
    return np.unique((el >> np.uint64(32)).astype("<u4"))


def _signatures(k: int, band: int, n: int, weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= TEXT_BYTES):
                    size += len(texts[hi])
                    hi += 1
                low = [D.lower(t) for t in texts[lo:hi]]
                sets = D.elements(low, n)
                full = [i for i, (e, _) in enumerate(sets) if len(e)]
                keys, size_, band_, packed = ([None] * len(low) for _ in range(4))
                if full:
                    weight = [(sets[i][0], sets[i][1] if weighting == "count" else np.ones(len(sets[i][0])))
                              for i in full]
                    found = D.bands(D.signatures(weight, k), band).view(np.int64)
                    for row, i in enumerate(full):
                        keys[i] = hashlib.blake2b(b" ".join(low[i].split()), digest_size=16).digest()
                        el = _packed(*sets[i], weighting)
                        size_[i], band_[i], packed[i] = len(el), found[row], el.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), rows.slice(lo, hi - lo), pa.array(keys, pa.binary()),
                     pa.array(size_, pa.int64()), pa.array(band_, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                    names=["id", "r", "c", "n", "bands", "el"])
                lo = hi
    return run


class _Forest:
    """Union-find over a group's members; keeps the joins that linked two trees."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))


def similar_pairs(sets: list[np.ndarray], threshold: float, split: int) -> Iterator[tuple[int, int]]:
    """Pairs at or above the similarity; with ``split`` > 0 only those between
    the first ``split`` sets and the others."""
    size = np.array([len(s) for s in sets])
    left = split or len(sets)
    if len(sets) <= 6:
        for i in range(left):
            for j in range(max(split, i + 1), len(sets)):
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= threshold * (size[i] + size[j] - both):
                        yield i, j
        return
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), size)
    shared = times[at] > 1
    column = np.cumsum(times > 1) - 1
    doc, at = doc[shared], column[at[shared]]
    order = np.argsort(at, kind="stable")
    doc, at = doc[order], at[order]
    both, step = np.zeros((left, len(sets) - split), np.float32), 2048
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        a, b = np.searchsorted(at, (lo, lo + step))
        m = np.zeros((len(sets), step), np.float32)
        m[doc[a:b], at[a:b] - lo] = 1
        both += m[:left] @ m[split:].T
    hit = both >= threshold * (size[:left, None] + size[None, split:] - both)
    for i, j in zip(*np.nonzero(hit), strict=True):
        if split or i < j:
            yield int(i), int(j) + split


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tested(rows: list[tuple]) -> pa.RecordBatch:
            split = sum(not r[0] for r in rows) if any(r[0] for r in rows) else 0
            sets = [np.frombuffer(r[2], "<u4") for r in rows]
            forest = _Forest(len(rows))
            for i, j in similar_pairs(sets, threshold, split):
                forest.join(i, j)
            ends = [(rows[i][1], rows[j][1]) for i, j in forest.edges]
            return pa.RecordBatch.from_arrays([pa.array([e[s] for e in ends], pa.binary()) for s in (0, 1)],
                                              names=["a", "b"])
        group, rows = None, []
        for batch in batches:
            for key, i, j, right, c, el in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if (key, i, j) != group:
                    if len(rows) > 1:
                        yield tested(rows)
                    group, rows = (key, i, j), []
                rows.append((right, c, el))
        if len(rows) > 1:
            yield tested(rows)
    return run


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           threshold: float = 0.8, shingle: int = D.SHINGLE, k: int = D.K, band: int = D.BAND,
                           weighting: str = "set") -> DataFrame:
    """``id_col, class_id``: one row per input row; ``class_id`` is the smallest
    id of the row's class (its own id if it is alone). Documents are linked if
    the Jaccard similarity of their shingles reaches ``threshold``, classes are
    the connected components.

    Candidates share one of ``k / band`` keys of consecutive signature values.
    Keys with the same members count once. Members of a key are tested exactly,
    every pair, in blocks of bounded size; a block pair returns a spanning
    forest of its links, so that the links grow with the members and not with
    the pairs. With the defaults a pair at similarity 0.8 has no common key with
    a probability of 0.00003.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("r", T.LongType()),
                           T.StructField("c", T.BinaryType()), T.StructField("n", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("el", T.BinaryType())])
    signed = (docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("r"), utf8(text_col).alias("t"))
                  .mapInArrow(tidy(_signatures(k, band, shingle, weighting)), schema))
    with passing(signed, "signatures") as sig:  # of use until the links are known
        ids = materialize(sig.select("id", "c"), "ids")
        links = materialize(_linked(sig.where("c is not null"), threshold), "links")
    some = ids.where("c is not null")
    root = components(links)
    low = some.groupBy("c").agg(F.min("id").alias("low")).join(root.withColumnRenamed("node", "c"), "c", "left")
    low = low.select("c", "low", F.coalesce("root", "c").alias("root"))
    classes = low.join(low.groupBy("root").agg(F.min("low").alias("class_id")), "root").select("c", "class_id")
    alone = ids.where("c is null").select("id", F.col("id").alias("class_id"))
    return (some.join(classes, "c").select("id", "class_id").unionByName(alone)
                .withColumnRenamed("id", id_col))


def _linked(some: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links between distinct texts that connect all that are similar."""
    texts = materialize(some.groupBy("c").agg(F.min("r").alias("r"), F.first("n").alias("n"),
                                              F.first("bands").alias("bands")), "texts")
    keys = texts.select("c", "r", "n", F.explode("bands").alias("key"))
    buckets = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("volume"),
                                       F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
                   .where("members > 1")
                   .groupBy("members", "volume", "x", "y").agg(F.min("key").alias("key")))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("volume") * 4 / BLOCK_BYTES)).cast("int")
    inside = keys.join(buckets, "key").select("key", "c", "r", blocks.alias("blocks")).withColumn(
        "mine", F.pmod(F.xxhash64("c", F.lit(2)), F.col("blocks")).cast("int"))
    wanted = inside.select("c", "r").distinct()
    el = some.select("c", "r", "el").join(wanted, ["c", "r"]).select("c", "el").dropDuplicates(["c"])
    paired = (inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                    .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                            (F.col("mine") > F.col("other")).alias("right"), "c")
                    .join(el, "c").select("key", "i", "j", "right", "c", "el")
                    .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "right", "c"))
    return paired.mapInArrow(tidy(_links(threshold)), "a binary, b binary").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` with one document of each class: the one with the
    smallest id. Of rows that share id and text one stays; rows that share an
    id but not the text are kept apart. Needs non-null ids to tell rows apart;
    rows with a null id are kept."""
    mark, i, m = spare(docs, "_mark"), spare(docs, "_i"), spare(docs, "_m")
    named = docs.withColumn(mark, F.xxhash64(text_col))
    rows = named.select(F.struct(F.col(id_col).alias("i"), F.col(mark).alias("m")).alias("id"), F.col(text_col).alias("t"))
    classes = near_duplicate_classes(rows, "id", "t", **params).where("class_id <=> id")
    stay = classes.select(F.col("id.i").alias(i), F.col("id.m").alias(m)).distinct()
    with_id = (named.where(F.col(id_col).isNotNull())
                    .join(stay, (F.col(id_col) == F.col(i)) & (F.col(mark) == F.col(m)), "left_semi")
                    .dropDuplicates([id_col, mark]))
    return with_id.unionByName(named.where(F.col(id_col).isNull())).select(*docs.columns)
