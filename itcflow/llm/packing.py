"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids (and an end id) are cut at every ``capacity``; full pieces are
sequences as they are. The rests are dealt by hash to groups of about
``WINDOWS`` windows. In a group, every rest starts as a partition of the windows
with one filled; the two partitions with the widest spread are merged again and
again, the fullest window of one with the emptiest of the other, until one is
left. Windows that come out a little above the capacity swap an item for a
smaller one of another window; if that doesn't help, the group is solved again
with one window more. Where whole rests would leave more than one window in a
hundred (and more than two) empty, some are cut at multiples of ``GRAIN`` tokens,
so that their parts fill the gaps.

Null and empty texts have the end id only. Repeated rows are packed one by one.
An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, prepare, tidy, utf8
from .token_ids import of_worker

CAPACITY = 4096
END = 2
WINDOWS = 256

#: Swaps tried before a group gets one window more.
SWAPS = 2000

#: Rests shorter than this are merged into bundles first, so that a group of
#: very short texts has no more items than others.
BUNDLE = 16

#: Rests are cut at multiples of so many tokens only: checksums up to these are kept.
GRAIN = 32


def _marks(piece: bytes) -> bytes:
    """The checksums of a piece's first 1, 2, 3 … times ``GRAIN`` tokens."""
    view, step, crc, out = memoryview(piece), 4 * GRAIN, 0, []
    for at in range(0, len(piece) - step, step):
        crc = zlib.crc32(view[at:at + step], crc)
        out.append(crc)
    return np.array(out, "<u4").tobytes()


def _part_crc(marks: bytes, whole: int, length: int, start: int, end: int) -> int:
    """The checksum of the tokens ``start`` to ``end`` of a piece; both are
    multiples of ``GRAIN`` or an end of the piece."""
    at = np.frombuffer(marks, "<u4")
    upto = whole if end == length else int(at[end // GRAIN - 1])
    if start == 0:
        return upto
    zeros = bytes(4 * (end - start))  # takes out what the tokens before have added
    return upto ^ zlib.crc32(zeros, int(at[start // GRAIN - 1])) ^ zlib.crc32(zeros)


def _pieces(capacity: int, end: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tail = of_worker(path), np.array([end], "<u4").tobytes()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc, out, marks = [], [], []
            for i, tokens in enumerate(ids.of_all(batch.column(1))):
                tokens += tail
                n = len(tokens) // 4
                for start in range(0, n, capacity):
                    piece = tokens[4 * start:4 * (start + capacity)]
                    doc.append(i)
                    out.append((row, start, len(piece) // 4, zlib.crc32(piece), n))
                    marks.append(_marks(piece) if len(piece) < 4 * capacity else None)
                    row += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())),
                 *[pa.array([x[c] for x in out], pa.int64()) for c in range(5)], pa.array(marks, pa.binary())],
                names=["id", "row", "start", "length", "ids_crc32", "doc_tokens", "marks"])
        ids.forget()
    return run


def differencing(sizes: list[int], k: int) -> tuple[list[int], int]:
    """A window in 0 .. k-1 for each size, and the fullest window's load."""
    if k == 1:
        return [0] * len(sizes), sum(sizes)
    nodes: list = []  # (item) or (left node, right node, where left's windows went, where right's went)
    heap = []
    for item, size in enumerate(sizes):
        load = np.zeros(k, np.int64)
        load[0] = size
        heap.append((-size, item, load))
        nodes.append(item)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        load = x + y[::-1]
        order = np.argsort(-load, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        nodes.append((a, b, place, place[::-1]))
        load = load[order]
        heapq.heappush(heap, (-int(load[0] - load[-1]), len(nodes) - 1, load))
    window = [0] * len(sizes)
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        node, where = todo.pop()
        if isinstance(nodes[node], int):
            window[nodes[node]] = int(where[0])
        else:
            a, b, left, right = nodes[node]
            todo += [(a, where[left]), (b, where[right])]
    return window, int(heap[0][2][0])


def relieve(sizes: list[int], window: list[int], k: int, capacity: int) -> list[int] | None:
    """The windows after swaps that bring the fullest one down until none is
    above the capacity; None if no swap helps any more."""
    size, where = np.array(sizes), np.array(window)
    load = np.bincount(where, size, k).astype(np.int64)
    for _ in range(SWAPS):
        full = int(load.argmax())
        if load[full] <= capacity:
            return where.tolist()
        mine, other = np.flatnonzero(where == full), np.flatnonzero(where != full)
        less = size[mine][:, None] - size[other][None, :]
        after = np.maximum(load[full] - less, load[where[other]][None, :] + less)  # the larger of the two loads
        after = np.where(less > 0, after, load[full])
        i, j = np.unravel_index(int(after.argmin()), after.shape)
        if after[i, j] >= load[full]:
            return None
        a, b = mine[i], other[j]
        load[full] -= less[i, j]
        load[where[b]] += less[i, j]
        where[a], where[b] = where[b], full
    return None


def _items(sizes: list[int], bundle: int) -> list[list[int]]:
    """The sizes' indices, the largest first; short ones in bundles."""
    items: list[list[int]] = []
    small: list[int] = []
    held = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i] >= bundle:
            items.append([i])
            continue
        small.append(i)
        held += sizes[i]
        if held >= bundle:
            items.append(small)
            small, held = [], 0
    return items + [[i] for i in small]


def pack_group(sizes: list[int], capacity: int = CAPACITY, bundle: int = BUNDLE, most_windows: int | None = None) -> list[int] | None:
    """A window for each size (1 .. capacity), with no window above the capacity;
    None if that would take more windows than ``most_windows``."""
    items = _items(sizes, bundle)
    loads = [sum(sizes[i] for i in item) for item in items]
    k = max(1, math.ceil(sum(loads) / capacity), sum(2 * x > capacity for x in loads))
    while True:
        if most_windows is not None and k > most_windows:
            return None
        window, most = differencing(loads, k)
        window = window if most <= capacity else relieve(loads, window, k, capacity)
        if window is not None:
            break
        k += 1
    out = [0] * len(sizes)
    for item, w in zip(items, window, strict=True):
        for i in item:
            out[i] = w
    return out


def cut_group(sizes: list[int], capacity: int = CAPACITY, bundle: int = BUNDLE, grain: int = GRAIN) -> list[tuple[int, int, int, int]]:
    """``index, start, end, window`` of the parts of all sizes. As many as fit
    stay whole, each in the fullest window that takes it; the others are cut at
    multiples of ``grain`` into what is free, less than ``grain`` of which stays
    empty in a window before the last one used."""
    items = _items(sizes, bundle)
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        free, parts, left = np.full(k, capacity, np.int64), [], []
        for item in items:
            load = sum(sizes[i] for i in item)
            w = int(np.where(free >= load, free, capacity + 1).argmin())
            if free[w] < load:
                left += item
                continue
            free[w] -= load
            parts += [(i, 0, sizes[i], w) for i in item]
        w = 0
        for i in left:
            start = 0
            while start < sizes[i] and w < k:
                room = int(free[w])
                take = sizes[i] - start if sizes[i] - start <= room else room // grain * grain
                if take:
                    parts.append((i, start, start + take, w))
                    start += take
                    free[w] -= take
                if start < sizes[i]:
                    w += 1
            if start < sizes[i]:
                break
        else:
            return parts
        k += 1


def _cut(rests: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """The parts of the rests as rows of their own, with their windows."""
    parts = sorted(cut_group(rests["length"].tolist(), capacity))
    at, start, end, window = (list(x) for x in zip(*parts, strict=True))
    out = rests.iloc[at].reset_index(drop=True)
    out["ids_crc32"] = [_part_crc(m, c, n, a, b) for m, c, n, a, b in
                        zip(out["marks"], out["ids_crc32"], out["length"], start, end, strict=True)]
    out["start"] += np.array(start)
    out["length"] = np.array(end) - np.array(start)
    out["window"] = window
    return out


def _packed(capacity: int):
    def run(rests: pd.DataFrame) -> pd.DataFrame:
        rests = rests.sort_values("row", ignore_index=True)
        least = math.ceil(rests["length"].sum() / capacity)
        window = pack_group(rests["length"].tolist(), capacity, most_windows=least + max(2, least // 100))
        rests = _cut(rests, capacity) if window is None else rests.assign(window=window)
        before = rests.groupby("window")["length"].cumsum() - rests["length"]
        rests["sequence_id"] = (rests["bucket"] * (1 << 20) + rests["window"]) * 2
        rests["offset"] = before
        return rests[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
         tokenizer: str | None = None) -> DataFrame:
    """One row a piece: ``id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. ``tokenizer`` is a path that every worker can read
    (by default the installed ``word_bpe_49k.json``). Other columns are ignored."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    longs = ["row", "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in longs],
                           T.StructField("marks", T.BinaryType())])
    pieces = materialize(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("t"))
                             .mapInArrow(tidy(_pieces(capacity, end, tokenizer)), schema), "pieces")
    rests = pieces.where(F.col("length") < capacity)
    tokens = rests.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / (capacity * WINDOWS)))
    out = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in
                                                     ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
    packed = (rests.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups)))
                   .groupBy("bucket").applyInPandas(_packed(capacity), out))
    full = pieces.where(F.col("length") == capacity).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed).withColumnRenamed("id", id_col)
