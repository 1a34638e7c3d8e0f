"""Skew-safe building blocks.

A running total over ``partitionBy(key).orderBy(t)`` sends each key to one
task: a key holding a third of the rows then runs in a single task. The
helpers here split such keys over many range partitions instead and stitch
the pieces with per-partition offsets (a classic distributed prefix sum):

1. ``repartitionByRange(key, order)`` samples the data, so a hot key is cut
   across several partitions, each holding a contiguous run of its order;
2. a running sum inside each (key, partition) piece;
3. piece totals -> for every piece, the sum of the pieces before it (a tiny
   table: about one row per key plus one per partition);
4. join back on (key, partition) and add the offset.

The partition id of a row must be the same in steps 2 and 3. Range bounds
come from sampling the input, and the sample differs between evaluations
(its seed derives from the RDD id; an input fed by a shuffle also arrives in
a different order), so the assignment is pinned once with a reliable
``checkpoint()`` into the shared checkpoint folder. This also keeps the
result stable when an executor is lost and tasks are re-run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PID = "_pid"


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value, out: str,
               n: int | None = None) -> DataFrame:
    """``out`` = running sum of ``value`` per ``keys`` in ``order`` (rows
    unbounded preceding .. current row). ``order`` must end in a unique column."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    value = F.col(value) if isinstance(value, str) else value
    r = (df.withColumn("_val", value)
           .repartitionByRange(*([n] if n else []), *keys, *order)  # without n, Spark sizes the pieces
           .withColumn(_PID, F.spark_partition_id())
           .checkpoint(eager=True))
    w_local = (Window.partitionBy(*keys, _PID).orderBy(*order)
                     .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = r.withColumn("_local", F.sum("_val").over(w_local))
    pieces = r.groupBy(*keys, _PID).agg(F.sum("_val").alias("_piece"))
    w_prev = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_offset", F.sum("_piece").over(w_prev)).drop("_piece")
    joined = local.join(offsets, [*keys, _PID], "left")
    zero = F.lit(0).cast(joined.schema["_local"].dataType)
    return (joined.withColumn(out, F.col("_local") + F.coalesce("_offset", zero))
                  .drop("_val", "_local", "_offset", _PID))


def sequential_index(df: DataFrame, order: list[str], out: str = "seq", start: int = 1,
                     n: int | None = None) -> DataFrame:
    """Dense 1..N numbering in ``order`` without a single-partition window."""
    k = "_k"
    res = prefix_sum(df.withColumn(k, F.lit(0)), [k], order, F.lit(1).cast("long"), out, n)
    return res.withColumn(out, F.col(out) + (start - 1)).drop(k)
