"""Running totals looked up at a moment (an as-of join), safe against hot keys.

Questions and changes are one table, sorted by key and time over range
partitions; a question reads the sum of the changes before it. As in ``skew.py``
a key that holds a third of the rows is cut over many partitions, and the pieces
are stitched by their totals; no row meets the other rows of its key in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_TOTAL = "decimal(38,2)"


def as_of_sums(asks: DataFrame, changes: DataFrame, keys: list[str], at: list[str], values: list[str],
               n: int | None = None) -> DataFrame:
    """``asks`` with one column per value: its sum over the changes of the same
    ``keys`` that come no later in the order of ``at`` (columns of both tables).

    Changes at one place of the order count together and before a question at it.
    A question without a key or a time finds nothing (0), changes without either
    count nowhere; null values add nothing. Questions that repeat are answered
    each. Changes of keys nobody asks about are left out before the sort.
    """
    ensure_checkpoint_dir(asks.sparkSession)
    ask = F.struct(*[F.col(c) for c in asks.columns])
    place = [F.col(c).alias(f"_at{i}") for i, c in enumerate(at)]
    key = [F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)]
    kn, an, vn = [f"_key{i}" for i in range(len(keys))], [f"_at{i}" for i in range(len(at))], [f"_v{i}" for i in range(len(values))]
    asked = asks.select(*key, *place, F.lit(1).alias("_turn"), *[F.lit(0).cast(_TOTAL).alias(v) for v in vn], ask.alias("_ask"))
    moved = (changes.select(*key, *place, *[F.col(c).alias(v) for c, v in zip(values, vn)])
                    .dropna(subset=[*kn, an[0]])
                    .groupBy(*kn, *an).agg(*[F.sum(v).cast(_TOTAL).alias(v) for v in vn])
                    .join(asked.select(*kn).distinct(), kn, "left_semi")
                    .select(*kn, *an, F.lit(0).alias("_turn"), *[F.coalesce(v, F.lit(0).cast(_TOTAL)).alias(v) for v in vn],
                            F.lit(None).cast(asked.schema["_ask"].dataType).alias("_ask")))
    order = [*an, "_turn"]
    line = (moved.unionByName(asked).repartitionByRange(*([n] if n else []), *kn, *order)
                 .withColumn("_piece", F.spark_partition_id()).checkpoint(eager=True))
    here = Window.partitionBy(*kn, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*kn).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (line.groupBy(*kn, "_piece").agg(*[F.sum(v).alias(v) for v in vn])
                   .select(*kn, "_piece", *[F.sum(v).over(before).alias(f"{v}_before") for v in vn]))
    inside = line.select(*kn, "_piece", "_ask", *[F.sum(v).over(here).alias(v) for v in vn]).filter(F.col("_ask").isNotNull())

    def total(v: str) -> Column:
        return (F.col(v) + F.coalesce(F.col(f"{v}_before"), F.lit(0).cast(_TOTAL))).cast(_TOTAL)
    return inside.join(offsets, [*kn, "_piece"], "left").select("_ask.*", *[total(v).alias(c) for c, v in zip(values, vn)])
