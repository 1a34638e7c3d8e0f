"""Mixing sources to target weights by entropy balancing.

Documents get rates as close as possible (in relative entropy) to one copy
each, under one constraint for each source: the tokens it gives equal its
target. The dual of that problem is convex with one number for each source;
its solution is the exponentially tilted rate ``min(cap, exp(l * size / mean
size))``. Newton steps on the dual run as Spark aggregations over the counts of
(source, size), kept in a bracket that always holds the root.

Rates become whole copies by a threshold: copy ``j`` of a document is taken if
``j - rate - u`` lies under its source's threshold, ``u`` being a hash of the
row in [0, 1). The threshold is the one at which the source's tokens reach its
target, found by histograms in two resolutions; up to two documents of fitting
size then close what is left.

Sums are exact (integers and decimals), so reruns agree. Null texts have size 0
and are never taken, null is a source like any other (the last one). Rows that
share id and text get the same number of copies. An empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import sequential_index
from .common import materialize, prepare

WEIGHTS = (1, 2, 3)
CAP = 3
BINS = 4096
MOVES = 2
MAX_STEPS = 100


def n_words(text_col: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def _small(df: DataFrame, sources: int, name: str) -> DataFrame:
    """A table with a few rows a source, written in as many files as it needs."""
    return materialize(df.coalesce(1 + sources // 100_000), name)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size, smallest, docs, target`` from rows of ``source, size``.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    the total; a target stops at ``cap`` times its source's size, and the excess
    is shared again by weight until no target is above.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"),
                                        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    total = materialize(total, "sources")
    n = total.count()
    ranked = sequential_index(total.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_rank", 0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = _small(ranked.select("source", "source_size", "docs", "smallest", weight.alias("weight")), n, "weights")
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, most = 0.0, F.col("source_size") * cap
    while True:  # the level rises until the capped sources stay the same
        above = F.col("weight") * level > most
        full, free = ranked.agg(F.coalesce(F.sum(F.when(above, most.cast("decimal(38,6)"))), F.lit(0)),
                                F.sum(F.when(~above, F.col("weight").cast("decimal(38,6)")))).first()
        higher = float(everything - full) / float(free) if free else level
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "source_size", "docs", "smallest",
                         F.least(most.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _rate(size: Column, tilt: Column, mean: Column, cap: float) -> Column:
    return F.when(tilt.isNull(), F.lit(float(cap))).otherwise(
        F.exp(F.least(tilt * size / mean, F.lit(math.log(cap)))))


def tilted_rates(sizes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """``targets`` with ``mean`` size and ``tilt`` by source; a null ``tilt``
    stands for a source that is taken ``cap`` times over."""
    n = targets.count()
    cells = materialize(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "cells")
    mean = F.col("source_size") / F.col("docs")
    state = targets.where("target > 0").withColumn("mean", mean)
    log_t = F.log(F.col("source_size") / F.col("target"))
    state = state.select("source", "target", "mean",
                         (F.col("target") >= F.col("source_size") * cap * (1 - 1e-9)).alias("done"),
                         F.lit(0.0).alias("tilt"),
                         (-F.greatest(log_t, F.lit(0.0)) * F.col("mean") / F.col("smallest")).alias("lo"),
                         (F.lit(math.log(cap)) * F.col("mean") / F.col("smallest")).alias("hi"))
    state = state.withColumn("tilt", F.when(~F.col("done"), F.col("tilt")))
    state = _small(state, n, "dual")
    for _ in range(MAX_STEPS):
        open_ = state.where("not done")
        x = F.col("tilt") * F.col("size") / F.col("mean")
        tokens = F.col("docs") * F.col("size") * F.exp(F.least(x, F.lit(math.log(cap))))
        slope = F.when(x < math.log(cap), tokens * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = (cells.join(F.broadcast(open_) if n <= 1000 else open_, cells["source"].eqNullSafe(open_["source"]))
                     .groupBy(open_["source"].alias("_source"))
                     .agg(F.sum(tokens.cast("decimal(32,6)")).cast("double").alias("g"),
                          F.sum(slope.cast("decimal(32,6)")).cast("double").alias("dg")))
        newton = F.col("tilt") + F.log(F.col("target") / F.col("g")) * F.col("g") / F.col("dg")
        low = F.when(F.col("g") <= F.col("target"), F.col("tilt")).otherwise(F.col("lo"))
        high = F.when(F.col("g") >= F.col("target"), F.col("tilt")).otherwise(F.col("hi"))
        met = F.abs(F.col("g") - F.col("target")) <= F.greatest(F.lit(0.5), F.col("target") * 1e-7)
        tight = high - low <= F.abs(F.col("tilt")) * 1e-12
        step = state.join(sums, state["source"].eqNullSafe(sums["_source"]), "left").select(
            "source", "target", "mean", (F.col("done") | met | tight).alias("done"),
            F.when(F.col("done") | met | tight, F.col("tilt"))
             .when((F.col("dg") > 0) & (newton > low) & (newton < high), newton)
             .otherwise((low + high) / 2).alias("tilt"),
            F.when(F.col("done"), F.col("lo")).otherwise(low).alias("lo"),
            F.when(F.col("done"), F.col("hi")).otherwise(high).alias("hi"))
        state = _small(step, n, "dual")
        if state.where("not done").isEmpty():
            break
    return targets.join(state.select(F.col("source").alias("_source"), "mean", "tilt"),
                        F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _copies(cap: int) -> Column:
    """Copies of a row with ``size, u, tilt, mean, edge, moves, mark``."""
    rate = _rate(F.col("size"), F.col("tilt"), F.col("mean"), cap)
    taken = F.lit(0)
    for j in range(1, cap + 1):
        taken = taken + (j - rate - F.col("u") < F.col("edge")).cast("int")
    moved = F.aggregate(F.filter("moves", lambda m: m["mark"] == F.col("mark")), F.lit(0), lambda a, m: a + m["by"])
    return F.when((F.col("size") > 0) & (F.col("target") > 0), taken + moved).otherwise(F.lit(0)).cast("long")


def _marked(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    mark = F.xxhash64(F.col(id_col), F.col(text_col))
    return [F.col(source_col).alias("source"), mark.alias("mark"),
            (F.pmod(F.xxhash64(mark), F.lit(1 << 30)) / float(1 << 30)).alias("u"), n_words(text_col).alias("size")]


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: what ``with_copies`` needs to count each row's copies."""
    prepare(docs.sparkSession)
    sizes = materialize(docs.select(*_marked(docs, id_col, source_col, text_col)), "sizes")
    targets = source_targets(sizes, weights, cap)
    n = targets.count()
    none = F.array().cast("array<struct<mark:bigint,by:int>>")
    plan = _small(tilted_rates(sizes, targets, cap).withColumn("edge", F.lit(-float(cap + 1)))
                  .withColumn("width", F.lit((2.0 * cap + 2) / BINS)).withColumn("before", F.lit(0).cast("decimal(38,0)"))
                  .withColumn("moves", none), n, "plan")
    rows = sizes.where("size > 0").withColumnRenamed("source", "_s")
    for _ in range(2):
        units = (rows.join(plan, F.col("_s").eqNullSafe(F.col("source")))
                     .select("_s", "size", "edge", "width", F.explode(F.array(*[F.lit(j) for j in range(1, cap + 1)])).alias("j"),
                             _rate(F.col("size"), F.col("tilt"), F.col("mean"), cap).alias("rate"), "u")
                     .withColumn("bin", F.floor((F.col("j") - F.col("rate") - F.col("u") - F.col("edge")) / F.col("width")))
                     .where(F.col("bin").between(0, BINS - 1)).groupBy("_s", "bin").agg(F.sum("size").alias("tokens")))
        to_here = F.sum("tokens").over(Window.partitionBy("_s").orderBy("bin"))
        # the bin in which the target is reached; the threshold is set at its start
        upto = (units.withColumn("upto", to_here.cast("decimal(38,0)"))
                     .join(plan.select(F.col("source").alias("_p"), "target", "before"), F.col("_s").eqNullSafe(F.col("_p")))
                     .where(F.col("before") + F.col("upto") <= F.col("target"))
                     .groupBy("_s").agg(F.max("upto").alias("inside"), F.max("bin").alias("last"))
                     .select(F.col("_s").alias("_in"), "inside", "last"))
        nxt = units.select(F.col("_s").alias("_n"), F.col("bin").alias("next"))
        cross = (nxt.join(upto, F.col("_n").eqNullSafe(F.col("_in")), "left")
                    .where(F.col("next") > F.coalesce("last", F.lit(-1)))
                    .groupBy("_n").agg(F.min("next").alias("next"), F.first("inside").alias("inside")))
        beyond = upto.join(cross, F.col("_in").eqNullSafe(F.col("_n")), "left_anti").select(
            F.col("_in").alias("_n"), (F.col("last") + 1).alias("next"), "inside")
        cross = cross.unionByName(beyond)
        plan = _small(plan.join(cross, F.col("source").eqNullSafe(F.col("_n")), "left").select(
            *[c for c in plan.columns if c not in ("edge", "width", "before")],
            (F.col("edge") + F.coalesce("next", F.lit(0)) * F.col("width")).alias("edge"),
            (F.col("width") / BINS).alias("width"),
            (F.col("before") + F.coalesce("inside", F.lit(0))).cast("decimal(38,0)").alias("before")), n, "plan")
    for _ in range(MOVES):
        now = (rows.join(plan, F.col("_s").eqNullSafe(F.col("source"))).withColumn("copies", _copies(cap))
                   .groupBy("_s", "mark", "u", "size", "copies", "target").agg(F.count(F.lit(1)).alias("times")))
        taken = now.groupBy("_s").agg(F.sum(F.col("copies") * F.col("size") * F.col("times")).alias("taken"))
        gap = F.col("target") - F.col("taken")
        options = (now.join(taken.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")))
                      .withColumn("by", F.when((gap > 0) & (F.col("copies") < cap), 1)
                                  .when((gap < 0) & (F.col("copies") > 0), -1))
                      .withColumn("rest", F.abs(gap - F.col("by") * F.col("size") * F.col("times")))
                      .where(F.col("rest") < F.abs(gap))
                      .groupBy("_s").agg(F.min(F.struct("rest", "u", "mark", "by")).alias("best")))
        plan = _small(plan.join(options, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn(
            "moves", F.when(F.col("best").isNull(), F.col("moves")).otherwise(
                F.concat("moves", F.array(F.struct(F.col("best.mark"), F.col("best.by"))))))
            .drop("_s", "best"), n, "plan")
    return plan.select("source", "source_size", "target", "mean", "tilt", "edge", "moves")


def _counted(docs: DataFrame, plan: DataFrame, keep: list[str], id_col: str, source_col: str, text_col: str,
             cap: int) -> DataFrame:
    """``_k0, _k1 ...`` for the columns ``keep``, and what the copies are counted from."""
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
                       *_marked(docs, id_col, source_col, text_col)).withColumnRenamed("source", "_s")
    return rows.join(plan, F.col("_s").eqNullSafe(F.col("source"))).withColumn("copies", _copies(cap))


def with_copies(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text", cap: int = CAP) -> DataFrame:
    """``id_col, size, source_size, target, rate, copies, taken`` of each row."""
    rate = F.when((F.col("size") > 0) & (F.col("target") > 0), _rate(F.col("size"), F.col("tilt"), F.col("mean"), cap))
    return _counted(docs, plan, [id_col], id_col, source_col, text_col, cap).select(
        F.col("_k0").alias(id_col), "size", "source_size", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"), "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          cap: int = CAP) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    out = _counted(docs, plan, docs.columns, id_col, source_col, text_col, cap).where("copies > 0")
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
               .select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)]))
