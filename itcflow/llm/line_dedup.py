"""Line de-duplication over overlapping windows of consecutive lines.

Spark SQL functions only: lines are hashed where they lie, and what is
shuffled is one narrow row a window; the first place of each window is a
partial aggregate, so a passage that a third of all documents share costs one
row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 3
BLANK = " \t\n\x0b\x0c\r"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                keep: list[str] | None = None) -> DataFrame:
    """``id_col, text, n_lines, n_removed``: one row per input row, with the
    lines of repeated windows removed from every place but the first. ``keep``
    names further columns to return (not those four).

    A window is ``window`` consecutive lines (cut at ``\\n``; trimmed for
    comparison; blank lines don't count). The first place of a window is the one
    in the row with the smallest id (null last), then the smallest position. At
    all later places, in the same document or another, the lines from the
    window's first to its last go, blank ones between them too; overlapping
    places are merged. A null text stays null, a text of fewer lines than
    ``window`` stays as it is. Of rows that share id and text, all but one lose
    every line that a window covers. Other columns are ignored.
    """
    names = ["_id", "_k1", "_k2"]  # the two hashes of id and text tell rows apart, null ids too
    keep = keep or []
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.xxhash64(id_col, text_col).alias("_k1"), F.hash(text_col, id_col).alias("_k2"),
                       F.split(text_col, "\n", -1).alias("_lines"))
    lines = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("x"))),
                     lambda s: s["x"] != "")
    hashed = F.transform(lines, lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("a"),
                                                   F.hash(s["x"]).alias("b")))
    at = [lambda i, n=n: F.get(F.col("_h"), i + n) for n in range(window)]
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - window), lambda i: F.struct(
        at[0](i)["i"].alias("lo"), at[-1](i)["i"].alias("hi"),
        F.xxhash64(*[g(i)["a"] for g in at]).alias("a"), F.hash(*[g(i)["b"] for g in at]).alias("b")))
    places = (rows.select(*names, hashed.alias("_h")).where(F.size("_h") >= window)
                  .select(*names, F.inline(windows)))
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_k1").alias("k1"),
                     F.col("_k2").alias("k2"), F.col("lo").alias("lo"))
    first = (places.groupBy("a", "b").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
                   .where("_n > 1").drop("_n"))
    later = (places.join(first, ["a", "b"]).where(place != F.col("_first"))
                   .groupBy("_k1", "_k2").agg(F.collect_set(F.struct("lo", "hi")).alias("_later")))
    spare = Window.partitionBy("_k1", "_k2").orderBy("_k1")
    copies = rows.join(later, ["_k1", "_k2"], "left").withColumn("_copy", F.row_number().over(spare))
    covered = F.array_distinct(F.flatten(F.transform("_later", lambda s: F.sequence(s["lo"], s["hi"]))))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    here = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("x"))),
                    lambda s: s["x"] != "")
    whole = F.sequence(F.element_at(here, 1)["i"], F.element_at(here, -1)["i"])
    gone = (F.when((F.col("_copy") > 1) & (F.size(here) >= window), whole)
             .otherwise(F.coalesce(covered, F.array().cast("array<int>"))))
    kept = copies.withColumn("_gone", gone).withColumn("_kept", F.array_except(every, F.col("_gone")))
    text = F.when(F.size("_gone") == 0, F.col("_text")).otherwise(
        F.array_join(F.transform("_kept", lambda i: F.get(F.col("_lines"), i)), "\n"))
    return kept.select(F.col("_id").alias(id_col), text.alias("text"),
                       F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
                       F.size("_gone").cast("long").alias("n_removed"),
                       *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)])


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with their text column de-duplicated, other columns as they were."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    inner = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"),
                        *[F.col(c).alias(f"_r{i}") for i, c in enumerate(rest)])
    out = dedup_lines(inner, "_i", "_t", window, keep=[f"_r{i}" for i in range(len(rest))])
    back = {id_col: "_i", text_col: "text"} | {c: f"_r{i}" for i, c in enumerate(rest)}
    return out.select(*[F.col(back[c]).alias(c) for c in docs.columns])


#: DuckDB SQL of ``dedup_lines`` over a table without repeated rows.
SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM d WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS x FROM l),
w AS (SELECT doc_id, i AS lo, lead(i, 2) OVER p AS hi, x AS x1, lead(x) OVER p AS x2, lead(x, 2) OVER p AS x3
      FROM t WHERE x <> '' WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY x1, x2, x3 ORDER BY doc_id NULLS LAST, lo) AS n FROM w WHERE hi IS NOT NULL),
c AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM r WHERE n > 1),
k AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN c USING (doc_id, i) GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN g.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""
