"""Chat formatting with perspective rotation.

Every participant of a dialogue gets a rendering of it in which that speaker is
the assistant and all others are named users; the mask covers what that speaker
says. Spark SQL functions only.

A dialogue is cut into blocks of ``BLOCK`` turns, counted over many tasks, so
that one with a third of all rows is neither one row nor one task; the blocks'
texts one after the other are the rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import prefix_sum
from .common import prepare

BLOCK = 64
SYSTEM = "system"
NOBODY = "unknown"
END = "<|end|>\n"


def clean(text: Column) -> Column:
    """A text that can't be taken for markers: ``<|`` gets a blank inside."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``conv_col, speaker, block, n_turns, text, spans``: one row for each
    dialogue, participant and block. ``spans`` are the masked stretches of the
    block's text: from (first) to (after the last) in code points, each the words of
    the speaker with the end marker.

    A participant is a distinct role other than ``system``; system turns are
    shown as such to everybody, and a dialogue of system turns only gives no row.
    A null role is the participant ``unknown``, a null text is empty, rows
    without a dialogue id are one dialogue (another one than that of an empty id). Turns are in order of their number,
    null last, ties by role and text; repeated rows are turns of their own. Other
    columns are ignored.
    """
    prepare(turns.sparkSession)
    rows = turns.select(F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("_key"), F.col(conv_col).alias("_conv"),
                        F.col(turn_col).isNull().alias("_last"), F.col(turn_col).alias("_turn"),
                        F.coalesce(role_col, F.lit(NOBODY)).alias("_role"), clean(F.col(text_col)).alias("_text"))
    order = ["_last", "_turn", "_role", "_text", "_again"]
    counted = prefix_sum(rows.withColumn("_again", F.monotonically_increasing_id()), ["_key"], order,
                         F.lit(1).cast("long"), "_nth").drop(*order[:2], "_again")
    people = rows.where(F.col("_role") != SYSTEM).select(F.col("_key").alias("_k"), F.col("_role").alias("speaker")).distinct()
    mine = F.col("_role") == F.col("speaker")
    head = (F.when(mine, F.lit("<|assistant|>\n")).when(F.col("_role") == SYSTEM, F.lit("<|system|>\n"))
             .otherwise(F.concat(F.lit("<|user "), clean(F.col("_role")), F.lit("|>\n"))))
    said = counted.join(people, F.col("_key") == F.col("_k")).select(
        "_key", "_conv", "speaker", F.floor((F.col("_nth") - 1) / block).alias("block"),
        F.struct(F.col("_nth").alias("nth"), mine.alias("mine"), F.length(head).alias("skip"),
                 F.concat(head, "_text", F.lit(END)).alias("x")).alias("part"))
    parts = said.groupBy("_key", "speaker", "block").agg(F.first("_conv").alias("_conv"),
                                                         F.sort_array(F.collect_list("part")).alias("parts"))
    span = "array<struct<start:int,end:int>>"
    walk = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans")),
                       lambda a, p: F.struct(
                           (a["at"] + F.length(p["x"])).alias("at"),
                           F.when(p["mine"], F.concat(a["spans"], F.array(F.struct(
                               (a["at"] + p["skip"]).alias("start"), (a["at"] + F.length(p["x"]) - 1).alias("end")))))
                            .otherwise(a["spans"]).alias("spans")))
    return parts.select(F.col("_conv").alias(conv_col), "speaker", F.col("block").cast("long").alias("block"),
                        F.size("parts").cast("long").alias("n_turns"),
                        F.array_join(F.transform("parts", lambda p: p["x"]), "").alias("text"),
                        walk["spans"].alias("spans"))


def mask_text(spans: str = "spans") -> Column:
    """Spans as ``start-end`` with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


#: DuckDB SQL of the registered query, for a table without repeated rows.
SQL = """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'),
                                     replace(coalesce(text, ''), '<|', '< |')) - 1 AS n FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
s AS (SELECT t.conv_id, speaker, n, n // 64 AS block, role = speaker AS mine, x || '<|end|>' || chr(10) AS x,
             CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
                  ELSE '<|user ' || replace(role, '<|', '< |') || '|>' END || chr(10) AS h
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
a AS (SELECT *, coalesce(sum(length(h) + length(x)) OVER (PARTITION BY conv_id, speaker, block ORDER BY n
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s)
SELECT conv_id, speaker, CAST(block AS BIGINT) AS block, count(*) AS n_turns, string_agg(h || x, '' ORDER BY n) AS text,
       string_agg(CASE WHEN mine THEN CAST(pos + length(h) AS BIGINT) || '-' || CAST(pos + length(h) + length(x) - 1 AS BIGINT) END,
                  ',' ORDER BY n) AS mask
FROM a GROUP BY conv_id, speaker, block
"""
