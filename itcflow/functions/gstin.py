"""GSTIN checks as column expressions (F5, F7) and the look-alike repair job.

The check digit is a mod-36 sum computed with SQL higher-order functions
(``transform``/``aggregate``), so it runs in the JVM for whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bridge import chk_spark
from . import fixed


def _lit_array(xs) -> str:
    return "array(" + ", ".join("'" + x + "'" for x in xs) + ")"




def check_char(g14_sql: str, checksum: str = "reference") -> Column:
    """Check character of a 14-char SQL expression under a factor scheme."""
    return F.expr(chk_spark(g14_sql, fixed.CHECKSUM_FACTORS[checksum]))


def checks(g: str, checksum: str = "reference") -> dict[str, Column]:
    """Pattern, state and checksum tests of a (cleaned) GSTIN column name."""
    c = F.col(g)
    pattern_ok = c.rlike(fixed.GSTIN_PATTERN)
    state_ok = F.substring(c, 1, 2).isin(list(fixed.STATE_CODES.keys()))
    chk = check_char(f"substr({g}, 1, 14)", checksum)
    checksum_ok = (F.length(c) == 15) & (F.substring(c, 15, 1) == chk)
    return {"pattern_ok": pattern_ok, "state_ok": state_ok,
            "checksum_ok": pattern_ok & state_ok & checksum_ok}


def _class_at(p: str) -> str:
    """Character class each position of a valid GSTIN allows."""
    return (f"CASE WHEN {p} <= 2 THEN '^[0-9]$' WHEN {p} <= 7 THEN '^[A-Z]$' WHEN {p} <= 11 THEN '^[0-9]$' "
            f"WHEN {p} = 12 THEN '^[A-Z]$' WHEN {p} = 13 THEN '^[1-9A-Z]$' WHEN {p} = 14 THEN '^Z$' "
            f"ELSE '^[0-9A-Z]$' END")


def _confusion_map_sql() -> str:
    parts = []
    for k, alts in fixed.OCR_CONFUSIONS.items():
        parts.append(f"'{k}', {_lit_array([k] + alts)}")
    return "map(" + ", ".join(parts) + ")"


def with_repair(df: DataFrame, g: str, when: Column, checksum: str = "reference") -> DataFrame:
    """F6 as projections: ``corrected`` = the first look-alike variant of a
    (cleaned) 15-character id that validates, for rows where ``when`` holds.

    Order of trial = the application's: the first 8 confusable positions,
    options original-first, first position varying slowest. Options a
    position can never hold in a valid GSTIN are dropped first, and spellings
    without a valid state code after two characters; both keep the order of
    the others, and leave a handful of variants.
    """
    keys = _lit_array(fixed.OCR_CONFUSIONS.keys())
    states = ", ".join(f"'{k}'" for k in fixed.STATE_CODES)
    pos = F.expr(f"slice(filter(sequence(1, 15), i -> array_contains({keys}, substr({g}, i, 1))), 1, {fixed.OCR_MAX_POSITIONS})")
    # for every place of the id, what may stand there
    opts = F.expr(f"transform(sequence(1, 15), i -> CASE WHEN array_contains(_pos, i) THEN filter(element_at({_confusion_map_sql()}, "
                  f"substr({g}, i, 1)), ch -> ch rlike {_class_at('i')}) ELSE array(substr({g}, i, 1)) END)")
    longer = "flatten(transform(done, d -> transform(o, ch -> concat(d, ch))))"
    start = F.expr(f"filter(aggregate(slice(_opts, 1, 2), array(''), (done, o) -> {longer}), c -> c IN ({states}))")
    spelled = F.expr(f"aggregate(slice(_opts, 3, 13), _start, (done, o) -> {longer})")
    fine = (f"c rlike '{fixed.GSTIN_PATTERN}' AND substr(c, 15, 1) = "
            f"{chk_spark('substr(c, 1, 14)', fixed.CHECKSUM_FACTORS[checksum])}")
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a filter on the result is not pushed below, so each step is computed once
    x = df.withColumn("_pos", once(F.when(when & (F.length(g) == 15), pos)))
    x = x.withColumn("_opts", once(F.when(F.size("_pos") > 0, opts))).withColumn("_start", once(start))
    x = x.withColumn("_all", once(spelled)).withColumn("corrected", once(F.expr(f"get(filter(_all, c -> {fine}), 0)")))
    return x.drop("_pos", "_opts", "_start", "_all")


def corrections(g: str, corrected: str) -> Column:
    """The changed positions, in order, as the application words them."""
    was, now = f"substr({g}, i, 1)", f"substr({corrected}, i, 1)"
    return F.expr(f"filter(transform(sequence(1, 15), i -> CASE WHEN {was} <> {now} THEN "
                  f"concat('pos ', i, ': ''', {was}, '''->''', {now}, '''') END), x -> x IS NOT NULL)")


def repair(ids: DataFrame, g: str = "gstin", checksum: str = "reference", distinct: bool = True) -> DataFrame:
    """(gstin, corrected, corrections array) of the 15-character ids that
    have a valid look-alike variant; no shuffle beyond the distinct."""
    base = ids.select(F.col(g).alias("_g")).filter(F.length("_g") == 15)
    base = base.distinct() if distinct else base
    hit = with_repair(base, "_g", F.lit(True), checksum).filter("corrected IS NOT NULL")
    return hit.select(F.col("_g").alias(g), "corrected", corrections("_g", "corrected").alias("corrections"))
