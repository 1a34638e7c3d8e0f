"""Filing calendar, deadlines and urgency."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def _next_month(y: int, m: int) -> tuple[int, int]:
    return (y + 1, 1) if m == 12 else (y, m + 1)


def deadlines(period: str, as_of: str) -> dict:
    """Deadlines of one period and days left from ``as_of`` (parameters, not data)."""
    y, m = map(int, period.split("-"))
    ny, nm = _next_month(y, m)
    g1 = _dt.date(ny, nm, fixed.GSTR1_DAY)
    g3 = _dt.date(ny, nm, fixed.GSTR3B_DAY)
    today = _dt.date.fromisoformat(as_of[:10])
    return {"period": period, "gstr1_deadline": str(g1), "gstr3b_deadline": str(g3),
            "days_to_gstr1": (g1 - today).days, "days_to_gstr3b": (g3 - today).days}


def deadline_cols(period: Column, as_of: str) -> list[Column]:
    """F3 as column expressions over a 'YYYY-MM' period column."""
    start = F.to_date(F.concat(period, F.lit("-01")))
    nxt = F.add_months(start, 1)
    g1 = F.make_date(F.year(nxt), F.month(nxt), F.lit(fixed.GSTR1_DAY))
    g3 = F.make_date(F.year(nxt), F.month(nxt), F.lit(fixed.GSTR3B_DAY))
    today = F.to_date(F.lit(as_of[:10]))
    return [g1.cast("string").alias("gstr1_deadline"), g3.cast("string").alias("gstr3b_deadline"),
            F.datediff(g1, today).alias("days_to_gstr1"), F.datediff(g3, today).alias("days_to_gstr3b")]


def filing_calendar(periods: DataFrame, as_of: str, col: str = "period") -> DataFrame:
    """deadlines of every period in ``periods`` (e.g. the months that have
    invoices), days left from ``as_of``."""
    return periods.select(F.col(col).alias("period"), *deadline_cols(F.col(col), as_of))


def period_range(spark, first: str, last: str) -> DataFrame:
    """Months first..last as rows (sequence + explode)."""
    s = F.to_date(F.lit(first + "-01"))
    e = F.to_date(F.lit(last + "-01"))
    return (spark.range(1).select(F.explode(F.sequence(s, e, F.expr("interval 1 month"))).alias("d"))
                 .select(F.date_format("d", "yyyy-MM").alias("period")))


def alert_due(days: Column) -> Column:
    """a reminder goes out when the days left are one of 7, 3, 1."""
    return days.isin(fixed.ALERT_LEAD_DAYS)


def alert_level(days: Column) -> Column:
    """1 day urgent, 3 days warning, otherwise notice."""
    return F.when(days == 1, "urgent").when(days == 3, "warning").otherwise("notice")


def chat_urgency(days: Column) -> Column:
    """chat traffic light: <=3 red, <=7 yellow, else green."""
    return F.when(days <= 3, "red").when(days <= 7, "yellow").otherwise("green")
