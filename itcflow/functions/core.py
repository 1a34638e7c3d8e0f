"""Column -> Column helpers shared by the table operators.

All are built-in Spark expressions (no Python per row), so they stay inside
whole-stage code generation and Catalyst can see through them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

POLICIES = {
    # default: the filing/dashboard list
    "dashboard": fixed.BLOCKED_DASHBOARD,
    "insights": fixed.BLOCKED_INSIGHTS,
    "act_codes": fixed.BLOCKED_ACT_CODES,
    "classifier": fixed.BLOCKED_CLASSIFIER,
    "dataset": fixed.BLOCKED_DATASET,
}
POLICIES["unified"] = sorted(set().union(*POLICIES.values()))

MONEY = "decimal(18,2)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """'' counts as missing, like Python truthiness (`x or default`)."""
    c = col(c)
    return F.when(c == "", None).otherwise(c)


def or_default(c, default) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def blocked_list(policy: str) -> list[str]:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; one of {sorted(POLICIES)}")
    return POLICIES[policy]


def category(c="ai_category") -> Column:
    """Category as shown: NULL or '' -> 'General'."""
    return or_default(c, "General")


def is_blocked(cat: Column, policy: str = "dashboard") -> Column:
    """Section 17(5) blocked-credit predicate under a named policy (P5)."""
    return cat.isin(blocked_list(policy))


def amt(c) -> Column:
    """Money column, NULL -> 0."""
    return F.coalesce(col(c), F.lit(0).cast(MONEY))


def itc_total(cgst="cgst", sgst="sgst", igst="igst") -> Column:
    """ITC as the dashboard sums it: cgst + sgst + igst (F1)."""
    return amt(cgst) + amt(sgst) + amt(igst)


def itc_exclusive(cgst="cgst", sgst="sgst", igst="igst") -> Column:
    """ITC as saved to the ledger: igst when positive, else cgst + sgst (F1)."""
    return F.when(amt(igst) > 0, amt(igst)).otherwise(amt(cgst) + amt(sgst))


def to_double(c) -> Column:
    """Output edge: exact decimals become doubles for reports."""
    return col(c).cast("double")


def client_name(business_name="business_name", phone="phone") -> Column:
    """business_name -> phone -> 'Unknown', '' counting as missing."""
    return F.coalesce(blank_to_null(business_name), blank_to_null(phone), F.lit("Unknown"))


def score(itc: Column, n: Column) -> Column:
    """min(100, int(itc / 500 * 10 + n * 5)), truncating toward zero."""
    raw = itc.cast("double") / fixed.SCORE_ITC_UNIT * 10 + n * fixed.SCORE_PER_INVOICE
    # cap before the cast: same as min(100, int(x)), and no int overflow
    # (an ANSI error) for very large ITC
    return F.least(F.lit(float(fixed.SCORE_CAP)), raw).cast("int")


def compliance_status(itc: Column) -> Column:
    return (F.when(itc > fixed.COMPLIANT_ITC_ABOVE, "compliant")
             .when(itc > 0, "attention").otherwise("at-risk"))


def risk_band(s: Column) -> Column:
    """Score band, W5: <40 high, <70 medium, else low."""
    return (F.when(s < fixed.RISK_HIGH_BELOW, "high")
             .when(s < fixed.RISK_MEDIUM_BELOW, "medium").otherwise("low"))


def confidence_band(c: Column) -> Column:
    """>=0.85 high, >=0.65 medium, else low."""
    return (F.when(c >= fixed.CONF_HIGH, "high")
             .when(c >= fixed.CONF_MEDIUM, "medium").otherwise("low"))


def in_period(df, period: str, c: str = "date"):
    """Half-open month filter [start, next month) with the year roll.

    A bad period raises like the reference's 400 reply. On a table written by
    ``Model.materialize`` the month partition column prunes files as well.
    """
    y, m = period.split("-")
    y, m = int(y), int(m)
    if not 1 <= m <= 12:
        raise ValueError("Invalid period format. Use YYYY-MM")
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    start = F.to_timestamp_ntz(F.lit(f"{y:04d}-{m:02d}-01"))
    end = F.to_timestamp_ntz(F.lit(f"{ny:04d}-{nm:02d}-01"))
    cond = (F.col(c) >= start) & (F.col(c) < end)
    if c == "date" and "date_month" in df.columns:
        cond = cond & (F.col("date_month") == f"{y:04d}-{m:02d}")
    return df.filter(cond)


def since_month_start(df, as_of: str, c: str = "date"):
    """Open-ended month-to-date filter: date >= first of as_of's month."""
    return df.filter(F.col(c) >= F.to_timestamp_ntz(F.lit(as_of[:7] + "-01")))


def ym(c) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def fmt_ts(c) -> Column:
    """Python's str(datetime) for whole seconds: 'yyyy-MM-dd HH:mm:ss'."""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss")

def inr_text(x) -> Column:
    """'₹' + amount in Indian digit grouping with up to 2 decimals and no
    trailing zeros (1,23,456.5), as the dashboard renders amounts; for
    non-negative amounts with at most 2 decimals."""
    x = col(x).cast("decimal(20,2)")
    ip = F.floor(x).cast("long").cast("string")
    cents = ((x - F.floor(x)) * 100).cast("int").cast("string")
    fr = F.regexp_replace(F.lpad(cents, 2, "0"), "0+$", "")
    n = F.length(ip)
    head, tail = ip.substr(F.lit(1), n - 3), ip.substr(n - 2, F.lit(3))
    # digits before the last three are grouped in pairs from the right
    pairs = F.regexp_replace(F.reverse(F.regexp_replace(F.reverse(head), r"(\d\d)", "$1,")), "^,", "")
    whole = F.when(n <= 3, ip).otherwise(F.concat(pairs, F.lit(","), tail))
    return F.concat(F.lit("₹"), whole, F.when(fr == "", F.lit("")).otherwise(F.concat(F.lit("."), fr)))
