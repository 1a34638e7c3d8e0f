"""Window, ranking, anomaly, top-k and set operators.

Shapes that look like windows are written as aggregates + joins where
possible (duplicate marking, per-client means, latest rows): aggregates
combine map-side, so a hot key does not become one task. Top-k per group
uses ``row_number() <= k``, which Spark plans as a partial
``WindowGroupLimit`` before the shuffle. Running totals use the distributed
prefix sum in ``skew.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions import fixed
from ..sources.tables import staged
from .skew import prefix_sum

D = C.to_double


def invoice_anomalies(v: DataFrame, k: float = fixed.ANOMALY_FACTOR, hi: float = fixed.ANOMALY_HIGH_FACTOR,
                      n: int | None = fixed.ANOMALY_SHOWN, by: str = "ca_id") -> DataFrame:
    """W1 (by='ca_id', first n in feed order) / W2 (by='user_id', all rows):
    invoices whose total exceeds k x the mean total of their group.

    The group mean is an aggregate joined back on the group key (one row per
    group), not a window over the whole feed. The feed's joins run once, for both.
    """
    v = staged(v.select(*dict.fromkeys([by, "id", "user_id", "client_name", "total"])), "feed")
    means = v.groupBy(by).agg(F.sum("total").alias("_s"), F.count(F.lit(1)).alias("_n"))
    means = means.select(by, (F.col("_s").cast("double") / F.col("_n")).alias("avg_total"))
    j = v.join(means, by)  # broadcast only if Spark measures it small at run time
    tot = F.col("total").cast("double")
    hit = j.filter(tot > F.col("avg_total") * k)
    out = hit.select(*dict.fromkeys([by, "id", "user_id", "client_name"]), D("total").alias("total"), "avg_total",
                     C.inr_text("total").alias("invoice"),
                     F.format_string("%.1f", tot / F.col("avg_total")).alias("ratio"),
                     F.format_string("%.1fx higher than average invoice value", tot / F.col("avg_total")).alias("detail"),
                     F.when(tot > F.col("avg_total") * hi, "high").otherwise("medium").alias("severity"))
    if n is not None:
        w = Window.partitionBy(by).orderBy(F.col("id").desc())
        out = out.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")
    return out


def mark_duplicates(inv: DataFrame) -> DataFrame:
    """Batch duplicate marking, the earliest (smallest id) invoice kept.

    With a supplier GSTIN the key is (user, invoice_no, gstin); without one,
    (user, invoice_no) against any GSTIN. Blank invoice numbers never match.
    One min-aggregate per key carries the incumbent's id, date and tax total, so
    nothing is looked up by the incumbent afterwards; rows without a number
    take no part in a join.
    """
    base = inv.select("id", "user_id", F.trim(F.coalesce("invoice_no", F.lit(""))).alias("no"),
                      F.trim(F.coalesce("seller_gstin", F.lit(""))).alias("g"), incumbent().alias("row"))
    found = with_incumbent(base, base, "inner")
    dup = F.col("first.id") < F.col("id")
    marked = found.select("id", "user_id", dup.alias("is_duplicate"),
                          *[F.when(dup, F.col("first." + c)).alias(n) for c, n in
                            (("id", "dup_of"), ("on", "existing_date"), ("total", "existing_total"))])
    blank = base.filter(F.col("no") == "").select(
        "id", "user_id", F.lit(False).alias("is_duplicate"), F.lit(None).cast("long").alias("dup_of"),
        F.lit(None).cast("string").alias("existing_date"), F.lit(None).cast("double").alias("existing_total"))
    return marked.unionByName(blank)


def incumbent():
    """What a duplicate message says of the stored invoice; ordered by its id."""
    return F.struct(F.col("id").cast("long").alias("id"),
                    F.coalesce(F.date_format("date", "dd-MM-yyyy"), F.lit("unknown date")).alias("on"),
                    D(F.round(C.itc_total(), 2)).alias("total"))


def with_incumbent(asked: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``asked`` rows with a number (``user_id, no, g``) and ``first`` of ``rows`` (the same
    and ``row``): the smallest ``row`` per (user, number, GSTIN), for a blank GSTIN the
    smallest per (user, number) whatever the GSTIN. Either join meets its aggregate
    where that was grouped, so no aggregate is shuffled a second time."""
    asked, rows = asked.filter(F.col("no") != ""), rows.filter(F.col("no") != "")
    by_gstin = rows.groupBy("user_id", "no", "g").agg(F.min("row").alias("first"))
    by_number = rows.groupBy("user_id", "no").agg(F.min("row").alias("first"))
    return asked.filter(F.col("g") != "").join(by_gstin, ["user_id", "no", "g"], how).unionByName(
        asked.filter(F.col("g") == "").join(by_number, ["user_id", "no"], how))


def running_itc(inv: DataFrame) -> DataFrame:
    """Ledger ITC of the save month after each save, in save order
    (created_at, id): a running sum per (user, month) done as a
    skew-safe distributed prefix sum."""
    src = inv.select("id", "user_id", C.ym("created_at").alias("period"), "created_at",
                     C.itc_exclusive().alias("itc_this"))
    r = prefix_sum(src, ["user_id", "period"], ["created_at", "id"], "itc_this", "itc_total")
    return r.select("id", "user_id", "period", D("itc_this").alias("itc_this"), D("itc_total").alias("itc_total"))


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """First k rows per group in ``order`` (WindowGroupLimit: partial top-k
    runs before the shuffle, so a hot group ships only k rows per task)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recent(v: DataFrame, n: int = fixed.RECENT_SHOWN) -> DataFrame:
    """Newest n invoices of each CA's feed (id descending)."""
    return top_per_group(v, "ca_id", [F.col("id").desc()], n)


def activity(v: DataFrame, n: int = fixed.RECENT_SHOWN) -> DataFrame:
    """Recent invoices as activity lines: action text and severity by status."""
    r = recent(v, n)
    st = F.col("status")
    return r.select("ca_id", "rank", "id", F.col("client_name").alias("client"),
                    F.when(st == "confirmed", "Invoice confirmed").when(st == "pending", "Awaiting review")
                     .otherwise("Invoice rejected").alias("action"),
                    D("total").alias("amount"), C.inr_text("total").alias("amount_text"),
                    F.coalesce(F.substring(C.fmt_ts("date"), 1, 10), F.lit("")).alias("time"),
                    F.when(st == "confirmed", "success").when(st == "pending", "warning").otherwise("danger")
                     .alias("status"))


def top_clients(clients: DataFrame, n: int = fixed.TOP_CLIENTS_SHOWN) -> DataFrame:
    """T4: top n clients of each CA by ITC this month (ties: smaller id first)."""
    return top_per_group(clients, "ca_id", [F.col("itc_this_month").desc(), F.col("id")], n)


def suppliers_head(v: DataFrame, n: int = fixed.SUPPLIERS_SHOWN) -> DataFrame:
    """T5: the first n suppliers in first-seen feed order (feed = id desc, so a
    supplier is first seen at its largest invoice id)."""
    g = C.or_default("supplier_gstin", "Unknown")
    s = v.groupBy("ca_id", g.alias("gstin")).agg(F.max("id").alias("first_seen"),
                                                 F.count(F.lit(1)).alias("times"))
    return top_per_group(s, "ca_id", [F.col("first_seen").desc()], n)


def client_alerts(usr: DataFrame, inv: DataFrame, as_of: str, policy: str = "reference",
                  ca_id: int | None = None) -> DataFrame:
    """U1: 'No Invoices' (0) and 'Low Invoice Count' (1-2) alerts per client.

    ``reference`` counts all invoices and uses the fixed due days (11, 16);
    ``calendar`` counts the invoices dated in as_of's month and computes the
    days left to the 20th / 25th.
    """
    from . import invoices as I
    u = I.tenant_users(usr, ca_id)
    src = inv.select("user_id", "date")
    if policy == "calendar":
        src = C.in_period(src, as_of[:7])
    n = src.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("user_id", "id")
    x = u.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    x = x.filter(F.col("n") < 3)
    period = as_of[:7]
    kind0, msg0, pri0, day0, left0 = fixed.ALERT_NO_INVOICES
    kind1, pri1, day1, left1 = fixed.ALERT_LOW_COUNT
    zero = F.col("n") == 0
    due = F.when(zero, F.lit(f"{period}-{day0}")).otherwise(F.lit(f"{period}-{day1}"))
    if policy == "calendar":
        days = F.datediff(F.to_date(due), F.to_date(F.lit(as_of[:10])))
    else:
        days = F.when(zero, F.lit(left0)).otherwise(F.lit(left1))
    return x.select(
        "ca_id",
        F.when(zero, F.concat(F.lit("alert-"), F.col("id").cast("string")))
         .otherwise(F.concat(F.lit("alert-low-"), F.col("id").cast("string"))).alias("id"),
        F.col("id").alias("user_id"),
        C.client_name().alias("client_name"),
        F.when(zero, F.lit(kind0)).otherwise(F.lit(kind1)).alias("type"),
        F.when(zero, F.lit(msg0)).otherwise(F.format_string("Only %d invoice(s) uploaded. More expected.", "n"))
         .alias("message"),
        F.when(zero, F.lit(pri0)).otherwise(F.lit(pri1)).alias("priority"),
        due.alias("due_date"), days.cast("int").alias("days_remaining"), F.lit(False).alias("resolved"))


def filter_alerts(alerts: DataFrame, resolved: DataFrame, tab: str = "all") -> DataFrame:
    """Alert tab: 'all' = active, 'resolved', or a priority among active.
    Resolved ids come as a table (semi / anti join), never as a driver list."""
    r = resolved.select(F.col("alert_id").alias("id")).distinct()
    res = alerts.join(r, "id", "left_semi").unionByName(alerts.filter(F.col("resolved")))
    active = alerts.join(r, "id", "left_anti").filter(~F.col("resolved"))
    if tab == "resolved":
        return res.distinct()
    if tab == "all":
        return active
    return active.filter(F.col("priority") == tab)
