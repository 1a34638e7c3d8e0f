"""Reports and aggregations.

Conventions: money is summed as DECIMAL (exact, order independent) and cast
to DOUBLE only at the output edge; every tenant report is computed for all
CAs at once, keyed by ``ca_id``; multi-measure reports are one pass with
conditional aggregates (``count_if``, ``sum(when ...)``), never one scan per
measure. All groupBy's run a partial (map-side) aggregate before the shuffle,
so a hot key costs one partial row per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions import fixed
from . import invoices as I

D = C.to_double


def build_ledger(inv: DataFrame, basis: str = "saved", policy: str = "dashboard") -> DataFrame:
    """Purchases and ITC per (user, period).

    ``saved`` reproduces the application: every saved invoice, whatever its
    status or category, counted in the month it was saved, ITC = igst if
    positive else cgst+sgst. ``filed``: confirmed, non-blocked invoices in the
    month of the invoice date.
    """
    if basis == "saved":
        src = inv.select("user_id", C.ym("created_at").alias("period"), "taxable_amt",
                         C.itc_exclusive().alias("itc"))
    elif basis == "filed":
        src = (inv.filter((F.col("status") == "confirmed") & F.col("date").isNotNull()
                          & ~C.is_blocked(C.category("ai_category"), policy))
                  .select("user_id", C.ym("date").alias("period"), "taxable_amt",
                          C.itc_exclusive().alias("itc")))
    else:
        raise ValueError(basis)
    return (src.groupBy("user_id", "period")
               .agg(F.sum(C.amt("taxable_amt")).alias("total_purchases"),
                    F.sum("itc").alias("itc_available")))


def gstr3b_totals(inv: DataFrame, policy: str = "dashboard", period: str | None = None,
                  by_user: bool = True) -> DataFrame:
    """A6 (flagship): GSTR-3B eligible/blocked split per (user, period).

    Confirmed invoices only; the month is the invoice date's; NULL dates drop
    out (they never fall in a half-open month). One conditional-sum pass.
    """
    src = inv.filter(F.col("status") == "confirmed")
    if period is not None:
        src = C.in_period(src, period)
    else:
        src = src.filter(F.col("date").isNotNull())
    blocked = C.is_blocked(C.category("ai_category"), policy)
    zero = F.lit(0).cast(C.MONEY)
    keys = (["user_id"] if by_user else []) + [C.ym("date").alias("period")]
    g = src.groupBy(*keys).agg(
        F.sum(F.when(blocked, zero).otherwise(C.amt("cgst"))).alias("el_cgst"),
        F.sum(F.when(blocked, zero).otherwise(C.amt("sgst"))).alias("el_sgst"),
        F.sum(F.when(blocked, zero).otherwise(C.amt("igst"))).alias("el_igst"),
        F.sum(F.when(blocked, C.amt("cgst")).otherwise(zero)).alias("bl_cgst"),
        F.sum(F.when(blocked, C.amt("sgst")).otherwise(zero)).alias("bl_sgst"),
        F.sum(F.when(blocked, C.amt("igst")).otherwise(zero)).alias("bl_igst"),
        F.sum(C.amt("taxable_amt")).alias("total_taxable"),
        F.count(F.lit(1)).alias("total_invoices"),
    )
    return g.select(
        *(["user_id"] if by_user else []), "period",
        *[D(c).alias(c) for c in ["el_cgst", "el_sgst", "el_igst", "bl_cgst", "bl_sgst", "bl_igst",
                                  "total_taxable"]],
        D(F.col("el_cgst") + F.col("el_sgst")).alias("intra"),
        D(F.col("el_cgst") + F.col("el_sgst") + F.col("el_igst")).alias("eligible_itc"),
        D(F.col("bl_cgst") + F.col("bl_sgst") + F.col("bl_igst")).alias("blocked_itc"),
        "total_invoices",
    )


def gstr3b_global(inv: DataFrame, period: str | None = None, policy: str = "dashboard") -> DataFrame:
    """The un-tenanted GSTR-3B: the same split summed over all clients."""
    return gstr3b_totals(inv, policy, period, by_user=False)


def _tenant_users(usr, ca_id):
    return I.tenant_users(usr, ca_id)


def dashboard_stats(inv: DataFrame, usr: DataFrame, led: DataFrame, period: str,
                    ca_id: int | None = None) -> DataFrame:
    """A1: per CA: the period's ledger ITC, invoice count, pending count, clients."""
    u = _tenant_users(usr, ca_id).select(F.col("id").alias("user_id"), "ca_id")
    clients = u.groupBy("ca_id").agg(F.count(F.lit(1)).alias("total_clients"))
    invs = (inv.select("user_id", "status").join(u, "user_id")
               .groupBy("ca_id").agg(F.count(F.lit(1)).alias("total_invoices"),
                                     F.count_if(F.col("status") == "pending").alias("pending_invoices")))
    itc = (led.filter(F.col("period") == period).select("user_id", "itc_available").join(u, "user_id")
              .groupBy("ca_id").agg(F.sum("itc_available").alias("total_itc")))
    return (clients.join(invs, "ca_id", "left").join(itc, "ca_id", "left")
                   .select("ca_id",
                           D(F.round(C.amt("total_itc"), 2)).alias("total_itc"),
                           F.coalesce("total_invoices", F.lit(0).cast("long")).alias("total_invoices"),
                           F.coalesce("pending_invoices", F.lit(0).cast("long")).alias("pending_invoices"),
                           "total_clients", F.lit(period).alias("period")))


def admin_stats(inv: DataFrame, usr: DataFrame, led: DataFrame, ca_id: int | None = None) -> DataFrame:
    """A2: per CA: users, invoices, all-time ledger ITC, confirmed, pending, MRR."""
    u = _tenant_users(usr, ca_id).select(F.col("id").alias("user_id"), "ca_id")
    users = u.groupBy("ca_id").agg(F.count(F.lit(1)).alias("total_users"))
    invs = (inv.select("user_id", "status").join(u, "user_id").groupBy("ca_id")
               .agg(F.count(F.lit(1)).alias("total_invoices"),
                    F.count_if(F.col("status") == "confirmed").alias("confirmed_invoices"),
                    F.count_if(F.col("status") == "pending").alias("pending_invoices")))
    itc = (led.select("user_id", "itc_available").join(u, "user_id").groupBy("ca_id")
              .agg(F.sum("itc_available").alias("total_itc")))
    z = F.lit(0).cast("long")
    return (users.join(invs, "ca_id", "left").join(itc, "ca_id", "left")
                 .select("ca_id", "total_users",
                         F.coalesce("total_invoices", z).alias("total_invoices"),
                         D(F.round(C.amt("total_itc"), 2)).alias("total_itc"),
                         F.coalesce("confirmed_invoices", z).alias("confirmed_invoices"),
                         F.coalesce("pending_invoices", z).alias("pending_invoices"),
                         (F.col("total_users") * fixed.PRICE_PER_CLIENT).alias("mrr")))


def admin_users(inv: DataFrame, usr: DataFrame, ca_id: int | None = None) -> DataFrame:
    """A3 + T8: the CA's users newest id first, with all-time invoice counts."""
    u = _tenant_users(usr, ca_id)
    return (I.with_invoice_count(u, inv)
             .select("ca_id", "id", C.or_default("business_name", "Unknown").alias("name"),
                     F.coalesce("phone", F.lit("")).alias("phone"),
                     F.coalesce("gstin", F.lit("")).alias("gstin"),
                     F.coalesce("state_code", F.lit("")).alias("state"),
                     "invoice_count",
                     (F.substring(C.fmt_ts("created_at"), 1, 10) if "created_at" in usr.columns
                      else F.lit(None).cast("string")).alias("_joined"))
             .withColumn("joined_at", F.coalesce("_joined", F.lit(""))).drop("_joined")
             .orderBy(F.col("id").desc()))


def client_summary(usr: DataFrame, inv: DataFrame, led: DataFrame, period: str,
                   ca_id: int | None = None, all_users: bool = False) -> DataFrame:
    """A4 (+F21, W5): per client: the period's ledger ITC, all-time invoice
    count, compliance status, score and band."""
    u = usr if all_users else _tenant_users(usr, ca_id)
    x = I.with_invoice_count(I.with_ledger(u, led, period), inv)
    itc = F.col("itc_available")
    sc = C.score(itc, F.col("invoice_count"))
    return x.select(
        "ca_id", "id", C.client_name().alias("name"),
        F.coalesce(C.blank_to_null("gstin"), F.lit("")).alias("gstin"),
        F.coalesce(C.blank_to_null("state_code"), F.lit("")).alias("state"),
        F.coalesce(C.blank_to_null("phone"), F.lit("")).alias("whatsapp"),
        D(itc).alias("itc_this_month"),
        "invoice_count",
        C.compliance_status(itc).alias("compliance_status"),
        sc.alias("risk_score"),
        C.risk_band(sc).alias("risk"),
    )


def gst_liability(txns: DataFrame) -> DataFrame:
    """A5: per (user, month): output tax of sales minus input tax of eligible
    purchases, floored at 0. rate/100 is taken as an exact decimal factor."""
    pct = F.lit("0.01").cast("decimal(3,2)")
    tax = C.amt("amount") * F.col("gst_rate") * pct
    g = (txns.groupBy("user_id", C.ym("date").alias("period"))
             .agg(F.sum(F.when(F.col("type") == "sale", tax)).alias("c"),
                  F.sum(F.when((F.col("type") == "purchase") & F.coalesce("itc_eligible", F.lit(False)), tax))
                   .alias("i")))
    zero = F.lit(0).cast("decimal(38,4)")
    c = F.coalesce("c", zero)
    i = F.coalesce("i", zero)
    return g.select("user_id", "period",
                    D(F.round(c, 2)).alias("total_gst_collected"),
                    D(F.round(i, 2)).alias("total_itc_available"),
                    D(F.round(F.greatest(zero, c - i), 2)).alias("net_liability"))


def itc_balance(usr: DataFrame, led: DataFrame, inv: DataFrame, period: str) -> DataFrame:
    """A10: per user: the period's ledger ITC (rounded) and all-time invoice count."""
    x = I.with_invoice_count(I.with_ledger(usr.select("id"), led, period), inv)
    return x.select(F.col("id").alias("user_id"), D(F.round("itc_available", 2)).alias("itc_total"),
                    F.lit(period).alias("period"), "invoice_count")


def monthly_report(inv: DataFrame, led: DataFrame, usr: DataFrame, as_of: str) -> DataFrame:
    """The chat monthly report per user.

    Invoices dated on/after the first of ``as_of``'s month (no upper bound,
    as in the application); ITC from the ledger of that month; 'blocked'
    status count; the deadline columns of F3 for that month.
    """
    from ..functions.calendar import deadlines
    period = as_of[:7]
    mtd = C.since_month_start(inv.select("user_id", "date", "taxable_amt", "status"), as_of)
    agg = mtd.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_invoices"),
                                     F.sum(C.amt("taxable_amt")).alias("total_purchases"),
                                     F.count_if(F.col("status") == "blocked").alias("blocked_count"))
    u = usr.select(F.col("id").alias("user_id"))
    lp = led.filter(F.col("period") == period).select("user_id", "itc_available")
    dl = deadlines(period, as_of)
    x = u.join(agg, "user_id", "left").join(lp, "user_id", "left")
    d3 = F.lit(dl["days_to_gstr3b"])
    return x.select(
        "user_id",
        F.coalesce("total_invoices", F.lit(0).cast("long")).alias("total_invoices"),
        D(C.amt("total_purchases")).alias("total_purchases"),
        D(F.round(C.amt("itc_available"), 2)).alias("total_itc"),
        F.coalesce("blocked_count", F.lit(0).cast("long")).alias("blocked_count"),
        F.lit(dl["gstr1_deadline"]).alias("gstr1_deadline"),
        F.lit(dl["gstr3b_deadline"]).alias("gstr3b_deadline"),
        F.lit(dl["days_to_gstr1"]).alias("days_to_gstr1"),
        d3.alias("days_to_gstr3b"),
        F.when(d3 <= 3, "red").when(d3 <= 7, "yellow").otherwise("green").alias("urgency"),
    )


def itc_trend(v: DataFrame, months: int = fixed.TREND_MONTHS) -> DataFrame:
    """A13 + T7: per CA, ITC by invoice month, the last ``months`` months that
    have data, month shown as 'MM', ITC rounded half up (Math.round)."""
    g = (v.filter(F.col("date").isNotNull())
          .groupBy("ca_id", C.ym("date").alias("month")).agg(F.sum("itc").alias("itc")))
    w = Window.partitionBy("ca_id").orderBy(F.col("month").desc())
    return (g.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= months)
             .select("ca_id", "month", F.substring("month", 6, 2).alias("month_label"),
                     F.floor(F.col("itc") + F.lit(0.5)).cast("long").alias("itc")))


def category_breakdown(v: DataFrame) -> DataFrame:
    """Per CA and category: invoice count and ITC, highest ITC first."""
    return (v.groupBy("ca_id", "ai_category")
             .agg(F.count(F.lit(1)).alias("count"), F.sum("itc").alias("itc"))
             .select("ca_id", "ai_category", "count", D("itc").alias("itc"))
             .orderBy("ca_id", F.col("itc").desc()))


def avg_confidence(v: DataFrame) -> DataFrame:
    """Per CA: mean AI confidence in percent, rounded half up; 0 if none."""
    conf = F.col("ai_confidence").cast("decimal(5,2)")
    g = v.groupBy("ca_id").agg(F.sum(conf).alias("s"), F.count(F.lit(1)).alias("n"))
    pct = F.col("s").cast("double") * 100 / F.col("n")
    return g.select("ca_id", F.floor(pct + F.lit(0.5)).cast("long").alias("avg_conf_pct"))


def compliance_distribution(clients: DataFrame) -> DataFrame:
    """Per CA: clients per compliance status (non-zero only) and the
    legacy share in whole percent, rounded half up (count / all clients)."""
    g = clients.groupBy("ca_id", "compliance_status").agg(F.count(F.lit(1)).alias("value"))
    tot = F.sum("value").over(Window.partitionBy("ca_id"))
    return g.select("ca_id", "compliance_status", "value",
                    F.floor(F.col("value").cast("double") * 100 / tot + 0.5).cast("long").alias("share_pct"))


def category_distribution(v: DataFrame) -> DataFrame:
    """Per CA: invoice count per category."""
    return v.groupBy("ca_id", "ai_category").agg(F.count(F.lit(1)).alias("value"))


def itc_by_state(clients: DataFrame) -> DataFrame:
    """Per CA: clients' ITC this month by state code, '' -> 'Unknown'."""
    st = C.or_default("state", "Unknown")
    return (clients.groupBy("ca_id", st.alias("state"))
                   .agg(F.sum(F.col("itc_this_month").cast(C.MONEY)).alias("itc"))
                   .select("ca_id", "state", D("itc").alias("itc")))


def portfolio_kpis(clients: DataFrame) -> DataFrame:
    """Per CA: total ITC this month, mean score and mean ITC (rounded half up)."""
    itc = F.col("itc_this_month").cast(C.MONEY)
    g = clients.groupBy("ca_id").agg(F.sum(itc).alias("t"), F.sum("risk_score").alias("s"),
                                     F.count(F.lit(1)).alias("n"))
    return g.select("ca_id", D("t").alias("total_itc"),
                    F.floor(F.col("s") / F.col("n") + F.lit(0.5)).cast("long").alias("avg_risk"),
                    F.floor(F.col("t").cast("double") / F.col("n") + F.lit(0.5)).cast("long").alias("avg_itc"))


def itc_leakage(v: DataFrame, policy: str = "insights") -> DataFrame:
    """Blocked ITC per CA in total, by category and by client name, in one
    pass (GROUPING SETS); ``level`` tells which set a row belongs to."""
    b = v.filter(C.is_blocked(F.col("ai_category"), policy))
    g = v.sparkSession.sql("""
        SELECT ca_id, ai_category, client_name, grouping(ai_category) * 2 + grouping(client_name) AS gid,
               sum(itc) AS amount
        FROM {src}
        GROUP BY ca_id, GROUPING SETS ((), (ai_category), (client_name))
    """, src=b)
    return g.select(
        "ca_id",
        F.when(F.col("gid") == 3, "total").when(F.col("gid") == 1, "category").otherwise("client").alias("level"),
        F.when(F.col("gid") == 1, F.col("ai_category")).when(F.col("gid") == 2, F.col("client_name"))
         .otherwise(F.lit("")).alias("key"),
        D("amount").alias("amount"))


def supplier_risk(v: DataFrame) -> DataFrame:
    """A21 + F7: per CA and supplier GSTIN ('' -> 'Unknown'): uses, ITC, state
    prefix ('?' when shorter than 2), validity = length 15."""
    g = C.or_default("supplier_gstin", "Unknown")
    s = (v.groupBy("ca_id", g.alias("gstin"))
          .agg(F.count(F.lit(1)).alias("times"), F.sum("itc").alias("total_itc")))
    return s.select("ca_id", "gstin", "times", D("total_itc").alias("total_itc"),
                    F.when(F.length("gstin") >= 2, F.substring("gstin", 1, 2)).otherwise(F.lit("?")).alias("state"),
                    (F.length("gstin") == 15).alias("valid"))


def supplier_risk_summary(v: DataFrame) -> DataFrame:
    """Per CA: number of invalid supplier ids and the ITC riding on them."""
    s = supplier_risk(v)
    return (s.groupBy("ca_id")
             .agg(F.count_if(~F.col("valid")).alias("invalid_count"),
                  F.sum(F.when(~F.col("valid"), F.col("total_itc").cast(C.MONEY))
                        .otherwise(F.lit(0).cast(C.MONEY))).alias("risk_itc"),
                  F.count(F.lit(1)).alias("suppliers"))
             .select("ca_id", "suppliers", "invalid_count", D("risk_itc").alias("risk_itc")))


def status_counts(v: DataFrame) -> DataFrame:
    """Per CA: total ITC and invoices per status, one pass."""
    return (v.groupBy("ca_id")
             .agg(F.sum("itc").alias("total_itc"), F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col("status") == "confirmed").alias("confirmed"),
                  F.count_if(F.col("status") == "pending").alias("pending"),
                  F.count_if(F.col("status") == "rejected").alias("rejected"))
             .select("ca_id", D("total_itc").alias("total_itc"), "total", "confirmed", "pending", "rejected"))


def tax_heads(v: DataFrame) -> DataFrame:
    """Per client: CGST/SGST/IGST totals as rows, non-zero heads only."""
    g = v.groupBy("user_id").agg(F.sum("cgst").alias("CGST"), F.sum("sgst").alias("SGST"),
                                 F.sum("igst").alias("IGST"))
    u = g.unpivot("user_id", ["CGST", "SGST", "IGST"], "name", "value")
    return u.filter(F.col("value") > 0).select("user_id", "name", D("value").alias("value"))


def revenue(usr: DataFrame, ca_id: int | None = None) -> DataFrame:
    """Per CA: clients x 299 + 999."""
    u = _tenant_users(usr, ca_id)
    return (u.groupBy("ca_id").agg(F.count(F.lit(1)).alias("clients"))
             .select("ca_id", "clients", (F.col("clients") * fixed.PRICE_PER_CLIENT).alias("mrr_consumer"),
                     F.lit(fixed.PLATFORM_FEE).alias("mrr_ca"),
                     (F.col("clients") * fixed.PRICE_PER_CLIENT + fixed.PLATFORM_FEE).alias("total_mrr")))


def alert_counts(alerts: DataFrame, resolved: DataFrame) -> DataFrame:
    """A25 (+P12): per CA: active high / medium alerts and resolved alerts.
    ``resolved`` holds alert ids marked resolved (joined, not collected)."""
    r = resolved.select("alert_id").distinct().withColumn("_res", F.lit(True))
    a = alerts.join(r, alerts["id"] == r["alert_id"], "left")
    res = F.coalesce("_res", F.lit(False)) | F.col("resolved")
    return (a.groupBy("ca_id")
             .agg(F.count_if(~res & (F.col("priority") == "high")).alias("high"),
                  F.count_if(~res & (F.col("priority") == "medium")).alias("medium"),
                  F.count_if(~res & (F.col("priority") == "low")).alias("low"),
                  F.count_if(~res).alias("active"),
                  F.count_if(res).alias("resolved")))


def legacy_totals(clients: DataFrame) -> DataFrame:
    """Per CA: ITC, invoices and clients of the portfolio, ITC per
    client, compliant ('green') and at-risk ('red') client counts."""
    itc = F.col("itc_this_month").cast(C.MONEY)
    g = clients.groupBy("ca_id").agg(F.sum(itc).alias("itc"), F.sum("invoice_count").alias("invoices"),
                                     F.count(F.lit(1)).alias("clients"),
                                     F.count_if(F.col("compliance_status") == "compliant").alias("green"),
                                     F.count_if(F.col("compliance_status") == "at-risk").alias("high_risk"))
    return g.select("ca_id", D("itc").alias("total_itc"), "invoices", "clients",
                    D(F.round(F.col("itc") / F.col("clients"), 2)).alias("itc_per_client"), "green", "high_risk")


def legacy_client_totals(v: DataFrame, usr: DataFrame) -> DataFrame:
    """Per client of the feed: total ITC, invoices, total spend
    (invoice totals) and turnover year to date."""
    g = v.groupBy("user_id").agg(F.sum("itc").alias("itc"), F.count(F.lit(1)).alias("invoices"),
                                 F.sum("total").alias("spend"))
    u = usr.select(F.col("id").alias("user_id"), "turnover_ytd")
    return g.join(u, "user_id", "left").select(
        "user_id", D("itc").alias("total_itc"), "invoices", D("spend").alias("total_spend"),
        D(F.coalesce("turnover_ytd", F.lit(0).cast(C.MONEY))).alias("turnover_ytd"))


def ocr_quality(parsed: DataFrame) -> DataFrame:
    """Per day of receipt: replies, parse errors, filled fields, mean
    confidence over filled fields, replies needing confirmation (< 0.85)."""
    conf = F.when(F.col("filled_count") > 0, F.lit(fixed.OCR_FIELD_CONFIDENCE)).otherwise(F.lit(0.0))
    needs = F.coalesce(conf < fixed.NEEDS_CONFIRMATION_BELOW, F.lit(True))
    return (parsed.groupBy(F.to_date("created_at").cast("string").alias("day"))
                  .agg(F.count(F.lit(1)).alias("replies"),
                       F.count_if(F.col("parse_error")).alias("parse_errors"),
                       F.sum(F.when(~F.col("parse_error"), F.col("filled_count")).otherwise(0)).alias("filled_fields"),
                       F.count_if(~F.col("parse_error") & needs).alias("needs_confirmation"),
                       F.count_if(~F.col("parse_error") & (conf >= fixed.NEEDS_CONFIRMATION_BELOW)).alias("confident"),
                       F.avg(F.when(~F.col("parse_error"), conf)).alias("mean_confidence")))


def model_agreement(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per accepted label: predictions, correct ones, accuracy."""
    j = pred.join(truth, "doc_id")
    return (j.groupBy("label")
             .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("label")).alias("correct"))
             .select("label", "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy")))


def confusion_counts(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion counts (label, predicted)."""
    return pred.join(truth, "doc_id").groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def label_counts(labelled: DataFrame) -> DataFrame:
    """Rows per category of a labelled set."""
    return labelled.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def distinct_clients(v: DataFrame) -> DataFrame:
    """Distinct clients of the feed; the name of the last row in feed
    order (id descending) wins, i.e. the smallest id's name."""
    return v.groupBy("ca_id", "user_id").agg(F.min_by("client_name", "id").alias("name"))
