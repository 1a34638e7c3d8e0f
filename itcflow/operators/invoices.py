"""Invoice/client projections, filters and joins.

Every function maps DataFrames to a DataFrame; no action runs here.
Tenant scoping keeps all tenants in one pass: ``ca_id=None`` means every
client that belongs to some CA, with ``ca_id`` carried as a key column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions import fixed
from .skew import sequential_index


# ----------------------------------------------------------------- joins ---

def tenant_users(usr: DataFrame, ca_id: int | None = None) -> DataFrame:
    """Users that belong to a CA (J4 key side). NULL ca_id belongs to none."""
    u = usr.filter(F.col("ca_id").isNotNull())
    if ca_id is not None:
        u = u.filter(F.col("ca_id") == ca_id)
    return u


def scope(df: DataFrame, usr: DataFrame, ca_id: int | None = None, key: str = "user_id") -> DataFrame:
    """Rows whose user belongs to the CA (J4): a left-semi join, no columns added."""
    u = tenant_users(usr, ca_id).select(F.col("id").alias(key))
    return df.join(u, key, "left_semi")


def with_client(inv: DataFrame, usr: DataFrame) -> DataFrame:
    """Invoice left-join user (J1): adds ca_id and the display name.

    The users side is a dimension of the fact; Spark/AQE broadcasts it when its
    measured size is under the broadcast threshold and shuffles otherwise, and
    AQE splits a skewed user's partition on the invoice side.
    """
    u = usr.select(F.col("id").alias("user_id"), "ca_id",
                   C.client_name().alias("client_name"))
    return (inv.join(u, "user_id", "left")
               .withColumn("client_name", F.coalesce("client_name", F.lit("Unknown"))))


def invoice_counts(inv: DataFrame) -> DataFrame:
    """Invoices per user, all time (J3 aggregate side; partial agg before shuffle)."""
    return inv.groupBy("user_id").agg(F.count(F.lit(1)).alias("invoice_count"))


def with_invoice_count(usr: DataFrame, inv: DataFrame) -> DataFrame:
    """User left-join invoice count, missing -> 0."""
    n = invoice_counts(inv).withColumnRenamed("user_id", "id")
    return (usr.join(n, "id", "left")
               .withColumn("invoice_count", F.coalesce("invoice_count", F.lit(0).cast("long"))))


def with_ledger(usr: DataFrame, led: DataFrame, period: str) -> DataFrame:
    """User left-join the period's ledger row, missing -> 0.

    The reference takes ``.first()`` of possibly several rows per
    (user, period); the ledger here has one row per key by construction.
    """
    lp = (led.filter(F.col("period") == period)
             .select(F.col("user_id").alias("id"), "itc_available", "total_purchases"))
    return (usr.join(lp, "id", "left")
               .withColumn("itc_available", C.amt("itc_available"))
               .withColumn("total_purchases", C.amt("total_purchases")))


# ------------------------------------------------------------ projections --

def invoice_view(inv: DataFrame, usr: DataFrame, policy: str = "dashboard",
                 ca_id: int | None = None, all_users: bool = False) -> DataFrame:
    """The invoice feed as the dashboard shows it (P1 + J1 + J4).

    Null defaults, ``itc = cgst+sgst+igst``, ``total = taxable + itc``,
    category NULL/'' -> General, status NULL/'' -> confirmed, confidence
    rounded to 2, eligibility under ``policy``. Money stays decimal here.
    """
    if all_users:
        v = with_client(inv, usr)
    else:
        # tenant scope and client name in one join: users.id is unique, so an
        # inner join with the tenant's users equals semi-join + left join
        u = tenant_users(usr, ca_id).select(F.col("id").alias("user_id"), "ca_id",
                                            C.client_name().alias("client_name"))
        v = inv.join(u, "user_id")
    cat = C.category("ai_category")
    return v.select(
        "id", "user_id", "ca_id", "client_name",
        C.or_default("invoice_no", "").alias("invoice_no"),
        F.col("date"),
        C.or_default("seller_gstin", "").alias("supplier_gstin"),
        C.amt("taxable_amt").alias("taxable_amt"),
        C.amt("cgst").alias("cgst"), C.amt("sgst").alias("sgst"), C.amt("igst").alias("igst"),
        C.itc_total().alias("itc"),
        (C.amt("taxable_amt") + C.itc_total()).alias("total"),
        C.or_default("status", "confirmed").alias("status"),
        cat.alias("ai_category"),
        F.round(F.coalesce("ai_confidence", F.lit(0.0)), 2).alias("ai_confidence"),
        F.lit("").alias("ai_keywords"),
        (~C.is_blocked(cat, policy)).alias("itc_eligible"),
        F.lit(False).alias("user_corrected"),
        "created_at",
    )


def by_status(df: DataFrame, status: str) -> DataFrame:
    """Status filter (confirmed / pending / rejected / blocked)."""
    return df.filter(F.col("status") == status)


def tag_itc_eligibility(df: DataFrame, cat: str = "category") -> DataFrame:
    """Act-code eligibility of a purchase table (lower+trim, reason, itc)."""
    code = F.lower(F.trim(F.col(cat)))
    blocked = code.isin(fixed.BLOCKED_ACT_CODES)
    return df.select(
        "*",
        code.alias("category_code"),
        (~blocked).alias("eligible"),
        F.when(blocked, F.concat(F.lit("'"), code, F.lit("' is blocked under Section 17(5) of GST Act")))
         .otherwise(F.lit("Purchase is eligible for Input Tax Credit")).alias("reason"),
        F.when(blocked, F.lit(0)).cast("int").alias("itc_amount"),
    )


def reachable(usr: DataFrame) -> DataFrame:
    """Users with a phone that is not NULL and not ''."""
    return usr.filter(F.col("phone").isNotNull() & (F.col("phone") != ""))


def search_invoices(v: DataFrame, q: str = "", tab: str = "all", client: str | None = None,
                    gstin: bool = False) -> DataFrame:
    """Case-insensitive contains on client name or invoice_no (and
    supplier GSTIN in the legacy page) AND status tab AND client."""
    ql = q.lower()
    m = (F.lower("client_name").contains(ql) | F.lower("invoice_no").contains(ql))
    if gstin:
        m = m | F.lower("supplier_gstin").contains(ql)
    if tab != "all":
        m = m & (F.col("status") == tab)
    if client is not None:
        m = m & (F.col("user_id") == client)
    return v.filter(m)


def search_clients(clients: DataFrame, q: str = "", legacy: bool = False) -> DataFrame:
    """P10: case-insensitive contains on name or gstin (legacy: also state, status)."""
    ql = q.lower()
    m = F.lower(F.coalesce("name", F.lit(""))).contains(ql) | F.lower(F.coalesce("gstin", F.lit(""))).contains(ql)
    if legacy:
        m = m | F.lower(F.coalesce("state", F.lit(""))).contains(ql) | \
            F.lower(F.coalesce("compliance_status", F.lit(""))).contains(ql)
    return clients.filter(m)


def at_risk(clients: DataFrame) -> DataFrame:
    """Status 'at-risk' OR score < 40."""
    return clients.filter((F.col("compliance_status") == "at-risk") | (F.col("risk_score") < fixed.RISK_HIGH_BELOW))


def period_cols(df: DataFrame, c: str = "date") -> DataFrame:
    """P14: 'yyyy-MM' period, 'MMyyyy' return period, 'dd-MM-yyyy' date text."""
    return df.select("*",
                     F.date_format(c, "yyyy-MM").alias("period"),
                     F.date_format(c, "MMyyyy").alias("ret_period"),
                     F.coalesce(F.date_format(c, "dd-MM-yyyy"), F.lit("")).alias("date_text"))


# ------------------------------------------------------------ decisions ----

def latest_by(df: DataFrame, key: str, order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """The latest row per key, as an aggregate (max_by over a struct).

    An aggregation combines map-side, so a key with millions of rows never
    lands whole in one task (a row_number window would).
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    vals = F.struct(*[F.col(c) for c in value_cols])
    return (df.groupBy(key).agg(F.max_by(vals, order).alias("_v"))
              .select(key, *[F.col("_v." + c).alias(c) for c in value_cols]))


def apply_decisions(inv: DataFrame, dec: DataFrame, usr: DataFrame, ca_id: int | None = None) -> DataFrame:
    """The latest review decision per invoice, within the tenant:
    approve -> confirmed, reject -> rejected; other invoices unchanged."""
    d = scope(dec, usr, ca_id)
    last = latest_by(d, "invoice_id", ["ts", "seq"], ["decision"]).withColumnRenamed("invoice_id", "id")
    out = inv.join(last, "id", "left")
    return out.withColumn(
        "status",
        F.when(F.col("decision") == "approve", "confirmed")
         .when(F.col("decision") == "reject", "rejected").otherwise(F.col("status"))
    ).drop("decision")


def bulk_approve(inv: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected ids are approved only when pending; returns the new
    status of every invoice and whether it changed."""
    s = selected.select(F.col("invoice_id").alias("id")).distinct().withColumn("_sel", F.lit(True))
    out = inv.join(s, "id", "left")
    hit = F.coalesce("_sel", F.lit(False)) & (F.col("status") == "pending")
    return (out.withColumn("approved", hit)
               .withColumn("status", F.when(hit, "confirmed").otherwise(F.col("status")))
               .drop("_sel"))


def upsert_users(senders: DataFrame, usr: DataFrame, default_ca: int = 1) -> DataFrame:
    """Find-or-create users from message senders. A sender without a CA
    gets the default one; users who sent nothing stay as they are. New users
    get ids after the current maximum."""
    from ..functions.text import norm_phone
    phones = senders.select(norm_phone(F.col("sender")).alias("phone")).distinct()
    new = phones.join(usr.select("phone"), "phone", "left_anti")
    max_id = usr.select(F.max("id")).scalar()
    numbered = sequential_index(new, ["phone"], out="_n")
    created = numbered.select(
        (F.coalesce(max_id, F.lit(0)) + F.col("_n")).cast("long").alias("id"),
        "phone", F.lit(None).cast("string").alias("business_name"),
        F.lit(None).cast("string").alias("gstin"), F.lit(None).cast("string").alias("state_code"),
        F.lit(default_ca).cast("int").alias("ca_id"), F.lit(True).alias("created"))
    sent = usr.join(phones.withColumn("_sent", F.lit(True)), "phone", "left")
    ca = F.when(F.col("_sent"), F.coalesce("ca_id", F.lit(default_ca))).otherwise(F.col("ca_id"))
    existing = sent.select("id", "phone", "business_name", "gstin", "state_code", ca.cast("int").alias("ca_id"),
                           F.lit(False).alias("created"))
    return existing.unionByName(created)


def register_clients(df: DataFrame, usr: DataFrame, ca_id: int) -> DataFrame:
    """Bulk client registration: gstin upper+trim, linked to the CA;
    phones already present are skipped (phone is unique). Of input rows that
    share a phone the first by name, GSTIN and state is registered."""
    rows = df.select(F.col("name").alias("business_name"), "phone",
                     F.when(C.blank_to_null("gstin").isNull(), F.lit(""))
                      .otherwise(F.upper(F.trim("gstin"))).alias("gstin"), F.col("state").alias("state_code"))
    one = rows.groupBy("phone").agg(F.min(F.struct("business_name", "gstin", "state_code")).alias("row"))
    return (one.join(usr.select("phone"), "phone", "left_anti")
               .select("row.business_name", "phone", "row.gstin", "row.state_code", F.lit(ca_id).cast("int").alias("ca_id")))
