"""Report shapes built from the core operators (sources, listings, policies)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions.text import norm_phone
from . import invoices as I

D = C.to_double


def lookup_users(messages: DataFrame, usr: DataFrame) -> DataFrame:
    """S2 in bulk: the first user (smallest id) whose phone equals each
    message's normalised sender. A join replaces one lookup per message."""
    first = usr.groupBy("phone").agg(F.min("id").alias("user_id"))
    m = messages.select("event_id", norm_phone(F.col("sender")).alias("phone"))
    return m.join(first, "phone", "left").select("event_id", "phone", "user_id")


def lookup(df: DataFrame, order: str = "id", **keys) -> DataFrame:
    """S2 for one key: 'first row where' = filter, then the smallest ``order``."""
    cond = None
    for k, v in keys.items():
        c = F.col(k) == v
        cond = c if cond is None else cond & c
    return (df.filter(cond) if cond is not None else df).orderBy(order).limit(1)


def read_statement_cells(cells: DataFrame) -> DataFrame:
    """S3: statement rows (statement_id, row_no, page_text, cells array)."""
    return cells.select("statement_id", "row_no", "page_text", F.size("cells").alias("n_cells"),
                        F.element_at("cells", 1).alias("first_cell"))


def feed_out(v: DataFrame) -> DataFrame:
    """The invoice feed at the output edge: doubles for money, text date."""
    return v.select("id", "user_id", "ca_id", "client_name", "invoice_no",
                    C.fmt_ts("date").alias("date"), "supplier_gstin",
                    *[D(c).alias(c) for c in ["taxable_amt", "cgst", "sgst", "igst", "itc", "total"]],
                    "status", "ai_category", "ai_confidence", "ai_keywords", "itc_eligible", "user_corrected")


def filing_summary(inv: DataFrame, usr: DataFrame, ca_id: int | None = None) -> DataFrame:
    """Per client invoice listing (no, date[:10], taxable, itc,
    category[:12], status) and one total-ITC row per client."""
    s = I.scope(inv, usr, ca_id)
    itc = C.itc_total()
    detail = s.select(
        "user_id", F.col("id").alias("invoice_id"),
        C.or_default("invoice_no", "—").alias("invoice_no"),
        F.coalesce(F.substring(C.fmt_ts("date"), 1, 10), F.lit("")).alias("date_text"),
        D(C.amt("taxable_amt")).alias("taxable"), D(itc).alias("itc"),
        F.substring(C.category(), 1, 12).alias("category"),
        C.or_default("status", "confirmed").alias("status"), F.lit(False).alias("is_total"))
    totals = s.groupBy("user_id").agg(D(F.sum(itc)).alias("itc")).select(
        "user_id", F.lit(None).cast("long").alias("invoice_id"), F.lit(None).cast("string").alias("invoice_no"),
        F.lit(None).cast("string").alias("date_text"), F.lit(None).cast("double").alias("taxable"), "itc",
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("status"),
        F.lit(True).alias("is_total"))
    return detail.unionByName(totals)


def blocked_by_policy(inv: DataFrame) -> DataFrame:
    """P5 under every policy in one scan: conditional counts, then rows."""
    cat = C.category()
    aggs = []
    for p in C.POLICIES:
        b = C.is_blocked(cat, p)
        aggs += [F.count_if(b).alias(f"{p}__blocked"), F.count_if(~b).alias(f"{p}__eligible")]
    wide = inv.agg(*aggs)
    stack = ", ".join(f"'{p}', `{p}__blocked`, `{p}__eligible`" for p in C.POLICIES)
    return wide.select(F.expr(f"stack({len(C.POLICIES)}, {stack}) AS (policy, blocked, eligible)"))


def tag_transactions(txns: DataFrame) -> DataFrame:
    """P6 over the transactions table; act code taken from the rate (fixture)."""
    code = (F.when(F.col("gst_rate") == 5, " Food_Beverage ").when(F.col("gst_rate") == 12, "gift")
             .when(F.col("gst_rate") == 18, "software").otherwise("Motor_Vehicle"))
    t = txns.select("user_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "type", code.alias("category"))
    return I.tag_itc_eligibility(t).select("user_id", "date", "type", "category_code", "eligible", "reason", "itc_amount")


def register_from_customers(customer: DataFrame, usr: DataFrame, ca_id: int) -> DataFrame:
    """J16 over a client list derived from the customer table: half new
    phones ('8...', every fourth of them twice), half already registered ('9...', skipped)."""
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    new = customer.select(
        F.col("c_name").alias("name"), F.concat(F.lit("8"), key).alias("phone"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" 27aabc"), key, F.lit(" "))).alias("gstin"),
        F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0").alias("state"))
    old = customer.select(F.col("c_name").alias("name"), F.concat(F.lit("9"), key).alias("phone"),
                          F.lit("").alias("gstin"), F.lit("01").alias("state"))
    again = new.filter(F.col("phone").substr(2, 9).cast("long") % 4 == 0).select(
        F.concat(F.lit("ZZ "), "name").alias("name"), "phone", F.lit("").alias("gstin"), F.lit("02").alias("state"))
    return I.register_clients(new.unionByName(old).unionByName(again), usr, ca_id).select(
        "business_name", "phone", "gstin", "state_code", "ca_id")
