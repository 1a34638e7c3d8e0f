"""Registered queries: scans, tenant reports, filing, analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import core as C
from ..functions import fixed
from ..operators import aggregates as A
from ..operators import invoices as I
from ..operators import reports as R
from ..sources.tables import Model
from . import sqlbits as Q
from .registry import AS_OF, CA_ID, PERIOD, query

D = C.to_double


def M(spark, sf_dir) -> Model:
    return Model(spark, sf_dir)


def feed(m, policy="dashboard", ca_id=None):
    return I.invoice_view(m.invoices, m.users, policy, ca_id)


def clients(m, period=PERIOD, ca_id=None):
    return A.client_summary(m.users, m.invoices, m.ledger, period, ca_id)




# --------------------------------------------------------------- flagship ---

@query("A6_gstr3b_totals", "A6", """
SELECT user_id, strftime(date, '%Y-%m') AS period,
  CAST(sum(CASE WHEN b THEN 0 ELSE cgst END) AS DOUBLE) AS el_cgst,
  CAST(sum(CASE WHEN b THEN 0 ELSE sgst END) AS DOUBLE) AS el_sgst,
  CAST(sum(CASE WHEN b THEN 0 ELSE igst END) AS DOUBLE) AS el_igst,
  CAST(sum(CASE WHEN b THEN cgst ELSE 0 END) AS DOUBLE) AS bl_cgst,
  CAST(sum(CASE WHEN b THEN sgst ELSE 0 END) AS DOUBLE) AS bl_sgst,
  CAST(sum(CASE WHEN b THEN igst ELSE 0 END) AS DOUBLE) AS bl_igst,
  CAST(sum(taxable_amt) AS DOUBLE) AS total_taxable,
  CAST(sum(CASE WHEN b THEN 0 ELSE cgst + sgst END) AS DOUBLE) AS intra,
  CAST(sum(CASE WHEN b THEN 0 ELSE cgst + sgst + igst END) AS DOUBLE) AS eligible_itc,
  CAST(sum(CASE WHEN b THEN cgst + sgst + igst ELSE 0 END) AS DOUBLE) AS blocked_itc,
  count(*) AS total_invoices
FROM t GROUP BY 1, 2
""", ctes=f"t AS (SELECT *, {Q.blocked()} AS b FROM invoices WHERE status = 'confirmed' AND date IS NOT NULL)")
def a6(spark, sf_dir):
    """GSTR-3B eligible/blocked split for every client and every month in one pass."""
    return A.gstr3b_totals(M(spark, sf_dir).invoices, "dashboard")


@query("A6_gstr3b_totals_period", "A6,P3,P4,P5", """
SELECT user_id, strftime(date, '%Y-%m') AS period,
  CAST(sum(CASE WHEN b THEN 0 ELSE cgst END) AS DOUBLE) AS el_cgst,
  CAST(sum(CASE WHEN b THEN 0 ELSE sgst END) AS DOUBLE) AS el_sgst,
  CAST(sum(CASE WHEN b THEN 0 ELSE igst END) AS DOUBLE) AS el_igst,
  CAST(sum(CASE WHEN b THEN cgst ELSE 0 END) AS DOUBLE) AS bl_cgst,
  CAST(sum(CASE WHEN b THEN sgst ELSE 0 END) AS DOUBLE) AS bl_sgst,
  CAST(sum(CASE WHEN b THEN igst ELSE 0 END) AS DOUBLE) AS bl_igst,
  CAST(sum(taxable_amt) AS DOUBLE) AS total_taxable,
  CAST(sum(CASE WHEN b THEN 0 ELSE cgst + sgst END) AS DOUBLE) AS intra,
  CAST(sum(CASE WHEN b THEN 0 ELSE cgst + sgst + igst END) AS DOUBLE) AS eligible_itc,
  CAST(sum(CASE WHEN b THEN cgst + sgst + igst ELSE 0 END) AS DOUBLE) AS blocked_itc,
  count(*) AS total_invoices
FROM t GROUP BY 1, 2
""", ctes=f"""t AS (SELECT *, {Q.blocked('unified')} AS b FROM invoices WHERE status = 'confirmed'
  AND date >= TIMESTAMP '{PERIOD}-01' AND date < TIMESTAMP '{PERIOD}-01' + INTERVAL 1 MONTH)""")
def a6_period(spark, sf_dir):
    """One filing month (half-open), policy 'unified' (union of all blocked vocabularies)."""
    return A.gstr3b_totals(M(spark, sf_dir).invoices, "unified", PERIOD)


@query("A8_gstr3b_global", "A8", """
SELECT strftime(date, '%Y-%m') AS period,
  CAST(sum(CASE WHEN b THEN 0 ELSE cgst END) AS DOUBLE) AS el_cgst,
  CAST(sum(CASE WHEN b THEN 0 ELSE sgst END) AS DOUBLE) AS el_sgst,
  CAST(sum(CASE WHEN b THEN 0 ELSE igst END) AS DOUBLE) AS el_igst,
  CAST(sum(CASE WHEN b THEN cgst ELSE 0 END) AS DOUBLE) AS bl_cgst,
  CAST(sum(CASE WHEN b THEN sgst ELSE 0 END) AS DOUBLE) AS bl_sgst,
  CAST(sum(CASE WHEN b THEN igst ELSE 0 END) AS DOUBLE) AS bl_igst,
  CAST(sum(taxable_amt) AS DOUBLE) AS total_taxable,
  CAST(sum(CASE WHEN b THEN 0 ELSE cgst + sgst END) AS DOUBLE) AS intra,
  CAST(sum(CASE WHEN b THEN 0 ELSE cgst + sgst + igst END) AS DOUBLE) AS eligible_itc,
  CAST(sum(CASE WHEN b THEN cgst + sgst + igst ELSE 0 END) AS DOUBLE) AS blocked_itc,
  count(*) AS total_invoices
FROM t GROUP BY 1
""", ctes=f"t AS (SELECT *, {Q.blocked()} AS b FROM invoices WHERE status = 'confirmed' AND date IS NOT NULL)")
def a8(spark, sf_dir):
    """Un-tenanted GSTR-3B: all clients summed, per month."""
    return A.gstr3b_global(M(spark, sf_dir).invoices)


# ------------------------------------------------------------- scans (S) ----

@query("S1_entity_scan", "S1", """
SELECT 'users' AS entity, count(*) AS n_rows FROM users
UNION ALL SELECT 'invoices', count(*) FROM invoices
UNION ALL SELECT 'transactions', count(*) FROM transactions
UNION ALL SELECT 'gst_ledger', count(*) FROM ledger
UNION ALL SELECT 'filing_history', count(*) FROM filings
UNION ALL SELECT 'gstr2b_cache', count(*) FROM gstr2b
UNION ALL SELECT 'ca_partners', count(DISTINCT ca_id) FROM users
UNION ALL SELECT 'alerts', count(*) FROM users WHERE ca_id IS NULL
""")
def s1(spark, sf_dir):
    """Typed scans of the eight entities, written with and read by their schemas (row counts)."""
    import uuid

    from ..session import shared_dir
    from ..sources.tables import ENTITIES, entity
    m, folder = M(spark, sf_dir), shared_dir(spark, f"itcflow-entities/{uuid.uuid4().hex}")
    partners = m.users.filter(F.col("ca_id").isNotNull()).select(F.col("ca_id").alias("id")).distinct()
    alerts = m.users.filter(F.col("ca_id").isNull()).select("id", F.col("id").alias("user_id"), F.lit("pending").alias("status"))

    def store(name, df):
        types = T.StructType.fromDDL(ENTITIES[name])
        df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                    for f in types]).write.parquet(f"{folder}/{name}")
        return entity(spark, folder, name)

    # the ledger and the 2B lines are made of the stored invoices: their joins run once
    m.replace("invoices", store("invoices", m.invoices))
    stored = {"invoices": m.invoices}
    parts = [("users", m.users), ("transactions", m.transactions),
             ("gst_ledger", m.ledger), ("filing_history", m.filings), ("gstr2b_cache", m.gstr2b),
             ("ca_partners", partners), ("alerts", alerts)]
    out = None
    for name, df in parts:
        stored[name] = store(name, df)
    for name, df in stored.items():
        r = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("entity"), "n_rows")
        out = r if out is None else out.unionByName(r)
    return out


@query("S2_sender_lookup", "S2,F17", """
SELECT mm.event_id, mm.phone, u.user_id
FROM (SELECT event_id, substr(replace(replace(replace(sender, 'whatsapp:+91', ''), 'whatsapp:+', ''), 'whatsapp:', ''), 1, 15) AS phone FROM messages) mm
LEFT JOIN (SELECT phone, min(id) AS user_id FROM users GROUP BY phone) u ON u.phone = mm.phone
""")
def s2(spark, sf_dir):
    """'First row where phone = sender' for every message at once: a join on the
    normalised phone against the smallest user id per phone."""
    m = M(spark, sf_dir)
    return R.lookup_users(m.messages, m.users)


@query("S3_statement_cells", "S3", """
SELECT statement_id, row_no, page_text, CAST(len(cells) AS INTEGER) AS n_cells, cells[1] AS first_cell FROM bank_cells
""")
def s3(spark, sf_dir):
    """Bank-statement cell rows as a source: one row per table row."""
    return R.read_statement_cells(M(spark, sf_dir).bank_cells)


@query("S8_filing_summary", "S8", f"""
SELECT user_id, invoice_id, invoice_no, date_text, taxable, itc, category, status, is_total FROM (
  SELECT i.user_id, i.id AS invoice_id, coalesce(nullif(i.invoice_no, ''), '—') AS invoice_no,
    coalesce(substr(strftime(i.date, '%Y-%m-%d %H:%M:%S'), 1, 10), '') AS date_text,
    CAST(coalesce(i.taxable_amt, 0) AS DOUBLE) AS taxable,
    CAST(coalesce(i.cgst, 0) + coalesce(i.sgst, 0) + coalesce(i.igst, 0) AS DOUBLE) AS itc,
    substr({Q.cat('i.ai_category')}, 1, 12) AS category, coalesce(nullif(i.status, ''), 'confirmed') AS status,
    false AS is_total
  FROM invoices i JOIN users u ON u.id = i.user_id WHERE u.ca_id IS NOT NULL
  UNION ALL
  SELECT i.user_id, NULL, NULL, NULL, NULL,
    CAST(sum(coalesce(i.cgst, 0) + coalesce(i.sgst, 0) + coalesce(i.igst, 0)) AS DOUBLE), NULL, NULL, true
  FROM invoices i JOIN users u ON u.id = i.user_id WHERE u.ca_id IS NOT NULL GROUP BY i.user_id) t
""")
def s8(spark, sf_dir):
    """Filing summary listing of every client of every CA, plus one total row per client."""
    m = M(spark, sf_dir)
    return R.filing_summary(m.invoices, m.users)


# --------------------------------------------------- projections (P) --------

@query("P1_invoice_view", "P1,J1,J4,P2,P5", f"""
SELECT id, user_id, ca_id, client_name, invoice_no, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, supplier_gstin,
  CAST(taxable_amt AS DOUBLE) AS taxable_amt, CAST(cgst AS DOUBLE) AS cgst, CAST(sgst AS DOUBLE) AS sgst,
  CAST(igst AS DOUBLE) AS igst, CAST(itc AS DOUBLE) AS itc, CAST(total AS DOUBLE) AS total, status,
  ai_category, ai_confidence, '' AS ai_keywords, itc_eligible, false AS user_corrected
FROM v
""", ctes=Q.view_cte())
def p1(spark, sf_dir):
    """Invoice feed of all tenants: null defaults, ITC, total, eligibility."""
    v = feed(M(spark, sf_dir))
    return R.feed_out(v)


@query("P3_P4_period_confirmed", "P3,P4", f"""
SELECT id, user_id, CAST(taxable_amt AS DOUBLE) AS taxable_amt FROM invoices
WHERE status = 'confirmed' AND date >= TIMESTAMP '{PERIOD}-01' AND date < TIMESTAMP '{PERIOD}-01' + INTERVAL 1 MONTH
""")
def p3(spark, sf_dir):
    """Confirmed invoices of the filing month (half-open; pushes to the scan)."""
    inv = M(spark, sf_dir).invoices
    return I.by_status(C.in_period(inv, PERIOD), "confirmed").select("id", "user_id", D("taxable_amt").alias("taxable_amt"))


@query("P3_december_roll", "P3", """
SELECT strftime(date, '%Y-%m') AS period, count(*) AS n FROM invoices
WHERE date >= TIMESTAMP '1999-12-01' AND date < TIMESTAMP '2000-01-01' GROUP BY 1
""")
def p3_dec(spark, sf_dir):
    """December period rolls the year: [1999-12-01, 2000-01-01)."""
    inv = M(spark, sf_dir).invoices
    return C.in_period(inv, "1999-12").groupBy(C.ym("date").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("P5_blocked_by_policy", "P5", f"""
SELECT policy, count_if(b) AS blocked, count_if(NOT b) AS eligible FROM (
  {" UNION ALL ".join(f"SELECT '{p}' AS policy, {Q.blocked(p)} AS b FROM invoices" for p in C.POLICIES)}) t GROUP BY policy
""")
def p5(spark, sf_dir):
    """Blocked/eligible invoice counts under each named policy (one pass, all policies)."""
    return R.blocked_by_policy(M(spark, sf_dir).invoices)


@query("P6_tag_itc_eligibility", "P6", f"""
SELECT user_id, date, type, category_code, NOT (category_code IN {Q.sql_list(fixed.BLOCKED_ACT_CODES)}) AS eligible,
  CASE WHEN category_code IN {Q.sql_list(fixed.BLOCKED_ACT_CODES)} THEN '''' || category_code || ''' is blocked under Section 17(5) of GST Act'
       ELSE 'Purchase is eligible for Input Tax Credit' END AS reason,
  CASE WHEN category_code IN {Q.sql_list(fixed.BLOCKED_ACT_CODES)} THEN 0 END AS itc_amount
FROM (SELECT user_id, strftime(date, '%Y-%m-%d') AS date, type, lower(trim(category)) AS category_code FROM t) x
""", ctes="""t AS (SELECT *, CASE gst_rate WHEN 5 THEN ' Food_Beverage ' WHEN 12 THEN 'gift' WHEN 18 THEN 'software'
  ELSE 'Motor_Vehicle' END AS category FROM transactions)""")
def p6(spark, sf_dir):
    """Act-code eligibility tagging of the purchase table (category derived from the rate)."""
    return R.tag_transactions(M(spark, sf_dir).transactions)


@query("P7_month_to_date", "P7", f"""
SELECT user_id, count(*) AS n, CAST(sum(taxable_amt) AS DOUBLE) AS purchases FROM invoices
WHERE date >= TIMESTAMP '{AS_OF[:7]}-01' GROUP BY user_id
""")
def p7(spark, sf_dir):
    """Open-ended month-to-date filter (no upper bound, as in the chat report)."""
    inv = M(spark, sf_dir).invoices
    return (C.since_month_start(inv, AS_OF).groupBy("user_id")
             .agg(F.count(F.lit(1)).alias("n"), D(F.sum("taxable_amt")).alias("purchases")))


@query("P8_reachable_users", "P8", """
SELECT id, phone, ca_id FROM users WHERE phone IS NOT NULL AND phone <> ''
""")
def p8(spark, sf_dir):
    """Users with a phone (reminder targets)."""
    return I.reachable(M(spark, sf_dir).users).select("id", "phone", "ca_id")


@query("P9_search_invoices", "P9", """
SELECT id, user_id, client_name, invoice_no, status FROM v
WHERE (contains(lower(client_name), '#00000001') OR contains(lower(invoice_no), '#00000001')) AND status = 'pending'
""", ctes=Q.view_cte())
def p9(spark, sf_dir):
    """Feed search: client name or invoice no contains the text, pending tab."""
    v = feed(M(spark, sf_dir))
    return I.search_invoices(v, "#00000001", "pending").select("id", "user_id", "client_name", "invoice_no", "status")


@query("P10_search_clients", "P10", f"""
SELECT id, name, gstin, state, compliance_status FROM cs
WHERE contains(lower(name), '00000012') OR contains(lower(gstin), '00000012') OR contains(lower(gstin), 'aaccu0012')
""", ctes=Q.clients_cte(PERIOD))
def p10(spark, sf_dir):
    """Client search on name/gstin."""
    c = clients(M(spark, sf_dir))
    a = I.search_clients(c, "00000012")
    b = I.search_clients(c, "AACCU0012")
    return a.unionByName(b).distinct().select("id", "name", "gstin", "state", "compliance_status")


@query("P11_search_invoices_gstin", "P11", """
SELECT id, client_name, invoice_no, supplier_gstin, status FROM v
WHERE contains(lower(client_name), '05aabc') OR contains(lower(invoice_no), '05aabc') OR contains(lower(supplier_gstin), '05aabc')
""", ctes=Q.view_cte())
def p11(spark, sf_dir):
    """Legacy search also on supplier GSTIN, all statuses."""
    v = feed(M(spark, sf_dir))
    return I.search_invoices(v, "05AABC", "all", gstin=True).select("id", "client_name", "invoice_no", "supplier_gstin", "status")


@query("P13_at_risk_clients", "P13,W5", f"""
SELECT ca_id, id, name, compliance_status, risk_score, {Q.risk_band('risk_score')} AS risk FROM cs
WHERE compliance_status = 'at-risk' OR risk_score < 40
""", ctes=Q.clients_cte(PERIOD))
def p13(spark, sf_dir):
    """At-risk clients: status at-risk or score below 40."""
    c = clients(M(spark, sf_dir))
    return I.at_risk(c).select("ca_id", "id", "name", "compliance_status", "risk_score", "risk")


@query("P14_period_cols", "P14", """
SELECT id, strftime(date, '%Y-%m') AS period, strftime(date, '%m%Y') AS ret_period,
  coalesce(strftime(date, '%d-%m-%Y'), '') AS date_text FROM invoices
""")
def p14(spark, sf_dir):
    """Calendar projections: yyyy-MM, MMyyyy, dd-MM-yyyy."""
    inv = M(spark, sf_dir).invoices.select("id", "date")
    return I.period_cols(inv).select("id", "period", "ret_period", "date_text")


# ---------------------------------------------------------------- joins -----

@query("J2_J3_client_ledger_counts", "J2,J3", f"""
SELECT u.id, CAST(coalesce(l.itc_available, 0) AS DOUBLE) AS itc_available,
  CAST(coalesce(l.total_purchases, 0) AS DOUBLE) AS total_purchases, coalesce(n.c, 0) AS invoice_count
FROM users u LEFT JOIN (SELECT * FROM ledger WHERE period = '{PERIOD}') l ON l.user_id = u.id LEFT JOIN n ON n.user_id = u.id
""", ctes=Q.counts_cte())
def j2j3(spark, sf_dir):
    """Users left-join the period's ledger and their invoice counts (missing -> 0)."""
    m = M(spark, sf_dir)
    x = I.with_invoice_count(I.with_ledger(m.users, m.ledger, PERIOD), m.invoices)
    return x.select("id", D("itc_available").alias("itc_available"), D("total_purchases").alias("total_purchases"),
                    "invoice_count")


@query("J4_tenant_scope", "J4", f"""
SELECT i.id, i.user_id FROM invoices i WHERE i.user_id IN (SELECT id FROM users WHERE ca_id = {CA_ID})
""")
def j4(spark, sf_dir):
    """Invoices of CA 3's clients (left-semi join)."""
    m = M(spark, sf_dir)
    return I.scope(m.invoices, m.users, CA_ID).select("id", "user_id")


@query("J13_apply_decisions", "J13,W7", f"""
SELECT i.id, CASE WHEN d.decision = 'approve' THEN 'confirmed' WHEN d.decision = 'reject' THEN 'rejected' ELSE i.status END AS status
FROM invoices i LEFT JOIN (
  SELECT invoice_id, arg_max(decision, ts) AS decision FROM decisions
  WHERE user_id IN (SELECT id FROM users WHERE ca_id IS NOT NULL) GROUP BY invoice_id) d ON d.invoice_id = i.id
WHERE i.user_id IN (SELECT id FROM users WHERE ca_id IS NOT NULL)
""")
def j13(spark, sf_dir):
    """Review decisions applied within each CA (a CA decides only its clients'
    invoices): latest decision per invoice wins."""
    m = M(spark, sf_dir)
    inv = I.scope(m.invoices, m.users)
    return I.apply_decisions(inv, m.decisions, m.users).select("id", "status")


@query("J14_bulk_approve", "J14", """
SELECT i.id, CASE WHEN s.id IS NOT NULL AND i.status = 'pending' THEN 'confirmed' ELSE i.status END AS status,
  (s.id IS NOT NULL AND i.status = 'pending') AS approved
FROM invoices i LEFT JOIN (SELECT DISTINCT invoice_id AS id FROM decisions WHERE decision = 'approve') s ON s.id = i.id
""")
def j14(spark, sf_dir):
    """Bulk approve of the selected ids (those with an approve decision): pending only."""
    m = M(spark, sf_dir)
    sel = m.decisions.filter(F.col("decision") == "approve").select("invoice_id")
    return I.bulk_approve(m.invoices, sel).select("id", "status", "approved")


@query("J15_upsert_users", "J15,F17", """
SELECT id, phone, ca_id, created FROM (
  SELECT id, phone, CASE WHEN phone IN (
      SELECT substr(replace(replace(replace(sender, 'whatsapp:+91', ''), 'whatsapp:+', ''), 'whatsapp:', ''), 1, 15) FROM messages)
    THEN coalesce(ca_id, 1) ELSE ca_id END AS ca_id, false AS created FROM users
  UNION ALL
  SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY phone) AS id, phone, 1 AS ca_id, true AS created
  FROM (SELECT DISTINCT substr(replace(replace(replace(sender, 'whatsapp:+91', ''), 'whatsapp:+', ''), 'whatsapp:', ''), 1, 15) AS phone
        FROM messages) s WHERE phone NOT IN (SELECT phone FROM users)) t
""")
def j15(spark, sf_dir):
    """Find-or-create users for every message sender; back-fill a sender's missing ca_id with CA 1."""
    m = M(spark, sf_dir)
    return I.upsert_users(m.messages, m.users, 1).select("id", "phone", "ca_id", "created")


@query("J16_register_clients", "J16", """
SELECT business_name, phone, gstin, state_code, 3 AS ca_id FROM (
  SELECT c_name AS business_name, '8' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE upper(trim(' 27aabc' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' ')) END AS gstin,
    lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') AS state_code FROM customer
  UNION ALL SELECT c_name, '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), '', '01' FROM customer
  UNION ALL SELECT 'ZZ ' || c_name, '8' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), '', '02' FROM customer WHERE c_custkey % 4 = 0) t
WHERE NOT starts_with(business_name, 'ZZ ') AND phone NOT IN (SELECT phone FROM users)
""")
def j16(spark, sf_dir):
    """Bulk client registration into CA 3; phones already registered are skipped."""
    m = M(spark, sf_dir)
    return R.register_from_customers(m.customer, m.users, CA_ID)


# ------------------------------------------------------- aggregates (A) -----

@query("A1_dashboard_stats", "A1", f"""
SELECT c.ca_id, CAST(round(coalesce(l.t, 0), 2) AS DOUBLE) AS total_itc, coalesce(i.n, 0) AS total_invoices,
  coalesce(i.p, 0) AS pending_invoices, c.n AS total_clients, '{PERIOD}' AS period
FROM (SELECT ca_id, count(*) AS n FROM users WHERE ca_id IS NOT NULL GROUP BY ca_id) c
LEFT JOIN (SELECT u.ca_id, count(*) AS n, count_if(i.status = 'pending') AS p FROM invoices i JOIN users u ON u.id = i.user_id
           WHERE u.ca_id IS NOT NULL GROUP BY u.ca_id) i ON i.ca_id = c.ca_id
LEFT JOIN (SELECT u.ca_id, sum(l.itc_available) AS t FROM ledger l JOIN users u ON u.id = l.user_id
           WHERE u.ca_id IS NOT NULL AND l.period = '{PERIOD}' GROUP BY u.ca_id) l ON l.ca_id = c.ca_id
""")
def a1(spark, sf_dir):
    """Dashboard stats of every CA for the period."""
    m = M(spark, sf_dir)
    return A.dashboard_stats(m.invoices, m.users, m.ledger, PERIOD)


@query("A2_admin_stats", "A2", f"""
SELECT c.ca_id, c.n AS total_users, coalesce(i.n, 0) AS total_invoices, CAST(round(coalesce(l.t, 0), 2) AS DOUBLE) AS total_itc,
  coalesce(i.c, 0) AS confirmed_invoices, coalesce(i.p, 0) AS pending_invoices, c.n * {fixed.PRICE_PER_CLIENT} AS mrr
FROM (SELECT ca_id, count(*) AS n FROM users WHERE ca_id IS NOT NULL GROUP BY ca_id) c
LEFT JOIN (SELECT u.ca_id, count(*) AS n, count_if(i.status = 'confirmed') AS c, count_if(i.status = 'pending') AS p
           FROM invoices i JOIN users u ON u.id = i.user_id WHERE u.ca_id IS NOT NULL GROUP BY u.ca_id) i ON i.ca_id = c.ca_id
LEFT JOIN (SELECT u.ca_id, sum(l.itc_available) AS t FROM ledger l JOIN users u ON u.id = l.user_id
           WHERE u.ca_id IS NOT NULL GROUP BY u.ca_id) l ON l.ca_id = c.ca_id
""")
def a2(spark, sf_dir):
    """Admin stats of every CA: users, invoices, all-time ITC, MRR."""
    m = M(spark, sf_dir)
    return A.admin_stats(m.invoices, m.users, m.ledger)


@query("A3_admin_users", "A3,T8", """
SELECT u.ca_id, u.id, coalesce(nullif(u.business_name, ''), 'Unknown') AS name, coalesce(u.phone, '') AS phone,
  coalesce(u.gstin, '') AS gstin, coalesce(u.state_code, '') AS state, coalesce(n.c, 0) AS invoice_count,
  '' AS joined_at
FROM users u LEFT JOIN n ON n.user_id = u.id WHERE u.ca_id IS NOT NULL ORDER BY u.id DESC
""", ctes=Q.counts_cte())
def a3(spark, sf_dir):
    """Admin user listing, newest first, with invoice counts."""
    m = M(spark, sf_dir)
    return A.admin_users(m.invoices, m.users)


@query("A4_client_summary", "A4,F21,W5", f"""
SELECT ca_id, id, name, gstin, state, whatsapp, itc_this_month, invoice_count, compliance_status, risk_score,
  {Q.risk_band('risk_score')} AS risk FROM cs
""", ctes=Q.clients_cte(PERIOD))
def a4(spark, sf_dir):
    """Client roll-up of every CA: ITC this month, invoices, status, score, band."""
    return clients(M(spark, sf_dir))


@query("A5_gst_liability", "A5", """
SELECT user_id, strftime(date, '%Y-%m') AS period,
  CAST(round(coalesce(sum(CASE WHEN type = 'sale' THEN amount * gst_rate * CAST(0.01 AS DECIMAL(3,2)) END), 0), 2) AS DOUBLE) AS total_gst_collected,
  CAST(round(coalesce(sum(CASE WHEN type = 'purchase' AND coalesce(itc_eligible, false) THEN amount * gst_rate * CAST(0.01 AS DECIMAL(3,2)) END), 0), 2) AS DOUBLE) AS total_itc_available,
  CAST(round(greatest(0, coalesce(sum(CASE WHEN type = 'sale' THEN amount * gst_rate * CAST(0.01 AS DECIMAL(3,2)) END), 0)
    - coalesce(sum(CASE WHEN type = 'purchase' AND coalesce(itc_eligible, false) THEN amount * gst_rate * CAST(0.01 AS DECIMAL(3,2)) END), 0)), 2) AS DOUBLE) AS net_liability
FROM transactions GROUP BY 1, 2
""")
def a5(spark, sf_dir):
    """Net GST liability per client and month: output tax - eligible input tax, floored at 0."""
    return A.gst_liability(M(spark, sf_dir).transactions)


@query("A9_ledger_saved", "A9", """
SELECT user_id, period, CAST(total_purchases AS DOUBLE) AS total_purchases, CAST(itc_available AS DOUBLE) AS itc_available FROM ledger
""")
def a9(spark, sf_dir):
    """Ledger as the application keeps it: every saved invoice, month of save time."""
    led = M(spark, sf_dir).ledger
    return led.select("user_id", "period", D("total_purchases").alias("total_purchases"),
                      D("itc_available").alias("itc_available"))


@query("A9_ledger_filed", "A9", f"""
SELECT user_id, strftime(date, '%Y-%m') AS period, CAST(sum(taxable_amt) AS DOUBLE) AS total_purchases,
  CAST(sum(CASE WHEN igst > 0 THEN igst ELSE cgst + sgst END) AS DOUBLE) AS itc_available
FROM invoices WHERE status = 'confirmed' AND date IS NOT NULL AND NOT {Q.blocked()} GROUP BY 1, 2
""")
def a9_filed(spark, sf_dir):
    """Ledger on the filing basis: confirmed, non-blocked, month of the invoice date."""
    led = A.build_ledger(M(spark, sf_dir).invoices, basis="filed")
    return led.select("user_id", "period", D("total_purchases").alias("total_purchases"),
                      D("itc_available").alias("itc_available"))


@query("A10_itc_balance", "A10", f"""
SELECT u.id AS user_id, CAST(round(coalesce(l.itc_available, 0), 2) AS DOUBLE) AS itc_total, '{PERIOD}' AS period,
  coalesce(n.c, 0) AS invoice_count
FROM users u LEFT JOIN (SELECT * FROM ledger WHERE period = '{PERIOD}') l ON l.user_id = u.id LEFT JOIN n ON n.user_id = u.id
""", ctes=Q.counts_cte())
def a10(spark, sf_dir):
    """ITC balance of every user for the period."""
    m = M(spark, sf_dir)
    return A.itc_balance(m.users, m.ledger, m.invoices, PERIOD)
