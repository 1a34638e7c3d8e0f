"""Registered queries: analytics, windows, top-k, set ops, filing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..functions import fixed
from ..operators import aggregates as A
from ..operators import filing as FL
from ..operators import windows as W
from . import sqlbits as Q
from .catalog_core import M, clients, feed
from .registry import AS_OF, PERIOD, query

D = C.to_double
VIEW = Q.view_cte()
CLIENTS = Q.clients_cte(PERIOD)


# ------------------------------------------------------------- analytics ----

@query("A11_monthly_report", "A11,P7,F3,F4", f"""
SELECT u.id AS user_id, coalesce(a.n, 0) AS total_invoices, CAST(coalesce(a.p, 0) AS DOUBLE) AS total_purchases,
  CAST(round(coalesce(l.itc_available, 0), 2) AS DOUBLE) AS total_itc, coalesce(a.b, 0) AS blocked_count,
  '2000-07-11' AS gstr1_deadline, '2000-07-20' AS gstr3b_deadline, 26 AS days_to_gstr1, 35 AS days_to_gstr3b,
  'green' AS urgency
FROM users u
LEFT JOIN (SELECT user_id, count(*) AS n, sum(taxable_amt) AS p, count_if(status = 'blocked') AS b FROM invoices
           WHERE date >= TIMESTAMP '{AS_OF[:7]}-01' GROUP BY user_id) a ON a.user_id = u.id
LEFT JOIN (SELECT * FROM ledger WHERE period = '{AS_OF[:7]}') l ON l.user_id = u.id
""")
def a11(spark, sf_dir):
    """Chat monthly report of every user as of 2000-06-15."""
    m = M(spark, sf_dir)
    return A.monthly_report(m.invoices, m.ledger, m.users, AS_OF)


A11_SQL = f"""
SELECT u.id AS user_id, coalesce(a.n, 0) AS total_invoices, CAST(coalesce(a.p, 0) AS DOUBLE) AS total_purchases,
  CAST(round(coalesce(l.itc_available, 0), 2) AS DOUBLE) AS total_itc, coalesce(a.b, 0) AS blocked_count,
  '2000-07-11' AS gstr1_deadline, '2000-07-20' AS gstr3b_deadline, 26 AS days_to_gstr1, 35 AS days_to_gstr3b,
  'green' AS urgency
FROM users u
LEFT JOIN (SELECT user_id, count(*) AS n, sum(taxable_amt) AS p, count_if(status = 'blocked') AS b FROM invoices
           WHERE date >= TIMESTAMP '{AS_OF[:7]}-01' GROUP BY user_id) a ON a.user_id = u.id
LEFT JOIN (SELECT * FROM ledger WHERE period = '{AS_OF[:7]}') l ON l.user_id = u.id
"""


def _sql_tpl(t: str, **exprs) -> str:
    """A template as a SQL concatenation: literal pieces and {field} expressions."""
    import re
    parts = re.split(r"\{(\w+)\}", t)
    out = []
    for i, piece in enumerate(parts):
        if i % 2 == 0:
            if piece:
                out.append("'" + piece.replace("'", "''") + "'")
        else:
            out.append("(" + exprs[piece] + ")")
    return " || ".join(out) if out else "''"


def _report_sql(month: str) -> str:
    """The report text over A11's columns; ``month`` is the SQL of the month's name."""
    fmt2 = "format('{{:,.2f}}', {})"
    body = " || ".join([
        _sql_tpl(fixed.REPORT_HEAD, month_name=month),
        _sql_tpl(fixed.REPORT_BODY, invoices="CAST(total_invoices AS VARCHAR)",
                 purchases=fmt2.format("total_purchases"), itc=fmt2.format("total_itc")),
        "CASE WHEN blocked_count > 0 THEN " + _sql_tpl(fixed.REPORT_BLOCKED, blocked="CAST(blocked_count AS VARCHAR)")
        + " ELSE '' END",
        _sql_tpl(fixed.REPORT_DEADLINES, light="CASE urgency " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in
                                                                        fixed.REPORT_LIGHT.items()) + " END",
                 g1="gstr1_deadline", d1="CAST(days_to_gstr1 AS VARCHAR)", g3="gstr3b_deadline",
                 d3="CAST(days_to_gstr3b AS VARCHAR)"),
        "CASE WHEN days_to_gstr3b <= 3 THEN " + _sql_tpl(fixed.REPORT_URGENT, d3="CAST(days_to_gstr3b AS VARCHAR)")
        + " WHEN days_to_gstr3b <= 7 THEN " + _sql_tpl(fixed.REPORT_SOON, d3="CAST(days_to_gstr3b AS VARCHAR)")
        + " ELSE " + _sql_tpl(fixed.REPORT_OK, d3="CAST(days_to_gstr3b AS VARCHAR)") + " END",
        "'" + fixed.REPORT_TAIL + "'"])
    return body


@query("A13_itc_trend", "A13,T7", """
SELECT ca_id, month, substr(month, 6, 2) AS month_label, CAST(floor(itc + 0.5) AS BIGINT) AS itc FROM (
  SELECT ca_id, strftime(date, '%Y-%m') AS month, sum(itc) AS itc,
    row_number() OVER (PARTITION BY ca_id ORDER BY strftime(date, '%Y-%m') DESC) AS rn
  FROM v WHERE date IS NOT NULL GROUP BY 1, 2) t WHERE rn <= 6
""", ctes=VIEW)
def a13(spark, sf_dir):
    """Monthly ITC trend per CA: last 6 months with data."""
    return A.itc_trend(feed(M(spark, sf_dir)))


@query("A14_category_breakdown", "A14", """
SELECT ca_id, ai_category, count(*) AS count, CAST(sum(itc) AS DOUBLE) AS itc FROM v GROUP BY 1, 2
""", ctes=VIEW)
def a14(spark, sf_dir):
    """Count and ITC per category, per CA, highest ITC first."""
    return A.category_breakdown(feed(M(spark, sf_dir)))


@query("A15_avg_confidence", "A15", """
SELECT ca_id, CAST(floor(CAST(sum(CAST(ai_confidence AS DECIMAL(5,2))) AS DOUBLE) * 100 / count(*) + 0.5) AS BIGINT) AS avg_conf_pct
FROM v GROUP BY 1
""", ctes=VIEW)
def a15(spark, sf_dir):
    """Mean AI confidence in percent per CA."""
    return A.avg_confidence(feed(M(spark, sf_dir)))


@query("A16_compliance_distribution", "A16", """
SELECT ca_id, compliance_status, value,
  CAST(floor(CAST(value AS DOUBLE) * 100 / sum(value) OVER (PARTITION BY ca_id) + 0.5) AS BIGINT) AS share_pct
FROM (SELECT ca_id, compliance_status, count(*) AS value FROM cs GROUP BY 1, 2) t
""", ctes=CLIENTS)
def a16(spark, sf_dir):
    """Clients per compliance status per CA (non-zero buckets), with share %."""
    return A.compliance_distribution(clients(M(spark, sf_dir)))


@query("A17_category_distribution", "A17", """
SELECT ca_id, ai_category, count(*) AS value FROM v GROUP BY 1, 2
""", ctes=VIEW)
def a17(spark, sf_dir):
    """Invoice count per category per CA."""
    return A.category_distribution(feed(M(spark, sf_dir)))


@query("A18_itc_by_state", "A18", """
SELECT ca_id, coalesce(nullif(state, ''), 'Unknown') AS state, CAST(sum(itc_dec) AS DOUBLE) AS itc FROM cs GROUP BY 1, 2
""", ctes=CLIENTS)
def a18(spark, sf_dir):
    """Clients' ITC this month by state code per CA."""
    return A.itc_by_state(clients(M(spark, sf_dir)))


@query("A19_portfolio_kpis", "A19", """
SELECT ca_id, CAST(sum(itc_dec) AS DOUBLE) AS total_itc, CAST(floor(sum(risk_score) / count(*) + 0.5) AS BIGINT) AS avg_risk,
  CAST(floor(CAST(sum(itc_dec) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS avg_itc
FROM cs GROUP BY 1
""", ctes=CLIENTS)
def a19(spark, sf_dir):
    """Portfolio KPIs per CA: total ITC, mean score, mean ITC per client."""
    return A.portfolio_kpis(clients(M(spark, sf_dir)))


@query("A20_itc_leakage", "A20", """
SELECT ca_id, 'total' AS level, '' AS key, CAST(sum(itc) AS DOUBLE) AS amount FROM b GROUP BY ca_id
UNION ALL SELECT ca_id, 'category', ai_category, CAST(sum(itc) AS DOUBLE) FROM b GROUP BY ca_id, ai_category
UNION ALL SELECT ca_id, 'client', client_name, CAST(sum(itc) AS DOUBLE) FROM b GROUP BY ca_id, client_name
""", ctes=VIEW + f",\nb AS (SELECT * FROM v WHERE {Q.blocked('insights', 'ai_category')})")
def a20(spark, sf_dir):
    """Blocked ITC (insights list) per CA: total, by category, by client, in one GROUPING SETS pass."""
    return A.itc_leakage(feed(M(spark, sf_dir)), "insights")


@query("A21_supplier_risk", "A21,F7", """
SELECT ca_id, gstin, count(*) AS times, CAST(sum(itc) AS DOUBLE) AS total_itc,
  CASE WHEN length(gstin) >= 2 THEN substr(gstin, 1, 2) ELSE '?' END AS state, length(gstin) = 15 AS valid
FROM (SELECT *, coalesce(nullif(supplier_gstin, ''), 'Unknown') AS gstin FROM v) t GROUP BY ca_id, gstin
""", ctes=VIEW)
def a21(spark, sf_dir):
    """Supplier risk per CA and supplier id: uses, ITC, state prefix, 15-char validity."""
    return A.supplier_risk(feed(M(spark, sf_dir)))


@query("A21_supplier_risk_summary", "A21", """
SELECT ca_id, count(*) AS suppliers, count_if(length(gstin) <> 15) AS invalid_count,
  CAST(sum(CASE WHEN length(gstin) <> 15 THEN itc ELSE 0 END) AS DOUBLE) AS risk_itc
FROM (SELECT ca_id, coalesce(nullif(supplier_gstin, ''), 'Unknown') AS gstin, sum(itc) AS itc FROM v GROUP BY 1, 2) t
GROUP BY ca_id
""", ctes=VIEW)
def a21s(spark, sf_dir):
    """Invalid supplier ids and the ITC riding on them, per CA."""
    return A.supplier_risk_summary(feed(M(spark, sf_dir)))


@query("A22_status_counts", "A22", """
SELECT ca_id, CAST(sum(itc) AS DOUBLE) AS total_itc, count(*) AS total, count_if(status = 'confirmed') AS confirmed,
  count_if(status = 'pending') AS pending, count_if(status = 'rejected') AS rejected FROM v GROUP BY 1
""", ctes=VIEW)
def a22(spark, sf_dir):
    """Status counts and total ITC per CA."""
    return A.status_counts(feed(M(spark, sf_dir)))


@query("A23_tax_heads", "A23", """
SELECT user_id, name, CAST(value AS DOUBLE) AS value FROM (
  SELECT user_id, 'CGST' AS name, sum(cgst) AS value FROM v GROUP BY 1
  UNION ALL SELECT user_id, 'SGST', sum(sgst) FROM v GROUP BY 1
  UNION ALL SELECT user_id, 'IGST', sum(igst) FROM v GROUP BY 1) t WHERE value > 0
""", ctes=VIEW)
def a23(spark, sf_dir):
    """Tax-head breakdown of every client, non-zero heads only."""
    return A.tax_heads(feed(M(spark, sf_dir)))


@query("A24_revenue", "A24", f"""
SELECT ca_id, count(*) AS clients, count(*) * {fixed.PRICE_PER_CLIENT} AS mrr_consumer, {fixed.PLATFORM_FEE} AS mrr_ca,
  count(*) * {fixed.PRICE_PER_CLIENT} + {fixed.PLATFORM_FEE} AS total_mrr FROM users WHERE ca_id IS NOT NULL GROUP BY 1
""")
def a24(spark, sf_dir):
    """Revenue estimate per CA: clients x 299 + 999."""
    return A.revenue(M(spark, sf_dir).users)


@query("A26_legacy_totals", "A26", """
SELECT ca_id, CAST(sum(itc_dec) AS DOUBLE) AS total_itc, CAST(sum(invoice_count) AS BIGINT) AS invoices, count(*) AS clients,
  CAST(round(sum(itc_dec) / count(*), 2) AS DOUBLE) AS itc_per_client,
  count_if(compliance_status = 'compliant') AS green, count_if(compliance_status = 'at-risk') AS high_risk
FROM cs GROUP BY 1
""", ctes=CLIENTS)
def a26(spark, sf_dir):
    """Legacy portfolio totals per CA."""
    return A.legacy_totals(clients(M(spark, sf_dir)))


@query("A26_legacy_client_totals", "A26", """
SELECT v.user_id, CAST(sum(v.itc) AS DOUBLE) AS total_itc, count(*) AS invoices, CAST(sum(v.total) AS DOUBLE) AS total_spend,
  CAST(coalesce(any_value(u.turnover_ytd), 0) AS DOUBLE) AS turnover_ytd
FROM v LEFT JOIN users u ON u.id = v.user_id GROUP BY v.user_id
""", ctes=VIEW)
def a26c(spark, sf_dir):
    """Legacy client page totals: ITC, invoices, spend, turnover YTD per client."""
    m = M(spark, sf_dir)
    return A.legacy_client_totals(feed(m), m.users)


@query("A30_distinct_clients", "A30", """
SELECT ca_id, user_id, arg_min(client_name, id) AS name FROM v GROUP BY 1, 2
""", ctes=VIEW)
def a30(spark, sf_dir):
    """Distinct clients of each CA's feed, last name in feed order wins."""
    return A.distinct_clients(feed(M(spark, sf_dir)))


# ------------------------------------------------------------- windows ------

ANOMALY_SQL = """
SELECT {cols}, CAST(total AS DOUBLE) AS total, avg_total, {inr} AS invoice,
  format('{{:.1f}}', CAST(total AS DOUBLE) / avg_total) AS ratio,
  format('{{:.1f}}', CAST(total AS DOUBLE) / avg_total) || 'x higher than average invoice value' AS detail,
  CASE WHEN CAST(total AS DOUBLE) > avg_total * 4.0 THEN 'high' ELSE 'medium' END AS severity
FROM (SELECT v.*, a.avg_total, row_number() OVER (PARTITION BY v.{by} ORDER BY v.id DESC) AS rn
      FROM v JOIN (SELECT {by}, CAST(sum(total) AS DOUBLE) / count(*) AS avg_total FROM v GROUP BY {by}) a ON a.{by} = v.{by}
      WHERE CAST(v.total AS DOUBLE) > a.avg_total * 2.5) t
{where}
"""


@query("W1_invoice_anomalies", "W1", ANOMALY_SQL.format(by="ca_id", cols="ca_id, id, user_id, client_name", where="WHERE rn <= 5", inr=Q.inr_text("total")), ctes=VIEW)
def w1(spark, sf_dir):
    """Invoices above 2.5x the CA feed's mean total; first 5 in feed order per CA."""
    return W.invoice_anomalies(feed(M(spark, sf_dir)))


@query("W2_client_anomalies", "W2", ANOMALY_SQL.format(by="user_id", cols="user_id, id, client_name", where="", inr=Q.inr_text("total")), ctes=VIEW)
def w2(spark, sf_dir):
    """Per-client variant (extension): above 2.5x the client's own mean, all rows."""
    return W.invoice_anomalies(feed(M(spark, sf_dir)), n=None, by="user_id")


@query("W3_mark_duplicates", "W3", """
SELECT b.id, b.user_id, d.id IS NOT NULL AS is_duplicate, d.id AS dup_of,
  CASE WHEN d.id IS NULL THEN NULL ELSE coalesce(strftime(d.date, '%d-%m-%Y'), 'unknown date') END AS existing_date,
  CAST(round(d.cgst + d.sgst + d.igst, 2) AS DOUBLE) AS existing_total
FROM (SELECT *, CASE WHEN no = '' THEN NULL WHEN g <> '' THEN first3 ELSE first2 END AS inc FROM (
  SELECT b.*, (SELECT min(x.id) FROM invoices x WHERE x.user_id = b.user_id AND trim(coalesce(x.invoice_no, '')) = b.no
               AND trim(coalesce(x.seller_gstin, '')) = b.g) AS first3,
              (SELECT min(x.id) FROM invoices x WHERE x.user_id = b.user_id AND trim(coalesce(x.invoice_no, '')) = b.no) AS first2
  FROM (SELECT id, user_id, trim(coalesce(invoice_no, '')) AS no, trim(coalesce(seller_gstin, '')) AS g FROM invoices) b) t) b
LEFT JOIN invoices d ON d.id = CASE WHEN b.inc < b.id THEN b.inc END
""")
def w3(spark, sf_dir):
    """Batch duplicate marking: every later copy points to its incumbent."""
    cols = ["id", "user_id", "invoice_no", "seller_gstin", "date", "cgst", "sgst", "igst"]
    return W.mark_duplicates(M(spark, sf_dir).stage("invoices", *cols).invoices)


@query("W4_running_itc", "W4", """
SELECT id, user_id, period, CAST(itc_this AS DOUBLE) AS itc_this,
  CAST(sum(itc_this) OVER (PARTITION BY user_id, period ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS itc_total
FROM (SELECT id, user_id, created_at, strftime(created_at, '%Y-%m') AS period,
        CASE WHEN igst > 0 THEN igst ELSE cgst + sgst END AS itc_this FROM invoices) t
""")
def w4(spark, sf_dir):
    """Running month ITC after each save (skew-safe distributed prefix sum)."""
    return W.running_itc(M(spark, sf_dir).invoices)


@query("W6_confidence_band", "W6", """
SELECT id, ai_confidence, CASE WHEN ai_confidence >= 0.85 THEN 'high' WHEN ai_confidence >= 0.65 THEN 'medium' ELSE 'low' END AS band,
  ai_confidence < 0.85 AS needs_correction, CAST(floor(ai_confidence * 100 + 0.5) AS BIGINT) AS conf_pct FROM v
""", ctes=VIEW)
def w6(spark, sf_dir):
    """Confidence bands of the feed; below 0.85 offers a correction."""
    v = feed(M(spark, sf_dir))
    return v.select("id", "ai_confidence", C.confidence_band(F.col("ai_confidence")).alias("band"),
                    (F.col("ai_confidence") < fixed.CONF_HIGH).alias("needs_correction"),
                    F.floor(F.col("ai_confidence") * 100 + 0.5).cast("long").alias("conf_pct"))


@query("W7_latest_decision", "W7", """
SELECT invoice_id, arg_max(decision, (ts, seq)) AS decision FROM decisions GROUP BY 1
""")
def w7(spark, sf_dir):
    """Latest review decision per invoice (max_by aggregate, no window)."""
    from ..operators.invoices import latest_by
    return latest_by(M(spark, sf_dir).decisions, "invoice_id", ["ts", "seq"], ["decision"])


# ---------------------------------------------------------------- top-k -----

@query("T1_feed", "T1", """
SELECT id, user_id, client_name, CAST(total AS DOUBLE) AS total, status FROM v ORDER BY id DESC
""", ctes=VIEW)
def t1(spark, sf_dir):
    """The invoice feed newest id first."""
    v = feed(M(spark, sf_dir))
    return v.select("id", "user_id", "client_name", D("total").alias("total"), "status").orderBy(F.col("id").desc())


@query("T2_recent", "T2", """
SELECT ca_id, rank, id, client_name, CAST(total AS DOUBLE) AS total FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY ca_id ORDER BY id DESC) AS INTEGER) AS rank FROM v) t WHERE rank <= 6
""", ctes=VIEW)
def t2(spark, sf_dir):
    """Newest 6 invoices of each CA."""
    return W.recent(feed(M(spark, sf_dir))).select("ca_id", "rank", "id", "client_name", D("total").alias("total"))


@query("T3_activity", "T3", """
SELECT ca_id, rank, id, client_name AS client,
  CASE status WHEN 'confirmed' THEN 'Invoice confirmed' WHEN 'pending' THEN 'Awaiting review' ELSE 'Invoice rejected' END AS action,
  CAST(total AS DOUBLE) AS amount, """ + Q.inr_text("total") + """ AS amount_text,
  coalesce(substr(strftime(date, '%Y-%m-%d %H:%M:%S'), 1, 10), '') AS time,
  CASE status WHEN 'confirmed' THEN 'success' WHEN 'pending' THEN 'warning' ELSE 'danger' END AS status
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ca_id ORDER BY id DESC) AS INTEGER) AS rank FROM v) t WHERE rank <= 6
""", ctes=VIEW)
def t3(spark, sf_dir):
    """Activity feed: 6 newest invoices per CA with action text and severity."""
    return W.activity(feed(M(spark, sf_dir)))


@query("T4_top_clients", "T4", """
SELECT ca_id, rank, id, name, itc_this_month FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY ca_id ORDER BY itc_dec DESC, id) AS INTEGER) AS rank FROM cs) t WHERE rank <= 6
""", ctes=CLIENTS)
def t4(spark, sf_dir):
    """Top 6 clients of each CA by ITC this month."""
    return W.top_clients(clients(M(spark, sf_dir))).select("ca_id", "rank", "id", "name", "itc_this_month")


@query("T5_suppliers_head", "T5", """
SELECT ca_id, gstin, first_seen, times, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY ca_id ORDER BY first_seen DESC) AS INTEGER) AS rank FROM (
    SELECT ca_id, coalesce(nullif(supplier_gstin, ''), 'Unknown') AS gstin, max(id) AS first_seen, count(*) AS times
    FROM v GROUP BY 1, 2) s) t WHERE rank <= 8
""", ctes=VIEW)
def t5(spark, sf_dir):
    """First 8 suppliers of each CA's feed in first-seen order."""
    return W.suppliers_head(feed(M(spark, sf_dir)))


# --------------------------------------------------------------- set ops ----

def _alerts_sql(policy: str) -> str:
    period = AS_OF[:7]
    if policy == "calendar":
        src = (f"SELECT user_id, count(*) AS n FROM invoices WHERE date >= TIMESTAMP '{period}-01' "
               f"AND date < TIMESTAMP '{period}-01' + INTERVAL 1 MONTH GROUP BY 1")
        days = (f"CAST(date_diff('day', DATE '{AS_OF}', CAST(CASE WHEN n = 0 THEN '{period}-20' ELSE '{period}-25' END AS DATE)) "
                "AS INTEGER)")
    else:
        src = "SELECT user_id, count(*) AS n FROM invoices GROUP BY 1"
        days = "CASE WHEN n = 0 THEN 11 ELSE 16 END"
    return f"""
SELECT ca_id, CASE WHEN n = 0 THEN 'alert-' ELSE 'alert-low-' END || CAST(uid AS VARCHAR) AS id, uid AS user_id, client_name,
  CASE WHEN n = 0 THEN 'No Invoices' ELSE 'Low Invoice Count' END AS type,
  CASE WHEN n = 0 THEN 'No invoices uploaded this month. ITC at risk.'
       ELSE 'Only ' || CAST(n AS VARCHAR) || ' invoice(s) uploaded. More expected.' END AS message,
  CASE WHEN n = 0 THEN 'high' ELSE 'medium' END AS priority,
  CASE WHEN n = 0 THEN '{period}-20' ELSE '{period}-25' END AS due_date, {days} AS days_remaining, false AS resolved
FROM (SELECT u.ca_id, u.id AS uid, {Q.name_sql()} AS client_name, coalesce(c.n, 0) AS n
      FROM users u LEFT JOIN ({src}) c ON c.user_id = u.id WHERE u.ca_id IS NOT NULL) t WHERE n < 3
"""


@query("U1_client_alerts", "U1", _alerts_sql("calendar"))
def u1(spark, sf_dir):
    """'No Invoices' / 'Low Invoice Count' alerts, counting the as-of month's invoices."""
    m = M(spark, sf_dir)
    return W.client_alerts(m.users, m.invoices, AS_OF, "calendar")


@query("U1_client_alerts_reference", "U1", _alerts_sql("reference"))
def u1r(spark, sf_dir):
    """The same alerts as the application counts them (all invoices, fixed days)."""
    m = M(spark, sf_dir)
    return W.client_alerts(m.users, m.invoices, AS_OF, "reference")


RESOLVED_CTE = f"res AS (SELECT DISTINCT 'alert-low-' || CAST(user_id AS VARCHAR) AS alert_id FROM ledger WHERE period = '{AS_OF[:7]}')"


def _resolved(m):
    """Alerts counted as resolved: low-count alerts of clients who saved an
    invoice in the as-of month (ledger row present)."""
    return (m.ledger.filter(F.col("period") == AS_OF[:7])
             .select(F.concat(F.lit("alert-low-"), F.col("user_id").cast("string")).alias("alert_id")).distinct())


@query("P12_filter_alerts", "P12", f"""
SELECT a.id, a.ca_id, a.priority FROM al a WHERE a.id NOT IN (SELECT alert_id FROM res) AND NOT a.resolved AND a.priority = 'high'
""", ctes=RESOLVED_CTE + ",\nal AS (" + _alerts_sql("calendar").strip() + ")")
def p12(spark, sf_dir):
    """Alert tab 'high': active (not resolved) high-priority alerts."""
    m = M(spark, sf_dir)
    a = W.client_alerts(m.users, m.invoices, AS_OF, "calendar")
    return W.filter_alerts(a, _resolved(m), "high").select("id", "ca_id", "priority")


@query("A25_alert_counts", "A25", f"""
SELECT a.ca_id, count_if(NOT r AND priority = 'high') AS high, count_if(NOT r AND priority = 'medium') AS medium,
  count_if(NOT r AND priority = 'low') AS low,
  count_if(NOT r) AS active, count_if(r) AS resolved
FROM (SELECT al.*, (al.id IN (SELECT alert_id FROM res)) OR al.resolved AS r FROM al) a GROUP BY a.ca_id
""", ctes=RESOLVED_CTE + ",\nal AS (" + _alerts_sql("calendar").strip() + ")")
def a25(spark, sf_dir):
    """Active alerts by priority and resolved alerts per CA."""
    m = M(spark, sf_dir)
    a = W.client_alerts(m.users, m.invoices, AS_OF, "calendar")
    return A.alert_counts(a, _resolved(m))


# ---------------------------------------------------------------- filing ----

REMIND_AS_OF = "2000-06-04"


@query("U2_deadline_messages", "U2,R4,J9,F4,F22,P8", f"""
SELECT u.id AS user_id, 'whatsapp:' || CASE WHEN u.phone LIKE '+%' THEN u.phone ELSE '+91' || u.phone END AS "to",
  CAST(round(coalesce(l.itc_available, 0), 2) AS DOUBLE) AS itc_balance, 'GSTR-1' AS kind, 7 AS days_left,
  '2000-06-11' AS deadline, 'notice' AS level,
  '📅 GSTR-1 Filing Reminder' || chr(10) || chr(10) || 'Deadline: 2000-06-11' || chr(10) || 'Sirf 7 din bacha hai!' || chr(10) || chr(10)
  || '💰 Aapka ITC this month: Rs.' || format('{{:,.2f}}', CAST(round(coalesce(l.itc_available, 0), 2) AS DOUBLE))
  || chr(10) || chr(10) || 'Apne CA se abhi contact karein.' || chr(10) || '{fixed.SIGNOFF}' AS body
FROM users u LEFT JOIN (SELECT * FROM ledger WHERE period = '{REMIND_AS_OF[:7]}') l ON l.user_id = u.id
WHERE u.phone IS NOT NULL AND u.phone <> ''
""")
def u2(spark, sf_dir):
    """Daily reminder job for 2000-06-04: GSTR-1 of May is due in 7 days."""
    m = M(spark, sf_dir)
    return FL.deadline_messages(m.users, m.ledger, REMIND_AS_OF, "calendar")


#: Days on which GSTR-3B of May (due 2000-06-20) is 7, 3 and 1 days away.
REMIND_3B = {"2000-06-13": 7, "2000-06-17": 3, "2000-06-19": 1}


def _remind_3b_sql() -> str:
    parts = []
    for as_of, days in REMIND_3B.items():
        text = fixed.REMINDER_GSTR3B.format(mark=fixed.URGENCY_MARK[days], date="2000-06-20", days=days, itc="\x00", signoff=fixed.SIGNOFF,
                                            tail=fixed.REMINDER_3B_TAIL.get(days, fixed.REMINDER_3B_TAIL_DEFAULT))
        head, tail = ("'" + x.replace("'", "''") + "'" for x in text.split("\x00"))
        level = {7: "notice", 3: "warning", 1: "urgent"}[days]
        parts.append(f"""
SELECT '{as_of}' AS as_of, u.id AS user_id, 'whatsapp:' || CASE WHEN u.phone LIKE '+%' THEN u.phone ELSE '+91' || u.phone END AS "to",
  CAST(round(coalesce(l.itc_available, 0), 2) AS DOUBLE) AS itc_balance, 'GSTR-3B' AS kind, {days} AS days_left,
  '2000-06-20' AS deadline, '{level}' AS level,
  {head} || format('{{:,.2f}}', CAST(round(coalesce(l.itc_available, 0), 2) AS DOUBLE)) || {tail} AS body
FROM users u LEFT JOIN (SELECT * FROM ledger WHERE period = '{as_of[:7]}') l ON l.user_id = u.id
WHERE u.phone IS NOT NULL AND u.phone <> ''""")
    return " UNION ALL ".join(parts)


@query("U2_deadline_messages_3b", "U2,R4,J9,F4,F22,P8", _remind_3b_sql())
def u2b(spark, sf_dir):
    """Daily reminder jobs on the days when GSTR-3B is due in 7, 3 and 1 days."""
    m, out = M(spark, sf_dir), None
    for as_of in REMIND_3B:
        r = FL.deadline_messages(m.users, m.ledger, as_of, "calendar").withColumn("as_of", F.lit(as_of))
        out = r if out is None else out.unionByName(r)
    return out


@query("F2_penalties", "F2", """
SELECT id, user_id, return_type, days_late, p AS penalty, i AS interest, round(p + i, 2) AS total,
  CASE WHEN days_late > 0 THEN CAST(days_late AS VARCHAR) || ' din late filing. Penalty: ₹' || CAST(p AS VARCHAR)
       || ' + Interest: ₹' || CASE WHEN due THEN CAST(i AS VARCHAR) ELSE '0' END END AS message_hi
FROM (SELECT *, CAST(CASE WHEN days_late <= 0 THEN 0
    WHEN return_type = 'GSTR-1' THEN least(days_late * 50, 10000)
    WHEN return_type = 'GSTR-3B' AND tax_liability > 0 THEN least(days_late * 50, 10000)
    WHEN return_type = 'GSTR-3B' THEN least(days_late * 20, 10000) ELSE 0 END AS INTEGER) AS p,
  CASE WHEN due THEN round(CAST(tax_liability AS DOUBLE) * 0.18 * days_late / 365, 2) ELSE 0.0 END AS i
  FROM (SELECT *, days_late > 0 AND return_type = 'GSTR-3B' AND tax_liability > 0 AS due FROM filings) f) t
""")
def f2(spark, sf_dir):
    """Late-fee and interest assessment of every filing."""
    return FL.assess_penalties(M(spark, sf_dir).filings)


@query("F3_filing_calendar", "F3", f"""
SELECT period, CAST(make_date(year(n), month(n), 11) AS VARCHAR) AS gstr1_deadline,
  CAST(make_date(year(n), month(n), 20) AS VARCHAR) AS gstr3b_deadline,
  CAST(date_diff('day', DATE '{AS_OF}', make_date(year(n), month(n), 11)) AS INTEGER) AS days_to_gstr1,
  CAST(date_diff('day', DATE '{AS_OF}', make_date(year(n), month(n), 20)) AS INTEGER) AS days_to_gstr3b
FROM (SELECT DISTINCT strftime(date, '%Y-%m') AS period, CAST(date_trunc('month', date) AS DATE) + INTERVAL 1 MONTH AS n
      FROM invoices WHERE date IS NOT NULL) t
""")
def f3(spark, sf_dir):
    """Deadlines of every month that has invoices, days left from the as-of date."""
    from ..functions.calendar import filing_calendar
    inv = M(spark, sf_dir).invoices
    periods = inv.filter(F.col("date").isNotNull()).select(C.ym("date").alias("period")).distinct()
    return filing_calendar(periods, AS_OF)


@query("F4_urgency", "F4", f"""
SELECT period, d, d IN (7, 3, 1) AS alert_due, CASE WHEN d = 1 THEN 'urgent' WHEN d = 3 THEN 'warning' ELSE 'notice' END AS level,
  CASE WHEN d <= 3 THEN 'red' WHEN d <= 7 THEN 'yellow' ELSE 'green' END AS chat
FROM (SELECT DISTINCT strftime(date, '%Y-%m') AS period,
  CAST(date_diff('day', DATE '2000-01-01', make_date(year(n), month(n), 20)) AS INTEGER) % 10 AS d
  FROM (SELECT date, CAST(date_trunc('month', date) AS DATE) + INTERVAL 1 MONTH AS n FROM invoices WHERE date IS NOT NULL) x) t
""")
def f4(spark, sf_dir):
    """Alert-day flag, level and chat light over a days-left column."""
    from ..functions import calendar as K
    inv = M(spark, sf_dir).invoices
    periods = inv.filter(F.col("date").isNotNull()).select(C.ym("date").alias("period")).distinct()
    cal = K.filing_calendar(periods, "2000-01-01")
    d = (F.col("days_to_gstr3b") % 10).cast("int")
    return cal.select("period", d.alias("d"), K.alert_due(d).alias("alert_due"), K.alert_level(d).alias("level"),
                      K.chat_urgency(d).alias("chat"))


@query("A7_gstr3b_document", "A7", f"""
SELECT t.user_id, u.gstin, t.period, substr(t.period, 6, 2) || substr(t.period, 1, 4) AS ret_period,
  'GSTR3B_' || u.gstin || '_' || substr(t.period, 6, 2) || substr(t.period, 1, 4) || '.json' AS file_name,
  t.total_invoices, t.total_taxable, t.eligible_itc, t.blocked_itc, round(t.el_igst, 2) AS itc_net_igst,
  round(t.intra, 2) AS isup_intra, 5 AS n_itc_avl
FROM (SELECT user_id, strftime(date, '%Y-%m') AS period, count(*) AS total_invoices,
        CAST(sum(taxable_amt) AS DOUBLE) AS total_taxable,
        CAST(sum(CASE WHEN b THEN 0 ELSE cgst + sgst + igst END) AS DOUBLE) AS eligible_itc,
        CAST(sum(CASE WHEN b THEN cgst + sgst + igst ELSE 0 END) AS DOUBLE) AS blocked_itc,
        CAST(sum(CASE WHEN b THEN 0 ELSE igst END) AS DOUBLE) AS el_igst,
        CAST(sum(CASE WHEN b THEN 0 ELSE cgst + sgst END) AS DOUBLE) AS intra
      FROM (SELECT *, {Q.blocked()} AS b FROM invoices WHERE status = 'confirmed' AND date IS NOT NULL) i GROUP BY 1, 2) t
JOIN users u ON u.id = t.user_id WHERE u.ca_id IS NOT NULL AND coalesce(u.gstin, '') <> ''
""")
def a7(spark, sf_dir):
    """GSTR-3B documents of every client with a GSTIN and every month (header fields + nested checks)."""
    m = M(spark, sf_dir)
    d = FL.gstr3b_document(m.invoices, m.users)
    return d.select("user_id", "gstin", "period", "ret_period", "file_name", "total_invoices", "total_taxable",
                    "eligible_itc", "blocked_itc", F.col("doc.itc_elg.itc_net.igst").alias("itc_net_igst"),
                    F.col("doc.inward_dtls.isup_details")[0]["intra"].alias("isup_intra"),
                    F.size("doc.itc_elg.itc_avl").alias("n_itc_avl"))


@query("A7_gstr3b_supplies", "A7", f"""
SELECT i.user_id, strftime(i.date, '%Y-%m') AS period, i.id AS invoice_id, i.invoice_no, i.seller_gstin AS supplier_gstin,
  coalesce(strftime(i.date, '%d-%m-%Y'), '') AS invoice_date, CAST(round(i.taxable_amt, 2) AS DOUBLE) AS taxable_value,
  CAST(round(i.igst, 2) AS DOUBLE) AS igst, CAST(round(i.cgst, 2) AS DOUBLE) AS cgst, CAST(round(i.sgst, 2) AS DOUBLE) AS sgst,
  {Q.cat('i.ai_category')} AS ai_category, round(coalesce(i.ai_confidence, 0.0), 2) AS ai_confidence,
  NOT {Q.blocked(c=Q.cat('i.ai_category'))} AS itc_eligible
FROM invoices i JOIN users u ON u.id = i.user_id
WHERE u.ca_id IS NOT NULL AND i.status = 'confirmed' AND i.date IS NOT NULL
""")
def a7s(spark, sf_dir):
    """Inward-supply lines of the GSTR-3B documents (a table beside the document)."""
    m = M(spark, sf_dir)
    return FL.gstr3b_supplies(m.invoices, m.users)


@query("F22_render_report", "F22,A11", f"""SELECT user_id, {_report_sql("'June 2000'")} AS report FROM rep""", ctes="rep AS (" + A11_SQL.strip() + ")")
def f22(spark, sf_dir):
    """Chat monthly-report text of every user (as of 2000-06-15)."""
    m = M(spark, sf_dir)
    return FL.render_report(A.monthly_report(m.invoices, m.ledger, m.users, AS_OF), AS_OF)


def _reminder_sql() -> str:
    pre, post = fixed.CLIENT_REMINDER.format(name="\x00", signoff=fixed.SIGNOFF).split("\x00")
    return f"""
SELECT u.id AS user_id, 'whatsapp:' || CASE WHEN u.phone LIKE '+%' THEN u.phone ELSE '+91' || u.phone END AS "to",
  'client_reminder' AS kind,
  '{pre}' || coalesce(nullif(u.business_name, ''), '{fixed.CLIENT_REMINDER_NAME_DEFAULT}') || '{post}' AS body
FROM cs JOIN users u ON u.id = cs.id
WHERE (cs.compliance_status = 'at-risk' OR cs.risk_score < 40) AND u.phone IS NOT NULL AND u.phone <> ''
"""


@query("S9_client_reminders", "S9,P13", _reminder_sql(), ctes=CLIENTS)
def s9r(spark, sf_dir):
    """The CA's reminder message to every at-risk client (outbox rows)."""
    from ..operators import invoices as I
    m = M(spark, sf_dir)
    return FL.client_reminders(I.at_risk(clients(m)), m.users)
