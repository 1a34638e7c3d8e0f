"""Reusable DuckDB oracle fragments (the SQL twin of the Spark operators)."""

from __future__ import annotations

from ..functions import core as C
from ..functions import fixed


def sql_list(xs) -> str:
    return "(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + ")"


def cat(c: str = "ai_category") -> str:
    return f"coalesce(nullif({c}, ''), 'General')"


def blocked(policy: str = "dashboard", c: str | None = None) -> str:
    return f"({c or cat()} IN {sql_list(C.blocked_list(policy))})"


def name_sql(u: str = "u") -> str:
    return f"coalesce(nullif({u}.business_name, ''), nullif({u}.phone, ''), 'Unknown')"


def view_cte(policy: str = "dashboard", name: str = "v", ca: int | None = None) -> str:
    """Invoice feed (P1 + J1 + J4) as a CTE."""
    where = "u.ca_id IS NOT NULL" + (f" AND u.ca_id = {ca}" if ca is not None else "")
    return f"""{name} AS (
  SELECT i.id, i.user_id, u.ca_id, {name_sql()} AS client_name,
    coalesce(i.invoice_no, '') AS invoice_no, i.date, coalesce(i.seller_gstin, '') AS supplier_gstin,
    coalesce(i.taxable_amt, 0) AS taxable_amt, coalesce(i.cgst, 0) AS cgst, coalesce(i.sgst, 0) AS sgst,
    coalesce(i.igst, 0) AS igst,
    coalesce(i.cgst, 0) + coalesce(i.sgst, 0) + coalesce(i.igst, 0) AS itc,
    coalesce(i.taxable_amt, 0) + coalesce(i.cgst, 0) + coalesce(i.sgst, 0) + coalesce(i.igst, 0) AS total,
    coalesce(nullif(i.status, ''), 'confirmed') AS status, {cat('i.ai_category')} AS ai_category,
    round(coalesce(i.ai_confidence, 0.0), 2) AS ai_confidence,
    NOT ({cat('i.ai_category')} IN {sql_list(C.blocked_list(policy))}) AS itc_eligible, i.created_at
  FROM invoices i JOIN users u ON i.user_id = u.id WHERE {where})"""


def counts_cte(name: str = "n") -> str:
    return f"{name} AS (SELECT user_id, count(*) AS c FROM invoices GROUP BY user_id)"


def clients_cte(period: str, name: str = "cs", all_users: bool = False) -> str:
    """Client summary (A4) as a CTE."""
    where = "" if all_users else "WHERE u.ca_id IS NOT NULL"
    itc = "coalesce(l.itc_available, 0)"
    n = "coalesce(n.c, 0)"
    sc = f"CAST(trunc(least({fixed.SCORE_CAP}.0, CAST({itc} AS DOUBLE) / {fixed.SCORE_ITC_UNIT} * 10 + {n} * {fixed.SCORE_PER_INVOICE})) AS INTEGER)"
    return f"""{counts_cte('n')},
{name} AS (
  SELECT u.ca_id, u.id, {name_sql()} AS name, coalesce(nullif(u.gstin, ''), '') AS gstin,
    coalesce(nullif(u.state_code, ''), '') AS state, coalesce(nullif(u.phone, ''), '') AS whatsapp,
    CAST({itc} AS DOUBLE) AS itc_this_month, {itc} AS itc_dec, {n} AS invoice_count,
    CASE WHEN {itc} > {fixed.COMPLIANT_ITC_ABOVE} THEN 'compliant' WHEN {itc} > 0 THEN 'attention' ELSE 'at-risk' END AS compliance_status,
    {sc} AS risk_score
  FROM users u LEFT JOIN (SELECT * FROM ledger WHERE period = '{period}') l ON l.user_id = u.id
  LEFT JOIN n ON n.user_id = u.id {where})"""


def risk_band(s: str) -> str:
    return f"CASE WHEN {s} < {fixed.RISK_HIGH_BELOW} THEN 'high' WHEN {s} < {fixed.RISK_MEDIUM_BELOW} THEN 'medium' ELSE 'low' END"


def values_cte(name: str, cols: str, rows) -> str:
    """A small literal dimension as a VALUES CTE."""
    def lit(x):
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, (int, float)):
            return str(x)
        return "'" + str(x).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


def catmap_cte() -> str:
    return values_cte("catmap", "category, blocked, reason", fixed.CATEGORY_MAP)


def labels_cte() -> str:
    return values_cte("lab13", "k, label, category",
                      [(i + 1, lab, cat) for i, (lab, cat) in enumerate(fixed.ZERO_SHOT_LABELS)])


def states_cte() -> str:
    return values_cte("states", "code, name", list(fixed.STATE_CODES.items()))


def kw_category(low: str) -> str:
    from ..functions.keywords import sql_first_group
    return sql_first_group(low, fixed.KEYWORD_RULES, "Other")


def kw_matched(low: str, cat: str) -> str:
    """Keywords of the winning group found in ``low``, comma-joined."""
    whens = []
    for label, words in fixed.KEYWORD_RULES:
        lst = "[" + ", ".join("'" + w + "'" for w in words) + "]"
        whens.append(f"WHEN {cat} = '{label}' THEN array_to_string(list_filter({lst}, lambda kk: contains({low}, kk)), ',')")
    return "CASE " + " ".join(whens) + " ELSE '' END"


def clean_amount(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL ELSE TRY_CAST(trim(replace(replace("
            f"regexp_replace({c}, '[₹,\\s]', '', 'g'), 'Dr', ''), 'Cr', '')) AS DOUBLE) END")


def inr_text(x: str) -> str:
    """DuckDB twin of core.inr_text."""
    d = f"CAST({x} AS DECIMAL(20,2))"
    ip = f"CAST(CAST(floor({d}) AS BIGINT) AS VARCHAR)"
    fr = f"regexp_replace(lpad(CAST(CAST(({d} - floor({d})) * 100 AS INTEGER) AS VARCHAR), 2, '0'), '0+$', '')"
    head = f"substr({ip}, 1, length({ip}) - 3)"
    tail = f"substr({ip}, length({ip}) - 2, 3)"
    pairs = f"regexp_replace(reverse(regexp_replace(reverse({head}), '(\\d\\d)', '\\1,', 'g')), '^,', '')"
    whole = f"CASE WHEN length({ip}) <= 3 THEN {ip} ELSE {pairs} || ',' || {tail} END"
    return f"('₹' || {whole} || CASE WHEN {fr} = '' THEN '' ELSE '.' || {fr} END)"
