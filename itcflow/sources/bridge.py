"""Bridge views: the driver's TPC-H-like tables shaped into the GST model.

Each view is one SQL statement over the driver tables (or earlier views);
the Spark side binds DataFrames with ``spark.sql(sql, **frames)``, and the
DuckDB oracle renders the same text as common table expressions. The few
dialect differences are listed in ``_DUCK``.
"""

from __future__ import annotations

ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def chk_spark(g14: str, factors=(2, 3)) -> str:
    """GSTIN check character of a 14-char column expression (Spark SQL)."""
    a, b = factors
    # position i counts from the right (1 = last); odd i -> first factor
    fac = f"(CASE WHEN i % 2 = 1 THEN {a} ELSE {b} END)"
    val = f"((instr('{ALNUM}', substr({g14}, 15 - i, 1)) - 1) * {fac})"
    total = f"aggregate(transform(sequence(1, 14), i -> {val}), 0, (acc, v) -> acc + int(v div 36) + v % 36)"
    return f"substr('{ALNUM}', 1 + (36 - ({total}) % 36) % 36, 1)"


def chk_duck(g14: str, factors=(2, 3)) -> str:
    a, b = factors
    fac = f"(CASE WHEN i % 2 = 1 THEN {a} ELSE {b} END)"
    val = f"((strpos('{ALNUM}', substr({g14}, cast(15 - i as int), 1)) - 1) * {fac})"
    total = f"list_sum(list_transform(range(1, 15), lambda i: {val} // 36 + {val} % 36))"
    return f"substr('{ALNUM}', cast(1 + (36 - ({total}) % 36) % 36 as int), 1)"


USERS = ("""
SELECT c_custkey AS id,
  concat('9', lpad(cast(c_custkey as string), 9, '0')) AS phone,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS business_name,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE concat(lpad(cast(c_nationkey + 1 as string), 2, '0'), 'AACCU',
       lpad(cast(c_custkey % 10000 as string), 4, '0'), 'C1Z', substr('%(alnum)s', cast(c_custkey %% 36 + 1 as int), 1)) END AS gstin,
  CASE WHEN c_nationkey = 24 THEN '' ELSE lpad(cast(c_nationkey + 1 as string), 2, '0') END AS state_code,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE cast(c_custkey % 10 + 1 as int) END AS ca_id,
  cast(c_acctbal as decimal(18,2)) AS turnover_ytd
FROM {customer}
""").replace("%(alnum)s", ALNUM).replace("%%", "%")

SUPPLIER_G14 = """
SELECT s_suppkey, s_nationkey, concat(lpad(cast(s_nationkey + 1 as string), 2, '0'), 'AABC',
  substr('%s', cast(s_suppkey %% 26 + 1 as int), 1), lpad(cast(s_suppkey %% 10000 as string), 4, '0'),
  substr('%s', cast(s_suppkey %% 26 + 1 as int), 1), '1Z') AS g14
FROM {supplier}
""" % (ALPHA, ALPHA)

SUPPLIER_GSTIN = """
SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 = 3 THEN g14
  WHEN s_suppkey % 5 = 1 THEN concat(substr(g14, 1, 7), replace(substr(g14, 8, 4), '0', 'O'), substr(g14, 12, 3), chk)
  ELSE concat(g14, chk) END AS gstin
FROM (SELECT *, <CHK> AS chk FROM {supplier_g14}) t
"""

INVOICE_FIELDS = """
SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, o_custkey AS user_id,
  CASE WHEN l_linenumber = 6 THEN '' ELSE gstin END AS seller_gstin,
  CASE WHEN l_quantity = 1 THEN '' ELSE concat('INV/', cast(l_orderkey as string), '/', cast(l_linenumber as string)) END AS invoice_no,
  CASE WHEN l_quantity = 2 THEN NULL ELSE l_shipdate END AS date, o_orderdate AS created_at,
  round(cast(l_extendedprice as decimal(18,2)) * cast(1 - l_discount as decimal(4,2)) * (CASE WHEN l_quantity >= 49 THEN 5 ELSE 1 END), 2) AS taxable_amt,
  CASE WHEN c_nationkey = s_nationkey THEN round(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) * cast(0.5 as decimal(2,1)), 2) ELSE cast(0 as decimal(18,2)) END AS cgst,
  CASE WHEN c_nationkey = s_nationkey THEN round(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) * cast(0.5 as decimal(2,1)), 2) ELSE cast(0 as decimal(18,2)) END AS sgst,
  CASE WHEN c_nationkey <> s_nationkey THEN round(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)), 2) ELSE cast(0 as decimal(18,2)) END AS igst,
  CASE WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'pending' WHEN l_linenumber = 1 THEN 'blocked' ELSE 'rejected' END AS status,
  CASE p_type WHEN 'ECONOMY' THEN 'Food & Beverages' WHEN 'SMALL' THEN 'Electronics' WHEN 'MEDIUM' THEN 'Office'
       WHEN 'LARGE' THEN 'Personal Vehicle' WHEN 'PROMO' THEN 'Food' ELSE NULL END AS ai_category,
  cast(l_partkey % 100 as double) / 100 AS ai_confidence, p_name AS description
"""
INVOICES = INVOICE_FIELDS + """FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
  JOIN {supplier_gstin} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey
"""

TRANSACTIONS = """
SELECT o_custkey AS user_id, o_orderdate AS date, cast(o_totalprice as decimal(18,2)) AS amount,
  CASE WHEN o_orderkey % 3 = 0 THEN 'sale' WHEN o_orderkey % 3 = 1 THEN 'purchase' ELSE 'other' END AS type,
  CASE WHEN o_orderkey % 4 = 0 THEN 5 WHEN o_orderkey % 4 = 1 THEN 12 WHEN o_orderkey % 4 = 2 THEN 18 ELSE 28 END AS gst_rate,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS itc_eligible
FROM {orders}
"""

FILINGS = """
SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'GSTR-1' WHEN o_orderkey % 3 = 1 THEN 'GSTR-3B' ELSE 'GSTR-9' END AS return_type,
  cast(o_orderkey % 260 - 20 as int) AS days_late,
  CASE WHEN o_orderkey % 5 = 0 THEN cast(0 as decimal(18,2)) ELSE cast(o_totalprice as decimal(18,2)) END AS tax_liability
FROM {orders}
"""

BANK_CELLS = """
SELECT o_custkey AS statement_id, o_orderkey AS row_no,
  CASE WHEN o_custkey % 19 = 0 THEN ' ' WHEN o_orderkey % 3 = 1 THEN 'Page 2' WHEN o_custkey % 6 = 0 THEN 'HDFC Bank Ltd' WHEN o_custkey % 6 = 1 THEN 'State Bank of India'
       WHEN o_custkey % 6 = 2 THEN 'ICICI Bank' WHEN o_custkey % 6 = 3 THEN 'Axis Bank'
       WHEN o_custkey % 6 = 4 THEN 'Kotak Mahindra' ELSE 'Village Bank' END AS page_text,
  CASE WHEN o_custkey % 17 = 0 THEN array('Opening', 'balance') WHEN o_custkey % 12 = 6 THEN array('03/02/24', nar, dr, '7.50')
       WHEN o_custkey % 6 = 0 THEN array('03/02/2024', nar, '', '03/02/2024', dr, cr, '1,000.00')
       WHEN o_custkey % 6 = 1 THEN array('03 Feb 2024', '03 Feb 2024', nar, 'ref', dr, cr, '1,000.00')
       WHEN o_custkey % 6 = 2 THEN array('1', '03/02/2024', '03/02/2024', '', nar, dr, cr, '1,000.00')
       WHEN o_custkey % 6 = 3 THEN array('03-02-2024', nar, '', dr, cr, '1,000.00')
       WHEN o_custkey % 6 = 4 THEN array('03-02-2024', nar, dr, cr, '1,000.00')
       ELSE array('03/02/24', nar, dr, '7.50') END AS cells
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'NEFT rent' WHEN o_orderkey % 4 = 1 THEN concat('Vendor bill', chr(9))
                     WHEN o_orderkey % 4 = 2 THEN 'SWIGGY order' ELSE 'misc' END AS nar,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('₹', cast(cast(o_totalprice as decimal(18,2)) as string), ' Dr') END AS dr,
  CASE WHEN o_orderkey % 3 = 0 THEN cast(cast(o_totalprice as decimal(18,2)) as string) ELSE '' END AS cr FROM {orders}) t
"""

# replies of the extraction: some fenced, some broken off, some without a field, single fields null or missing
OCR_REPLIES = """
SELECT id, user_id, concat(CASE WHEN id % 2 = 0 THEN '```json' ELSE '' END, CASE WHEN id % 50 = 9 THEN '{{' ELSE concat(
  '{{"seller_gstin":"', seller_gstin, '","invoice_no":"', invoice_no,
  '","invoice_date":"', CASE WHEN id % 3 = 0 THEN '3-2-2024' WHEN id % 3 = 1 THEN '2024-02-03' ELSE 'n/a' END,
  '","taxable_amount":', CASE WHEN id % 11 = 0 THEN 'null' ELSE cast(cast(taxable_amt as decimal(18,2)) as string) END,
  ',"cgst":', cast(cgst as string), CASE WHEN id % 13 = 0 THEN '' ELSE concat(',"sgst":', cast(sgst as string)) END,
  ',"igst":', CASE WHEN igst = 0 THEN 'null' ELSE cast(igst as string) END,
  ',"total_amount":', CASE WHEN id % 7 = 0 THEN 'null' ELSE cast(cast(taxable_amt + cgst + sgst + igst as decimal(18,2)) as string) END,
  ',"description":', CASE WHEN id % 17 = 0 THEN 'null' WHEN id % 17 = 1 THEN '""' WHEN id % 17 = 2 THEN '"x"' WHEN id % 17 < 6 THEN '"Laptop and mouse"'
    WHEN id % 17 < 9 THEN '"Restaurant dinner"' ELSE concat('"', description, '"') END) END,
  CASE WHEN id % 50 = 7 THEN '' ELSE '}}' END, CASE WHEN id % 2 = 0 THEN '```' ELSE '' END) AS reply, created_at
FROM {invoices}
"""

MESSAGES = """
SELECT event_id, ts, concat('whatsapp:+919', lpad(cast(user_id as string), 9, '0')) AS sender, event_id % 4 = 0 AS has_photo,
  CASE event_type WHEN 'view' THEN 'summary' WHEN 'signup' THEN 'hello' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'edit total' ELSE 'edit date' END
       WHEN 'purchase' THEN 'yes' ELSE CASE WHEN event_id % 5 = 0 THEN 'Rs 1,200.50' ELSE 'no' END END AS body
FROM {events}
"""

# what the extraction read on the photo of a message
PHOTO_READS = """
SELECT event_id, concat('EV/', cast(event_id as string)) AS invoice_no,
  CASE WHEN event_id % 12 = 0 THEN '' WHEN event_id % 12 = 4 THEN '5-2-2000' ELSE '07/01/2000' END AS invoice_date,
  taxable AS taxable_amount, tax AS cgst, tax AS sgst, itax AS igst,
  CASE WHEN event_id % 28 = 0 THEN cast(0 as decimal(18,2)) ELSE cast(taxable + tax + tax + itax as decimal(18,2)) END AS total_amount,
  CASE WHEN event_id % 20 = 0 THEN 'Laptop and mouse' WHEN event_id % 20 = 4 THEN 'Restaurant dinner' WHEN event_id % 20 = 8 THEN ''
       WHEN event_id % 20 = 12 THEN 'Printer paper' ELSE 'Petrol' END AS description
FROM (SELECT event_id, cast(value as decimal(18,2)) AS taxable,
  CASE WHEN event_id % 8 = 0 THEN cast(round(cast(value as decimal(18,2)) * cast(0.09 as decimal(4,2)), 2) as decimal(18,2)) ELSE cast(0 as decimal(18,2)) END AS tax,
  CASE WHEN event_id % 8 = 4 AND event_id % 5 <> 0 THEN cast(round(cast(value as decimal(18,2)) * cast(0.18 as decimal(4,2)), 2) as decimal(18,2)) ELSE cast(0 as decimal(18,2)) END AS itax
  FROM {events} WHERE event_id % 4 = 0) t
"""

GSTR2B = """
SELECT user_id, <PERIOD> AS period, seller_gstin AS supplier_gstin, invoice_no,
  min(cgst + sgst + igst + CASE WHEN id % 13 = 0 THEN 100 ELSE 0 END) AS itc_amount,
  max(CASE WHEN id % 9 = 0 THEN 'not_filed' ELSE 'filed' END) AS filing_status
FROM {invoices} WHERE id % 10 < 8 AND date IS NOT NULL AND invoice_no <> '' GROUP BY 1, 2, 3, 4
"""

# corrections: two per invoice for every 34th id, one for the other 17ths.
CORRECTIONS = """
SELECT id AS invoice_id, k AS seq, CASE WHEN k = 1 THEN 'Other' ELSE 'Blocked' END AS category
FROM {invoices} <SEQ2> WHERE id % 17 = 0 AND (k = 1 OR id % 2 = 0)
"""

# review decisions: every 7th invoice approved; every 14th later rejected.
DECISIONS = """
SELECT id AS invoice_id, user_id, k AS seq, CASE WHEN k = 1 THEN 'approve' ELSE 'reject' END AS decision,
  <TS_PLUS_K_HOURS> AS ts
FROM {invoices} <SEQ2> WHERE id % 7 = 0 AND (k = 1 OR id % 14 = 0)
"""

PHOTO_METRICS = """
SELECT event_id AS image_id, value * 20 AS blur, cast(event_id % 256 as double) AS brightness,
  cast(600 + event_id % 800 as int) AS width, cast(400 + event_id % 700 as int) AS height
FROM {events}
"""

# zero-shot scores: every document scored against the 13 labels (k = 1..13).
ZERO_SHOT = """
SELECT doc_id, k, cast(((doc_id * 7 + k * 13) % 100) as double) / 100 AS score
FROM {documents} <SEQ13>
"""

# fine-tuned model scores: every document scored against the 8 categories (k = 1..8).
FINE_TUNED = """
SELECT doc_id, k, CASE k WHEN 1 THEN 'Food' WHEN 2 THEN 'Vehicle' WHEN 3 THEN 'Clothing' WHEN 4 THEN 'Electronics'
  WHEN 5 THEN 'Office' WHEN 6 THEN 'Pharma' WHEN 7 THEN 'Travel' ELSE 'Other' END AS label,
  cast(((doc_id * 11 + k * 17) % 100) as double) / 100 AS score
FROM {documents} <SEQ8>
"""

# saved-basis ledger: every saved invoice, month of save time (see build_ledger)
LEDGER = """
SELECT user_id, <CPERIOD> AS period, sum(taxable_amt) AS total_purchases,
  sum(CASE WHEN igst > 0 THEN igst ELSE cgst + sgst END) AS itc_available
FROM {invoices} GROUP BY 1, 2
"""

_SPARK = {
    "<CHK>": chk_spark("g14"),
    "<PERIOD>": "date_format(date, 'yyyy-MM')",
    "<CPERIOD>": "date_format(created_at, 'yyyy-MM')",
    "<SEQ2>": "LATERAL VIEW explode(sequence(1, 2)) s AS k",
    "<SEQ13>": "LATERAL VIEW explode(sequence(1, 13)) s AS k",
    "<SEQ8>": "LATERAL VIEW explode(sequence(1, 8)) s AS k",
    "<TS_PLUS_K_HOURS>": "created_at + make_interval(0, 0, 0, 0, k, 0, 0)",
}
_DUCK = {
    "<CHK>": chk_duck("g14"),
    "<PERIOD>": "strftime(date, '%Y-%m')",
    "<CPERIOD>": "strftime(created_at, '%Y-%m')",
    "<SEQ2>": ", (SELECT unnest(range(1, 3)) AS k) s",
    "<SEQ13>": ", (SELECT unnest(range(1, 14)) AS k) s",
    "<SEQ8>": ", (SELECT unnest(range(1, 9)) AS k) s",
    "<TS_PLUS_K_HOURS>": "created_at + to_hours(cast(k as bigint))",
    "array(": "list_value(",
}

# view name -> (sql, the frames it reads); dependency order.
VIEWS = {
    "users": (USERS, ["customer"]),
    "supplier_g14": (SUPPLIER_G14, ["supplier"]),
    "supplier_gstin": (SUPPLIER_GSTIN, ["supplier_g14"]),
    "invoices": (INVOICES, ["lineitem", "orders", "customer", "supplier_gstin", "part"]),
    "transactions": (TRANSACTIONS, ["orders"]),
    "filings": (FILINGS, ["orders"]),
    "bank_cells": (BANK_CELLS, ["orders"]),
    "ocr_replies": (OCR_REPLIES, ["invoices"]),
    "messages": (MESSAGES, ["events"]),
    "photo_reads": (PHOTO_READS, ["events"]),
    "gstr2b": (GSTR2B, ["invoices"]),
    "corrections": (CORRECTIONS, ["invoices"]),
    "decisions": (DECISIONS, ["invoices"]),
    "photo_metrics": (PHOTO_METRICS, ["events"]),
    "zero_shot": (ZERO_SHOT, ["documents"]),
    "fine_tuned": (FINE_TUNED, ["documents"]),
    "ledger": (LEDGER, ["invoices"]),
}


def render(sql: str, dialect: str) -> str:
    subs = _SPARK if dialect == "spark" else _DUCK
    for k, v in subs.items():
        sql = sql.replace(k, v)
    return sql


def duck_ctes() -> str:
    """All bridge views as DuckDB CTE definitions (without the WITH)."""
    parts = []
    for name, (sql, deps) in VIEWS.items():
        body = render(sql, "duck")
        for d in deps:
            body = body.replace("{" + d + "}", d)
        body = body.replace("{{", "{").replace("}}", "}")
        parts.append(f"{name} AS ({body.strip()})")
    return ",\n".join(parts)

