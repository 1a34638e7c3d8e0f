"""Registered queries: classification, bank statements, ingest, GSTIN quality,
data preparation and sinks (SURVEY §2.1, §2.3, §2.8, §2.10)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import core as C
from ..functions import fixed
from ..functions import text as X
from ..operators import bank as B
from ..operators import classify as CL
from ..operators import filing as FL
from ..operators import ingest as IN
from ..operators.invoices import latest_by
from ..session import shared_dir
from ..sources.tables import in_slice, slices, spread, staged, staged_slices
from . import sqlbits as Q
from .catalog_core import M, feed
from .registry import query

D = C.to_double


def _kw_sql(src: str, key: str, text: str) -> str:
    """DuckDB twin of classify_keywords over ``src``."""
    return f"""
SELECT t.{key} AS doc_id, t.category, CAST(CASE WHEN t.category <> 'Other' THEN 0.85 ELSE 0.60 END AS DOUBLE) AS confidence,
  c.blocked, CASE WHEN t.category <> 'Other' THEN c.reason || ' (keyword match)' ELSE '{fixed.UNCLASSIFIED_REASON}' END AS reason,
  {Q.kw_matched('t.low', 't.category')} AS keywords
FROM (SELECT {key}, low, {Q.kw_category('low')} AS category FROM (SELECT {key}, lower({text}) AS low FROM {src}) s) t
JOIN catmap c ON c.category = t.category
"""


def _kw_spark(df, key, text):
    r = CL.classify_keywords(df.select(F.col(key).alias("doc_id"), F.col(text).alias("description")), "description")
    return r.select("doc_id", "category", "confidence", "blocked", "reason",
                    F.array_join("matched_keywords", ",").alias("keywords"))


# ------------------------------------------------------- classification ----

@query("F8_classify_part_names", "F8,J6", _kw_sql("part", "p_partkey", "p_name"), ctes=Q.catmap_cte())
def f8p(spark, sf_dir):
    """Keyword classification of every part name (the invoice descriptions)."""
    return _kw_spark(M(spark, sf_dir).part, "p_partkey", "p_name")


@query("F8_classify_documents", "F8,J6", _kw_sql("documents", "doc_id", "text"), ctes=Q.catmap_cte())
def f8d(spark, sf_dir):
    """Keyword classification of whole document texts (long-text substring traffic)."""
    return _kw_spark(spread(M(spark, sf_dir).documents.select("doc_id", "text")), "doc_id", "text")


_LAYERED_CTES = Q.catmap_cte() + ",\n" + Q.labels_cte() + f""",
kw AS (SELECT doc_id, text, lower(text) AS low, {Q.kw_category('lower(text)')} AS kw_cat FROM documents),
zs AS (SELECT z.doc_id, arg_max(l.category, round(z.score * 100) * 100 - z.k) AS zs_category, round(max(z.score), 3) AS zs_conf
       FROM zero_shot z JOIN lab13 l ON l.k = z.k GROUP BY 1),
ft AS (SELECT doc_id, arg_max(label, round(score * 100) * 100 - k) AS ft_cat, round(max(score), 3) AS ft_conf FROM fine_tuned GROUP BY 1),
lay AS (SELECT kw.doc_id, kw.low,
  CASE WHEN kw.text IS NULL OR length(trim(kw.text)) < 3 THEN 'none' WHEN kw_cat <> 'Other' THEN 'keyword'
       WHEN zs_category IS NOT NULL AND zs_category <> 'Other' THEN 'zero_shot' WHEN ft_cat IS NOT NULL THEN 'fine_tuned'
       ELSE 'fallback' END AS layer, kw_cat, zs_category, zs_conf, ft_cat, ft_conf
  FROM kw LEFT JOIN zs ON zs.doc_id = kw.doc_id LEFT JOIN ft ON ft.doc_id = kw.doc_id),
res AS (SELECT doc_id, low, layer,
  CASE layer WHEN 'none' THEN 'Other' WHEN 'keyword' THEN kw_cat WHEN 'zero_shot' THEN zs_category WHEN 'fine_tuned' THEN ft_cat ELSE 'Other' END AS category,
  CAST(CASE layer WHEN 'none' THEN 0.0 WHEN 'keyword' THEN 0.85 WHEN 'zero_shot' THEN zs_conf WHEN 'fine_tuned' THEN ft_conf ELSE 0.5 END AS DOUBLE) AS confidence
  FROM lay)"""


@query("F9_classify_layered", "F9,F10,J17", f"""
SELECT r.doc_id, r.layer, r.category, r.confidence,
  CASE WHEN r.layer IN ('none', 'fallback') THEN false ELSE coalesce(c.blocked, false) END AS blocked,
  CASE r.layer WHEN 'none' THEN '{fixed.NO_DESCRIPTION_REASON}' WHEN 'keyword' THEN c.reason || ' (keyword match)'
       WHEN 'fallback' THEN '{fixed.UNCLASSIFIED_REASON}' ELSE coalesce(c.reason, 'Verify manually') END AS reason,
  CASE WHEN r.layer = 'keyword' THEN {Q.kw_matched('r.low', 'r.category')} ELSE '' END AS keywords
FROM res r LEFT JOIN catmap c ON c.category = r.category
""", ctes=_LAYERED_CTES)
def f9(spark, sf_dir):
    """Layered classification of documents: keywords, else zero-shot scores, else fine-tuned scores."""
    m = M(spark, sf_dir)
    r = CL.classify_layered(m.documents.select("doc_id", "text"), "text", m.zero_shot, m.fine_tuned)
    return r.select("doc_id", "layer", "category", "confidence", "blocked", "reason",
                    F.array_join("matched_keywords", ",").alias("keywords"))


@query("F1_itc_amounts", "F1", f"""
SELECT id, CAST(coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst, 0) AS DOUBLE) AS itc_total,
  CAST(CASE WHEN coalesce(igst, 0) > 0 THEN igst ELSE coalesce(cgst, 0) + coalesce(sgst, 0) END AS DOUBLE) AS itc_exclusive,
  {Q.blocked()} AS blocked,
  CAST(CASE WHEN {Q.blocked()} THEN 0 ELSE CASE WHEN coalesce(igst, 0) > 0 THEN igst ELSE coalesce(cgst, 0) + coalesce(sgst, 0) END END AS DOUBLE) AS itc_eligible_amt,
  CAST(CASE WHEN {Q.blocked()} THEN CASE WHEN coalesce(igst, 0) > 0 THEN igst ELSE coalesce(cgst, 0) + coalesce(sgst, 0) END ELSE 0 END AS DOUBLE) AS itc_blocked_amt
FROM invoices
""")
def f1(spark, sf_dir):
    """Both ITC formulas per invoice and the eligible/blocked split (dashboard policy)."""
    inv = M(spark, sf_dir).invoices
    b = C.is_blocked(C.category(), "dashboard")
    ex = C.itc_exclusive()
    z = F.lit(0).cast(C.MONEY)
    return inv.select("id", D(C.itc_total()).alias("itc_total"), D(ex).alias("itc_exclusive"), b.alias("blocked"),
                      D(F.when(b, z).otherwise(ex)).alias("itc_eligible_amt"),
                      D(F.when(b, ex).otherwise(z)).alias("itc_blocked_amt"))


@query("F10_top_label", "F10,J17", """
SELECT z.doc_id, arg_max(l.label, round(z.score * 100) * 100 - z.k) AS top_label, max(z.score) AS top_score,
  arg_max(l.category, round(z.score * 100) * 100 - z.k) AS zs_category,
  string_agg(CASE WHEN z.rn <= 3 THEN l.label || '=' || CAST(round(z.score, 3) AS VARCHAR) END, ';' ORDER BY z.rn) AS top3
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS rn FROM zero_shot) z
JOIN lab13 l ON l.k = z.k GROUP BY 1
""", ctes=Q.labels_cte())
def f10(spark, sf_dir):
    """Top zero-shot label per document and its category."""
    m = M(spark, sf_dir)
    return CL.zero_shot_top(m.zero_shot, spark).select("doc_id", "top_label", "top_score", "zs_category", "top3")


@query("F11_classify_invoices", "F11,F1", f"""
SELECT i.id, i.category, CAST(CASE WHEN i.category <> 'Other' THEN 0.85 ELSE 0.5 END AS DOUBLE) AS confidence,
  CASE WHEN i.category <> 'Other' THEN 'keyword' ELSE 'fallback' END AS layer,
  CASE WHEN i.category <> 'Other' THEN c.blocked ELSE false END AS blocked,
  CAST(round(CASE WHEN i.igst > 0 THEN i.igst ELSE i.cgst + i.sgst END, 2) AS DOUBLE) AS total_tax,
  CAST(CASE WHEN i.category <> 'Other' AND c.blocked THEN 0 ELSE CASE WHEN i.igst > 0 THEN i.igst ELSE i.cgst + i.sgst END END AS DOUBLE) AS itc_eligible,
  CAST(CASE WHEN i.category <> 'Other' AND c.blocked THEN CASE WHEN i.igst > 0 THEN i.igst ELSE i.cgst + i.sgst END ELSE 0 END AS DOUBLE) AS itc_blocked
FROM (SELECT *, {Q.kw_category("lower(coalesce(nullif(description, ''), 'Business purchase invoice'))")} AS category
      FROM invoices) i JOIN catmap c ON c.category = i.category
""", ctes=Q.catmap_cte())
def f11(spark, sf_dir):
    """Classify every invoice description and split its ITC into eligible/blocked."""
    r = CL.classify_invoices(M(spark, sf_dir).invoices)
    return r.select("id", "category", "confidence", "layer", "blocked", "total_tax", "itc_eligible", "itc_blocked")


@query("J6_with_category", "J6", """
SELECT d.ai_category, coalesce(c.blocked, false) AS blocked, coalesce(c.reason, 'Verify manually') AS reason
FROM (SELECT DISTINCT ai_category FROM invoices WHERE ai_category IS NOT NULL) d LEFT JOIN catmap c ON c.category = d.ai_category
""", ctes=Q.catmap_cte())
def j6(spark, sf_dir):
    """Category dimension join (blocked flag, reason) over the invoice categories."""
    cats = M(spark, sf_dir).invoices.select("ai_category").filter(F.col("ai_category").isNotNull()).distinct()
    return CL.with_category(cats, "ai_category").select("ai_category", "blocked", "reason")


TRUTH_CTE = f"""pt AS (SELECT c.invoice_id AS doc_id, c.category AS label, i.predicted
  FROM (SELECT invoice_id, arg_max(category, seq) AS category FROM corrections GROUP BY 1) c
  JOIN (SELECT DISTINCT id, {Q.kw_category("lower(coalesce(nullif(description, ''), 'Business purchase invoice'))")} AS predicted
        FROM invoices) i ON i.id = c.invoice_id)"""


@query("A28_model_agreement", "A28", """
SELECT label, count(*) AS n, count_if(predicted = label) AS correct, count_if(predicted = label) / count(*) AS accuracy
FROM pt GROUP BY 1
""", ctes=TRUTH_CTE)
def a28(spark, sf_dir):
    """Agreement of predictions with accepted labels per label."""
    t, p = _truth_pred(spark, sf_dir)
    from ..operators.aggregates import model_agreement
    return model_agreement(p, t)


def _truth_pred(spark, sf_dir):
    """Accepted label = the latest correction of an invoice; prediction = the
    layered classifier's category of its description (F9, F11)."""
    m = M(spark, sf_dir)
    from ..operators.invoices import latest_by
    truth = latest_by(m.corrections, "invoice_id", ["seq"], ["category"]).toDF("doc_id", "label")
    pred = CL.classify_invoices(m.invoices).select(F.col("id").alias("doc_id"), F.col("category").alias("predicted")).distinct()
    return truth, pred


@query("A28_confusion_counts", "A28", """
SELECT label, predicted, count(*) AS n FROM pt GROUP BY 1, 2
""", ctes=TRUTH_CTE)
def a28c(spark, sf_dir):
    """Confusion counts (accepted label, predicted label)."""
    t, p = _truth_pred(spark, sf_dir)
    from ..operators.aggregates import confusion_counts
    return confusion_counts(p, t)


@query("A31_rule_coverage", "A31", f"""
SELECT category, keyword, count(*) AS n FROM (
  SELECT category, unnest(string_split(keywords, ',')) AS keyword FROM ({_kw_sql('documents', 'doc_id', 'text')}) k
  WHERE keywords <> '') t GROUP BY 1, 2
""", ctes=Q.catmap_cte())
def a31(spark, sf_dir):
    """How often each keyword of the winning group fired over all documents."""
    d = M(spark, sf_dir).documents.select(F.col("doc_id"), F.col("text").alias("description"))
    return CL.rule_coverage(CL.classify_keywords(d, "description"))


# ------------------------------------------------------------------ bank ----

def _bank_sql() -> str:
    """DuckDB twin of normalise_statements + categorise."""
    def cell(i):
        return f"coalesce(tc[{i + 1}], '')"
    parts = []
    for bank, mn, dcs, tx, de, cr, ba, rx, hdr in fixed.BANK_LAYOUTS:
        date = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({cell(i)}, '{rx}') THEN {cell(i)} END" for i in dcs) + ", NULL)"
        d, c, b = Q.clean_amount(cell(de)), Q.clean_amount(cell(cr)), Q.clean_amount(cell(ba))
        parts.append(f"""SELECT statement_id, row_no, date, description, debit, credit, balance,
  CASE WHEN debit IS NOT NULL AND debit <> 0 THEN 'debit' ELSE 'credit' END AS type,
  CASE WHEN debit IS NOT NULL AND debit <> 0 THEN debit WHEN credit IS NOT NULL AND credit <> 0 THEN credit ELSE 0.0 END AS amount,
  '{bank}' AS bank
FROM (SELECT statement_id, row_no, {date} AS date, {cell(tx)} AS description, {d} AS debit, {c} AS credit, {b} AS balance
      FROM nc WHERE bank = '{bank}' AND len(tc) >= {mn}) x
WHERE date IS NOT NULL AND description <> '' AND lower(description) NOT IN {Q.sql_list(hdr)}""")
    grx = fixed.GENERIC_DATE_REGEX
    gdate = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({cell(i)}, '{grx}') THEN {cell(i)} END" for i in range(3)) + ")"
    generic = f"""SELECT statement_id, row_no, date, description, amts[1] AS debit, amts[2] AS credit,
  CASE WHEN len(amts) > 2 THEN amts[-1] END AS balance, 'debit' AS type, amts[1] AS amount, bank
FROM (SELECT statement_id, row_no, bank, {gdate} AS date,
        list_filter(list_transform(tc, lambda cc: {Q.clean_amount('cc')}), lambda a: a IS NOT NULL AND a > 0 AND NOT isnan(a)) AS amts,
        substr(array_to_string(list_filter(tc[2:4], lambda cc: cc <> '' AND NOT regexp_matches(cc, '{grx}')), ' '), 1, 100) AS description
      FROM nc WHERE len(tc) >= 3) x WHERE date IS NOT NULL AND len(amts) > 0"""
    detect = "CASE " + " ".join("WHEN (" + " OR ".join(f"contains(low, '{w}')" for w in ws)
                                + f") THEN '{b}'" for b, ws in fixed.BANK_DETECTION) + " ELSE 'GENERIC' END"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
    cat = "CASE " + " ".join("WHEN (" + " OR ".join(f"contains(lower(description), '{w}')" for w in ws) + f") THEN '{c}'"
                             for c, ws in fixed.BANK_CATEGORIES) + " ELSE 'other' END"
    return f"""bk AS (SELECT statement_id, {detect} AS bank, trim(low, {blank}) <> '' AS has_text FROM (
  SELECT statement_id, lower(string_agg(coalesce(page_text, ''), chr(10))) AS low FROM bank_cells GROUP BY 1) p),
nc AS (SELECT c.statement_id, row_no, list_transform(cells, lambda cc: coalesce(trim(cc, {blank}), '')) AS tc, bank
  FROM bank_cells c JOIN bk ON bk.statement_id = c.statement_id),
sp AS ({" UNION ALL ".join(parts)}),
ge AS ({generic}),
tx0 AS (SELECT * FROM sp UNION ALL SELECT * FROM ge WHERE statement_id NOT IN (SELECT statement_id FROM sp)),
tx AS (SELECT *, {cat} AS category, ({cat}) IN {Q.sql_list(fixed.BANK_ITC_CATEGORIES)} AS itc_possible FROM tx0)"""


BANK_CTES = _bank_sql()


def _txns(spark, sf_dir):
    return B.statement_transactions(M(spark, sf_dir).bank_cells)


@query("U3_F14_F15_F16_statement_transactions", "U3,F12,F14,F15,F16", """
SELECT statement_id, row_no, date, description, debit, credit, balance, type, amount, bank, category, itc_possible
FROM tx
""", ctes=BANK_CTES)
def u3(spark, sf_dir):
    """Statement rows by bank layout, generic fallback, narration category."""
    return _txns(spark, sf_dir).drop("needs_invoice")


@query("F12_detect_bank", "F12", """
SELECT statement_id, bank, has_text FROM bk
""", ctes=BANK_CTES)
def f12(spark, sf_dir):
    """Bank of every statement from the texts of all its pages."""
    return B.detect_banks(M(spark, sf_dir).bank_cells)


@query("F15_extract_generic", "F15", """
SELECT * FROM ge
""", ctes=BANK_CTES)
def f15(spark, sf_dir):
    """Generic layout extraction over every statement row."""
    return B.extract_generic(B.normalise_cells(M(spark, sf_dir).bank_cells))


@query("A12_statement_summary", "A12", """
SELECT b.statement_id, b.bank, count(t.row_no) AS total_transactions,
  CAST(coalesce(sum(CAST(coalesce(debit, 0) AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_debit,
  CAST(coalesce(sum(CAST(coalesce(credit, 0) AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_credit,
  coalesce(count_if(itc_possible), 0) AS itc_possible_count, coalesce(count_if(category = 'purchase'), 0) AS purchase_count,
  coalesce(count_if(category = 'salary'), 0) AS salary_count, coalesce(count_if(category = 'travel'), 0) AS travel_count,
  coalesce(count_if(category = 'food'), 0) AS food_count
FROM bk b LEFT JOIN tx t ON t.statement_id = b.statement_id WHERE b.has_text GROUP BY b.statement_id, b.bank
""", ctes=BANK_CTES)
def a12(spark, sf_dir):
    """Per statement: transactions, debit/credit totals, ITC-possible and category counts."""
    return B.statement_summary(_txns(spark, sf_dir), M(spark, sf_dir).bank_cells)


@query("U3_unreadable_statements", "U3", """
SELECT statement_id, 'Could not extract text from PDF. May be scanned/image PDF.' AS error FROM bk WHERE NOT has_text
""", ctes=BANK_CTES)
def u3e(spark, sf_dir):
    """Statements whose pages have no text: the failure row."""
    return B.unreadable_statements(M(spark, sf_dir).bank_cells)


@query("T6_P15_itc_rows_head", "T6,P15", """
SELECT statement_id, rank, row_no, date, substr(description, 1, 30) AS text, amount, format('{:,.0f}', amount) AS amount_text
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY row_no) AS INTEGER) AS rank FROM tx WHERE itc_possible) t
WHERE rank <= 5
""", ctes=BANK_CTES)
def t6(spark, sf_dir):
    """First 5 ITC-possible rows of each statement."""
    return B.itc_rows_head(_txns(spark, sf_dir))


@query("F13_F20_clean_amounts", "F13,F20", f"""
SELECT statement_id, row_no, pos, cell, {Q.clean_amount('cell')} AS amount,
  TRY_CAST(trim(replace(replace(replace(cell, 'rs', ''), 'Rs', ''), ',', '')) AS DOUBLE) AS edited
FROM (SELECT statement_id, row_no, CAST(unnest(range(1, len(cells) + 1)) AS INTEGER) AS pos, unnest(cells) AS cell FROM bank_cells) t
""")
def f13(spark, sf_dir):
    """Amount cleaning of every statement cell (statement and chat-edit rules)."""
    c = M(spark, sf_dir).bank_cells
    e = c.select("statement_id", "row_no", F.posexplode("cells").alias("p", "cell"))
    return e.select("statement_id", "row_no", (F.col("p") + 1).alias("pos"), "cell",
                    X.clean_amount(F.col("cell")).alias("amount"), X.clean_edit_amount(F.col("cell")).alias("edited"))


# ---------------------------------------------------------------- ingest ----

OCR_CTE = """ocr AS (SELECT id, user_id, created_at, raw, json_valid(raw) AS ok FROM (
  SELECT id, user_id, created_at, trim(replace(replace(reply, '```json', ''), '```', '')) AS raw FROM ocr_replies) t),
parsed AS (SELECT id, user_id, created_at, NOT ok AS parse_error,
  CASE WHEN ok THEN json_extract_string(raw, '$.seller_gstin') END AS seller_gstin,
  CASE WHEN ok THEN json_extract_string(raw, '$.invoice_no') END AS invoice_no,
  CASE WHEN ok THEN json_extract_string(raw, '$.invoice_date') END AS invoice_date,
  CASE WHEN ok THEN TRY_CAST(json_extract(raw, '$.taxable_amount') AS DOUBLE) END AS taxable_amount,
  CASE WHEN ok THEN TRY_CAST(json_extract(raw, '$.cgst') AS DOUBLE) END AS cgst,
  CASE WHEN ok THEN TRY_CAST(json_extract(raw, '$.sgst') AS DOUBLE) END AS sgst,
  CASE WHEN ok THEN TRY_CAST(json_extract(raw, '$.igst') AS DOUBLE) END AS igst,
  CASE WHEN ok THEN TRY_CAST(json_extract(raw, '$.total_amount') AS DOUBLE) END AS total_amount,
  CASE WHEN ok THEN json_extract_string(raw, '$.description') END AS description
  FROM ocr),
filled AS (SELECT *, CASE WHEN parse_error THEN 0 ELSE
  CAST(seller_gstin IS NOT NULL AS INT) + CAST(invoice_no IS NOT NULL AS INT) + CAST(invoice_date IS NOT NULL AS INT)
  + CAST(taxable_amount IS NOT NULL AS INT) + CAST(cgst IS NOT NULL AS INT) + CAST(sgst IS NOT NULL AS INT)
  + CAST(igst IS NOT NULL AS INT) + CAST(total_amount IS NOT NULL AS INT) + CAST(description IS NOT NULL AS INT) END AS filled_count
  FROM parsed)"""


def _parsed(spark, sf_dir):
    return IN.read_ocr_replies(M(spark, sf_dir).ocr_replies)


@query("S4_ocr_replies", "S4", """
SELECT id, parse_error, seller_gstin, invoice_no, invoice_date, taxable_amount, cgst, sgst, igst, total_amount, description, filled_count FROM filled
""", ctes=OCR_CTE)
def s4(spark, sf_dir):
    """Parse every OCR reply: fences stripped, fixed schema, parse errors flagged."""
    p = _parsed(spark, sf_dir)
    return p.select("id", "parse_error", *fixed.OCR_FIELDS, "filled_count")


@query("P16_split_ocr", "P16", """
SELECT id, CASE WHEN parse_error THEN 'parse_error' ELSE 'empty' END AS reason FROM filled
WHERE parse_error OR filled_count = 0
""", ctes=OCR_CTE)
def p16(spark, sf_dir):
    """Replies to retry: unparseable or with no field filled."""
    _, retry = IN.split_ocr(_parsed(spark, sf_dir))
    return retry.select("id", F.when(F.col("parse_error"), "parse_error").otherwise("empty").alias("reason"))


@query("A27_ocr_quality", "A27", """
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS replies, count_if(parse_error) AS parse_errors,
  CAST(sum(CASE WHEN NOT parse_error THEN filled_count ELSE 0 END) AS BIGINT) AS filled_fields,
  count_if(NOT parse_error AND filled_count = 0) AS needs_confirmation,
  count_if(NOT parse_error AND filled_count > 0) AS confident,
  avg(CASE WHEN NOT parse_error THEN CASE WHEN filled_count > 0 THEN 0.93 ELSE 0.0 END END) AS mean_confidence
FROM filled GROUP BY 1
""", ctes=OCR_CTE)
def a27(spark, sf_dir):
    """OCR extraction quality per day of receipt."""
    from ..operators.aggregates import ocr_quality
    return ocr_quality(_parsed(spark, sf_dir))


@query("F18_F19_to_invoices", "F18,F19", """
SELECT user_id, CASE WHEN substr(coalesce(seller_gstin, ''), 1, 15) = '' THEN NULL ELSE substr(seller_gstin, 1, 15) END AS seller_gstin,
  CASE WHEN substr(coalesce(invoice_no, ''), 1, 100) = '' THEN NULL ELSE substr(invoice_no, 1, 100) END AS invoice_no,
  strftime(CASE WHEN coalesce(invoice_date, '') = '' THEN NULL ELSE coalesce(try_strptime(invoice_date, '%d-%m-%Y'),
    try_strptime(invoice_date, '%d/%m/%Y'), try_strptime(invoice_date, '%Y-%m-%d')) END, '%Y-%m-%d') AS date,
  CASE WHEN taxable_amount IS NULL OR taxable_amount = 0 THEN 0.0 ELSE taxable_amount END AS taxable_amt,
  CASE WHEN cgst IS NULL OR cgst = 0 THEN 0.0 ELSE cgst END AS cgst,
  CASE WHEN sgst IS NULL OR sgst = 0 THEN 0.0 ELSE sgst END AS sgst,
  CASE WHEN igst IS NULL OR igst = 0 THEN 0.0 ELSE igst END AS igst, 'pending' AS status
FROM filled WHERE NOT parse_error
""", ctes=OCR_CTE)
def f19(spark, sf_dir):
    """Parsed replies -> invoice rows (date by three formats, defaults, pending)."""
    p = _parsed(spark, sf_dir).filter(~F.col("parse_error"))
    r = IN.to_invoices(p)
    return r.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("J5_find_duplicates", "J5", """
SELECT n.id AS req_id, d.id IS NOT NULL AS is_duplicate, d.id AS existing_id,
  CASE WHEN d.id IS NULL THEN NULL ELSE coalesce(strftime(d.date, '%d-%m-%Y'), 'unknown date') END AS existing_date,
  CAST(round(d.cgst + d.sgst + d.igst, 2) AS DOUBLE) AS existing_total
FROM (SELECT f.id, CASE WHEN f.no = '' THEN NULL WHEN f.g <> '' THEN s3.m ELSE s2.m END AS inc FROM
        (SELECT id, user_id, trim(coalesce(invoice_no, '')) AS no, trim(coalesce(seller_gstin, '')) AS g FROM filled WHERE NOT parse_error) f
        LEFT JOIN (SELECT user_id, invoice_no, seller_gstin, min(id) AS m FROM invoices GROUP BY 1, 2, 3) s3
          ON s3.user_id = f.user_id AND s3.invoice_no = f.no AND s3.seller_gstin = f.g
        LEFT JOIN (SELECT user_id, invoice_no, min(id) AS m FROM invoices GROUP BY 1, 2) s2
          ON s2.user_id = f.user_id AND s2.invoice_no = f.no) n
LEFT JOIN (SELECT * FROM invoices QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(strftime(date, '%d-%m-%Y'), 'unknown date'),
           round(cgst + sgst + igst, 2)) = 1) d ON d.id = n.inc
""", ctes=OCR_CTE)
def j5(spark, sf_dir):
    """Incoming (parsed) invoices checked against the stored ones, large tables in slices of users."""
    m = M(spark, sf_dir).stage("invoices", "id", "user_id", "seller_gstin", "invoice_no", "date", "taxable_amt", "cgst", "sgst", "igst",
                               "description", "created_at")
    p = IN.read_ocr_replies(m.ocr_replies).filter(~F.col("parse_error"))
    p = staged(p.select(F.col("id").alias("req_id"), "user_id", "invoice_no", "seller_gstin"), "parsed")
    n = slices(m.invoices)
    if n == 1:
        return IN.find_duplicates(p, m.invoices)
    return staged_slices((IN.find_duplicates(*[df.filter(in_slice("user_id", i, n)) for df in (p, m.invoices)]) for i in range(n)), "found")


@query("J12_apply_corrections", "J12,W7", """
SELECT i.id, coalesce(c.category, i.ai_category) AS ai_category, c.category IS NOT NULL AS user_corrected
FROM invoices i LEFT JOIN (SELECT invoice_id, arg_max(category, seq) AS category FROM corrections GROUP BY 1) c ON c.invoice_id = i.id
""")
def j12(spark, sf_dir):
    """Category corrections applied: latest correction wins, user_corrected set."""
    m = M(spark, sf_dir)
    return IN.apply_corrections(m.invoices.select("id", "ai_category"), m.corrections)


def _intent_sql() -> str:
    def any_of(ws):
        return "(" + " OR ".join(f"contains(low, '{w}')" for w in ws) + ")"
    intent = "CASE " + " ".join(f"WHEN {any_of(ws)} THEN '{lab}'" for lab, ws in fixed.INTENTS) + " ELSE 'fallback' END"
    alias = "CASE kw " + " ".join(f"WHEN '{a}' THEN '{f}'" for a, f in fixed.FIELD_ALIASES) + " END"
    return f"""
SELECT event_id, body, {intent} AS intent,
  CASE WHEN {any_of(fixed.CONFIRM_WORDS)} THEN 'confirm' WHEN {any_of(fixed.CANCEL_WORDS)} THEN 'cancel'
       WHEN starts_with(low, 'edit ') AND ({alias}) IS NOT NULL THEN 'edit' WHEN starts_with(low, 'edit ') THEN 'ask_field'
       ELSE 'prompt' END AS pending_action,
  CASE WHEN starts_with(low, 'edit ') THEN {alias} END AS edit_field
FROM (SELECT *, trim(replace(low, 'edit ', '')) AS kw FROM (SELECT event_id, body, lower(trim(body)) AS low FROM messages) a) b
"""


@query("F23_tag_intent", "F23", _intent_sql())
def f23(spark, sf_dir):
    """Intent of every chat message, with and without a pending invoice."""
    msgs = M(spark, sf_dir).messages.select("event_id", "body")
    return IN.tag_intent(msgs)


@query("F25_photo_triage", "F25", """
SELECT image_id, score, is_blurry, is_dark, is_overexposed, is_low_res, array_to_string(list_filter([
  CASE WHEN is_blurry THEN 'Blurry (score: ' || format('{:.0f}', blur) || ')' END,
  CASE WHEN is_dark THEN 'Too dark (brightness: ' || format('{:.0f}', brightness) || ')' END,
  CASE WHEN is_overexposed THEN 'Overexposed (brightness: ' || format('{:.0f}', brightness) || ')' END,
  CASE WHEN is_low_res THEN 'Low resolution (' || CAST(width AS VARCHAR) || 'x' || CAST(height AS VARCHAR) || ')' END],
  lambda x: x IS NOT NULL), '; ') AS issues, score < 80 AS needs_preprocessing
FROM (SELECT *, greatest(0, 100 - CASE WHEN is_blurry THEN 30 ELSE 0 END - CASE WHEN is_dark OR is_overexposed THEN 20 ELSE 0 END
        - CASE WHEN is_low_res THEN 20 ELSE 0 END) AS score FROM (
  SELECT *, blur < 100 AS is_blurry, brightness < 80 AS is_dark, brightness > 200 AS is_overexposed,
    width < 800 OR height < 600 AS is_low_res FROM photo_metrics) a) b
""")
def f25(spark, sf_dir):
    """Photo quality triage over every measured image."""
    t = IN.photo_triage(M(spark, sf_dir).photo_metrics)
    return t.withColumn("issues", F.array_join("issues", "; "))


# ----------------------------------------------------------------- GSTIN ----

def _gstin_sql() -> str:
    from ..sources.bridge import chk_duck
    pat = fixed.GSTIN_PATTERN
    return f"""
SELECT raw AS seller_gstin, ok AS is_valid, CASE WHEN ok THEN g END AS gstin, CASE WHEN ok THEN substr(g, 1, 2) END AS state_code,
  CASE WHEN ok THEN coalesce(s.name, 'Unknown') END AS state_name, CASE WHEN ok THEN substr(g, 3, 10) END AS pan,
  CASE WHEN ok THEN false ELSE NOT ok END AND false AS auto_corrected,
  CASE WHEN g IS NULL THEN 'GSTIN is empty' WHEN length(g) <> 15 THEN 'GSTIN must be 15 characters, got ' || CAST(length(g) AS VARCHAR)
       WHEN ok THEN NULL WHEN NOT pattern_ok THEN 'GSTIN format invalid — could not auto-correct'
       WHEN NOT state_ok THEN 'Invalid state code: ' || substr(g, 1, 2)
       ELSE 'Checksum failed — OCR error not correctable' END AS error
FROM (SELECT *, coalesce(pattern_ok AND state_ok AND length(g) = 15 AND substr(g, 15, 1) = {chk_duck('substr(g, 1, 14)')}, false)
        AND length(g) = 15 AS ok FROM (
  SELECT raw, g, regexp_matches(g, '{pat}') AS pattern_ok, substr(g, 1, 2) IN {Q.sql_list(fixed.STATE_CODES.keys())} AS state_ok
  FROM (SELECT raw, CASE WHEN raw IS NULL OR raw = '' THEN NULL ELSE upper(trim(raw)) END AS g
        FROM (SELECT DISTINCT seller_gstin AS raw FROM invoices) d) e) f) x
LEFT JOIN states s ON s.code = substr(x.g, 1, 2)
"""


@query("F5_gstin_report", "F5,F7,J7", _gstin_sql(), ctes=Q.states_cte())
def f5(spark, sf_dir):
    """Validity report of every distinct supplier GSTIN (no repair)."""
    inv = M(spark, sf_dir).invoices
    r = IN.gstin_report(inv, "seller_gstin", repair=False)
    return r.drop("corrections")


def _repair_sql() -> str:
    """DuckDB twin of functions.gstin.repair over the failing supplier ids."""
    from ..sources.bridge import chk_duck
    pat = fixed.GSTIN_PATTERN
    keys = Q.sql_list(fixed.OCR_CONFUSIONS.keys())
    conf = ", ".join(f"('{k}', {r + 1}, '{o}')" for k, alts in fixed.OCR_CONFUSIONS.items()
                     for r, o in enumerate([k] + alts))
    cls = ("CASE WHEN p8.p <= 2 THEN '[0-9]' WHEN p8.p <= 7 THEN '[A-Z]' WHEN p8.p <= 11 THEN '[0-9]' "
           "WHEN p8.p = 12 THEN '[A-Z]' WHEN p8.p = 13 THEN '[1-9A-Z]' WHEN p8.p = 14 THEN 'Z' ELSE '[0-9A-Z]' END")
    states = Q.sql_list(fixed.STATE_CODES.keys())
    q1 = "''''"  # SQL literal holding one quote character
    return f"""ids AS (SELECT DISTINCT upper(trim(seller_gstin)) AS g FROM invoices WHERE length(upper(trim(seller_gstin))) = 15),
bad AS (SELECT g FROM ids WHERE NOT (regexp_full_match(g, '{pat}') AND substr(g, 1, 2) IN {states}
                                     AND substr(g, 15, 1) = {chk_duck('substr(g, 1, 14)')})),
pos8 AS (SELECT g, p, ch, j FROM (SELECT g, i AS p, substr(g, i, 1) AS ch, row_number() OVER (PARTITION BY g ORDER BY i) AS j
         FROM bad CROSS JOIN range(1, 16) t(i) WHERE substr(g, i, 1) IN {keys}) x WHERE j <= {fixed.OCR_MAX_POSITIONS}),
conf(orig, rk, opt) AS (VALUES {conf}),
opts AS (SELECT p8.g, p8.j, p8.p, c.opt, row_number() OVER (PARTITION BY p8.g, p8.j ORDER BY c.rk) AS o
         FROM pos8 p8 JOIN conf c ON c.orig = p8.ch WHERE regexp_full_match(c.opt, {cls})),
sz AS (SELECT p8.g, p8.j, count(o.opt) AS sz FROM pos8 p8 LEFT JOIN opts o ON o.g = p8.g AND o.j = p8.j GROUP BY 1, 2),
strides AS (SELECT g, j, sz, CAST(coalesce(product(sz) OVER (PARTITION BY g ORDER BY j DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS BIGINT) AS stride FROM sz),
tot AS (SELECT g, CAST(product(sz) AS BIGINT) AS total FROM sz GROUP BY g HAVING product(sz) > 0),
cand AS (SELECT g, unnest(range(total)) AS idx FROM tot),
pick AS (SELECT c.g, c.idx, s.j, o.p, o.opt FROM cand c JOIN strides s ON s.g = c.g
         JOIN opts o ON o.g = c.g AND o.j = s.j AND o.o = (c.idx // s.stride) % s.sz + 1),
strs AS (SELECT c.g, c.idx, string_agg(coalesce(pk.opt, substr(c.g, t.i, 1)), '' ORDER BY t.i) AS cand
         FROM cand c CROSS JOIN range(1, 16) t(i) LEFT JOIN pick pk ON pk.g = c.g AND pk.idx = c.idx AND pk.p = t.i
         GROUP BY c.g, c.idx),
win AS (SELECT g, min(idx) AS idx, arg_min(cand, idx) AS corrected FROM strs
        WHERE regexp_full_match(cand, '{pat}') AND substr(cand, 1, 2) IN {states}
          AND substr(cand, 15, 1) = {chk_duck('substr(cand, 1, 14)')} GROUP BY g),
corr AS (SELECT w.g, string_agg('pos ' || CAST(pk.p AS VARCHAR) || ': ' || {q1} || substr(w.g, pk.p, 1) || {q1} || '->'
         || {q1} || pk.opt || {q1}, ', ' ORDER BY pk.j) AS corrections
         FROM win w JOIN pick pk ON pk.g = w.g AND pk.idx = w.idx WHERE substr(w.g, pk.p, 1) <> pk.opt GROUP BY w.g)"""


def _gstin_repaired_sql(status_line: bool = False) -> str:
    """DuckDB twin of gstin_report(repair=True) (and of gstin_status)."""
    from ..sources.bridge import chk_duck
    pat = fixed.GSTIN_PATTERN
    inner = f"""SELECT raw, g, pattern_ok, state_ok,
        coalesce(pattern_ok AND state_ok AND length(g) = 15 AND substr(g, 15, 1) = {chk_duck('substr(g, 1, 14)')}, false)
        AND coalesce(length(g) = 15, false) AS ok FROM (
  SELECT raw, g, regexp_matches(g, '{pat}') AS pattern_ok, substr(g, 1, 2) IN {Q.sql_list(fixed.STATE_CODES.keys())} AS state_ok
  FROM (SELECT raw, CASE WHEN raw IS NULL OR raw = '' THEN NULL ELSE upper(trim(raw)) END AS g
        FROM (SELECT DISTINCT seller_gstin AS raw FROM invoices) d) e) f"""
    rep = f"""SELECT x.raw, x.g, x.ok, x.pattern_ok, x.state_ok, w.corrected, c.corrections,
  CASE WHEN x.ok THEN x.g WHEN w.corrected IS NOT NULL THEN w.corrected END AS fin
  FROM ({inner}) x LEFT JOIN win w ON w.g = x.g LEFT JOIN corr c ON c.g = x.g"""
    cols = f"""y.raw AS seller_gstin, (y.ok OR y.corrected IS NOT NULL) AS is_valid, y.fin AS gstin,
  substr(y.fin, 1, 2) AS state_code, CASE WHEN y.fin IS NOT NULL THEN coalesce(s.name, 'Unknown') END AS state_name,
  substr(y.fin, 3, 10) AS pan, (NOT y.ok AND y.corrected IS NOT NULL) AS auto_corrected,
  CASE WHEN NOT y.ok AND y.corrected IS NOT NULL THEN y.corrections END AS corrections,
  CASE WHEN y.g IS NULL THEN 'GSTIN is empty'
       WHEN length(y.g) <> 15 THEN 'GSTIN must be 15 characters, got ' || CAST(length(y.g) AS VARCHAR)
       WHEN y.ok OR y.corrected IS NOT NULL THEN NULL WHEN NOT y.pattern_ok THEN 'GSTIN format invalid — could not auto-correct'
       WHEN NOT y.state_ok THEN 'Invalid state code: ' || substr(y.g, 1, 2)
       ELSE 'Checksum failed — OCR error not correctable' END AS error"""
    body = f"SELECT {cols} FROM ({rep}) y LEFT JOIN states s ON s.code = substr(y.fin, 1, 2)"
    if not status_line:
        return body
    return f"""SELECT seller_gstin, CASE WHEN seller_gstin IS NULL OR seller_gstin = '' THEN ''
  WHEN is_valid AND auto_corrected THEN '✅ Auto-corrected: ' || gstin || ' (' || state_name || ')'
  WHEN is_valid THEN 'Valid (' || state_name || ')' ELSE 'Invalid GSTIN - ITC risk!' END AS status_line FROM ({body}) r"""


@query("F5_F6_gstin_report_repaired", "F5,F6", _gstin_repaired_sql(), ctes=Q.states_cte() + ",\n" + _repair_sql())
def f5r(spark, sf_dir):
    """Validity report with look-alike repair of the failing 15-character ids."""
    return IN.gstin_report(M(spark, sf_dir).invoices, "seller_gstin", repair=True) \
        .withColumn("corrections", F.array_join("corrections", ", "))


@query("F6_gstin_repair", "F6", """
SELECT w.g AS gstin, w.corrected, coalesce(c.corrections, '') AS corrections FROM win w LEFT JOIN corr c ON c.g = w.g
""", ctes=_repair_sql())
def f6(spark, sf_dir):
    """Repairs found for the supplier GSTINs that fail the check."""
    from ..functions import gstin as G
    inv = M(spark, sf_dir).invoices
    ids = inv.select(F.upper(F.trim("seller_gstin")).alias("gstin")).filter(F.length("gstin") == 15).distinct()
    ck = G.checks("gstin")
    bad = ids.filter(~ck["checksum_ok"])
    return G.repair(bad).withColumn("corrections", F.array_join("corrections", ", "))


@query("F24_gstin_status", "F24", _gstin_repaired_sql(True), ctes=Q.states_cte() + ",\n" + _repair_sql())
def f24(spark, sf_dir):
    """Chat status line of every supplier GSTIN (valid / auto-corrected / risk)."""
    return IN.gstin_status(IN.gstin_report(M(spark, sf_dir).invoices, "seller_gstin", repair=True))


@query("J7_with_state", "J7", """
SELECT g, coalesce(s.name, 'Unknown') AS state_name FROM (SELECT DISTINCT seller_gstin AS g FROM invoices) d
LEFT JOIN states s ON s.code = substr(d.g, 1, 2)
""", ctes=Q.states_cte())
def j7(spark, sf_dir):
    """State-name lookup of every supplier GSTIN prefix, default Unknown."""
    ids = M(spark, sf_dir).invoices.select(F.col("seller_gstin").alias("g")).distinct()
    m = F.create_map(*[F.lit(x) for kv in fixed.STATE_CODES.items() for x in kv])
    return ids.select("g", F.coalesce(F.element_at(m, F.substring("g", 1, 2)), F.lit("Unknown")).alias("state_name"))


# ------------------------------------------------------------ extensions ----

@query("J8_with_gst_rate", "J8", f"""
SELECT c AS goods_class, coalesce(r.rate, 18.0) AS gst_rate FROM (SELECT DISTINCT lower(p_type) AS c FROM part
  UNION SELECT DISTINCT CASE p_size % 6 WHEN 0 THEN 'textile' WHEN 1 THEN ' Gold ' WHEN 2 THEN 'automobile' WHEN 3 THEN 'HOTEL'
                        WHEN 4 THEN 'medicine' ELSE 'tools' END FROM part) d
LEFT JOIN ({" UNION ALL ".join(f"SELECT '{k}' AS k, CAST({v} AS DOUBLE) AS rate" for k, v in fixed.GST_RATES.items())}) r ON r.k = lower(trim(d.c))
""")
def j8(spark, sf_dir):
    """GST rate of each goods class (extension; default 18)."""
    part, names = M(spark, sf_dir).part, ["textile", " Gold ", "automobile", "HOTEL", "medicine", "tools"]
    named = F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_size") % 6).cast("int"))
    classes = part.select(F.lower("p_type").alias("goods_class")).union(part.select(named)).distinct()
    return IN.with_gst_rate(classes, "goods_class")


@query("J10_reconcile_2b", "J10", """
SELECT coalesce(b.user_id, r.user_id) AS user_id, coalesce(b.period, r.period) AS period,
  coalesce(b.supplier_gstin, r.supplier_gstin) AS supplier_gstin, coalesce(b.invoice_no, r.invoice_no) AS invoice_no,
  CAST(b.claimed AS DOUBLE) AS claimed, CAST(r.itc_amount AS DOUBLE) AS reported,
  CASE WHEN r.itc_amount IS NULL THEN 'missing_in_2b' WHEN b.claimed IS NULL THEN 'missing_in_books'
       WHEN b.claimed = r.itc_amount THEN 'matched' ELSE 'mismatch' END AS status,
  CAST(coalesce(b.claimed, 0) - coalesce(r.itc_amount, 0) AS DOUBLE) AS difference
FROM (SELECT user_id, strftime(date, '%Y-%m') AS period, seller_gstin AS supplier_gstin, invoice_no, sum(cgst + sgst + igst) AS claimed
      FROM invoices WHERE date IS NOT NULL AND coalesce(invoice_no, '') <> '' GROUP BY 1, 2, 3, 4) b
FULL OUTER JOIN gstr2b r ON r.user_id = b.user_id AND r.period = b.period AND r.supplier_gstin = b.supplier_gstin
  AND r.invoice_no = b.invoice_no
""")
def j10(spark, sf_dir):
    """GSTR-2B reconciliation of the books (extension)."""
    m = M(spark, sf_dir)
    return IN.reconcile_2b(m.invoices, m.gstr2b)


@query("J11_supplier_not_filed", "J11", """
SELECT i.id, i.user_id, i.seller_gstin, i.invoice_no FROM invoices i
WHERE i.date IS NOT NULL AND EXISTS (SELECT 1 FROM gstr2b r WHERE r.filing_status <> 'filed' AND r.user_id = i.user_id
  AND r.period = strftime(i.date, '%Y-%m') AND r.supplier_gstin = i.seller_gstin AND r.invoice_no = i.invoice_no)
""")
def j11(spark, sf_dir):
    """Invoices whose supplier did not file them in GSTR-2B (extension)."""
    m = M(spark, sf_dir)
    return IN.supplier_not_filed(m.invoices, m.gstr2b).select("id", "user_id", "seller_gstin", "invoice_no")


@query("J17_map_label", "J17", """
SELECT z.doc_id, coalesce(l.category, 'Other') AS zs_category FROM (
  SELECT doc_id, arg_max(k, round(score * 100) * 100 - k) AS tk FROM zero_shot GROUP BY 1) z LEFT JOIN lab13 l ON l.k = z.tk
""", ctes=Q.labels_cte())
def j17(spark, sf_dir):
    """Zero-shot top label -> category for every document."""
    return CL.zero_shot_top(M(spark, sf_dir).zero_shot, spark).select("doc_id", "zs_category")


LABELLED_SQL = f"""
SELECT id AS row_id, description, CAST(floor(coalesce(taxable_amt, 0) + cgst + sgst + igst) AS INTEGER) AS amount, ai_category AS category,
  CASE WHEN ai_category IN {Q.sql_list(fixed.BLOCKED_DATASET)} THEN 'No' ELSE 'Yes' END AS itc_eligible, seller_gstin AS gstin
FROM invoices WHERE coalesce(description, '') <> '' AND ai_category IS NOT NULL
"""


@query("L1_make_labelled", "L1,U4", LABELLED_SQL)
def l1(spark, sf_dir):
    """Labelled transactions from the stored invoices."""
    return IN.make_labelled(M(spark, sf_dir).invoices)


@query("A29_label_counts", "A29", f"SELECT category, count(*) AS n FROM ({LABELLED_SQL}) t GROUP BY 1")
def a29(spark, sf_dir):
    """Rows per category of the labelled set."""
    from ..operators.aggregates import label_counts
    return label_counts(IN.make_labelled(M(spark, sf_dir).invoices))


@query("L2_training_set", "L2", f"""
SELECT text, label, source,
  CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(text || '|' || label), text)
         <= floor(count(*) OVER (PARTITION BY label) * 20 / 100 + 0.5) THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY prio, label) AS rn FROM (
  SELECT i.description AS text, c.category AS label, 0 AS prio, 'correction' AS source
  FROM invoices i JOIN (SELECT invoice_id, arg_max(category, seq) AS category FROM corrections GROUP BY 1) c ON c.invoice_id = i.id
  UNION ALL
  SELECT description, {Q.kw_category('lower(description)')}, 1, 'keyword' FROM invoices) u
  WHERE label <> 'Other' OR prio = 0) t
WHERE rn = 1
""")
def l2(spark, sf_dir):
    """Training rows from corrections and keyword predictions, one per text; a fifth of every label is the test split."""
    m = M(spark, sf_dir)
    return IN.training_set(m.invoices, m.corrections)


@query("L3_with_scorer", "L3", f"""
SELECT d.doc_id, d.layer, d.category, d.confidence,
  CASE WHEN d.layer = 'none' THEN false ELSE c.blocked END AS blocked
FROM (SELECT doc_id, CASE WHEN short THEN 'none' WHEN kw <> 'Other' THEN 'keyword' ELSE 'fine_tuned' END AS layer,
        CASE WHEN short THEN 'Other' WHEN kw <> 'Other' THEN kw ELSE cats[1 + CAST(floor(v * 1000) AS BIGINT) % len(cats)] END AS category,
        CASE WHEN short THEN 0.0 WHEN kw <> 'Other' THEN CAST({fixed.KEYWORD_CONFIDENCE} AS DOUBLE)
             ELSE round_even(v * 100, 0) / 100 END AS confidence
      FROM (SELECT doc_id, text IS NULL OR length(trim(text)) < 3 AS short, {Q.kw_category('lower(text)')} AS kw,
              {[c for c, _, _ in fixed.CATEGORY_MAP]!r} AS cats,
              CAST(length(regexp_replace(lower(coalesce(text, '')), '[^aeiou]', '', 'g')) AS DOUBLE)
                / greatest(length(lower(coalesce(text, ''))), 1) AS v FROM documents) a) d
JOIN catmap c ON c.category = d.category
""", ctes=Q.catmap_cte())
def l3(spark, sf_dir):
    """Layer-3 scores from a user pandas scorer, used by the layered classifier."""
    scorer = CL.demo_scorer()
    docs = spread(M(spark, sf_dir).documents.select("doc_id", "text"))   # one exchange, read by both
    ft = CL.with_scorer(docs, scorer, "doc_id", "text").withColumn("k", F.lit(1))
    r = CL.classify_layered(docs, "text", None, ft)
    return r.select("doc_id", "layer", "category", "confidence", "blocked")


# ----------------------------------------------------------------- sinks ----

#: With a mark for null, empty texts come back as they were.
CSV = {"header": True, "nullValue": "\\N"}


def _out(spark, sf_dir, name):
    """A folder of this run's own: two runs at once don't write over each other."""
    return shared_dir(spark, f"itcflow-sinks/{os.path.basename(sf_dir.rstrip('/'))}/{name}-{uuid.uuid4().hex[:8]}")


@query("S5_labelled_csv", "S5", "SELECT description, amount, category, itc_eligible, gstin FROM (" + LABELLED_SQL + ") t")
def s5(spark, sf_dir):
    """Labelled set written as CSV with header and read back with a schema."""
    path = _out(spark, sf_dir, "labelled_csv")
    IN.make_labelled(M(spark, sf_dir).invoices).drop("row_id") \
        .write.mode("overwrite").options(**CSV).csv(path)
    schema = T.StructType([T.StructField("description", T.StringType()), T.StructField("amount", T.IntegerType()),
                           T.StructField("category", T.StringType()), T.StructField("itc_eligible", T.StringType()),
                           T.StructField("gstin", T.StringType())])
    return spark.read.schema(schema).options(**CSV).csv(path)


@query("S6_export_invoices", "S6", """
SELECT CAST(id AS VARCHAR) AS "ID", client_name AS "Client", invoice_no AS "Invoice No",
  coalesce(substr(strftime(date, '%Y-%m-%d %H:%M:%S'), 1, 10), '') AS "Date", supplier_gstin AS "Supplier GSTIN",
  CAST(total AS DOUBLE) AS "Total", CAST(itc AS DOUBLE) AS "ITC", ai_category AS "Category", status AS "Status" FROM v
""", ctes=Q.view_cte())
def s6(spark, sf_dir):
    """Invoice CSV export (9 named columns), written to the shared folder and read back."""
    v = feed(M(spark, sf_dir))
    out = v.select(F.col("id").cast("string").alias("ID"), F.col("client_name").alias("Client"),
                   F.col("invoice_no").alias("Invoice No"),
                   F.coalesce(F.substring(C.fmt_ts("date"), 1, 10), F.lit("")).alias("Date"),
                   F.col("supplier_gstin").alias("Supplier GSTIN"), D("total").alias("Total"), D("itc").alias("ITC"),
                   F.col("ai_category").alias("Category"), F.col("status").alias("Status"))
    path = _out(spark, sf_dir, "invoices_csv")
    out.write.mode("overwrite").options(**CSV).csv(path)
    return spark.read.schema(out.schema).options(**CSV).csv(path)


S7_HEADS = ["igst", "cgst", "sgst"]


def _s7_sql() -> str:
    def heads(prefix, src):
        return ", ".join(f"round({src}_{h}, 2) AS {prefix}_{h}" for h in S7_HEADS)
    sums = ", ".join(f"CAST(sum(CASE WHEN b THEN {x} ELSE {y} END) AS DOUBLE) AS {n}_{h}" for h in S7_HEADS
                     for n, x, y in (("el", "0", h), ("bl", h, "0")))
    return f"""
SELECT t.ret_period, u.gstin, 'GSTR3B_' || u.gstin || '_' || t.ret_period || '.json' AS file_name,
  u.gstin || ' ' || t.ret_period || ' ' || t.period || ' ' || coalesce(u.business_name, '') AS named, t.total_invoices,
  round(t.total_taxable, 2) AS total_taxable, round(t.el_igst + t.el_cgst + t.el_sgst, 2) AS eligible_itc,
  round(t.bl_igst + t.bl_cgst + t.bl_sgst, 2) AS blocked_itc, {heads("net", "t.el")}, {heads("avl", "t.el")}, {heads("inelg", "t.bl")},
  round(t.el_igst, 2) AS isup_inter, round(t.el_cgst + t.el_sgst, 2) AS isup_intra,
  'IMPG,IMPS,ISRC,ITC,OTH RUL,OTH RUL,OTH OTH' AS kinds, CAST(0 AS DOUBLE) AS zeros
FROM (SELECT user_id, strftime(date, '%Y-%m') AS period, strftime(date, '%m%Y') AS ret_period, count(*) AS total_invoices,
        CAST(sum(taxable_amt) AS DOUBLE) AS total_taxable, {sums}
      FROM (SELECT *, {Q.blocked()} AS b FROM invoices WHERE status = 'confirmed' AND date IS NOT NULL) i GROUP BY 1, 2, 3) t
JOIN users u ON u.id = t.user_id WHERE u.ca_id IS NOT NULL AND coalesce(u.gstin, '') <> ''
"""


def _written_gstr3b(spark, sf_dir):
    m = M(spark, sf_dir)
    # the documents, their keys and the supply lines all read these
    inv = staged(m.invoices.filter((F.col("status") == "confirmed") & F.col("date").isNotNull()).select(
        "id", "user_id", "seller_gstin", "invoice_no", "date", "taxable_amt", "cgst", "sgst", "igst", "status", "ai_category", "ai_confidence"), "confirmed")
    docs, sup = FL.gstr3b_document(inv, m.users), FL.gstr3b_supplies(inv, m.users)
    path = _out(spark, sf_dir, "gstr3b")
    FL.write_gstr3b(docs, sup, path)
    return FL.read_gstr3b(path, docs, sup)


@query("S7_write_gstr3b", "S7", _s7_sql())
def s7(spark, sf_dir):
    """GSTR-3B JSON documents written per (ret_period, gstin) and read back, every value of header and body."""
    d = _written_gstr3b(spark, sf_dir)[0]
    elg, sup, meta, isup = "doc.itc_elg", F.col("doc.sup_details"), "doc._meta", F.col("doc.inward_dtls.isup_details")
    avl, rev, inelg = (F.col(f"{elg}.{k}") for k in ("itc_avl", "itc_rev", "itc_inelg"))
    own = F.filter(avl, lambda x: x["ty"] == "ITC")[0]
    # what the application always files as 0, and the heads other than ITC
    rest = F.aggregate(F.flatten(F.array(F.filter(avl, lambda x: x["ty"] != "ITC"), rev, F.filter(inelg, lambda x: x["ty"] != "RUL"))),
                       F.lit(0.0), lambda acc, x: acc + x["igst"] + x["cgst"] + x["sgst"] + x["cess"])
    fixed_zeros = sum([sup[k][h] for k in ("osup_det", "osup_zero", "isup_rev") for h in ("txval", "igst", "cgst", "sgst", "cess")]
                      + [sup["osup_nil_exmp"]["txval"], sup["osup_nongst"]["txval"], isup[0]["exmt"], isup[0]["ngsup"], F.col(f"{elg}.itc_net.cess"),
                         own["cess"], inelg[0]["cess"]]
                      + [F.col(f"doc.intr_ltfee.{k}.{h}") for k in ("intr_details", "fee_details") for h in S7_HEADS]
                      + [F.size(f"doc.inter_sup.{k}") for k in ("unreg_details", "comp_details", "uin_details")], F.lit(0.0))
    kinds = F.concat_ws(" ", *[F.array_join(F.transform(x, lambda y: y["ty"]), ",") for x in (avl, rev, inelg)],
                        F.array_join(F.transform(isup, lambda y: y["ty"]), ","))
    return d.select(
        "ret_period", "gstin", "file_name",
        F.concat_ws(" ", "doc.gstin", "doc.ret_period", f"{meta}.period", f"{meta}.client_name").alias("named"),
        *[F.col(f"{meta}.{c}").alias(c) for c in ("total_invoices", "total_taxable", "eligible_itc", "blocked_itc")],
        *[F.col(f"{elg}.itc_net.{h}").alias(f"net_{h}") for h in S7_HEADS], *[own[h].alias(f"avl_{h}") for h in S7_HEADS],
        *[inelg[0][h].alias(f"inelg_{h}") for h in S7_HEADS],
        isup[0]["inter"].alias("isup_inter"), isup[0]["intra"].alias("isup_intra"), kinds.alias("kinds"),
        (rest + fixed_zeros).alias("zeros"))


@query("S7_written_supplies", "S7,A7", f"""
SELECT strftime(i.date, '%m%Y') AS ret_period, u.gstin, i.id AS invoice_id, i.invoice_no, i.seller_gstin AS supplier_gstin,
  strftime(i.date, '%d-%m-%Y') AS invoice_date, CAST(round(i.taxable_amt, 2) AS DOUBLE) AS taxable_value,
  CAST(round(i.igst, 2) AS DOUBLE) AS igst, CAST(round(i.cgst, 2) AS DOUBLE) AS cgst, CAST(round(i.sgst, 2) AS DOUBLE) AS sgst,
  {Q.cat('i.ai_category')} AS ai_category, round(coalesce(i.ai_confidence, 0.0), 2) AS ai_confidence,
  NOT {Q.blocked(c=Q.cat('i.ai_category'))} AS itc_eligible
FROM invoices i JOIN users u ON u.id = i.user_id
WHERE u.ca_id IS NOT NULL AND coalesce(u.gstin, '') <> '' AND i.status = 'confirmed' AND i.date IS NOT NULL
""")
def s7s(spark, sf_dir):
    """The supply lines written beside the GSTR-3B documents, read back, every value."""
    return _written_gstr3b(spark, sf_dir)[1]


@query("S9_outbox", "S9", f"""
SELECT DISTINCT 'whatsapp:' || CASE WHEN phone LIKE '+%' THEN phone ELSE '+91' || phone END AS "to", 'GSTR-1' AS kind,
  '📅 GSTR-1 Filing Reminder' || chr(10) || chr(10) || 'Deadline: 2000-06-11' || chr(10) || 'Sirf 7 din bacha hai!' || chr(10) || chr(10)
  || '💰 Aapka ITC this month: Rs.' || format('{{:,.2f}}', CAST(round(coalesce(l.itc_available, 0), 2) AS DOUBLE))
  || chr(10) || chr(10) || 'Apne CA se abhi contact karein.' || chr(10) || '{fixed.SIGNOFF}' AS body
FROM users u LEFT JOIN (SELECT * FROM ledger WHERE period = '2000-06') l ON l.user_id = u.id
WHERE u.phone IS NOT NULL AND u.phone <> ''
""")
def s9(spark, sf_dir):
    """Reminder messages appended to the outbox table."""
    from .catalog_more import REMIND_AS_OF
    m = M(spark, sf_dir)
    msgs = FL.deadline_messages(m.users, m.ledger, REMIND_AS_OF, "calendar")
    path = _out(spark, sf_dir, f"outbox-{uuid.uuid4().hex[:8]}")  # the outbox appends; one run, one folder
    FL.write_outbox(msgs, path)
    return spark.read.parquet(path).select("to", "kind", "body").distinct()


@query("S10_publish_ledger", "S10", """
SELECT user_id, period, CAST(itc_available AS DOUBLE) AS itc_available, CAST(total_purchases AS DOUBLE) AS total_purchases FROM ledger
""")
def s10(spark, sf_dir):
    """Ledger published in two parts of users that overlap in every month (the first with wrong amounts for the
    users of both): find or create by (user, period), others' rows stay, a re-run changes nothing."""
    m = M(spark, sf_dir).stage("ledger")   # an upsert reads its rows twice
    path, key = _out(spark, sf_dir, f"gst_ledger-{uuid.uuid4().hex[:8]}"), (["user_id", "period"], ["period"])
    early = m.ledger.filter("user_id % 3 <> 0").withColumn("itc_available", F.when(F.col("user_id") % 3 == 1, F.lit(0).cast("decimal(38,2)"))
                                                           .otherwise(F.col("itc_available")))
    FL.publish(early, path, *key)
    FL.publish(m.ledger.filter("user_id % 3 < 2"), path, *key)
    if FL.publish(m.ledger.filter("user_id % 3 < 2"), path, *key):
        raise AssertionError("a re-run has written something")
    return FL.published(spark, path, *key).select("user_id", "period", D("itc_available").alias("itc_available"),
                                                  D("total_purchases").alias("total_purchases"))


@query("W7_latest_correction", "W7", """
SELECT invoice_id, arg_max(category, seq) AS category FROM corrections GROUP BY 1
""")
def w7c(spark, sf_dir):
    """Latest correction per invoice (aggregate, no window)."""
    return latest_by(M(spark, sf_dir).corrections, "invoice_id", ["seq"], ["category"])


def _confirm_sql() -> str:
    def lit(t):
        return "'" + t.replace("'", "''") + "'"
    shown = "CASE WHEN coalesce(r.auto_corrected, false) THEN r.gstin ELSE f.seller_gstin END"
    status = ("CASE WHEN r.is_valid AND r.auto_corrected THEN '✅ Auto-corrected: ' || r.gstin || ' (' || r.state_name || ')' "
              "WHEN r.is_valid THEN 'Valid (' || r.state_name || ')' ELSE 'Invalid GSTIN - ITC risk!' END")
    lines = []
    for field, label in fixed.CONFIRM_LINES:
        if field == "seller_gstin":
            lines.append(f"CASE WHEN f.seller_gstin IS NOT NULL AND f.seller_gstin <> '' THEN {lit(label)} || {shown} || "
                         f"{lit(chr(10) + '  ')} || {status} || {lit(chr(10))} ELSE '' END")
        elif field in ("invoice_no", "invoice_date"):
            lines.append(f"CASE WHEN f.{field} IS NOT NULL AND f.{field} <> '' THEN {lit(label)} || f.{field} || {lit(chr(10))} ELSE '' END")
        else:
            lines.append(f"CASE WHEN f.{field} IS NOT NULL AND f.{field} <> 0 THEN {lit(label)} || CAST(f.{field} AS VARCHAR) || "
                         f"{lit(chr(10))} ELSE '' END")
    desc = f"lower(coalesce(nullif(f.description, ''), {lit(fixed.DEFAULT_DESCRIPTION)}))"
    cat = Q.kw_category(desc)
    itc = "round(coalesce(f.cgst, 0.0) + coalesce(f.sgst, 0.0) + coalesce(f.igst, 0.0), 2)"
    h, t = fixed.AI_HEAD.split("{cat}")
    m, e = t.split("{conf}")
    kw_pre, kw_post = fixed.AI_KEYWORDS.split("{kw}")
    el_pre, el_post = fixed.AI_ELIGIBLE.split("{itc}")
    ai = (f"{lit(h)} || cat || {lit(m)} || CAST(CAST(trunc(CASE WHEN short THEN 0.0 WHEN cat <> 'Other' THEN 0.85 ELSE 0.5 END * 100) AS INTEGER) AS VARCHAR) "
          f"|| {lit(e)} || CASE WHEN kws <> '' THEN {lit(kw_pre)} || replace(kws, ',', ', ') || {lit(kw_post)} ELSE '' END || "
          f"CASE WHEN cat IN {Q.sql_list(fixed.BLOCKED_DASHBOARD)} THEN {lit(fixed.AI_BLOCKED)} "
          f"WHEN {itc} > 0 THEN {lit(el_pre)} || format('{{:,.2f}}', {itc}) || {lit(el_post)} ELSE '' END")
    body = " || ".join([lit(fixed.CONFIRM_HEAD)] + lines + [lit(fixed.CONFIRM_TAIL), ai])
    return f"""
SELECT f.id, CASE WHEN f.parse_error THEN {lit(fixed.PHOTO_UNREADABLE)} WHEN f.filled_count = 0 THEN {lit(fixed.PHOTO_EMPTY)}
  ELSE {body} END AS message
FROM (SELECT *, CASE WHEN short THEN 'Other' ELSE {cat} END AS cat, {Q.kw_matched(desc, f"(CASE WHEN short THEN 'Other' ELSE {cat} END)")} AS kws
      FROM (SELECT *, length(trim({desc.replace("f.", "")})) < 3 AS short FROM filled) f) f LEFT JOIN rep r ON r.seller_gstin = f.seller_gstin
"""


@query("F22_render_confirmation", "F22,F24,F11,S4", _confirm_sql(),
       ctes=OCR_CTE + ",\n" + Q.states_cte() + ",\n" + _repair_sql() + ",\nrep AS (" + _gstin_repaired_sql() + ")")
def f22c(spark, sf_dir):
    """The chat reply to every extraction reply: confirmation message (fields, GSTIN status,
    classification block) or the unreadable/empty notice."""
    m = M(spark, sf_dir).stage("invoices", "id", "user_id", "seller_gstin", "invoice_no", "taxable_amt", "cgst", "sgst", "igst",
                               "description", "created_at")   # joined once, for the ids and for the replies
    rep = IN.gstin_report(m.invoices, "seller_gstin", repair=True)
    return IN.confirmation_messages(IN.read_ocr_replies(m.ocr_replies), rep)


def _statement_reply_sql() -> str:
    def tpl(t, **e):
        import re
        parts = re.split(r"\{(\w+)\}", t)
        return " || ".join("'" + p.replace("'", "''") + "'" if i % 2 == 0 else "(" + e[p] + ")"
                           for i, p in enumerate(parts) if not (i % 2 == 0 and p == ""))
    line = tpl(fixed.STATEMENT_ITC_LINE, date="date", text="substr(description, 1, 30)",
               amount="format('{:,.0f}', amount)")
    head = tpl(fixed.STATEMENT_HEAD, bank="s.bank", n="CAST(s.n AS VARCHAR)",
               debit="format('{:,.2f}', s.debit)", credit="format('{:,.2f}', s.credit)", itc="CAST(s.itc AS VARCHAR)")
    tail = tpl(fixed.STATEMENT_TAIL, itc="CAST(s.itc AS VARCHAR)")
    return f"""
SELECT s.statement_id, {head} || CASE WHEN l.lines IS NOT NULL THEN '{fixed.STATEMENT_ITC_TITLE}' || l.lines ELSE '' END
  || {tail} AS reply
FROM (SELECT b.statement_id, b.bank, count(t.row_no) AS n,
        CAST(coalesce(sum(CAST(coalesce(debit, 0) AS DECIMAL(18,2))), 0) AS DOUBLE) AS debit,
        CAST(coalesce(sum(CAST(coalesce(credit, 0) AS DECIMAL(18,2))), 0) AS DOUBLE) AS credit, coalesce(count_if(itc_possible), 0) AS itc
      FROM bk b LEFT JOIN tx t ON t.statement_id = b.statement_id WHERE b.has_text GROUP BY b.statement_id, b.bank) s
LEFT JOIN (SELECT statement_id, string_agg({line}, '' ORDER BY rank) AS lines FROM (
    SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY row_no) AS rank FROM tx WHERE itc_possible) t
  WHERE rank <= 5 GROUP BY statement_id) l ON l.statement_id = s.statement_id
"""


@query("F22_statement_reply", "F22,A12,T6", _statement_reply_sql(), ctes=BANK_CTES)
def f22s(spark, sf_dir):
    """The chat reply to every parsed bank statement (totals and first five ITC rows)."""
    return B.statement_replies(_txns(spark, sf_dir), M(spark, sf_dir).bank_cells)
