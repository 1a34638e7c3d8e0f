"""Golden vectors computed by hand from the application's rules."""

from pyspark.sql import functions as F

from itcflow.functions import gstin as G
from itcflow.functions import keywords as K
from itcflow.functions.calendar import deadlines
from itcflow.functions.text import clean_amount, clean_edit_amount, norm_phone, parse_invoice_date
from itcflow.operators import aggregates as A
from itcflow.operators import filing as FL
from itcflow.operators import ingest as IN


def test_check_digit_reference_and_standard(spark):
    df = spark.createDataFrame([("27AAPFU0939F1Z",), ("24AABCS1429B1Z",)], "g string")
    rows = df.select("g", G.check_char("g").alias("ref"), G.check_char("g", "standard").alias("std")).collect()
    got = {r.g: (r.ref, r.std) for r in rows}
    assert got == {"27AAPFU0939F1Z": ("Z", "V"), "24AABCS1429B1Z": ("C", "0")}


def test_gstin_repair_goldens(spark):
    ids = spark.createDataFrame([("24AABCSI429B1ZC",), ("24AABC51429B1ZC",), ("24AABCS1429BIZC",),
                                 ("27AAPFU0939F1ZV",)], "gstin string")
    got = {r.gstin: r.corrected for r in G.repair(ids).collect()}
    assert got == {"24AABCSI429B1ZC": "24AABCS1429B1ZC", "24AABC51429B1ZC": "24AABCS1429B1ZC"}


def test_gstin_report_messages(spark):
    df = spark.createDataFrame([("",), ("ABC",), ("24AABCS1429B1ZC",), ("99AABCS1429B1ZC",), ("24AABCSI429B1ZC",),
                                ("24AABCS1429B1ZX",)], "g string")
    r = {x.g: x for x in IN.gstin_report(df, "g").collect()}
    assert r[""].error == "GSTIN is empty" and not r[""].is_valid
    assert r["ABC"].error == "GSTIN must be 15 characters, got 3"
    assert r["24AABCS1429B1ZC"].is_valid and r["24AABCS1429B1ZC"].state_name == "Gujarat"
    assert r["24AABCS1429B1ZC"].pan == "AABCS1429B"
    assert r["99AABCS1429B1ZC"].error == "Invalid state code: 99"
    assert r["24AABCSI429B1ZC"].is_valid and r["24AABCSI429B1ZC"].auto_corrected
    assert r["24AABCSI429B1ZC"].corrections == ["pos 8: 'I'->'1'"]
    assert r["24AABCS1429B1ZX"].error == "Checksum failed — OCR error not correctable"


def test_penalties(spark):
    rows = [(1, 1, "GSTR-1", 10, 0.0), (2, 1, "GSTR-1", 300, 0.0), (3, 1, "GSTR-3B", 10, 50000.0),
            (4, 1, "GSTR-3B", 10, 0.0), (5, 1, "GSTR-9", 10, 100.0), (6, 1, "GSTR-3B", 0, 100.0)]
    df = spark.createDataFrame(rows, "id long, user_id long, return_type string, days_late int, tax_liability double")
    df = df.withColumn("tax_liability", F.col("tax_liability").cast("decimal(18,2)"))
    got = {r.id: (r.penalty, r.interest, r.total) for r in FL.assess_penalties(df).collect()}
    assert got[1] == (500, 0.0, 500.0)
    assert got[2] == (10000, 0.0, 10000.0)
    assert got[3] == (500, 246.58, 746.58)
    assert got[4] == (200, 0.0, 200.0)
    assert got[5] == (0, 0.0, 0.0)
    assert got[6] == (0, 0.0, 0.0)


def test_deadlines():
    d = deadlines("2025-12", "2025-12-15")
    assert (d["gstr1_deadline"], d["gstr3b_deadline"]) == ("2026-01-11", "2026-01-20")
    d = deadlines("2025-03", "2025-04-01")
    assert (d["gstr1_deadline"], d["gstr3b_deadline"], d["days_to_gstr1"]) == ("2025-04-11", "2025-04-20", 10)


def test_liability(spark):
    df = spark.createDataFrame([(1, "2024-01-05", 10000.0, "sale", 18, None), (1, "2024-01-06", 5000.0, "purchase", 12, True)],
                               "user_id long, date string, amount double, type string, gst_rate int, itc_eligible boolean")
    df = df.withColumn("amount", F.col("amount").cast("decimal(18,2)")).withColumn("date", F.to_timestamp("date"))
    r = A.gst_liability(df).collect()[0]
    assert (r.total_gst_collected, r.total_itc_available, r.net_liability) == (1800.0, 600.0, 1200.0)


def test_score_and_status(spark):
    from itcflow.functions import core as C
    df = spark.createDataFrame([(3200.0, 8), (0.0, 0), (600.0, 2)], "itc double, n long")
    df = df.withColumn("itc", F.col("itc").cast("decimal(18,2)"))
    got = [(r.s, r.st) for r in df.select(C.score(F.col("itc"), F.col("n")).alias("s"),
                                           C.compliance_status(F.col("itc")).alias("st")).collect()]
    assert got == [(100, "compliant"), (0, "at-risk"), (22, "attention")]


def test_amounts_phone_dates(spark):
    df = spark.createDataFrame([("₹1,234.50 Dr",), ("",), ("abc",), ("Rs 1,500",)], "s string")
    got = [(r.a, r.e) for r in df.select(clean_amount(F.col("s")).alias("a"), clean_edit_amount(F.col("s")).alias("e")).collect()]
    assert got == [(1234.5, None), (None, None), (None, None), (None, 1500.0)]
    p = spark.createDataFrame([("whatsapp:+919876543210",), ("whatsapp:+14155238886",)], "s string")
    assert [r.p for r in p.select(norm_phone(F.col("s")).alias("p")).collect()] == ["9876543210", "14155238886"]
    d = spark.createDataFrame([("3-2-2024",), ("03/02/2024",), ("2024-02-03",), ("31-02-2024",), ("n/a",)], "s string")
    got = [r.d for r in d.select(F.date_format(parse_invoice_date(F.col("s")), "yyyy-MM-dd").alias("d")).collect()]
    assert got == ["2024-02-03", "2024-02-03", "2024-02-03", None, None]


def test_keyword_rules(spark):
    df = spark.createDataFrame([("Laptop purchase Dell Inspiron",), ("milk",), ("saree",), ("Diesel fill",),
                                ("zzz",)], "d string")
    got = [r.c for r in df.select(K.keyword_category(F.col("d")).alias("c")).collect()]
    assert got == ["Electronics", "Electronics", "Clothing", "Vehicle", "Other"]
    b = spark.createDataFrame([("NEFT rent May",), ("Salary April",), ("misc",)], "d string")
    got = [r.c for r in b.select(K.bank_category(F.col("d")).alias("c")).collect()]
    assert got == ["rent", "salary", "other"]


def test_trie_regex_equals_substring_semantics():
    import re

    from itcflow.functions import fixed
    texts = ["my pencil", "x-ray report", "notebook", "aws bill", "1mg order", "", "t-shirt", "ola cab", "amul milk"]
    for _, words in fixed.KEYWORD_RULES + fixed.BANK_CATEGORIES:
        rx = re.compile(K.trie_regex(words))
        for t in texts:
            assert bool(rx.search(t)) == any(w in t for w in words), (words[:3], t)


def test_intents(spark):
    df = spark.createDataFrame([("yes",), ("edit gst",), ("edit foo",), ("deadline",), ("nahi",), ("hello",),
                                ("bhai",)], "body string")
    r = {x.body: x for x in IN.tag_intent(df).collect()}
    assert r["yes"].pending_action == "confirm"
    assert (r["edit gst"].pending_action, r["edit gst"].edit_field) == ("edit", "seller_gstin")
    assert r["edit foo"].pending_action == "ask_field"
    assert r["deadline"].intent == "deadline"
    assert r["nahi"].pending_action == "cancel"
    assert r["bhai"].pending_action == "confirm"  # substring 'ha' is a confirm word, tested first
    assert r["hello"].intent == "greeting"


def test_photo_triage(spark):
    m = spark.createDataFrame([(1, 50.0, 60.0, 640, 480), (2, 500.0, 120.0, 1024, 768)],
                              "image_id long, blur double, brightness double, width int, height int")
    r = {x.image_id: x for x in IN.photo_triage(m).collect()}
    assert r[1].score == 30 and r[1].needs_preprocessing
    assert r[1].issues == ["Blurry (score: 50)", "Too dark (brightness: 60)", "Low resolution (640x480)"]
    assert r[2].score == 100 and not r[2].needs_preprocessing and r[2].issues == []


def test_gstr3b_document_shape(spark):
    """Portal-shaped document: sections, fixed rows, eligible vs blocked heads."""
    import json

    from conftest import SF001
    from itcflow.sources.tables import Model
    m = Model(spark, SF001)
    docs = FL.gstr3b_document(m.invoices, m.users)
    r = docs.orderBy("user_id", "period").select("file_name", "ret_period", "period", "gstin",
                                                 F.to_json("doc").alias("j"), "eligible_itc", "blocked_itc").first()
    d = json.loads(r.j)
    assert r.file_name == f"GSTR3B_{r.gstin}_{r.ret_period}.json"
    assert r.ret_period == r.period[5:7] + r.period[:4]
    assert set(d) >= {"gstin", "ret_period", "inward_dtls", "itc_elg", "sup_details", "inter_sup", "intr_ltfee"}
    assert [x["ty"] for x in d["itc_elg"]["itc_avl"]] == ["IMPG", "IMPS", "ISRC", "ITC", "OTH"]
    assert [x["ty"] for x in d["itc_elg"]["itc_rev"]] == ["RUL", "OTH"]
    itc = d["itc_elg"]["itc_avl"][3]
    net = d["itc_elg"]["itc_net"]
    assert (itc["igst"], itc["cgst"], itc["sgst"]) == (net["igst"], net["cgst"], net["sgst"])
    inelg = d["itc_elg"]["itc_inelg"][0]
    assert abs(inelg["igst"] + inelg["cgst"] + inelg["sgst"] - r.blocked_itc) < 1e-6
    assert abs(net["igst"] + net["cgst"] + net["sgst"] - r.eligible_itc) < 1e-6
    assert d["inward_dtls"]["isup_details"][0]["ty"] == "OTH"
    assert set(d["sup_details"]) == {"osup_det", "osup_zero", "osup_nil_exmp", "isup_rev", "osup_nongst"}


def test_bank_layouts_and_fallback(spark):
    """Hand-built statement rows: layout parsing, header skip, Dr/Cr amounts,
    a bank whose layout finds nothing falls back to the generic reading."""
    from itcflow.operators import bank as B
    rows = [
        (1, 1, "HDFC Bank Ltd", ["01/02/2024", "Narration", "", "01/02/2024", "", "", ""]),   # header row
        (1, 2, "HDFC Bank Ltd", ["03/02/2024", "NEFT rent May", "ref", "03/02/2024", "₹1,234.50 Dr", "", "5,000.00"]),
        (1, 3, "HDFC Bank Ltd", ["04/02/2024", "Salary April", "ref", "04/02/2024", "", "10,000.00 Cr", "15,000.00"]),
        (2, 1, "State Bank of India", ["05 Feb 2024", "05 Feb 2024", "Vendor bill", "r", "700.00", "", "1.00"]),
        (3, 1, "ICICI Bank", ["1", "x", "06-02-2024", "", "Uber cab", "250.00", "", "9.00"]),
        (4, 1, "Axis Bank", ["no date here", "Lunch", "", "100.00", "", "1.00"]),          # layout finds nothing
        (4, 2, "Axis Bank", ["x", "07/02/24", "Lunch", "nan", "-5", "80.00"]),             # generic reading
        (5, 1, "Village Bank", ["08/02/24", "misc", "12.00", "7.50"]),
    ]
    cells = spark.createDataFrame(rows, "statement_id long, row_no long, page_text string, cells array<string>")
    t = {(r.statement_id, r.row_no): r for r in B.statement_transactions(cells).collect()}
    assert (1, 1) not in t                                      # header words skipped
    r = t[(1, 2)]
    assert (r.bank, r.debit, r.type, r.amount, r.balance, r.category, r.itc_possible) == \
        ("HDFC", 1234.5, "debit", 1234.5, 5000.0, "rent", True)
    r = t[(1, 3)]
    assert (r.credit, r.type, r.amount, r.category) == (10000.0, "credit", 10000.0, "salary")
    assert (t[(2, 1)].bank, t[(2, 1)].description, t[(2, 1)].category) == ("SBI", "Vendor bill", "purchase")
    assert (t[(3, 1)].bank, t[(3, 1)].date, t[(3, 1)].category) == ("ICICI", "06-02-2024", "travel")
    r = t[(4, 2)]                                               # fallback: first date in cells 1-3, positive amounts
    # text = non-date cells among cells 2..4 (the amount "-5" is cell 5)
    assert (r.bank, r.date, r.debit, r.credit, r.balance, r.description) == ("AXIS", "07/02/24", 80.0, None, None,
                                                                            "Lunch nan")
    assert (4, 1) not in t
    r = t[(5, 1)]
    assert (r.bank, r.debit, r.credit, r.amount) == ("GENERIC", 12.0, 7.5, 12.0)


def test_bank_of_all_pages_and_empty_statements(spark):
    """A bank is found once, on all pages; nothing is lost on pages that don't
    name it; statements without transactions have a summary, scans an error."""
    from itcflow.operators import bank as B
    rows = [
        (1, 1, "HDFC Bank Ltd", ["03/02/2024", "NEFT rent May", "ref", "03/02/2024", "100.00", "", "5,000.00"]),
        (1, 2, "Page 2", ["04/02/2024", "\tVendor bill\n", "ref", "04/02/2024", "50.00", "", "4,950.00"]),
        (2, 1, "Kotak Mahindra", ["Opening", "balance"]),
        (3, 1, " ", ["05/02/24", "misc", "12.00", "7.50"]), (3, 2, None, ["x"]),
    ]
    cells = spark.createDataFrame(rows, "statement_id long, row_no long, page_text string, cells array<string>")
    tx = B.statement_transactions(cells)
    got = {(r.statement_id, r.row_no): (r.bank, r.description, r.debit) for r in tx.collect()}
    assert got == {(1, 1): ("HDFC", "NEFT rent May", 100.0), (1, 2): ("HDFC", "Vendor bill", 50.0), (3, 1): ("GENERIC", "misc 12.00 7.50", 12.0)}
    summary = {r.statement_id: (r.bank, r.total_transactions, r.total_debit) for r in B.statement_summary(tx, cells).collect()}
    assert summary == {1: ("HDFC", 2, 150.0), 2: ("KOTAK", 0, 0.0)}
    assert [r.statement_id for r in B.unreadable_statements(cells).collect()] == [3]


def test_inr_text(spark):
    from itcflow.functions import core as C
    df = spark.createDataFrame([(123456.5,), (1234.56,), (100.0,), (0.0,), (12345678.05,), (99999.9,)], "x double")
    got = [r.t for r in df.select(C.inr_text("x").alias("t")).collect()]
    assert got == ["₹1,23,456.5", "₹1,234.56", "₹100", "₹0", "₹1,23,45,678.05", "₹99,999.9"]
