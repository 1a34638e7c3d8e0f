"""Bank statements: cell rows -> transactions -> categories -> summary
(S3, F12-F16, U3, A12, T6, P15).

Input rows are already-extracted table rows ``(statement_id, row_no,
page_text, cells array<string>)``. Each layout is a row of parameters
(cell positions, date pattern, header words); extraction is projection +
filter, and the five bank layouts are one pass: every row reads the layout
of its statement's bank through a ``CASE`` on the detected bank. A bank is
detected once per statement, on the texts of all its pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions import fixed
from ..functions import keywords as K
from ..functions.text import clean_amount
from ..sources.tables import staged
from .windows import top_per_group


def _cell(i: int):
    """0-based cell i, '' when the row is shorter (cells are trimmed)."""
    return F.coalesce(F.get(F.col("tcells"), i), F.lit(""))


def _truthy(x):
    return x.isNotNull() & (x != 0)


#: What cells are trimmed of.
BLANK = " \t\n\x0b\x0c\r\u00a0"


def detect_banks(cells: DataFrame) -> DataFrame:
    """``statement_id, bank, has_text``: the first bank, in rule order, that
    any page of the statement names; GENERIC if none. Pages without text name
    none; ``has_text`` is false if all are such (nothing could be read)."""
    low = F.lower(F.coalesce("page_text", F.lit("")))
    rules = [(str(i), words) for i, (_, words) in enumerate(fixed.BANK_DETECTION)]
    rank = K.first_group(low, rules, str(len(rules))).cast("int")
    names = F.array(*[F.lit(b) for b, _ in fixed.BANK_DETECTION], F.lit(fixed.GENERIC_BANK))
    return (cells.groupBy("statement_id").agg(F.min(rank).alias("_r"), F.max(F.btrim(low, F.lit(BLANK)) != "").alias("has_text"))
                 .select("statement_id", F.get(names, F.col("_r")).alias("bank"), "has_text"))


def normalise_cells(cells: DataFrame) -> DataFrame:
    """Cells trimmed (NULL -> ''), with the bank of their statement. The banks, one row
    a statement, are what the join holds in memory; the cells stream past, unsorted."""
    rows = cells.select("statement_id", "row_no",
                        F.transform("cells", lambda c: F.coalesce(F.btrim(c, F.lit(BLANK)), F.lit(""))).alias("tcells"))
    return rows.join(detect_banks(cells).select("statement_id", "bank").hint("shuffle_hash"), "statement_id")


_OUT = ["date", "description", "debit", "credit", "balance", "type", "amount"]


def _param(i: int):
    """Column of one layout parameter, chosen by the statement's bank."""
    e = None
    for lay in fixed.BANK_LAYOUTS:
        v = lay[i]
        v = F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
        e = F.when(F.col("bank") == lay[0], v) if e is None else e.when(F.col("bank") == lay[0], v)
    return e


def _with_layout(n: DataFrame) -> DataFrame:
    """Layout parameters as columns (NULL for GENERIC): cell positions, the
    date pattern and header words. Per-row work then references them, so
    each field is computed by one expression whatever the bank."""
    names = ["min_cells", "date_cells", "text_pos", "debit_pos", "credit_pos", "balance_pos", "date_re", "headers"]
    return n.select("*", *[_param(i + 1).alias("_" + nm) for i, nm in enumerate(names)])


def _at(pos):
    return F.coalesce(F.get(F.col("tcells"), pos), F.lit(""))


def _layout_fields() -> dict:
    # the date test is a literal pattern per layout (compiled once per task),
    # chosen by the bank, rather than a per-row pattern column
    date = None
    for bank, _, dcs, *_rest in fixed.BANK_LAYOUTS:
        rx = _rest[-2]
        hit = F.coalesce(*[F.when(_cell(i).rlike(rx), _cell(i)) for i in dcs])
        date = F.when(F.col("bank") == bank, hit) if date is None else date.when(F.col("bank") == bank, hit)
    desc = _at(F.col("_text_pos"))
    ok = ((F.size("tcells") >= F.col("_min_cells")) & date.isNotNull() & (desc != "")
          & ~F.array_contains(F.col("_headers"), F.lower(desc)))
    d, c, b = (clean_amount(_at(F.col(x))) for x in ("_debit_pos", "_credit_pos", "_balance_pos"))
    return {"ok": F.coalesce(ok, F.lit(False)), "date": date, "description": desc, "debit": d, "credit": c,
            "balance": b, "type": F.when(_truthy(d), "debit").otherwise("credit"),
            "amount": F.when(_truthy(d), d).when(_truthy(c), c).otherwise(F.lit(0.0))}


def _generic_fields() -> dict:
    rx = fixed.GENERIC_DATE_REGEX
    date = F.coalesce(*[F.when(_cell(i).rlike(rx), _cell(i)) for i in range(3)])
    # positive amounts; NaN is excluded (Spark orders NaN above all numbers,
    # the application's `nan > 0` is false)
    amts = F.filter(F.transform("tcells", lambda c: clean_amount(c)), lambda a: a.isNotNull() & (a > 0) & ~F.isnan(a))
    text_cells = F.filter(F.slice("tcells", 2, 3), lambda c: (c != "") & ~c.rlike(rx))
    return {"date": date, "amts": amts,
            "description": F.substring(F.array_join(text_cells, " "), 1, fixed.GENERIC_TEXT_CHARS)}


def _generic_out(prefix: str = "") -> list:
    a = F.col(prefix + "amts")
    return [F.col(prefix + "date").alias("date"), F.col(prefix + "description").alias("description"),
            F.get(a, 0).alias("debit"), F.get(a, 1).alias("credit"),
            F.when(F.size(a) > 2, F.element_at(a, -1)).alias("balance"), F.lit("debit").alias("type"),
            F.get(a, 0).alias("amount")]


def extract_rows(n: DataFrame) -> DataFrame:
    """rows of HDFC/SBI/ICICI/AXIS/KOTAK statements by their layouts."""
    f = _layout_fields()
    x = _with_layout(n).filter(F.col("bank") != fixed.GENERIC_BANK)
    x = x.select("statement_id", "row_no", "bank", *[f[k].alias(k) for k in ["ok"] + _OUT])
    return x.filter("ok").select("statement_id", "row_no", *_OUT, "bank")


def extract_generic(n: DataFrame) -> DataFrame:
    """first date among the 3 leading cells; positive amounts anywhere in
    the row; text = non-date cells 2..4 joined, cut to 100 characters."""
    g = _generic_fields()
    x = n.filter(F.size("tcells") >= fixed.GENERIC_MIN_CELLS).select(
        "statement_id", "row_no", "bank", *[g[k].alias(k) for k in ("date", "amts", "description")])
    x = x.filter(F.col("date").isNotNull() & (F.size("amts") > 0))
    return x.select("statement_id", "row_no", *_generic_out(), "bank")


def normalise_statements(cells: DataFrame) -> DataFrame:
    """Layout rows, plus the generic reading of the statements whose bank
    is unknown or whose layout found nothing. Statements of no known bank go
    to the generic reading at once; only those of a known bank are looked up
    among the layout's hits. ``bank`` is the detected one in either case."""
    n = normalise_cells(cells)
    known = n.filter(F.col("bank") != fixed.GENERIC_BANK)
    spec = extract_rows(known)
    have = spec.select("statement_id").distinct().hint("shuffle_hash")   # as in normalise_cells
    generic = n.filter(F.col("bank") == fixed.GENERIC_BANK).unionByName(known.join(have, "statement_id", "left_anti"))
    return spec.unionByName(extract_generic(generic))


def categorise(txns: DataFrame) -> DataFrame:
    """F16: narration category; ITC possible (and invoice needed) for
    purchase, utility and rent."""
    cat = K.bank_category(F.col("description"))
    itc = cat.isin(fixed.BANK_ITC_CATEGORIES)
    return txns.select("*", cat.alias("category"), itc.alias("itc_possible"), itc.alias("needs_invoice"))


def statement_transactions(cells: DataFrame) -> DataFrame:
    return categorise(normalise_statements(cells))


def statement_summary(txns: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per statement with text: detected bank, count, debit and
    credit totals (exact), ITC-possible count, four category counts. A
    statement without a transaction has zeros; one whose pages have no text
    has no row (``unreadable_statements``)."""
    money = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast(C.MONEY)
    names = ["purchase", "salary", "travel", "food"]
    g = txns.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(money("debit")).alias("total_debit"), F.sum(money("credit")).alias("total_credit"),
        F.count_if("itc_possible").alias("itc_possible_count"),
        *[F.count_if(F.col("category") == k).alias(f"{k}_count") for k in names])
    counts = ["total_transactions", "itc_possible_count", *[f"{k}_count" for k in names]]
    x = detect_banks(cells).filter("has_text").join(g, "statement_id", "left").fillna(0, counts)
    return x.select("statement_id", "bank", "total_transactions",
                    F.coalesce(C.to_double("total_debit"), F.lit(0.0)).alias("total_debit"),
                    F.coalesce(C.to_double("total_credit"), F.lit(0.0)).alias("total_credit"), "itc_possible_count",
                    *[f"{k}_count" for k in names])


def unreadable_statements(cells: DataFrame) -> DataFrame:
    """Statements whose pages have no text (scans), with the application's error."""
    return detect_banks(cells).filter("not has_text").select("statement_id", F.lit(fixed.STATEMENT_NO_TEXT).alias("error"))


def itc_possible(txns: DataFrame) -> DataFrame:
    """Rows where ITC may be claimed."""
    return txns.filter(F.col("itc_possible"))


def itc_rows_head(txns: DataFrame, n: int = fixed.ITC_ROWS_SHOWN) -> DataFrame:
    """First n ITC-possible rows of each statement (row order), text cut to 30."""
    t = top_per_group(itc_possible(txns), "statement_id", [F.col("row_no")], n)
    return t.select("statement_id", "rank", "row_no", "date",
                    F.substring("description", 1, fixed.ITC_ROW_TEXT_CHARS).alias("text"),
                    "amount", F.format_number("amount", 0).alias("amount_text"))


def _tpl(t: str, **cols):
    import re
    parts = re.split(r"\{(\w+)\}", t)
    return F.concat(*[F.lit(p) if i % 2 == 0 else cols[p] for i, p in enumerate(parts)])


def statement_replies(txns: DataFrame, cells: DataFrame) -> DataFrame:
    """the chat reply to each parsed statement: counts and totals, then
    the first five ITC-possible rows. The transactions are read out of the cells
    once, for both; the rows come ranked and sorted out of the top-5, so that
    their lines are put together as they pass."""
    txns = staged(txns.select("statement_id", "row_no", "date", "description", "debit", "credit", "amount", "category",
                              "itc_possible"), "transactions")
    summ = statement_summary(txns, cells)
    head = itc_rows_head(txns)
    lines = head.select("statement_id", "rank", _tpl(fixed.STATEMENT_ITC_LINE, date=F.col("date"), text=F.col("text"),
                                                     amount=F.col("amount_text")).alias("line"))
    lst = lines.groupBy("statement_id").agg(F.concat_ws("", *[
        F.max(F.when(F.col("rank") == i + 1, F.col("line"))) for i in range(fixed.ITC_ROWS_SHOWN)]).alias("lines"))
    x = summ.join(lst, "statement_id", "left")
    itc = F.col("itc_possible_count").cast("string")
    body = F.concat(
        _tpl(fixed.STATEMENT_HEAD, bank=F.col("bank"), n=F.col("total_transactions").cast("string"),
             debit=F.format_number(F.round("total_debit", 2), 2), credit=F.format_number(F.round("total_credit", 2), 2),
             itc=itc),
        F.when(F.col("lines").isNotNull(), F.concat(F.lit(fixed.STATEMENT_ITC_TITLE), F.col("lines"))).otherwise(F.lit("")),
        _tpl(fixed.STATEMENT_TAIL, itc=itc))
    return x.select("statement_id", body.alias("reply"))
