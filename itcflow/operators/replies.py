"""the chat replies that need the store as it was when a message came.

Everything saved (the stored invoices and those confirmed in the chat) becomes
signed changes of a sender's figures: what an invoice adds to a month's figures
when it is saved it takes away again when a month begins for which it no longer
counts. The figures at a message are then plain sums of the changes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions import fixed
from ..functions import keywords as K
from ..functions.calendar import chat_urgency
from ..functions.text import norm_phone, parse_invoice_date
from .asof import as_of_sums
from .filing import report_text, template

_MONEY = "decimal(28,2)"
FIGURES = ["itc", "invoices", "purchases", "blocked", "chat_saves"]


def chat_saves(done: DataFrame) -> DataFrame:
    """The invoices confirmed in the chat, from the session steps (R1): saved at the
    confirming message, whose id is also the invoice's. Amounts that are no
    numbers count as 0, dates that can't be read as missing."""
    f = F.col("fields")

    def money(c: str) -> Column:
        return F.coalesce(f[c].try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).alias(c)
    return done.filter(F.col("action") == "saved").select(
        "sender", "event_id", "ts", *[f[c].alias(c) for c in ("invoice_no", "invoice_date", "total_amount", "description")],
        money("taxable_amount").alias("taxable_amt"), money("cgst"), money("sgst"), money("igst"))


def _saves(done: DataFrame, inv: DataFrame, usr: DataFrame) -> DataFrame:
    """``sender, at, seq, date, taxable_amt, itc, status, chat_saves`` of everything saved.
    A phone that several users share belongs to the smallest id (S2)."""
    owner = (usr.select(norm_phone(F.col("phone")).alias("sender"), F.col("id").alias("user_id"))
                .filter(F.col("sender") != "").groupBy("sender").agg(F.min("user_id").alias("user_id")))
    stored = inv.join(owner, "user_id").select(
        "sender", F.col("created_at").cast("timestamp").alias("at"), F.lit(-1).cast("long").alias("seq"),
        F.col("date").cast("timestamp").alias("date"), C.amt("taxable_amt").alias("taxable_amt"), C.itc_exclusive().alias("itc"),
        "status", F.lit(0).alias("chat_saves"))
    mine = chat_saves(done)
    told = F.when(C.blank_to_null("invoice_date").isNotNull(), parse_invoice_date(F.col("invoice_date")))
    return stored.unionByName(mine.select(
        "sender", F.col("ts").alias("at"), F.col("event_id").alias("seq"), told.cast("timestamp").alias("date"), "taxable_amt",
        C.itc_exclusive().alias("itc"), F.lit("pending").alias("status"), F.lit(1).alias("chat_saves")))


def figure_changes(saves: DataFrame) -> DataFrame:
    """``sender, at, seq`` and a change of each of ``FIGURES``. The ledger's ITC of a
    month lasts from the save to the end of the month of the save. The month-to-date
    report counts an invoice dated on or after the first of the message's month:
    from the save to the end of the month of its date, not at all if that is over."""
    def next_month(c: str) -> Column:
        return F.add_months(F.trunc(F.col(c), "month"), 1).cast("timestamp")
    counts = F.coalesce(F.col("date") >= F.trunc("at", "month"), F.lit(False))

    def change(at: Column, seq: Column, sign: int, **figures: Column) -> Column:
        zero = F.lit(0).cast(_MONEY)
        return F.struct(at.alias("at"), seq.cast("long").alias("seq"),
                        *[(figures[c].cast(_MONEY) * sign if c in figures else zero).cast(_MONEY).alias(c) for c in FIGURES])
    report = {"invoices": F.lit(1), "purchases": F.col("taxable_amt"), "blocked": F.when(F.col("status") == "blocked", 1).otherwise(0)}
    opened = F.lit(-2)   # a month begins before anything is saved in it
    moves = F.array(
        change(F.col("at"), F.col("seq"), 1, itc=F.col("itc"), chat_saves=F.col("chat_saves")),
        change(next_month("at"), opened, -1, itc=F.col("itc")),
        F.when(counts, change(F.col("at"), F.col("seq"), 1, **report)),
        F.when(counts, change(next_month("date"), opened, -1, **report)))
    return saves.select("sender", F.inline(F.array_compact(moves)))


def _standing(asks: DataFrame, done: DataFrame, inv: DataFrame, usr: DataFrame) -> DataFrame:
    asks = asks.withColumn("at", F.col("ts")).withColumn("seq", F.col("event_id"))
    return as_of_sums(asks, figure_changes(_saves(done, inv, usr)), ["sender"], ["at", "seq"], FIGURES).drop("at", "seq")


def saved_replies(done: DataFrame, inv: DataFrame, usr: DataFrame, policy: str = "dashboard") -> DataFrame:
    """``sender, event_id, message``: the reply to every confirmed invoice: its fields,
    the category of its description, the credit it brings or that it is blocked,
    and the month's ITC in the ledger with this save. Empty and zero fields have no line."""
    x = _standing(chat_saves(done), done, inv, usr)
    total = C.blank_to_null("total_amount")
    shown = {"invoice_no": C.blank_to_null("invoice_no"), "invoice_date": C.blank_to_null("invoice_date"),
             "total_amount": F.when(F.coalesce(total.try_cast("double") != 0, F.lit(True)), total)}
    lines = [F.coalesce(F.concat(F.lit(label), shown[c], F.lit("\n")), F.lit("")) for c, label in fixed.SAVED_LINES]
    desc = F.coalesce(C.blank_to_null("description"), F.lit(fixed.DEFAULT_DESCRIPTION))
    short = F.length(F.trim(desc)) < 3
    cat = F.when(short, "Other").otherwise(K.keyword_category(desc))
    conf = F.when(short, 0.0).when(F.col("_cat") != "Other", fixed.KEYWORD_CONFIDENCE).otherwise(fixed.FALLBACK_CONFIDENCE)
    itc = F.col("cgst") + F.col("sgst") + F.col("igst")
    text = F.concat(
        F.lit(fixed.SAVED_HEAD), *lines,
        template(fixed.SAVED_CATEGORY, cat=F.col("_cat"), conf=(conf * 100).cast("int").cast("string")),
        F.when(C.is_blocked(F.col("_cat"), policy), F.lit(fixed.SAVED_BLOCKED))
         .when(itc > 0, template(fixed.SAVED_ITC, itc=F.format_number(itc, 2))).otherwise(F.lit("")),
        template(fixed.SAVED_MONTH, total=F.format_number("itc", 2), id=F.col("event_id").cast("string")),
        F.lit(fixed.SAVED_TAIL))
    return x.withColumn("_cat", cat).select("sender", "event_id", text.alias("message"))


def summary_replies(done: DataFrame, inv: DataFrame, usr: DataFrame) -> DataFrame:
    """``sender, event_id, message``: the monthly report asked for in the chat, as it stood
    when the message came. Senders who are no user and have saved nothing are told
    so; a message without a time has no month and no reply (null)."""
    asks = done.filter((F.col("action") == "intent") & (F.col("detail") == "summary")).select("sender", "event_id", "ts")
    known = usr.select(norm_phone(F.col("phone")).alias("sender"), F.lit(True).alias("is_user")).distinct()
    x = _standing(asks, done, inv, usr).join(known, "sender", "left")
    day = F.to_date("ts")
    due = {c: F.date_add(F.add_months(F.trunc(day, "month"), 1), d - 1)
           for c, d in (("gstr1", fixed.GSTR1_DAY), ("gstr3b", fixed.GSTR3B_DAY))}
    x = x.withColumns({**{f"{c}_deadline": d.cast("string") for c, d in due.items()},
                       **{f"days_to_{c}": F.datediff(d, day) for c, d in due.items()},
                       "total_invoices": F.col("invoices").cast("long"), "total_purchases": F.col("purchases"),
                       "total_itc": F.col("itc"), "blocked_count": F.col("blocked").cast("long")})
    x = x.withColumn("urgency", chat_urgency(F.col("days_to_gstr3b")))
    text = (F.when(F.col("ts").isNull(), F.lit(None).cast("string"))
             .when(F.col("is_user").isNull() & (F.col("chat_saves") == 0), F.lit(fixed.SUMMARY_NO_USER))
             .otherwise(report_text(F.date_format("ts", "MMMM yyyy"))))
    return x.select("sender", "event_id", text.alias("message"))
