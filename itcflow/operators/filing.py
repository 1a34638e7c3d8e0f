"""Filing documents, penalties, deadline reminders and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as K
from ..functions import core as C
from ..functions import fixed
from ..functions.text import e164
from ..sources.keyed import KeyedTable
from . import aggregates as A
from . import invoices as I

D = C.to_double


def _heads(ty, igst=None, cgst=None, sgst=None, cess_key="cess"):
    z = F.lit(0.0)
    return F.struct(F.lit(ty).alias("ty"), (igst if igst is not None else z).alias("igst"),
                    (cgst if cgst is not None else z).alias("cgst"), (sgst if sgst is not None else z).alias("sgst"),
                    z.alias(cess_key))


def gstr3b_document(inv: DataFrame, usr: DataFrame, period: str | None = None, policy: str = "dashboard",
                    ca_id: int | None = None, generated_at: str | None = None) -> DataFrame:
    """The portal-shaped GSTR-3B document of every (client, month).

    Only clients of a CA with a GSTIN get a document (the reference answers 400
    otherwise). The inward-supply list is *not* nested into the document: a
    client-month can hold any number of invoices, so it is a separate table
    (``gstr3b_supplies``) written beside the document; nothing is collected
    into one array in one task.
    """
    t = A.gstr3b_totals(I.scope(inv, usr, ca_id), policy, period)
    u = I.tenant_users(usr, ca_id).filter(F.coalesce(F.col("gstin"), F.lit("")) != "").select(
        F.col("id").alias("user_id"), "gstin", F.coalesce("business_name", F.lit("")).alias("client_name"))
    j = t.join(u, "user_id")
    ret = F.concat(F.substring("period", 6, 2), F.substring("period", 1, 4))
    r2 = lambda c: F.round(F.col(c), 2)
    doc = F.struct(
        F.col("gstin").alias("gstin"), ret.alias("ret_period"),
        F.struct(F.array(F.struct(F.lit("OTH").alias("ty"), r2("el_igst").alias("inter"), r2("intra").alias("intra"),
                                  F.lit(0).alias("exmt"), F.lit(0).alias("ngsup"))).alias("isup_details"))
         .alias("inward_dtls"),
        F.struct(
            F.array(_heads("IMPG"), _heads("IMPS"), _heads("ISRC"),
                    _heads("ITC", r2("el_igst"), r2("el_cgst"), r2("el_sgst")), _heads("OTH")).alias("itc_avl"),
            F.array(_heads("RUL"), _heads("OTH")).alias("itc_rev"),
            F.struct(r2("el_igst").alias("igst"), r2("el_cgst").alias("cgst"), r2("el_sgst").alias("sgst"),
                     F.lit(0).alias("cess")).alias("itc_net"),
            F.array(_heads("RUL", r2("bl_igst"), r2("bl_cgst"), r2("bl_sgst")), _heads("OTH")).alias("itc_inelg"),
        ).alias("itc_elg"),
        F.struct(
            F.struct(*[F.lit(0).alias(k) for k in ["txval", "igst", "cgst", "sgst", "cess"]]).alias("osup_det"),
            F.struct(*[F.lit(0).alias(k) for k in ["txval", "igst", "cgst", "sgst", "cess"]]).alias("osup_zero"),
            F.struct(F.lit(0).alias("txval")).alias("osup_nil_exmp"),
            F.struct(*[F.lit(0).alias(k) for k in ["txval", "igst", "cgst", "sgst", "cess"]]).alias("isup_rev"),
            F.struct(F.lit(0).alias("txval")).alias("osup_nongst"),
        ).alias("sup_details"),
        F.struct(*[F.array().cast("array<string>").alias(k) for k in ["unreg_details", "comp_details", "uin_details"]])
         .alias("inter_sup"),
        F.struct(F.struct(*[F.lit(0).alias(k) for k in ["cgst", "sgst", "igst"]]).alias("intr_details"),
                 F.struct(*[F.lit(0).alias(k) for k in ["cgst", "sgst", "igst"]]).alias("fee_details")).alias("intr_ltfee"),
        F.struct(F.lit("itcflow").alias("generated_by"),
                 F.lit(generated_at).cast("string").alias("generated_at"),
                 F.col("period").alias("period"), F.col("client_name").alias("client_name"),
                 F.col("total_invoices").alias("total_invoices"), r2("total_taxable").alias("total_taxable"),
                 r2("eligible_itc").alias("eligible_itc"), r2("blocked_itc").alias("blocked_itc")).alias("_meta"),
    )
    return j.select("user_id", "gstin", "period", ret.alias("ret_period"),
                    F.concat(F.lit("GSTR3B_"), F.col("gstin"), F.lit("_"), ret, F.lit(".json")).alias("file_name"),
                    "total_invoices", "total_taxable", "eligible_itc", "blocked_itc", doc.alias("doc"))


def gstr3b_supplies(inv: DataFrame, usr: DataFrame, period: str | None = None, policy: str = "dashboard",
                    ca_id: int | None = None) -> DataFrame:
    """Inward-supply lines of each document (one row per invoice)."""
    src = I.scope(inv.filter(F.col("status") == "confirmed"), usr, ca_id)
    src = C.in_period(src, period) if period else src.filter(F.col("date").isNotNull())
    cat = C.category()
    return src.select("user_id", C.ym("date").alias("period"), F.col("id").alias("invoice_id"),
                      F.col("invoice_no"), F.col("seller_gstin").alias("supplier_gstin"),
                      F.coalesce(F.date_format("date", "dd-MM-yyyy"), F.lit("")).alias("invoice_date"),
                      D(F.round(C.amt("taxable_amt"), 2)).alias("taxable_value"),
                      D(F.round(C.amt("igst"), 2)).alias("igst"), D(F.round(C.amt("cgst"), 2)).alias("cgst"),
                      D(F.round(C.amt("sgst"), 2)).alias("sgst"), cat.alias("ai_category"),
                      F.round(F.coalesce("ai_confidence", F.lit(0.0)), 2).alias("ai_confidence"),
                      (~C.is_blocked(cat, policy)).alias("itc_eligible"))


def write_gstr3b(docs: DataFrame, supplies: DataFrame, path: str) -> None:
    """GSTR-3B documents as JSON lines, one folder per return period; each
    line is one (gstin, period) document with its portal file name. The supply
    lines go beside them, keyed by gstin. Partitioning by period (not by
    period x gstin) keeps the file count proportional to the data instead of
    one directory per client-month; dynamic overwrite makes re-runs idempotent.
    The files are compressed: the lines of a period are much alike.
    """
    (docs.select("ret_period", F.to_json(F.struct("file_name", "gstin", "doc")).alias("value"))
         .write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="gzip")
         .partitionBy("ret_period").text(f"{path}/documents"))
    key = docs.select("user_id", "period", "gstin", "ret_period")
    cols = [c for c in supplies.columns if c not in ("user_id", "period")]
    (supplies.join(key, ["user_id", "period"])
             .select("ret_period", F.to_json(F.struct("gstin", *cols)).alias("value"))
             .write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression="gzip")
             .partitionBy("ret_period").text(f"{path}/supplies"))


def read_gstr3b(path: str, docs: DataFrame, supplies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents and supply lines that ``write_gstr3b`` wrote, typed as the tables they came from."""
    spark = docs.sparkSession
    period = F.lpad(F.col("ret_period").cast("string"), 6, "0").alias("ret_period")   # the folder's name reads as a number
    one = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("gstin", T.StringType()), docs.schema["doc"]])
    line = T.StructType([T.StructField("gstin", T.StringType()),
                         *[f for f in supplies.schema.fields if f.name not in ("user_id", "period")]])
    d = spark.read.text(f"{path}/documents").select(period, F.from_json("value", one).alias("v"))
    x = spark.read.text(f"{path}/supplies").select(period, F.from_json("value", line).alias("v"))
    return d.select("ret_period", "v.*"), x.select("ret_period", "v.*")


def assess_penalties(filings: DataFrame) -> DataFrame:
    """late fee and interest per filing row.

    GSTR-1: 50/day capped at 10000. GSTR-3B: with tax due 50/day capped plus
    18 % p.a. interest over 365 days; nil return 20/day capped. Other return
    types and days_late <= 0: zero (the message only when late).
    """
    d = F.col("days_late")
    liab = C.amt("tax_liability")
    rt = F.col("return_type")
    cap = F.lit(fixed.LATE_FEE_CAP)
    penalty = (F.when(d <= 0, 0)
                .when(rt == "GSTR-1", F.least(d * fixed.LATE_FEE_PER_DAY, cap))
                .when((rt == "GSTR-3B") & (liab > 0), F.least(d * fixed.LATE_FEE_PER_DAY, cap))
                .when(rt == "GSTR-3B", F.least(d * fixed.NIL_LATE_FEE_PER_DAY, cap))
                .otherwise(0))
    # float arithmetic in the application's order: liability * 0.18 * days / 365
    due = (d > 0) & (rt == "GSTR-3B") & (liab > 0)
    interest = F.when(due, F.round(liab.cast("double") * fixed.INTEREST_RATE * d / 365, 2)).otherwise(F.lit(0.0))
    pen = penalty.cast("int")
    return filings.select(
        "id", "user_id", "return_type", "days_late", pen.alias("penalty"), interest.alias("interest"),
        F.round(pen + interest, 2).alias("total"),
        F.when(d > 0, F.concat(F.lit(""), d.cast("string"), F.lit(" din late filing. Penalty: ₹"), pen.cast("string"),
                               F.lit(" + Interest: ₹"),
                               F.when(due, interest.cast("string")).otherwise(F.lit("0")))).alias("message_hi"))


def deadline_messages(usr: DataFrame, led: DataFrame, as_of: str, policy: str = "calendar") -> DataFrame:
    """U2 / R4 (+J9, F4, F22): the daily reminder job as one table.

    ``reference``: deadlines of as_of's own month (never 7/3/1 days away, so it
    sends nothing - as the application does); ``calendar``: deadlines of the
    return being filed (the previous month), due this month. Every reachable
    user gets one row per due branch; the deadline values are literals of the
    job's parameters, so the fan-out is a projection, not a join.
    """
    y, m = map(int, as_of[:7].split("-"))
    if policy == "calendar":
        y, m = (y - 1, 12) if m == 1 else (y, m - 1)
    period = f"{y:04d}-{m:02d}"
    ledger_period = as_of[:7]
    dl = K.deadlines(period, as_of)
    u = I.reachable(usr).select("id", "phone")
    lp = led.filter(F.col("period") == ledger_period).select(F.col("user_id").alias("id"), "itc_available")
    x = u.join(lp, "id", "left").withColumn("itc", F.round(C.amt("itc_available"), 2))
    itc_txt = F.format_number(F.col("itc"), 2)
    branches = []
    for kind, days, date in (("GSTR-1", dl["days_to_gstr1"], dl["gstr1_deadline"]),
                             ("GSTR-3B", dl["days_to_gstr3b"], dl["gstr3b_deadline"])):
        if days not in fixed.ALERT_LEAD_DAYS:
            continue
        tpl = fixed.REMINDER_GSTR1 if kind == "GSTR-1" else fixed.REMINDER_GSTR3B
        text = tpl.format(mark=fixed.URGENCY_MARK[days], date=date, days=days, itc="\x00", signoff=fixed.SIGNOFF,
                          tail=fixed.REMINDER_3B_TAIL.get(days, fixed.REMINDER_3B_TAIL_DEFAULT))
        head, tail = text.split("\x00")
        body = F.concat(F.lit(head), itc_txt, F.lit(tail))
        branches.append(F.struct(F.lit(kind).alias("kind"), F.lit(days).alias("days_left"), F.lit(date).alias("deadline"),
                                 K.alert_level(F.lit(days)).alias("level"), body.alias("body")))
    if not branches:
        empty = F.array().cast("array<struct<kind:string,days_left:int,deadline:string,level:string,body:string>>")
        arr = empty
    else:
        arr = F.array(*branches)
    out = x.select("id", F.concat(F.lit("whatsapp:"), e164(F.col("phone"))).alias("to"), D("itc").alias("itc_balance"),
                   F.explode(arr).alias("b"))
    return out.select(F.col("id").alias("user_id"), "to", "itc_balance", "b.kind", "b.days_left", "b.deadline",
                      "b.level", "b.body")


def write_outbox(msgs: DataFrame, path: str) -> DataFrame:
    """reminder/alert messages as rows (to, kind, body), appended as parquet."""
    out = msgs.select("to", "kind", "body")
    out.write.mode("append").parquet(path)
    return out


def publish(df: DataFrame, path: str, keys: list[str], by: list[str]) -> set[str]:
    """Find-or-create by key (the ledger's is (user, period)): rows of ``df``
    replace those with the same key or are new, all others stay. Only parts (of
    ``by``, e.g. the period) in which something changes are rewritten, and readers
    see an upsert as a whole; running it again changes nothing. Returns the parts
    that were written."""
    return KeyedTable(df.sparkSession, path, keys, by).upsert(df)


def published(spark: SparkSession, path: str, keys: list[str], by: list[str]) -> DataFrame:
    """The rows of a published table."""
    return KeyedTable(spark, path, keys, by).read()


def template(t: str, **cols) -> Column:
    """A message template with its {name} fields filled by columns."""
    import re as _re
    parts = _re.split(r"\{(\w+)\}", t)
    return F.concat(*[F.lit(piece) if i % 2 == 0 else cols[piece] for i, piece in enumerate(parts)])


def report_text(month_name: Column) -> Column:
    """The chat monthly report from A11's columns."""
    d3 = F.col("days_to_gstr3b")
    light = F.create_map(*[F.lit(x) for kv in fixed.REPORT_LIGHT.items() for x in kv])
    return F.concat(
        template(fixed.REPORT_HEAD, month_name=month_name),
        template(fixed.REPORT_BODY, invoices=F.col("total_invoices").cast("string"),
                 purchases=F.format_number("total_purchases", 2), itc=F.format_number("total_itc", 2)),
        F.when(F.col("blocked_count") > 0, template(fixed.REPORT_BLOCKED, blocked=F.col("blocked_count").cast("string")))
         .otherwise(F.lit("")),
        template(fixed.REPORT_DEADLINES, light=F.element_at(light, F.col("urgency")), g1=F.col("gstr1_deadline"),
                 d1=F.col("days_to_gstr1").cast("string"), g3=F.col("gstr3b_deadline"), d3=d3.cast("string")),
        F.when(d3 <= 3, template(fixed.REPORT_URGENT, d3=d3.cast("string")))
         .when(d3 <= 7, template(fixed.REPORT_SOON, d3=d3.cast("string")))
         .otherwise(template(fixed.REPORT_OK, d3=d3.cast("string"))),
        F.lit(fixed.REPORT_TAIL))


def render_report(rep: DataFrame, as_of: str) -> DataFrame:
    """the chat monthly-report text of every user from A11's columns."""
    import datetime as _dt
    month_name = _dt.date.fromisoformat(as_of[:10]).strftime("%B %Y")
    return rep.select("user_id", report_text(F.lit(month_name)).alias("report"))


def client_reminders(clients: DataFrame, usr: DataFrame) -> DataFrame:
    """The CA's reminder to each selected client (e.g. the at-risk list):
    one outbox row (to, kind, body) per client with a phone."""
    pre, post = fixed.CLIENT_REMINDER.format(name="\x00", signoff=fixed.SIGNOFF).split("\x00")
    u = usr.select(F.col("id"), "phone", "business_name")
    x = clients.select("id").join(u, "id").filter(F.col("phone").isNotNull() & (F.col("phone") != ""))
    name = F.coalesce(C.blank_to_null("business_name"), F.lit(fixed.CLIENT_REMINDER_NAME_DEFAULT))
    return x.select(F.col("id").alias("user_id"), F.concat(F.lit("whatsapp:"), e164(F.col("phone"))).alias("to"),
                    F.lit("client_reminder").alias("kind"), F.concat(F.lit(pre), name, F.lit(post)).alias("body"))
