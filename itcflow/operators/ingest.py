"""Ingest, review and supplier-quality operators (S4, P16, F5, F6, F19, F23,
F24, F25, J5, J8, J10, J11, J12, L1, L2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions import fixed
from ..functions import gstin as G
from ..functions import keywords as K
from ..functions.text import parse_invoice_date
from .invoices import latest_by

OCR_SCHEMA = ("seller_gstin string, invoice_no string, invoice_date string, taxable_amount double, "
              "cgst double, sgst double, igst double, total_amount double, description string")


def read_ocr_replies(df: DataFrame, col: str = "reply") -> DataFrame:
    """Strip ``` fences, parse the JSON reply with a fixed schema. A reply
    that does not parse is flagged (``parse_error``), not a job failure. The test and the
    parsed fields come out of a generator: Spark would else repeat them for each
    field, and in every filter on them."""
    raw = F.trim(F.replace(F.replace(F.col(col), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    valid = F.expr("try_parse_json(_raw)")
    kept = [c for c in df.columns if c != col]
    fields = F.when(valid.isNotNull(), F.struct(F.from_json("_raw", OCR_SCHEMA).alias("f")))   # null: doesn't parse
    out = df.withColumn("_raw", raw).select(*kept, F.explode(F.array(fields)).alias("_read"))
    filled = sum(F.col("_read.f." + k).isNotNull().cast("int") for k in fixed.OCR_FIELDS)
    ok = F.col("_read").isNotNull()
    return out.select(*kept, (~ok).alias("parse_error"),
                      *[F.col("_read.f." + k).alias(k) for k in fixed.OCR_FIELDS],
                      F.when(ok, filled).otherwise(F.lit(0)).alias("filled_count"))


def split_ocr(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, retry): retry = parse error or no field filled."""
    retry = F.col("parse_error") | (F.col("filled_count") == 0)
    return parsed.filter(~retry), parsed.filter(retry)


def to_invoices(fields: DataFrame) -> DataFrame:
    """F19 (+F18): reply fields -> invoice rows: lengths cut, '' -> NULL,
    amounts NULL -> 0, date by the three formats, status pending."""
    z = F.lit(0.0)
    return fields.select(
        "user_id",
        C.blank_to_null(F.substring(F.coalesce("seller_gstin", F.lit("")), 1, 15)).alias("seller_gstin"),
        C.blank_to_null(F.substring(F.coalesce("invoice_no", F.lit("")), 1, 100)).alias("invoice_no"),
        F.when(C.blank_to_null("invoice_date").isNotNull(), parse_invoice_date(F.col("invoice_date"))).alias("date"),
        *[F.when(F.col(k).isNull() | (F.col(k) == 0), z).otherwise(F.col(k)).alias(n)
          for k, n in (("taxable_amount", "taxable_amt"), ("cgst", "cgst"), ("sgst", "sgst"), ("igst", "igst"))],
        F.lit("pending").alias("status"))


def find_duplicates(new: DataFrame, inv: DataFrame) -> DataFrame:
    """Incoming rows against stored invoices. Key (user, invoice_no) and,
    when the incoming row has a GSTIN, that GSTIN too; blank invoice numbers
    never match and are joined to nothing; the incumbent is the smallest stored
    id. Stored invoices are reduced to one row per key, which carries the
    incumbent's date and total, so the join is 1:1 per incoming row."""
    from .windows import incumbent, with_incumbent
    n = new.select("req_id", "user_id", F.trim(F.coalesce("invoice_no", F.lit(""))).alias("no"),
                   F.trim(F.coalesce("seller_gstin", F.lit(""))).alias("g"))
    s = inv.select("user_id", F.coalesce("invoice_no", F.lit("")).alias("no"), F.coalesce("seller_gstin", F.lit("")).alias("g"),
                   incumbent().alias("row"))
    asked = with_incumbent(n, s, "left").select("req_id", "first")
    blank = n.filter(F.col("no") == "").select("req_id", F.lit(None).cast(s.schema["row"].dataType).alias("first"))
    found = asked.unionByName(blank)
    return found.select("req_id", F.col("first").isNotNull().alias("is_duplicate"), F.col("first.id").alias("existing_id"),
                        F.col("first.on").alias("existing_date"), F.col("first.total").alias("existing_total"))


def apply_corrections(inv: DataFrame, corr: DataFrame) -> DataFrame:
    """The latest correction per invoice (highest seq) replaces the
    category and sets user_corrected."""
    last = latest_by(corr, "invoice_id", ["seq"], ["category"]).withColumnRenamed("invoice_id", "id")
    j = inv.join(last.withColumnRenamed("category", "_corr"), "id", "left")
    return (j.withColumn("user_corrected", F.col("_corr").isNotNull())
             .withColumn("ai_category", F.coalesce("_corr", "ai_category")).drop("_corr"))


def tag_intent(msgs: DataFrame, body: str = "body") -> DataFrame:
    """message intent without a pending invoice (ordered keyword tests),
    and the action it takes when an invoice is pending: confirm, cancel, edit
    of a named field (alias map), or a prompt."""
    low = F.lower(F.trim(F.col(body)))
    intent = K.first_group(low, fixed.INTENTS, "fallback")
    kw = F.trim(F.replace(low, F.lit("edit "), F.lit("")))
    alias = F.create_map(*[F.lit(x) for kv in fixed.FIELD_ALIASES for x in kv])
    field = F.element_at(alias, kw)
    pending = (F.when(K.any_of(low, fixed.CONFIRM_WORDS), "confirm")
                .when(K.any_of(low, fixed.CANCEL_WORDS), "cancel")
                .when(low.startswith("edit ") & field.isNotNull(), "edit")
                .when(low.startswith("edit "), "ask_field")
                .otherwise("prompt"))
    return msgs.select("*", intent.alias("intent"), pending.alias("pending_action"),
                       F.when(low.startswith("edit "), field).alias("edit_field"))


def _state_name(code):
    m = F.create_map(*[F.lit(x) for kv in fixed.STATE_CODES.items() for x in kv])
    return F.element_at(m, code)


def gstin_report(df: DataFrame, col: str, checksum: str = "reference", repair: bool = True) -> DataFrame:
    """F5 (+F6, F7): validity report of every distinct id in ``col``.

    Checks run once per distinct id (ids repeat across invoices), repairs only
    for the 15-character ids that fail; the result can be joined back.
    """
    ids = df.select(F.col(col).alias("raw")).distinct()
    g = F.upper(F.trim(F.col("raw")))
    x = ids.withColumn("g", F.when(F.col("raw").isNull() | (F.col("raw") == ""), F.lit(None)).otherwise(g))
    ck = G.checks("g", checksum)
    x = x.select("raw", "g", ck["pattern_ok"].alias("pattern_ok"), ck["state_ok"].alias("state_ok"),
                 ck["checksum_ok"].alias("checksum_ok"))
    ok = F.coalesce(F.col("checksum_ok") & (F.length("g") == 15), F.lit(False))
    if repair:
        x = G.with_repair(x, "g", ~ok, checksum)
        x = x.withColumn("corrections", G.corrections("g", "corrected"))
    else:
        x = x.withColumn("corrected", F.lit(None).cast("string")) \
             .withColumn("corrections", F.lit(None).cast("array<string>"))
    fixed_ok = F.col("corrected").isNotNull()
    final = F.when(ok, F.col("g")).when(fixed_ok, F.col("corrected"))
    err = (F.when(F.col("g").isNull(), F.lit("GSTIN is empty"))
            .when(F.length("g") != 15, F.concat(F.lit("GSTIN must be 15 characters, got "), F.length("g").cast("string")))
            .when(ok | fixed_ok, F.lit(None))
            .when(~F.col("pattern_ok"), F.lit("GSTIN format invalid — could not auto-correct"))
            .when(~F.col("state_ok"), F.concat(F.lit("Invalid state code: "), F.substring("g", 1, 2)))
            .otherwise(F.lit("Checksum failed — OCR error not correctable")))
    sc = F.substring(final, 1, 2)
    return x.select(F.col("raw").alias(col), (ok | fixed_ok).alias("is_valid"), final.alias("gstin"),
                    sc.alias("state_code"), F.when(final.isNotNull(), F.coalesce(_state_name(sc), F.lit("Unknown")))
                    .alias("state_name"),
                    F.substring(final, 3, 10).alias("pan"), (~ok & fixed_ok).alias("auto_corrected"),
                    F.when(~ok & fixed_ok, F.col("corrections")).alias("corrections"), err.alias("error"))


def gstin_status(report: DataFrame) -> DataFrame:
    """the chat status line of each supplier id."""
    c = F.col(report.columns[0])
    line = (F.when(c.isNull() | (c == ""), F.lit(""))
             .when(F.col("is_valid") & F.col("auto_corrected"),
                   F.concat(F.lit("✅ Auto-corrected: "), F.col("gstin"), F.lit(" ("), F.col("state_name"), F.lit(")")))
             .when(F.col("is_valid"), F.concat(F.lit("Valid ("), F.col("state_name"), F.lit(")")))
             .otherwise(F.lit("Invalid GSTIN - ITC risk!")))
    return report.select(c, line.alias("status_line"))


def photo_triage(m: DataFrame) -> DataFrame:
    """photo quality score from measured metrics, issue list, whether the
    image needs the clean-up step (score < 80)."""
    blurry = F.col("blur") < fixed.PHOTO_BLUR_MIN
    dark = F.col("brightness") < fixed.PHOTO_DARK_BELOW
    over = F.col("brightness") > fixed.PHOTO_BRIGHT_ABOVE
    low = (F.col("width") < fixed.PHOTO_MIN_W) | (F.col("height") < fixed.PHOTO_MIN_H)
    score = F.greatest(F.lit(0), F.lit(100) - F.when(blurry, fixed.PHOTO_PENALTY_BLUR).otherwise(0)
                       - F.when(dark | over, fixed.PHOTO_PENALTY_LIGHT).otherwise(0)
                       - F.when(low, fixed.PHOTO_PENALTY_RES).otherwise(0))
    issues = F.array_compact(F.array(
        F.when(blurry, F.format_string("Blurry (score: %.0f)", F.col("blur"))),
        F.when(dark, F.format_string("Too dark (brightness: %.0f)", F.col("brightness"))),
        F.when(over, F.format_string("Overexposed (brightness: %.0f)", F.col("brightness"))),
        F.when(low, F.format_string("Low resolution (%dx%d)", F.col("width"), F.col("height")))))
    return m.select("image_id", score.alias("score"), blurry.alias("is_blurry"), dark.alias("is_dark"),
                    over.alias("is_overexposed"), low.alias("is_low_res"), issues.alias("issues"),
                    (score < fixed.PHOTO_PREPROCESS_BELOW).alias("needs_preprocessing"))


def with_gst_rate(df: DataFrame, col: str) -> DataFrame:
    """J8 (extension): GST rate of a goods class (fixed 11-row map), default 18."""
    rates = F.create_map(*[F.lit(x) for kv in fixed.GST_RATES.items() for x in kv])
    return df.withColumn("gst_rate", F.coalesce(F.element_at(rates, F.lower(F.trim(F.col(col)))),
                                               F.lit(fixed.GST_RATES["default"])))


def reconcile_2b(inv: DataFrame, g2b: DataFrame) -> DataFrame:
    """J10 (extension): books vs GSTR-2B per (user, period, supplier, invoice):
    matched / mismatch / missing_in_2b / missing_in_books and the difference."""
    keys = ["user_id", "period", "supplier_gstin", "invoice_no"]
    books = (inv.filter(F.col("date").isNotNull() & (F.coalesce("invoice_no", F.lit("")) != ""))
                .groupBy("user_id", C.ym("date").alias("period"), F.col("seller_gstin").alias("supplier_gstin"),
                         "invoice_no")
                .agg(F.sum(C.itc_total()).alias("claimed")))
    r = g2b.select(*keys, F.col("itc_amount").alias("reported"), "filing_status")
    j = books.join(r, keys, "full_outer")
    st = (F.when(F.col("reported").isNull(), "missing_in_2b").when(F.col("claimed").isNull(), "missing_in_books")
           .when(F.col("claimed") == F.col("reported"), "matched").otherwise("mismatch"))
    z = F.lit(0).cast(C.MONEY)
    return j.select(*keys, C.to_double("claimed").alias("claimed"), C.to_double("reported").alias("reported"),
                    st.alias("status"),
                    C.to_double(F.coalesce("claimed", z) - F.coalesce("reported", z)).alias("difference"))


def supplier_not_filed(inv: DataFrame, g2b: DataFrame) -> DataFrame:
    """J11 (extension): invoices whose supplier did not file them in 2B."""
    nf = (g2b.filter(F.col("filing_status") != "filed")
             .select("user_id", "period", F.col("supplier_gstin").alias("seller_gstin"), "invoice_no"))
    src = inv.filter(F.col("date").isNotNull()).withColumn("period", C.ym("date"))
    return src.join(nf, ["user_id", "period", "seller_gstin", "invoice_no"], "left_semi")


# ------------------------------------------------------------ data prep ----

def make_labelled(inv: DataFrame, policy: str = "dataset") -> DataFrame:
    """L1 (+U4): labelled transactions from the stored invoices: description,
    amount (whole rupees of the invoice total), accepted category, 'Yes'/'No'
    by the dataset's blocked list, supplier GSTIN. One row per invoice that
    has a description and a category."""
    amount = F.floor(F.coalesce("taxable_amt", F.lit(0)) + C.itc_total()).cast("int")
    return (inv.filter(C.blank_to_null("description").isNotNull() & F.col("ai_category").isNotNull())
               .select(F.col("id").alias("row_id"), "description", amount.alias("amount"), F.col("ai_category").alias("category"),
                       F.when(C.is_blocked(F.col("ai_category"), policy), "No").otherwise("Yes").alias("itc_eligible"),
                       F.col("seller_gstin").alias("gstin")))


def training_set(inv: DataFrame, corr: DataFrame, test_pct: int = 20) -> DataFrame:
    """L2 (extension): (text, label, source, split) from user corrections and
    from confident keyword predictions; one row per text, corrections first;
    ``test_pct`` percent of every label's rows are the test split."""
    fixed_rows = apply_corrections(inv.select("id", "description", "ai_category"), corr) \
        .filter(F.col("user_corrected")).select(F.col("description").alias("text"),
                                                 F.col("ai_category").alias("label"), F.lit(0).alias("prio"),
                                                 F.lit("correction").alias("source"))
    kw = K.keyword_category(F.col("description"))
    logged = inv.select(F.col("description").alias("text"), kw.alias("label"), F.lit(1).alias("prio"),
                        F.lit("keyword").alias("source")).filter(F.col("label") != "Other")
    both = fixed_rows.unionByName(logged)
    best = both.groupBy("text").agg(F.min_by(F.struct("label", "source"), F.struct("prio", "label")).alias("b"))
    rows = best.select("text", F.col("b.label").alias("label"), F.col("b.source").alias("source"))
    return stratified_split(rows, "label", "text", test_pct)


def stratified_split(rows: DataFrame, label: str, key: str, test_pct: int = 20) -> DataFrame:
    """``rows`` with ``split``: of every label's rows exactly ``test_pct`` percent
    (rounded half up) are ``test``, the others ``train``: those whose hash of key and
    label is smallest, ties by key.

    Two passes find a label's threshold: counts by label and leading digits of the
    hash say in which of 65,536 buckets it lies, and only that bucket's rows are
    ranked. No label is gathered in a task. Null labels are a label of their own, a
    null key is an empty one; rows that repeat fall on the same side, so that a label
    that has such rows at its threshold can be off by their number.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(rows.sparkSession)
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    h = F.md5(F.concat(k, F.lit("|"), F.coalesce(F.col(label).cast("string"), F.lit(""))))
    x = rows.withColumn("_place", F.struct(h.alias("h"), k.alias("k"))).checkpoint(eager=True)  # read three times
    lab, bucket = F.col(label).alias("_label"), F.substring("_place.h", 1, 4).alias("_bucket")
    counts = x.groupBy(lab, bucket).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("_label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = F.floor(F.sum("n").over(Window.partitionBy("_label")) * test_pct / 100 + 0.5)
    cut = (counts.withColumn("below", F.sum("n").over(up_to) - F.col("n")).withColumn("quota", quota)
                 .filter((F.col("below") < F.col("quota")) & (F.col("quota") <= F.col("below") + F.col("n")))
                 .select("_label", "_bucket", (F.col("quota") - F.col("below")).alias("_left")))
    near = x.select(lab, bucket, "_place").alias("r").join(
        cut.alias("c"), F.col("r._label").eqNullSafe(F.col("c._label")) & (F.col("r._bucket") == F.col("c._bucket")))
    rank = F.row_number().over(Window.partitionBy("r._label").orderBy("r._place"))
    last = (near.select("r._label", "r._place", "c._left", rank.alias("_rank")).filter("_rank = _left")
                .select(F.col("_label").alias("_of"), F.col("_place").alias("_last")))
    split = F.when(F.col("_place") <= F.col("_last"), "test").otherwise("train")
    return x.join(last, x[label].eqNullSafe(last["_of"]), "left").select(*rows.columns, split.alias("split"))


def confirmation_messages(parsed: DataFrame, report: DataFrame, policy: str = "dashboard") -> DataFrame:
    """F22 (+F24, F11): the chat reply to every extraction reply: an
    unreadable/empty notice, or the confirmation message listing the filled
    fields (the GSTIN shown repaired when the repair found one, with its
    status line) and the classification block of the description.

    The join holds the report in memory, one row an id; the replies stream past,
    unsorted, however many share an id. Those without a GSTIN look nothing up and
    are dealt by their own id."""
    g = report.select(F.concat(F.lit("="), F.col(report.columns[0])).alias("_key"), "is_valid", "auto_corrected",
                      F.col("gstin").alias("fixed_gstin"), "state_name")
    key = F.when(F.col("seller_gstin") != "", F.concat(F.lit("="), F.col("seller_gstin"))).otherwise(F.col("id").cast("string"))
    x = parsed.withColumn("_key", key).join(g.hint("shuffle_hash"), "_key", "left")
    status = (F.when(F.col("is_valid") & F.col("auto_corrected"),
                     F.concat(F.lit("✅ Auto-corrected: "), F.col("fixed_gstin"), F.lit(" ("), F.col("state_name"), F.lit(")")))
               .when(F.col("is_valid"), F.concat(F.lit("Valid ("), F.col("state_name"), F.lit(")")))
               .otherwise(F.lit("Invalid GSTIN - ITC risk!")))
    shown = F.when(F.coalesce(F.col("auto_corrected"), F.lit(False)), F.col("fixed_gstin")).otherwise(F.col("seller_gstin"))

    def line(field, label):
        v = F.col(field)
        present = (v.isNotNull() & (v != "")) if dict(parsed.dtypes)[field] == "string" else (v.isNotNull() & (v != 0))
        val = shown if field == "seller_gstin" else v.cast("string")
        text = F.concat(F.lit(label), val, F.lit("\n"))
        if field == "seller_gstin":
            text = F.concat(text, F.lit("  "), status, F.lit("\n"))
        return F.when(present, text).otherwise(F.lit(""))

    # a reply is classified where it is (the default description is that of many replies,
    # a join on descriptions brings them all to one task); the generator keeps it to once
    once = lambda c: F.explode(F.array(c))
    x = x.withColumn("_desc", F.coalesce(C.blank_to_null("description"), F.lit(fixed.DEFAULT_DESCRIPTION)))
    short = F.length(F.trim("_desc")) < 3
    x = x.withColumn("_cat", once(F.when(short, F.lit("Other")).otherwise(K.keyword_category(F.col("_desc")))))
    x = x.withColumn("_words", once(K.matched_words(F.lower("_desc"), F.col("_cat"), fixed.KEYWORD_RULES)))
    conf = (F.when(short, F.lit(0.0)).when(F.col("_cat") != "Other", F.lit(fixed.KEYWORD_CONFIDENCE))
             .otherwise(F.lit(fixed.FALLBACK_CONFIDENCE)))
    cat, words = F.col("_cat"), F.col("_words")
    itc = F.round(F.coalesce("cgst", F.lit(0.0)) + F.coalesce("sgst", F.lit(0.0)) + F.coalesce("igst", F.lit(0.0)), 2)
    head, tail = fixed.AI_HEAD.split("{cat}")
    mid, end = tail.split("{conf}")
    ai = F.concat(F.lit(head), cat, F.lit(mid), (conf * 100).cast("int").cast("string"), F.lit(end),
                  F.when(F.size(words) > 0, F.concat(F.lit(fixed.AI_KEYWORDS.split("{kw}")[0]), F.array_join(words, ", "),
                                                     F.lit(fixed.AI_KEYWORDS.split("{kw}")[1]))).otherwise(F.lit("")),
                  F.when(C.is_blocked(cat, policy), F.lit(fixed.AI_BLOCKED))
                   .when(itc > 0, F.concat(F.lit(fixed.AI_ELIGIBLE.split("{itc}")[0]), F.format_number(itc, 2),
                                           F.lit(fixed.AI_ELIGIBLE.split("{itc}")[1])))
                   .otherwise(F.lit("")))
    confirm = F.concat(F.lit(fixed.CONFIRM_HEAD), *[line(f, lab) for f, lab in fixed.CONFIRM_LINES],
                       F.lit(fixed.CONFIRM_TAIL), ai)
    msg = (F.when(F.col("parse_error"), F.lit(fixed.PHOTO_UNREADABLE))
            .when(F.col("filled_count") == 0, F.lit(fixed.PHOTO_EMPTY)).otherwise(confirm))
    return x.select("id", msg.alias("message"))
