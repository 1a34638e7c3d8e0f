"""Structured Streaming jobs.

Sources are file streams read with a fixed schema; event time is a TIMESTAMP
column with a watermark. Results go to parquet tables, never to the driver:

* ``append_to``: rows that are final when they are emitted;
* ``changes_to``: every micro-batch writes the keys it changed into its own
  folder ``batch=N`` (a batch that is run again replaces that folder), and
  ``latest`` reads the newest row of each key;
* keyed tables (``sources/keyed.py``): every micro-batch upserts the keys it changed.

Rows without an event time belong to no window: windowed jobs count them with
the dropped ones, jobs without a watermark keep them (they come first). Rows that
a watermark drops are counted by the runner (``Run.dropped``); the nightly
batch ledger restates the month (``restate_ledger``), so filing never depends on
them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core as C
from ..functions import fixed
from ..functions import keywords as K
from ..session import settings
from ..sources.keyed import KeyedTable, corrections
from . import sessions as SE

MESSAGE_SCHEMA = "event_id long, ts timestamp, sender string, has_photo boolean, body string"
INVOICE_SCHEMA = ("id long, user_id long, seller_gstin string, invoice_no string, date timestamp, "
                  "created_at timestamp, taxable_amt decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), "
                  "igst decimal(18,2), status string, ai_category string")


def write_in_order(df: DataFrame, ts: str, path: str, steps: int = 4):
    """Lay a table down as a file stream, oldest rows first: ``steps`` time
    ranges of about equal size, each written by all tasks as files of its own; rows
    without a time are in the first. A generator: the caller runs its stream
    between the ranges; it is given the number of those to come."""
    at = F.unix_micros(ts)
    cuts = df.select(at.alias("t")).approxQuantile("t", [i / steps for i in range(1, steps)], 0.01)
    edges = [None, *sorted(set(cuts)), None]
    for left, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True), 2 - len(edges)):
        inside = F.lit(True) if lo is not None else at.isNull() | F.lit(hi is None)
        if lo is not None:
            inside = inside & (at >= int(lo))
        if hi is not None:
            inside = (inside & (at < int(hi))) if lo is not None else inside | (at < int(hi))
        df.filter(inside).write.mode("append").option("compression", "zstd").parquet(path)
        yield -left


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


@dataclass
class Run:
    """A stream run to the end of its available input."""

    batches: int
    dropped: int
    rows: int

    @staticmethod
    def of(query) -> Run:
        """Adds up what every micro-batch reports. ``recentProgress`` keeps the last
        ones only, so it is read while the query runs, each batch once."""
        seen: dict[int, tuple[int, int]] = {}

        def look() -> None:
            for p in query.recentProgress:
                dropped = sum(int(o.get("numRowsDroppedByWatermark", 0)) for o in p.get("stateOperators", []))
                n, d = seen.get(p["batchId"], (0, 0))
                seen[p["batchId"]] = max(n, p["numInputRows"]), max(d, dropped)
        while not query.awaitTermination(0.2):
            look()
        look()
        return Run(sum(n > 0 for n, _ in seen.values()), sum(d for _, d in seen.values()), sum(n for n, _ in seen.values()))


def append_to(sdf: DataFrame, path: str, checkpoint: str) -> Run:
    """Final rows into a parquet table (exactly once, by the file sink's log)."""
    return Run.of(sdf.writeStream.format("parquet").outputMode("append").option("path", path)
                     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def each_batch(sdf: DataFrame, write, checkpoint: str, mode: str = "append") -> Run:
    """``write(batch, number)`` for every micro-batch."""
    return Run.of(sdf.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
                     .trigger(availableNow=True).start())


def changes_to(sdf: DataFrame, path: str, checkpoint: str) -> Run:
    """The changed rows of every micro-batch into ``path/batch=N``."""
    return each_batch(sdf, lambda rows, n: rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={n}"),
                      checkpoint, "update")


def read_changes(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All changes, or those of batches before one; no table yet is an empty one.
    Works on any file system Spark reads: nothing is looked up on the driver."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema + ", batch int")
    rows = spark.read.schema(schema + ", batch int").parquet(path)
    return rows if before is None else rows.filter(F.col("batch") < before)


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key; an aggregate, so a hot key combines map-side."""
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    return (changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*"))


# ------------------------------------------------------------ stateless ----

def stream_classify(msgs: DataFrame) -> DataFrame:
    """Live intent/keyword classification of incoming messages."""
    low = F.lower(F.trim("body"))
    return msgs.select("event_id", "ts", "sender", K.first_group(low, fixed.INTENTS, "fallback").alias("intent"),
                       K.keyword_category(F.col("body")).alias("category"))


# ------------------------------------------------------ windowed state -----

def stream_status(events: DataFrame, ts: str = "ts", key: str = "body", size: str = "1 hour",
                  slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Counts per tumbling (or sliding) event-time window and key."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (events.withWatermark(ts, watermark).groupBy(w.alias("w"), key)
                  .agg(F.count(F.lit(1)).alias("n"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n"))


def stream_sessions(msgs: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """R6 (extension): sender activity sessions separated by a 30-minute gap."""
    return (msgs.withWatermark("ts", watermark)
                .groupBy(F.session_window("ts", gap).alias("s"), "sender")
                .agg(F.count(F.lit(1)).alias("messages"), F.count_if("has_photo").alias("photos"))
                .select("sender", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                        "messages", "photos"))


def stream_ledger(inv: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Purchases and ITC per user and save day (month totals are the sum
    of the days; Spark windows cannot be calendar months)."""
    return (inv.withWatermark("created_at", watermark)
               .groupBy(F.window("created_at", "1 day").alias("w"), "user_id")
               .agg(F.sum(C.amt("taxable_amt")).alias("total_purchases"),
                    F.sum(C.itc_exclusive()).alias("itc_available"))
               .select("user_id", F.to_date(F.col("w.start")).alias("day"), "total_purchases", "itc_available"))


def month_rollup(daily: DataFrame) -> DataFrame:
    """The published monthly ledger from the daily stream output (batch)."""
    return (daily.groupBy("user_id", F.date_format("day", "yyyy-MM").alias("period"))
                 .agg(F.sum("total_purchases").alias("total_purchases"), F.sum("itc_available").alias("itc_available")))


STATE_IN_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",  # a run that has ended leaves the disk
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd", "spark.sql.streaming.stateStore.compression.codec": "zstd"}


GATE_SCHEMA = "id long, user_id long, invoice_no string, seller_gstin string, created_at timestamp"


def gate_duplicates(inv: DataFrame, stored: DataFrame, path: str, checkpoint: str) -> Run:
    """R2: the duplicate gate. A row passes if its invoice number is blank, or if
    no stored invoice and no earlier row of the stream has its key: (user,
    invoice_no, gstin), and without a GSTIN (user, invoice_no) with any GSTIN.
    Rows of one micro-batch are in order of (created_at, id), null first.

    Keys are never forgotten: they are the keyed state of a streaming
    aggregate, which holds of each key the row that came first. A micro-batch reads
    its own rows and looks up its own keys; neither the stored table nor what
    passed before is read again. Stored invoices enter once, ahead of the stream.
    The rows that pass are in ``path/batch=N`` and, with blank numbers, in ``path-blank``.
    The state is in RocksDB, on disk: on the heap it would grow with all keys ever seen.
    """
    spark = inv.sparkSession
    cols = ["id", "user_id", "invoice_no", "seller_gstin", "created_at"]
    first = f"{path}-stored"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(first + "/_SUCCESS")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        stored.select(*cols).write.mode("overwrite").parquet(first)
    known = spark.readStream.schema(GATE_SCHEMA).parquet(first).withColumn("fresh", F.lit(False))
    rows = _keyed(known.unionByName(inv.select(*cols).withColumn("fresh", F.lit(True))))
    blank, no_text = F.col("g") == "", F.lit(None).cast("string")
    # the order is that of arrival: stored rows, earlier batches, then time and id
    order = ["arrival", "fresh", "created_at", "id", blank.alias("blank")]
    came = F.struct(*order, "invoice_no", "seller_gstin")
    # the key of any GSTIN has none; a row with one doesn't pass by it, its texts would only fill the state
    exact = F.struct("g", came.alias("came"))
    any_gstin = F.struct(no_text.alias("g"), F.struct(*order, F.when(blank, F.col("invoice_no")).alias("invoice_no"),
                                                      F.when(blank, F.col("seller_gstin")).alias("seller_gstin")).alias("came"))
    keys = F.explode(F.when(blank, F.array(any_gstin)).otherwise(F.array(exact, any_gstin))).alias("k")
    heard = rows.filter(F.col("no") != "").withColumn("arrival", F.current_timestamp()).select("user_id", "no", keys, "arrival")
    state = heard.groupBy("user_id", "no", "k.g").agg(F.min("k.came").alias("first"), F.max("arrival").alias("now"))
    passed = state.filter((F.col("first.arrival") == F.col("now")) & F.col("first.fresh") & (F.col("first.blank") == F.col("g").isNull()))
    with settings(spark, STATE_IN_ROCKSDB):
        run = changes_to(passed.select("first.id", "user_id", "first.invoice_no", "first.seller_gstin", "first.created_at"), path, checkpoint)
    blank = _keyed(inv).filter(F.col("no") == "").select(*cols)
    append_to(blank, f"{path}-blank", f"{checkpoint}-blank")
    return run


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"no": F.trim(F.coalesce("invoice_no", F.lit(""))),
                             "g": F.trim(F.coalesce("seller_gstin", F.lit("")))})


def passed_rows(spark: SparkSession, path: str) -> DataFrame:
    return read_changes(spark, path, GATE_SCHEMA).drop("batch").unionByName(spark.read.schema(GATE_SCHEMA).parquet(f"{path}-blank"))


# ------------------------------------------------- R1: chat sessions -------

STEP_SCHEMA = "sender string, event_id long, ts timestamp, action string, detail string, fields map<string,string>"
#: Parts of the table of senders: a batch reads and rewrites those of its own senders.
SENDER_PARTS = 64


def sender_table(spark: SparkSession, path: str) -> KeyedTable:
    """Where every sender stands, one row each: ``state`` and ``before`` (ahead of ``batch``) as JSON."""
    return KeyedTable(spark, f"{path}/senders", ["sender", "part"], ["part"])


def run_sessions(msgs: DataFrame, path: str, checkpoint: str) -> Run:
    """The confirmation sessions of a stream of messages (``sessions.py``).
    What a batch's messages did goes to ``path/steps/batch=N``; where its senders
    stand afterwards is upserted into ``sender_table``, which holds one row a sender
    however long the stream. A batch that is run again starts from ``before``."""
    part = F.pmod(F.xxhash64("sender"), F.lit(SENDER_PARTS)).cast("int").alias("part")

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        senders = sender_table(spark, path)
        mine = SE.symbols(batch).select("sender").distinct().select("sender", part)
        known = senders.read(near=mine)
        if known.columns:
            known = known.select("sender", F.from_json(F.when(F.col("batch") == n, F.col("before")).otherwise(F.col("state")),
                                                       SE.STATE).alias("state"))
        folded = SE.fold(batch, known if known.columns else None)
        folded.write.mode("overwrite").parquet(f"{path}/folded/batch={n}")     # once for both tables
        done = spark.read.schema(folded.schema).parquet(f"{path}/folded/batch={n}")
        SE.steps(done).write.mode("overwrite").parquet(f"{path}/steps/batch={n}")
        senders.upsert(SE.ends(done).select("sender", part, F.to_json("state").alias("state"), F.to_json("was").alias("before"),
                                            F.lit(n).cast("long").alias("batch")))

    return each_batch(msgs, write, checkpoint)


def session_steps(spark: SparkSession, path: str) -> DataFrame:
    return read_changes(spark, path + "/steps", STEP_SCHEMA).drop("batch")


def with_replies(out: DataFrame) -> DataFrame:
    """The chat reply of each state-machine step, where it depends only on
    the step (replies that need the saved invoice, the ledger or the
    extraction result are produced by F22 and the filing jobs)."""
    labels = F.create_map(*[F.lit(x) for kv in fixed.FIELD_LABELS.items() for x in kv])
    pre, post = fixed.REPLY_ASK_VALUE.split("{label}")
    a, d = F.col("action"), F.col("detail")
    # deadline reply: the message's own time stands for "now"
    from ..functions.calendar import chat_urgency
    day = F.to_date("ts")
    nxt = F.add_months(F.trunc(day, "month"), 1)
    g1 = F.make_date(F.year(nxt), F.month(nxt), F.lit(fixed.GSTR1_DAY))
    g3 = F.make_date(F.year(nxt), F.month(nxt), F.lit(fixed.GSTR3B_DAY))
    d1, d3 = F.datediff(g1, day), F.datediff(g3, day)
    light = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.REPORT_LIGHT.items() for x in kv]), chat_urgency(d3))
    t = fixed.REPLY_DEADLINES
    parts = {"g1": g1.cast("string"), "d1": d1.cast("string"), "g3": g3.cast("string"), "d3": d3.cast("string"),
             "light": light}
    import re as _re
    pieces = _re.split(r"\{(\w+)\}", t)
    deadline_text = F.concat(*[F.lit(x) if i % 2 == 0 else parts[x] for i, x in enumerate(pieces)])
    reply = (F.when(a == "cancelled", F.lit(fixed.REPLY_CANCELLED))
              .when((a == "intent") & (d == "deadline"), deadline_text)
              .when(a == "ask_value", F.concat(F.lit(pre), F.element_at(labels, d), F.lit(post)))
              .when(a == "ask_field", F.lit(fixed.REPLY_ASK_FIELD))
              .when(a == "prompt", F.lit(fixed.REPLY_PROMPT))
              .when((a == "intent") & (d == "greeting"), F.lit(fixed.REPLY_GREETING.format(name=fixed.ASSISTANT_NAME)))
              .when((a == "intent") & (d == "help"), F.lit(fixed.REPLY_HELP.format(name=fixed.ASSISTANT_NAME)))
              .when((a == "intent") & (d == "fallback"), F.lit(fixed.REPLY_FALLBACK)))
    return out.withColumn("reply", reply)


# ------------------------------------------------------ live ledger --------

LEDGER = ["total_purchases", "itc_available"]
LEDGER_SCHEMA = "user_id long, day date, total_purchases decimal(28,2), itc_available decimal(28,2)"


def day_table(spark: SparkSession, path: str) -> KeyedTable:
    """The live ledger by day, cut by month."""
    return KeyedTable(spark, f"{path}/days", ["user_id", "day", "period"], ["period"])


def month_table(spark: SparkSession, path: str) -> KeyedTable:
    """The published ledger by month."""
    return KeyedTable(spark, f"{path}/months", ["user_id", "period"], ["period"])


def run_ledger(inv: DataFrame, path: str, checkpoint: str, watermark: str = "2 days") -> Run:
    """R3 + S10: the live ledger, published by every micro-batch: the (user, day)
    totals it changed are upserted, the (user, month) totals above them are summed
    anew from the days of those months and upserted in turn. Months without a
    changed day are neither read nor written; a batch that is run again changes
    nothing."""
    typed = stream_ledger(inv, watermark).select(
        "user_id", "day", *[F.col(c).cast("decimal(28,2)").alias(c) for c in LEDGER])

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={n}")  # once for both tables
        changed = spark.read.schema(LEDGER_SCHEMA).parquet(f"{path}/changes/batch={n}").withColumn(
            "period", F.date_format("day", "yyyy-MM"))
        if changed.isEmpty():  # a batch that only moves the watermark
            return
        days = day_table(spark, path)
        days.upsert(changed)
        touched = changed.select("user_id", "period").distinct()
        rows = days.read(near=touched).join(touched, ["user_id", "period"], "left_semi")
        month_table(spark, path).upsert(_by_month(rows))

    return each_batch(typed, write, checkpoint, "update")


def _by_month(days: DataFrame) -> DataFrame:
    return days.groupBy("user_id", "period").agg(*[F.sum(c).cast("decimal(28,2)").alias(c) for c in LEDGER])


def daily_ledger(spark: SparkSession, path: str) -> DataFrame:
    return day_table(spark, path).read().drop("period")


def restate_ledger(live: KeyedTable, nightly: DataFrame) -> DataFrame:
    """A9 against R3: the correction rows (insert, change, delete) that turn the live
    months into the nightly ledger, late rows included; and the live table is
    brought to it. A second run returns no row and writes nothing."""
    want = nightly.select(*live.keys, *[F.col(c).cast("decimal(28,2)").alias(c) for c in LEDGER])
    spark = live.spark
    from ..session import shared_dir
    path = shared_dir(spark, f"itcflow-restated/{uuid.uuid4().hex}")
    corrections(live.read(), want, live.keys).write.parquet(path)  # before the upsert changes what it compares
    rows = spark.read.parquet(path)
    live.upsert(rows.where("change <> 'delete'").select(*live.keys, *LEDGER), deleted=rows.where("change = 'delete'").select(*live.keys))
    return rows
