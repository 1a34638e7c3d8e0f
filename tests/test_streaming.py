"""Streams over several micro-batches equal the batch computation (SURVEY §5 (4))."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from itcflow.plans import catalog_stream as CS
from itcflow.streaming import jobs as S
from itcflow.streaming import sessions as SE

MSG = "event_id long, ts timestamp, sender string, has_photo boolean, body string"


def _same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _text(df):
    """Maps as text, so that rows can be compared."""
    return df.withColumn("fields", F.to_json("fields"))


def _chat(spark, *bodies):
    rows = [(i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", "whatsapp:+919000000001", b is None, b or "") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "event_id long, ts string, sender string, has_photo boolean, body string").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def test_confirm_sessions_stream_equals_batch(spark, tmp_path):
    msgs = CS._messages(spark, SF001)
    runs = CS._in_steps(msgs, "ts", str(tmp_path), S.MESSAGE_SCHEMA, lambda m: S.run_sessions(m, f"{tmp_path}/out", f"{tmp_path}/ck"))
    assert len(runs) >= 3 and all(r.batches >= 1 for r in runs)
    out = S.session_steps(spark, f"{tmp_path}/out")
    assert out.count() == msgs.count()
    _same(_text(out), _text(SE.confirm_sessions_batch(msgs)))


def test_sessions_follow_the_table(spark):
    """Golden chat: edits, a refused amount, a confirmation days later."""
    msgs = _chat(spark, "hello", None, "edit total", "abc", "edit total", "Rs 1,200.50", "edit date", "yes", "edit colour",
                 "well", *["well"] * 60, "haan", "yes", None, None, "cancel")
    got = [(r["action"], r["detail"], r["fields"]) for r in SE.confirm_sessions_batch(msgs).orderBy("ts").collect()]
    acts = [a for a, _, _ in got]
    assert acts[:10] == ["intent", "pending", "ask_value", "refused", "ask_value", "edited", "ask_value", "edited", "ask_field", "prompt"]
    assert got[3][1] == "total_amount" and got[5][2] == {"invoice_no": "EV/1", "total_amount": "1200.5"}
    assert acts[10:70] == ["prompt"] * 60 and acts[70] == "saved"
    assert got[70][2] == {"invoice_no": "EV/1", "total_amount": "1200.5", "invoice_date": "yes"}
    assert acts[71:] == ["intent", "pending", "pending", "cancelled"] and got[74][1] == "EV/73"
    saved = SE.saved_invoices(SE.confirm_sessions_batch(msgs)).collect()
    assert len(saved) == 1 and saved[0]["total_amount"] == 1200.5 and saved[0]["invoice_date"] == "yes"


def _walk(bodies):
    """The golden machine in plain Python: (action, fields) of each message."""
    from itcflow.functions import fixed
    alias, state, field, fields, out = dict(fixed.FIELD_ALIASES), "idle", None, None, []
    for i, b in enumerate(bodies):
        low, was, asked = (b or "").strip().lower(), state, field
        field = None
        if b is None:
            symbol, state, action, fields = "photo", "open", "pending", {"invoice_no": f"EV/{i}"}
        elif was == "asked":
            state, action = "open", "edited"
            value = b.strip()
            if asked in SE.AMOUNTS:
                try:
                    value = str(float(value.replace("Rs", "").replace("rs", "").replace(",", "").strip()))
                except ValueError:
                    action = "refused"
            if action == "edited":
                fields = fields | {asked: value}
        else:
            symbol = ("confirm" if any(w in low for w in fixed.CONFIRM_WORDS) else "cancel" if any(w in low for w in fixed.CANCEL_WORDS)
                      else "other" if not low.startswith("edit ") else "edit" if low.replace("edit ", "").strip() in alias else "which")
            state, action = SE.MOVES.get((was, symbol), (was, "intent"))
            field = alias[low.replace("edit ", "").strip()] if action == "ask_value" else None
        out.append((action, fields if action in ("saved", "cancelled", "edited") else None))
        fields = fields if state != "idle" else None
    return out


def test_blocks_compose_whatever_lies_between_photos(spark, monkeypatch):
    """Many small blocks on several levels equal the machine walked message by message."""
    rng = random.Random(8)
    monkeypatch.setattr(SE, "BLOCK", 4)
    words = ["edit total", "edit date", "12", "abc", "edit colour", "hm", "hm", "yes", "cancel", "edit gstin", "Rs 7.5", "edit cgst"]
    for photos, n in ((0.02, 260), (0.0, 70), (0.3, 90)):
        bodies = [None if rng.random() < photos or (photos and i == 3) else rng.choice(words) for i in range(n)]
        got = SE.confirm_sessions_batch(_chat(spark, *bodies)).orderBy("event_id").collect()
        assert [(r["action"], r["fields"]) for r in got] == _walk(bodies)


def test_a_sender_without_photos_runs_in_many_tasks(spark):
    msgs = _chat(spark, None).crossJoin(spark.range(20_000).withColumnRenamed("id", "n")).select(
        F.col("n").alias("event_id"), (F.col("ts") + F.make_dt_interval(secs=F.col("n").cast("int"))).alias("ts"), "sender",
        (F.col("n") == 0).alias("has_photo"), F.when(F.col("n") == 19_999, "yes").otherwise("hm").alias("body"))
    folded = SE.fold(msgs)
    assert folded.agg(F.max(F.size("done"))).first()[0] == SE.BLOCK and folded.count() == -(-20_000 // SE.BLOCK)
    got = {(r["action"], r["detail"]): r["count"] for r in SE.steps(folded).groupBy("action", "detail").count().collect()}
    assert got == {("pending", "EV/0"): 1, ("prompt", ""): 19_998, ("saved", "EV/0"): 1}


def test_a_session_batch_that_runs_again_starts_where_it_did(spark, tmp_path):
    base, parts = str(tmp_path), [_chat(spark, None, "edit total"), _chat(spark, "x", "y", "12.5", "yes").filter("event_id >= 2")]
    for p in parts:
        p.write.mode("append").parquet(base + "/src")
        S.run_sessions(S.read_stream(spark, base + "/src", MSG), base + "/out", base + "/ck")
    want = sorted((r["event_id"], r["action"]) for r in S.session_steps(spark, base + "/out").collect())
    assert want == [(0, "pending"), (1, "ask_value"), (2, "edited"), (3, "saved")]
    newest = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "ck" / "commits").iterdir():  # as if the driver had died after the batch's writes
        if p.name.strip(".").startswith(f"{newest}"):
            p.unlink()
    S.run_sessions(S.read_stream(spark, base + "/src", MSG), base + "/out", base + "/ck")
    assert sorted((r["event_id"], r["action"]) for r in S.session_steps(spark, base + "/out").collect()) == want
    assert S.sender_table(spark, base + "/out").read().count() == 1


def test_an_empty_chat_gives_nothing(spark):
    assert SE.confirm_sessions_batch(_chat(spark, "x").limit(0)).count() == 0


def test_status_windows_stream_equals_batch(spark, tmp_path):
    msgs = CS._messages(spark, SF001)
    runs = CS._in_steps(msgs, "ts", str(tmp_path), S.MESSAGE_SCHEMA,
                        lambda m: S.changes_to(S.stream_status(m), f"{tmp_path}/out", f"{tmp_path}/ck"))
    assert sum(r.dropped for r in runs) == 0
    schema = "window_start timestamp, window_end timestamp, body string, n long"
    out = S.latest(S.read_changes(spark, f"{tmp_path}/out", schema), ["window_start", "window_end", "body"])
    b = (msgs.groupBy(F.window("ts", "1 hour").alias("w"), "body").agg(F.count(F.lit(1)).alias("n"))
             .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "body", "n"))
    _same(out, b)


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    def step(day, n):
        spark.range(n).select("id", F.lit(f"2024-01-{day} 10:00:00").cast("timestamp").alias("ts"), F.lit("a").alias("sender"),
                              F.lit(False).alias("has_photo"), F.lit("hi").alias("body")).withColumnRenamed("id", "event_id").write.mode(
            "append").parquet(f"{tmp_path}/src")
        return S.changes_to(S.stream_status(S.read_stream(spark, f"{tmp_path}/src", MSG)), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert step("05", 3).dropped == 0
    step("06", 1)
    assert step("02", 2).dropped > 0


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_ledger_stream_equals_batch_ledger(spark, tmp_path, scheme):
    """Also by a path with a scheme: nothing is looked up with local file calls."""
    from itcflow.sources.tables import Model
    m, base = Model(spark, SF001), scheme + str(tmp_path)
    runs = CS._in_steps(CS._invoices(spark, SF001), "created_at", base, S.INVOICE_SCHEMA,
                        lambda s: S.run_ledger(s, base, base + "/ck"))
    assert len(runs) >= 3
    cols = ["user_id", "period", *[F.col(c).cast("decimal(28,2)").alias(c) for c in ("total_purchases", "itc_available")]]
    _same(S.month_rollup(S.daily_ledger(spark, base)).select(*cols), m.ledger.select(*cols))
    _same(S.month_table(spark, base).read().select(*cols), m.ledger.select(*cols))


def _invoice(i, at, no="A", g="G1", user=1, amount=100):
    return (i, user, g, no, None, at, Decimal(amount), Decimal(9), Decimal(9), Decimal(0), "pending", None)


def _feed(spark, path, rows):
    schema = S.INVOICE_SCHEMA.replace("created_at timestamp", "created_at string")
    spark.createDataFrame(rows, schema).withColumn("created_at", F.col("created_at").cast("timestamp")).write.mode("append").parquet(path)


def test_a_batch_publishes_only_the_months_it_touches(spark, tmp_path):
    base = str(tmp_path)

    def step(*rows):
        before = S.month_table(spark, base + "/l").manifest()["parts"]
        _feed(spark, base + "/src", rows)
        S.run_ledger(S.read_stream(spark, base + "/src", S.INVOICE_SCHEMA), base + "/l", base + "/ck", "400 days")
        after = S.month_table(spark, base + "/l").manifest()["parts"]
        return sum(before.get(k) != v for k, v in after.items())
    assert step(_invoice(1, "2024-01-05"), _invoice(2, "2024-02-05"), _invoice(3, "2024-02-06", user=2)) == 2
    assert step(_invoice(4, "2024-02-05 11:00:00", amount=50), _invoice(5, None)) == 1
    assert step(_invoice(6, "2024-03-01"), _invoice(7, "2024-01-31", user=2)) == 2
    got = {(r["user_id"], r["period"]): (float(r["total_purchases"]), float(r["itc_available"])) for r in S.month_table(spark, base + "/l").read().collect()}
    assert got == {(1, "2024-01"): (100, 18), (1, "2024-02"): (150, 36), (2, "2024-02"): (100, 18), (1, "2024-03"): (100, 18), (2, "2024-01"): (100, 18)}


def test_late_rows_come_back_as_corrections(spark, tmp_path):
    base = str(tmp_path)
    late = [_invoice(3, "2024-01-05", amount=7), _invoice(4, "2024-01-06", user=3)]
    for rows in ([_invoice(1, "2024-01-05"), _invoice(2, "2024-01-07", user=2)], [_invoice(9, "2024-05-01")], late):
        _feed(spark, base + "/src", rows)
        run = S.run_ledger(S.read_stream(spark, base + "/src", S.INVOICE_SCHEMA), base + "/l", base + "/ck")
    assert run.dropped == 2
    nightly = S._by_month(spark.read.schema(S.INVOICE_SCHEMA).parquet(base + "/src").select(
        "user_id", F.date_format("created_at", "yyyy-MM").alias("period"), F.col("taxable_amt").alias("total_purchases"),
        (F.col("cgst") + F.col("sgst")).alias("itc_available")).filter("user_id <> 2"))
    live = S.month_table(spark, base + "/l")
    got = {(r["user_id"], r["change"], r["total_purchases"], r["total_purchases_before"]) for r in S.restate_ledger(live, nightly).collect()}
    assert got == {(1, "change", 107, 100), (3, "insert", 100, None), (2, "delete", None, 100)}
    _same(live.read().select("user_id", "period", *S.LEDGER), nightly)
    assert S.restate_ledger(live, nightly).count() == 0


def test_rows_without_a_time_are_kept(spark, tmp_path):
    msgs = _chat(spark, "hello", "help", "thanks", "bye").withColumn("ts", F.when(F.col("event_id") == 2, None).otherwise(F.col("ts")))
    for _ in S.write_in_order(msgs, "ts", f"{tmp_path}/src"):
        pass
    assert {r["event_id"] for r in spark.read.parquet(f"{tmp_path}/src").collect()} == {0, 1, 2, 3}
    none = msgs.withColumn("ts", F.lit(None).cast("timestamp"))
    for _ in S.write_in_order(none, "ts", f"{tmp_path}/none"):
        pass
    assert spark.read.parquet(f"{tmp_path}/none").count() == 4


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    days = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    for rows, n in ((days, 0), (days.filter("k = 1").withColumn("v", F.lit(11).cast("long")), 1), (days.filter("k = 1"), 1)):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/t/batch={n}")
    got = S.latest(S.read_changes(spark, f"{tmp_path}/t", "k long, v long"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, 10), (2, 20)]
    assert S.read_changes(spark, f"{tmp_path}/none", "k long").count() == 0


def test_dedup_gate_never_forgets(spark, tmp_path):
    def inv(i, day, no, g, user=1):
        return (i, user, g, no, None, f"{day} 10:00:00", None, None, None, None, "pending", None)
    data = [inv(1, "2024-01-01", "A", "G1"), inv(2, "2024-01-02", "A", "G2"), inv(3, "2024-01-03", "A", None), inv(4, "2024-03-01", "A", "G1"),
            inv(5, "2024-03-02", "B", ""), inv(6, "2024-06-02", "B", ""), inv(7, "2024-06-03", "B", "G9"), inv(8, "2024-06-04", " ", "G1"),
            inv(9, "2024-06-05", None, "G1"), inv(10, "2024-06-06", "S", "G1"), inv(11, "2024-06-07", "S", "G2"), inv(12, "2024-06-08", "S", None),
            inv(13, "2024-07-08", "A", "G1", 2)]
    schema = S.INVOICE_SCHEMA.replace("created_at timestamp", "created_at string")
    df = spark.createDataFrame(data, schema).withColumn("created_at", F.col("created_at").cast("timestamp"))
    stored = spark.createDataFrame([inv(0, "2023-01-01", "S", "G1")], schema).withColumn("created_at", F.col("created_at").cast("timestamp"))
    runs = CS._in_steps(df, "created_at", str(tmp_path), S.INVOICE_SCHEMA,
                 lambda s: S.gate_duplicates(s, stored, f"{tmp_path}/passed", f"{tmp_path}/ck"))
    assert {r["id"] for r in S.passed_rows(spark, f"{tmp_path}/passed").collect()} == {1, 2, 5, 7, 8, 9, 11, 13}
    # every row is read once, the stored one too: no batch looks at what came before it
    assert len(runs) >= 3 and sum(r.rows for r in runs) == df.count() + 1


def test_dedup_gate_keeps_to_the_order_of_arrival(spark, tmp_path):
    """A row that comes later but is dated earlier is still the duplicate; inside a batch time and id decide, null first."""
    base, empty = str(tmp_path), spark.createDataFrame([], S.GATE_SCHEMA)

    def step(*rows):
        _feed(spark, base + "/src", rows)
        S.gate_duplicates(S.read_stream(spark, base + "/src", S.INVOICE_SCHEMA), empty, base + "/passed", base + "/ck")
    step(_invoice(1, "2024-03-01"), _invoice(2, "2024-02-01"), _invoice(3, "2024-02-01", no=" A "), _invoice(4, None, no="N"), _invoice(5, "2020-01-01", no="N"))
    step(_invoice(6, "2020-01-01"), _invoice(7, "2020-01-01", g=" "), _invoice(8, "2020-01-01", no="B", g=None), _invoice(9, "2020-01-02", no="B"))
    step(_invoice(10, "2019-01-01", no="B"), _invoice(11, "2019-01-01", no="B", g="G2"), _invoice(12, "2019-01-01", no="C", user=None))
    assert {r["id"] for r in S.passed_rows(spark, base + "/passed").collect()} == {2, 4, 8, 9, 11, 12}
