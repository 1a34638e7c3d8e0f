"""As-of sums against brute force, and the chat replies built on them."""

import datetime as dt
import random
from decimal import Decimal

from itcflow.operators import replies as RP
from itcflow.operators.asof import as_of_sums

ASK = "k string, t timestamp, s long, who string, v0 long"
MOVE = "k string, t timestamp, s long, a decimal(18,2), b int"


def _at(minute):
    return None if minute is None else dt.datetime(2000, 1, 1) + dt.timedelta(minutes=minute)


def _brute(asks, moves):
    out = []
    for k, t, s, who, v in asks:
        mine = [m for m in moves if k is not None and t is not None and m[0] == k and m[1] is not None and (m[1], m[2]) <= (t, s)]
        out.append((k, who, v, sum((m[3] or 0 for m in mine), Decimal(0)), sum((m[4] or 0 for m in mine), 0)))
    return sorted(out, key=repr)


def _run(spark, asks, moves, n=None):
    got = as_of_sums(spark.createDataFrame(asks, ASK), spark.createDataFrame(moves, MOVE), ["k"], ["t", "s"], ["a", "b"], n)
    assert got.columns == ["k", "t", "s", "who", "v0", "a", "b"]
    return sorted([(r["k"], r["who"], r["v0"], r["a"], int(r["b"])) for r in got.collect()], key=repr)


def _same(got, want):
    assert [(k, w, v, Decimal(a), b) for k, w, v, a, b in got] == [(k, w, v, Decimal(a).quantize(Decimal("0.01")), b) for k, w, v, a, b in want]


def test_as_of_sums_hot_key_ties_nulls_repeats(spark):
    rng = random.Random(3)
    keys = ["hot"] * 6 + ["b", "c", "", None]
    moves = [(rng.choice(keys), _at(rng.choice([None, *range(40)])), rng.randint(-2, 5),
              rng.choice([None, Decimal(rng.randint(-500, 500)) / 100]), rng.choice([None, 1, 2])) for _ in range(900)]
    asks = [(rng.choice([*keys, "nobody"]), _at(rng.choice([None, *range(40)])), rng.randint(-2, 5), f"m{i}", i) for i in range(300)]
    asks += asks[:5]                                  # repeated questions are answered each
    got, want = _run(spark, asks, moves, 7), _brute(asks, moves)
    _same(got, want)


def test_as_of_sums_empty(spark):
    move = ("a", _at(1), 0, Decimal("1.00"), 1)
    assert _run(spark, [], [move]) == []
    _same(_run(spark, [("a", _at(2), 0, "m", 1)], []), [("a", "m", 1, 0, 0)])


def test_as_of_sums_cuts_a_hot_key(spark):
    """A key with all rows lies in several pieces: its changes are not one task's."""
    moves = [("hot", _at(i), 0, Decimal(1), 1) for i in range(4000)]
    asks = [("hot", _at(i), 0, f"m{i}", i) for i in range(0, 4000, 7)]
    a, m = spark.createDataFrame(asks, ASK), spark.createDataFrame(moves, MOVE)
    got = as_of_sums(a, m, ["k"], ["t", "s"], ["a", "b"], 8)
    assert {(r["who"], int(r["b"])) for r in got.collect()} == {(f"m{i}", i + 1) for i in range(0, 4000, 7)}
    from pyspark.sql import functions as F
    pieces = m.repartitionByRange(8, "k", "t", "s").groupBy(F.spark_partition_id()).count().collect()
    assert len(pieces) > 4 and max(p["count"] for p in pieces) < 2000


STEP = "sender string, event_id long, ts timestamp, action string, detail string, fields map<string,string>"
INV = "id long, user_id long, created_at timestamp, date timestamp, taxable_amt decimal(18,2), cgst decimal(18,2), sgst decimal(18,2), igst decimal(18,2), status string"


def _day(s):
    return dt.datetime.fromisoformat(s)


def _fixture(spark):
    usr = spark.createDataFrame([(1, "9000000001"), (2, "9000000001"), (3, None)], "id long, phone string")
    inv = spark.createDataFrame([
        (10, 1, _day("2000-01-05"), _day("2000-02-10"), Decimal("100.00"), Decimal("9.00"), Decimal("9.00"), Decimal("0.00"), "pending"),
        (11, 1, _day("2000-01-06"), _day("1999-12-30"), Decimal("50.00"), Decimal("0.00"), Decimal("0.00"), Decimal("5.00"), "blocked"),
        (12, 1, _day("2000-02-01"), _day("2000-02-01"), Decimal("7.00"), None, None, Decimal("1.00"), "blocked"),
        (13, 1, None, _day("2000-02-01"), Decimal("7.00"), None, None, Decimal("1.00"), "pending"),
        (14, 1, _day("2000-02-03"), None, None, None, None, Decimal("2.50"), None),
        (15, 2, _day("2000-01-02"), _day("2000-01-02"), Decimal("999.00"), None, None, Decimal("99.00"), "pending"),
    ], INV)
    photo = {"invoice_no": "EV/1", "invoice_date": "3-2-2000", "taxable_amount": "20.00", "cgst": "1.00", "sgst": "x", "igst": "",
             "total_amount": "0", "description": "restaurant dinner"}
    ask = lambda e, t, who="9000000001": (who, e, None if t is None else _day(t), "intent", "summary", None)
    done = spark.createDataFrame([
        ask(1, "2000-01-05"), ask(2, "2000-01-31T23:59:59"), ask(3, "2000-02-01"), ask(4, "2000-03-01"), ask(5, None),
        ("9000000001", 6, _day("2000-02-04"), "saved", "EV/1", photo), ask(7, "2000-02-04"),
        ask(8, "2000-02-01", "777"), ("777", 9, _day("2000-02-02"), "saved", None, {}), ask(10, "2000-02-03", "777"),
        ("777", 11, _day("2000-02-02"), "edited", "cgst", {}), ask(12, "2000-02-03", None)], STEP)
    return done, inv, usr


def _figures(text):
    return [line.split(": ")[1] for line in text.split("\n") if line.startswith(("📄", "🛒", "💰"))]


def test_summary_as_the_store_stood(spark):
    got = {r["event_id"]: r["message"] for r in RP.summary_replies(*_fixture(spark)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 7, 8, 10, 12]
    assert _figures(got[1]) == ["1", "Rs.100.00", "Rs.18.00"]      # a save at the same moment counts
    assert _figures(got[2]) == ["1", "Rs.100.00", "Rs.23.00"]      # dated before the month: ledger only
    assert _figures(got[3]) == ["2", "Rs.107.00", "Rs.1.00"] and "Blocked: 1 " in got[3]   # February: a new ledger month
    assert _figures(got[7]) == ["3", "Rs.127.00", "Rs.4.50"]       # with the invoice confirmed in the chat
    assert _figures(got[4]) == ["0", "Rs.0.00", "Rs.0.00"] and "March 2000" in got[4]
    assert "GSTR-3B: 2000-04-20 (50 din baaki)" in got[4]
    assert got[5] is None
    assert got[8].startswith("Koi data") and got[12].startswith("Koi data")
    assert _figures(got[10]) == ["0", "Rs.0.00", "Rs.0.00"]        # known by what the chat saved


def test_saved_reply_texts(spark):
    done, inv, usr = _fixture(spark)
    got = {r["event_id"]: r["message"] for r in RP.saved_replies(done, inv, usr).collect()}
    assert sorted(got) == [6, 9]
    assert got[6].split("\n") == ["✅ Invoice save ho gayi!", "", "Invoice: EV/1", "Date: 3-2-2000", "", "Category: Food (85% AI confidence)",
                                  "ITC Mila: Rs.1.00", "Total ITC is mahine: Rs.4.50", "Invoice ID: #6", "", "Aur invoices bhejte rahein!"]
    assert "Category: Other (50% AI confidence)\nTotal ITC is mahine: Rs.0.00\nInvoice ID: #9" in got[9]
    strict = {r["event_id"]: r["message"] for r in RP.saved_replies(done, inv, usr, "classifier").collect()}
    assert "ITC: Blocked (Section 17(5))\n(Yeh" in strict[6] and "ITC Mila" not in strict[6]


def test_replies_of_nothing(spark):
    done, inv, usr = _fixture(spark)
    assert RP.summary_replies(done.limit(0), inv, usr).count() == 0
    assert RP.saved_replies(done, inv.limit(0), usr.limit(0)).count() == 2
