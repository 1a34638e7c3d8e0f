"""What keeps the large jobs in bounds: inputs that are joined or parsed once, shuffles that are needed once."""

import os
import time
from types import SimpleNamespace

from pyspark.sql import functions as F

STAGED = "/itcflow-staged/"


def _all_staged(df):
    files = df.inputFiles()
    return bool(files) and all(STAGED in f for f in files)


def _invoices(spark, n=200):
    i = F.col("id")
    money = lambda x: x.cast("decimal(18,2)")
    return spark.range(n).select(
        "id", (i % 7).alias("user_id"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("G"), (i % 3).cast("string"))).alias("seller_gstin"),
        F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("N"), (i % 13).cast("string"))).alias("invoice_no"),
        F.timestamp_seconds(i * 86400 * 9).alias("date"), F.timestamp_seconds(i * 86400 * 11).alias("created_at"),
        money(i * 10).alias("taxable_amt"), money(i).alias("cgst"), money(i).alias("sgst"), money(i * 0).alias("igst"),
        F.lit("confirmed").alias("status"), F.lit("Office").alias("ai_category"), F.lit(0.9).alias("ai_confidence"),
        F.lit("x").alias("description"))


def test_replies_are_parsed_once(spark):
    from itcflow.operators import ingest as IN
    texts = ['{"cgst": 1.5}', '```json{"igst": null}```', "no", "", "{", "5"]
    rows = spark.range(6).select("id", F.element_at(F.array(*map(F.lit, texts)), (F.col("id") + 1).cast("int")).alias("reply"))
    parsed = IN.read_ocr_replies(rows)
    good, retry = IN.split_ocr(parsed)
    assert retry._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert sorted((r.id, r.parse_error, r.filled_count) for r in parsed.collect())[:2] == [(0, False, 1), (1, False, 0)]
    assert [r.id for r in good.collect()] == [0] and retry.count() == 5


def test_replies_are_tested_once_and_dates_tried_by_shape(spark):
    from itcflow.functions import fixed
    from itcflow.functions import text as X
    from itcflow.operators import ingest as IN
    texts = ['{"invoice_date": "3-2-2024"}', '{"invoice_date": "x"} y', '{"a": 1, "a": 2}', "[1]", "null", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "user_id long, reply string")
    parsed = IN.read_ocr_replies(rows)
    good = IN.to_invoices(parsed.filter(~F.col("parse_error")))
    assert good._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1   # not again in the filter
    valid = {r.user_id for r in rows.filter("try_parse_json(reply) is not null").collect()}
    assert {r.user_id for r in good.collect()} == valid == {r.user_id for r in parsed.collect() if not r.parse_error}
    days = ["3-2-2024", "03/02/2024", "2024-2-3", "2024/2/3", "n/a", "", " 3-2-2024", "3-2-24", "31-2-2024", "3-2-+12024", "-2024-1-1", "3-2-2024\n", None]
    d = spark.createDataFrame([(x,) for x in days], "d string")
    plain = F.coalesce(*[F.try_to_timestamp("d", F.lit(f)) for f in fixed.INVOICE_DATE_FORMATS]).cast("timestamp_ntz")
    out = d.select("d", plain.alias("plain"), X.parse_invoice_date(F.col("d")).alias("got"))
    assert out.filter("NOT plain <=> got").count() == 0 and out.filter("got IS NOT NULL").count() == 5
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") >= 3


def test_invoices_meet_the_parts_first_and_orders_their_customers(spark):
    from itcflow.sources.tables import Model
    m = Model(spark, "nowhere")
    for name, rows, schema in (
            ("lineitem", [(1, 1, 5, 7, 9.0, 100.0, 0.1, 0.05, "A", None), (1, 1, 5, 7, 9.0, 100.0, 0.1, 0.05, "A", None), (2, 1, 6, 7, 1.0, 9.0, 0.0, 0.0, "N", None),
                          (None, 1, 5, 7, 9.0, 1.0, 0.0, 0.0, "N", None), (1, 2, None, 7, 9.0, 1.0, 0.0, 0.0, "N", None)],
             "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
             "l_returnflag string, l_shipdate timestamp_ntz"),
            ("orders", [(1, 3, None), (2, 4, None), (None, 3, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
            ("customer", [(3, 1), (3, 1), (None, 1)], "c_custkey long, c_nationkey int"), ("supplier", [(7, 1), (None, 1)], "s_suppkey long, s_nationkey int"),
            ("part", [(5, "SMALL", "x"), (6, "SMALL", "y"), (None, "z", "z")], "p_partkey long, p_type string, p_name string")):
        m.replace(name, spark.createDataFrame(rows, schema))
    got = [(r.user_id, r.invoice_no, r.description) for r in m.invoices.collect()]
    assert got == [(3, "INV/1/1", "x")] * 4   # equal rows multiply, null meets nothing
    plan = m.invoices._jdf.queryExecution().optimizedPlan().toString()
    joins = [x.split("\n")[0] for x in plan.split("Join Inner, ")[1:]]
    assert [next(k for k in ("s_suppkey", "o_orderkey", "p_partkey", "c_custkey") if k in j) for j in joins] == ["s_suppkey", "o_orderkey", "p_partkey", "c_custkey"]


def _tables(spark, path, n=300):
    """Small driver tables with nulls and rows that come twice."""
    i = F.col("id")
    key = lambda x, k: F.when(i % 37 == k, None).otherwise(x)
    day = lambda x: F.timestamp_seconds(757382400 + x * 86400).cast("timestamp_ntz")
    t = {"orders": spark.range(n // 3).select(key(i, 5).alias("o_orderkey"), key(i % 9, 7).alias("o_custkey"), day(i * 7).alias("o_orderdate"),
                                              F.lit(10.0).alias("o_totalprice"), F.lit("O").alias("o_orderstatus"), F.lit("1").alias("o_orderpriority")),
         "lineitem": spark.range(n).unionAll(spark.range(n // 9)).select(
             key(i % (n // 3), 1).alias("l_orderkey"), (i % 4).alias("l_partkey"), key(i % 5, 2).alias("l_suppkey"), (1 + i % 7).cast("int").alias("l_linenumber"),
             (1.0 + i % 50).alias("l_quantity"), (100.0 + i).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"), F.lit(0.05).alias("l_tax"),
             F.element_at(F.array(*map(F.lit, "ANR")), (1 + i % 3).cast("int")).alias("l_returnflag"), F.lit("F").alias("l_linestatus"), day(i).alias("l_shipdate")),
         "customer": spark.range(9).select(i.alias("c_custkey"), F.lit("c").alias("c_name"), (i % 3).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"),
                                           F.lit("m").alias("c_mktsegment")),
         "supplier": spark.range(5).select(i.alias("s_suppkey"), F.lit("s").alias("s_name"), (i % 3).cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")),
         "part": spark.range(4).select(i.alias("p_partkey"), F.lit("petrol").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("SMALL").alias("p_type"),
                                       F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))}
    for name, df in t.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in top for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_") and f.endswith(".data")}


def test_shuffles_of_a_staged_table_go(spark):
    from itcflow.sources.tables import staged
    was, key = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    df = staged(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    assert df.count() == 100 and spark.conf.get(key, "false") == "false"
    for _ in range(50):   # they are removed in the background; the last one is that of the count
        left = {f.split("_")[1] for f in _shuffle_files(spark) - was}
        if len(left) <= 1:
            break
        time.sleep(0.1)
    assert len(left) <= 1


def test_invoices_staged_in_slices_are_the_same(spark, tmp_path, monkeypatch):
    from itcflow.sources import tables as TB
    d = _tables(spark, tmp_path)
    rows = lambda df: sorted(map(str, df.collect()))
    cols = ["id", "user_id", "seller_gstin", "invoice_no", "created_at", "igst", "description"]
    inv = rows(TB.Model(spark, d).invoices.select(*cols))
    m, written, was = TB.Model(spark, d), [], TB.Model._invoices
    assert TB.slices(m.lineitem) == 1
    monkeypatch.setattr(TB, "SLICE", 2 + sum(os.path.getsize(f.removeprefix("file:")) for f in m.lineitem.inputFiles()) // 3)
    monkeypatch.setattr(TB.Model, "_invoices", lambda self, r: (written.append(r.count()), was(self, r))[1])
    assert rows(m.stage("invoices", *cols).invoices) == inv and _all_staged(m.invoices)
    assert len(written) == 3 and all(written) and sum(written) == len(inv) > 100


def test_duplicates_are_found_in_slices_of_users(spark, tmp_path, monkeypatch):
    from itcflow.plans import catalog_text as CT
    d = _tables(spark, tmp_path)
    rows = lambda df: sorted(map(str, df.collect()))
    whole = CT.j5(spark, d)
    assert not any("/found/" in f for f in whole.inputFiles())
    monkeypatch.setattr(CT, "slices", lambda df: 3)
    found = CT.j5(spark, d)
    assert _all_staged(found) and all("/found/" in f for f in found.inputFiles())
    assert rows(found) == rows(whole) and whole.filter("is_duplicate").count() > 50


def test_streams_read_invoices_that_were_joined_once(spark, monkeypatch):
    from itcflow.plans import catalog_stream as CS
    inv = _invoices(spark)
    monkeypatch.setattr(CS, "M", lambda *_: SimpleNamespace(invoices=inv))
    got = CS._invoices(spark, "nowhere")
    assert _all_staged(got) and got.count() == 200


def test_ledger_streams_carry_what_the_ledger_reads(spark, monkeypatch):
    from itcflow.operators.aggregates import build_ledger
    from itcflow.plans import catalog_stream as CS
    from itcflow.streaming import jobs as S
    inv = _invoices(spark, 120).withColumn("igst", F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 3).cast("decimal(18,2)")))
    monkeypatch.setattr(CS, "M", lambda *_: SimpleNamespace(invoices=inv))
    laid, was = [], CS.S.read_stream
    monkeypatch.setattr(CS.S, "read_stream", lambda s, p, x: (laid.append((s.read.parquet(p).columns, s.read.parquet(p).count())), was(s, p, x))[1])
    path = CS._ledger(spark, "nowhere", "reads")
    assert len(laid) == 4 and all(c == CS.LEDGER_READS for c, _ in laid) and sum(n for _, n in laid) == 120
    rows = lambda df: sorted((r.user_id, r.period, float(r.total_purchases), float(r.itc_available)) for r in df.collect())
    assert rows(S.month_table(spark, path).read()) == rows(build_ledger(inv, "saved"))


def test_views_read_a_staged_table(spark):
    from itcflow.sources.tables import Model
    m = Model(spark, "nowhere")
    m._frames["invoices"] = _invoices(spark)
    plain = sorted(map(tuple, m.ledger.collect()))
    m = Model(spark, "nowhere")
    m._frames["invoices"] = _invoices(spark)
    m.stage("invoices", "user_id", "created_at", "taxable_amt", "cgst", "sgst", "igst")
    assert _all_staged(m.ledger) and sorted(map(tuple, m.ledger.collect())) == plain


def test_anomalies_join_the_feed_once(spark):
    from itcflow.operators import windows as W
    v = _invoices(spark).select("id", "user_id", F.lit("n").alias("client_name"), F.col("taxable_amt").alias("total"))
    assert _all_staged(W.invoice_anomalies(v, n=None, by="user_id"))


def test_duplicates_join_aggregates_where_they_were_grouped(spark):
    from itcflow.operators import windows as W
    inv = _invoices(spark)
    out = W.mark_duplicates(inv)
    assert not [j for j in out._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1:] if "Union" in j]
    rows = [(r.id, r.user_id, r.invoice_no, r.seller_gstin) for r in inv.collect()]
    want = {}
    for i, u, no, g in rows:
        first = min((x for x, xu, xno, xg in rows if xu == u and xno == no and (g == "" or xg == g)), default=None) if no else None
        want[i] = first if first is not None and first < i else None
    assert {r.id: r.dup_of for r in out.collect()} == want and any(want.values())


def test_filings_are_compressed_and_read_back(spark, tmp_path):
    from itcflow.operators import filing as FL
    docs = spark.range(3).select(F.col("id").alias("user_id"), F.lit("2000-01").alias("period"), F.lit("012000").alias("ret_period"),
                                 F.concat(F.lit("G"), F.col("id")).alias("gstin"), F.lit("f").alias("file_name"), F.struct("id").alias("doc"))
    sup = spark.range(9).select((F.col("id") % 3).alias("user_id"), F.lit("2000-01").alias("period"), F.col("id").alias("invoice_id"))
    FL.write_gstr3b(docs, sup, str(tmp_path))
    parts = [f for _, _, fs in os.walk(tmp_path) for f in fs if f.startswith("part-")]
    assert parts and all(f.endswith(".gz") for f in parts)
    d, x = FL.read_gstr3b(str(tmp_path), docs, sup)
    assert d.count() == 3 and sorted((r.ret_period, r.gstin, r.invoice_id) for r in x.collect()) == sorted(
        ("012000", f"G{i % 3}", i) for i in range(9))


def test_gate_keeps_its_state_in_rocksdb(spark, tmp_path):
    from itcflow.streaming import jobs as S
    rows = _invoices(spark).select([c.split()[0] for c in S.INVOICE_SCHEMA.split(", ")])
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    rows.write.parquet(f"{tmp_path}/src")
    S.gate_duplicates(S.read_stream(spark, f"{tmp_path}/src", S.INVOICE_SCHEMA), rows.limit(0), f"{tmp_path}/passed", f"{tmp_path}/ck")
    assert "RocksDB" in open(f"{tmp_path}/ck/offsets/0").read() and spark.conf.get(key, None) == was


def test_gate_and_its_stream_leave_little(spark, monkeypatch):
    """The laid ranges and the staged table go when they have been read; a key without a GSTIN keeps no texts of rows with one."""
    from itcflow.plans import catalog_stream as CS
    inv, seen = _invoices(spark).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 24 YEARS")), []
    monkeypatch.setattr(CS, "M", lambda *_: SimpleNamespace(invoices=inv))
    was, base, staged = CS.S.gate_duplicates, CS._base, CS.staged
    monkeypatch.setattr(CS, "staged", lambda df, name: seen.append(staged(df, name)) or seen[-1])
    monkeypatch.setattr(CS, "_base", lambda *a: seen.append(base(*a)) or seen[-1])
    monkeypatch.setattr(CS.S, "gate_duplicates", lambda s, *a: (seen.append(spark.read.parquet(seen[0] + "/src")), was(s, *a))[1])
    out = CS.r2(spark, "nowhere")
    top, table, laid = seen[0], seen[1], seen[2:]
    assert table.columns == CS.GATE_READS and all(x.columns == CS.GATE_READS for x in laid) and len(laid) == 4
    gone = lambda p: not os.path.exists(p.removeprefix("file:"))
    assert gone(top + "/src") and all(gone(f.replace("file:///", "/")) for f in table.inputFiles())
    rows, first = sorted(((r.created_at, r.id, r.user_id, r.invoice_no, r.seller_gstin) for r in inv.collect())), []
    for i, (_, _, u, no, g) in enumerate(rows):
        if not no or not any((u, no) == x[2:4] and g in ("", x[4]) for x in rows[:i]):
            first.append(rows[i][1])
    late = {r.id for r in inv.filter(F.col("created_at") >= CS.STORED_BEFORE).collect()}
    assert sorted(r.id for r in out.collect()) == sorted(set(first) & late) and len(set(first) & late) > 20
    at = F.when(F.col("id") < 100, "1992-01-01").otherwise("2000-01-01")   # one range, and rows that are stored
    inv = inv.withColumn("created_at", at.cast("timestamp"))
    seen.clear()
    got = CS.r2(spark, "nowhere")
    assert got.filter("id < 100").count() == 0 and got.count() > 5


def test_documents_of_one_row_group_go_to_many_tasks(spark, tmp_path):
    from itcflow.plans.catalog_text import f8d, l3
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("some petrol text").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (f8d, l3):
        df = query(spark, str(tmp_path))
        assert "Repartition" in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 50


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k: plan.count(k) for k in ("ShuffledHashJoin", "SortMergeJoin", "BroadcastHashJoin")}


def test_statements_are_read_once_and_cells_are_not_sorted(spark):
    from itcflow.operators import bank as B
    rows = [(1, n, "HDFC Bank", ["03/02/2024", f"NEFT rent {n}", "", "03/02/2024", f"{n}00.50", "", "9.00"]) for n in range(1, 8)]
    rows += [(2, 1, "Kotak", ["03/02/24", "misc", "7.50"]), (2, 2, None, ["x", None]), (3, 1, "Village", ["03/02/24", "Vendor bill", "5.00"]),
             (4, 1, " ", ["a"]), (None, 1, "HDFC Bank", ["03/02/2024", "rent", "", "", "1.00", "", ""])]
    cells = spark.createDataFrame(rows, "statement_id long, row_no long, page_text string, cells array<string>")
    txns = B.statement_transactions(cells)
    assert _joins(txns)["ShuffledHashJoin"] >= 3 and _joins(txns)["SortMergeJoin"] + _joins(txns)["BroadcastHashJoin"] == 0
    out = B.statement_replies(txns, cells)
    assert _all_staged(out.select("reply"))
    got = {r.statement_id: r.reply for r in out.collect()}
    assert set(got) == {1, 2, 3, None}   # null is a statement of its own, whose rows meet no bank
    assert [f"NEFT rent {n}" in got[1] for n in range(1, 8)] == [True] * 5 + [False] * 2
    assert got[1].index("NEFT rent 1") < got[1].index("NEFT rent 2") < got[1].index("NEFT rent 5")
    assert "Vendor bill" in got[3] and "misc" not in got[2]


def test_confirmations_join_ids_only_and_deal_blank_ones(spark):
    from itcflow.functions import fixed
    from itcflow.functions import gstin as G
    from itcflow.operators import ingest as IN
    good = spark.range(1).select(F.concat(F.lit("27AAPFU0939F1Z"), G.check_char("'27AAPFU0939F1Z'"))).first()[0]
    texts = ['{"seller_gstin": "%s", "description": "Laptop", "cgst": 9.0}' % good, '{"seller_gstin": "", "invoice_no": "7"}',
             '{"seller_gstin": "bad", "description": "x"}', '{"invoice_no": "8", "description": ""}', "no", "{}"]
    replies = spark.range(6).select("id", F.element_at(F.array(*map(F.lit, texts)), (F.col("id") + 1).cast("int")).alias("reply"))
    report = IN.gstin_report(spark.createDataFrame([(good,), ("bad",), ("",), (None,)], "g string"), "g")
    out = IN.confirmation_messages(IN.read_ocr_replies(replies), report)
    assert _joins(out) == {"ShuffledHashJoin": 1, "SortMergeJoin": 0, "BroadcastHashJoin": 0}
    got = {r.id: r.message for r in out.collect()}
    assert len(got) == 6 and "Valid (" in got[0] and "Electronics" in got[0] and "Invalid GSTIN - ITC risk!" in got[2]
    assert "GSTIN" not in got[1].split(fixed.CONFIRM_TAIL)[0].replace(fixed.CONFIRM_HEAD, "") and "Other" in got[3]
    assert (got[4], got[5]) == (fixed.PHOTO_UNREADABLE, fixed.PHOTO_EMPTY)


def test_workers_keep_little():
    from itcflow.llm import hyper_lang, token_ids
    kept = token_ids.Kept(lambda key: b"")
    for i in range(600_000):
        kept[f"{i:x}"]
    assert len(kept) + len(kept.old) <= 400_000
    assert hyper_lang.Profiles().vectors.nbytes <= 20_000 * 1024


def test_workers_keep_no_words_after_a_task(monkeypatch):
    import pyarrow as pa

    from itcflow.llm import common, dartminhash, packing

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)
    monkeypatch.setattr(packing, "TaskContext", Task)
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(len(ids.words) + len(ids.words.old)))
    ids = packing.of_worker(None)
    ids.words.old["left"] = b""
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"river{i} Stone, wood".encode()])], names=["id", "t"]) for i in (1, 2)]
    out = common.tidy(packing._pieces(4096, 2, None))(iter(batches))
    first = next(out)
    assert len(ids.words) and len(ids.chunks) == 3 and not given
    second = next(out)
    assert list(out) == [] and given == [0]
    assert (len(ids.words), len(ids.chunks), len(ids.chunks.old), ids.words.bytes, ids.chunks.bytes) == (0,) * 5
    again = list(packing._pieces(4096, 2, None)(iter(batches)))
    assert [b.to_pydict() for b in again] == [b.to_pydict() for b in (first, second)]
    assert dartminhash._UP.nbytes + dartminhash._DOWN.nbytes <= 16 << 20
