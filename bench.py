"""Benchmark of the headline queries.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.
Step 1 runs A6 over the unshaped driver tables on four cores, the set-up of the
writes the fact tables once to the shared folder, as the production pipeline
stores them (``ingest``). Step 3 runs each headline query to a ``noop`` sink
(full computation, no collect) three times; ``queries`` has the fastest run,
``first`` the first one. The headline value is ingest plus the fastest runs.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from itcflow.operators import aggregates as A  # noqa: E402
from itcflow.operators import bank as B  # noqa: E402
from itcflow.operators import classify as CL  # noqa: E402
from itcflow.operators import filing as FL  # noqa: E402
from itcflow.operators import ingest as IN  # noqa: E402
from itcflow.operators import invoices as I  # noqa: E402
from itcflow.operators import windows as W  # noqa: E402
from itcflow.plans import catalog_stream as CS  # noqa: E402
from itcflow.plans import catalog_text as CT  # noqa: E402
from itcflow.plans.registry import AS_OF, PERIOD  # noqa: E402
from itcflow.session import get_spark, shared_dir  # noqa: E402
from itcflow.sources.tables import Model  # noqa: E402


def headline(m: Model) -> dict:
    feed = lambda: I.invoice_view(m.invoices, m.users, "dashboard")
    ins = lambda: I.invoice_view(m.invoices, m.users, "insights")
    return {
        "A6_gstr3b_totals": lambda: A.gstr3b_totals(m.invoices, "dashboard"),
        "A4_client_summary": lambda: A.client_summary(m.users, m.invoices, m.ledger, PERIOD),
        "A20_itc_leakage": lambda: A.itc_leakage(ins(), "insights"),
        "A21_supplier_risk": lambda: A.supplier_risk(feed()),
        "W1_invoice_anomalies": lambda: W.invoice_anomalies(feed()),
        "W3_mark_duplicates": lambda: W.mark_duplicates(m.invoices),
        "W4_running_itc": lambda: W.running_itc(m.invoices),
        "F5_gstin_report": lambda: IN.gstin_report(m.invoices, "seller_gstin", repair=True),
        "F8_classify_documents": lambda: CL.classify_keywords(
            m.documents.select("doc_id", F.col("text").alias("description")), "description")
            .select("doc_id", "category", "confidence", "blocked", "reason", "matched_keywords"),
        "F9_classify_layered": lambda: CL.classify_layered(m.documents.select("doc_id", "text"), "text",
                                                           m.zero_shot, m.fine_tuned)
            .select("doc_id", "layer", "category", "confidence", "blocked", "reason", "matched_keywords"),
        "A12_statement_summary": lambda: B.statement_summary(B.statement_transactions(m.bank_cells), m.bank_cells),
        "A7_gstr3b_document": lambda: FL.gstr3b_document(m.invoices, m.users),
        "A11_monthly_report": lambda: A.monthly_report(m.invoices, m.ledger, m.users, AS_OF),
        "F22_render_confirmation": lambda: CT.f22c(m.spark, m.sf_dir),
        "R3_stream_ledger": lambda: CS.r3(m.spark, m.sf_dir),
    }


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def raw_a6(sf_dir: str) -> list[float]:
    """A6 over the driver tables as they are, on four cores: first and best of three."""
    spark = get_spark("itcflow-bench-raw", cpus=4, shuffle_partitions=8)
    took = []
    for _ in range(3):
        t = time.time()
        run(A.gstr3b_totals(Model(spark, sf_dir).invoices, "dashboard"))
        took.append(time.time() - t)
    spark.stop()
    return [round(took[0], 3), round(min(took), 3)]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    raw = raw_a6(sf_dir)
    spark = get_spark("itcflow-bench", cpus=cpus, shuffle_partitions=cpus * 2)
    m = Model(spark, sf_dir)
    t0 = time.time()
    out = shared_dir(spark, f"itcflow-bench/{os.path.basename(sf_dir.rstrip('/'))}-{int(t0)}")
    m.materialize(out, ("invoices", "users", "ledger", "bank_cells", "documents"), files=cpus * 2)
    ingest = time.time() - t0
    first, best = {}, {}
    for name, build in headline(m).items():
        took = []
        for _ in range(1 if name.startswith("R") else 3):
            t = time.time()
            run(build())
            took.append(time.time() - t)
        first[name], best[name] = round(took[0], 3), round(min(took), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "ingest_and_headline_sec", "value": round(ingest + sum(best.values()), 3), "unit": "sec",
                      "queries": best, "first": first, "ingest_sec": round(ingest, 3),
                      "raw_A6_4_cores_first_best": raw, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
