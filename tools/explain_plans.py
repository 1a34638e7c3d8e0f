"""Write PLANS.md: physical plans of the headline queries over the
materialized model (invoices partitioned by month), for review."""
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from itcflow.operators import aggregates as A  # noqa: E402
from itcflow.operators import classify as CL  # noqa: E402
from itcflow.operators import invoices as I  # noqa: E402
from itcflow.operators import windows as W  # noqa: E402
from itcflow.session import get_spark  # noqa: E402
from itcflow.sources.tables import Model  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("itcflow-plans")
    m = Model(spark, sf).materialize(tempfile.mkdtemp(prefix="itcflow-plans-", dir="/tmp"),
                                     ("invoices", "users", "ledger"))
    v = I.invoice_view(m.invoices, m.users)
    items = [
        ("A6 GSTR-3B split, one filing month", A.gstr3b_totals(m.invoices, "dashboard", "2000-05")),
        ("A4 client roll-up", A.client_summary(m.users, m.invoices, m.ledger, "2000-05")),
        ("W1 anomalies (join of per-CA means, partial top-k)", W.invoice_anomalies(v)),
        ("W3 duplicate marking (one aggregate chain, one join)", W.mark_duplicates(m.invoices)),
        ("W4 running ITC (distributed prefix sum)", W.running_itc(m.invoices)),
        ("T2 newest 6 per CA (partial WindowGroupLimit)", W.recent(v)),
        ("F8 keyword classification of documents", CL.classify_keywords(
            m.documents.select("doc_id", F.col("text").alias("description")), "description")),
    ]
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `python tools/explain_plans.py` over `{os.path.basename(sf)}` with the fact tables",
           "materialized as in bench.py (invoices partitioned by month). Expression lists are shortened.", ""]
    for title, df in items:
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = [re.sub(r"\[plan_id=\d+\]", "", ln) for ln in plan.splitlines()]
        lines = [ln if "FileScan" in ln else ln[:180] for ln in lines]
        out += [f"## {title}", "", "```", *lines, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
