"""Print the registered queries as a markdown table (for the README)."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from itcflow.plans.registry import load_all  # noqa: E402

print("| Query | SURVEY ids | Oracle | What it computes |")
print("|---|---|---|---|")
for q in load_all().values():
    doc = " ".join(q.doc.split())
    print(f"| `{q.name}` | {q.survey_id.replace(',', ', ')} | {'DuckDB' if q.sql else 'rows'} | {doc} |")
