"""The stratified split: exact quotas of every label, whatever its size."""

import hashlib
from collections import Counter, defaultdict

from itcflow.operators.ingest import stratified_split


def _want(data, pct):
    by = defaultdict(list)
    for text, label in data:
        k = text or ""
        by[label].append((hashlib.md5(f"{k}|{label or ''}".encode()).hexdigest(), k))
    return {(k, label) for label, rows in by.items() for _, k in sorted(rows)[:int(len(rows) * pct / 100 + 0.5)]}


def test_quotas_of_hot_and_small_labels(spark):
    data = [(f"t{i}", "hot") for i in range(3000)] + [(f"t{i}", f"l{i % 9}") for i in range(200)]
    data += [("a", "one"), ("b", None), ("c", None), ("d", None), (None, "null text"), ("", "empty text"), ("e", "")]
    df = spark.createDataFrame(data, "text string, label string").withColumnRenamed("text", "words")
    for pct in (20, 0, 100, 50):
        got = stratified_split(df, "label", "words", pct)
        assert got.columns == ["words", "label", "split"]
        out = got.collect()
        assert Counter((r["words"], r["label"]) for r in out) == Counter(data)
        assert {(r["words"] or "", r["label"]) for r in out if r["split"] == "test"} == _want(data, pct), pct
        assert {r["split"] for r in out} <= {"test", "train"}


def test_repeated_rows_stay_together_and_empty(spark):
    df = spark.createDataFrame([("x", "a")] * 10 + [("y", "a")] * 10, "text string, label string")
    out = Counter((r["text"], r["split"]) for r in stratified_split(df, "label", "text").collect())
    assert len(out) == 2 and sum(out.values()) == 20
    assert stratified_split(df.limit(0), "label", "text").count() == 0
