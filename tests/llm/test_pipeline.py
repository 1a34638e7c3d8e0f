"""The corpus pipeline's stages against brute-force versions."""

import collections

import pytest
from conftest import SF001
from test_operators_llm import DOCS, EDGE, brute_classes, check_mix, check_packing, docs, rows


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline
    return dict(corpus_pipeline.STAGES)


def test_stages_follow_each_other(spark, stages):
    from itcflow.llm.common import materialize, table
    assert list(stages) == ["language", "lines", "near_copies", "mix", "packing"]
    before = table(spark, SF001, "documents")
    columns = before.columns
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    kept = materialize(stages["language"](spark, before, SF001), "t1")
    assert kept.columns == columns
    assert {r["doc_id"] for r in rows(kept)} == {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    lined = materialize(stages["lines"](spark, kept, SF001), "t2")
    assert lined.columns == columns
    first = {}
    for i in sorted(texts):
        ls = [x.strip(" \t\n\x0b\x0c\r") for x in texts[i].split("\n")]
        for n in range(len(ls) - 2):
            first.setdefault(tuple(ls[n:n + 3]), (i, n))
    want = {}
    for i, t in texts.items():
        ls = t.split("\n")
        gone = {n + k for n in range(len(ls) - 2) for k in range(3) if first[tuple(x.strip(" \t\n\x0b\x0c\r") for x in ls[n:n + 3])] != (i, n)}
        left = "\n".join(x for n, x in enumerate(ls) if n not in gone)
        if left.strip(" \t\n\x0b\x0c\r"):
            want[i] = left
    assert {r["doc_id"]: r["text"] for r in rows(lined)} == want
    single = materialize(stages["near_copies"](spark, lined, SF001), "t3")
    assert single.columns == columns
    classes = brute_classes(sorted(want.items()))
    assert {r["doc_id"] for r in rows(single)} == set(classes.values())
    mixed = materialize(stages["mix"](spark, single, SF001), "t4")
    assert mixed.columns == columns
    times = collections.Counter(r["doc_id"] for r in rows(mixed))
    data = [(r["doc_id"], r["text"], r["source"]) for r in rows(single)]
    from itcflow.llm.mixing import mixing_plan, with_copies
    planned = rows(with_copies(single, mixing_plan(single)))
    check_mix(planned, data)
    assert times == collections.Counter({r["doc_id"]: r["copies"] for r in planned if r["copies"]})
    packed = rows(stages["packing"](spark, mixed, SF001))
    check_packing(packed, [(r["doc_id"], r["text"]) for r in rows(mixed)], 0.05)


def test_stages_on_edge_rows_and_empty_tables(spark, stages):
    for name, stage in stages.items():
        for extra in (False, True):
            out = stage(spark, docs(spark, EDGE, extra=extra), SF001)
            assert out.count() >= 1
            if name != "packing":
                assert out.columns == docs(spark, EDGE, extra=extra).columns
        assert stage(spark, spark.createDataFrame([], DOCS), SF001).count() == 0


def test_run_gives_pieces(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SF001)
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(out.columns) and out.count() > 50
