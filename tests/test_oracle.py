"""Every registered query against its DuckDB oracle (row count, columns,
order-insensitive values), on the small fixture; a hot subset at sf0.01."""

import math

import pytest


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in records)


# Spark type -> the DuckDB types that hold the same values
SAME_TYPE = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"},
             "date": {"DATE"}}


def _check(spark, con, name, sf, tmp):
    import __spark_entry__ as E
    df = E.queries()[name](spark, sf)
    cols = df.columns
    assert len({c.lower() for c in cols}) == len(cols), name
    df.write.parquet(f"{tmp}/out")          # what is compared has been written and read
    srows = [tuple(r) for r in spark.read.schema(df.schema).parquet(f"{tmp}/out").collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols), name
    dtypes = {d[0]: str(d[1]) for d in cur.description}
    for c, t in df.dtypes:
        assert t not in SAME_TYPE or dtypes[c] in SAME_TYPE[t], (name, c, t, dtypes[c])
    assert _rows(cols, srows) == _rows(dcols, cur.fetchall()), name


def _names():
    from itcflow.plans.registry import load_all
    return sorted(load_all())


@pytest.mark.parametrize("name", _names())
def test_registry_small(spark, duck, name, tmp_path):
    from conftest import SF001
    _check(spark, duck(SF001), name, SF001, tmp_path)


HOT = ["A6_gstr3b_totals", "A4_client_summary", "W3_mark_duplicates", "W4_running_itc", "F5_gstin_report",
       "F9_classify_layered", "U3_F14_F15_F16_statement_transactions", "J10_reconcile_2b"]


@pytest.mark.parametrize("name", HOT)
def test_registry_sf001(spark, duck, name, tmp_path):
    from conftest import SF01
    _check(spark, duck(SF01), name, SF01, tmp_path)


def test_every_query_names_its_survey_id():
    from itcflow.plans.registry import load_all
    for q in load_all().values():
        assert q.survey_id and q.doc, q.name
