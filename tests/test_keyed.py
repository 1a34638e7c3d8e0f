"""Keyed tables: upserts by key, restatement."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from itcflow.operators import filing as FL
from itcflow.sources.keyed import Conflict, KeyedTable, corrections

SCHEMA = "user_id long, period string, itc decimal(18,2), note string"
KEY = ["user_id", "period"], ["period"]


def _table(spark, rows):
    return spark.createDataFrame([(u, p, None if i is None else Decimal(i), n) for u, p, i, n in rows], SCHEMA)


def _rows(df):
    return sorted(((r["user_id"], r["period"], None if r["itc"] is None else float(r["itc"]), r["note"]) for r in df.collect()), key=repr)


def test_publishing_some_users_keeps_the_others(spark, tmp_path):
    path = str(tmp_path)
    FL.publish(_table(spark, [(1, "2000-01", 1, "a"), (2, "2000-01", 2, "b"), (1, "2000-02", 3, "c"), (None, None, 4, None)]), path, *KEY)
    wrote = FL.publish(_table(spark, [(1, "2000-01", 10, None), (3, "2000-03", 5, "d")]), path, *KEY)
    assert len(wrote) == 2
    want = [(1, "2000-01", 10.0, None), (2, "2000-01", 2.0, "b"), (1, "2000-02", 3.0, "c"), (3, "2000-03", 5.0, "d"), (None, None, 4.0, None)]
    assert _rows(FL.published(spark, path, *KEY)) == sorted(want, key=repr)


def test_a_rerun_changes_nothing_and_untouched_parts_stay(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), *KEY)
    rows = _table(spark, [(u, f"2000-0{1 + u % 3}", u, "x") for u in range(30)] + [(7, None, None, None)])
    assert len(t.upsert(rows)) == 4
    first = t.manifest()
    assert t.upsert(rows) == set() and t.upsert(rows.limit(0)) == set() and t.manifest() == first
    part, = t.upsert(_table(spark, [(3, "2000-01", 99, "y")]))
    now = t.manifest()
    assert {k for k in first["parts"] if first["parts"][k] != now["parts"][k]} == {part}
    assert t.read().count() == 31 and t.read(near=_table(spark, [(0, "2000-01", 0, "")])).count() == 10


def test_equal_keys_nulls_and_deletes(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), *KEY)
    t.upsert(_table(spark, [(1, "p", 1, "a"), (1, "p", 2, "b"), (2, "p", None, None), (2, "p", None, None), (None, "p", 3, "n")]), order=["itc"])
    assert _rows(t.read()) == sorted([(1, "p", 2.0, "b"), (2, "p", None, None), (None, "p", 3.0, "n")], key=repr)
    t.upsert(_table(spark, [(2, "p", 5, None)]), deleted=_table(spark, [(1, "p", 0, ""), (2, "p", 0, ""), (9, "q", 0, "")]))
    assert _rows(t.read()) == sorted([(2, "p", 5.0, None), (None, "p", 3.0, "n")], key=repr)
    t.upsert(_table(spark, []), deleted=t.read())
    assert t.read().count() == 0 and t.read().columns == ["user_id", "period", "itc", "note"]
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path), ["user_id"], ["period"])


def test_a_writer_that_died_and_one_that_was_faster(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, "file://" + str(tmp_path), *KEY)
    t.upsert(_table(spark, [(1, "p", 1, "a")]))
    (tmp_path / "manifest" / "1.json").write_text('{"parts": {}')  # without its end
    assert t.read().count() == 1
    t.upsert(_table(spark, [(2, "p", 2, "b")]))
    assert t.read().count() == 2 and t.manifest()["version"] == 2
    other, seen = KeyedTable(spark, "file://" + str(tmp_path), *KEY), []
    plain = KeyedTable._read

    def read(self, *a, **k):  # another writer finishes after this one has looked
        if self is t and not seen:
            seen.append(other.upsert(_table(spark, [(3, "p", len(other._versions()), "c")])))
        return plain(self, *a, **k)
    monkeypatch.setattr(KeyedTable, "_read", read)
    t.upsert(_table(spark, [(4, "p", 4, "d")]))
    assert {r["user_id"] for r in t.read().collect()} == {1, 2, 3, 4}
    seen.clear()
    with pytest.raises(Conflict):
        t.upsert(_table(spark, [(3, "p", 5, "e")]), tries=1)
    t.vacuum(keep=1)
    assert {r["user_id"] for r in t.read().collect()} >= {1, 2, 3, 4} and len(t._versions()) == 1


def test_corrections_turn_one_into_the_other(spark):
    before = _table(spark, [(1, "p", 1, "a"), (2, "p", 2, None), (3, "p", 3, "c"), (None, "p", 0, "n")])
    after = _table(spark, [(1, "p", 1, "a"), (2, "p", 2, "b"), (4, "p", 4, "d"), (None, "p", 0, "n")])
    got = {(r["user_id"], r["change"], r["note"], r["note_before"]) for r in corrections(before, after, KEY[0]).collect()}
    assert got == {(2, "change", "b", None), (3, "delete", None, "c"), (4, "insert", "d", None)}
    assert corrections(before, before.orderBy(F.desc("itc")), KEY[0]).count() == 0
