"""Registry of named queries: a Spark builder and, where SQL can say it, the
DuckDB oracle text over the same driver tables.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame. Oracle text is
rendered with the bridge views (FIXTURES.md) as common table expressions in
front, so it reads the same parquet tables as the Spark side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..sources import bridge

# Fixed parameters of the registered queries (FIXTURES.md).
PERIOD = "2000-05"
AS_OF = "2000-06-15"
CA_ID = 3


@dataclass
class Query:
    name: str
    build: Callable
    sql: str | None
    survey_id: str
    doc: str


REGISTRY: dict[str, Query] = {}


def _bigint_counts(sql: str) -> str:
    """DuckDB's count_if returns HUGEINT; Spark's count_if is BIGINT. Wrap
    every count_if(...) call so both engines report the same type."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def oracle(select: str, ctes: str = "") -> str:
    """Bridge views + optional extra CTEs (text starting after a comma) + SELECT."""
    pre = "WITH " + bridge.duck_ctes()
    if ctes.strip():
        pre += ",\n" + ctes.strip()
    return _bigint_counts(pre + "\n" + select.strip())


def query(name: str, survey_id: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        import functools

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from ..session import ensure_checkpoint_dir, ship_package
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        text = oracle(sql, ctes) if sql is not None else None
        REGISTRY[name] = Query(name, run, text, survey_id, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    from . import catalog_core, catalog_more, catalog_stream, catalog_text  # noqa: F401  (registration side effects)
    return REGISTRY
