"""All queries of the library's own operators and the SQL that checks them."""

from __future__ import annotations

import importlib

from sievework.plans.registry import ORACLES, QUERIES, Query

MODULES = ("text_queries", "result_queries", "data_queries", "page_queries")

for _name in MODULES:
    importlib.import_module(f"sievework.plans.{_name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
