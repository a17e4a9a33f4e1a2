"""All registered queries over the block-log engine and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from ledgerstone.plans import formats, maps, rules  # noqa: F401  they register
from ledgerstone.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
