"""All ledger queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthbook.plans.fixtures import Ledger, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers a function of a Ledger; sql runs after the common table expressions of views."""

    def add(function: Callable[[Ledger], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Ledger(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return function

    return add


def half_even_sql(n: str, d: str) -> str:
    """n / d rounded half to even, for positive d."""
    rest = f"((({n}) % ({d}) + ({d})) % ({d}))"
    whole = f"((({n}) - {rest}) // ({d}))"
    return f"(case when ({d}) = 0 then null else {whole} + case when 2 * {rest} > ({d}) then 1 when 2 * {rest} = ({d}) and (({whole} % 2) + 2) % 2 = 1 then 1 else 0 end end)"


def percent_sql(part: str, base: str) -> str:
    """100 * part / base to one decimal as text, for bases of 0 and more."""
    tenths = half_even_sql(f"({part}) * 1000", base)
    return f"(case when ({base}) = 0 then null else (case when {tenths} < 0 then '-' else '' end) || cast(abs({tenths}) // 10 as varchar) || '.' || cast(abs({tenths}) % 10 as varchar) end)"


def load() -> None:
    """Imports every module that registers queries."""
    from hearthbook.plans import commands, extras, items, lifecycle, papers, reconciliation, reviews, scalars, spending, states, tables, trash  # noqa: F401


