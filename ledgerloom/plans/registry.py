"""Key -> (Spark job over a scale-factor folder, DuckDB oracle SQL).

Every registered job reads the given tables (through ``Fixture``) over their
whole extent; parameters are the fixture's fixed ones (``AS_OF``, 30 days,
page 1 of 20, …), never row caps chosen to make a check cheap.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import prepare_for_fixtures

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Job], Job]:
    def deco(fn: Job) -> Job:
        if key in JOBS:
            raise KeyError(f"duplicate key {key}")

        @functools.wraps(fn)
        def job(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare_for_fixtures(spark), sf_dir)

        JOBS[key] = job
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def _load_all() -> None:
    # Importing the key modules fills JOBS / ORACLE.
    from ledgerloom.plans import (keys_alerts, keys_commands, keys_crm, keys_defects,  # noqa: F401
                                  keys_history, keys_inventory, keys_keyed, keys_listing, keys_quality,
                                  keys_ranked, keys_sales, keys_search, keys_stored, keys_streams, keys_writes)


def queries() -> dict[str, Job]:
    _load_all()
    return dict(JOBS)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
