"""Registered queries: a Spark plan over the given tables and, where SQL can say the
same, the statement it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.weekly_bars import MarketTables
from .sql import query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


_TABLES: dict[tuple[str, str], MarketTables] = {}


def tables(spark: SparkSession, folder: str) -> MarketTables:
    """One set of lazy plans per session and folder; holds no data."""
    return _TABLES.setdefault((spark.sparkContext.applicationId, folder), MarketTables(spark, folder))


def registered(key: str, select: str | None = None):
    """Register a function of MarketTables under `key`."""

    def register(plan: Callable[[MarketTables], DataFrame]):
        QUERIES[key] = lambda spark, folder: plan(tables(spark, folder))
        if select is not None:
            STATEMENTS[key] = query(select)
        return plan

    return register


def near(frame: DataFrame, names, digits: int = 6) -> DataFrame:
    """Round doubles with the operations the SQL side uses, see sql.near."""
    scale = F.lit(float(10**digits))
    return frame.withColumns({n: F.floor(F.col(n) * scale + F.lit(0.5001)) / scale for n in names})


def signed_log(frame: DataFrame, names) -> DataFrame:
    """sign(x) * ln(1 + |x|) for figures that compound over hundreds of periods; the
    derived bars move far more than real prices, so these reach 1e50 and beyond."""
    return frame.withColumns({n: F.signum(n) * F.log1p(F.abs(n)) for n in names})
