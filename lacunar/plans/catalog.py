"""Query name to Spark function and SQL.

``query`` registers a function (spark, sf_dir) -> DataFrame under a name with a
signature like "series_id s, idx i, prob d, seg a": columns and their kinds
(s string, i integer, d double, a array of doubles, t timestamp). The signature
selects and casts the same columns on both sides and rounds doubles to six
places, so that engines agree whatever their order of addition.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = "absence_suspicion"
MODULES = ("q_series", "q_features", "q_distances", "q_detectors", "q_estimators", "q_sources")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_SPARK = {"s": lambda c: F.col(c), "i": lambda c: F.col(c).cast("long"), "d": lambda c: F.round(F.col(c).cast("double"), 6) + 0.0, "a": lambda c: F.transform(c, lambda x: F.round(x, 6) + 0.0), "t": lambda c: F.col(c).cast("timestamp_ntz")}
_DUCK = {"s": "{0}", "i": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0::DOUBLE", "a": "list_transform({0}, lambda x: round(x, 6) + 0.0::DOUBLE)", "t": "CAST({0} AS TIMESTAMP)"}


def query(name: str, signature: str, sql: str | None = None):
    columns = [c.split() for c in signature.split(", ")]

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*(_SPARK[k](c).alias(c) for c, k in columns))

        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = run
        if sql:
            body = sql.strip()
            _SQL[name] = f"SELECT {', '.join(f'{_DUCK[k].format(c)} AS {c}' for c, k in columns)} FROM (\n{body}\n) AS q"
        return fn

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
