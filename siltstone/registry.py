"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone import queries as found
from siltstone import queries_code as _code  # noqa: F401 (registers its queries)
from siltstone import queries_evaluation as _evaluation  # noqa: F401
from siltstone import queries_governance as _governance  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found.text_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(found.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(found.ORACLES)
