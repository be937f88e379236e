"""Look-ups that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot, so there are at most so many hot keys.
SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row a key); a null in the key finds nothing.

    Rows of hot keys meet their row of ``table`` by broadcast (at most ``SHARE`` rows), the
    others by shuffle; rows without a key meet nothing and stay where they are. ``rows`` is
    read several times: cut it first where that is dear.
    """
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in key]
    none = F.lit(False)
    for k in key:
        none = none | F.col(k).isNull()
    asking = rows.filter(~none)
    counts = asking.groupBy(*key).agg(F.count("*").alias("n_"))
    total = counts.agg(F.sum("n_")).first()[0] or 0
    hot = rows.sparkSession.createDataFrame(counts.filter(F.col("n_") * SHARE > total).drop("n_").collect(), rows.select(*key).schema)  # at most SHARE rows
    cold = asking.join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    warm = asking.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, "left")
    columns = [*rows.columns, *(f.name for f in table.schema if f.name not in key)]
    return cold.select(*columns).unionByName(warm.select(*columns)).unionByName(rows.filter(none).select(*rows.columns, *others))
