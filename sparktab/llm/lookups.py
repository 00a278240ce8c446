"""Looking rows up in a table with unique keys when one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in so many; there are fewer hot keys than that.
HOT_SHARE = 1000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of table, null where it lacks the key. keys hold no nulls and are unique in table. Rows of
    hot keys meet a broadcast of fewer than HOT_SHARE rows, so they stay where they are; the rest meets by shuffle."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    limit = rows.count() // HOT_SHARE + 100
    hot = table.join(counts.where(F.col("__n") > limit).select(*keys), keys)
    few = rows.sparkSession.createDataFrame(hot.collect(), table.select(*keys, *[c for c in table.columns if c not in keys]).schema)
    if few.isEmpty():
        return rows.join(table, keys, "left")
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table, keys, "left")
    return rows.join(F.broadcast(few), keys).unionByName(rest)
