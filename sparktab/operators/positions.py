"""Row positions and joining two tables by position, for tables without a key.

The order of a table is that of its partitions and of the rows within them. A numbered
table is checkpointed with its partition numbers, so positions hold when tasks run
again. Offsets are prefix sums over one row for each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparktab.session import cut_lineage

POSITION = "_position"
#: monotonically_increasing_id holds the row's place in its partition in so many bits.
PLACE_BITS = 33


def numbered(df: DataFrame, name: str = POSITION) -> DataFrame:
    """``df`` with the positions 0, 1, 2 ... of its rows."""
    if name in df.columns:
        raise ValueError(f"Column exists already: {name}")
    tagged = cut_lineage(df.withColumn("_tag", F.monotonically_increasing_id()))
    part = F.shiftright("_tag", PLACE_BITS)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_tag").bitwiseAND((1 << PLACE_BITS) - 1)
    placed = tagged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_offset") + place).drop("_tag", "_part", "_offset")


def attach(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of both tables side by side, row by row. Tables of different length or with a column of one name are an error."""
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"Columns in both tables: {sorted(clash)}")
    a, b = numbered(left), numbered(right)
    rows = [x.count() for x in (a, b)]
    if rows[0] != rows[1]:
        raise ValueError(f"Tables of different length: {rows[0]} and {rows[1]}")
    return a.join(b, POSITION).drop(POSITION)
