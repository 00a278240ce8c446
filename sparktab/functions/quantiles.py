"""Exact quantiles of many columns at any table size.

``percentile`` keeps every distinct value of a column in one aggregation buffer, so
it is used only where the row count proves that buffer small. Larger columns are
narrowed first: a sketch proposes a value bracket around each wanted rank, an exact
count confirms it, and the loop repeats until the bracket holds few rows or a single
value. All columns share each pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.functions.scalars import nan_to_null

DIRECT_ROWS = 1_000_000
ACCURACY = 10_000


@dataclass
class _Rank:
    """One wanted order statistic and the open value interval known to hold it."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def sql(self) -> str:
        """The column's values inside the interval, null outside."""
        c = f"`{self.column}`"
        tests = []
        if self.low is not None:
            tests.append(f"{c} > {self.low!r}D")
        if self.high is not None:
            tests.append(f"{c} < {self.high!r}D")
        return f"CASE WHEN {' AND '.join(tests)} THEN {c} END" if tests else c


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    direct_rows: int = DIRECT_ROWS,
    accuracy: int = ACCURACY,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, nulls and NaN ignored.

    ``counts`` saves a pass where the number of values per column is known.
    """
    if not columns:
        return {}
    types = dict(df.dtypes)
    data = df.select([nan_to_null(c, types[c]).cast("double").alias(c) for c in columns])
    if counts is None:
        row = data.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)]).first()
        counts = {c: row[str(i)] for i, c in enumerate(columns)}
    n_of = counts
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}

    small = [c for c in columns if 0 < n_of[c] <= direct_rows]
    if small:
        probs = F.array(*[F.lit(float(p)) for p in probabilities])
        row = data.agg(
            *[F.percentile(F.col(f"`{c}`"), probs).alias(str(i)) for i, c in enumerate(small)]
        ).first()
        for i, c in enumerate(small):
            result[c] = list(row[str(i)])

    large = [c for c in columns if n_of[c] > direct_rows]
    ranks: dict[tuple[str, int], _Rank] = {}
    for c in large:
        for p in probabilities:
            pos = (n_of[c] - 1) * p
            for r in {math.floor(pos), math.ceil(pos)}:
                ranks.setdefault((c, r), _Rank(c, r, n_of[c]))
    _select(data, list(ranks.values()), direct_rows, accuracy)
    for c in large:
        for i, p in enumerate(probabilities):
            pos = (n_of[c] - 1) * p
            lo, hi = math.floor(pos), math.ceil(pos)
            a, b = ranks[(c, lo)].value, ranks[(c, hi)].value
            result[c][i] = a + (b - a) * (pos - lo)
    return result


def _select(data: DataFrame, ranks: list[_Rank], direct_rows: int, accuracy: int) -> None:
    pending = ranks
    while pending:
        wide = [r for r in pending if r.inside > direct_rows]
        if wide:
            _narrow(data, wide, accuracy)
        narrow = [r for r in pending if r.value is None and r.inside <= direct_rows]
        if narrow:
            row = data.agg(
                *[
                    F.expr(
                        f"percentile_disc({(r.rank - r.below + 0.5) / r.inside!r}D) "
                        f"WITHIN GROUP (ORDER BY {r.sql()})"
                    ).alias(str(i))
                    for i, r in enumerate(narrow)
                ]
            ).first()
            for i, r in enumerate(narrow):
                r.value = row[str(i)]
        pending = [r for r in pending if r.value is None]


def _narrow(data: DataFrame, ranks: list[_Rank], accuracy: int) -> None:
    """One sketch pass and one exact counting pass over all open intervals.

    Whatever the sketch proposes, the counts say on which side of the two proposed
    values the rank lies, so each round either finds the value or drops rows.
    """
    near: dict[str, list[float]] = {}
    for r in ranks:
        share = (r.rank - r.below + 0.5) / r.inside
        near.setdefault(r.sql(), []).extend([max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)])
    # ranks of one interval share a sketch
    proposals = [F.percentile_approx(F.expr(sql), shares, accuracy) for sql, shares in near.items()]
    found = {sql: iter(values) for sql, values in zip(near, data.agg(*proposals).first())}
    sketch = [(next(found[r.sql()]), next(found[r.sql()])) for r in ranks]
    counts = []
    for i, r in enumerate(ranks):
        c = F.col(f"`{r.column}`")
        lo, hi = (F.lit(v) for v in sketch[i])
        counts += [
            F.count_if(c < lo).alias(f"lt_lo{i}"),
            F.count_if(c <= lo).alias(f"le_lo{i}"),
            F.count_if(c < hi).alias(f"lt_hi{i}"),
            F.count_if(c <= hi).alias(f"le_hi{i}"),
        ]
    exact = data.agg(*counts).first()
    for i, r in enumerate(ranks):
        lo, hi = sketch[i]
        lt_lo, le_lo = exact[f"lt_lo{i}"], exact[f"le_lo{i}"]
        lt_hi, le_hi = exact[f"lt_hi{i}"], exact[f"le_hi{i}"]
        top = r.below + r.inside
        if r.rank < lt_lo:
            r.high, r.inside = lo, lt_lo - r.below
        elif r.rank < le_lo:
            r.value = lo
        elif r.rank < lt_hi:
            r.low, r.high, r.below, r.inside = lo, hi, le_lo, lt_hi - le_lo
        elif r.rank < le_hi:
            r.value = hi
        else:
            r.low, r.below, r.inside = hi, le_hi, top - le_hi
