"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested one-row report as JSON."""
    report.write.mode(mode).json(path)


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(line_no, text) as a text file, lines in order. For reports of some hundred lines."""
    ordered = lines.groupBy().agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]),
            "\n",
        ).alias("value")
    )
    ordered.write.mode(mode).text(path)
