"""Result files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: heading of the text report.
REPORT_HEADING = "Customer Feedback Analysis Summary\n" + "=" * 40 + "\n\n"
# ---- end of fixed values


def timestamped(folder: str, stem: str, now: datetime | None = None) -> str:
    """Path with the time of writing in its name."""
    return f"{folder.rstrip('/')}/{stem}_{(now or datetime.now()):%Y%m%d_%H%M%S}"


def write_json(results: DataFrame, folder: str, stem: str = "analysis_results") -> str:
    """Rows as JSON lines under a timestamped name; returns the path."""
    path = timestamped(folder, stem)
    results.write.option("ignoreNullFields", False).json(path)
    return path


def write_report(report: DataFrame, folder: str, stem: str = "summary") -> str:
    """The ``report`` column as text under a heading; returns the path."""
    path = timestamped(folder, stem)
    report.select(F.concat(F.lit(REPORT_HEADING), "report").alias("value")).write.text(path)
    return path
