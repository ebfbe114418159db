"""The report's column list with BI types.

Type rule: ``decimal*`` -> ``DECIMAL``, ``bigint*`` -> ``INTEGER``, anything
else upper-cased; then the two derived totals are appended as ``DECIMAL``.
It works on the schema only (driver metadata), never on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The two columns the roll-up report adds, in this order.
TOTAL_COLUMNS = ("total_emissions_marketbased", "total_emissions_locationbased")


def bi_type(type_text: str) -> str:
    t = type_text.strip()
    if t.startswith("decimal"):
        return "DECIMAL"
    if t.startswith("bigint"):
        return "INTEGER"
    return t.upper()


def report_columns(df: DataFrame) -> list[tuple[str, str]]:
    cols = [(f.name, bi_type(f.dataType.simpleString())) for f in df.schema.fields]
    return cols + [(name, "DECIMAL") for name in TOTAL_COLUMNS]


def report_schema(df: DataFrame) -> DataFrame:
    """DataFrame ``(position, name, type)`` describing the report of ``df``."""
    rows = [(i, n, t) for i, (n, t) in enumerate(report_columns(df))]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")
