"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed values of the data model: emission amounts are DECIMAL(20,10) and every
# roll-up step is cast back to that type.
AMOUNT_TYPE = DecimalType(20, 10)
# Totals: what SUM over DECIMAL(20,10) yields in Spark SQL.
TOTAL_TYPE = DecimalType(30, 10)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coalesce_amount(total, specific) -> Column:
    """``COALESCE(total, specific, 0)`` as an amount (stays DECIMAL(20,10))."""
    return F.coalesce(_col(total), _col(specific), F.lit(0)).cast(AMOUNT_TYPE)


def contribution(amount, percentage) -> Column:
    """``CAST(amount * percentage AS DECIMAL(20,10))`` — rounds every step."""
    return (_col(amount) * _col(percentage)).cast(AMOUNT_TYPE)


def run_date(as_of: date | str | None = None) -> Column:
    """Run date as ``yyyy-MM-dd`` text; injectable for reproducible runs."""
    if as_of is None:
        return F.date_format(F.current_date(), "yyyy-MM-dd")
    return F.lit(str(as_of))


def principal_name(tenant, prefix: str) -> Column:
    """Principal of a tenant: ``{prefix}{t}/{t}TenantRole/{t}``.

    ``prefix`` is deployment configuration (account and region part of the
    principal), so it is a parameter rather than a constant.
    """
    t = _col(tenant)
    return F.concat(F.lit(prefix), t, F.lit("/"), t, F.lit("TenantRole/"), t)


def exact_decimal_sum(column, precision: int = 18, scale: int = 2) -> Column:
    """``SUM(CAST(column AS DECIMAL(precision, scale)))``, computed on the
    unscaled integers.

    Same value and type (``DECIMAL(precision + 10, scale)``) as Spark's sum,
    but the aggregation buffer is a long instead of a wide decimal, which
    keeps the partial aggregate on Spark's fast fixed-width path.  The unscaled
    long sum raises on overflow (ANSI) rather than wrapping.
    """
    unit = 10**scale
    unscaled = (_col(column).cast(f"decimal({precision},{scale})") * F.lit(unit)).cast("bigint")
    total = F.sum(unscaled).cast(f"decimal({precision + 10},0)") / F.lit(unit)
    return total.cast(f"decimal({precision + 10},{scale})")
