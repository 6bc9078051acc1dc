"""Guarded arithmetic, labels and market constants as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five fuels and the unit column of each.
FUEL_COLUMNS = {
    "EV": "ev_regs",
    "CNG": "cng_regs",
    "Petrol": "petrol_regs",
    "Diesel": "diesel_regs",
    "Strong Hybrid": "hybrid_regs",
}
UNIT_COLUMNS = list(FUEL_COLUMNS.values())
SHARE_COLUMNS = [c.replace("_regs", "_share") for c in UNIT_COLUMNS]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double; null when b is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def safe_ln(x: str | Column) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def xlnx(x: str | Column) -> Column:
    """x ln x with the limit 0 at x <= 0 (null counts as 0)."""
    x = col(x)
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def row_entropy(columns: Sequence[str]) -> Column:
    """Shannon entropy (nats) of share columns in one row."""
    return -total([xlnx(F.col(c)) for c in columns])


def month_start(year: str | Column = "year", month: str | Column = "month") -> Column:
    return F.make_date(col(year), col(month), F.lit(1))


def fiscal_year_starting(year: str | Column) -> Column:
    """Label of the April-March year that starts in ``year``: 1995 -> 1995-96."""
    y = col(year).cast("int")
    return F.format_string("%d-%02d", y, (y + 1) % 100)


def fiscal_year_of(date: str | Column) -> Column:
    d = col(date)
    return fiscal_year_starting(F.year(d) - F.when(F.month(d) < 4, 1).otherwise(0))


def normal_two_sided(z: str | Column) -> Column:
    """Two-sided normal p-value, Abramowitz-Stegun 26.2.17 (error below 7.5e-8)."""
    a = F.abs(col(z))
    t = 1 / (1 + F.lit(0.2316419) * a)
    # The published polynomial coefficients.
    coefficients = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    poly = total([F.lit(c) * F.pow(t, F.lit(float(i + 1))) for i, c in enumerate(coefficients)])
    density = F.exp(-a * a / 2) / F.sqrt(F.lit(2 * 3.141592653589793))
    return F.least(F.lit(1.0), 2 * density * poly)
