"""Display formatters as Column expressions.

Fixed decimals use ``format_number`` with a DecimalFormat pattern (correct
half-even rounding of the exact binary value, like Python's ``format``);
``format_string`` rounds half-up and is used only for the exponent form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frostline.functions.columns import col, missing

# Display strings and colours.
DASH = "—"
PRESSURE_UNIT = "mbar"
STATE_ON, STATE_OFF, STATE_UNKNOWN = "On", "Off", "Unknown"
CHIP_ON, CHIP_OFF, CHIP_UNKNOWN = "#16a34a", "#dc2626", "#64748b"
# End of fixed values.


def _fixed(x: Column, decimals: int, grouping: bool = False) -> Column:
    pattern = ("#,##0" if grouping else "0") + ("." + "0" * decimals if decimals else "")
    return F.call_function("format_number", x, F.lit(pattern))


def _guard(v, body: Column) -> Column:
    return F.when(missing(v), F.lit(DASH)).otherwise(body)


def fmt_temp(v, always_mk: bool | Column = False) -> Column:
    """mK below 0.1 K (or below 1 K with ``always_mk``), else K."""
    x = col(v).cast("double")
    amk = always_mk if isinstance(always_mk, Column) else F.lit(bool(always_mk))
    body = (F.when(amk & (F.abs(x) < 1.0), F.concat(_fixed(x * 1e3, 1, True), F.lit(" mK")))
            .when(F.abs(x) < 0.1, F.concat(_fixed(x * 1e3, 1), F.lit(" mK")))
            .when(F.abs(x) < 10, F.concat(_fixed(x, 3), F.lit(" K")))
            .otherwise(F.concat(_fixed(x, 2), F.lit(" K"))))
    return _guard(x, body)


def fmt_pressure(v) -> Column:
    """pressure with an exponent form outside [1e-2, 1e3)."""
    x = col(v).cast("double")
    unit = F.lit(" " + PRESSURE_UNIT)
    body = (F.when(x == 0, F.lit("0 " + PRESSURE_UNIT))
            .when((F.abs(x) < 1e-2) | (F.abs(x) >= 1e3), F.concat(F.format_string("%.2e", x), unit))
            .when(F.abs(x) < 1, F.concat(_fixed(x, 4), unit))
            .when(F.abs(x) < 100, F.concat(_fixed(x, 3), unit))
            .otherwise(F.concat(_fixed(x, 1), unit)))
    return _guard(x, body)


def fmt_flow(v) -> Column:
    x = col(v).cast("double")
    return _guard(x, _fixed(x, 4))


def fmt_em_temp(v) -> Column:
    """F8: effective temperature; mK below 0.5 K."""
    x = col(v).cast("double")
    body = (F.when(F.abs(x) < 0.5, F.concat(_fixed(x * 1e3, 1, True), F.lit(" mK")))
            .when(F.abs(x) < 10, F.concat(_fixed(x, 3), F.lit(" K")))
            .otherwise(F.concat(_fixed(x, 2), F.lit(" K"))))
    return _guard(x, body)


def fmt_hours(v) -> Column:
    x = col(v).cast("double")
    return _guard(x, F.concat(_fixed(x, 1, True), F.lit(" h")))


def fmt_percent(v) -> Column:
    x = col(v).cast("double")
    return _guard(x, F.concat(_fixed(x, 1), F.lit("%")))


def fmt_count(v) -> Column:
    """Round half to even, then integer text."""
    x = col(v).cast("double")
    return _guard(x, F.bround(x, 0).cast("long").cast("string"))


def fmt_state(v) -> Column:
    """On / Off / Unknown at the 0.5 threshold."""
    x = col(v).cast("double")
    return F.when(missing(x), F.lit(STATE_UNKNOWN)).when(x >= 0.5, F.lit(STATE_ON)).otherwise(F.lit(STATE_OFF))


def chip_color(v) -> Column:
    x = col(v).cast("double")
    return F.when(missing(x), F.lit(CHIP_UNKNOWN)).when(x >= 0.5, F.lit(CHIP_ON)).otherwise(F.lit(CHIP_OFF))
