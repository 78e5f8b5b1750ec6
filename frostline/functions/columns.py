"""Column-expression helpers shared by all operators.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.schema import MAX_HOURS, MAX_POINTS, MIN_HOURS, MIN_POINTS, ON_THRESHOLD, TS



def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

US_PER_HOUR = 3_600_000_000.0


# what a text strip removes: all white space, not only blanks
WHITE_SPACE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                       0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# the same as a regular-expression class
WHITE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE) + "]"
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts="ts_eastern") -> Column:
    """Integer microseconds since 1970 of a TIMESTAMP_NTZ, from its naive date and
    time fields, so the result never depends on the session time zone (F2)."""
    t = col(ts)
    day_us = F.unix_date(F.to_date(t)).cast("long") * F.lit(86_400_000_000)
    hm_us = F.hour(t).cast("long") * F.lit(3_600_000_000) + F.minute(t).cast("long") * F.lit(60_000_000)
    sec_us = (F.date_part(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("long")
    return day_us + hm_us + sec_us


def from_micros(us) -> Column:
    """Inverse of :func:`micros`, returning TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", col(us), _epoch())


def bucket_of(us, bucket_us: int) -> Column:
    """Start (in micros) of the fixed-size time bucket holding ``us``.

    Exact long arithmetic; no double division near bucket edges.
    """
    return col(us) - F.pmod(col(us), F.lit(int(bucket_us)))


def floor_minute(ts="ts_eastern") -> Column:
    """Floor an NTZ timestamp to the minute without any time-zone step."""
    us = micros(ts)
    return from_micros(bucket_of(us, 60_000_000))


def is_on(c) -> Column:
    """On/off predicate: NULL counts as off (P5). Never NULL."""
    return F.coalesce(col(c), F.lit(0.0)) >= F.lit(ON_THRESHOLD)


def missing(c) -> Column:
    """NULL or NaN (F3 ``is_missing`` for doubles)."""
    return col(c).isNull() | F.isnan(col(c))


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def strip(text) -> Column:
    """Text without white space at its ends."""
    return F.btrim(col(text), F.lit(WHITE_SPACE))


def lenient_float(text) -> Column:
    """L2: stripped text -> double; empty or unparsable -> NULL; 'nan' -> NaN.
    The pattern keeps out what a cast takes besides: ``1.5d``, ``0x1p3``."""
    t = strip(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def scrub(c) -> Column:
    """NaN and +-inf become NULL (P7 output edge)."""
    x = col(c)
    return F.when(~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), x)


def scrub_frame(df: DataFrame) -> DataFrame:
    """Apply :func:`scrub` to every double column."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(scrub(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def iso_text(ts="ts_eastern") -> Column:
    """ISO-8601 text of a timestamp, microseconds only when non-zero."""
    t = col(ts)
    return F.when(F.date_format(t, "SSSSSS") == "000000", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def ts_literal(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime or ISO text."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def resolve_as_of(df: DataFrame, as_of=None, ts: str = TS):
    """Return ``as_of`` as an NTZ literal column.

    ``None`` means the latest timestamp of the data.  It is resolved once as a
    single scalar so that the trailing-window predicate reaches the Parquet
    scan as a pushed filter (a scalar subquery would not be pushed down).
    ``'now'`` uses the session's current local time, like the reference API.
    """
    if as_of is None:
        latest = df.agg(F.max(ts)).first()[0]
        if latest is None:
            return F.lit(None).cast("timestamp_ntz")
        return ts_literal(latest)
    if isinstance(as_of, str) and as_of.lower() == "now":
        return F.localtimestamp().cast("timestamp_ntz")
    return ts_literal(as_of)


def since(df: DataFrame, start: Column, ts: str = TS) -> DataFrame:
    """``ts >= start`` plus, when the frame has a ``day`` partition column, the
    matching ``day >= to_date(start)`` predicate so whole partitions are pruned."""
    out = df.filter(F.col(ts) >= start)
    if "day" in df.columns:
        out = out.filter(F.col("day") >= F.to_date(start))
    return out


def window_start(as_of_col: Column, hours: int) -> Column:
    return as_of_col - F.expr(f"INTERVAL {int(hours)} HOURS")


def check_hours(hours: int, lo: int = MIN_HOURS, hi: int = MAX_HOURS) -> int:
    if not isinstance(hours, int) or hours < lo or hours > hi:
        raise ValueError(f"hours must be an integer in [{lo}, {hi}], got {hours!r}")
    return hours


def check_points(max_points, lo: int = MIN_POINTS, hi: int = MAX_POINTS, optional: bool = True):
    if max_points is None and optional:
        return None
    if not isinstance(max_points, int) or max_points < lo or max_points > hi:
        raise ValueError(f"max_points must be an integer in [{lo}, {hi}], got {max_points!r}")
    return max_points


def request_error(hours, max_points) -> Column:
    """P2 as an expression: why a request's arguments are refused, NULL if they are
    fine (``max_points`` may be NULL).  For checking many requests in one pass."""
    h, m = col(hours), col(max_points)
    return (F.when(h.isNull() | (h < MIN_HOURS) | (h > MAX_HOURS), F.concat(F.lit(f"hours must be an integer in [{MIN_HOURS}, {MAX_HOURS}], got "),
                                                                      F.coalesce(h.cast("string"), F.lit("None"))))
            .when((m < MIN_POINTS) | (m > MAX_POINTS), F.concat(F.lit(f"max_points must be an integer in [{MIN_POINTS}, {MAX_POINTS}], got "), m.cast("string"))))


def keys_list(keys: Iterable[str] | str | None) -> list[str]:
    if keys is None:
        return []
    if isinstance(keys, str):
        return [keys]
    return list(keys)
