"""Column expressions used across the stages (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from txnwatch.schema import SAFE_EPS, pay_column

_MICROS = 1_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(df: DataFrame, ts: str) -> Column:
    """Whole seconds since the epoch, floored; independent of the session time zone
    for ``timestamp_ntz`` columns (a plain ``cast`` would shift them by the zone)."""
    dtype = df.schema[ts].dataType
    if isinstance(dtype, TimestampNTZType):
        us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
        return ((us - F.pmod(us, F.lit(_MICROS))) / F.lit(_MICROS)).cast("long")
    if isinstance(dtype, TimestampType):
        return F.col(ts).cast("long")
    return F.col(ts).cast("long")


def parse_ts(c: str | Column) -> Column:
    """``yyyy/MM/dd HH:mm`` text to a timestamp without a zone (a wall-clock time means the
    same in every session, also across a daylight-saving change); anything else is null."""
    iso = F.regexp_replace(col(c), r"^(\d{4})/(\d{2})/(\d{2}) (\d{2}:\d{2})$", "$1-$2-$3 $4:00")
    return F.when(iso != col(c), iso.try_cast("timestamp_ntz"))


def safe_ratio(num: str | Column, den: str | Column, eps: float = SAFE_EPS) -> Column:
    """``num / (den + eps)``: the published ratio features, null on null input."""
    return col(num) / (col(den) + F.lit(eps))


def is_multiple(c: str | Column, unit: float) -> Column:
    """1 when the value is an exact multiple of ``unit`` (0 counts), else 0; null on null."""
    return ((col(c) % F.lit(unit)) == 0).cast("int")


def differs(a: str | Column, b: str | Column) -> Column:
    """1 when the two values differ, 0 when equal, null when either is null."""
    return (col(a) != col(b)).cast("int")


def one_hot(c: str | Column, categories) -> list[Column]:
    """One int column per category, named ``pay_<lower_snake>``; null on null input."""
    return [(col(c) == F.lit(cat)).cast("int").alias(pay_column(cat)) for cat in categories]


def keyed_hash(key: str | Column, seed: int) -> Column:
    """Deterministic 32-bit hash of ``'<seed>:<key>'`` (first 8 hex digits of MD5).

    The same value in any engine with MD5; it replaces seeded ``rand`` so a
    sample or split does not depend on how rows are partitioned.
    """
    text = F.concat(F.lit(f"{seed}:"), col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def typology_from_header(header: str | Column) -> Column:
    """``BEGIN ... - FAN-OUT: detail`` -> ``FAN-OUT``: text after the first '-', before the first ':', trimmed."""
    after_dash = F.regexp_replace(col(header), r"^[^-]*-", "")
    return F.trim(F.split(after_dash, ":").getItem(0))


def round6(c: str | Column) -> Column:
    return F.round(col(c), 6)
