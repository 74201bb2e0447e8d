"""Column expressions that features, labels and evaluation share.

Spark orders NaN above every number and raises on division by zero in ANSI mode; these helpers
compare as IEEE arithmetic does (NaN is greater than nothing) and never divide by zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROSECOND, MILLISECOND, SECOND = 1, 1_000, 1_000_000
SCALES = {"us": MICROSECOND, "ms": MILLISECOND, "sec": SECOND}
CAPPED_WEIGHT = 100_000.0


def to_us(amount: float, scale: str) -> int:
    """A duration in microseconds; an unknown scale raises ValueError."""
    if scale not in SCALES:
        raise ValueError(f"unknown time scale: {scale}")
    return int(amount * SCALES[scale])


def over_positive(num: Column, den: Column, other: Column | float = 0.0) -> Column:
    """num / den where den > 0, else ``other``."""
    return F.when(~F.isnan(den) & (den > 0), num / F.nullif(den, F.lit(0.0))).otherwise(other)


def over_nonzero(num: Column, den: Column, other: Column | float = 0.0) -> Column:
    """num / den where den is not 0, else ``other``."""
    return F.when(den != 0, num / F.nullif(den, F.lit(0.0))).otherwise(other)


def ieee_divide(num: Column, den: Column) -> Column:
    """num / den with infinities and NaN where den is 0."""
    at_zero = F.when(F.isnan(num) | (num == 0), float("nan")).when(num > 0, float("inf")).otherwise(float("-inf"))
    return F.when(den != 0, num / F.nullif(den, F.lit(0.0))).when(den.isNotNull(), at_zero)


def side_sign(side: Column, kind: T.DataType) -> Column:
    """+1 for buy and -1 for sell, or the sign of a number; anything else, 0 included, raises at run time."""
    if isinstance(kind, T.StringType):
        return F.when(side == "buy", 1.0).when(side == "sell", -1.0).otherwise(F.raise_error(F.lit("side must be buy or sell")).cast("double"))
    return F.when(side != 0, F.signum(side)).otherwise(F.raise_error(F.lit("side must not be 0")).cast("double"))


def side_sign_lenient(side: Column, kind: T.DataType) -> Column:
    """As labels take it: every text but buy is -1, and numbers give their sign, 0 included."""
    if isinstance(kind, T.StringType):
        return F.when(side == "buy", 1.0).otherwise(-1.0)
    return F.signum(side)


def mid(bid: Column, ask: Column) -> Column:
    return (bid.cast("double") + ask.cast("double")) / 2.0


def notional(price: Column, amount: Column) -> Column:
    return (price * amount).cast("double")


def label_weight(price: Column, amount: Column) -> Column:
    """Capped in double precision, for label averages."""
    return F.least(notional(price, amount), F.lit(CAPPED_WEIGHT))


def sample_weight(price: Column, amount: Column) -> Column:
    """Narrowed to float, then capped, for training and evaluation."""
    return F.least(notional(price, amount).cast("float"), F.lit(CAPPED_WEIGHT).cast("float"))


def log1p(x: Column) -> Column:
    """log(1 + x), NaN below -1 and -inf at -1 instead of null."""
    return F.when(x > -1, F.log1p(x)).when(x == -1, float("-inf")).when(x.isNotNull(), float("nan"))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_rows(df: DataFrame, *columns: str) -> DataFrame:
    """The rows in which all ``columns`` are finite; a missing column raises ValueError."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    for c in columns:
        df = df.where(is_finite(F.col(c).cast("double")))
    return df


def utc_date_to_sec(date: Column) -> Column:
    """YYYY-MM-DD, as midnight UTC, to epoch seconds."""
    return F.unix_date(F.to_date(date, "yyyy-MM-dd")).cast("long") * 86_400


def us_to_utc_text(us: Column) -> Column:
    """Epoch microseconds to ``YYYY-MM-DD HH:MM:SS UTC``, whatever the session's time zone."""
    day = F.date_format(F.date_from_unix_date(F.floor(us / F.lit(86_400 * SECOND)).cast("int")), "yyyy-MM-dd")
    sec = F.floor(F.pmod(us, F.lit(86_400 * SECOND)) / SECOND)
    return F.format_string("%s %02d:%02d:%02d UTC", day, F.floor(sec / 3600), F.floor(F.pmod(sec, F.lit(3600)) / 60), F.pmod(sec, F.lit(60)))


def microseconds(ts: str, kind: T.DataType) -> Column:
    """A timestamp column as epoch microseconds; ts without zone is read as UTC."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts)) if isinstance(kind, T.TimestampType) else F.col(ts).cast("long")
