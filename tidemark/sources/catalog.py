"""Named sources, their bounds and ranges of time.

A source is a Parquet path, or any DataFrame, with a ``timestamp`` in epoch microseconds. Rows
of equal timestamps keep the order of ``seq``; where a file has none, its row index is used.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import SECOND, to_us

_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


QUOTES = _schema(timestamp=_L, bid_price=_D, bid_amount=_D, ask_price=_D, ask_amount=_D)
TRADES = _schema(timestamp=_L, side=_S, price=_D, amount=_D)
LIQUIDATIONS = TRADES

DAY_SEC = 86_400
TWO_WEEKS_SEC = 14 * DAY_SEC


@dataclass(frozen=True)
class Source:
    """A name and where its rows are; ``schema`` (optional) is declared to the reader."""

    name: str
    path: str
    schema: T.StructType | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read if self.schema is None else spark.read.schema(self.schema)
        df = reader.parquet(self.path)
        return df if "seq" in df.columns else df.withColumn("seq", F.col("_metadata.row_index"))


def sources(root: str, paths: Mapping[str, str], schemas: Mapping[str, T.StructType] | None = None) -> list[Source]:
    """One source per name, below ``root``."""
    return [Source(name, f"{root.rstrip('/')}/{path}", (schemas or {}).get(name)) for name, path in paths.items()]


def time_range(df: DataFrame, since: int, until: int) -> DataFrame:
    """since <= timestamp < until, pushed down to the scan."""
    return df.where((F.col("timestamp") >= since) & (F.col("timestamp") < until))


def bounds_by_source(tables: Mapping[str, DataFrame]) -> DataFrame:
    """source, first_ts, last_ts of all tables in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")).select(F.lit(name).alias("source"), "first_ts", "last_ts")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def _aggregating(spark: SparkSession) -> SparkSession:
    """A session beside the given one whose Parquet reader answers minima and maxima from the files' footers."""
    session = spark.newSession()
    listed = session.conf.get("spark.sql.sources.useV1SourceList")
    session.conf.set("spark.sql.sources.useV1SourceList", ",".join(name for name in listed.split(",") if name != "parquet"))
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def footer_bounds(spark: SparkSession, named: list[Source], column: str | Mapping[str, str] = "timestamp") -> DataFrame:
    """As ``bounds_by_source`` of Parquet sources, from the footers of their files: no data is read.

    ``column`` is a whole number, or a date, of all sources or of each by name. Reading the result raises if a file has no statistics.
    """
    session = _aggregating(spark)
    out = None
    for s in named:
        at = column if isinstance(column, str) else column[s.name]
        reader = session.read if s.schema is None else session.read.schema(s.schema)
        one = reader.parquet(s.path).agg(F.min(f"`{at}`").alias("first_ts"), F.max(f"`{at}`").alias("last_ts")).select(F.lit(s.name).alias("source"), "first_ts", "last_ts")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def known_bounds(rows: DataFrame) -> dict[str, tuple[int | None, int | None]]:
    """First and last timestamp by source."""
    return {r.source: (r.first_ts, r.last_ts) for r in rows.collect()}  # one row per source


@dataclass
class Catalog:
    """Tables by name, cut into chunks of ``window`` from ``start`` to ``end``.

    ``start`` is the first timestamp of all tables, or ``since`` if that is later; ``end`` the last one
    plus 1, or ``until`` if that is earlier. ``since`` and ``until`` are microseconds. ``bounds`` are the tables' first and last
    timestamps where they are known; otherwise they are looked up by reading the tables.
    """

    tables: Mapping[str, DataFrame]
    window: float = 3600
    timescale: str = "sec"
    since: int | None = None
    until: int | None = None
    lookback: Mapping[str, float] = field(default_factory=dict)
    lookahead: Mapping[str, float] = field(default_factory=dict)
    bounds: Mapping[str, tuple[int | None, int | None]] | None = None

    def __post_init__(self) -> None:
        self.chunk_us = to_us(self.window, self.timescale)
        if self.chunk_us <= 0:
            raise ValueError("the window must be positive")
        self.lookback_us = {k: to_us(v, self.timescale) for k, v in self.lookback.items()}
        self.lookahead_us = {k: to_us(v, self.timescale) for k, v in self.lookahead.items()}
        if self.bounds is None:
            self.bounds = known_bounds(bounds_by_source(self.tables))
        found = [self.bounds[name] for name in self.tables]
        firsts, lasts = ([pair[i] for pair in found if pair[i] is not None] for i in (0, 1))
        if not firsts:
            raise ValueError("all tables are empty")
        self.start = min(firsts) if self.since is None else max(min(firsts), self.since)
        self.end = max(lasts) + 1 if self.until is None else min(max(lasts) + 1, self.until)

    @classmethod
    def of(cls, spark: SparkSession, named: list[Source], **options) -> Catalog:
        """Of Parquet sources, whose bounds come from their files' footers; or from the rows where a file has no statistics."""
        try:
            bounds = known_bounds(footer_bounds(spark, named))
        except (PySparkException, Py4JJavaError) as problem:
            if "aggregatePushdown" not in str(problem):
                raise
            bounds = None
        return cls({s.name: s.read(spark) for s in named}, bounds=bounds, **options)

    @property
    def n_chunks(self) -> int:
        return max(0, -(-(self.end - self.start) // self.chunk_us))

    def between(self, since: int, until: int) -> dict[str, DataFrame]:
        """All tables over one range, whatever the catalog's bounds."""
        return {name: time_range(df, since, until) for name, df in self.tables.items()}

    def first(self, seconds: int) -> dict[str, DataFrame]:
        return self.between(self.start, self.start + seconds * SECOND)

    def first_hour(self) -> dict[str, DataFrame]:
        return self.first(3600)

    def first_day(self) -> dict[str, DataFrame]:
        return self.first(DAY_SEC)

    def first_two_weeks(self) -> dict[str, DataFrame]:
        return self.first(TWO_WEEKS_SEC)

    def chunked(self, name: str) -> DataFrame:
        """A table with ``chunk_id``: each row once for every chunk that sees it through lookback or lookahead."""
        back, ahead = self.lookback_us.get(name, 0), self.lookahead_us.get(name, 0)
        ts = F.col("timestamp")
        seen = self.tables[name].where((ts >= self.start - back) & (ts < self.end))
        low = F.greatest(F.lit(0).cast("long"), F.floor((ts - F.lit(self.start + ahead)) / self.chunk_us))
        high = F.least(F.lit(self.n_chunks - 1).cast("long"), F.floor((ts - F.lit(self.start - back)) / self.chunk_us))
        if not back and not ahead:
            return seen.withColumn("chunk_id", low)
        out = seen.withColumn("chunk_id", F.explode(F.sequence(low, F.greatest(low, high))))
        begin = F.lit(self.start) + F.col("chunk_id") * self.chunk_us
        stop = F.least(begin + self.chunk_us, F.lit(self.end))
        return out.where((ts >= begin - back) & (ts < F.least(stop + ahead, F.lit(self.end))))

    def whole(self, name: str) -> DataFrame:
        """The table as one chunk, for results that do not depend on chunk borders."""
        return self.tables[name].withColumn("chunk_id", F.lit(0).cast("long"))

    def chunk(self, index: int) -> dict[str, DataFrame]:
        """What one chunk sees of every table, for training chunk by chunk; ranges are pushed down to the scans."""
        begin = self.start + index * self.chunk_us
        stop = min(begin + self.chunk_us, self.end)
        return {
            name: time_range(df, begin - self.lookback_us.get(name, 0), min(stop + self.lookahead_us.get(name, 0), self.end)).withColumn("chunk_id", F.lit(index).cast("long"))
            for name, df in self.tables.items()
        }
