"""Mutual information of two columns by nearest neighbours, with a defined result on ties.

Columns are divided by their standard deviations (to 24 bits, which do not depend on the order of summing) and rounded to multiples of 2**-32, so
that distances are integers. For each of N rows let r
be the distance (the larger of the two columns' differences) to its k-th nearest other row, and n_x, n_y the rows, itself included, whose
one column lies nearer than r; then

    I = psi(N) + mean(psi(m) - psi(n_x) - psi(n_y)),  at least 0,

with m = k where r > 0. Where k or more other rows equal the row, r is 0: then m, n_x and n_y are the rows, itself included, that equal it in
both columns and in each. Rows without ties give the estimate of Kraskov, Stoegbauer and Grassberger; on discrete columns it
is that of counts. Rows with nulls, NaN or infinities take no part; fewer than k + 2 rows, or a constant column, give 0.

Equal rows are one point with a weight. Points are dealt to leaves of about ``leaf_rows``: strips of x by quantiles, each cut by
quantiles of y. A leaf finds its points' neighbours among its own; where a point's square of that radius reaches
into other leaves, it is sent there to ask for nearer ones. Rows in a column's range are counted by running sums over range partitions. No task holds more than a
leaf with what is asked of it, and the driver holds the cuts only (at most 2**16 of them).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import is_finite
from tidemark.plans.prefix import running
from tidemark.sources.scratch import written

LEAF_ROWS = 1024
MOST_LEAVES = 1 << 16
UNIT = 1 << 32
FAR = 1 << 62


def digamma(m: Column) -> Column:
    """psi of whole numbers from 1 on."""
    harmonic = [0.0]
    for i in range(1, 16):
        harmonic.append(harmonic[-1] + 1 / i)
    small = F.element_at(F.array(*(F.lit(h - 0.5772156649015329) for h in harmonic)), F.least(m, F.lit(16)).cast("int"))
    x = F.greatest(m, F.lit(1)).cast("double")
    inverse = 1 / (x * x)
    large = F.log(x) - 0.5 / x - inverse * (1 / 12 - inverse * (1 / 120 - inverse / 252))
    return F.when(m <= 16, small).otherwise(large)


class Leaves:
    """Strips of x, each cut by y: the upper ends of strips and, for each, of its leaves; the last ones are open."""

    def __init__(self, x: np.ndarray, y: list[np.ndarray]):
        self.x, self.y = x, y
        self.first = np.cumsum([0, *(len(e) + 1 for e in y)])

    @classmethod
    def of(cls, points: DataFrame, leaf_rows: int) -> Leaves:
        total = points.count()
        leaf_rows = max(leaf_rows, -(-total // MOST_LEAVES))
        strips = max(1, int(np.sqrt(total / leaf_rows)))
        shares = [i / strips for i in range(1, strips)]
        ends = np.unique(points.agg(F.percentile_approx("x", shares, 10_000)).first()[0] or []) if shares else np.zeros(0)
        ends = ends.astype(np.int64)
        strip = sum((F.when(F.col("x") > int(e), 1).otherwise(0) for e in ends), F.lit(0)) if len(ends) < 8 else F.size(F.filter(F.array(*map(F.lit, ends.tolist())), lambda e: e < F.col("x")))
        fine = [i / 1024 for i in range(1, 1024)]
        cut = [np.zeros(0, np.int64)] * (len(ends) + 1)
        for r in points.groupBy(strip.alias("strip")).agg(F.count("*").alias("n"), F.percentile_approx("y", fine, 10_000).alias("ends")).collect():  # a row for each strip
            parts = min(1024, -(-r.n // leaf_rows))
            cut[r.strip] = np.unique(np.array(r.ends, np.int64)[[i * 1024 // parts - 1 for i in range(1, parts)]])
        return cls(ends, cut)

    def place(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.x, x, "left")
        out = self.first[strip]
        for s in np.unique(strip).tolist():
            at = strip == s
            out[at] += np.searchsorted(self.y[s], y[at], "left")
        return out

    def reached(self, x: int, y: int, radius: int) -> Iterator[int]:
        """The leaves that hold places nearer than ``radius``."""
        for s in range(int(np.searchsorted(self.x, x - radius + 1, "left")), int(np.searchsorted(self.x, x + radius - 1, "left")) + 1):
            a, b = (int(np.searchsorted(self.y[s], v, "left")) for v in (y - radius + 1, y + radius - 1))
            yield from range(int(self.first[s]) + a, int(self.first[s]) + b + 1)


def _nearest(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, weight: np.ndarray, k: int, own: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each (x, y) the distances to its k nearest points (px, py), in order, and their weights; ``own``: the i-th point is the i-th asker itself, with one row less."""
    for begin in range(0, len(x), 256):
        some = slice(begin, begin + 256)
        away = np.maximum(np.abs(x[some, None] - px[None]), np.abs(y[some, None] - py[None]))
        near = np.argpartition(away, min(k, away.shape[1] - 1), axis=1)[:, : k + 1] if away.shape[1] > k + 1 else np.broadcast_to(np.arange(away.shape[1]), away.shape)
        for i, names in enumerate(near):
            w = weight[names].copy()
            if own:
                w[names == begin + i] -= 1
            d = away[i, names]
            order = np.argsort(d[w > 0], kind="stable")
            yield begin + i, d[w > 0][order], w[w > 0][order]


def _kth(distance: np.ndarray, weight: np.ndarray, k: int) -> int:
    """The distance of the k-th row; ``FAR`` if there are fewer."""
    upto = np.cumsum(weight)
    at = int(np.searchsorted(upto, k))
    return int(distance[at]) if at < len(upto) else FAR


def radii(points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """id, radius: the distance of each point (id, x, y, n) to the k-th nearest row besides one of its own."""
    leaves = Leaves.of(points, leaf_rows)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves.place(batch.column(1).to_numpy(), batch.column(2).to_numpy()))], names=["id", "x", "y", "n", "leaf"])

    def columns(table: pa.Table) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in ("id", "x", "y", "n")]

    def inside(group: pa.Table) -> pa.Table:
        ids, x, y, n = columns(group)
        leaf = group.column("leaf")[0].as_py()
        out: list[tuple] = []
        for i, d, w in _nearest(x, y, x, y, n, k, own=True):
            radius = _kth(d, w, k)
            row = (int(ids[i]), int(x[i]), int(y[i]), radius)
            out.append((*row, -1, d.tolist(), w.tolist()))
            if radius > 0:
                out += [(*row, other, None, None) for other in leaves.reached(int(x[i]), int(y[i]), min(radius, FAR)) if other != leaf]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "x", "y", "radius", "leaf", "d", "w"])

    def beyond(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(left) and len(right):
            (_, px, py, n), ids, x, y, radius = columns(left), *(right.column(c).to_numpy() for c in ("id", "x", "y", "radius"))
            for i, d, w in _nearest(x, y, px, py, n, k, own=False):
                near = d < radius[i]
                if near.any():
                    rows.append((int(ids[i]), d[near].tolist(), w[near].tolist()))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["id", "d", "w"])

    spark = points.sparkSession
    dealt = points.select("id", "x", "y", "n").mapInArrow(placed, "id long, x long, y long, n long, leaf long")
    first = written(dealt.groupBy("leaf").applyInArrow(inside, "id long, x long, y long, radius long, leaf long, d array<long>, w array<long>"), spark)
    more = dealt.groupBy("leaf").cogroup(first.where("leaf >= 0").select("id", "x", "y", "radius", "leaf").groupBy("leaf")).applyInArrow(beyond, "id long, d array<long>, w array<long>")
    lists = first.where("leaf < 0").select("id", "d", "w").unionByName(more)
    # the k-th row over the lists that its leaf and others gave, at most k long each
    pairs = F.flatten(F.collect_list(F.arrays_zip("d", "w")))
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(FAR).cast("long").alias("radius"))
    kth = F.aggregate(F.sort_array("pairs"), start, lambda a, p: F.struct((a["rows"] + p["w"]).alias("rows"), F.when(a["rows"] >= k, a["radius"]).otherwise(p["d"]).alias("radius")))
    return lists.groupBy("id").agg(pairs.alias("pairs")).select("id", F.when(kth["rows"] >= k, kth["radius"]).otherwise(F.lit(FAR)).alias("radius"))


def _within(spark: SparkSession, points: DataFrame, column: str) -> DataFrame:
    """id, n_column: the rows whose ``column`` lies nearer than the point's radius, or equals it where the radius is 0."""
    at, r = F.col(column), F.col("radius")
    zero = (r == 0).cast("int")
    # at equal values, ties of 0 are counted before and ties of 2 after the rows themselves, which have 1
    ends = F.array(F.struct((at + r).alias("at"), (2 * zero).alias("tie"), F.lit(1).alias("sign")), F.struct((at - r).alias("at"), (2 - 2 * zero).alias("tie"), F.lit(-1).alias("sign")))
    asked = points.select("id", F.explode(ends).alias("e")).select(F.col("e.at").alias("at"), F.col("e.tie").alias("tie"), "id", F.col("e.sign").alias("sign"), F.lit(0).cast("long").alias("n"))
    rows = points.groupBy(at.alias("at")).agg(F.sum("n").alias("n")).select("at", F.lit(1).alias("tie"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("sign"), "n")
    upto = running(spark, rows.unionByName(asked), [F.col("at"), F.col("tie"), F.col("id"), F.col("sign")], {"upto": F.col("n")})
    return upto.where("id is not null").groupBy("id").agg(F.sum(F.col("sign") * F.col("upto")).alias(f"n_{column}"))


def neighbour_information(df: DataFrame, x: str, y: str, k: int = 3, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """mutual_information in nats, one row."""
    spark = df.sparkSession
    both = [F.col(f"`{c}`").cast("double") for c in (x, y)]
    clean = df.select(both[0].alias("x"), both[1].alias("y")).where(is_finite(F.col("x")) & is_finite(F.col("y")))
    about = clean.agg(F.count("*").alias("n"), *(f(c).cast("float").cast("double").alias(a + c) for c in ("x", "y") for a, f in (("s", F.stddev_pop), ("min", F.min)))).first()
    if about.n < k + 2 or not about.sx or not about.sy:
        return spark.createDataFrame([(0.0,)], "mutual_information double")
    scaled = clean.select(*(F.round((F.col(c) - about[f"min{c}"]) / about[f"s{c}"] * UNIT).cast("long").alias(c) for c in ("x", "y")))
    points = written(scaled.groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), spark)
    found = written(points.join(radii(points, k, leaf_rows), "id"), spark)
    counts = found.join(_within(spark, found, "x"), "id").join(_within(spark, found, "y"), "id")
    m = F.when(F.col("radius") == 0, F.col("n")).otherwise(F.lit(k))
    term = F.col("n") * (digamma(m) - digamma(F.col("n_x")) - digamma(F.col("n_y")))
    total = F.lit(about.n).cast("long")
    return counts.agg(F.greatest(digamma(total) + F.sum(term) / total, F.lit(0.0)).alias("mutual_information"))
