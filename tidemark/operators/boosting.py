"""Boosted ensembles that grow chunk by chunk from histograms, and score in Arrow batches.

A tree is symmetric: each of its levels asks one question (feature, threshold) of all rows, so a tree of depth d is d
questions and 2**d leaf values, and an ensemble is three flat arrays. Scoring goes through batches of rows with NumPy, tree by tree.
The arrays are broadcast in groups of at most ``GROUP_BYTES``; an ensemble of several groups is scored group by group with
the sums so far written in between, so that no worker holds more than one group.

Growing: a chunk's features are binned once, by quantiles over all its rows, and kept as blocks of rows (a byte for each feature) with
their weights and residuals in the shared folder. Each level of a tree is one aggregate over the blocks: sums of gradients and of weights
by (leaf, feature, bin), added up as integers, which makes them independent of the order and of how rows are dealt. The question with
the largest gain is asked (ties: the first feature, then the smaller bin). Trees of a few rounds are applied to a
block's residuals on the fly, then the residuals are written anew, so no row is ever scored again by trees that it has seen.

The driver holds sums by (leaf, feature, bin), quantiles and the ensemble: nothing that grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import is_finite
from tidemark.sources import sinks
from tidemark.sources.scratch import written

BINS = 64
BLOCK_ROWS = 1 << 16
ROUNDS = 25  # trees until residuals are written anew, fewer for large learning rates
GROUP_BYTES = 64 << 20


@dataclass
class Trees:
    """Symmetric trees: the feature and the threshold of each level, the value of each leaf, and what each level gained.

    A row's leaf has the bit 2**level where the feature is above the threshold (or null or NaN). A level that asks nothing has an infinite
    threshold, and gains 0.
    """

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    gain: np.ndarray

    @classmethod
    def none(cls, depth: int) -> Trees:
        return cls(np.zeros((0, depth), np.int32), np.zeros((0, depth)), np.zeros((0, 1 << depth)), np.zeros((0, depth)))

    def __len__(self) -> int:
        return len(self.feature)

    @property
    def nbytes(self) -> int:
        return self.feature.nbytes + self.threshold.nbytes + self.leaf.nbytes

    def slice(self, begin: int, end: int) -> Trees:
        return Trees(*(x[begin:end] for x in (self.feature, self.threshold, self.leaf, self.gain)))

    def plus(self, other: Trees) -> Trees:
        return Trees(*(np.concatenate([a, b]) for a, b in zip((self.feature, self.threshold, self.leaf, self.gain), (other.feature, other.threshold, other.leaf, other.gain), strict=True)))

    def groups(self, most: int | None = None) -> list[Trees]:
        """Runs of trees of at most ``most`` bytes."""
        if not len(self):
            return []
        each = max(1, (most or GROUP_BYTES) // (self.nbytes // len(self)))
        return [self.slice(i, i + each) for i in range(0, len(self), each)]

    def score(self, columns: np.ndarray) -> np.ndarray:
        """The sum of the trees' values for rows given by feature (features x rows); NaN counts as above."""
        columns = np.where(np.isnan(columns), np.inf, columns)
        out = np.zeros(columns.shape[1])
        for feature, threshold, leaf in zip(self.feature.tolist(), self.threshold.tolist(), self.leaf, strict=True):
            place = np.zeros(columns.shape[1], np.int32)
            for level, (f, t) in enumerate(zip(feature, threshold, strict=True)):
                place |= (columns[f] > t).view(np.uint8).astype(np.int32) << level
            out += leaf[place]
        return out

    def rows(self) -> pa.Table:
        columns = {"tree": pa.array(np.arange(len(self)), pa.int64())}
        for name, kind in (("feature", pa.int32()), ("threshold", pa.float64()), ("leaf", pa.float64()), ("gain", pa.float64())):
            columns[name] = pa.array(list(getattr(self, name)), pa.list_(kind))
        return pa.table(columns)

    @classmethod
    def of(cls, rows: pa.Table, depth: int) -> Trees:
        rows = rows.sort_by("tree")
        shape = {"feature": (np.int32, depth), "threshold": (np.float64, depth), "leaf": (np.float64, 1 << depth), "gain": (np.float64, depth)}
        return cls(*(np.array(rows.column(name).to_pylist(), kind).reshape(len(rows), width) for name, (kind, width) in shape.items()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Features x rows of a column of arrays; nulls become NaN."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width).T)


def add_scores(df: DataFrame, names: list[str], trees: Trees, keep: list[str], score: str, start: float = 0.0, group_bytes: int | None = None) -> DataFrame:
    """``keep`` of ``df`` and ``score``: ``start`` and the trees' values of the features ``names``."""
    spark, width = df.sparkSession, len(names)
    groups = trees.groups(group_bytes)
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.lit(float(start)).alias(score), F.array(*(F.col(f"`{n}`").cast("double") for n in names)).alias("features"))
    if not groups:
        return rows.drop("features")
    kept = len(keep)
    rows = rows.toDF(*(f"c{i}" for i in range(kept + 2)))  # Arrow functions take plain names only
    for i, group in enumerate(groups):
        held, width_out = spark.sparkContext.broadcast((group.feature, group.threshold, group.leaf)), kept + 1 + (i < len(groups) - 1)  # at most GROUP_BYTES

        def run(batches: Iterable[pa.RecordBatch], held=held, width_out=width_out) -> Iterator[pa.RecordBatch]:
            own = Trees(*held.value, np.zeros(0))
            for batch in batches:
                total = pa.array(batch.column(kept).to_numpy() + own.score(_matrix(batch.column(kept + 1), width)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], total, *batch.columns[kept + 1 : width_out]], names=batch.schema.names[:width_out])

        rows = rows.mapInArrow(run, T.StructType(rows.schema.fields[:width_out]))
        if width_out > kept + 1:
            rows = written(rows, spark)
    return rows.toDF(*keep, score)


@dataclass
class Chunk:
    """A chunk's rows in blocks (n, bins, weight, residual), and what bounds them."""

    blocks: DataFrame
    rows: int
    edges: list[np.ndarray]
    residual: float  # the largest absolute value
    weight: float


def _block(columns: np.ndarray, edges: list[np.ndarray], weight: np.ndarray, residual: np.ndarray) -> list:
    bins = np.stack([np.searchsorted(e, x, "left").astype(np.uint8) for e, x in zip(edges, columns, strict=True)])
    return [len(weight), bins.tobytes(), weight.astype(np.float64).tobytes(), residual.astype(np.float64).tobytes(), float(np.abs(residual).max()), float(weight.max())]


_BLOCK = "n long, bins binary, weight binary, residual binary, most_residual double, most_weight double"


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _BLOCK.split(", ")])


def _arrays(batch: pa.RecordBatch, i: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.column(0)[i].as_py()
    bins, weight, residual = (batch.column(k)[i].as_buffer() for k in (1, 2, 3))
    return np.frombuffer(bins, np.uint8).reshape(width, n), np.frombuffer(weight, np.float64), np.frombuffer(residual, np.float64)


def _place(bins: np.ndarray, levels: list[tuple[int, int]]) -> np.ndarray:
    """The leaf of each row after some questions (feature, cut); a negative feature asks nothing."""
    place = np.zeros(bins.shape[1], np.int64)
    for level, (f, cut) in enumerate(levels):
        if f >= 0:
            place |= (bins[f] > cut).view(np.uint8).astype(np.int64) << level
    return place


def _left(bins: np.ndarray, residual: np.ndarray, fresh: list[tuple[list[tuple[int, int]], np.ndarray]]) -> np.ndarray:
    """What the ``fresh`` trees (questions, leaf values) leave of the residuals."""
    for levels, leaf in fresh:
        residual = residual - leaf[_place(bins, levels)]
    return residual


def _cached(chunk_blocks: DataFrame, rows: int, edges: list[np.ndarray], spark: SparkSession) -> Chunk:
    held = written(chunk_blocks, spark)
    if rows <= BLOCK_ROWS:  # one block, whose sums need no exchange
        held = held.coalesce(1)
    held = held.persist()
    most = held.agg(F.max("most_residual").alias("r"), F.max("most_weight").alias("w")).first()
    return Chunk(held, rows, edges, most.r or 0.0, most.w or 0.0)


def prepared(df: DataFrame, names: list[str], label: str, weight: str, trees: Trees, start: float | None, bins: int = BINS) -> tuple[Chunk, float] | None:
    """The rows of ``df`` as a chunk, with what ``start`` (None: their mean label) and ``trees`` leave of the labels as residuals; None without rows.

    Rows without a finite label and a finite weight of at least 0 are left out.
    """
    spark, width = df.sparkSession, len(names)
    columns = [F.col(f"`{n}`").cast("double").alias(n) for n in names]
    keep = df.select(*columns, F.col(label).cast("double").alias("_label"), F.col(weight).cast("double").alias("_weight")).where(is_finite(F.col("_label")) & is_finite(F.col("_weight")) & (F.col("_weight") >= 0))
    # at most bins - 1 thresholds of each feature, by quantiles of all rows
    shares = [i / bins for i in range(1, bins)]
    edges = [F.percentile_approx(F.when(~F.isnan(F.col(f"`{n}`")), F.col(f"`{n}`")), shares, 10_000).alias(f"q{i}") for i, n in enumerate(names)]
    mean = F.sum(F.col("_weight") * F.col("_label")) / F.nullif(F.sum("_weight"), F.lit(0.0))
    rows, first, *found = keep.agg(F.count("*"), mean, *edges).first()
    if not rows:
        return None
    start = (first or 0.0) if start is None else start
    edges = [np.unique(np.array(q or [], np.float64)) for q in found]
    tasks = max(min(-(-rows // BLOCK_ROWS), 4 * spark.sparkContext.defaultParallelism), -(-rows // (16 * BLOCK_ROWS)))
    scored = add_scores(keep, names, trees, [*names, "_label", "_weight"], "_score", start)
    flat = scored.select(F.array(*(F.col(f"`{n}`") for n in names)).alias("x"), "_weight", (F.col("_label") - F.col("_score")).alias("r")).repartition(tasks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            x, w, r = (pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in range(3))
            return _batch([_block(_matrix(x, width), edges, w.to_numpy(), r.to_numpy())])

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield block()
                held = []
        if held:
            yield block()

    return _cached(flat.mapInArrow(run, _BLOCK), rows, edges, spark), start


def rewritten(chunk: Chunk, fresh: list[tuple[list[tuple[int, int]], np.ndarray]]) -> Chunk:
    """The chunk with the fresh trees taken off its residuals."""
    width = len(chunk.edges)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                bins, weight, residual = _arrays(batch, i, width)
                left = _left(bins, residual, fresh)
                yield _batch([[len(weight), batch.column(1)[i].as_py(), weight.tobytes(), left.tobytes(), float(np.abs(left).max()), float(weight.max())]])

    new = _cached(chunk.blocks.mapInArrow(run, _BLOCK), chunk.rows, chunk.edges, chunk.blocks.sparkSession)
    chunk.blocks.unpersist()
    return new


def _scale(rows: int, most: float) -> float:
    """A power of two by which sums over ``rows`` values of at most ``most`` become integers of less than 62 bits."""
    return 2.0 ** math.floor(61 - math.log2(max(1, rows)) - math.log2(most)) if most > 0 else 1.0


def histogram(chunk: Chunk, fresh: list[tuple[list[tuple[int, int]], np.ndarray]], levels: list[tuple[int, int]], growth: float, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weight times residual, and of weight, by leaf x feature x bin, of what ``fresh`` trees leave and ``levels`` have asked."""
    width, leaves = len(chunk.edges), 1 << len(levels)
    up, up_w = _scale(chunk.rows, chunk.residual * chunk.weight * growth), _scale(chunk.rows, chunk.weight)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, leaves, width, bins), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                own, weight, residual = _arrays(batch, i, width)
                pull = weight * _left(own, residual, fresh)
                place = _place(own, levels) * bins
                for f in range(width):
                    at = place + own[f]
                    total[0, :, f] += np.rint(np.bincount(at, pull, leaves * bins) * up).astype(np.int64).reshape(leaves, bins)
                    total[1, :, f] += np.rint(np.bincount(at, weight, leaves * bins) * up_w).astype(np.int64).reshape(leaves, bins)
        flat = total.reshape(2, leaves * width, bins)
        some = np.flatnonzero(flat.any(axis=(0, 2)))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bins), pa.array(flat[k, some].ravel())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(some), *lists], names=["cell", "g", "w"])

    added = [F.expr(f"aggregate(collect_list({c}), array_repeat(0L, {bins}), (a, x) -> zip_with(a, x, (p, q) -> p + q)) as {c}") for c in ("g", "w")]
    sums = chunk.blocks.mapInArrow(run, "cell long, g array<long>, w array<long>").groupBy("cell").agg(*added).toArrow()
    out = np.zeros((2, leaves * width, bins))
    cell = sums.column("cell").to_numpy()
    for k, (name, unit) in enumerate((("g", up), ("w", up_w))):
        out[k, cell] = np.array(sums.column(name).to_pylist(), np.int64).reshape(len(cell), bins) / unit
    return tuple(out.reshape(2, leaves, width, bins))


def question(g: np.ndarray, w: np.ndarray, l2: float) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """feature, cut, gain of the best question over histograms (leaf x feature x bin), and the sums of the leaves that it makes."""
    gl, wl = g.cumsum(axis=2), w.cumsum(axis=2)
    gt, wt = gl[:, :, -1:], wl[:, :, -1:]
    gr, wr = gt - gl, wt - wl

    def value(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b > 0, a * a / np.where(b + l2 > 0, b + l2, 1.0), 0.0)

    gains = (value(gl, wl) + value(gr, wr) - value(gt, wt)).sum(axis=0)[:, :-1]
    best = int(gains.argmax())
    f, cut = divmod(best, gains.shape[1])
    return f, cut, float(gains[f, cut]), np.concatenate([gl[:, f, cut], gr[:, f, cut]]), np.concatenate([wl[:, f, cut], wr[:, f, cut]])


class HistogramBooster:
    """Boosted symmetric trees over named columns with squared loss: ``trees_per_call`` from each chunk.

    A call beyond ``max_trees``, if given, raises ValueError. Scores are 0 before the first fit.
    """

    def __init__(self, names: list[str], trees_per_call: int = 300, max_depth: int = 5, learning_rate: float = 0.01, max_trees: int | None = None, l2: float = 0.0, bins: int = BINS):
        if not 2 <= bins <= 256 or not 1 <= max_depth <= 12 or not 0 < learning_rate <= 1:
            raise ValueError("bins are 2 to 256, max_depth 1 to 12, learning_rate above 0 to 1")
        self.names, self.trees_per_call, self.max_depth = list(names), trees_per_call, max_depth
        self.learning_rate, self.max_trees, self.l2, self.bins = learning_rate, max_trees, l2, bins
        self.trees, self.start = Trees.none(max_depth), 0.0
        self.epoch = -1  # the last micro-batch trained on, of a stream

    def partial_fit(self, df: DataFrame, label: str = "label", weight: str = "weight") -> bool:
        """Adds trees grown on all rows of ``df`` (the named columns, label and weight), and says whether there were any."""
        if self.max_trees is not None and len(self.trees) + self.trees_per_call > self.max_trees:
            raise ValueError(f"{len(self.trees)} trees and {self.trees_per_call} more exceed max_trees = {self.max_trees}")
        # the first chunk's mean is a first guess, as trees shrink what they add
        made_of = prepared(df, self.names, label, weight, self.trees, self.start if len(self.trees) else None, self.bins)
        if made_of is None:
            return False
        chunk, self.start = made_of
        every = max(1, min(ROUNDS, int(math.log(16) / math.log1p(self.learning_rate))))
        growth = (1 + self.learning_rate) ** every
        made = Trees.none(self.max_depth)
        fresh: list[tuple[list[tuple[int, int]], np.ndarray]] = []
        try:
            for i in range(self.trees_per_call):
                if len(fresh) == every:
                    chunk, fresh = rewritten(chunk, fresh), []
                levels, tree = self._tree(chunk, fresh, growth)
                fresh.append((levels, tree.leaf[0]))
                made = made.plus(tree)
        finally:
            chunk.blocks.unpersist()
        self.trees = self.trees.plus(made)
        return True

    def _tree(self, chunk: Chunk, fresh: list, growth: float) -> tuple[list[tuple[int, int]], Trees]:
        depth = self.max_depth
        levels: list[tuple[int, int]] = []
        tree = Trees(np.zeros((1, depth), np.int32), np.full((1, depth), np.inf), np.zeros((1, 1 << depth)), np.zeros((1, depth)))
        g = w = np.zeros(1)
        for level in range(depth):
            sums = histogram(chunk, fresh, levels, growth, self.bins)
            if not level:
                g, w = sums[0][:, 0].sum(axis=1), sums[1][:, 0].sum(axis=1)
            f, cut, gain, g_next, w_next = question(*sums, self.l2)
            if gain <= 0:
                break
            levels.append((f, cut))
            g, w = g_next, w_next
            tree.feature[0, level], tree.threshold[0, level], tree.gain[0, level] = f, chunk.edges[f][cut], gain
        value = np.where(w > 0, self.learning_rate * g / np.where(w + self.l2 > 0, w + self.l2, 1.0), 0.0)
        tree.leaf[0, : len(value)] = value
        return levels, tree

    def predict(self, df: DataFrame, keep: list[str] | None = None, group_bytes: int | None = None) -> DataFrame:
        """``df``, or its columns ``keep``, with score."""
        return add_scores(df, self.names, self.trees, df.columns if keep is None else keep, "score", self.start, group_bytes)

    def importances(self, spark: SparkSession) -> DataFrame:
        """feature_name, importance (its share of what all questions gained), the most important first."""
        gains = np.bincount(self.trees.feature.ravel(), self.trees.gain.ravel(), len(self.names)) if len(self.trees) else np.zeros(len(self.names))
        share = gains / gains.sum() if gains.sum() > 0 else gains
        return spark.createDataFrame([(n, float(x)) for n, x in zip(self.names, share, strict=True)], "feature_name string, importance double").orderBy(F.desc("importance"), "feature_name")

    def _settings(self) -> dict:
        return {"names": self.names, "trees_per_call": self.trees_per_call, "max_depth": self.max_depth, "learning_rate": self.learning_rate, "max_trees": self.max_trees, "l2": self.l2, "bins": self.bins}

    def save(self, spark: SparkSession, path: str, since: int = 0) -> None:
        """The trees from number ``since`` on, as a table, and settings; the settings are written last."""
        spark.createDataFrame(self.trees.slice(since, len(self.trees)).rows(), "tree long, feature array<int>, threshold array<double>, leaf array<double>, gain array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        sinks.write_json(spark, {"settings": self._settings(), "start": self.start, "since": since, "trees": len(self.trees), "epoch": self.epoch}, f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, *paths: str) -> HistogramBooster:
        """The model saved in ``paths``: whole, or in the parts that its growth has left, in order."""
        abouts = [sinks.read_json(spark, f"{path}/metadata") for path in paths]
        model = cls(**abouts[-1]["settings"])
        for about, path in zip(abouts, paths, strict=True):
            if about["since"] != len(model.trees):
                raise ValueError(f"{path} goes on from tree {about['since']}, not from {len(model.trees)}")
            model.trees = model.trees.plus(Trees.of(spark.read.parquet(f"{path}/trees").toArrow(), model.max_depth))
        model.start, model.epoch = abouts[-1]["start"], abouts[-1].get("epoch", -1)
        return model
