"""Quality rules: fixed limits on counts, and a logistic regression over hashed n-grams.

Features are the presence of word 1- and 2-grams and character 3-grams (lower case in A-Z),
hashed to 2**18 buckets. Two heads learn ``quality`` and ``toxic`` from labelled rows with an L1
penalty (so most weights are exactly zero, and a long text gathers no noise from words that decide
nothing). A quarter of the training rows is held out to calibrate each head's score to a
probability. The model is fitted on labelled rows in the order of a hash of doc_id: at most
``train_rows`` of them, and as many as have ``train_grams`` distinct n-grams together. A row counts
with its whole text or not at all. Its size is bounded by the buckets, whatever the corpus holds. All
whole texts, however long, are scored in Arrow batches.

A document is kept if the counts pass, P(quality) is at least 0.5 and P(toxic) is below 0.3.
Null texts are empty: 0 words, so the counts fail. Repeated rows are judged one by one; several
labels for one doc_id count as their minimum quality and maximum toxicity, and several texts for one
doc_id are learnt from as the one with the smallest hash; null labels are ignored. Without labelled rows, or with one class only, a head gives 1 for quality and 0 for
toxicity, and the counts decide. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bytebpe import codepoints
from tidemark.llm.shared import map_texts, table, written
from tidemark.llm.words import Words, grams, mix, per_text, pieces

BITS = 18
BUCKETS = 1 << BITS
TRAIN_ROWS, TRAIN_GRAMS = 4000, 12_000_000
MIN_QUALITY, MAX_TOXIC = 0.5, 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(body: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    words = Words(body, at)
    char = (body & 0xC0) != 0x80
    inside = np.ones(len(body), bool)
    inside[np.isin(body, [0x20, 9, 10, 11, 12, 13])] = False
    # lines: spans between line feeds and the ends of texts
    feed = np.flatnonzero(body == 10)
    begin = np.unique(np.concatenate([at[:-1], feed + 1])).astype(np.int64)
    begin = begin[begin < len(body)]
    line_text = np.searchsorted(at, begin, "right") - 1
    stop = np.minimum(np.append(feed, len(body))[np.searchsorted(feed, begin)], at[line_text + 1])
    with_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop, line_text = begin[with_word], stop[with_word], line_text[with_word]
    seen = words.hash_spans(begin, stop)
    order = np.lexsort((seen, line_text))
    seen, owner = seen[order], line_text[order]
    again = (seen[1:] == seen[:-1]) & (owner[1:] == owner[:-1])
    n = len(at) - 1
    dup = np.bincount(owner[1:][again], minlength=n)
    # words in windows of three that are found twice or more in the text
    window = grams(words.hash, 3)
    own = np.flatnonzero(words.text[2:] == words.text[:-2]) if len(window) else np.zeros(0, np.int64)
    key = mix(window[own] ^ mix(words.text[own].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words.start), bool)
    for i in range(3):
        covered[own[twice] + i] = True
    return {
        "n_words": words.n,
        "word_chars": per_text(char & inside, at),
        "n_symbols": per_text(_SYMBOL[body], at),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(words.text[covered], minlength=n),
    }


def features(body: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The text and the bucket of each n-gram, repeats included, kind by kind."""
    words = Words(body, at, lower=True)
    shift = np.uint64(64 - BITS)
    yield words.text, (mix(words.hash + np.uint64(1)) >> shift).astype(np.int64)
    pair = grams(words.hash, 2)
    same = words.text[1:] == words.text[:-1] if len(pair) else np.zeros(0, bool)
    yield words.text[:-1][same], (pair[same] >> shift).astype(np.int64)
    chars, begin = codepoints(words.body, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(begin))
    code = chars.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if len(code) > 2:
        key = (code[:-2] ^ (code[:-2] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[1:-1]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + code[2:]
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        own = owner[2:] == owner[:-2]
        yield owner[:-2][own], (key[own] >> shift).astype(np.int64)


@dataclass
class Head:
    """Weights by bucket, a bias, and the line that turns scores into log odds."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -50, 50)))


def _constant(p: float) -> Head:
    return Head(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0, 50.0 if p else -50.0)


def fit_head(flat: np.ndarray, edge: np.ndarray, y: np.ndarray, default: float, penalty: float = 1e-3, rounds: int = 12, steps: int = 60, fresh: int = 1000) -> Head:
    """L1-penalised logistic regression, calibrated on every fourth row.

    ``flat`` holds the rows' buckets (int32), row i from ``edge[i]`` to ``edge[i + 1]``. Each round takes in
    the ``fresh`` buckets whose gradients exceed the penalty most, and fits all those that have a weight or were taken in by
    accelerated proximal steps, so a step passes over few buckets.
    """
    rows = len(y)
    if rows < 8 or y.min() == y.max():
        return _constant(default)
    held = np.arange(rows) % 4 == 3
    learn = ~held
    weight = np.where(y == 1, 0.5 / max(1, (y[learn] == 1).sum()), 0.5 / max(1, (y[learn] == 0).sum())) * learn
    size = np.diff(edge)
    rare = np.bincount(flat[np.repeat(learn, size)], minlength=BUCKETS) < 3
    names, w, b = np.zeros(0, np.int64), np.zeros(0), 0.0
    z = np.zeros(rows)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(z + b, -50, 50))) - y) * weight
        pull = np.abs(np.bincount(flat, np.repeat(error, size), BUCKETS))
        pull[rare] = 0
        pull[names] = 0
        new = np.argsort(-pull, kind="stable")[:fresh]
        new = new[pull[new] > penalty]
        if len(names) and not len(new):
            break
        names, w = np.concatenate([names, new]), np.concatenate([w, np.zeros(len(new))])
        place = np.full(BUCKETS, -1, np.int32)
        place[names] = np.arange(len(names), dtype=np.int32)
        mine = place[flat]
        use = mine >= 0
        kept = np.concatenate([[0], np.cumsum(use)])[edge]
        w, b = _proximal(mine[use], kept, y, weight, w, b, penalty, steps)
        z = _score(w, mine[use], kept)
        some = w != 0
        names, w = names[some], w[some]
    z = z + b
    return Head(names, w, b, *_calibrated(z[held], y[held]))


def _score(w: np.ndarray, flat: np.ndarray, edge: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(w[flat])])
    return total[edge[1:]] - total[edge[:-1]]


def _proximal(flat: np.ndarray, edge: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, b: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias after ``steps`` accelerated proximal steps."""
    size = np.diff(edge)
    step_w, step_b, t = w, b, 1.0
    rate = 4.0 / max(1.0, float((size * weight).sum()) / 12)
    for _ in range(steps):
        z = _score(step_w, flat, edge) + step_b
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        moved = step_w - rate * np.bincount(flat, np.repeat(error, size), len(w))
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        new_b = step_b - rate * error.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        step_w = new_w + (t - 1) / new_t * (new_w - w)
        step_b = new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds by Newton's method, with smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([z, np.ones(len(z))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -50, 50)))
        curve = (x * (p * (1 - p))) @ x.T + np.eye(2) * 1e-3
        step = np.linalg.solve(curve, x @ (p - goal) + 1e-3 * (at - [1.0, 0.0]))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 1e-3)), float(at[1])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_grams: int = TRAIN_GRAMS) -> tuple[Head, Head]:
    """The heads for quality and toxicity."""
    known = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body, at in pieces(batch.column(3)):
                n = len(at) - 1
                found = np.unique(np.concatenate([text * BUCKETS + bucket for text, bucket in features(body, at)]))
                starts = np.searchsorted(found, np.arange(n + 1) * BUCKETS).astype(np.int32)
                some = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.ListArray.from_arrays(pa.array(starts), pa.array((found % BUCKETS).astype(np.int32)))],
                    names=["doc_id", "quality", "toxic", "buckets"],
                )

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most train_rows ids
    chosen = texts.groupBy("doc_id", "quality", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = map_texts(chosen, run, f"doc_id {dict(chosen.dtypes)['doc_id']}, quality int, toxic int, buckets array<int>")
    rows = written(rows.select(F.xxhash64("doc_id").alias("place"), "*", F.size("buckets").alias("n")), spark)
    grams_of = rows.select("place", "doc_id", "n").orderBy("place", "doc_id").toArrow()  # at most train_rows
    upto = np.searchsorted(np.cumsum(grams_of.column("n").to_numpy()), train_grams, "right")
    if not upto:
        return _constant(1), _constant(0)
    last = grams_of.column("place")[int(upto) - 1].as_py()
    rows = rows.where((F.col("place") < last) | (F.col("place") == last) & (F.col("doc_id") <= grams_of.column("doc_id")[int(upto) - 1].as_py()))
    rows = rows.select("place", "doc_id", "quality", "toxic", "buckets").toArrow().sort_by([("place", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    buckets = rows.column("buckets").chunk(0)
    flat, edge = buckets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(buckets.value_lengths().to_numpy())])
    quality, toxic = (rows.column(c).to_numpy() for c in ("quality", "toxic"))
    return fit_head(flat, edge, quality, 1.0), fit_head(flat, edge, toxic, 0.0)


def judged(docs: DataFrame, heads: tuple[Head, Head], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, the counts, base_failed, p_quality, p_toxic and kept of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((BUCKETS, 2))
        for k, head in enumerate(heads):
            weights[head.buckets, k] = head.weights
        decides = weights.any(axis=1)
        for batch in batches:
            for row, body, at in pieces(batch.column(len(keep))):
                n = len(at) - 1
                count = counts(body, at)
                found = []
                for text, bucket in features(body, at):
                    hit = decides[bucket]
                    found.append(text[hit] * BUCKETS + bucket[hit])
                once = np.unique(np.concatenate(found))
                text, w = once // BUCKETS, weights[once % BUCKETS]
                p_quality, p_toxic = (head.probability(np.bincount(text, w[:, k], n) + head.bias) for k, head in enumerate(heads))
                failed = (count["n_words"] < MIN_WORDS) | (100 * count["n_repeat_words"] > MAX_REPEAT_PERCENT * count["n_words"])
                kept = ~failed & (p_quality >= MIN_QUALITY) & (p_toxic < MAX_TOXIC)
                values = [pa.array(count[c].astype(np.int64)) for c in COUNTS] + [pa.array(x) for x in (failed, p_quality, p_toxic, kept)]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, n).columns[: len(keep)], *values], names=[*keep, *COUNTS, "base_failed", "p_quality", "p_toxic", "kept"])

    own = docs.select(*keep, F.col("text").alias("whole_text"))
    more = [(c, T.LongType()) for c in COUNTS] + [("base_failed", T.BooleanType()), ("p_quality", T.DoubleType()), ("p_toxic", T.DoubleType()), ("kept", T.BooleanType())]
    return map_texts(own, run, T.StructType([*own.schema.fields[:-1], *(T.StructField(*x) for x in more)]))


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return judged(rows, fit(spark, docs, labels), ["row"]).where("kept").select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(spark, docs, table(spark, sf_dir, "labels")), ["doc_id"])
