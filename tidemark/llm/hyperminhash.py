"""Near-duplicate documents by HyperMinHash.

A document's set holds the 64-bit hashes of its distinct word 5-shingles (words lower-cased in
A-Z). Its sketch has 256 buckets, chosen by the top 8 bits of a shingle's hash; a register packs
the count of leading zeros of the bucket's least remaining hash (6 bits) with the 10 bits that
follow its leading one, so 16 bits stand for a minimum of 56. Buckets that no shingle falls into
borrow the register of the first filled bucket in an order of their own (with its place mixed in),
so that the empty buckets of a small set draw from its shingles independently.

1. *Classes*: documents with equal sets are one class, named by the smallest doc_id.
2. *Banding*: 51 bands of 5 registers. Two sets of Jaccard similarity s share a band with
   probability 1 - (1 - s**5)**51, all but about one in a million at s = 0.75, if registers agree
   independently; the few filled buckets of small sets make that approximate (README). Classes that
   share a band are candidates; a star to the smallest class of the bucket keeps the candidate
   graph connected, so its components hold every candidate pair.
3. *Estimate, then verify*: inside each candidate component of at most ``most`` classes, pairs are estimated from the
   registers, corrected for registers that agree by chance; those within five standard errors of
   the threshold or above are verified on the full sets. Components of more than ``block``
   classes are cut into blocks and every pair of blocks is a group of its own, so that no task
   holds an unbounded group. Each group returns a spanning forest of its links, never all pairs.
   In larger components, which weak candidates chain together as a corpus grows, only classes that share a
   band meet: each with the smallest of the band's, in salted groups, and where the links so far leave a
   band's other classes in several components, those outside the largest with all others, in blocks of both.
4. Components of the verified links give the result.

A text of any length is taken whole: its set is 8 bytes for each distinct shingle. Null texts and texts
without words have an empty set and are linked with nothing. Rows that share a
doc_id are one document with the links of all their texts, and stay separate rows of the result.
Rows without a doc_id get the component of equal sets, link nothing, and are kept. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import map_texts, table, written
from tidemark.llm.words import Words, grams, mix, pieces

SHINGLE = 5
BUCKETS, ROWS = 256, 5
BANDS = BUCKETS // ROWS
MANTISSA = 10
BLOCK = 128
MOST = 4096  # classes of a component of which all pairs are looked at


def shingle_sets(body: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its word sequence as one."""
    words = Words(body, at, lower=True)
    hashes = words.hash
    whole = grams(hashes, width)
    out = []
    for first, n in zip(words.first[:-1].tolist(), words.n.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(whole[first : first + n - width + 1]))
        else:
            out.append(grams(hashes[first : first + n], n) if n else np.zeros(0, np.uint64))
    return out


# each bucket's order of the others, as ranks; a fixed function, so that all sets borrow alike
_RANK = mix(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64)).reshape(BUCKETS, BUCKETS).argsort(axis=1).argsort(axis=1).astype(np.uint8)


def registers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 256 registers of a sorted non-empty set, filled up, and which of them were filled by the set."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    head = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = hashes[head] & np.uint64((1 << 56) - 1)
    # frexp of a 56-bit number: the exponent gives the leading zeros, the next bits the mantissa
    top = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    shift = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> shift) & np.uint64((1 << MANTISSA) - 1)
    value = (((56 - top).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa) + np.uint64(1)
    own = np.zeros(BUCKETS, np.uint64)
    own[bucket[head]] = value
    filled = own > 0
    where = np.flatnonzero(filled)
    none = np.flatnonzero(~filled)
    full = own.copy()
    if len(none):
        source = where[_RANK[none][:, where].argmin(axis=1)]
        full[none] = own[source] + (source + 1).astype(np.uint64) * np.uint64(1 << 17)
    return full, filled


_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_keys(full: np.ndarray) -> np.ndarray:
    """One key per band, of registers that lie 51 apart."""
    key = _BAND.copy()
    for rows in full[: BANDS * ROWS].reshape(ROWS, BANDS):
        key = mix((key ^ rows) * np.uint64(0x9FB21C651E98DF25))
    return key


def similarity_estimate(a: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The Jaccard similarity by registers of one set with others, less registers that agree by chance.

    Minima over different shingles agree in zeros and mantissa with a probability of about
    (1/3) * 2**-MANTISSA, the sum of squared probabilities of a register's values.
    """
    chance = 2.0**-MANTISSA / 3
    return np.maximum((others == a).mean(axis=1) - chance, 0) / (1 - chance)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, tid (a hash of the text), n_shingles, fp1, fp2 (a 128-bit name of the set; null if empty), keys (the band keys)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body, at in pieces(batch.column(2)):
                sets = shingle_sets(body, at)
                n = np.array([len(s) for s in sets], np.int64)
                some = n > 0
                fp = np.array([((s ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) for s in sets], np.uint64)
                fp2 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                keys = [band_keys(registers(s)[0]) for s in sets if len(s)]
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                starts = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(row, len(sets)).columns[:2],
                        pa.array(n),
                        pa.array(fp.view(np.int64), mask=~some),
                        pa.array(fp2.view(np.int64), mask=~some),
                        pa.ListArray.from_arrays(pa.array(starts), pa.array(flat)),
                    ],
                    names=["doc_id", "tid", "n_shingles", "fp1", "fp2", "keys"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return map_texts(docs.select("doc_id", F.xxhash64("text").alias("tid"), "text"), run, f"doc_id {kind}, tid long, n_shingles long, fp1 long, fp2 long, keys array<long>")


def links(sets: list[np.ndarray], percent: int = 75, label: np.ndarray | None = None, expand: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph of all pairs with 100 * intersection >= percent * union.

    Sets are expanded (compared with all sets outside their own component) until only members of
    the largest component are left, so every pair of different components has been compared: by
    size, then by estimate, then on the full sets. Pairs inside one component need no look. Sets may
    come with components (``label``, numbers below their count), and then only those in ``expand`` are expanded.
    """
    count, s = len(sets), percent / 100
    sizes = np.array([len(x) for x in sets], np.int64)
    sketch = [registers(x) for x in sets]
    full = np.stack([x for x, _ in sketch])
    # registers that were borrowed repeat others, so only half of the filled ones count as samples
    error = np.sqrt(s * (1 - s) / np.maximum(np.array([x.sum() for _, x in sketch]) / 2, 1))
    # one number per distinct shingle, so that one set meets all others in a single pass over their numbers
    edge = np.concatenate([[0], np.cumsum(sizes)])
    names, number = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(names), bool)
    label = np.arange(count) if label is None else label.copy()
    done, out = np.zeros(count, bool) if expand is None else ~expand, []
    while True:
        size = np.bincount(label, minlength=count)
        rest = np.flatnonzero(~done & (label != size.argmax())) if expand is None else np.flatnonzero(~done)
        if not len(rest):
            return out
        i = int(rest[0])
        done[i] = True
        at = np.flatnonzero((label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        at = at[similarity_estimate(full[i], full[at]) >= s - 5 * np.maximum(error[at], error[i])]
        if not len(at):
            continue
        mine[number[edge[i] : edge[i + 1]]] = True
        upto = np.concatenate([[0], np.cumsum(mine[number])])
        mine[:] = False
        common = upto[edge[at + 1]] - upto[edge[at]]
        for j in at[100 * common >= percent * (sizes[at] + sizes[i] - common)].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]


def _grouped_links(batches: Iterable[pa.RecordBatch], percent: int, keys: int = 3) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with one group key; rows arrive sorted by the key.

    Columns: ``keys`` columns of the key, id, text, and for sets that come with components label and expand.
    """
    key, ids, sets, labels, expand = None, [], [], [], []

    def flush() -> list[tuple]:
        if len(sets) < 2:
            return []
        if not labels:
            return [(ids[a], ids[b]) for a, b in links(sets, percent)]
        return [(ids[a], ids[b]) for a, b in links(sets, percent, np.unique(labels, return_inverse=True)[1], np.array(expand))]

    for batch in batches:
        found: list[tuple] = []
        group = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        names = batch.column(keys).to_pylist()
        known = [batch.column(i).to_pylist() for i in range(keys + 2, batch.num_columns)]
        for row, body, at in pieces(batch.column(keys + 1)):
            for i, hashes in enumerate(shingle_sets(body, at), row):
                if group[i] != key:
                    found += flush()
                    key, ids, sets, labels, expand = group[i], [], [], [], []
                if len(hashes):
                    ids.append(names[i])
                    sets.append(hashes)
                    if known:
                        labels.append(known[0][i])
                        expand.append(known[1][i])
        kind = batch.schema.field(keys).type
        yield _edges(found, kind)
    if key is not None:
        yield _edges(flush(), kind)


def _star_links(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the first row of each run (low, salt) with the others; columns low, salt, order, id, text."""
    key, centre = None, None
    for batch in batches:
        found = []
        runs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        names = batch.column(3).to_pylist()
        for row, body, at in pieces(batch.column(4)):
            for i, hashes in enumerate(shingle_sets(body, at), row):
                if runs[i] != key:
                    key, centre = runs[i], hashes
                elif len(hashes):
                    common = int(np.isin(hashes, centre, assume_unique=True).sum())
                    if 100 * common >= percent * (len(hashes) + len(centre) - common):
                        found.append((key[0], names[i]))
        yield _edges(found, batch.schema.field(3).type)


def _edges(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in (0, 1)], names=["a", "b"])


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept; one row per row of ``docs``."""
    return _judged(spark, docs, percent, block, most).select("doc_id", "n_shingles", "component_id", "kept")


def _small(own: DataFrame, loose: DataFrame, percent: int, block: int, most: int) -> DataFrame:
    """Links (a, b) among all pairs of each component of ``loose`` (node, component, count)."""
    # blocks grow with the component: at most 8 to a side
    wide = F.greatest(F.lit(block), F.least(F.lit(max(block, most)), F.ceil(F.col("count") / 8)))
    member = loose.withColumn("blocks", F.ceil(F.col("count") / wide).cast("int")).select(
        F.col("node").alias("doc_id"), "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")
    )
    # always a sort-merge join: the members grow with the corpus, and a broadcast of few would only hide that
    pairs = own.join(member.hint("merge"), "doc_id").select(
        "component",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda other: F.struct(F.least(other, F.col("mine")).alias("i"), F.greatest(other, F.col("mine")).alias("j")),
            )
        ).alias("pair"),
        "doc_id",
        "text",
    )
    grouped = pairs.select("component", "pair.i", "pair.j", "doc_id", "text").repartition("component", "i", "j")
    kind = dict(own.dtypes)["doc_id"]
    return map_texts(grouped.sortWithinPartitions("component", "i", "j"), lambda batches: _grouped_links(batches, percent), f"a {kind}, b {kind}")


def _large(spark: SparkSession, own: DataFrame, bands: DataFrame, percent: int, most: int) -> DataFrame:
    """Links (a, b) among classes that share a band (``bands``: rep, key)."""
    kind = dict(own.dtypes)["doc_id"]
    low = bands.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    others = written(bands.join(low, "key").where("rep <> low"), spark)
    star = others.select("rep", "low").distinct()
    salts = written(star.groupBy("low").agg(F.ceil(F.count("*") / most).cast("int").alias("salts")), spark)
    spokes = star.join(salts, "low").select("low", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("place"), F.col("rep").alias("doc_id"))
    centres = salts.select("low", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("place"), F.col("low").alias("doc_id"))
    rows = own.join(spokes.unionByName(centres).hint("merge"), "doc_id").select("low", "salt", "place", "doc_id", "text")
    met = rows.repartition("low", "salt").sortWithinPartitions("low", "salt", "place")
    first = written(map_texts(met, lambda batches: _star_links(batches, percent), f"a {kind}, b {kind}"), spark)
    # bands whose other classes are still in several components: each kind of them once
    named = others.join(components(first, spark), F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
    named = written(named, spark)
    sizes = written(named.groupBy("key", "label").agg(F.count("*").alias("n")), spark)
    open_ = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    names = named.groupBy("key").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    open_ = open_.join(names, "key").groupBy("x", "y", "n").agg(F.min(F.struct("key", "main")).alias("one")).select("one.key", F.col("one.main.label").alias("main"), F.col("one.main.n").alias("in_main"), "n")
    blocks, strays = F.ceil(F.col("n") / most).cast("int"), F.ceil((F.col("n") - F.col("in_main")) / most).cast("int")
    open_ = written(open_.select("key", "main", blocks.alias("blocks"), strays.alias("parts")), spark)
    member = named.join(open_, "key")

    def dealt(rows: DataFrame, mine: str, other: str, expand: bool) -> DataFrame:
        own_part = F.pmod(F.xxhash64("rep"), F.col(mine)).cast("int")
        return rows.select("key", own_part.alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), F.col("rep").alias("doc_id"), "label", F.lit(expand).alias("expand"))

    both = dealt(member, "blocks", "parts", False).unionByName(dealt(member.where("label <> main"), "parts", "blocks", True))
    rows = own.join(both.hint("merge"), "doc_id").select("key", "blocks", "parts", "doc_id", "text", "label", "expand")
    met = rows.repartition("key", "blocks", "parts").sortWithinPartitions("key", "blocks", "parts")
    second = map_texts(met, lambda batches: _grouped_links(batches, percent), f"a {kind}, b {kind}")
    return first.unionByName(second)


def _judged(spark: SparkSession, docs: DataFrame, percent: int, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """``near_duplicates`` with tid (a hash of the text), fp1 and fp2."""
    own = docs.select(F.col("doc_id"), F.col("text"))
    sketched = written(sketches(own), spark)
    classes = written(
        sketched.where(F.col("fp1").isNotNull())
        .groupBy("fp1", "fp2", "n_shingles")
        .agg(F.min_by("keys", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("keys"), F.min("doc_id").alias("rep"))
        .where(F.col("rep").isNotNull()),
        spark,
    )
    bands = classes.select("rep", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key", "low")
    candidates = bands.join(shared, "key").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")).distinct()
    loose = components(candidates, spark)
    sizes = loose.groupBy("component").count()
    loose = written(loose.join(sizes, "component"), spark)
    found = _small(own, loose.where(F.col("count") <= most), percent, block, most)
    large = loose.where(F.col("count") > most)
    if not large.isEmpty():
        found = found.unionByName(_large(spark, own, bands.join(large.select(F.col("node").alias("rep")), "rep", "left_semi"), percent, most))
    linked = components(found.where("a <> b").distinct(), spark)
    named = classes.join(linked, F.col("rep") == F.col("node"), "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component_id"))
    slim = sketched.select("doc_id", "tid", "n_shingles", "fp1", "fp2")
    return slim.join(named, ["fp1", "fp2"], "left").select(
        "doc_id",
        "tid",
        "fp1",
        "fp2",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def representatives(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component; one row of those that share a doc_id and a set.

    Of a doc_id with several texts, each text is judged by itself. Rows without words or without
    doc_id are linked with nothing and stay.
    """
    linkable = written(_judged(spark, docs, percent).where("doc_id is not null and fp1 is not null"), spark)
    same = linkable.groupBy("doc_id", "fp1", "fp2").agg(F.min("tid").alias("first"), F.count("*").alias("n"), F.first("kept").alias("kept"))
    texts = linkable.select("doc_id", "fp1", "fp2", "tid").distinct()
    # what leaves its place: rows of other components' documents, and rows that share doc_id and set with another
    moved = texts.join(same.where("not kept or n > 1"), ["doc_id", "fp1", "fp2"]).select(F.col("doc_id").alias("id"), "tid")
    back = same.where("kept and n > 1").select(F.col("doc_id").alias("id"), F.col("first").alias("tid"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tid"))
    stay = rows.join(moved, ["id", "tid"], "left_anti").select("row")
    once = rows.join(back, ["id", "tid"]).groupBy("id", "tid").agg(F.first("row").alias("row")).select("row")
    return stay.unionByName(once).select("row.*")


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
rep AS (SELECT list_sort(sh) AS shs, min(doc_id) AS rep, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
g AS (SELECT rep, n, unnest(shs) AS x FROM rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM g a JOIN g b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep),
e AS (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
r AS (SELECT rep AS node, rep AS seen FROM rep UNION SELECT e.a, r.seen FROM r JOIN e ON e.b = r.node),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id,
       coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN rep ON rep.shs = list_sort(s.sh) AND len(s.sh) > 0 LEFT JOIN c ON c.node = rep.rep
"""
