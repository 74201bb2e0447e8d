"""Language-model scores by a weighted backoff automaton.

Tokens are the words of the text, lower-cased in A-Z, and one end token. The model is learnt from
the training documents: crc32(doc_id as text) mod 5 is not 1. It holds every n-gram of 1 to 3 tokens
that they have, with its count c, whatever its share: it grows with the corpus.

    p(w)      = (c(w) + 0.5) / (N + 0.5 * (V + 1))
    p(w | h)  = t(h) * c(h w) / c(h) + (1 - t(h)) * p(w | h less its first token)
    t(h)      = (c(h) - 1) / (c(h) - 1 + DOUBT)

A context h is trusted the more the more often it was seen, and not at all if it was seen once; so
the probabilities of each context sum to 1. As an automaton: states are the contexts seen at least twice; an
n-gram h w seen in training is an arc of state h that adds log10 p(w | h) and leads to the longest state
that ends in h w; the failure arc of h adds log10 (1 - t(h)) and leads to h less its first
token. Each text is read once from left to right with the state carried along.

No task holds the automaton. Texts are encoded in blocks of about ``BLOCK_TOKENS`` tokens (a
text is never cut), which are ranges of rows of a file. A block asks for the counts of its distinct n-grams; the requests are dealt by
the leading bits of the n-grams' hashes, so that each of ``parts`` tasks sums and answers about
``PART_GRAMS`` of them at a time, however large the corpus is; then each block meets its answers, which are
the part of the automaton that its texts can reach, and reads them. A frequent n-gram is asked
for once a block, so no task is hot. Keys of n-grams of 2 and 3 tokens have 40 bits besides the part's:
two n-grams of a part share one with a probability of about 4e-6; those of single tokens have all 64.

Blocks are not stored but made anew for each pass. A pass may deal the files' row groups out otherwise than the one before (as it
does when executors have come or gone), and then sees a block in other pieces. So each request names its rows, and the answers are
read against the same rows, put together from whatever pieces there are.

Null texts are empty: the end token alone. Rows are scored one by one, so ties, repeated rows and null
ids (which count as the empty text for the split) need no rule. A text longer than a block is a block of
its own. Without training tokens, every token has the same probability. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import map_texts, table, written
from tidemark.llm.words import Words, grams, pieces

ORDER = 3
DOUBT = 0.5
END = np.uint64(0x243F6A8885A308D3)
BLOCK_TOKENS = 1 << 20
PART_GRAMS = 1 << 22
KEY_BYTES = 5


def tokens(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, and where each text's tokens start (last entry: the end)."""
    words = Words(body, at, lower=True)
    return np.insert(words.hash, words.first[1:], END), words.first + np.arange(len(at))


def packed(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of ``width`` bytes, compressed byte by byte of equal weight, which suits sorted or small ones."""
    planes = np.ascontiguousarray(values, ">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, 8 - width :] = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(">u8").ravel().astype(np.uint64)


def packed_sorted(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers, as the steps between them."""
    return packed(np.diff(values, prepend=np.uint64(0)), width)


def unpacked_sorted(data: bytes, n: int, width: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, width), dtype=np.uint64)


class Block:
    """Some texts as tokens: the distinct words' hashes, sorted; each token's word; where texts start; which texts are held out."""

    def __init__(self, names: np.ndarray, word: np.ndarray, begin: np.ndarray, held: np.ndarray):
        self.names, self.word, self.begin, self.held = names, word, begin, held

    def distinct(self, orders: Iterable[int] = range(1, ORDER + 1)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each of ``orders``: sorted hashes of the n-grams, the place there of the n-gram ending at each token (-1: none), training counts."""
        hashes = self.names[self.word]
        text = np.repeat(np.arange(len(self.held)), np.diff(self.begin))
        train = ~self.held[text]
        for order in orders:
            if order == 1:
                names, place = self.names, self.word
            else:
                whole = np.flatnonzero(text[order - 1 :] == text[: len(text) - order + 1]) if len(text) >= order else np.zeros(0, np.int64)
                names, inverse = np.unique(grams(hashes, order)[whole], return_inverse=True)
                place = np.full(len(text), -1, np.int64)
                place[whole + order - 1] = inverse
            ends = place >= 0
            yield names, place, np.bincount(place[ends & train], minlength=len(names))


def encoded(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, block_rows: int = 1 << 10) -> DataFrame:
    """One row for each piece of a block: file and block (its place there), first (row) and ids, held, sizes (arrays, by text), n_words, words, ranks and stream (packed).

    ``docs`` are read from Parquet files; a block is ``block_rows`` rows of one, and a piece as many of them as come together, but at most about ``block_tokens`` tokens.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def piece(name: tuple[int, int, int], ids: list, held: list, hashes: list, sizes: list) -> pa.RecordBatch:
        names, word = np.unique(np.concatenate(hashes), return_inverse=True)
        # frequent words get small numbers, which pack well
        rank = np.argsort(-np.bincount(word), kind="stable")
        small = np.empty(len(rank), np.int64)
        small[rank] = np.arange(len(rank))
        ids, held, sizes = pa.concat_arrays(ids), pa.concat_arrays(held), pa.array(np.concatenate(sizes))
        one = pa.array([0, len(ids)], pa.int32())
        columns = [*(pa.array([x], pa.int64()) for x in name), *(pa.ListArray.from_arrays(one, x) for x in (ids, held, sizes))]
        columns += [pa.array([len(names)]), *(pa.array([x], pa.binary()) for x in (packed_sorted(names, 8), packed(small, 4), packed(small[word], 4)))]
        return pa.RecordBatch.from_arrays(columns, names=["file", "block", "first", "ids", "held", "sizes", "n_words", "words", "ranks", "stream"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, upto, size = (0, 0, 0), -1, 0
        held: tuple[list, ...] = ([], [], [], [])
        for batch in batches:
            file, row = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            block = row // block_rows
            cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1]) | (row[1:] != row[:-1] + 1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if a == b:
                    continue
                if size and (name[:2] != (file[a], block[a]) or upto != row[a]):
                    yield piece(name, *held)
                    held, size = ([], [], [], []), 0
                for begin, body, at in pieces(batch.column(4).slice(a, b - a)):
                    if not size:
                        name = (int(file[a]), int(block[a]), int(row[a]) + begin)
                    hashes, starts = tokens(body, at)
                    n = len(at) - 1
                    for kept, x in zip(held, (batch.column(0).slice(a + begin, n), batch.column(1).slice(a + begin, n), hashes, np.diff(starts)), strict=True):
                        kept.append(x)
                    upto, size = int(row[a]) + begin + n, size + len(hashes)
                    if size >= block_tokens:
                        yield piece(name, *held)
                        held, size = ([], [], [], []), 0
        if size:
            yield piece(name, *held)

    place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), *place, "text")
    return map_texts(rows, run, f"file long, block long, first long, ids array<{kind}>, held array<boolean>, sizes array<long>, n_words long, words binary, ranks binary, stream binary")


def _block(row: dict[str, pa.Array], i: int) -> Block:
    """The block of row ``i`` of arrays by column name."""
    n = row["n_words"][i].as_py()
    sizes = row["sizes"][i].values.to_numpy()
    begin = np.concatenate([[0], np.cumsum(sizes)])
    rank = unpacked(row["ranks"][i].as_py(), n, 4).astype(np.int64)
    back = np.empty(n, np.int64)
    back[rank] = np.arange(n)
    word = back[unpacked(row["stream"][i].as_py(), int(begin[-1]), 4).astype(np.int64)]
    held = row["held"][i].values.to_numpy(zero_copy_only=False).astype(bool)
    return Block(unpacked_sorted(row["words"][i].as_py(), n, 8), word, begin, held)


def _cells(names: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The runs of sorted hashes that share their leading ``bits``, which name a part."""
    part = (names >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(names), np.int64)
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(part)], strict=True):
        yield int(part[a]), slice(a, b)


def _key(names: np.ndarray, order: int, bits: int) -> np.ndarray:
    """What stands for n-grams within their part."""
    return names if order == 1 else (names << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)


def _width(order: int) -> int:
    return 8 if order == 1 else KEY_BYTES


_NAME = ["file", "block", "first", "rows"]


def asked(blocks: DataFrame, bits: int, orders: tuple[int, ...]) -> DataFrame:
    """part, the piece (file, block, first row, rows), order, n, keys, counts: each piece's distinct n-grams of each part, with their training counts there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(len(batch)):
                block = _block(columns, i)
                name = (*(columns[c][i].as_py() for c in _NAME[:3]), len(block.held))
                for order, (names, _, count) in zip(orders, block.distinct(orders), strict=True):
                    rows = [
                        (part, *name, order, at.stop - at.start, packed_sorted(_key(names[at], order, bits), _width(order)), packed(count[at], 4))
                        for part, at in _cells(names, bits)
                    ]
                    if rows:
                        kinds = (*[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", *_NAME, "order", "n", "keys", "counts"])

    return blocks.mapInArrow(run, "part long, file long, block long, first long, rows long, order int, n long, keys binary, counts binary")


def _summed(group: pa.Table) -> pa.Table:
    """The training counts, over all blocks, of what each block asked; and the distinct and all training tokens, on the first row."""
    orders, sizes = group.column("order").to_pylist(), group.column("n").to_pylist()
    answers: list[bytes] = [b""] * len(orders)
    distinct = tokens_ = 0
    for order in sorted(set(orders)):
        rows = [i for i, x in enumerate(orders) if x == order]
        keys = np.concatenate([unpacked_sorted(group.column("keys")[i].as_py(), sizes[i], _width(order)) for i in rows])
        counts = np.concatenate([unpacked(group.column("counts")[i].as_py(), sizes[i], 4) for i in rows]).astype(np.int64)
        by = np.argsort(keys, kind="stable")
        head = np.flatnonzero(np.append(True, keys[by][1:] != keys[by][:-1]))
        total = np.add.reduceat(counts[by], head)
        if order == 1:
            distinct, tokens_ = int((total > 0).sum()), int(total.sum())
        out = np.empty(len(keys), np.int64)
        out[by] = np.repeat(total, np.diff(np.append(head, len(keys))))
        edge = np.concatenate([[0], np.cumsum([sizes[i] for i in rows])])
        for i, a, b in zip(rows, edge[:-1], edge[1:], strict=True):
            answers[i] = packed(out[a:b], 5)
    return pa.table(
        {
            **{c: group.column(c) for c in _NAME},
            "part": group.column("part"),
            "order": group.column("order"),
            "n": group.column("n"),
            "totals": pa.array(answers, pa.binary()),
            "distinct": pa.array([distinct] + [0] * (len(orders) - 1), pa.int64()),
            "tokens": pa.array([tokens_] + [0] * (len(orders) - 1), pa.int64()),
        }
    )


def answered(requests: DataFrame) -> DataFrame:
    """The piece, part, order, n, totals (packed, in the order of the request), distinct, tokens."""
    return requests.groupBy("part").applyInArrow(_summed, "file long, block long, first long, rows long, part long, order int, n long, totals binary, distinct long, tokens long")


class Automaton:
    """The part of the model that one block can reach, by the tokens of the block.

    ``count[k]`` is the training count of the n-gram of k + 1 tokens that ends at each token, or 0.
    """

    def __init__(self, count: list[np.ndarray], total: int, distinct: int):
        size = len(count[0])
        p = (count[0] + 0.5) / (total + 0.5 * (distinct + 1))
        self.base = np.log10(p)
        self.gain, self.fail = [self.base], [np.zeros(size)]  # by length of the context before each token: its arc, or nan; its failure
        self.state = np.zeros(size, np.int64)  # the length of the longest context seen twice that ends at each token
        for k in range(1, len(count)):
            context = np.concatenate([[0], count[k - 1][:-1]])
            trust = np.where(context > 1, (context - 1) / np.maximum(context - 1 + DOUBT, DOUBT), 0.0)
            p = trust * count[k] / np.maximum(context, 1) + (1 - trust) * p
            self.gain.append(np.where((trust > 0) & (count[k] > 0), np.log10(p), np.nan))
            self.fail.append(np.log10(1 - trust))
            self.state[count[k - 1] > 1] = k

    def read(self, begin: np.ndarray) -> np.ndarray:
        """The log10 probability of each text (tokens ``begin[i]`` to ``begin[i + 1]``), read from left to right."""
        out = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            gain, fail, ends = [x[a:b].tolist() for x in self.gain], [x[a:b].tolist() for x in self.fail], self.state[a:b].tolist()
            sum_, state = 0.0, 0
            for i in range(b - a):
                arc = gain[state][i]
                while arc != arc:  # no arc of this state reads the token
                    sum_ += fail[state][i]
                    state -= 1
                    arc = gain[state][i]
                sum_ += arc
                state = ends[i]
            out.append(sum_)
        return np.array(out)


class Joined:
    """The pieces of one block, in the order of their rows: ids, held and sizes of all texts, and any run of them as a Block."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("first").combine_chunks()
        columns = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in zip(table.column_names, table.columns, strict=True)}
        self.parts = [_block(columns, i) for i in range(len(table))]
        self.row = columns["first"][0].as_py()
        self.ids = pa.concat_arrays([x.values for x in columns["ids"]])
        self.held = np.concatenate([p.held for p in self.parts])
        self.begin = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.begin) for p in self.parts]))])
        self.found = {}
        row = 0
        for p in self.parts:
            self.found[self.row + row, len(p.held)] = p
            row += len(p.held)
        self._hashes: np.ndarray | None = None

    def block(self, first: int, rows: int) -> Block:
        """The texts from row ``first`` on, which need not be a piece."""
        if (first, rows) in self.found:
            return self.found[first, rows]
        if self._hashes is None:
            self._hashes = np.concatenate([p.names[p.word] for p in self.parts])
        a = first - self.row
        begin = self.begin[a : a + rows + 1]
        names, word = np.unique(self._hashes[begin[0] : begin[-1]], return_inverse=True)
        return Block(names, word, begin - begin[0], self.held[a : a + rows])


def _counts(texts: Joined, answers: pa.Table, bits: int) -> list[np.ndarray]:
    """The training counts of the n-grams that end at each token, by order; 0 where there is none."""
    rows = {(o, f, r, p): (n, t) for o, f, r, p, n, t in zip(*(answers.column(c).to_pylist() for c in ("order", "first", "rows", "part", "n", "totals")), strict=True)}
    asked_by: dict[tuple[int, int], list[int]] = {}
    for order, first, count in sorted({x[:3] for x in rows}):
        asked_by.setdefault((first, count), []).append(order)
    out = [np.zeros(texts.begin[-1], np.int64) for _ in range(ORDER)]
    for (first, count), orders in asked_by.items():
        start = texts.begin[first - texts.row]
        for order, (names, place, _) in zip(orders, texts.block(first, count).distinct(orders), strict=True):
            total = np.zeros(len(names) + 1, np.int64)  # the last entry is for tokens without an n-gram
            for part, at in _cells(names, bits):
                n, data = rows[order, first, count, part]
                total[at] = unpacked(data, n, 5).astype(np.int64)
            out[order - 1][start : start + len(place)] = total[place]
    return out


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def scored(spark: SparkSession, docs: DataFrame, block_tokens: int = BLOCK_TOKENS, part_grams: int = PART_GRAMS, from_files: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    ``from_files`` says that ``docs`` is a Parquet table as it is read; other rows are written first.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs if from_files else written(docs.select("doc_id", "text"), spark)
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    # a token has about four bytes of text
    blocks = encoded(docs, block_tokens, max(1, min(1 << 16, block_tokens * 4 * rows // max(1, size))))
    # about two bytes of text for each n-gram that is asked for
    bits = max(0, -(-size // (2 * part_grams)) - 1).bit_length()
    single = written(answered(asked(blocks, bits, (1,))), spark)
    distinct, total = single.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    answers = single.unionByName(answered(asked(blocks, bits, tuple(range(2, ORDER + 1)))))

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = Joined(left)
        count = _counts(texts, right, bits)
        model = Automaton(count, total, distinct)
        edges = texts.begin[:-1]
        return pa.table(
            {
                "doc_id": texts.ids,
                "held_out": pa.array(texts.held),
                "n_tokens": pa.array(np.diff(texts.begin)),
                "n_known": pa.array(np.add.reduceat((count[0] > 0).astype(np.int64), edges)),
                "train_tokens": pa.array(np.full(len(edges), total, np.int64)),
                "base_score": pa.array(np.add.reduceat(model.base, edges)),
                "score": pa.array(model.read(texts.begin)),
            }
        )

    shape = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("file", "block").cogroup(answers.groupBy("file", "block")).applyInArrow(read, shape)


def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, table(spark, sf_dir, "documents"), from_files=True)
