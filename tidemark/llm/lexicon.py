"""Byte-level BPE by a minimal acyclic transducer of frequent words, and exact merges for all others.

Texts are split into words (the pieces of the vocabulary's own splitter, see ``bytebpe``). Words are counted over all
documents, and the most frequent ones, at most ``words``, with the ids that their merges give, are compiled into a transducer: an acyclic
automaton over bytes in which equal suffixes share their states, so that it is minimal, and whose arcs carry numbers that add up to the
word's place in a list of ids. States and arcs lie in flat arrays, arcs in one table at places (state's base + byte) where no others lie. The file
is written to the shared folder, handed to every executor by Spark, and mapped into memory by its workers, so that
processes of one machine share one copy.

Encoding takes each batch's distinct words and walks them through the transducer side by side, byte by byte. Words that it does
not accept are merged exactly: the pair with the smallest rank first, ties to the left, until no pair of the vocabulary is left. So
the list decides how fast words are found, never what they become; its size is bounded by ``words`` at any size of the corpus.
Merged words are remembered within a task, at most ``MOST_BYTES`` of them.

Decoding joins the bytes of ids; bytes that are not UTF-8 become U+FFFD as in the library, whose ``decode`` it equals.

Null texts are empty and have no ids. Strings of added tokens in a text are those tokens, as the library's call has it. Texts of
any length, also without spaces, take n log n steps. Rows are encoded one by one, so ties, repeats and null ids need no
rule; words of equal counts enter the list together or not at all. Other columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import ByteBPE
from tidemark.llm.shared import map_texts, shared_folder, table, written
from tidemark.llm.words import pieces

VOCABULARY = "byte_bpe_50k.json"
WORDS = 1 << 16
WORD_BYTES = 64  # longer pieces are no words of the list
PART_BYTES = 1 << 19
MOST_BYTES = 64 << 20
MOST_COUNTED = 1 << 18
LOOK = 1 << 10


class Merges:
    """The merges of a vocabulary file: ids of words."""

    _own: dict[str, Merges] = {}

    @classmethod
    def of(cls, path: str) -> Merges:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        self.split = ByteBPE(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary: dict[str, int] = model["vocab"]
        # printable stand-ins of bytes: those that are printable stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        back = {c: b for b, c in sign.items()}
        self.byte = [vocabulary[sign[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pairs[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        added = {i: t.content for i, t in self.split.library.get_added_tokens_decoder().items()}
        self.added = {content.encode(): i for i, content in added.items()}
        size = 1 + max([*vocabulary.values(), *added])
        texts = [b""] * size
        for token, i in vocabulary.items():
            texts[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for i, content in added.items():
            texts[i] = content.encode()
        self.texts = pa.array(texts, pa.binary())
        self.names = pa.array([str(i).encode() for i in range(size)], pa.binary())

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if word in self.added:
            return [self.added[word]]
        pairs = self.pairs
        ids = [self.byte[b] for b in word]
        last = len(ids) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        agenda = [(*found, i) for i in range(last) if (found := pairs.get((ids[i], ids[i + 1])))]
        heapq.heapify(agenda)
        while agenda:
            _, made, i = heapq.heappop(agenda)
            j = after[i]
            if ids[i] < 0 or j > last or (found := pairs.get((ids[i], ids[j]))) is None or found[1] != made:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k <= last:
                before[k] = i
                if found := pairs.get((made, ids[k])):
                    heapq.heappush(agenda, (*found, i))
            if (h := before[i]) >= 0 and (found := pairs.get((ids[h], made))):
                heapq.heappush(agenda, (*found, h))
        return [x for x in ids if x >= 0]


class Transducer:
    """A compiled list of words: flat arrays, which may lie in a mapped file."""

    _own: dict[str, Transducer] = {}

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        if path not in cls._own:
            cls._own[path] = cls(np.load(path, mmap_mode="r"))
        return cls._own[path]

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        states, slots, words, ids = flat[:4].tolist()
        self.base, self.final, self.owner, self.target, self.number, self.edge, self.ids = np.split(flat[4:], np.cumsum([states, states, slots, slots, slots, words + 1]))
        self.states, self.words, self.n_ids = states, words, ids

    @classmethod
    def compiled(cls, entries: dict[bytes, list[int]]) -> Transducer:
        names = sorted(entries)
        arcs, final = _minimal(names)
        number, _ = _numbers(arcs, final)
        base, owner, target, number = _table(arcs, number)
        edge = np.cumsum([0, *(len(entries[w]) for w in names)])
        ids = [i for w in names for i in entries[w]]
        return cls(np.concatenate([[len(arcs), len(owner), len(names), len(ids)], base, final, owner, target, number, edge, ids]).astype(np.int32))

    def find(self, words: pa.Array) -> np.ndarray:
        """The place in the list of each of ``words`` (binary), or -1."""
        _, starts, data = words.buffers()
        at = np.frombuffer(starts, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out = np.full(len(words), -1, np.int64)
        row, state, sum_, place, end = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), at[:-1], at[1:]
        while len(row):
            done = place == end
            whole = done & (self.final[state] == 1)
            out[row[whole]] = sum_[whole]
            row, state, sum_, place, end = (x[~done] for x in (row, state, sum_, place, end))
            slot = self.base[state] + body[place]
            arc = self.owner[slot] == state
            row, slot, sum_, place, end = (x[arc] for x in (row, slot, sum_, place, end))
            state, sum_, place = self.target[slot], sum_ + self.number[slot], place + 1
        return out


def _minimal(names: list[bytes]) -> tuple[list[dict[int, int]], list[int]]:
    """Arcs and finality of the minimal automaton of sorted ``names``; state 0 is where words start.

    Words are added in order; as soon as no later word can reach a state's arcs, an equal state takes its place if there is one.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [0]
    known: dict[tuple, int] = {}
    free: list[int] = []
    path = [0]
    before = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            twin = known.setdefault((final[state], *arcs[state].items()), state)
            if twin != state:
                arcs[path[-1]][before[len(path) - 1]] = twin
                free.append(state)

    for name in names:
        shared = 0
        while shared < min(len(name), len(before)) and name[shared] == before[shared]:
            shared += 1
        settle(shared)
        for b in name[shared:]:
            if free:
                state = free.pop()
                arcs[state], final[state] = {}, 0
            else:
                state = len(arcs)
                arcs.append({})
                final.append(0)
            arcs[path[-1]][b] = state
            path.append(state)
        final[path[-1]] = 1
        before = name
    settle(0)
    # numbers without gaps
    alive = [s for s in range(len(arcs)) if s not in set(free)] if free else range(len(arcs))
    new = {s: i for i, s in enumerate(alive)}
    return [{b: new[t] for b, t in arcs[s].items()} for s in alive], [final[s] for s in alive]


def _numbers(arcs: list[dict[int, int]], final: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """What each arc adds to a word's place in the list, and how many words each state can read."""
    count: list[int] = [-1] * len(arcs)
    number: list[dict[int, int]] = [{} for _ in arcs]
    stack = [0]
    while stack:
        state = stack[-1]
        if todo := [t for t in arcs[state].values() if count[t] < 0]:
            stack += todo
            continue
        stack.pop()
        sum_ = final[state]
        for b, t in arcs[state].items():
            number[state][b] = sum_
            sum_ += count[t]
        count[state] = sum_
    return number, count


def _table(arcs: list[dict[int, int]], number: list[dict[int, int]]) -> tuple[np.ndarray, ...]:
    """base by state, and owner, target and number by slot, so that the arc of a state with a byte lies at base + byte.

    States with many arcs come first; each takes the first place where its arcs fit among ``LOOK`` slots from the
    first free one on or the last ``LOOK`` slots, or else the end.
    """
    used = np.zeros(1 << 18, bool)
    base = np.zeros(len(arcs), np.int64)
    first = end = 256  # places before it would have a negative base for some byte
    for state in sorted(range(len(arcs)), key=lambda s: (-len(arcs[s]), s)):
        if not (own := np.fromiter(arcs[state], np.int64, len(arcs[state]))).size:
            continue
        while used[first]:
            first += 1
        while max(first + LOOK, end) + 512 > len(used):
            used = np.concatenate([used, np.zeros_like(used)])
        at = end
        near, far = np.flatnonzero(~used[first : first + LOOK]) + first, np.flatnonzero(~used[max(first, end - LOOK) : end]) + max(first, end - LOOK)
        places = np.concatenate([near, far]) - own[0]
        fits = ~used[places[:, None] + own].any(axis=1)
        if fits.any():
            at = int(places[fits.argmax()])
        base[state] = at
        used[at + own] = True
        end = max(end, int(at + own.max()) + 1)
    slots = int(base.max()) + 256
    owner, target, numbers = np.full(slots, -1), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for state, own in enumerate(arcs):
        for b, t in own.items():
            owner[base[state] + b], target[base[state] + b], numbers[base[state] + b] = state, t, number[state][b]
    return base, owner, target, numbers


def _words(split: ByteBPE, body: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one after the other, and where each text's words start."""
    if not len(body):
        return pa.array([], pa.binary()), np.zeros(len(at), np.int64)
    chars, edges, start = split.pieces(body, at)
    head = np.flatnonzero((body & 0xC0) != 0x80)
    if len(head) != len(chars) or head[0]:  # some bytes are not UTF-8
        body = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
        head = np.flatnonzero((body & 0xC0) != 0x80)
    else:
        try:
            body.tobytes().decode()
        except UnicodeDecodeError:
            body = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), np.uint8)
            head = np.flatnonzero((body & 0xC0) != 0x80)
    begin = np.append(head[start], len(body)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(begin), pa.py_buffer(np.ascontiguousarray(body))])
    return words, np.searchsorted(start, edges)


def frequent_words(spark: SparkSession, docs: DataFrame, words: int = WORDS, vocabulary: str | None = None) -> list[bytes]:
    """The most frequent words of at most ``WORD_BYTES`` in all texts, sorted: all that occur more often than a limit, which is the least of 2 or more that leaves at most ``words``.

    The limit comes from two small histograms of the counts, so no task ranks words of the whole corpus. Counts from 8192 on are told apart by their
    leading 13 bits.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Merges.of(path).split
        held, rows = [], 0
        for batch in batches:
            for _, body, at in pieces(batch.column(0), PART_BYTES):
                counted = _words(split, body, at)[0].value_counts()
                held.append(pa.table({"word": counted.field("values"), "n": counted.field("counts")}))
                rows += len(counted)
                if rows > MOST_COUNTED:  # what a task has counted so far; handed on if it does not get smaller
                    held = [summed(held)]
                    rows = len(held[0])
                    if rows > MOST_COUNTED // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from summed(held).to_batches()

    counts = map_texts(docs.select("text"), run, "word binary, n long").where(F.length("word") <= WORD_BYTES)
    counts = written(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), spark)
    bits = F.length(F.bin("n"))
    room, limit = words, 2
    for level in sorted(counts.groupBy(bits.alias("bits")).count().collect(), reverse=True):  # at most 63 rows
        if level["count"] > room:
            step = 1 << max(0, level.bits - 13)
            cells = counts.where(bits == level.bits).groupBy(F.floor(F.col("n") / step).alias("cell")).count()
            for cell in sorted(cells.collect(), reverse=True):  # at most 4096 rows
                if cell["count"] > room:
                    limit = (cell.cell + 1) * step
                    break
                room -= cell["count"]
            break
        room -= level["count"]
    kept = counts.where(F.col("n") >= limit)
    return sorted(bytes(w) for w in kept.select("word").toArrow().column("word").to_pylist())  # at most ``words``


def published(spark: SparkSession, lexicon: Transducer) -> str:
    """The name under which Spark hands the file of ``lexicon`` to every executor."""
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = f"{shared_folder(spark)}/{name}"
    data = io.BytesIO()
    np.save(data, lexicon.flat)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def lexicon(spark: SparkSession, docs: DataFrame, words: int = WORDS, vocabulary: str | None = None) -> str:
    """The name of the published transducer of the frequent words of ``docs``."""
    merges = Merges.of(vocabulary or public_tokenizers.path(VOCABULARY))
    return published(spark, Transducer.compiled({w: merges.merge(w) for w in frequent_words(spark, docs, words, vocabulary)}))


class Encoder:
    """Encodes batches of texts with a transducer, merging what it does not accept."""

    def __init__(self, path: str, lexicon_file: str):
        self.merges, self.list = Merges.of(path), Transducer.mapped(lexicon_file)
        self.forget()

    def forget(self) -> None:
        self.merged: dict[bytes, list[int]] = {}
        self.kept = 0

    def _unseen(self, word: bytes) -> list[int]:
        if (ids := self.merged.get(word)) is None:
            if self.kept > MOST_BYTES:
                self.forget()
            ids = self.merged[word] = self.merges.merge(word)
            self.kept += 200 + len(word) + 36 * len(ids)
        return ids

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        """The place of each word among the distinct ones, and the ids of those."""
        coded = words.dictionary_encode()
        names = coded.dictionary
        place = self.list.find(names)
        unseen = np.flatnonzero(place < 0)
        more = [self._unseen(w) for w in names.take(pa.array(unseen)).to_pylist()]
        known = np.clip(place, 0, None)
        length = self.list.edge[known + 1] - self.list.edge[known] if self.list.words else np.zeros(len(names), np.int64)
        length = length.astype(np.int64)
        length[unseen] = [len(x) for x in more]
        edge = np.concatenate([[0], np.cumsum(length)])
        flat = np.zeros(edge[-1], np.int32)
        seen = np.flatnonzero(place >= 0)
        if len(seen):
            begin, size = self.list.edge[place[seen]].astype(np.int64), length[seen]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            flat[np.repeat(edge[seen], size) + step] = self.list.ids[np.repeat(begin, size) + step]
        for i, ids in zip(unseen.tolist(), more, strict=True):
            flat[edge[i] : edge[i + 1]] = ids
        return coded.indices.to_numpy(), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat))


def _joined(values: pa.Array, edge: np.ndarray, between: bytes) -> pa.Array:
    """The strings of each run of ``values`` in one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), values), between)


def _mapped(docs: DataFrame, path: str, name: str, made, schema: str) -> DataFrame:
    """``made(encoder, row numbers' batch, place, distinct ids, edges)`` for parts of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(path, SparkFiles.get(name))
        for batch in batches:
            for row, body, at in pieces(batch.column(1), PART_BYTES):
                words, edge = _words(own.merges.split, body, at)
                yield made(own, batch.column(0).slice(row, len(at) - 1), *own.distinct(words), edge)

    return map_texts(docs.select("doc_id", "text"), run, schema)


def encode(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, words: int = WORDS, lexicon_name: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every text; with the list ``lexicon_name``, or one made of ``docs``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def made(own: Encoder, ids: pa.Array, place: np.ndarray, distinct: pa.ListArray, edge: np.ndarray) -> pa.RecordBatch:
        each = distinct.take(pa.array(place))
        starts = np.concatenate([[0], np.cumsum(each.value_lengths().to_numpy(zero_copy_only=False))]) if len(each) else np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(starts[edge].astype(np.int32)), each.flatten())], names=["doc_id", "ids"])

    return _mapped(docs, path, lexicon_name or lexicon(spark, docs, words, vocabulary), made, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def _text(joined: bytes) -> str:
    return joined.decode("utf-8", "replace")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text of every row of ids; null ids give null."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Merges.of(path).texts
        for batch in batches:
            ids = batch.column(1)
            edge = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy())])
            joined = _joined(texts.take(ids.flatten()), edge, b"")
            out = [_text(t) if some else None for t, some in zip(joined.to_pylist(), ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return map_texts(encoded.select("doc_id", "ids"), run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, words: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of the ids of ``encode`` and what ``decode`` makes of them, without moving either."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def made(own: Encoder, ids: pa.Array, place: np.ndarray, distinct: pa.ListArray, edge: np.ndarray) -> pa.RecordBatch:
        sizes, flat, starts = distinct.value_lengths().to_numpy(zero_copy_only=False), distinct.flatten(), distinct.offsets.to_numpy()
        at = pa.array(place)
        total = np.concatenate([[0], np.cumsum(sizes[place])])
        numbers = _joined(_joined(own.merges.names.take(flat), starts, b",").take(at), edge, b",")
        texts = _joined(_joined(own.merges.texts.take(flat), starts, b"").take(at), edge, b"")
        hashes = [[hashlib.sha256(x.as_buffer()).hexdigest() for x in numbers], [hashlib.sha256(_text(x.as_py()).encode()).hexdigest() for x in texts]]
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(total[edge])), *map(pa.array, hashes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, path, lexicon(spark, docs, words, vocabulary), made, shape)


def op12_transducer_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, table(spark, sf_dir, "documents"))
