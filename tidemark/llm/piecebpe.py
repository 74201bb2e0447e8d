"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they would
form, ties to the left: the best pair merges, its new neighbours join the agenda, and pairs whose
symbols have changed are skipped. Symbols that are no piece become byte pieces. Spaces are written
as U+2581 and one is put before the text.

A merge can only join characters that stand side by side in some piece, so a text falls apart
wherever they never do: before a run of spaces, around line feeds, and between ASCII punctuation
marks and letters, as far as the vocabulary holds no such pair. Arrow finds the distinct words of ``SLICE`` bytes
of texts, so that Python cuts and looks up each word once per slice, and Arrow puts their ids back in place. Each distinct part is encoded once per
worker, as long as ``MOST_BYTES`` hold what is known; parts first seen in a slice are compared with
the sentencepiece library's ids, and a difference raises an error. Decoding is the library's, of the whole ids.

Null texts are empty: their ids are the end id alone. Texts of any length, also without spaces,
take n log n steps; parts of at most ``SHORT`` characters keep their agenda in a plain list, which is faster there than a heap. Rows are encoded one by one, so ties, repeats and null ids need no rule; other
columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import operator
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import map_texts, table

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
MOST_BYTES = 200 << 20
SLICE = 4 << 20
SHORT = 100
NEVER = float("inf")


class PieceBPE:
    """The pieces of the model file ``path``, and the parts of texts encoded so far."""

    _own: dict[str, PieceBPE] = {}

    @classmethod
    def of(cls, path: str) -> PieceBPE:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        count = range(lib.get_piece_size())
        self.pieces = [lib.id_to_piece(i) for i in count]
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) for i in count]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.decimal = [b" %d" % i for i in count]
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids):
            raise ValueError("a piece of this vocabulary crosses the places where texts are cut")
        # marks that no piece puts next to a letter: a text may be cut between both
        letters = "[^\\W\\d_" + "".join(sorted({c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()})) + "]"
        letter = re.compile(letters)
        sides = {pair for p in self.ids for pair in itertools.pairwise(p)}
        marks = set(string.punctuation) - {c for pair in sides if any(map(letter.match, pair)) for c in pair}
        mark = "".join(map(re.escape, sorted(marks)))
        whole = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        word = rf"{SPACE}*{letters}++(?=[{mark}{SPACE}\n]|\Z)|{SPACE}*[{mark}]++(?={letters}|[{SPACE}\n]|\Z)"
        self.cut = re.compile(f"{word}|{whole}" if marks else whole)
        self.side = np.zeros(256, np.uint8)  # of ASCII: 1 a letter, 2 such a mark
        self.side[[*string.ascii_letters.encode()]] = 1
        self.side[[ord(c) for c in marks]] = 2
        self.known: dict[str, bytes] = {}  # ids in decimal, a space before each
        self.kept = 0

    def merge(self, part: str) -> list[int]:
        """The ids of one part."""
        symbols = self._short(part) if len(part) <= SHORT else self._long(part)
        try:
            return [*map(self.ids.__getitem__, symbols)]
        except KeyError:
            return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else [self.bytes[b] for b in s.encode()])]

    def _short(self, part: str) -> list[str]:
        """The symbols of a part after all merges; the agenda holds a rank for each pair, in the order of the text."""
        rank = self.rank.get
        symbols = list(part)
        agenda = [*map(rank, map(operator.add, part, part[1:]), itertools.repeat(NEVER))]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] = pair = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + pair, NEVER)
            if i < len(agenda):
                agenda[i] = rank(pair + symbols[i + 1], NEVER)
        return symbols

    def _long(self, part: str) -> list[str]:
        """The symbols of a part after all merges; the agenda is a heap."""
        rank = self.rank
        symbols: list[str] = list(part)
        last = len(symbols) - 1
        after = list(range(1, last + 2))
        before = list(range(-1, last))
        agenda = [(r, i, s) for i in range(last) if (r := rank.get(s := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j > last or len(symbols[i]) + len(symbols[j]) != len(pair) or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k <= last:
                before[k] = i
                if (r := rank.get(s := pair + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, s))
            if (h := before[i]) >= 0 and (r := rank.get(s := symbols[h] + pair)) is not None:
                heapq.heappush(agenda, (r, h, s))
        return [s for s in symbols if s]

    def learn(self, parts: Iterable[str]) -> None:
        """Encodes new parts and compares them with the library."""
        if self.kept > MOST_BYTES:
            self.known, self.kept = {}, 0
        new = [p for p in dict.fromkeys(parts) if p not in self.known]
        if not new:
            return
        lead = self.library.encode("\n")  # a line feed before a part keeps the library from putting a space there
        for begin in range(0, len(new), 4096):
            some = new[begin : begin + 4096]
            theirs = self.library.encode(["\n" + p for p in some], num_threads=1)
            for p, want in zip(some, theirs, strict=True):
                ids = self.merge(p)
                if lead + ids != want:
                    raise ValueError(f"the library encodes {p!r} as {want[len(lead):]}, the agenda as {ids}")
                self.known[p] = text = b"".join(map(self.decimal.__getitem__, ids))
                self.kept += 4 * len(p) + len(text) + 200

    def words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, cut before runs of spaces, around line feeds and between ASCII letters and marks, and where each text's words start; the space before a text is its first word's."""
        texts = texts.fill_null("").cast(pa.string())
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise("", texts, " "))
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        body = np.frombuffer(texts.buffers()[2] or b"", np.uint8, int(at[-1]))
        blank, line = body == 32, body == 10
        spaces = blank.copy()  # the last byte of a space or U+2581
        spaces[2:] |= (body[2:] == 0x81) & (body[1:-1] == 0x96) & (body[:-2] == 0xE2)
        begin = np.zeros(len(body) + 1, bool)
        side = self.side[body]
        begin[1:-1] = blank[1:] & ~spaces[:-1] | line[1:] | line[:-1] | (side[1:] + side[:-1] == 3)
        begin[at] = True
        start = np.flatnonzero(begin).astype(np.int32)  # the end as well
        words = pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer(start), pa.py_buffer(body)])
        return words.dictionary_encode(), np.searchsorted(start, at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview, np.ndarray]:
        """All ids of the texts, where each text's ids start, all ids in decimal with a space before each, and where each text's start there."""
        words, edge = self.words(texts)
        distinct = pc.replace_substring(words.dictionary.cast(pa.string()), " ", SPACE).to_pylist()
        decimal = [*map(self.known.get, distinct)]
        new = [i for i, ids in enumerate(decimal) if ids is None]
        parts = [self.cut.findall(distinct[i]) for i in new]
        self.learn(itertools.chain.from_iterable(parts))
        for i, some in zip(new, parts, strict=True):
            decimal[i] = b"".join(map(self.known.__getitem__, some))
        count = np.zeros(len(decimal) + 1, np.int64)
        np.cumsum([ids.count(b" ") for ids in decimal], out=count[1:])
        ids = pa.array(np.fromstring(b"".join(decimal), np.int32, sep=" ") if decimal else np.zeros(0, np.int32))
        ids = pa.LargeListArray.from_arrays(count, ids).take(words.indices)
        text = pa.array(decimal, pa.large_binary()).take(words.indices)
        places = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)
        return ids.flatten().to_numpy(), ids.offsets.to_numpy()[edge], memoryview(text.buffers()[2] or b""), places[edge]


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``SLICE`` bytes of text."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(batch)]
        for begin, end in itertools.pairwise(cuts):
            if end > begin:
                yield batch.slice(begin, end - begin)


def encode(docs: DataFrame, vocabulary: str | None = None, end_id: int | None = 2) -> DataFrame:
    """doc_id, ids (array<int>) of every text."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceBPE.of(path)
        for batch in slices(batches):
            ids, at, _, _ = own.encode(batch.column(1))
            if end_id is not None:
                ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at.astype(np.int32), ids)], names=["doc_id", "ids"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text of every row of ids."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceBPE.of(path)
        for batch in batches:
            texts = [None if x is None else own.library.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of the ids of ``encode`` and the text the library decodes them to, without moving either."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceBPE.of(path)
        for batch in slices(batches):
            ids, at, text, place = own.encode(batch.column(1))
            ours, texts = [], []
            for (a, b), (c, d) in zip(itertools.pairwise(at.tolist()), itertools.pairwise(place.tolist()), strict=True):
                ours.append(hashlib.sha256(b"%b %d" % (text[c + 1 : d], end_id) if d > c else b"%d" % end_id).hexdigest())
                texts.append(hashlib.sha256(own.library.decode([*ids[a:b].tolist(), end_id]).encode()).hexdigest())
            counts = np.diff(at) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ours), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
