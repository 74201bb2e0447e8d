"""Byte-level BPE ids of many texts at a time, equal to the tokenizers library's.

The library splits a text by one pattern and encodes every piece of it by itself. Here the split
is computed for whole Arrow batches from a table of character classes, each distinct piece is
encoded by the library once per task, and the ids of all pieces are gathered with NumPy. The class of
a character (letter, number or neither) is asked of the library's own splitter when the character is first met, since tables
of Unicode differ between versions. Strings
of added tokens in a text (such as an end-of-text mark) become those tokens, as the library's call
has it by default; the text on either side of one is split by itself.
"""

from __future__ import annotations

import itertools

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm.words import _Powers, mix

LETTER, NUMBER, SPACE, UNKNOWN = 1, 2, 3, 255
#: White_Space of Unicode, as \s in the pattern (fixed values).
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
MOST_KEPT = 1_000_000  # pieces remembered at a time, of 24 bytes and 4 for each id


def codepoints(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts and where each text starts; bytes that are not UTF-8 become U+FFFD."""
    try:
        chars = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begins = np.zeros(len(body) + 1, np.int64)
        np.cumsum((body & 0xC0) != 0x80, out=begins[1:])
        return chars, begins[at]
    except UnicodeDecodeError:
        texts = [np.frombuffer(body[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


class ByteBPE:
    """Encodes with the vocabulary file ``path``, as ``encode(text, add_special_tokens=False)`` of the library does."""

    _own: dict[str, ByteBPE] = {}

    @classmethod
    def of(cls, path: str) -> ByteBPE:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.kind[SPACES] = SPACE
        self.forget()

    def classes(self, chars: np.ndarray) -> np.ndarray:
        """The class of each character."""
        kind = self.kind[chars]
        new = np.unique(chars[kind == UNKNOWN])
        if not len(new):
            return kind
        # between a letter and a number, a letter joins the one and a number the other
        asked = "".join(f"a{chr(c)}1" for c in new.tolist())
        head = np.zeros(len(asked) + 1, bool)
        head[[at for _, (at, _) in self.library.pre_tokenizer.pre_tokenize_str(asked)]] = True
        self.kind[new] = np.where(~head[1:-1:3], LETTER, np.where(~head[2::3], NUMBER, 0))
        return self.kind[chars]

    def forget(self) -> None:
        """Drops the pieces encoded so far; called at the end of a task, as workers live on."""
        self.names = np.zeros(0, np.uint64)  # hashes of the known pieces, sorted
        self.where = self.length = np.zeros(0, np.int64)  # the place of each one's ids in ``flat``
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def marks(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(start, end) in bytes of every string of an added token that lies within one text."""
        raw, out = body.tobytes(), []
        for token in self.added:
            i = raw.find(token)
            while i >= 0:
                end = i + len(token)
                if end <= at[np.searchsorted(at, i, "right")]:
                    out.append((i, end))
                i = raw.find(token, end)
        return np.array(sorted(out), np.int64).reshape(-1, 2)

    def split(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the pieces of the pattern start, in all texts."""
        n = len(chars)
        kind = self.classes(chars)
        begin = np.zeros(n + 1, bool)
        begin[at] = True
        space = kind == SPACE
        before = np.empty(n, np.uint8)
        before[1:], before[:1] = kind[:-1], 0
        blank = np.zeros(n, bool)  # the character before is U+0020
        blank[1:] = chars[:-1] == 32
        after = np.ones(n, bool)  # the next character is in the same text and no white space
        after[:-1] = ~space[1:]
        after[-1:] = False
        after &= ~begin[1:]
        start = np.where(
            space,
            (before != SPACE) | after,
            np.where(before == SPACE, ~blank, before != kind),
        )
        start |= begin[:-1]
        # 's 't 'm 'd 're 've 'll at the start of a piece are pieces
        mark = np.flatnonzero((chars[:-1] == 39) & start[:-1] & ~begin[1:-1]) if n > 1 else np.zeros(0, np.int64)
        if len(mark):
            second = chars[mark + 1]
            third = chars[np.minimum(mark + 2, n - 1)]
            inside = (mark + 2 < n) & ~begin[np.minimum(mark + 2, n)]
            one = np.isin(second, [115, 116, 109, 100])
            two = inside & ((((second == 114) | (second == 118)) & (third == 101)) | ((second == 108) & (third == 108)))
            start[mark[one | two] + 1] = False
            ends = np.concatenate([mark[one] + 2, mark[two] + 3])
            start[ends[ends < n]] = True
            # white space before keeps its own pieces, as a space after the contraction still leads the next word
        return np.flatnonzero(start)

    def pieces(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters of the texts, where each text starts there, and where each piece does; pieces leave nothing out."""
        marks = self.marks(body, at)
        cuts = np.unique(np.concatenate([at, marks.ravel()]))
        chars, edges = codepoints(body, cuts)
        at = edges[np.searchsorted(cuts, at)]
        start = self.split(chars, edges)
        if len(marks):  # an added token is one piece
            begins, ends = edges[np.searchsorted(cuts, marks[:, 0])], edges[np.searchsorted(cuts, marks[:, 1])]
            last = np.searchsorted(begins, start, "right") - 1
            start = start[(last < 0) | (start == begins[last]) | (start >= ends[last])]
        return chars, at, start

    def encode(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's ids start."""
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        chars, at, start = self.pieces(body, at)
        end = np.append(start[1:], len(chars))
        up, down = _Powers.of(len(chars))
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=total[1:])
        key = mix((total[end] - total[start]) * down[start])
        names, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.names) > MOST_KEPT:
            self.forget()
        place = np.searchsorted(self.names, names)
        new = np.flatnonzero(np.append(self.names, np.uint64(0))[place] != names) if len(self.names) else np.arange(len(names))
        if len(new):
            whole, some = chars.tobytes().decode("utf-32-le"), first[new]
            texts = [whole[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
            self._keep(names[new], [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)])
        piece = np.searchsorted(self.names, names)[back]
        length = self.length[piece]
        edge = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(length, out=edge[1:])
        ids = self.flat[np.repeat(self.where[piece] - edge[:-1], length) + np.arange(edge[-1])]
        return ids, edge[np.searchsorted(start, at)]

    def _keep(self, names: np.ndarray, ids: list[list[int]]) -> None:
        """Adds pieces by their sorted hashes."""
        length = np.array([len(x) for x in ids], np.int64)
        end = self.used + np.cumsum(length)
        while end[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end[-1]] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(length.sum()))
        place = np.searchsorted(self.names, names)
        self.names = np.insert(self.names, place, names)
        self.where = np.insert(self.where, place, end - length)
        self.length = np.insert(self.length, place, length)
        self.used = int(end[-1])
