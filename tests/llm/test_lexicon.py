"""The transducer lexicon: minimal, exact, and equal to the library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, empty, frame
from tidemark.llm import lexicon
from tidemark.llm.bytebpe import ByteBPE

PATH = public_tokenizers.path("byte_bpe_50k.json")
MORE = [
    (200, "an <|endoftext|> inside<|endoftext|>", "s"),
    (201, "\U000134da齠 1ᲊ2 Ꟊ\U000105c0'll we'LL  \u0085 x　 y", "s"),
    (202, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 90, "s"),
    (203, "\n\n \t  tabs\r\n and trailing   ", "s"),
    (204, "don't I'm he's they've we're x'd ''s 's", "s"),
    (205, "0123456789" * 30 + " ½ ² ٣ ⅷ", "s"),
]


def states_by_brute_force(names):
    """The number of different sets of endings that prefixes have."""
    prefixes = {w[:i] for w in names for i in range(len(w) + 1)} | {b""}
    return len({frozenset(w[len(p) :] for w in names if w.startswith(p)) for p in prefixes})


def test_transducer_is_minimal_and_exact():
    rng = random.Random(3)
    for size in (0, 1, 2, 30, 200):
        names = sorted({bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(1, 7))) for _ in range(size)})
        entries = {w: [rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for w in names}
        made = lexicon.Transducer.compiled(entries)
        assert made.states == states_by_brute_force(names)
        others = [bytes(rng.choice(b"abc\xff\x00z") for _ in range(rng.randint(0, 9))) for _ in range(300)]
        asked = names + others
        place = made.find(pa.array(asked, pa.binary()))
        for w, at in zip(asked, place.tolist(), strict=True):
            assert (at >= 0) == (w in entries)
            if at >= 0:
                assert names[at] == w and made.ids[made.edge[at] : made.edge[at + 1]].tolist() == entries[w]
        sliced = pa.array([b"zz", *asked], pa.binary()).slice(1)
        assert made.find(sliced).tolist() == place.tolist()


def test_suffixes_are_shared_on_real_words(tmp_path):
    merges = lexicon.Merges.of(PATH)
    words = [b" walking", b" talking", b" walked", b" talked", b"walking", b"talking"]
    made = lexicon.Transducer.compiled({w: merges.merge(w) for w in words})
    assert made.states == states_by_brute_force(words) < len({w[:i] for w in words for i in range(len(w) + 1)})
    np.save(tmp_path / "x.npy", made.flat)
    mapped = lexicon.Transducer.mapped(str(tmp_path / "x.npy"))
    assert isinstance(mapped.flat.base, np.memmap) or isinstance(mapped.flat, np.memmap)
    assert (mapped.find(pa.array(words, pa.binary())) >= 0).all()


def test_merges_equal_the_library():
    library, merges = Tokenizer.from_file(PATH), lexicon.Merges.of(PATH)
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzäéßあ語"
    for _ in range(3000):
        word = "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 9, 40])))
        assert merges.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_ids_and_texts_equal_the_library(spark):
    rows = documents() + MORE
    docs, library = frame(spark, rows), Tokenizer.from_file(PATH)
    want = {}
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, t] = (ids, library.decode(ids, skip_special_tokens=False))
        assert want[d, t][1] == (t or "")
    for words in (0, 20, 1 << 16):  # the list changes nothing
        got = lexicon.encode(spark, docs, words=words)
        assert sorted(map(str, ((r.doc_id, r.ids) for r in got.collect()))) == sorted(str((d, want[d, t][0])) for d, t, _ in rows)
    back = lexicon.decode(got)
    assert sorted(map(str, ((r.doc_id, r.text) for r in back.collect()))) == sorted(str((d, want[d, t][1])) for d, t, _ in rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = sorted(map(str, map(tuple, lexicon.digests(spark, docs).collect())))
    assert digests == sorted(str((d, len(ids), sha(",".join(map(str, ids))), sha(text))) for d, t, _ in rows for ids, text in [want[d, t]])


def test_ids_that_are_no_text(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(1, [200, 100, 50256, 13]), (2, []), (3, None), (4, [167, 220, 95, 96])]
    got = {r.doc_id: r.text for r in lexicon.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)).collect()}
    assert got == {d: None if ids is None else library.decode(ids, skip_special_tokens=False) for d, ids in rows}


def test_counts_are_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "MOST_COUNTED", 50)
    rows = [(i, "the cat sat " * 3 + f"word{i}" + " the" * i, "s") for i in range(40)]
    split = ByteBPE.of(PATH).library.pre_tokenizer
    want = {}
    for _, t, _ in rows:
        for _, (a, b) in split.pre_tokenize_str(t):
            want[t[a:b].encode()] = want.get(t[a:b].encode(), 0) + 1
    for words in (0, 3, 5, 40, 1000):
        limit = min(c for c in {2, *(n + 1 for n in want.values())} if c > 1 and sum(n >= c for n in want.values()) <= words)
        assert lexicon.frequent_words(spark, frame(spark, rows), words) == sorted(w for w, n in want.items() if n >= limit)
    assert max(want.values()) > 500


def test_empty_and_broken(spark):
    assert lexicon.digests(spark, empty(spark)).count() == 0
    broken = spark.range(3).selectExpr("id as doc_id", "cast(unhex('61ff62206363') as string) as text").coalesce(1)
    ids = Tokenizer.from_file(PATH).encode("a�b cc", add_special_tokens=False).ids
    assert [r.ids for r in lexicon.encode(spark, broken).collect()] == [ids] * 3


def test_classes_are_the_library_s():
    library, own = Tokenizer.from_file(PATH), ByteBPE(PATH)
    chars = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x1F000 or c % 61 == 0)]
    for i in range(0, len(chars), 4096):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2  {chr(c)} x" for c in chars[i : i + 4096])
        body = np.frombuffer(text.encode(), np.uint8)
        ids, _ = own.encode(body, np.array([0, len(body)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
