"""Text operators against plain versions of their definitions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, empty, frame, lower, sentence, words
from tidemark.llm import backoff, boilerplate, hyperminhash, licences, packing, piecebpe, privacy, quality
from tidemark.llm.bytebpe import ByteBPE
from tidemark.llm.words import Words, mix, pieces


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_words_match_the_pattern():
    texts = [t for _, t, _ in documents()]
    got = []
    for _, body, at in pieces(pa.array(texts), most=3000):
        w = Words(body, at)
        spans = [body[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
        got += [spans[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert len(set(zip(spans, w.hash.tolist(), strict=True))) == len(set(spans)) == len(set(w.hash.tolist()))
    assert got == [words(t) for t in texts]


# --- 2: quality ---


def _counts(text):
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    n = Counter(windows)
    covered = {i + k for i, g in enumerate(windows) if n[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


def test_quality_counts_and_verdict(spark):
    docs = frame(spark, [*documents(), (200, "a b c\na b c\n#|x a b c", "s")])
    heads = (quality._constant(1), quality._constant(0))
    got = Counter((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"], r["kept"]) for r in _rows(quality.judged(docs, heads, ["doc_id"])))
    want = Counter()
    for i, t, _ in [*documents(), (200, "a b c\na b c\n#|x a b c", "s")]:
        c = _counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[i, *c, failed, not failed] += 1
    assert got == want


def test_quality_learns(spark):
    rows, marks = [], []
    for i, (_, text, _) in enumerate(documents() * 4):
        bad, rude = i % 4 == 0, i % 5 == 0
        text = f"{text or ''} {'plain words here'} " + ("%%% $$$ " * 3 if bad else "") + ("you idiot scum" if rude else "")
        rows.append((i, text, "s"))
        marks.append((i, int(not bad), int(rude)))
    labels = spark.createDataFrame([*marks, (None, 1, 0), (1, None, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in _rows(quality.judged(docs, quality.fit(spark, docs, labels), ["doc_id"]))}
    assert np.mean([(got[i]["p_quality"] >= 0.5) == bool(q) for i, q, _ in marks]) > 0.98
    assert np.mean([(got[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t in marks]) > 0.98
    kept = quality.good_documents(spark, docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    again = quality.fit(spark, docs, labels)
    assert all(np.array_equal(a.weights, b.weights) for a, b in zip(quality.fit(spark, docs, labels), again, strict=True))


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(empty(spark), quality.fit(spark, empty(spark), none), ["doc_id"]).count() == 0
    one = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = _rows(quality.judged(frame(spark), quality.fit(spark, frame(spark), one), ["doc_id"]))
    assert all(r["kept"] != r["base_failed"] for r in rows)


# --- 3: lines ---


def _cleaned(rows, ratio, least):
    pages, total = defaultdict(int), Counter()
    for _, t, s in rows:
        total[s] += 1
        for line in set((t or "").split("\n")) if t is not None else ():
            if words(line):
                pages[s, line] += 1
    drop = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    out = Counter()
    for i, t, s in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if (s, x) not in drop]
        out[i, s, t if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


@pytest.mark.parametrize("few", [10_000, 0])
def test_line_dedup(spark, few):
    rows = [(i, f"{t}\nshare this page\n\n menu" if i and i % 2 and t is not None else t, s) for i, t, s in documents()]
    df = frame(spark, rows)
    df = df.withColumns({c: F.lit(1) for c in ("_n_lines", "_n_dropped", "n_lines", "drop", "lines")})
    out = boilerplate.counted(spark, df, max_ratio=0.3, min_pages=4, broadcast_lines=few)
    got = Counter((r["doc_id"], r["source"], r["text"], r["n"], r["d"]) for r in _rows(out.select("row.doc_id", "row.source", "row.text", F.col("n_lines").alias("n"), F.col("n_dropped").alias("d"))))
    assert got == _cleaned(rows, 0.3, 4)
    assert boilerplate.cleaned(spark, empty(spark)).count() == 0
    assert boilerplate.cleaned(spark, df).columns == df.columns


# --- 4: licences ---


def test_licences(spark):
    mit = " ".join(["MIT License", *licences.SENTENCES["mit-grant"], *licences.SENTENCES["mit-condition"]]).replace("MIT License ", "MIT License\n")
    bsd = " ".join(licences.SENTENCES[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    texts = [mit, bsd, f"x\n{bsd} {licences.SENTENCES['bsd-name'][0]}\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0.\ntext", "no licence", None, "", "Licensed under  THE apache license, version 2.0!", "mit license\nmit license"]
    got = {r["doc_id"]: r for r in _rows(licences.scanned(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])))}
    assert [got[i]["licences"] for i in range(9)] == ["MIT", "BSD-2-Clause", "BSD-3-Clause,MIT", "CC-BY-NC-4.0", "", "", "", "Apache-2.0", "MIT"]
    assert got[0]["sentence_ids"] == "mit-title,mit-grant,mit-condition" and got[5]["n_sentences"] == 0
    for name, forms in licences.SENTENCES.items():
        assert len(set(map(licences.normal, forms))) == len(forms), name
    assert {i for _, need in licences.RULES for i in need} <= set(licences.SENTENCES)
    assert licences.scanned(empty(spark)).count() == 0


# --- 5: language model ---


def _tokens(text):
    return [*words(text, low=True), None]


class _Model:
    """The model as its definition has it, over dictionaries of whole n-grams."""

    def __init__(self, texts):
        self.count = Counter(tuple(t[i : i + n]) for t in map(_tokens, texts) for n in (1, 2, 3) for i in range(len(t) - n + 1))
        self.words = {g[0] for g in self.count if len(g) == 1}
        self.total = sum(c for g, c in self.count.items() if len(g) == 1)

    def p(self, word, context):
        if not context:
            return (self.count[word,] + 0.5) / (self.total + 0.5 * (len(self.words) + 1))
        low, seen = self.p(word, context[1:]), self.count[context]
        trust = (seen - 1) / (seen - 1 + backoff.DOUBT) if seen > 1 else 0
        return trust * self.count[(*context, word)] / seen + (1 - trust) * low if trust else low

    def score(self, text):
        t = _tokens(text)
        return sum(math.log10(self.p(w, tuple(t[max(0, i - 2) : i]))) for i, w in enumerate(t))


def _held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


@pytest.mark.parametrize(("block", "part"), [(1 << 20, 1 << 22), (500, 1 << 10)])
def test_scores_match_the_definition(spark, block, part):
    rows = documents()
    model = _Model([t for i, t, _ in rows if not _held(i)])
    got = Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in _rows(backoff.scored(spark, frame(spark), block, part))
    )
    want = Counter()
    for i, t, _ in rows:
        toks = _tokens(t)
        base = sum(math.log10(model.p(w, ())) for w in toks)
        want[i, _held(i), len(toks), sum(model.count[w,] > 0 for w in toks), model.total, round(base, 6), round(model.score(t), 6)] += 1
    assert got == want
    assert backoff.scored(spark, empty(spark)).count() == 0


def test_model_is_a_distribution():
    model = _Model([t for _, t, _ in documents()[:40]])
    contexts = [g for g in model.count if len(g) < 3 and g[-1] is not None][:300]
    for h in [(), *contexts]:
        assert sum(model.p(w, h) for w in model.words) + model.p("never seen", h) == pytest.approx(1, abs=1e-9)


def test_model_tells_repeated_texts_and_beats_the_base(spark):
    rows = documents()[:60]
    rows += [(1000 + i, rows[i][1], "s") for i in range(10)]
    got = {r["doc_id"]: r for r in _rows(backoff.scored(spark, frame(spark, rows))) if not r["held_out"]}
    each = {i: r["score"] / r["n_tokens"] for i, r in got.items()}
    twice = [each[i] for i in each if i >= 1000 and i - 1000 in each]
    once = [each[i] for i in each if 10 <= i < 60]
    assert twice and min(twice) > max(once)
    easy = [(i, "the cat sat on the mat and the dog ran off " * 6 + f"w{i}", "s") for i in range(60)]
    got = [r for r in _rows(backoff.scored(spark, frame(spark, easy))) if r["held_out"]]
    assert got and all(r["score"] > r["base_score"] for r in got)


# --- 7: personal data ---


def test_spans(spark):
    import random
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def plain(text):
        out = []
        for kind, p in patterns.items():
            for m in re.finditer(p, text or ""):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                    out.append(f"{kind}:{m.start()}:{m.end()}")
        return out

    rng = random.Random(2)
    texts = ["".join(rng.choice("aZ9@.-+_% 1().é\n0") for _ in range(rng.randint(1, 50))) for _ in range(300)]
    texts += ["".join(rng.choice("0123456789 -.+()") for _ in range(rng.randint(1, 50))) for _ in range(300)]
    texts += ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.004", "4111 1111 1111 1111", "+1 (456) 555-2186", "9" * 20000, "a" * 30000 + "@b", "é\U0001f600 x@y.zz", None, ""]
    got = privacy.detected(spark, frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).select("doc_id", privacy._listed(privacy.KINDS).alias("spans")).collect()
    assert {r.doc_id: r.spans for r in got} == {i: ",".join(plain(t)) for i, t in enumerate(texts)}


def test_disclosing_terms_and_redaction(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"note {rng.integers(99)} about quibble at joe@corp.org, {rng.integers(99)} now", "s") for i in range(12)]
    rows += [(100 + i, f"ordinary note about now {i}", "s") for i in range(80)] + [(None, None, None), (7, rows[7][1], "s")]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in privacy.detected(spark, df).select("doc_id", privacy._listed(["term"]).alias("t")).collect()}
    text = rows[3][1]
    at = text.index("quibble")
    assert f"term:{at}:{at + 7}" in got[3].t and "note" == text[:4] and not got[3].t.startswith("term:0:4")
    assert got[105].t == "" and got[None].t == ""
    out = privacy.sanitised(spark, df)
    texts = [r.text for r in out.where("doc_id = 3").collect()]
    assert out.columns == df.columns and "[EMAIL]" in texts[0] and "quibble" not in texts[0] and "joe" not in texts[0]
    assert out.count() == len(rows) and out.where("doc_id = 105").first().text == rows[17][1]
    assert privacy.sanitised(spark, empty(spark)).count() == 0


# --- 8: sentencepiece ---


def test_sentencepiece(spark):
    rows = [*documents(), (300, "<s> </s><unk> e.g. a,b ².x\r\n\x00", "s"), (301, " ", "s"), (302, "\n\n", "s"), (303, "▁▁ a  ▁", "s")]
    df = frame(spark, rows)
    library = piecebpe.PieceBPE(public_tokenizers.path(piecebpe.VOCABULARY)).library
    want = Counter()
    for i, t, _ in rows:
        ids = [*library.encode(t or ""), 2]
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in piecebpe.digests(df).collect()) == want
    encoded = piecebpe.encode(df)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((i, (*library.encode(t or ""), 2)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.text) for r in piecebpe.decode(encoded).collect()) == Counter((i, library.decode([*library.encode(t or ""), 2])) for i, t, _ in rows)
    assert piecebpe.digests(empty(spark)).count() == 0


def _digest_batches(monkeypatch, texts):
    """Rows of digests without Spark: what one task does with the batches of 1,000 texts."""
    monkeypatch.setattr(piecebpe, "map_texts", lambda rows, run, schema: run)

    class Docs:
        dtypes = [("doc_id", "bigint")]

        def select(self, *names):
            return self

    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    return [tuple(r.values()) for b in piecebpe.digests(Docs())(table.to_batches(1000)) for r in b.to_pylist()]


def _sentencepiece_rows(library, texts):
    for i, t in enumerate(texts):
        ids = [*library.encode(t or ""), 2]
        yield i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_sentencepiece_looks_up_each_distinct_word_once_per_batch(monkeypatch):
    looked = 0

    class Known(dict):
        def __getitem__(self, key):
            nonlocal looked
            looked += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            nonlocal looked
            looked += 1
            return super().get(key, default)

    rng = random.Random(8)
    texts = [sentence(rng, 100) for _ in range(1000)]
    own = piecebpe.PieceBPE.of(public_tokenizers.path(piecebpe.VOCABULARY))
    monkeypatch.setattr(own, "known", Known())
    got = _digest_batches(monkeypatch, texts)
    assert looked < 2000  # of 140,037 words and marks, 80 are distinct
    assert got == [*_sentencepiece_rows(own.library, texts)]


@pytest.mark.parametrize(("size", "most"), [(4 << 20, 200 << 20), (60, 200 << 20), (1, 1000)])
def test_sentencepiece_cuts_and_slices(monkeypatch, size, most):
    """Words cut out of a batch, slices of any size and a cache that is emptied on the way leave the library's ids."""
    monkeypatch.setattr(piecebpe, "SLICE", size, raising=False)
    monkeypatch.setattr(piecebpe, "MOST_BYTES", most)
    rng = random.Random(9)
    bits = ["a", "Th", "the", " ", " ", "  ", "▁", "▁ ", " ▁", "\n", "\r\n", "\t", ".", ",", "!?", "_", "'s", "-", "é", "e\u0301", "日本", "\U0001f600", "12", "½", "²", "\x00", "\x81", "▀", "</s>", "ﬁ", "\u3000", "\u00a0", "xy" * 80]
    texts = [None, "", " ", "▁", "\n", None, *("".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(1500)), "x" * 5000, ""]
    own = piecebpe.PieceBPE.of(public_tokenizers.path(piecebpe.VOCABULARY))
    assert _digest_batches(monkeypatch, texts) == [*_sentencepiece_rows(own.library, texts)]


@pytest.mark.parametrize("length", [1, 2, 7, 30, 100])
def test_sentencepiece_agenda_in_a_list_and_in_a_heap(length):
    own = piecebpe.PieceBPE.of(public_tokenizers.path(piecebpe.VOCABULARY))
    rng = random.Random(length)
    for _ in range(200):
        part = "".join(rng.choices("aab" if length > 7 else "theionßü日", k=length))
        assert own._short(part) == own._long(part)


# --- 9: near duplicates ---


def _components(rows, percent=75):
    sets = {}
    for i, t, _ in rows:
        w = words(t, low=True)
        sets.setdefault(i, []).append(frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    ids = [i for i in sets if i is not None]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    by_set = {s: find(i) for i in ids for s in sets[i]}
    out = Counter()
    for i, t, _ in rows:
        w = words(t, low=True)
        s = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        c = find(i) if i is not None else by_set.get(s) if s else None
        out[i, len(s), c, i is None or c == i] += 1
    return out


@pytest.mark.parametrize(("block", "most"), [(hyperminhash.BLOCK, hyperminhash.MOST), (3, 4096), (2, 2), (1, 1)])
def test_near_duplicates(spark, block, most):
    rows = documents()
    got = Counter(tuple(r) for r in hyperminhash.near_duplicates(spark, frame(spark), block=block, most=most).collect())
    assert got == _components(rows)


@pytest.mark.parametrize("most", [2, 7])
def test_near_duplicates_in_chained_components(spark, most):
    rng = np.random.default_rng(5)
    rows = []
    for topic in range(6):  # texts that share much with many others, in families of near copies
        base = [f"t{topic}w{i}" for i in range(60)]
        for family in range(4):
            own = [w if rng.random() < 0.96 else f"f{family}{w}" for w in base]
            for copy in range(5):
                rows.append((len(rows), " ".join(w if rng.random() < 0.985 else f"c{copy}{w}" for w in own), "s"))
    got = Counter(tuple(r) for r in hyperminhash.near_duplicates(spark, frame(spark, rows), most=most).collect())
    want = _components(rows)
    assert got == want and 10 < sum(r[3] for r in want) < 100


def test_no_link_is_lost_beyond_the_size_of_all_pairs(spark, monkeypatch):
    """5,000 texts of one candidate component: each differs from the one before it by a run of words, many at exactly 0.75 or just below."""
    rng = np.random.default_rng(12)
    text, texts = [f"w{i}" for i in range(60)], []
    for i in range(5000):
        n, first = int(rng.integers(3, 6)), int(rng.integers(5, 50))  # n words are in n + 4 of 56 shingles: 0.75 for n = 4, 0.72 for n = 5
        text = [f"x{i}n{j}" if first <= j < first + n else w for j, w in enumerate(text)]
        texts.append(" ".join(text))
    ids = rng.permutation(len(texts)).tolist()
    sizes = []
    real = hyperminhash._large
    monkeypatch.setattr(hyperminhash, "_large", lambda spark, own, bands, percent, most: sizes.append(bands.select("rep").distinct().count()) or real(spark, own, bands, percent, most))
    got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(spark, frame(spark, [(i, t, "s") for i, t in zip(ids, texts, strict=True)])).collect()}
    assert sizes == [5000]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    holders, common, links = {}, Counter(), []
    for i, shingles in enumerate(sets):
        for x in shingles:
            common.update((j, i) for j in holders.setdefault(x, []))
            holders[x].append(i)
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        p, q = sorted((find(ids[a]), find(ids[b])))
        up[q] = p
    assert len(links) > 3000 and len(set(map(find, ids))) > 1000
    assert got == {i: find(i) for i in ids}


def test_near_duplicates_edges(spark):
    assert hyperminhash.near_duplicates(spark, empty(spark)).count() == 0
    df = frame(spark)
    kept = hyperminhash.representatives(spark, df)
    df = df.withColumns({c: F.lit(1) for c in ("_gone", "id", "tid", "first", "fp1")})
    kept = hyperminhash.representatives(spark, df)
    # repeated rows of a kept doc_id are one, rows without doc_id stay
    want = Counter({i: n if i is None else 1 for (i, _, _, k), n in _components(documents()).items() if k})
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == want + Counter({None: 1})
    two = frame(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "x y z", "s"), (2, "x  y z", "s"), (2, "x y z", "s")], extra=False)
    assert sorted((r.doc_id, r.text.split()[0]) for r in hyperminhash.representatives(spark, two).collect()) == [(1, "a"), (2, "x")]


def test_estimate_is_close():
    pool = mix(np.arange(3000, dtype=np.uint64))
    a, b = np.unique(pool[:2500]), np.unique(pool[500:])
    x, y = hyperminhash.registers(a)[0], hyperminhash.registers(b)[0]
    assert hyperminhash.similarity_estimate(x, y[None])[0] == pytest.approx(2000 / 3000, abs=0.12)


def test_components_of_chains_and_stars(spark):
    from tidemark.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}


# --- 10: packing ---


def test_byte_bpe_matches_the_library():
    path = public_tokenizers.path(packing.VOCABULARY)
    library = Tokenizer.from_file(path)
    texts = [t or "" for _, t, _ in documents()] + ["'s it's we're'd'd  's\n's", "a  b \n\n c\t", " ", "\x85 x y'll", "<|endoftext|>", "!'s ''s", "hello <|endoftext|> world", "a  <|endoftext|>  b<|endoftext|><|endoftext|>\n", "cut <|endof", "text|> off"]
    got = []
    assert 50256 in library.encode(texts[-4], add_special_tokens=False).ids
    for _, body, at in pieces(pa.array(texts), most=2000):
        ids, edge = ByteBPE.of(path).encode(body, at)
        got += [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark):
    path = public_tokenizers.path(packing.VOCABULARY)
    library = Tokenizer.from_file(path)
    rows = [*documents(), (400, "one <|endoftext|>  two<|endoftext|>", "s")]
    want = Counter()
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        at = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    out = _rows(packing.packed_documents(spark, frame(spark, rows)))
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces_of in bins.values():
        end = 0
        for offset, length in sorted(pieces_of):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in out)
    assert len(bins) <= math.ceil(total / 1024) + 2
    assert packing.packed_documents(spark, empty(spark)).count() == 0
    kept = packing.cut(frame(spark), keep_ids=True).where("doc_id = 93").first()
    assert kept.ids == [*library.encode("one two three", add_special_tokens=False).ids, 2]


def test_sum_of_squares_is_near_the_bound():
    sizes = np.random.default_rng(0).integers(1, 1024, 4000)
    bins, offsets = packing.sum_of_squares(sizes)
    assert bins.max() + 1 <= 1.03 * math.ceil(sizes.sum() / 1024)
    # each placement makes the squared counts smallest among the open gaps that fit
    counts = Counter()
    gap_of = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, b = int(sizes[i]), int(bins[i])
        options = {g: sum(n * n for n in (counts + Counter({g - size: 1 if g > size else 0}) - Counter({g: 1})).values()) for g in counts if g >= size and counts[g] > 0} if len(gap_of) < 150 else None
        gap = gap_of.get(b, 1024)
        if options is not None:
            assert (b not in gap_of and not options) or options[gap] == min(options.values())
        if b in gap_of:
            counts[gap] -= 1
        gap_of[b] = gap - size
        if gap > size:
            counts[gap - size] += 1
        assert offsets[i] == 1024 - gap


def test_lower_is_ascii_only():
    assert lower("ÀB") == "Àb"
