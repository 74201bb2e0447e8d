"""Cases in which an operator once did less than its whole job."""

import math
import random
import re
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex

from tests.llm.fixtures import frame, lower, sentence
from tidemark.llm import backoff, hyperminhash, licences, privacy, quality

# --- 9: near duplicates ---


@pytest.mark.parametrize(("union", "shared"), [(4, 3), (6, 5), (8, 6), (12, 9), (20, 15), (50, 38), (100, 75), (400, 300), (1000, 750)])
def test_bands_find_sets_of_all_sizes(union, shared):
    rng = np.random.default_rng(union)
    for _ in range(1000):
        x = rng.integers(0, 1 << 64, union, dtype=np.uint64)
        cut = shared + (union - shared) // 2
        a, b = np.sort(x[:cut]), np.sort(np.concatenate([x[:shared], x[cut:]]))
        assert (hyperminhash.band_keys(hyperminhash.registers(a)[0]) == hyperminhash.band_keys(hyperminhash.registers(b)[0])).any()


def test_short_near_duplicates_are_linked(spark):
    rows, want = [], {}
    for k in range(160):
        union = (8, 20, 50, 100)[k % 4]
        common = -(-3 * union // 4)
        half = (union - common) // 2
        base = [f"w{k}x{i}" for i in range(common + 4)]
        for side, more in ((0, half), (1, union - common - half)):
            rows.append((2 * k + side, " ".join([*base, *(f"s{side}k{k}x{i}" for i in range(more))]), "s"))
            want[2 * k + side] = 2 * k  # common of union shingles are equal, so brute force links the two
    got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(spark, frame(spark, rows)).collect()}
    assert got == want


# --- 2: quality ---


def test_quality_on_held_out_labels(spark):
    small = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    heads = quality.fit(spark, docs, labels.where("doc_id % 3 <> 0"))
    got = quality.judged(docs, heads, ["doc_id"]).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert len(got) > 100
    assert ((got.p_quality >= 0.5) == (got.quality == 1)).mean() > 0.9
    assert ((got.p_toxic >= quality.MAX_TOXIC) == (got.toxic == 1)).mean() > 0.9


def test_training_rows_are_bounded(spark):
    rows = [(i % 20, f"word{i % 20} " * (i % 7 + 1) + ("good" if i % 2 else "bad"), "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    seen = []
    real = quality.fit_head
    quality.fit_head = lambda flat, edge, y, default: seen.append((len(flat), len(y))) or real(flat, edge, y, default)
    try:
        for grams in (quality.TRAIN_GRAMS, 200):
            quality.fit(spark, frame(spark, rows), labels, train_grams=grams)
        quality.fit(spark, frame(spark, rows), labels, train_rows=5)
    finally:
        quality.fit_head = real
    whole, few, five = seen[0], seen[2], seen[4]
    assert whole[1] == 20 and 0 < few[1] < 20 and few[0] <= 200 and five[1] == 5


# --- 7: personal data ---


def _plain_terms(rows):
    """Spans of disclosing terms by their definition."""
    texts = {t or "" for _, t, _ in rows}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    named = regex.compile(r"(?<![\p{L}\p{N}_])(" + "|".join(privacy.NAMES) + r")[\x22\x27]?[\x20\t]*[=:]")

    def keys(word):
        word = word.lower()
        mixed = len(word) >= 8 and regex.search("[0-9]", word) and regex.search(r"\p{L}", word)
        return [word, ("#hex" if regex.fullmatch("[0-9a-f]+", word) else "#mix") + str(len(word))] if mixed else [word]

    entities, places, words = {}, {}, {}
    for text in texts:
        found = [(k, m) for k, p in patterns.items() for m in regex.finditer(p, text)]
        entities[text] = {f"{k}:{m[0].lower()}" for k, m in found} | {f"name:{m[1]}" for m in named.finditer(text.lower())}
        masked = list(text)
        for _, m in found:
            masked[m.start() : m.end()] = "\uffff" * len(m[0])
        runs = [m for m in regex.finditer(r"[\p{L}\p{N}\uffff]+", "".join(masked)) if len(m[0]) >= 3 and "\uffff" not in m[0]]
        places[text] = [(m.start(), m.end(), m[0]) for m in runs]
        words[text] = {k for _, _, w in places[text] for k in keys(w)}
    n_t, n_e, n_te = Counter(), Counter(), Counter()
    for text in texts:
        n_t.update(words[text])
        n_e.update(entities[text])
        n_te.update((e, w) for e in entities[text] for w in words[text])
    out = {}
    for text in texts:
        spans = []
        for a, b, w in places[text]:
            best = 0.0
            for e in entities[text]:
                for k in keys(w):
                    n = n_te[e, k]
                    if n >= privacy.SUPPORT:
                        pmi = math.log2(len(texts) * n / (n_t[k] * n_e[e])) * n / (n + 1)
                        best = max(best, pmi / max(math.log2(len(texts) / n_e[e]), 1e-9))
            if best >= privacy.GENERALISE:
                spans.append((a, b, best >= privacy.REMOVE))
        out[text] = spans
    return out


def test_terms_match_their_definition(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        parts = [f"common{rng.randint(0, 30)}" for _ in range(rng.randint(3, 12))]
        person = rng.randint(0, 40)
        if person < 12:
            parts += [f"p{person}@mail.example.com", f"nick{person}", f"Street{person % 5}"]
        if person in (3, 13, 14, 15):
            parts += ["token = " + "".join(rng.choice("0123456789abcdef") for _ in range(24)), "api_key: " + "".join(rng.choice("XYZ0123") for _ in range(12)) + "Q7"]
        if person > 35:
            parts += [f"10.0.0.{person}", f"host{person}"]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), "s"))
    rows += [rows[3], (500, None, "s"), (501, "", "s")]
    got = privacy.detected(spark, frame(spark, rows)).select("doc_id", "term").collect()
    want = _plain_terms(rows)
    texts = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows) and {r.doc_id for r in got} == set(texts)
    for r in got:
        assert [(x.start, x.end, x.removed) for x in r.term] == want[texts[r.doc_id]]
    removed = {texts[r.doc_id][x.start : x.end] for r in got for x in r.term}
    assert any(len(x) == 24 for x in removed) and any(x.startswith("nick") for x in removed) and not any(x.startswith("common") for x in removed)


def test_long_texts_of_many_matches(spark):
    text = " ".join(f"u{i}@x.org é 10.0.{i % 300}.1 +1 (456) 555-{i:04d}" for i in range(3000))
    assert len(text) > 100_000
    got = privacy.detected(spark, frame(spark, [(1, text, "s")])).select("email", "ip", "phone").first()
    want = [(m.start(), m.end()) for m in regex.finditer(r"u[0-9]+@x\.org", text)]
    assert [(x.start, x.end) for x in got.email] == want
    assert len(got.ip) == sum(i % 300 <= 255 for i in range(3000)) and len(got.phone) == 3000
    out = privacy.sanitised(spark, frame(spark, [(1, text, "s")])).first().text
    assert out == " ".join(f"[EMAIL] é {'[IP]' if i % 300 <= 255 else f'10.0.{i % 300}.1'} [PHONE]" for i in range(3000))


def test_terms_disclose_anywhere_in_a_text(spark):
    far = "plain filler words " * 40
    rows = [(i, f"Quibble {i} {far} joe@corp.org, 10.0.0.{i} {far} x quibble", "s") for i in range(2)]
    rows += [(10 + i, f"{far} ordinary {i}", "s") for i in range(40)] + [(60, "quibble alone, twice quibble", "s"), (61, f"amy@corp.org {far} once", "s")]
    df = frame(spark, rows)
    got = {r.doc_id: r.t for r in privacy.detected(spark, df).select("doc_id", privacy._listed(["term"]).alias("t")).collect()}
    for i in range(2):
        text = rows[i][1]
        assert got[i] == f"term:0:7,term:{len(text) - 7}:{len(text)}"
    assert not any(got[i] for i in got if i > 1)
    texts = {r.doc_id: r.text for r in privacy.sanitised(spark, df).collect()}
    assert "uibble" not in texts[0] and texts[60] == rows[-2][1]


# --- 4: licences ---


def _licence_files(mark, width):
    need = [
        ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
        ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"]),
        ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
        ("GPL-3.0", ["gpl-program", "gpl3-redistribute", "gpl-hope", "gpl-implied", "gpl-details"]),
        ("GPL-2.0", ["gpl-program", "gpl2-redistribute", "gpl2-version", "gpl-hope"]),
        ("LGPL-2.1", ["lgpl-library", "lgpl21-redistribute", "lgpl21-version"]),
        ("AGPL-3.0", ["gpl-program", "agpl-redistribute"]),
        ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy", "apache-warranty", "apache-see"]),
        ("ISC", ["isc-grant"]),
        ("Unlicense", ["unlicense", "unlicense-free"]),
        ("Zlib", ["zlib-warranty", "zlib-grant"]),
        ("GPL-3.0 WITH GCC-exception-3.1", ["gpl-program", "gpl3-redistribute", "gpl-hope", "gpl-implied", "gpl-details", "gcc-exception"]),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-program", "gpl2-redistribute", "gpl2-version", "gpl-hope", "gpl-implied", "gpl-details", "classpath-exception"]),
        ("CDDL-1.0", ["cddl-form", "apache-comply"]),
        ("Apache-2.0 OR MIT", ["apache-or-mit"]),
    ]
    rows = []
    for i, (_, keys) in enumerate(need):
        sentences = [licences.SENTENCES[key][-1 if key == "apache-copy" else 1 if key == "apache-notice" else 0] for key in keys]
        for k, together in enumerate((True, False)):
            lines = ["Copyright 2020 A. Person", ""]
            paragraphs = [" ".join(sentences)] if together else sentences
            for x in paragraphs:
                lines += [*textwrap.wrap(x, width), ""]
            rows.append((2 * i + k, "\n".join(mark + x for x in lines), "s"))
    form = licences.SENTENCES["mpl-form"][0] + " 2.0. " + licences.SENTENCES["mpl-copy"][0]
    rows.append((98, "\n".join(mark + x for x in textwrap.wrap(form, width)), "s"))
    fsf = "Copyright (C) Free Software Foundation, Inc. <https://fsf.org/>\n" + licences.SENTENCES["gnu-verbatim"][0]
    bodies = [
        ("Apache-2.0", f"Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\n{licences.SENTENCES['apache-body'][0]}\n\n1. Definitions."),
        ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n{fsf}\n\nPreamble\n\n{licences.SENTENCES['gpl3-preamble'][0]}"),
        ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n{fsf}\n\nPreamble"),
        ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\n{fsf}\n\nPreamble\n\n{licences.SENTENCES['agpl-preamble'][0]}"),
        ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n{fsf}\n\n{licences.SENTENCES['lgpl3-body'][0]}"),
        ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\n{fsf}"),
        ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"),
        ("EUPL-1.2", "Copyright A. Person\n" + licences.SENTENCES["eupl-notice"][2]),
        ("Artistic-2.0", "The Artistic License 2.0\n\nPreamble"),
        ("MS-PL", "Microsoft Public License (Ms-PL)\n\nThis license governs use of the accompanying software. If you use it, you accept it."),
        ("Apache-2.0 OR MIT", "SPDX-License-Identifier: MIT OR Apache-2.0\ncode"),
    ]
    rows += [(200 + i, "\n".join(mark + x for x in text.split("\n")), "s") for i, (_, text) in enumerate(bodies)]
    rows.append((99, f"{mark}MIT License\n{mark}some text\n{mark}SPDX-License-Identifier: BSD-3-Clause\n", "s"))
    want = {2 * i + k: name for i, (name, _) in enumerate(need) for k in (0, 1)} | {98: "MPL-2.0", 99: "MIT,BSD-3-Clause"}
    want |= {200 + i: name for i, (name, _) in enumerate(bodies)}
    return rows, want


@pytest.mark.parametrize(("mark", "width"), [("", 72), ("# ", 78), (" * ", 70)])
def test_licence_files(spark, mark, width):
    rows, want = _licence_files(mark, width)
    got = {r.doc_id: r.licences for r in licences.scanned(frame(spark, rows)).collect()}
    assert got == want
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", rows)
    sql = {i: x for i, x in db.execute("select doc_id, licences from (" + licences.ORACLE + ")").fetchall()}
    assert sql == want


# --- 5: language model ---


def test_scores_do_not_depend_on_how_files_are_split(spark, tmp_path):
    rows = [(i, f"{sentence(random.Random(i % 40), 30 + i % 50)} only{i}", "s") for i in range(3000)]
    frame(spark, rows).coalesce(2).write.option("parquet.block.size", 20_000).option("parquet.page.size", 2_000).option("parquet.page.row.count.limit", 100).parquet(f"{tmp_path}/docs")
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism")
    before = {c: spark.conf.get(c, None) for c in sizes}

    def split(most, parallelism):
        for c, value in zip(sizes, (most, "1k", parallelism), strict=True):
            spark.conf.set(c, value)
        return spark.read.parquet(f"{tmp_path}/docs").rdd.getNumPartitions()

    try:
        want = None
        for first, then in ((("1g", "1"), ("1g", "1")), (("1g", "1"), ("11k", "8")), (("11k", "8"), ("1g", "1")), (("17k", "3"), ("29k", "2"))):
            before_call = split(*first)
            found = backoff.scored(spark, spark.read.parquet(f"{tmp_path}/docs"), 20_000, 4000, from_files=True)
            assert (split(*then) == before_call) == (first == then)
            got = sorted(tuple(r) for r in found.collect())
            assert want is None or [r[:5] for r in got] == [r[:5] for r in want]
            assert want is None or np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=0, atol=1e-9)
            want = got
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    assert len(want) == 3000


def test_common_entities_and_words_are_paired_as_classes(spark):
    """Two logs with 300 common addresses and 500 common words, and others with different overlaps, against the definition."""
    rng = random.Random(8)
    ips = [f"10.{i // 200}.7.{i % 200 + 1}" for i in range(320)]
    names = [f"host{i}" for i in range(520)]
    rows = [(i, " ".join([*ips[:300], *names[:500], f"own{i}"]), "s") for i in range(2)]
    rows += [(10 + i, " ".join([*rng.sample(ips[300:], 3), *rng.sample(names[490:], 6), "shared words of all"]), "s") for i in range(12)]
    rows += [(40 + i, sentence(rng, 30) + " shared", "s") for i in range(60)]
    want, texts = _plain_terms(rows), {i: t for i, t, _ in rows}
    got = privacy.detected(spark, frame(spark, rows)).select("doc_id", "term").collect()
    assert len(got) == len(rows) and sum(len(r.term) for r in got) > 900
    for r in got:
        assert [(x.start, x.end, x.removed) for x in r.term] == want[texts[r.doc_id]]


def _plain_buckets(text):
    """The buckets of a text's n-grams, in whole-number arithmetic."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def word(w):
        base, power, total = 0x9E3779B97F4A7C15 | 5, 1, 0
        for b in w.encode():
            total, power = total + mix((b + 1) * 0xD1342543DE82EF95 & mask) * power & mask, power * base & mask
        return mix(total)

    def triple(a, b, c):
        start = a * 0x9E3779B97F4A7C15 & mask
        key = (start ^ (start >> 29)) * 0xBF58476D1CE4E5B9 + b * 0x9E3779B97F4A7C15 & mask
        key = (key ^ (key >> 29)) * 0x94D049BB133111EB + c * 0x9E3779B97F4A7C15 & mask
        return (key ^ (key >> 32)) * 0x94D049BB133111EB & mask

    text = lower(text)
    hashes = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    out = {mix(h + 1 & mask) >> 46 for h in hashes}
    for pair in zip(hashes, hashes[1:], strict=False):
        g = 0
        for h in pair:
            g = (g ^ h) * 0x9FB21C651E98DF25 & mask
            g ^= g >> 32
        out.add(mix(g + 2 & mask) >> 46)
    chars = [*map(ord, text)]
    return out | {triple(*t) >> 46 for t in zip(chars, chars[1:], chars[2:], strict=False)}


def test_verdicts_equal_a_plain_version(spark):
    rng = random.Random(6)
    good, bad = "sound careful measured clear prose", "buy now cheap click win"
    rows = [(i, " ".join(rng.choice((good if i % 3 else bad).split()) if rng.random() < 0.3 else sentence(rng, 1) for _ in range(rng.randint(20, 120))) + (" vile insult" if i % 7 == 0 else ""), "s") for i in range(240)]
    rows += [(900, None, "s"), (901, "", "s"), (902, "é ﬁ 日本語 \U0001f600 " * 30, "s")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    heads = quality.fit(spark, docs, labels)
    assert all(len(h.buckets) > 1 for h in heads)
    got = {r.doc_id: r for r in quality.judged(docs, heads, ["doc_id"]).collect()}
    for i, text, _ in rows:
        found = _plain_buckets(text or "")
        p = []
        for head in heads:
            z = head.bias + sum(w for b, w in zip(head.buckets.tolist(), head.weights.tolist(), strict=True) if b in found)
            p.append(1 / (1 + math.exp(-max(-50, min(50, head.slope * z + head.offset)))))
        assert (got[i].p_quality, got[i].p_toxic) == pytest.approx(tuple(p), abs=1e-9)
        assert got[i].kept == (not got[i].base_failed and p[0] >= 0.5 and p[1] < 0.3)
    assert {r.kept for r in got.values()} == {True, False}
    # the heads themselves, from the plain buckets
    known = {r.doc_id: r for r in labels.collect()}
    order = [r.doc_id for r in labels.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h", "doc_id").collect()]
    texts = {i: t for i, t, _ in rows}
    each = [sorted(_plain_buckets(texts[i])) for i in order]
    flat, edge = np.concatenate(each).astype(np.int32), np.cumsum([0, *map(len, each)])
    again = quality.fit_head(flat, edge, np.array([known[i].quality for i in order]), 1.0)
    assert (again.buckets == heads[0].buckets).all() and np.allclose(again.weights, heads[0].weights)
