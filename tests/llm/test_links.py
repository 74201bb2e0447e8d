"""Search, quotation links, the pipeline, and queries against their SQL."""

import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.fixtures import frame
from tests.llm.test_text import _cleaned, _components, _counts
from tidemark.llm import boilerplate, covertree, packing, quotes, registry

SMALL = "/root/testdata/sf0.001"


def _plain_top(ids, vectors, queries, k):
    v = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    out = Counter()
    for i in queries:
        score = v @ v[i]
        best = sorted((-int(s), int(ids[j])) for j, s in enumerate(score) if ids[j] != ids[i])[:k]
        for rank, (s, j) in enumerate(best, 1):
            out[int(ids[i]), rank, j, -s] += 1
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_top_k_matches_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    if kind == "clusters":
        x = (rng.normal(size=(6, 8))[rng.integers(0, 6, 700)] * 3 + 0.05 * x).astype(np.float32)
    if kind == "copies":
        x[:400] = x[0]
    ids = np.arange(700) * 10
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    bad = spark.createDataFrame([(3, None), (50, [1.0, None] * 4), (101, [float("nan")] * 8), (None, [1.0] * 8)], "vec_id long, embedding array<float>")
    vectors = covertree.integer_vectors(df.unionByName(bad))
    got = Counter(tuple(r) for r in covertree.top_k(spark, vectors, vectors.where("vec_id % 50 = 0"), pivots=16).collect())
    assert got == _plain_top(ids, x, [i for i in range(700) if ids[i] % 50 == 0], 5)


def test_top_k_edges(spark):
    none = covertree.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert covertree.top_k(spark, none, none).count() == 0
    few = covertree.integer_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0]), (50, [])], "vec_id long, embedding array<float>"))
    got = sorted(tuple(r) for r in covertree.top_k(spark, few, few.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 1, 32768)]


def test_top_k_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(a) for a in rng.integers(-9, 9, 4)]) for i in range(1, 120)]
    rows += [rows[49], rows[49], (50, [9.0, 9.0, 9.0, 9.0]), rows[10], (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as block", "3 as part")
    got = sorted(tuple(r) for r in covertree.top_k(spark, covertree.integer_vectors(df), covertree.integer_vectors(df).where("vec_id % 50 = 0"), pivots=8).collect())
    want = []
    for q in (50, 100):
        own = min(tuple(int(256 * a) for a in v) for i, v in rows if i == q)
        best = sorted((-sum(a * int(256 * b) for a, b in zip(own, v, strict=True)), i) for i, v in rows if i not in (q, None))[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want


@pytest.mark.parametrize("kind", ["clusters", "one vector", "one id", "one row"])
def test_two_levels_of_centres(spark, kind):
    """Cells of more than a block get centres of their own; a third of all rows with one vector, one vec_id or both."""
    rng = np.random.default_rng(11)
    n = 1500
    x = (rng.normal(size=(12, 8))[rng.integers(0, 12, n)] * 3 + 0.2 * rng.normal(size=(n, 8))).astype(np.float32)
    ids = np.arange(n)
    if kind in ("one vector", "one row"):
        x[:500] = x[7]
    if kind in ("one id", "one row"):
        ids[:500] = 77
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    vectors = covertree.integer_vectors(df.repartition(3))
    got = Counter(tuple(r) for r in covertree.top_k(spark, vectors, vectors.where("vec_id % 50 = 0"), pivots=8, block_rows=(16, 24)).collect())
    assert got == _plain_top(ids, x, [i for i in range(n) if ids[i] % 50 == 0], 5)


def test_equal_rows_beyond_k_are_left_out():
    ids, v = [1, 2] * 6 + [3], [[1, 2], [3, 4]] * 5 + [[1, 2], [9, 9], [5, 6]]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(v, pa.list_(pa.int64()))], names=["vec_id", "v"])
    got = Counter((i, tuple(x)) for b in covertree._thinned([batch, batch], 3) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    assert got == {(1, (1, 2)): 3, (2, (3, 4)): 3, (2, (9, 9)): 2, (3, (5, 6)): 2}


def test_search_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (20, 6))
    data = centres[rng.integers(0, 20, 4000)] + rng.integers(-20, 20, (4000, 6))
    seen = []
    real = covertree._bound
    covertree._bound = lambda q, r: seen.append(len(r.rows) * len(q.rows)) or real(q, r)
    try:
        rows, ids, scores = covertree.search(data[:200], np.arange(200) + 10_000, data, np.arange(4000), 5)
    finally:
        covertree._bound = real
    exact = data[:200] @ data.T
    for i in range(200):
        want = sorted((-int(s), j) for j, s in enumerate(exact[i]))[:5]
        assert [(-int(s), int(j)) for s, j in zip(scores[rows == i], ids[rows == i], strict=True)] == want
    assert len(seen) < 200 * 4000 / 100


CHAT = [
    (1, 0, "user", "How do I sort?\nPlease tell."),
    (1, 1, "assistant", "Use sort().\nOr sorted()."),
    (1, 2, "user", "Something else."),
    (1, 3, "user", "> Use sort().\nWhich one?"),
    (1, 4, "assistant", ">> Use sort().\n> which   ONE?\nThe first."),
    (1, 5, "user", "> How do I sort?\n> Please tell.\nMe too."),
    (1, 6, "user", "> nothing known\nHm > 3"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (None, 2, "user", "> x"),
    (3, 5, "user", "> later line"),
    (3, 6, "user", "later line"),
]


def _messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as parent", "2 as thread", "3 as place", "4 as hash", "5 as span")


def test_quotation_links(spark):
    df = _messages(spark, CHAT)
    rows = quotes.linked(spark, df).collect()
    got = {(r.conv_id, r.turn): r for r in rows}
    assert [got[1, t].parent for t in range(7)] == [None, None, None, 1, 3, 0, None]
    order = sorted((k for k in got if k[0] == 1), key=lambda k: (got[k].thread, got[k].place))
    assert [t for _, t in order] == [0, 5, 1, 3, 4, 2, 6]
    assert got[1, 4].text == "The first." and got[1, 6].text == "Hm > 3" and got[2, 0].text is None and got[2, 1].text == ""
    assert got[3, 5].parent is None and len(rows) == len(CHAT)
    assert quotes.linked(spark, df.limit(0)).count() == 0


def test_wrapped_quotes_and_any_turns(spark):
    text = "The quick brown fox jumps over the lazy dog. It was not amused by that at all, and left.\n\nAnother paragraph stands here."
    wrapped = "> The quick brown fox jumps\n> over the lazy dog. It was not amused\n> by that at all, and left.\nReally?"
    part = ">It was not amused by\n> that at all, and left.\nOnly that."
    rows = [(1, -20, "u", text), (1, -3, "u", wrapped), (1, 10**11, "u", part), (1, 10**11 + 1, "u", "> > over the lazy dog. It was not amused\n> Really?\nYes.")]
    got = {r.turn: r for r in quotes.linked(spark, _messages(spark, rows)).collect()}
    assert [got[t].parent for t in (-20, -3, 10**11, 10**11 + 1)] == [None, -20, -20, -3]
    assert sorted(got, key=lambda t: (got[t].thread, got[t].place)) == [-20, -3, 10**11 + 1, 10**11]


def test_a_message_that_everyone_answers(spark):
    """Answers over many ranges of turns, with gaps between them, keep the order of their turns."""
    turns = [t for t in range(1, 9000) if t % 3 and not 2000 < t < 7000]
    rows = [(1, 0, "user", "What now?")] + [(1, t, "user", f"> What now?\nAnswer {t}.") for t in turns]
    got = {r.turn: (r.parent, r.thread, r.place) for r in quotes.linked(spark, _messages(spark, rows)).collect()}
    assert got == {0: (None, 0, 0)} | {t: (0, 0, i) for i, t in enumerate(turns, 1)}


def test_long_reply_chain(spark):
    rows = [(1, 0, "u", "line 0"), *((1, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 40))]
    got = {r.turn: (r.thread, r.place) for r in quotes.linked(spark, _messages(spark, rows)).collect()}
    assert got == {i: (0, i) for i in range(40)}


def _many(seed):
    """Conversations whose messages quote earlier ones, in part, wrapped anew, nested, or make quotes up."""
    import random
    import textwrap

    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.choice([3, 10, 40])):
            own = " ".join(f"w{rng.randint(0, 400)} x{conv} says so{rng.choice('.!?,')}" for _ in range(rng.randint(1, 6)))
            text = own if rng.random() < 0.4 else "\n".join(textwrap.wrap(own, 30))
            if said and rng.random() < 0.7:
                other = rng.choice(said)[-1 if rng.random() < 0.5 else 0]
                lines = textwrap.wrap(" ".join(other.split()), rng.choice([25, 40, 200])) if rng.random() < 0.5 else other.split("\n")
                lines = lines[: rng.randint(1, len(lines))]
                text = "\n".join((">" if rng.random() < 0.5 else "> ") + x for x in lines) + rng.choice(["\n", "\n\n"]) + text
            if rng.random() < 0.1:
                text = "> common line\n" + text
            said.append((text, own))
            rows.append((conv, turn * 700 - 2000, "u", text))
    return rows + rows[:3]


@pytest.mark.parametrize("rows", [[r for r in CHAT if r[0] is not None], _many(1), _many(2)])
def test_quotation_links_match_sql(spark, rows):
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = Counter((a, b, c, p if p != -1 else None, *x) for a, b, c, p, *x in db.execute("select conv_id, turn, role, parent, thread, place, text from (" + registry.ORACLES["op6_quotation_links"] + ")").fetchall())
    got = Counter(tuple(r) for r in quotes.linked(spark, _messages(spark, rows)).collect())
    assert got == want
    assert len(rows) < 50 or sum(n for r, n in got.items() if r[3] is not None) > len(rows) / 4


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    found = db.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    got = registry.QUERIES[name](spark, SMALL)
    columns = sorted(names)
    assert sorted(got.columns) == columns
    # row by row, as pandas has no one form for whole numbers with nulls
    want = sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == want


def test_pipeline_stages(spark):
    """Each stage over all rows of the one before, against plain versions of what it keeps and changes."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "PII", "best-fit packing"]
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, seen = source, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        if name != "best-fit packing":
            assert docs.columns == source.columns
        docs = docs.cache()
        seen.append([r.asDict() for r in docs.collect()])
    rows = [[(r["doc_id"], r["text"], r["source"]) for r in x] for x in seen[:4]]
    raw = {r.doc_id: r.text for r in source.collect()}
    # quality: counts by their definition; the classifier may drop more, but keeps most of the good
    passed = {i for i, t in raw.items() if (c := _counts(t))[0] >= 50 and 2 * c[4] <= c[0]}
    good = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1 and toxic = 0").collect()} & passed
    kept = {i for i, _, _ in rows[0]}
    assert kept <= passed and len(good & kept) >= 0.95 * len(good) and all(raw[i] == t for i, t, _ in rows[0])
    # lines and near copies
    assert Counter(rows[1]) == Counter({(i, t, s): n for (i, s, t, *_), n in _cleaned(rows[0], boilerplate.MAX_RATIO, boilerplate.MIN_PAGES).items()})
    assert {i for i, _, _ in rows[2]} == {i for i, _, _, k in _components(rows[1]) if k} and set(rows[2]) <= set(rows[1]) and len(rows[2]) < len(rows[1])
    # personal data: what the patterns find is gone, and texts without entities stay as they are
    before = {i: t for i, t, _ in rows[2]}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert [i for i, _, _ in sorted(rows[3])] == sorted(before) and not any(email.search(t) for _, t, _ in rows[3])
    assert any(email.search(t) for t in before.values())
    assert all(t == before[i] for i, t, _ in rows[3] if not re.search("[0-9=:@]", before[i]))
    # packing: all tokens of all texts, in sequences
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    length = Counter()
    for r in seen[4]:
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows[3]}


def test_pipeline_keeps_what_stages_may_not_touch(spark):
    df = frame(spark, extra=True)
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.pii, corpus_pipeline.near_dedup):
        assert stage(spark, df, SMALL).columns == df.columns


def test_pipeline_takes_columns_of_any_name_and_empty_tables(spark, tmp_path):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, docs in (("odd", small.withColumns({"odd name": F.lit(1), "a.b": F.lit("x"), "x:y": F.struct(F.lit(2).alias("p.q"))})), ("none", small.where("false"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        columns = docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == columns
            docs.write.parquet(f"{tmp_path}/{name}/{_}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{_}")
        assert (docs.count() > 20) == (name == "odd")
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
