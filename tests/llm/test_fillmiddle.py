"""Fill-in-the-middle texts against a plain version."""

import hashlib
import re

import duckdb
import pyarrow as pa

from tests.llm.fixtures import documents, empty, frame
from tidemark.llm import fillmiddle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MORE = [
    (200, "a <P> b", "s"),
    (201, "half <P half S> <M ", "s"),
    (202, "<S", "s"),
    (203, "nul\x00 and \U0001f600  line  ", "s"),
    (204, "   ", "s"),
    (205, "<" * 50 + " S> M> P>", "s"),
    *((300 + i, "ends in < " * 3 + "<P " * (i % 3), "s") for i in range(60)),
]


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    assert "".join(units) == text
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, None, text
    if h4 % 100 < 80:
        return n, "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_parts_and_digests(spark, monkeypatch):
    rows = documents() + MORE
    docs = frame(spark, rows)
    want = sorted((d is None, d or 0, *plain(d, t)) for d, t, _ in rows)
    key = lambda r: (r[0], r[1], r[2], r[3], r[7])
    got = fillmiddle.fill_in_middle(docs).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in got), key=key) == sorted(want, key=key)
    assert {r[3] for r in want} == {"plain", "psm", "spm"}
    back = fillmiddle.restored(fillmiddle.fill_in_middle(docs))
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((d or -1, t or "") for d, t, _ in rows)
    digests = sorted(tuple(r) for r in fillmiddle.digests(docs.where("doc_id is not null")).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digests == sorted((d, n, f, p if p is None else len(p), m if m is None else len(m), sha(o), sha(t or "")) for d, t, _ in rows if d is not None for n, f, p, m, _, o in [plain(d, t)])


def test_small_batches_and_sql(spark):
    rows = documents() + MORE
    found = [tuple(r) for r in fillmiddle.digests(frame(spark, rows)).collect()]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])}))
    assert sorted(map(str, con.sql(fillmiddle.ORACLE).fetchall())) == sorted(map(str, found))
    batch = pa.record_batch({"doc_id": [1, 2, 3], "text": ["x" * 10, "", None]})
    real, fillmiddle.BATCH_BYTES = fillmiddle.BATCH_BYTES, 4
    try:
        assert [len(b) for b in fillmiddle._slices(batch, 1)] == [1, 2]
    finally:
        fillmiddle.BATCH_BYTES = real


def test_rates_and_empty(spark):
    docs = frame(spark, [(i, "one two three", "s") for i in range(50)])
    assert {r.form for r in fillmiddle.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fillmiddle.fill_in_middle(docs, rate=100, spm_rate=0).collect()} == {"psm"}
    assert fillmiddle.digests(empty(spark)).count() == 0 and fillmiddle.fill_in_middle(empty(spark)).count() == 0
