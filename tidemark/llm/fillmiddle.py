"""Fill-in-the-middle training texts, made by DuckDB SQL over Arrow batches.

A text is cut into units: runs of other characters with the white space in front of them, and white space at the
end. Two cuts between units give prefix, middle and suffix. Cuts and form follow from SHA-256 of ``seed:doc_id``, so a
row gets the same result in every run, on every executor and whatever rows lie beside it:

* plain: the text itself, for ``100 - rate`` of 100 ids, for empty texts, and for texts that hold one of ``MARKS``,
* spm (``spm_rate`` of 100 of the others): ``<S>suffix<P>prefix<M>middle``,
* psm: ``<P>prefix<S>suffix<M>middle``.

Each task has one in-memory DuckDB connection with one thread, and hands it whole texts of about ``BATCH_BYTES`` at a
time (one text may be longer); no row is touched by Python. As no text with a mark is rewritten, and no mark can
arise where two parts meet, marks cut an output back into its parts.

Null texts are empty: no units, plain. A null id hashes as an empty one. Rows are independent of each other, so repeated
rows get equal results and ties do not arise. Bytes that are not UTF-8 become U+FFFD first. Other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import map_texts, table
from tidemark.llm.words import raw

SEED, RATE, SPM_RATE = 42, 50, 80
MARKS = ("<P>", "<S>", "<M>")
BATCH_BYTES = 4 << 20
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: No spill files: an executor's own disk is not ours, and a batch is bounded.
SETTINGS = {"threads": 1, "memory_limit": "1GB", "temp_directory": ""}

_P, _S, _M = (f"'{m}'" for m in MARKS)

#: parts: doc_id, n, form, prefix, middle, suffix, output of the rows of ``batch`` (doc_id, text).
PARTS = f"""
WITH hashed AS (SELECT doc_id, text, sha256($seed || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch),
cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '{UNITS}') AS units,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS UBIGINT)) AS h FROM hashed),
placed AS (
  SELECT doc_id, text, units, len(units) AS n, CAST(least(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS a, CAST(greatest(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS b,
    CASE WHEN text = '' OR contains(text, {_P}) OR contains(text, {_S}) OR contains(text, {_M}) OR h[3] % 100 >= $rate THEN 'plain'
         WHEN h[4] % 100 < $spm_rate THEN 'spm' ELSE 'psm' END AS form FROM cut),
parted AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, a), '') AS prefix,
    array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM placed),
parts AS (
  SELECT doc_id, n, form, prefix, middle, suffix,
    CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {_P} || prefix || {_S} || suffix || {_M} || middle
              ELSE {_S} || suffix || {_P} || prefix || {_M} || middle END AS output FROM parted)"""


def _restored(output: str = "output", form: str = "form") -> str:
    """The text that an output was made of, from the output and its form alone."""

    def between(first: str, last: str) -> str:
        begin = f"(strpos({output}, {first}) + {len(MARKS[0])})"
        return f"substring({output}, {begin}, strpos({output}, {last}) - {begin})"

    middle = f"substring({output}, strpos({output}, {_M}) + {len(MARKS[2])})"
    return f"""CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN {between(_P, _S)} || {middle} || {between(_S, _M)}
      ELSE {between(_P, _M)} || {middle} || {between(_S, _P)} END"""


_CHARS = "CASE WHEN form <> 'plain' THEN length({0}) END AS {0}_chars"


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``BATCH_BYTES`` of text."""
    _, at = raw(batch.column(text))
    row = 0
    while row < len(batch):
        end = max(row + 1, int(np.searchsorted(at, at[row] + BATCH_BYTES, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def _queried(rows: DataFrame, text: int, sql: str, schema: str, **values) -> DataFrame:
    """The result of DuckDB's ``sql`` over ``batch``, batch by batch; column ``text`` holds the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config=SETTINGS)
        try:
            for batch in batches:
                for some in _slices(batch, text):
                    con.register("batch", pa.Table.from_batches([some]))
                    yield from con.sql(sql, params=values).to_arrow_table().to_batches()
                    con.unregister("batch")
        finally:
            con.close()

    return map_texts(rows, run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.make_valid_utf8("text"), F.lit("")).alias("text"))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null where plain) and output of every row."""
    parts = ", ".join(f"CASE WHEN form <> 'plain' THEN {c} END AS {c}" for c in ("prefix", "middle", "suffix"))
    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix string, middle string, suffix string, output string"
    return _queried(_texts(docs), 1, f"{PARTS} SELECT doc_id, n, form, {parts}, output FROM parts", shape, seed=str(seed), rate=rate, spm_rate=spm_rate)


def restored(made: DataFrame) -> DataFrame:
    """doc_id, text of rows with doc_id, form and output."""
    shape = f"doc_id {dict(made.dtypes)['doc_id']}, text string"
    return _queried(made.select("doc_id", "form", "output"), 2, f"SELECT doc_id, {_restored()} AS text FROM batch", shape)


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, without moving outputs out of the tasks."""
    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    sql = f"{PARTS} SELECT doc_id, n, form, {_CHARS.format('prefix')}, {_CHARS.format('middle')}, sha256(output) AS output_sha256, sha256({_restored()}) AS restored_sha256 FROM parts"
    return _queried(_texts(docs), 1, sql, shape, seed=str(seed), rate=rate, spm_rate=spm_rate)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: Cuts by characters counted over the units' lengths; the text itself stands for what is restored.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, list_transform(regexp_extract_all(text, '[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+$'), lambda x: length(x)) AS words,
    list_transform(regexp_extract_all(text, '[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+'), lambda x: length(x)) AS sizes,
    ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM t),
c AS (
  SELECT *, len(words) AS n, least(h1 % (len(words) + 1), h2 % (len(words) + 1)) AS a, greatest(h1 % (len(words) + 1), h2 % (len(words) + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, text, n, form, CAST(coalesce(list_sum(sizes[1:a]), 0) AS BIGINT) AS pc, CAST(coalesce(list_sum(sizes[a + 1:b]), 0) AS BIGINT) AS mc FROM c),
q AS (SELECT *, substring(text, 1, pc) AS pre, substring(text, pc + 1, mc) AS mid, substring(text, pc + mc + 1) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN pc END AS prefix_chars, CASE WHEN form <> 'plain' THEN mc END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM q
"""
