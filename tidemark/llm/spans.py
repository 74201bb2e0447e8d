"""Places of pattern matches in texts and texts with places rewritten, with DataFrame functions only.

Both go over the matches in chunks of ``CHUNK``: the work inside a chunk is bounded, and what is carried from
chunk to chunk is one number each, so a text of many matches takes few passes over itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches, as an array of strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda, an expression would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def _chunks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)).cast("int"), F.lit(CHUNK)), lambda i: F.slice(items, i + 1, F.lit(CHUNK)))


def _before(numbers: Column, total: Callable[[Column], Column]) -> Column:
    """For each place of an array, ``total`` of the numbers in front of it (0 for the first)."""
    return F.transform(numbers, lambda _, i: F.when(i == 0, F.lit(0)).otherwise(total(F.slice(numbers, F.lit(1), F.greatest(i, F.lit(1))))))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def places(text: Column, pattern: str, matches: Column) -> Column:
    """array<struct<start, end, value>> of ``matches`` (``found`` of the same text and pattern), in code points, end exclusive.

    Splitting at the pattern gives the text between matches, so the lengths of both add up to places.
    """
    kind = "array<struct<start:int,end:int,value:string>>"
    between = F.split(text, pattern, -1)
    sized = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda gap, value: F.struct(F.length(gap).alias("gap"), F.length(value).alias("size"), value.alias("value")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value")))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], one.cast(kind)).alias("out"))

    def moved(chunk: Column, by: Column) -> Column:
        return F.transform(chunk, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["value"].alias("value")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    parts = let(sized, lambda items: F.transform(_chunks(items), lambda chunk: F.aggregate(chunk, first, add)))
    whole = let(parts, lambda p: F.flatten(F.zip_with(F.transform(p, lambda x: x["out"]), _before(F.transform(p, lambda x: x["at"]), _sum), moved)))
    return F.when(F.size(matches) > 0, whole.cast(kind)).otherwise(F.array().cast(kind))


def rewritten(text: Column, marks: Column, by: Callable[[Column, Column, Column], Column]) -> Column:
    """``text`` with each of ``marks`` (sorted by start; start, end and more) replaced by ``by(mark, begin, end)``.

    begin and end bound what no earlier mark has covered; they are equal where nothing is left of it.
    """

    def one(segment: Column, base: Column, chunk: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin, end = F.greatest(x["start"], acc["at"]), F.greatest(x["end"], acc["at"])
            piece = F.concat(F.substring(segment, acc["at"] - base + 1, begin - acc["at"]), by(x, begin, end))
            return F.struct(end.alias("at"), F.concat(acc["out"], piece).alias("out"))

        start = F.struct(base.alias("at"), F.lit("").alias("out"))
        return F.aggregate(chunk, start, step, lambda acc: F.concat(acc["out"], F.substring(segment, acc["at"] - base + 1, F.length(segment))))

    def joined(chunks: Column) -> Column:
        ends = F.transform(chunks, lambda chunk: F.array_max(F.transform(chunk, lambda x: x["end"])))
        # each chunk rewrites the text from where earlier marks end to where its own last one does
        starts = _before(ends, F.array_max)

        def rest(begins: Column) -> Column:
            def at(chunk: Column, i: Column) -> Column:
                base = begins[i]
                upto = F.when(i + 1 < F.size(begins), F.element_at(begins, F.least(i + 2, F.size(begins)))).otherwise(F.length(text))
                return let(F.struct(F.substring(text, base + 1, upto - base).alias("text"), base.alias("base")), lambda s: one(s["text"], s["base"], chunk))

            return F.array_join(F.transform(chunks, at), "")

        return let(starts, rest)

    return F.when(F.size(marks) > 0, let(marks, lambda items: let(_chunks(items), joined))).otherwise(text)
