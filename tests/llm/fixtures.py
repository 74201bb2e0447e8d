"""Small tables with the hard cases, and plain versions of the definitions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = "the of and to in that was his he it with is for as had you not be her on at by which have or from this him but all she they were my are me one their so an said them we who would been will no when there if more out up into do any your what has man could other than our some very time upon about may its only now little then can should".split()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text, low=False):
    return WORD.findall(lower(text) if low else text or "")


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(seed=1):
    """(doc_id, text, source): prose, exact and near copies, repeated lines, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    out = [(i, "\n".join(sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 6))), f"s{i % 3}") for i in range(60)]
    for i in range(60, 90):
        base = out[rng.randrange(10)][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(VOCABULARY)
        out.append((i, " ".join(base), "s0"))
    out += [(90, None, "s1"), (91, "", None), (92, " \t\n", "s0"), (93, "one two three", "s2"), (94, "ONE two  three", "s2"), (95, sentence(rng, 9000), "s0")]
    out += [(96, "é ﬁ 日本語 ▁x ½ \U0001f600 it's we'll", "s1"), (97, "x" * 5000, "s1"), out[5], out[5], (None, out[3][1], "s0"), (None, None, None)]
    return out


def frame(spark, rows=None, extra=True):
    rows = documents() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    if extra:
        # columns whose names clash with those of results and inner steps
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(7) for c in ("kept", "row", "whole", "rid", "length", "piece", "component", "host", "key", "n_words")})
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
