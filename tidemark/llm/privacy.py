"""Personal data: patterns, and terms that disclose the entities those patterns find.

Base kinds are email addresses, IP addresses, card numbers and phone numbers. Protected entities are their
values and named secrets (``NAMES`` before ``=`` or ``:``, as in ``token = "..."``). A term (a run of
at least three letters and digits, lower case, outside base spans) discloses an entity by their pointwise
mutual information over the corpus, discounted where few texts speak for it,

    PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e))) * n(t, e) / (n(t, e) + 1),   IC(e) = log2(N / n(e)),

with counts of distinct texts: N in all, n(t) with the term, n(e) with the entity and n(t, e) with
both, anywhere in the text. Copies of a document count once. Evidence is gathered for terms by themselves
and, as a secret's value stands in one text only, for the shapes of mixed terms: letters and digits of
one length, apart for hexadecimal ones. A term that meets the entity (itself, or its shape) in at least
``support`` texts with PMI at least ``generalise`` * IC(e) becomes a span at all its places in the
texts that hold the entity; from ``remove`` * IC(e) on it is removed, below that it is generalised to
a placeholder. Base spans always stay and become placeholders. Two rules: texts without the entity
keep the term, as they hold no value that it could disclose; and ``support`` is 2, the least that
tells a link from chance, because in a single text each of its rare words would have the full IC.

Everything is DataFrame functions: words are counted over one text of each group of copies, and only
texts that hold entities meet the telling terms. Entities that stand in exactly the same texts have the same counts with every
term, and so have terms that do: they are counted as one, so that texts with thousands of common entities and words
do not pair each with each; and a pair that could not reach the threshold even if the rarer one never stood alone is not counted. Patterns start only where a run of their characters starts (or where
the last match ended), which finds the same matches as the plain patterns in linear time on long
runs, and texts are rewritten in chunks of matches, so very long texts with many of them are no special case.
Null texts are empty: no spans. Rows with equal doc_id and text get equal spans, null ids
included. Other columns are ignored by the query and kept by ``sanitised``, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import table, written
from tidemark.llm.spans import found, places, rewritten

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"[\p{L}\p{N}]++"
HIDDEN = "\uffff"  # stands for each character of a base span; no character of any language
RUN = r"[\p{L}\p{N}\uffff]++"
SUPPORT, GENERALISE, REMOVE = 2, 0.5, 0.9
#: What secrets are called where they are set.
NAMES = ["access_key", "api_key", "apikey", "credential", "passwd", "password", "private_key", "pwd", "secret", "token"]
NAMED = r"(?<![\p{L}\p{N}_])(" + "|".join(NAMES) + r")[\x22\x27]?[\x20\t]*[=:]"
MIXED_LENGTH = 8  # letters and digits from which on a term with both has a shape


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["value"])


def _tagged(kind: str) -> Column:
    """The spans of one kind with the kind's name in front."""
    return F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))


def _marks(kind: str, by) -> Column:
    return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), by(x).alias("by")))


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, whole (the text, null: empty) and one array of (start, end, value) for each kind."""
    out = docs.select(*keep, F.coalesce("text", F.lit("")).alias("whole"))
    hint = {"email": "@", "phone": "+"}
    for kind in KINDS:
        may = F.contains("whole", F.lit(hint[kind])) if kind in hint else F.col("whole").rlike("[0-9]")
        out = out.withColumn(f"m_{kind}", F.when(may, found(F.col("whole"), PATTERNS[kind])).otherwise(F.array().cast("array<string>")))
    spans = {kind: places(F.col("whole"), PATTERNS[kind], F.col(f"m_{kind}")) for kind in KINDS}
    out = out.select(*keep, "whole", *(spans[kind].alias(kind) for kind in KINDS))
    return out.withColumns({kind: F.filter(kind, _check(kind)) for kind in KINDS})


def _words(matches: Column) -> Column:
    """The distinct terms among matches, lower case, and the shapes of mixed ones."""
    words = F.transform(F.filter(matches, lambda x: (F.length(x) >= 3) & ~F.contains(x, F.lit(HIDDEN))), F.lower)
    return F.array_distinct(F.concat(words, F.transform(F.filter(words, _mixed), _shape)))


def _mixed(word: Column) -> Column:
    return (F.length(word) >= MIXED_LENGTH) & word.rlike("[0-9]") & word.rlike(r"\p{L}")


def _shape(word: Column) -> Column:
    """A name for all mixed terms like this one; no word has its first character."""
    return F.concat(F.when(word.rlike("^[0-9a-f]+$"), "#hex").otherwise("#mix"), F.length(word).cast("string"))


#: Classes of entities and of terms: how many texts, and two fingerprints of which; of terms only those texts that hold entities.
_ENTITY, _TERM = ["e1", "e2", "n_e"], ["w1", "w2", "n_t"]


def _set(key: str, name: str) -> list[Column]:
    """Two fingerprints of a group's set of distinct keys, whatever their order."""
    return [F.bit_xor(F.xxhash64(F.lit(i), key)).alias(f"{name}{i}") for i in (1, 2)]


def detected(spark: SparkSession, docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """rid, doc_id, a span array for each base kind, and ``term``: array of (start, end, removed)."""
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), "text")
    every = F.concat(*map(_tagged, KINDS))
    base = base_spans(own, ["doc_id", "rid", "tid"]).withColumn("every", every)
    spans = F.sort_array(F.transform("every", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    values = F.transform("every", lambda x: F.concat_ws(":", x["kind"], F.lower(x["value"])))
    names = F.transform(F.regexp_extract_all(F.lower("whole"), F.lit(NAMED), F.lit(1)), lambda x: F.concat(F.lit("name:"), x))
    may = F.contains("whole", F.lit("=")) | F.contains("whole", F.lit(":"))
    base = base.withColumn("entities", F.array_distinct(F.concat(values, F.when(may, names).otherwise(F.array().cast("array<string>")))))
    some = F.size("entities") > 0
    masked = rewritten(F.translate("whole", HIDDEN, " "), spans, lambda _, begin, end: F.repeat(F.lit(HIDDEN), end - begin))
    base = base.withColumn("masked", F.when(some, masked))
    # words of a text that stand in its base spans only, which are no terms there
    hidden = F.when(some, F.array_except(_words(found(F.col("whole"), TERM)), _words(found(F.col("masked"), RUN))))
    base = written(base.select("doc_id", "rid", "tid", *KINDS, "entities", "masked", hidden.alias("hidden")), spark)
    held = base.where("masked is not null").dropDuplicates(["tid"]).select("tid", "entities", "masked", "hidden").withColumn("matches", found(F.col("masked"), RUN))
    values = held.select("tid", F.explode("entities").alias("entity"))
    words = held.select("tid", F.explode(_words(F.col("matches"))).alias("word"))
    texts = own.select("tid", F.coalesce("text", F.lit("")).alias("whole")).dropDuplicates(["tid"])
    seen = texts.select(F.explode(_words(found(F.col("whole"), TERM))).alias("word"), F.lit(1).alias("n"))
    unseen = held.select(F.explode("hidden").alias("word"), F.lit(-1).alias("n"))
    spread = seen.unionByName(unseen).groupBy("word").agg(F.sum("n").alias("n_t"))
    total = F.lit(float(own.select("tid").distinct().count()))
    # entities that stand in the same texts, and terms that do, share all counts: each such class is paired once
    entities = values.groupBy("entity").agg(F.count("*").alias("n_e"), *_set("tid", "e")).where(F.col("n_e") >= support)
    terms_ = words.groupBy("word").agg(F.count("*").alias("n_h"), *_set("tid", "w")).where(F.col("n_h") >= support)
    # written, so that all texts are counted once for its two uses below
    terms_ = written(terms_.join(spread, "word").select("word", *_TERM), spark)
    one = terms_.groupBy(*_TERM).agg(F.min("word").alias("word"))
    held_entities = values.join(entities.groupBy(*_ENTITY).agg(F.min("entity").alias("entity")), "entity").select("tid", *_ENTITY)
    pairs = held_entities.join(words.join(one, "word").select("tid", *_TERM), "tid")
    evidence = F.log2(total / F.col("n_e"))

    def pmi(joint: Column) -> Column:
        return F.log2(total * joint / (F.col("n_t") * F.col("n_e"))) * joint / (joint + 1)

    # no more texts can hold both than hold the rarer one; most pairs of an entity and a frequent word end here
    pairs = pairs.where(pmi(F.least("n_t", "n_e")) >= generalise * evidence - 1e-9)
    joint = pairs.groupBy(*_ENTITY, *_TERM).agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    ratio = pmi(F.col("n_te")) / F.greatest(evidence, F.lit(1e-9))
    telling = joint.withColumn("ratio", ratio).where(F.col("ratio") >= generalise).select(*_ENTITY, *_TERM, "ratio")
    hits = pairs.join(telling, [*_ENTITY, *_TERM]).groupBy("tid", *_TERM).agg((F.max("ratio") >= remove).alias("removed"))
    hits = hits.join(terms_, _TERM).select("tid", "word", "removed")
    gaps = F.slice(F.split("masked", RUN, -1), F.lit(1), F.size("matches"))
    sized = F.zip_with(gaps, "matches", lambda gap, value: F.struct((F.length(gap) + F.length(value)).alias("step"), value.alias("value")))
    end = F.sum("t.step").over(Window.partitionBy("tid").orderBy("place")).cast("int")
    placed = held.select("tid", F.posexplode(sized).alias("place", "t")).select("tid", F.lower("t.value").alias("term"), (end - F.length("t.value")).alias("start"), end.alias("end"))
    placed = placed.select("tid", "start", "end", F.explode(F.when(_mixed(F.col("term")), F.array("term", _shape(F.col("term")))).otherwise(F.array("term"))).alias("word"))
    once = placed.join(hits, ["tid", "word"]).groupBy("tid", "start", "end").agg(F.max("removed").alias("removed"))
    # written, so that the join with many copies of one text is one of two shuffles, which adaptive execution splits
    terms = written(once.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("term")), spark)
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    return base.select("doc_id", "rid", "tid", *KINDS).join(terms, "tid", "left").withColumn("term", F.coalesce("term", none)).drop("tid")


def _listed(kinds: list[str]) -> Column:
    def one(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*map(one, kinds)), ",")


def sanitised(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with spans replaced in ``text``; null texts stay null."""
    tag = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
    spans = detected(spark, docs).where(F.size(F.concat(*(F.transform(k, lambda x: x["start"]) for k in [*KINDS, "term"]))) > 0).dropDuplicates(["rid"])
    marks = [_marks(kind, lambda _, kind=kind: F.lit(tag[kind])) for kind in KINDS]
    marks.append(_marks("term", lambda x: F.when(x["removed"], "").otherwise("[TERM]")))
    spans = spans.select("rid", F.sort_array(F.concat(*marks)).alias("marks"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("whole"), F.xxhash64("doc_id", "text").alias("rid"))
    changed = rewritten(F.col("whole"), F.col("marks"), lambda x, begin, _: F.when(begin == x["start"], x["by"]).otherwise(""))
    return rows.join(spans, "rid", "left").select(
        *(F.when(F.col("marks").isNull(), F.col("whole")).otherwise(changed).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns)
    )


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = detected(spark, table(spark, sf_dir, "documents"))
    return spans.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_listed(KINDS), 256).alias("base_sha256"),
        _listed([*KINDS, "term"]).alias("spans"),
        F.size("term").cast("long").alias("n_term"),
        sum(F.size(kind) for kind in [*KINDS, "term"]).cast("long").alias("n_spans"),
    )
