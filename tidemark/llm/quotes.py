"""Conversations ordered by quotation links, without the quotes, with DataFrame functions only.

A line's quote level is the number of ``>`` that lead it (spaces between are allowed). A passage is a run of
lines of one level with text; level 0 is the message's own. Lines are normalised (lower case, white space
collapsed) and a passage is its lines joined by one space, so it stays the same when a quote is wrapped anew. What is hashed
of a passage, once each: the whole passage, its sentences (cut after ``.``, ``!`` or ``?`` before a space) and its lines. A
hash of a quoted passage of the shallowest level links to the latest earlier message of the conversation
that has it in a passage of its own, and a message answers the one that most of its hashes link to (ties:
the latest). Deeper levels were quoted by that message in turn and follow from its own links.

Answers form trees. Sorting a conversation by thread (the turn of the tree's first message) and place (0 for that
message; each message comes before its answers, and these in the order of their turns) puts every answer behind what it
answers. Messages that quote nothing known start a thread, so without quotes the order is that of turns. Places
are found by walking round each tree: every message is passed on the way down and on the way up, each step knows the next one,
and rounds of doubling those steps count what lies ahead. Their tables have two rows for each message at any depth of the
tree, and a chain of n messages takes about log 2n rounds; the driver sees only whether steps are left.

Only conversations with quotes are taken apart, and only hashes that are quoted somewhere are kept. The latest
earlier message is looked up within ranges of ``SPAN`` turns, and across ranges among one row for each, and so is the next answer to the same message, so long conversations,
common passages and a message that everyone answers make no pairs and no large group. Rows with null conv_id or turn link nothing and keep their own
text, as threads of their own; a null text has no lines. Rows that share conv_id and turn are one message for links: answers name
the turn. Turns may be any numbers, also negative. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import table, written
from tidemark.llm.spans import let

MARKS = r"^[ \t]*(?:>[ \t]*)+"
SPAN = 1024


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[\x20\x09-\x0D]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)


def own_text(text: Column) -> Column:
    """The text without quoted lines; as it is where there are none."""
    kept = F.array_join(F.filter(_lines(text), lambda x: _level(x) == 0), "\n")
    return F.when(text.isNull(), None).when(F.contains(text, F.lit(">")), F.trim(kept)).otherwise(text)


def passages(text: Column) -> Column:
    """array<struct<level, hashes>>: what is hashed of each passage."""
    lines = F.transform(_lines(F.translate(text, "\x01\x02\x03", "   ")), lambda x: F.struct(_level(x).alias("level"), _normal(x).alias("line")))

    def led(lines: Column) -> Column:
        def lead(x: Column, i: Column) -> Column:
            # what a line adds: itself behind the last one of its passage, or the start of a new passage
            last = F.get(lines, i - 1)
            goes_on = (i > 0) & (last["level"] == x["level"]) & (last["line"] != "")
            return F.when(x["line"] == "", "").otherwise(F.concat(F.when(goes_on, "\x03").otherwise(F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"))), x["line"]))

        return F.array_join(F.transform(lines, lead), "")

    runs = F.filter(F.split(let(lines, led), "\x01", -1), lambda x: x != "")

    def one(run: Column) -> Column:
        body = F.substring_index(run, "\x02", -1)
        whole = F.translate(body, "\x03", " ")
        parts = F.array_distinct(F.concat(F.array(whole), F.split(whole, r"(?<=[.!?])\x20", -1), F.split(body, "\x03", -1)))
        return F.struct(F.substring_index(run, "\x02", 1).cast("int").alias("level"), F.transform(parts, lambda x: F.xxhash64(x)).alias("hashes"))

    return F.transform(runs, one)


def answers(messages: DataFrame, spark: SparkSession) -> DataFrame:
    """conv_id, turn, parent: the turn that each quoting message answers, where one is found."""
    some = messages.where("conv_id is not null and turn is not null and text is not null").select("conv_id", "turn", "text")

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("x")).select("conv_id", "turn", "x.level", F.explode("x.hashes").alias("hash"))

    quoted = hashed(some.where(F.contains("text", F.lit(">")))).where("level > 0")
    nearest = quoted.groupBy("conv_id", "turn").agg(F.min("level").alias("level"))
    asking = written(quoted.join(nearest, ["conv_id", "turn", "level"]).select("conv_id", "turn", "hash").distinct(), spark)
    turn = dict(asking.dtypes)["turn"]
    talked = some.join(asking.select("conv_id").distinct(), "conv_id", "left_semi")
    wanted = asking.select("conv_id", "hash").distinct()
    owned = hashed(talked).where("level = 0").select("conv_id", "turn", "hash").join(wanted, ["conv_id", "hash"], "left_semi").distinct()
    both = owned.withColumn("source", F.col("turn")).unionByName(asking.withColumn("source", F.lit(None).cast(turn)))
    both = written(both.withColumn("span", F.floor(F.col("turn") / SPAN)), spark)
    within = Window.partitionBy("conv_id", "hash", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id", "hash").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = both.groupBy("conv_id", "hash", "span").agg(F.max("source").alias("top")).withColumn("before", F.max("top").over(earlier)).where("before is not null").drop("top")
    near = both.withColumn("near", F.max("source").over(within)).where("source is null")
    linked = near.join(spans, ["conv_id", "hash", "span"], "left").withColumn("parent", F.coalesce("near", "before")).where("parent is not null")
    votes = linked.groupBy("conv_id", "turn", "parent").agg(F.count("*").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "parent")).alias("best")).select("conv_id", "turn", F.col("best.parent").alias("parent"))


def order(links: DataFrame, spark: SparkSession) -> DataFrame:
    """conv_id, turn, thread, place of every message that answers or is answered."""
    nodes = links.unionByName(
        links.select("conv_id", F.col("parent").alias("turn")).distinct().join(links, ["conv_id", "turn"], "left_anti").withColumn("parent", F.lit(None).cast(dict(links.dtypes)["parent"]))
    )
    # the next answer beside each one: within its range of turns, or the first of the next range that has any
    span = F.floor(F.col("turn") / SPAN)
    heads = links.groupBy("conv_id", "parent", span.alias("span")).agg(F.min("turn").alias("head"))
    heads = heads.select("conv_id", "parent", "span", F.lead("head").over(Window.partitionBy("conv_id", "parent").orderBy("span")).alias("after"))
    within = Window.partitionBy("conv_id", "parent", "span").orderBy("turn")
    beside = links.withColumn("span", span).withColumn("within", F.lead("turn").over(within)).join(heads, ["conv_id", "parent", "span"])
    beside = beside.select("conv_id", "turn", F.coalesce("within", "after").alias("beside"))
    first = links.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = nodes.join(beside, ["conv_id", "turn"], "left").join(first, ["conv_id", "turn"], "left")
    # a step down goes on to the first answer or turns round; a step up goes on to the next answer beside it or up again
    down = nodes.select("conv_id", "turn", F.lit(0).alias("side"), F.coalesce("child", "turn").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("ahead"))
    up = nodes.select("conv_id", "turn", F.lit(1).alias("side"), F.coalesce("beside", "parent").alias("to"), F.when(F.col("beside").isNull(), 1).otherwise(0).alias("to_side"), F.lit(0).cast("long").alias("ahead"))
    steps = down.unionByName(up).withColumn("thread", F.when(F.col("to").isNull(), F.col("turn")))
    now = written(steps, spark)
    while not now.where("to is not null").isEmpty():
        then = now.select("conv_id", F.col("turn").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("next"), F.col("to_side").alias("next_side"), F.col("ahead").alias("more"), F.col("thread").alias("end"))
        now = written(
            now.join(then, ["conv_id", "to", "to_side"], "left").select(
                "conv_id", "turn", "side", F.col("next").alias("to"), F.coalesce("next_side", "to_side").alias("to_side"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"), F.coalesce("thread", "end").alias("thread")
            ),
            spark,
        )
    down = now.where("side = 0").select("conv_id", "turn", "thread", "ahead")
    whole = down.where("turn = thread").select("conv_id", "thread", F.col("ahead").alias("size"))
    return down.join(whole, ["conv_id", "thread"]).select("conv_id", "turn", "thread", (F.col("size") - F.col("ahead")).alias("place"))


def linked(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent, thread, place, text (without quotes); order by conv_id, thread, place."""
    messages = conversations.select("conv_id", "turn", "role", "text")
    links = written(answers(messages, spark), spark)
    full = order(links, spark).join(links, ["conv_id", "turn"], "left")
    out = messages.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"))
    return out.join(full, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "parent", F.coalesce("thread", "turn").alias("thread"), F.coalesce("place", F.lit(0)).cast("long").alias("place"), "text"
    )


def op6_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, table(spark, sf_dir, "conversations")).withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
l AS (
  SELECT conv_id, turn, i, len(regexp_replace(regexp_extract(x, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(x, '^[ \t]*(>[ \t]*)+', '')), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT conv_id, turn, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM m WHERE text IS NOT NULL)),
b AS (SELECT *, CASE WHEN lag(level) OVER w = level AND lag(line) OVER w <> '' THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM b),
p AS (SELECT conv_id, turn, level, run, string_agg(line, ' ' ORDER BY i) AS whole FROM n WHERE line <> '' GROUP BY conv_id, turn, level, run),
u AS (
  SELECT conv_id, turn, level, run, whole AS x FROM p
  UNION SELECT conv_id, turn, level, run, unnest(string_split(regexp_replace(whole, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) FROM p
  UNION SELECT conv_id, turn, level, run, line FROM n WHERE line <> ''),
q AS (SELECT * FROM u WHERE level > 0),
a AS (SELECT DISTINCT q.conv_id, q.turn, q.x FROM q JOIN (SELECT conv_id, turn, min(level) AS level FROM q GROUP BY conv_id, turn) n
      ON q.conv_id = n.conv_id AND q.turn = n.turn AND q.level = n.level),
h AS (SELECT a.conv_id, a.turn, a.x, max(o.turn) AS parent FROM a JOIN u o ON o.conv_id = a.conv_id AND o.x = a.x AND o.level = 0 AND o.turn < a.turn
      GROUP BY a.conv_id, a.turn, a.x),
v AS (SELECT conv_id, turn, parent, row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, parent DESC) AS best FROM h GROUP BY conv_id, turn, parent),
t AS (SELECT DISTINCT m.conv_id, m.turn, v.parent FROM m LEFT JOIN v ON v.conv_id = m.conv_id AND v.turn = m.turn AND v.best = 1),
r AS (
  SELECT conv_id, turn, parent, turn AS thread, [turn] AS path FROM t WHERE parent IS NULL
  UNION ALL
  SELECT t.conv_id, t.turn, t.parent, r.thread, list_append(r.path, t.turn) FROM t JOIN r ON r.conv_id = t.conv_id AND r.turn = t.parent),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY path) - 1 AS place FROM r)
SELECT m.conv_id, m.turn, m.role, coalesce(o.parent, -1) AS parent, o.thread, CAST(o.place AS BIGINT) AS place,
  CASE WHEN contains(m.text, '>') THEN trim(coalesce(array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '^[ \t]*(>[ \t]*)+')), chr(10)), '')) ELSE m.text END AS text
FROM m JOIN o ON o.conv_id = m.conv_id AND o.turn = m.turn
"""
