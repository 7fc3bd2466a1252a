"""Chat formatting by quotation linking, by Spark's own functions only.

Lines that begin with ``>`` marks are quoted, as deep as they have marks. A line's passage (marks off, A-Z lower
case, white space collapsed) is hashed, and a quoted passage joins the message of its conversation that wrote it
first, unquoted. A message replies to the latest message it quotes at the least level, or else to the one before
it. Quotes make threads: a turn belongs to the thread of the turn it quotes, up to one that quotes none. What is
left without quoted lines is rendered as a chat turn; threads follow each other by their first turns, and a thread's
turns stand together in order, so that replies follow originals, not what was said between.

First authors are one row for each (conversation, passage) after partial aggregation, so a passage that every
message repeats joins as one row. Threads are found by pointer doubling. The message before, and the places in
the order, are found over blocks of turns, blocks of blocks and so on: no window ever holds more than BLOCK rows
of a conversation, however long it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

BLOCK = 64
MARKS = r"^[\t ]*>[>\t ]*"


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _passage(line: Column) -> Column:
    bare = F.regexp_replace(line, MARKS, "")
    return F.btrim(F.regexp_replace(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "), F.lit(" "))


def _double(*columns) -> Column:
    """Two independent 64-bit hashes, which stand for the columns where equality is all that matters."""
    return F.struct(F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit("again"), *columns).alias("y"))


def parse(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, message, lines, body) of distinct messages; lines: (level, passage hash) of those with a word.

    body: the text without quoted lines, trimmed. A null text is empty.
    """
    rows = messages.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    split = F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")
    rows = rows.withColumn("message", _double("conv_id", "turn", "role", F.col("text").isNull(), "text")).withColumn("_split", split)
    pieces = F.transform("_split", lambda x: F.struct(_level(x).cast("int").alias("level"), _passage(x).alias("passage")))
    pieces = F.transform(F.filter(pieces, lambda p: p["passage"] != ""), lambda p: F.struct(p["level"].alias("level"), _double(p["passage"]).alias("hash")))
    body = F.array_join(F.filter("_split", lambda x: ~x.rlike(MARKS)), "\n")
    return rows.withColumn("lines", pieces).withColumn("body", F.btrim(body, F.lit(" \t\n\x0b\x0c\r"))).drop("_split")


def previous_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, previous, position) of distinct (conv_id, turn): the turn before, and how many come before.

    A column n, if there is one, says for how many a turn counts.
    """
    turns = turns if "n" in turns.columns else turns.withColumn("n", F.lit(1).cast("long"))
    widest = turns.agg(F.max(F.abs(F.col("turn").cast("double")))).first()[0] or 0
    levels = max(1, math.ceil(math.log(widest + 2, BLOCK)))  # so the last level has two blocks at most
    blocks = [turns.select("conv_id", "turn", F.col("turn").alias("b0"), "n", F.col("turn").alias("last"))]
    for level in range(1, levels + 1):
        up = F.floor(F.col(f"b{level - 1}") / BLOCK).cast("long").alias(f"b{level}")
        rows = blocks[-1].select("conv_id", f"b{level - 1}", "n", "last").groupBy("conv_id", up).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        blocks.append(rows)
    found: DataFrame | None = None
    for level in range(levels, -1, -1):
        name, rows = f"b{level}", blocks[level]
        if level < levels:
            rows = rows.withColumn("up", F.floor(F.col(name) / BLOCK).cast("long"))
            within = Window.partitionBy("conv_id", "up").orderBy(name)
        else:
            within = Window.partitionBy("conv_id").orderBy(name)
        before = within.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.select("*", F.max("last").over(before).alias("earlier"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
        if found is not None:
            above = found.select(F.col("conv_id").alias("c"), F.col(f"b{level + 1}").alias("up_"), F.col("earlier").alias("far"), F.col("ahead").alias("more"))
            rows = rows.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("up").eqNullSafe(F.col("up_")))
            rows = rows.withColumns({"earlier": F.coalesce("earlier", "far"), "ahead": F.col("ahead") + F.col("more")}).drop("c", "up_", "far", "more", "up")
        found = rows
    return found.select("conv_id", F.col("b0").alias("turn"), F.col("earlier").alias("previous"), F.col("ahead").alias("position"))


def threads(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, root) of distinct (conv_id, turn, parent): the first turn that parents lead to. A parent is an earlier turn, or null.

    Pointer doubling: each round a turn's pointer goes to where its target points, so rounds are the log of the depth.
    """
    state = materialize(turns.where("parent IS NOT NULL").select("conv_id", "turn", F.col("parent").alias("root")), "pointers")
    while True:
        to = state.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("further"))
        ahead = state.join(to, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left")
        moved = materialize(ahead.select("conv_id", "turn", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "pointers")
        done = moved.where("moved").isEmpty()
        discard(state)
        state = moved.drop("moved")
        state.written_to = moved.written_to
        if done:
            return turns.where("parent IS NULL").select("conv_id", "turn", F.col("turn").alias("root")).unionByName(state)


def places(threaded: DataFrame) -> DataFrame:
    """(conv_id, turn, position) of (conv_id, turn, root): turns before it by (root, turn)."""
    sizes = threaded.groupBy("conv_id", F.col("root").alias("turn")).agg(F.count("*").alias("n"))
    before = previous_turns(sizes).select(F.col("conv_id").alias("c"), F.col("turn").alias("r"), F.col("position").alias("base"))
    own = previous_turns(threaded.select(F.struct("conv_id", "root").alias("conv_id"), "turn")).select("conv_id.conv_id", "conv_id.root", "turn", "position")
    out = own.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("root") == F.col("r")))
    return out.select("conv_id", "turn", "root", (F.col("base") + F.col("position")).alias("position"))


def _escaped(text: Column) -> Column:
    """Without the marks of a chat turn: one more backslash stands between ``<`` and ``|``, and can be taken out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def link(messages: DataFrame) -> DataFrame:
    """One row per distinct message of ``messages`` (conv_id, turn, role, text), with what it replies to and its chat turn.

    Columns: conv_id, turn, role, copies (equal rows), quote_level (the deepest), n_quoted (quoted lines),
    n_linked (those whose original is an earlier turn), reply_to (the turn, null for a first one), link
    (``quote``, ``previous`` or ``none``), thread (its first turn), position (turns before it in reply order), body,
    rendered (``<|`` in a body, and marks in a role, escaped). Ties: of equally good originals the latest turn;
    messages of one turn are in one thread, that of the latest turn any of them quotes. A null turn comes before
    all and is replied to by none; a null conv_id is one conversation. Quotes of other conversations, of later
    turns or of nothing stay unlinked. No rows give no rows.
    """
    rows = materialize(parse(messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")), "messages")
    lines = rows.select("message", "conv_id", "turn", F.explode("lines").alias("l")).select("message", "conv_id", "turn", "l.level", "l.hash")
    first = lines.where("level = 0 AND turn IS NOT NULL").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    first = first.withColumnsRenamed({"conv_id": "f_conv", "hash": "f_hash"})
    quoted = lines.where("level > 0").select("message", "conv_id", "turn", "level", "hash")
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("hash") == F.col("f_hash"))
    joined = quoted.join(first, same, "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    best = joined.groupBy("message").agg(
        F.count("*").alias("n_quoted"), F.count("original").alias("n_linked"), F.max("level").alias("quote_level"),
        F.max(F.when(F.col("original").isNotNull(), F.struct((-F.col("level")).alias("near"), "original")))["original"].alias("quoted_turn"),
    )
    best = materialize(best, "quotes")
    known = rows.where("turn IS NOT NULL")
    parents = known.select("message", "conv_id", "turn").join(best.select("message", "quoted_turn"), "message", "left")
    parents = materialize(parents.groupBy("conv_id", "turn").agg(F.max("quoted_turn").alias("parent")), "parents")
    order = previous_turns(parents.select("conv_id", "turn")).drop("position").withColumnsRenamed({"conv_id": "o_conv", "turn": "o_turn"})
    spots = places(threads(parents)).withColumnsRenamed({"conv_id": "p_conv", "turn": "p_turn", "root": "thread"})
    order = order.join(spots, F.col("o_conv").eqNullSafe(F.col("p_conv")) & (F.col("o_turn") == F.col("p_turn")))
    out = rows.join(best, "message", "left")
    out = out.join(order, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("turn") == F.col("o_turn")), "left")
    reply = F.coalesce("quoted_turn", "previous")
    how = F.when(F.col("quoted_turn").isNotNull(), "quote").when(F.col("previous").isNotNull(), "previous").otherwise("none")
    rendered = F.concat(F.lit("<|"), F.translate(F.coalesce("role", F.lit("unknown")), "<|>\n", "____"), F.lit("|>\n"), _escaped(F.col("body")), F.lit("\n"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return out.select(
        "conv_id", "turn", "role", "copies", zero("quote_level", "int"), zero("n_quoted", "long"), zero("n_linked", "long"),
        reply.alias("reply_to"), how.alias("link"), "thread", zero("position", "long"), "body", rendered.alias("rendered"),
    )


def render(linked: DataFrame, turns: int = BLOCK) -> DataFrame:
    """(conv_id, part, text): conversations as text in reply order, ``turns`` positions to a part, so parts stay bounded."""
    part = F.floor(F.col("position") / turns).alias("part")
    rows = linked.groupBy("conv_id", part).agg(F.array_sort(F.collect_list(F.struct("position", "turn", "role", "body", "rendered"))).alias("rows"))
    return rows.select("conv_id", "part", F.array_join(F.transform("rows", lambda r: r["rendered"]), "").alias("text"))


ORACLE_SQL = r"""
WITH RECURSIVE messages AS (
  SELECT conv_id, turn, role, text, count(*) AS copies, row_number() OVER () AS message FROM conversations GROUP BY conv_id, turn, role, text
), split AS (
  SELECT message, conv_id, turn, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS ls FROM messages
), raw AS (
  SELECT message, conv_id, turn, unnest(ls) AS line FROM split
), lines AS (
  SELECT message, conv_id, turn, length(regexp_replace(regexp_extract(line, '^[\t ]*>[>\t ]*'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(translate(regexp_replace(line, '^[\t ]*>[>\t ]*', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS passage
  FROM raw
), firsts AS (
  SELECT conv_id, passage, min(turn) AS original FROM lines WHERE level = 0 AND passage <> '' GROUP BY conv_id, passage
), quoted AS (
  SELECT l.message, l.level, CASE WHEN f.original < l.turn THEN f.original END AS original
  FROM lines l LEFT JOIN firsts f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.passage = f.passage WHERE l.level > 0 AND l.passage <> ''
), best AS (
  SELECT message, count(*) AS n_quoted, count(original) AS n_linked, max(level) AS quote_level,
         arg_max(original, (-level, original)) FILTER (WHERE original IS NOT NULL) AS quoted_turn
  FROM quoted GROUP BY message
), turns AS (
  SELECT conv_id, turn, parent, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
  FROM (SELECT conv_id, turn, max(quoted_turn) AS parent FROM messages LEFT JOIN best USING (message) WHERE turn IS NOT NULL GROUP BY conv_id, turn)
), threads(conv_id, turn, root) AS (
  SELECT conv_id, turn, turn FROM turns WHERE parent IS NULL
  UNION ALL SELECT t.conv_id, t.turn, h.root FROM threads h JOIN turns t ON t.conv_id IS NOT DISTINCT FROM h.conv_id AND t.parent = h.turn
), places AS (
  SELECT conv_id, turn, root, row_number() OVER (PARTITION BY conv_id ORDER BY root, turn) - 1 AS position FROM threads
), bodies AS (
  SELECT message, trim(array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '^[\t ]*>')), chr(10)), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM split
)
SELECT m.conv_id, m.turn, m.role, m.copies, coalesce(b.quote_level, 0)::INT AS quote_level, coalesce(b.n_quoted, 0) AS n_quoted, coalesce(b.n_linked, 0) AS n_linked,
       coalesce(b.quoted_turn, t.previous) AS reply_to, CASE WHEN b.quoted_turn IS NOT NULL THEN 'quote' WHEN t.previous IS NOT NULL THEN 'previous' ELSE 'none' END AS link,
       p.root AS thread, coalesce(p.position, 0) AS position, body,
       '<|' || translate(coalesce(m.role, 'unknown'), '<|>' || chr(10), '____') || '|>' || chr(10) || regexp_replace(body, '<(\\*)\|', '<\\\1|', 'g') || chr(10) AS rendered
FROM messages m JOIN bodies USING (message) LEFT JOIN best b USING (message)
LEFT JOIN turns t ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.turn = t.turn
LEFT JOIN places p ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.turn = p.turn
"""
