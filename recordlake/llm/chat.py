r"""Conversations written as one text of marked turns, with a mask of what a model learns from, in DataFrame functions only.

The grammar, in which ``body`` is a turn's text and every mark is one of ``MARKS``::

    conversation := turn turn ...
    turn := "[INST] " body " [/INST]"                    a user's
          | "<s> " body " </s>"                          an assistant's
          | "[TURN] " role " [SEP] " body " [/TURN]"     of any other role

A backslash before a mark makes it content, and exactly one backslash before each mark is taken away on reading. Rendered text is
parsed again: it is cut before every mark that has no backslash, the pieces have to follow the grammar without a rest, and the turns
read back have to equal the source. Conversations that fail have their marks escaped, turn by turn, and are checked again; a text that
still differs would be an error. The loss mask is a list of spans (code points from 0) over the formatted text, one for every
assistant's body.

A conversation of more than ``part_turns`` rows continues in further parts: its rows get their places in slices of equal row counts, so
neither a task nor a row holds more than ``part_turns`` turns of it. A part is a formatted text of its own; the conversation is their
concatenation.

Null texts and roles count as empty; only the exact roles ``user`` and ``assistant`` have marks of their own. Rows without a
conversation id cannot be told to belong together, so each is a conversation of one turn. Rows of one turn number are ordered by a
hash of role and text, null turn numbers come first, repeated rows stay. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import running_position
from .common import stored

#: Strings that no text contains without a backslash before them once it is formatted.
MARKS = ("[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[SEP]", "[/TURN]")
_MARK = r"\[/?INST\]|</?s>|\[/?TURN\]|\[SEP\]"
PART_TURNS = 512


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({_MARK})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({_MARK})", "$1")


def _rendered_turn(role: Column, text: Column) -> Column:
    return (F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(role == "assistant", F.concat(F.lit("<s> "), text, F.lit(" </s>")))
            .otherwise(F.concat(F.lit("[TURN] "), role, F.lit(" [SEP] "), text, F.lit(" [/TURN]"))))


def rendered(turns: Column) -> Column:
    """The text of ``turns`` (array of role, text), as they are."""
    return F.array_join(F.transform(turns, lambda t: _rendered_turn(t["role"], t["text"])), "")


def _with_marks_escaped(turns: Column) -> Column:
    """The turns with every mark escaped in the roles and texts that contain one; all others stay as they are."""
    return F.transform(turns, lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")))


def parsed(text: Column) -> Column:
    """The turns (array of role, text) that a formatted text holds, null if it does not follow the grammar."""
    def inside(piece: Column, mark: str) -> Column:
        """What stands between the mark with its blank and the blank at the end; null for other pieces."""
        held = piece.startswith(mark + " ") & piece.endswith(" ") & (F.length(piece) >= len(mark) + 2)
        return F.when(held, unescaped(F.substring(piece, F.lit(len(mark) + 2), F.length(piece) - len(mark) - 2)))

    def turns(pieces: Column) -> Column:
        def at(i: Column) -> Column:
            here, after, then = (F.get(pieces, i + k) for k in range(3))
            return (F.when(after == "[/INST]", F.struct(F.lit("user").alias("role"), inside(here, "[INST]").alias("text"), F.lit(2).alias("size")))
                    .when(after == "</s>", F.struct(F.lit("assistant").alias("role"), inside(here, "<s>").alias("text"), F.lit(2).alias("size")))
                    .when(then == "[/TURN]", F.struct(inside(here, "[TURN]").alias("role"), inside(after, "[SEP]").alias("text"), F.lit(3).alias("size"))))

        found = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), at)
        return F.filter(found, lambda t: t["role"].isNotNull() & t["text"].isNotNull())

    pieces = F.split(text, rf"(?<!\\)(?={_MARK})")
    # Through one-element arrays, so that the pieces and the turns are computed once.
    each = F.transform(F.array(pieces), lambda p: F.struct(F.size(p).alias("pieces"), turns(p).alias("turns")))
    whole = F.filter(each, lambda x: x["pieces"] == F.aggregate(x["turns"], F.lit(0), lambda n, t: n + t["size"]))
    return F.transform(F.get(whole, 0)["turns"], lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def loss_spans(text: Column) -> Column:
    """Spans (start, length) in code points, from 0, of the assistants' bodies of a formatted text."""
    pieces = F.split(text, rf"(?<!\\)(?={_MARK})")
    none = F.array().cast("array<struct<start:long,length:long>>")

    def step(done: Column, piece: Column) -> Column:
        long = F.length(piece).cast("long")
        span = F.struct((done["at"] + 4).alias("start"), (long - 5).alias("length"))
        return F.struct((done["at"] + long).alias("at"), F.when(piece.startswith("<s> "), F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda done: done["spans"])


def text_under(text: Column, spans: Column) -> Column:
    """The assistants' texts that the mask covers, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def gathered(conversations: DataFrame, part_turns: int = PART_TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, parts, part, turns): the rows of a conversation in order, at most ``part_turns`` of them in a row."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), said[0].alias("role"), said[1].alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("turn", "tie", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    alone = rows.filter("conv_id IS NULL").select("conv_id", F.lit(1).cast("long").alias("parts"), F.lit(0).cast("long").alias("part"), F.array(F.struct("role", "text")).alias("turns"))
    named = rows.filter("conv_id IS NOT NULL")
    sizes = conversations.select(F.col(conv_col).alias("conv_id")).filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("n"))
    long = stored(sizes.filter(F.col("n") > part_turns).select("conv_id", F.ceil(F.col("n") / part_turns).alias("parts")))
    if long.isEmpty():
        short, more = named, None
    else:
        # At most one conversation in part_turns rows is long; whether the list is broadcast follows from its size at run time.
        short, more = named.join(long, "conv_id", "left_anti"), named.join(long, "conv_id")
    out = short.groupBy("conv_id").agg(in_order.alias("turns")).select("conv_id", F.lit(1).cast("long").alias("parts"), F.lit(0).cast("long").alias("part"), "turns").unionByName(alone)
    if more is not None:
        placed = running_position(more, "conv_id", "turn", "tie", name="place")
        part = F.floor((F.col("place") - 1) / part_turns).cast("long")
        parts = placed.groupBy("conv_id", "parts", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
        out = out.unionByName(parts.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))))
    return out


def formatted(conversations: DataFrame, part_turns: int = PART_TURNS, **columns: str) -> DataFrame:
    """(conv_id, parts, part, formatted, loss_spans, escaped) for every conversation, or each of its ``parts``.

    ``escaped`` tells that content had to be escaped before the text read back equalled the source.
    """
    rows = gathered(conversations, part_turns, **columns).withColumn("plain", rendered(F.col("turns")))
    rows = rows.withColumn("fits", parsed(F.col("plain")).eqNullSafe(F.col("turns")))
    rows = rows.withColumn("formatted", F.when(F.col("fits"), F.col("plain")).otherwise(rendered(_with_marks_escaped(F.col("turns")))))
    same = F.col("fits") | parsed(F.col("formatted")).eqNullSafe(F.col("turns"))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not read back as its source")))
    return rows.select("conv_id", "parts", "part", checked.alias("formatted"), (~F.col("fits")).alias("escaped")).select(
        "conv_id", "parts", "part", "formatted", loss_spans(F.col("formatted")).alias("loss_spans"), "escaped")


def turns_of(texts: DataFrame) -> DataFrame:
    """(conv_id, part, place, role, text): the turns read back from the formatted texts."""
    return texts.select("conv_id", "part", F.posexplode(parsed(F.col("formatted"))).alias("place", "turn")).select("conv_id", "part", "place", "turn.role", "turn.text")


def digest(texts: DataFrame) -> DataFrame:
    """A row per conversation with what is read back from ``texts``, the result of :func:`formatted`.

    A digest needs a conversation's whole text in one row, so those of several parts meet here, and none may exceed 2 GB.
    """
    said = F.array_join(F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = texts.select("conv_id", "parts", "part", F.size(parsed(F.col("formatted"))).cast("long").alias("n_turns"), said.alias("said"),
                        text_under(F.col("formatted"), F.col("loss_spans")).alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", name))), lambda x: x[name]), "").alias(name)

    several = read.filter("parts > 1").groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), joined("said"), joined("learnt"), F.sum("formatted_chars").alias("formatted_chars"))
    whole = read.filter("parts = 1").drop("parts", "part").unionByName(several)
    return whole.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
                        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def with_mark_texts(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose two texts consist of marks."""
    row = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(row)


#: ``formatted_chars`` of a turn: its text, its marks with their blanks, and a backslash for every mark in text or role.
SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS learnt,
  sum(length(text) + len(regexp_extract_all(text, '{_MARK}')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 22 + length(role) + len(regexp_extract_all(role, '{_MARK}')) END) AS chars
FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c"""
