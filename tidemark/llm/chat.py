"""Conversations as training text, by expressions over their sorted turns.

The rows of a conversation are collected and sorted; neighbours of one role are merged; the text is

    ### role: text<part>text</turn>

with a line feed behind each merged turn. Inside texts and roles a backslash is doubled, and the
strings ``###``, ``</turn>`` and ``<part>`` (in roles also ``:``) are broken up by a backslash and a letter, so
the template's own marks are unique and every text can be read back exactly.

The loss mask says which text a model learns: the texts of ``assistant``. It is a list of
(turn, start, end): the merged turn (from 0) and code points inside it, marks excluded.

Merged turns and places in them come from windows over a conversation, which sort and spill; only the finished parts
are collected. The text is one value by definition, so the largest conversation must fit in a task; the work on it is linear.

Defined results: a null text or role is empty; a null conversation id is a conversation of
its own; null turns sort first, ties by role and text as they were given; repeated rows are repeated turns. A
conversation whose texts are all empty is formatted like any other. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END, PART, LEARNED = "###", "</turn>", "<part>", "assistant"
ORDER_MARK = b"\x00\x00\xfe\xff"
#: What stands for the first character of a mark, or the colon of a role, inside texts.
BROKEN = {"#": "h", "<": "l", ":": "c"}


def escaped(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (HEAD, END, PART, *([":"] if role else [])):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("#", "\\h").replace("<", "\\l").replace(":", "\\c")))
    return text


def unescaped(text: Column) -> Column:
    def whole(piece: Column) -> Column:
        for mark, letter in BROKEN.items():
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(mark))
        return piece

    # doubled backslashes are taken apart first, so what follows them is never read as a mark
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), whole), "\\")


def formatted(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, ``formatted`` and ``loss`` (the mask)."""
    empty = F.lit("")
    said = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"))
    order = ["turn", "role", "text"]
    so_far = Window.partitionBy("id").orderBy(*order)
    begins = ~F.lag("role").over(so_far).eqNullSafe(F.col("role"))
    merged = F.sum(F.col("begins").cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    told = said.withColumn("begins", begins).withColumn("merged", merged.cast("int")).withColumn("shown", escaped(F.col("text")))
    # code points of the turn's parts before this one, marks included; at least those of a mark, so no two parts share a place
    before = F.sum(F.char_length("shown") + len(PART)).over(Window.partitionBy("id", "merged").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    part = F.struct("merged", F.coalesce(before, F.lit(0)).cast("int").alias("before"), escaped(F.col("role"), role=True).alias("role"), F.col("role").eqNullSafe(LEARNED).alias("learned"), "shown")
    turns = told.select("id", part.alias("t")).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def written(t: Column) -> Column:
        head = F.concat(F.when(t["merged"] > 0, F.lit(END + "\n")).otherwise(empty), F.lit(HEAD + " "), t["role"], F.lit(": "))
        return F.concat(F.when(t["before"] == 0, head).otherwise(F.lit(PART)), t["shown"])

    def masked(t: Column) -> Column:
        start = F.char_length(t["role"]) + len(HEAD) + 3 + t["before"]
        return F.struct(t["merged"].alias("turn"), start.alias("start"), (start + F.char_length(t["shown"])).alias("end"))

    text = F.concat(F.array_join(F.transform("turns", written), ""), F.lit(END + "\n"))
    return turns.select(F.col("id").alias(id_col), text.alias("formatted"), F.transform(F.filter("turns", lambda t: t["learned"]), masked).alias("loss"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: what a lambda refers to outside is worked out for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged_turns(text: Column) -> Column:
    """The merged turns of a formatted text, without their end marks."""
    return bound(F.split(text, rf"\Q{END}\E\n", -1), lambda pieces: F.slice(pieces, F.lit(1), F.size(pieces) - 1))


def read_turns(text: Column) -> Column:
    """Array of (role, text) of all rows that were formatted, in order."""
    def rows(one: Column) -> Column:
        role = F.substring_index(F.substring(one, len(HEAD) + 2, 1 << 30), ": ", 1)

        def bodies(role: Column) -> Column:
            body = F.substring(one, F.char_length(role) + len(HEAD) + 4, F.char_length(one))
            return bound(unescaped(role), lambda known: F.transform(F.split(body, rf"\Q{PART}\E", -1), lambda t: F.struct(known.alias("role"), unescaped(t).alias("text"))))

        return bound(role, bodies)

    return F.flatten(F.transform(merged_turns(text), rows))


def read_loss(text: Column, loss: Column) -> Column:
    """Array of the unescaped texts under the mask.

    Spans are cut from the turns in four bytes a code point, where a place is found without counting from the
    start; texts that are no valid UTF-8 are cut as they are."""
    wide = F.transform(merged_turns(text), lambda t: F.struct(t.alias("text"), F.when(F.is_valid_utf8(t), F.encode(t, "UTF-32")).alias("wide")))

    def cut(turn: Column, s: Column) -> Column:
        # a byte order mark in front, so that one in the text is not taken for it
        quick = F.decode(F.concat(F.lit(ORDER_MARK), F.substring(turn["wide"], s["start"] * 4 + 1, (s["end"] - s["start"]) * 4)), "UTF-32")
        return unescaped(F.when(turn["wide"].isNotNull(), quick).otherwise(F.substring(turn["text"], s["start"] + 1, s["end"] - s["start"])))

    return bound(wide, lambda turns: F.transform(loss, lambda s: bound(F.get(turns, s["turn"]), lambda turn: cut(turn, s))))
