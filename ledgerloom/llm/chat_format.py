"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns
of one role are merged into a block, and the blocks are concatenated::

    [SYS]Be brief.</s>[INST]Hello[NEXT]Anyone there?</s>[/INST]Yes.</s>

A block is an opening mark for its role, its texts with ``[NEXT]`` between them,
and ``</s>``; roles other than the three known ones are written out as
``[ROLE]name[TEXT]``. Inside texts and role names a control string gets one more
backslash after its first character, however many it had (``</s>`` becomes
``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), so that reading back is exact.

Defined results: a null text or role is the empty string; a null conversation
key is a conversation of its own; turns are ordered by turn (null first), ties by
role, then text, and repeated rows stay repeated turns; no rows, no conversation.
Columns besides the four named ones take no part, whatever their names. One
conversation is one cell of the result, so its text must fit a cell (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
OTHER, NAMED, NEXT, END = "[ROLE]", "[TEXT]", "[NEXT]", "</s>"

_REST = r"(?=/s>|/?INST\]|SYS\]|ROLE\]|TEXT\]|NEXT\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)" + _REST, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\" + _REST, "$1")


def _opening(role: Column) -> Column:
    named = F.concat(F.lit(OTHER), escape(role), F.lit(NAMED))
    for name, mark in OPEN.items():
        named = F.when(role == name, F.lit(mark)).otherwise(named)
    return named


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _segments(block: Column) -> Column:
    """Marks and texts of a block in order; only an assistant's texts are under the loss."""
    mark = lambda text: _segment(text, F.lit(False))
    texts = F.transform(block.texts, lambda text, i: F.array(
        mark(F.when(i == 0, _opening(block.role)).otherwise(F.lit(NEXT))), _segment(text, block.role == "assistant")))
    return F.concat(F.flatten(texts), F.array(mark(F.lit(END))))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its key (by its own name), ``formatted``, and
    ``segments``, an array of (text, loss) whose texts make up ``formatted``; a model
    is trained on the segments under the loss only."""
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(conv).alias("_conv")).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1),
                      lambda i: (i == 0) | (F.col("turns")[i].role != F.col("turns")[F.greatest(i - 1, F.lit(0))].role))
    chats = chats.select("_conv", "turns", F.concat(starts, F.array(F.size("turns"))).alias("bounds"))
    blocks = F.transform(F.slice("bounds", 1, F.size("bounds") - 1), lambda start, k: F.struct(
        F.col("turns")[start].role.alias("role"),
        F.transform(F.slice("turns", start + 1, F.col("bounds")[k + 1] - start), lambda t: escape(t.text)).alias("texts")))
    chats = chats.select("_conv", blocks.alias("blocks"))
    chats = chats.select("_conv", F.flatten(F.transform("blocks", _segments)).alias("segments"))
    return chats.select(F.col("_conv").alias(conv), F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, an array of (role, text)."""
    def turns(block: Column) -> Column:
        name = F.regexp_extract(block, r"(?s)^\[ROLE\](.*?)\[TEXT\]", 1)
        role, skip = unescape(name), F.length(name) + len(OTHER) + len(NAMED)
        for known, mark in OPEN.items():
            role = F.when(block.startswith(mark), F.lit(known)).otherwise(role)
            skip = F.when(block.startswith(mark), F.lit(len(mark))).otherwise(skip)
        body = F.substring(block, skip + 1, F.length(block))
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    blocks = F.split(formatted, END, -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss, as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")


def loss_spans(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(key, start, length) of every loss segment, in code points of ``formatted``."""
    parts = chats.select(F.col(conv), F.posexplode("segments").alias("place", "segment"))
    before = Window.partitionBy(conv).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("segment.text")
    spans = parts.select(conv, F.coalesce(F.sum(size).over(before), F.lit(0)).alias("start"), size.cast("long").alias("length"),
                         F.col("segment.loss").alias("_loss"))
    return spans.where("_loss").drop("_loss")


#: The control strings of the fixed conversation, which must come back unchanged.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
PROBE_SCHEMA = "conv_id long, turn long, role string, text string"

ORACLE_SQL = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed AS (
    SELECT *, row_number() OVER chat AS place, lag(role) OVER chat AS before FROM said
    WINDOW chat AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
    SELECT *, length(regexp_replace(text, '([<\[]\\*)(/s>|/?INST\]|SYS\]|ROLE\]|TEXT\]|NEXT\])', '\1\\\2', 'g'))
        + CASE WHEN before IS NOT DISTINCT FROM role THEN 6
               ELSE 4 + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7
                        ELSE 12 + length(regexp_replace(role, '([<\[]\\*)(/s>|/?INST\]|SYS\]|ROLE\]|TEXT\]|NEXT\])', '\1\\\2', 'g')) END
          END AS chars
    FROM placed
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
