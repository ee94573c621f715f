"""Formatted conversations: exact round trips, merged turns, the loss, edge rows."""

from __future__ import annotations

import random
from itertools import groupby

from pyspark.sql import functions as F

from ledgerloom.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = ["</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[TEXT]", "[NEXT]", "\\", "<", "[", "/s>", "INST]", "NEXT]", "\n", " ", "a", "é👍"]


def formatted(spark, rows):
    return {r.conv_id: r for r in cf.format_chats(spark.createDataFrame(rows, SCHEMA)).select(
        "*", cf.read_turns(F.col("formatted")).alias("turns"), cf.loss_text(F.col("segments")).alias("learned")).collect()}


def test_every_text_and_role_comes_back(spark):
    dice = random.Random(7)
    some = lambda: "".join(dice.choice(MARKS) for _ in range(dice.randrange(9)))
    rows = [(c, t, dice.choice(["user", "assistant", "system", "tool", some()]), some()) for c in range(300) for t in range(dice.randrange(1, 7))]
    found = formatted(spark, rows)
    assert len(found) == len({r[0] for r in rows})
    for c, own in groupby(rows, lambda r: r[0]):
        own = list(own)
        assert [tuple(t) for t in found[c].turns] == [(r[2], r[3]) for r in own]
        assert found[c].learned == "".join(r[3] for r in own if r[2] == "assistant")
        assert found[c].formatted.count("</s>") == len(list(groupby(own, lambda r: r[2])))
        assert "".join(s.text for s in found[c].segments) == found[c].formatted


def test_layout_and_merged_turns(spark):
    found = formatted(spark, [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello"), (1, 2, "user", "Anyone there?"), (1, 3, "assistant", "Yes."),
                              (1, 4, "tool", "[/INST]")])
    assert found[1].formatted == "[SYS]Be brief.</s>[INST]Hello[NEXT]Anyone there?</s>[/INST]Yes.</s>[ROLE]tool[TEXT][\\/INST]</s>"


def test_order_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, 1, "user", "b"), (None, None, None, None), (None, 1, "user", "a"), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS turns", "'x' AS formatted", "'x' AS segments", "'x' AS _conv")
    found = {r.conv_id: [tuple(t) for t in r.turns] for r in cf.format_chats(df).select("conv_id", cf.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert found == {None: [("", ""), ("user", "a"), ("user", "b")], 2: [("user", "x")] * 2, 3: [("assistant", "")]}


def test_empty_table_and_long_text(spark):
    assert cf.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "</s>[INST] \\" * 50_000
    found = formatted(spark, [(1, 0, "assistant", text)] + [(2, t, "user", "same") for t in range(3000)])
    assert found[1].learned == text and len(found[2].turns) == 3000


def test_spans_point_at_the_loss(spark):
    chats = cf.format_chats(spark.createDataFrame([(1, 0, "user", "é"), (1, 1, "assistant", "👍[INST]"), (1, 2, "assistant", "b")], SCHEMA))
    text = chats.first().formatted
    assert [text[r.start:r.start + r.length] for r in cf.loss_spans(chats).orderBy("start").collect()] == ["👍[\\INST]", "b"]


def test_no_python_on_the_path(spark):
    plan = cf.format_chats(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
