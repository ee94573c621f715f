"""How the shingle sets of lines are made: once for each use, in time linear in the line."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ledgerloom.llm import fuzzy_lines as fl


def _texts(spark, lines):
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "a long, b long, line string")
    return rows.select("a", "b", fl._units(F.col("line")).alias("units"))


def _sets(df):
    """The lambdas that hash a shingle, in the optimized plan."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")
    plan = plan[plan.index("== Optimized Logical Plan =="):plan.index("== Physical Plan ==")]
    return re.findall(r"lambdafunction\(xxhash64\(substring\(([^,]*),", plan)


def test_sets_are_made_once(spark):
    texts = _texts(spark, ["one line of some words", "one line of some words more"])
    pairs = spark.createDataFrame([(0, 0, 1, 0)], "a long, b long, pa long, pb long")
    assert len(_sets(fl.folded(texts))) == 1
    assert len(_sets(fl.verified(pairs, texts))) == 2  # one for each side


def test_bytes_of_a_line_are_not_copied_for_each_shingle(spark):
    """A column inside the lambda is read, as a copy of the whole line, for every shingle."""
    texts = _texts(spark, ["one line of some words"])
    held = _sets(fl.folded(texts))
    assert held and all(x.startswith("lambda ") for x in held), held


def test_edges_of_long_repeated_and_short_lines(spark):
    long = "".join(f"{i * 7919 % 99991:05d} " for i in range(8000))
    lines = [long, long[:-200], "ab " * 300, "ab " * 700, "short", "short.", "eleven char", "eleven chars", "zz \U0001f600" * 40, "zz \U0001f600" * 40 + "!"]
    texts = _texts(spark, lines)
    sets = [{u[2 * i:2 * i + 2 * fl.SHINGLE] for i in range(max(len(u) // 2 - fl.SHINGLE + 1, 1))}
            for u in (x.encode("utf-16-be") for x in lines)]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    want = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= fl.SIMILARITY * len(sets[p[0]] | sets[p[1]])}
    got = fl.verified(spark.createDataFrame([(i, 0, j, 0) for i, j in pairs], "a long, b long, pa long, pb long"), texts)
    assert {(int(r.x[:16], 16), int(r.y[:16], 16)) for r in got.collect()} == want and len(want) >= 3
    assert {r.a: r["size"] for r in fl.folded(texts).select("a", "size").collect()} == {i: len(s) for i, s in enumerate(sets)}
