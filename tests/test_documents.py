"""JSON documents of any length, written in order without holding one whole."""

from __future__ import annotations

from ledgerloom.sources.sinks import write_long_documents


def test_documents_come_back_whole_and_in_order(spark, scratch):
    parents = spark.createDataFrame([(1, 'a "quoted"\nname'), (2, None), (3, "no lines"), (None, "no key")], "id long, title string")
    children = spark.range(100_000).selectExpr("1L AS id", "id AS line_no", "concat('text ', id, '\\n') AS note", "CASE WHEN id % 2 = 0 THEN id END AS units")
    more = spark.createDataFrame([(2, 5, "]}", None), (2, 4, ",[{", 1), (9, 1, "no parent", 1), (None, 1, "x", 1)], "id long, line_no long, note string, units long")
    write_long_documents(parents, children.unionByName(more).repartition(7), "id", ["line_no"], "lines", f"{scratch}/out")
    got = {r.id: r for r in spark.read.schema("id long, title string, lines array<struct<line_no: long, note: string, units: long>>").json(f"{scratch}/out").collect()}
    assert set(got) == {1, 2, 3} and got[1].title == 'a "quoted"\nname' and got[2].title is None
    assert [tuple(x) for x in got[1].lines] == [(i, f"text {i}\n", i if i % 2 == 0 else None) for i in range(100_000)]
    assert [tuple(x) for x in got[2].lines] == [(4, ",[{", 1), (5, "]}", None)] and got[3].lines == []


def test_nothing_to_write(spark, scratch):
    none = spark.createDataFrame([], "id long, line_no long")
    write_long_documents(none.select("id"), none, "id", ["line_no"], "lines", f"{scratch}/out")
    assert spark.read.text(f"{scratch}/out").count() == 0
