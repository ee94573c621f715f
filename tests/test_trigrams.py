"""Searches by the trigram index equal the scan, and read little."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import search_predicate
from ledgerloom.sources.keyed import KeyedTable
from ledgerloom.sources.trigrams import TrigramIndex, indexed_search

SCHEMA = "id long, name string, code string"
WORDS = ["steel", "Brass", "copper", "Café", "cafe", "na\x02me", "100%", "a_b", "ÆON", "aeon", "x", "SKU-7", "  ", "日本", "O'Neil", "back\\slash", "ab", "B"]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    dice = random.Random(1)
    rows = [(i, " ".join(dice.choice(WORDS) for _ in range(dice.randrange(4))) if i % 11 else None, dice.choice(["", f"SKU-{i}", f"sku {i % 9}"])) for i in range(900)]
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(rows, SCHEMA)
    table, index = KeyedTable(f"{path}/table", df.schema, ("id",), 8), TrigramIndex(f"{path}/index", "id", ("name", "code"))
    table.create(df)
    index.build(df.where("id < 600"))
    index.add(df.where("id >= 600"))
    return df, table, index


@pytest.mark.parametrize("term", ["steel", "STEEL b", "cafe", "café", "afé co", "name", "100%", "%", "_", "a_b", "aeon", "ÆON", "x", "X ", "ab", "AB", "sku-77", "日本",
                                  "o'n", "k\\s", "nowhere", "zzz", "", None, "  ", "7", "-7", "l b", "\x02", "l\x02b", "é"])
def test_equals_the_scan(spark, shop, term):
    df, table, index = shop
    wanted = search_predicate(["name", "code"], term)
    want = sorted(r.id for r in (df if wanted is None else df.where(wanted)).collect())
    assert sorted(r.id for r in indexed_search(table, index, spark, term).collect()) == want


def test_reads_the_rarest_lists_only(spark, shop):
    df, table, index = shop
    found = index.lookup(spark, "sku-877")
    assert found.grams == ["877"] or "877" in found.grams
    special = df.where("name rlike '[^ -~]'").count()
    assert found.postings - special < 30 and found.keys.count() - special <= 3
    assert index.lookup(spark, "qqqq").grams == []
    assert index.lookup(spark, "日本") is None
    plan = spark.read.parquet(f"{index.path}/postings").where(F.col("gram").isin(["877"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), EqualTo(gram,877)" in plan


def test_empty_table(spark, scratch):
    df = spark.createDataFrame([], SCHEMA)
    table, index = KeyedTable(f"{scratch}/table", df.schema, ("id",), 4), TrigramIndex(f"{scratch}/index", "id", ("name",))
    table.create(df)
    index.build(df)
    assert indexed_search(table, index, spark, "steel").collect() == [] and indexed_search(table, index, spark, "s").collect() == []


def test_each_gram_once_and_made_once(spark, scratch):
    """The pairs of a row are distinct, whatever its texts repeat, and building
    evaluates each row's texts once (a sample for ranges would do it twice)."""
    rows = [(1, "aaaa", "AAAA"), (2, "café", "ab"), (3, None, ""), (4, "a\x01b", None), (5, "ab", "b"), (6, "日", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    TrigramIndex(f"{scratch}/index", "id", ("name", "code")).build(df.mapInArrow(look, df.schema))
    got = sorted(tuple(r) for r in spark.read.parquet(f"{scratch}/index/postings").collect())
    end = "\x01"
    want = [("", 2), ("", 4), ("", 6), ("aaa", 1), ("aa" + end, 1), ("a" + end * 2, 1), ("ab" + end, 2), ("b" + end * 2, 2), ("ab" + end, 5), ("b" + end * 2, 5)]
    assert got == sorted(want) and seen.value == len(rows)
