"""Keyed tables: upserts, changes, files of untouched buckets, replays, edge rows."""

from __future__ import annotations

import datetime as dt
import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import alerts as al
from ledgerloom.sources.domain import DOMAIN_SCHEMAS
from ledgerloom.sources.keyed import KeyedTable, upsert

USERS = DOMAIN_SCHEMAS["users"]
COMMANDS = "command_id long, id long, name string, email string, role string"
NOW = dt.datetime(2001, 8, 1)


def table_of(scratch, buckets=8):
    return KeyedTable(f"{scratch}/users", USERS, ("email",), buckets)


def files(path):
    return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/_bucket=*/part-*")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("update", [["name", "role"], []])
def test_upserts_equal_one_command_at_a_time(spark, scratch, update):
    dice = random.Random(len(update))
    table, stored, out = table_of(scratch), {f"u{i}": (i, f"n{i}", f"u{i}", "SALES") for i in range(20)}, {}
    table.create(spark.createDataFrame(list(stored.values()), USERS))
    for start in (0, 500):
        commands = []
        for n in range(start, start + 300):
            email = dice.choice([None, "u3", "u3", f"u{dice.randrange(60)}", f"new{start}"])
            commands.append((n, 1000 + n, dice.choice(["x", f"name {n}"]), email, dice.choice(["ADMIN", "SALES", None])))
        for n, i, name, email, role in commands:
            if email is None:
                out[n] = "invalid"
            elif email not in stored:
                stored[email], out[n] = (i, name, email, role), "inserted"
            elif update:
                stored[email], out[n] = (stored[email][0], name, email, role), "updated"
            else:
                out[n] = "unchanged"
        dice.shuffle(commands)
        got = upsert(table, spark.createDataFrame(commands, COMMANDS), "command_id", update)
        assert {r.command_id: r.outcome for r in got.collect()} == {n: o for n, o in out.items() if start <= n < start + 300}
        assert sorted(r.email for r in table.read(spark).collect()) == sorted(stored)
        assert {r.email: tuple(r) for r in table.read(spark).collect()} == stored


def test_only_changed_buckets_are_rewritten(spark, scratch):
    table = table_of(scratch, 32)
    table.create(spark.range(400).selectExpr("id", "concat('n', id) AS name", "concat('u', id) AS email", "'SALES' AS role"))
    before = files(table.path)
    assert len(before) == 32
    command = spark.createDataFrame([(1, 9999, "other", "u17", "ADMIN"), (2, 1, "n18", "u18", "SALES")], COMMANDS)
    upsert(table, command, "command_id", ["name", "role"])
    after = files(table.path)
    bucket = spark.createDataFrame([("u17",)], "email string").select(table.bucket()).first()[0]
    gone, new = before.keys() - after.keys(), after.keys() - before.keys()
    assert {os.path.dirname(f) for f in gone | new} == {f"{table.path}/_bucket={bucket}"}  # u18 was already so
    assert all(before[f] == after[f] for f in before.keys() & after.keys())
    upsert(table, command, "command_id", ["name", "role"])  # a replay changes no file at all
    assert files(table.path) == after
    plan = table.near(spark, [bucket])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(_bucket#" in plan or f"_bucket" in plan.split("PartitionFilters", 1)[1][:80]


def test_deletes_empty_a_bucket_and_put_fills_it_again(spark, scratch):
    table = table_of(scratch, 4)
    everyone = spark.range(12).selectExpr("id", "'n' AS name", "concat('u', id) AS email", "'SALES' AS role")
    table.create(everyone)
    none = everyone.limit(0)
    assert table.apply(none, everyone) == [0, 1, 2, 3]
    assert table.read(spark).collect() == [] and len(files(table.path)) == 4
    assert table.apply(none, none) == []
    table.apply(everyone.where("id = 5"))
    assert rows(table.read(spark)) == [(5, "n", "u5", "SALES")]


def test_empty_table_and_clashing_columns(spark, scratch):
    table = table_of(scratch)
    table.create(spark.createDataFrame([], USERS))
    commands = spark.createDataFrame([(1, 1, "a", "e", None), (2, 2, "b", "e", "SALES")], COMMANDS).selectExpr("*", "'x' AS first", "'x' AS old", "'x' AS outcome")
    assert rows(upsert(table, commands, "command_id", ["name"])) == [(1, "e", "inserted"), (2, "e", "updated")]
    assert rows(table.read(spark)) == [(1, "b", "e", None)]
    assert upsert(table, commands.limit(0), "command_id", ["name"]).collect() == []


def test_alert_changes_equal_the_whole_merge(spark, scratch):
    dice = random.Random(3)
    live_schema = "type string, title string, detail string, priority string, related_type string, related_id long"
    table, whole = al.alert_table(scratch, 8), {}

    def some(ids):
        return [("LOW_STOCK", "Low stock:", f"p{i} has {dice.randrange(4)} units left", "HIGH", "PRODUCT", i) for i in ids]

    stored = spark.createDataFrame(some(range(0, 60, 2)), live_schema)
    stored = al.as_snapshot(stored, dt.datetime(2001, 1, 1))
    table.create(stored)
    whole = stored
    now_live = {r.related_id: tuple(r)[1:7] for r in stored.collect()}
    for step in range(3):
        touched = sorted({dice.randrange(80) for _ in range(25)})
        fresh = {r[-1]: r for r in some(i for i in touched if dice.random() < 0.6)}
        now_live = {i: r for i, r in now_live.items() if i not in touched} | fresh
        at = NOW + dt.timedelta(days=step)
        keys = al.low_stock_keys(spark.createDataFrame([(i,) for i in touched], "product_id long"))
        al.reconcile_touched(table, keys, spark.createDataFrame(list(fresh.values()), live_schema), at)
        whole = spark.createDataFrame(al.alerts_merge(whole, spark.createDataFrame(list(now_live.values()), live_schema), at).collect(), DOMAIN_SCHEMAS["notifications"])
        assert rows(table.read(spark)) == rows(whole)
    before = files(scratch)
    assert al.reconcile_touched(table, keys, table.read(spark).join(keys, al.KEY, "left_semi"), NOW) == []
    assert files(scratch) == before


def test_a_catalogue_loaded_twice_opens_its_stock_once(spark):
    from ledgerloom.operators import inventory as inv
    products = spark.createDataFrame([(1, 5), (2, 0), (3, 7)], "id long, current_stock int")
    ledger = spark.createDataFrame([(3, "OPENING_STOCK"), (1, "CHALLAN")], "product_id long, reference_type string")
    first = inv.seed_movements(products, ledger, created_at=NOW)
    assert [(r.product_id, r.quantity_changed) for r in first.collect()] == [(1, 5)]
    assert inv.seed_movements(products, ledger.unionByName(first.select("product_id", "reference_type")), created_at=NOW).collect() == []
    assert first.select(F.max("created_at")).first()[0] == NOW
