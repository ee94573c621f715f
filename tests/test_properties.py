"""Property tests: distributed forms equal their sequential / single-window definitions."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions.ordered import positions, running_sum, running_sums
from ledgerloom.operators import alerts as al
from ledgerloom.operators import allocation as alloc
from ledgerloom.plans import keys_alerts, keys_commands

from .conftest import SF_SMALL
from .frames import CHALLANS, PRODUCTS, frame, money, ts

BASE = dt.date(2026, 1, 1)


def _random_batches(seed: int, cases: int):
    """Independent cases with disjoint products, so one Spark run decides them all."""
    rng = random.Random(seed)
    stock, challans, lines, batch = [], [], [], []
    cid = 0
    for case in range(cases):
        prods = [case * 10 + p for p in range(rng.randint(1, 4))]
        for p in prods:
            stock.append((p, rng.randint(0, 12)))
        for _ in range(rng.randint(1, 12)):
            cid += 1
            challans.append((cid, f"CH-{cid}", 1, 1, "DRAFT", ts(BASE), None, None))
            for ln, p in enumerate(rng.sample(prods, rng.randint(1, len(prods)))):
                lines.append((cid, ln, p, rng.randint(1, 6)))
            when = ts(BASE + dt.timedelta(days=rng.randint(0, 3)), rng.randint(0, 2))
            batch.append((cid, when))
    return stock, challans, lines, batch


def _one_at_a_time(stock, lines, batch):
    level = dict(stock)
    items = defaultdict(dict)
    for c, _, p, q in lines:
        items[c][p] = items[c].get(p, 0) + q
    out = {}
    for when, c in sorted((w, c) for c, w in batch):
        if all(level[p] >= q for p, q in items[c].items()):
            for p, q in items[c].items():
                level[p] -= q
            out[c] = "applied"
        else:
            out[c] = "insufficient_stock"
    return out, level


def test_confirm_drafts_equals_sequential(spark):
    stock, challans, lines, batch = _random_batches(7, 120)
    prods = frame(spark, [(p, f"p{p}", f"S{p}", "c", money(1), 0, "L") for p, _ in stock], PRODUCTS)
    res = alloc.confirm_drafts(
        frame(spark, challans, CHALLANS),
        frame(spark, lines, "challan_id bigint, line_no int, product_id bigint, quantity int"),
        frame(spark, stock, "product_id bigint, available bigint"), prods,
        frame(spark, batch, "challan_id bigint, requested_at timestamp_ntz"), ts(BASE))
    expected, level = _one_at_a_time(stock, lines, batch)
    got = {r.challan_id: r.outcome for r in res["decisions"].collect()}
    assert got == expected
    assert {r.product_id: r.available for r in res["stock"].collect()} == level


def test_adjustments_equal_sequential(spark):
    rng = random.Random(11)
    stock = [(p, rng.randint(0, 8)) for p in range(30)]
    cmds = []
    for i in range(400):
        p = rng.randrange(30)
        cmds.append((i, p, rng.choice(["IN", "OUT", "OUT"]), rng.randint(1, 6),
                     ts(BASE + dt.timedelta(days=rng.randint(0, 5)), rng.randint(0, 23))))
    df = frame(spark, cmds, "command_id bigint, product_id bigint, movement_type string, quantity int, "
                            "requested_at timestamp_ntz")
    got = {r.command_id: r.outcome for r in
           alloc.apply_adjustments(df, frame(spark, stock, "product_id bigint, available bigint"),
                                   frame(spark, [(p,) for p in range(30)], "id bigint")).collect()}
    level = dict(stock)
    for i, p, kind, q, _ in sorted(cmds, key=lambda c: (c[4], c[0])):
        if kind == "IN":
            level[p] += q
            assert got[i] == "applied"
        elif level[p] >= q:
            level[p] -= q
            assert got[i] == "applied"
        else:
            assert got[i] == "insufficient_stock"


def test_split_windows_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 5), ts(BASE + dt.timedelta(days=rng.randint(0, 20)),
                                                                rng.randint(0, 23)), i, rng.randint(-5, 9))
            for i in range(3000)]   # key 0 is hot: ~40 % of all rows
    df = frame(spark, rows, "k bigint, t timestamp_ntz, i bigint, v bigint")
    plain = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("t", "i")
                                              .rowsBetween(Window.unboundedPreceding, 0)))
    split = running_sum(df, ["k"], ["t", "i"], "v", "s", bucket=F.to_date("t"))
    assert sorted(plain.collect()) == sorted(split.collect())
    excl = running_sums(df, ["k"], ["t", "i"], {"s": F.col("v")}, bucket=F.to_date("t"), inclusive=False)
    plain_excl = df.withColumn("s", F.coalesce(F.sum("v").over(
        Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert sorted(plain_excl.collect()) == sorted(excl.select(*plain_excl.columns).collect())
    rn = df.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("t", "i")))
    assert sorted(rn.collect()) == sorted(positions(df, ["k"], ["t", "i"], "pos", bucket=F.to_date("t")).collect())
    rng_frame = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("t")))
    assert sorted(rng_frame.collect()) == sorted(
        running_sum(df, ["k"], ["t"], "v", "s", bucket=F.to_date("t"), frame="range").collect())


def test_confirm_drafts_fixture_matches_sequential(spark):
    res = keys_commands.confirm_drafts_fixture(spark, SF_SMALL)
    got = {r.challan_id: r.outcome for r in res["decisions"].collect()}
    assert sum(1 for v in got.values() if v == "applied") == 253
    assert sum(1 for v in got.values() if v in ("applied", "insufficient_stock")) == 507


def test_alert_merge_is_idempotent(spark):
    st = keys_alerts._State(spark, SF_SMALL)
    once = st.merged
    twice = al.alerts_merge(once, st.live, keys_alerts.NOW)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_ledger_sum_is_last_running_balance(spark):
    from ledgerloom.operators import inventory as inv
    from ledgerloom.sources.fixtures import Fixture
    mv = Fixture(spark, SF_SMALL).movements()
    bal = inv.stock_running_balance(mv)
    last = bal.groupBy("product_id").agg(F.max_by("balance", "created_at").alias("current_stock"))
    assert sorted(last.collect()) == sorted(inv.stock_levels(mv).collect())


def test_bounded_chunks_reassemble(spark):
    from ledgerloom.functions.ordered import nest_ordered
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randint(0, 9)) for i in range(60)]
    df = frame(spark, rows, "k bigint, i bigint, v bigint")
    nested = nest_ordered(df, ["k"], ["v", "i"], ["i", "v"], "xs", chunk_size=4, bucket=F.col("v"))
    got = defaultdict(list)
    for r in sorted(nested.collect(), key=lambda r: (r.k, r.chunk_no)):
        assert len(r.xs) <= 4
        got[r.k].extend((x.i, x.v) for x in r.xs)
    want = defaultdict(list)
    for k, i, v in sorted(rows, key=lambda t: (t[0], t[2], t[1])):
        want[k].append((i, v))
    assert dict(got) == dict(want)


def test_split_helpers_keep_rows_with_null_keys(spark):
    rows = [(None, ts(BASE, 1), 1, 2), (None, ts(BASE, 2), 2, 3), (1, None, 3, 4), (1, ts(BASE, 3), 4, 5)]
    df = frame(spark, rows, "k bigint, t timestamp_ntz, i bigint, v bigint")
    out = running_sum(df, ["k"], ["t", "i"], "v", "s", bucket=F.date_trunc("hour", F.col("t")))
    plain = df.withColumn("s", F.sum("v").over(Window.partitionBy("k").orderBy("t", "i")
                                              .rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(out.collect(), key=str) == sorted(plain.collect(), key=str)
    pos = positions(df, ["k"], ["t", "i"], "pos", bucket=F.date_trunc("hour", F.col("t")))
    assert pos.count() == 4


def test_question_transitions_equal_sequential(spark):
    from ledgerloom.operators import commands as cm
    rng = random.Random(17)
    queries = [(q, 1, "s", "m", rng.choice(["OPEN", "IN_PROGRESS", "RESOLVED"]), "LOW", 1) for q in range(40)]
    cmds = [(i, rng.randrange(42), rng.choice(["reply", "reply", "resolve"])) for i in range(300)]  # 40, 41 unknown
    got = {r.command_id: (r.outcome, r.status_after) for r in cm.query_transitions(
        frame(spark, queries, "id bigint, customer_id bigint, subject string, message string, status string, "
                              "priority string, created_by bigint"),
        frame(spark, cmds, "command_id bigint, query_id bigint, action string"), ts(BASE)).collect()}
    state = {q: st for q, _, _, _, st, _, _ in queries}
    for i, q, action in cmds:
        if q not in state:
            want = ("not_found", None)
        elif state[q] == "RESOLVED":
            want = ("conflict" if action == "reply" else "not_found", "RESOLVED")
        elif action == "reply":
            state[q] = "IN_PROGRESS"
            want = ("applied", "IN_PROGRESS")
        else:
            state[q] = "RESOLVED"
            want = ("applied", "RESOLVED")
        assert got[i] == want, (i, q, action)


def test_one_shot_transitions_equal_sequential(spark):
    from ledgerloom.operators import commands as cm
    rng = random.Random(23)
    reqs = [(r, 1, 1, 5, "LOW", "m", rng.choice(["PENDING", "APPROVED", "REJECTED"]), None, ts(BASE))
            for r in range(30)]
    cmds = [(i, rng.randrange(33)) for i in range(120)]
    got = {r.command_id: r.outcome for r in cm.review_requests(
        frame(spark, reqs, "id bigint, product_id bigint, requested_by bigint, quantity int, urgency string, "
                           "message string, status string, reviewed_by bigint, created_at timestamp_ntz"),
        frame(spark, cmds, "command_id bigint, request_id bigint"), 2, ts(BASE), "reject").collect()}
    state = {r[0]: r[6] for r in reqs}
    for i, rid in cmds:
        if rid not in state:
            want = "not_found"
        elif state[rid] == "PENDING":
            state[rid], want = "REJECTED", "applied"
        else:
            want = "conflict"
        assert got[i] == want, (i, rid)
