"""Newest-first questions and reviews, and the rules of the notification tables."""

from __future__ import annotations

import datetime as dt

from ledgerloom.operators import crm, listing
from ledgerloom.operators import quality as dq
from tests.frames import QUERIES, USERS, ts

DAY = dt.date(2001, 8, 1)
TIMED = QUERIES + ", created_at timestamp_ntz, resolved_at timestamp_ntz"
REPLIES = "query_id bigint, turn bigint, message string, created_by bigint"
REVIEWS = "id bigint, customer_id bigint, rating int, review string, created_by bigint, created_at timestamp_ntz"


def _question(i, customer, at):
    return (i, customer, f"s{i}", f"m{i}", "OPEN", "LOW", 1, at, None)


def test_questions_newest_first(spark):
    q = spark.createDataFrame([_question(1, 7, ts(DAY)), _question(2, 7, ts(DAY, 5)), _question(3, 7, ts(DAY)), _question(4, 7, None),
                               _question(5, None, ts(DAY)), _question(6, 8, None)], TIMED)
    r = spark.createDataFrame([(2, 1, "a", 1), (2, 2, "b", 1), (99, 1, "c", 1)], REPLIES)
    got = crm.customer_question_list(q, r).orderBy("customer_id", "nth").collect()
    assert [(x.customer_id, x.nth, x.id, x.n_replies) for x in got] == [
        (None, 1, 5, 0), (7, 1, 2, 2), (7, 2, 3, 0), (7, 3, 1, 0), (7, 4, 4, 0), (8, 1, 6, 0)]


def test_reviews_newest_first(spark):
    u = spark.createDataFrame([(1, "Asha", "a@x", "SALES")], USERS)
    rows = [(i, 7, 5, f"r{i}", 1, ts(DAY, i % 3)) for i in range(200)] + [(900, 7, 1, "by nobody", 5, ts(DAY))]
    got = crm.customer_review_list(spark.createDataFrame(rows, REVIEWS), u).orderBy("nth").collect()
    want = sorted((r for r in rows if r[4] == 1), key=lambda r: (r[5], r[0]), reverse=True)
    assert [(x.nth, x.id) for x in got] == [(k + 1, r[0]) for k, r in enumerate(want)]


def test_lists_of_nothing(spark):
    u, none = spark.createDataFrame([], USERS), spark.createDataFrame([], REPLIES)
    assert crm.customer_question_list(spark.createDataFrame([], TIMED), none).collect() == []
    assert crm.customer_review_list(spark.createDataFrame([], REVIEWS), u).collect() == []


def test_orphans_by_text_ids(spark):
    reads = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), (None, 3)], "notification_id string, user_id bigint")
    notes, users = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([(1,), (3,)], "id bigint")
    got = dq.dq_orphans([("notification_reads", "notification_id", reads, notes), ("notification_reads", "user_id", reads, users)], "string")
    assert sorted(map(tuple, got.collect())) == [("notification_reads", "notification_id", "b", 2), ("notification_reads", "user_id", "2", 1)]


def test_badges_of_awkward_names(spark):
    rows = [(1, "Asha Rao"), (2, ""), (3, None), (4, " lead"), (5, "\u00e9lan x"), (6, "one")]
    users = spark.createDataFrame([(i, n, None, "SALES") for i, n in rows], USERS)
    got = {r.id: (r.first_name, r.initial) for r in listing.user_badges(users).collect()}
    assert got == {1: ("Asha", "A"), 2: ("", ""), 3: (None, None), 4: ("", " "), 5: ("\u00e9lan", "\u00e9"), 6: ("one", "o")}
