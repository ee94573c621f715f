"""Conversation repair against a plain dynamic program that keeps whole audits."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import chat_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = set(" \t\n\x0b\x0c\r")


def brute(rows: list[tuple[str, str]]) -> dict:
    """Rows (role, text) in order; all ways row by row, the least (cost, audit) per state."""
    seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for role, text in rows:
        body = text.strip("".join(BLANK))
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        marked.append((role, text, fault))
    follow = lambda s: "a" if s == "u" else "u"
    best = {"0": (0, "", [])}

    def inserted(best):
        for _ in range(2):
            for s, (cost, audit, out) in list(best.items()):
                to = follow(s)
                new = (cost + 5, audit + "I", [*out, ("user" if to == "u" else "assistant", "")])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    for role, text, fault in marked:
        best, after = inserted(best), {}

        def reach(s, cost, audit, out, after=after):
            if s not in after or (cost, audit) < after[s][:2]:
                after[s] = (cost, audit, out)

        for s, (cost, audit, out) in best.items():
            reach(s, cost + 2, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            to = follow(s)
            if role[:1] == to or (role[:1] == "s" and s == "0"):
                reach("s" if role[:1] == "s" else to, cost + extra, audit + "K", [*out, (role, text)])
            reach(to, cost + extra + 1, audit + "R", [*out, ("user" if to == "u" else "assistant", text)])
        best = after
    cost, audit, out = min(v for s, v in inserted(best).items() if s in "0a")
    initials = [r[:1] for r, _ in rows]
    return faults | {"cost": cost, "audit": audit, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                     "repaired": "\n".join(f"{r}:{t}" for r, t in out)}


def conversation(dice: random.Random, longest: int = 24) -> list[tuple[str, str]]:
    roles = dice.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "system", "tool", ""], ["assistant"]])
    return [(dice.choice(roles), dice.choice(["", " \n", "cut", "Done.", "Why?", f"{dice.random()}.", f"{dice.random()}", "x! "])) for _ in range(dice.randrange(1, longest))]


def symbols(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.strip("".join(BLANK))
        gone = not body or (role, text) in seen
        seen.add((role, text))
        kind = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
        out.append(0 if gone else 1 + 2 * kind + (body[-1] not in ".!?"))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tables_equal_brute_force_however_it_is_cut(seed):
    dice = random.Random(seed)
    for _ in range(150):
        rows = conversation(dice)
        syms, want = symbols(rows), brute(rows)
        cuts = sorted({0, len(syms), *(dice.randrange(len(syms) + 1) for _ in range(dice.randrange(5)))})
        pieces = [syms[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        cost, known = cr.link([cr.cost_table(p) for p in pieces])
        state, tokens = cr.START, ""
        for piece, (end, entries) in zip(pieces, known, strict=True):
            assert state in entries
            own, state = cr.trace(piece, tuple(end), [state])[0]
            tokens += "".join(own)
        assert cost == want["cost"]
        assert (tokens + cr.closing(state)).translate(cr.EDIT) == want["audit"]


def test_jobs_equal_brute_force_with_pieces_of_two_rows(spark, monkeypatch):
    monkeypatch.setattr(cr, "PIECE_BITS", 1)
    dice = random.Random(5)
    chats = {c: conversation(dice) for c in range(60)}
    fixed = cr.repair(spark.createDataFrame([(c, t, role, text) for c, rows in chats.items() for t, (role, text) in enumerate(rows)], SCHEMA))
    digests = {r.conv_id: r.sha256 for r in cr.digests(fixed.messages).collect()}
    got = {r.conv_id: r for r in fixed.summary.collect()}
    assert len(got) == 60
    for c, rows in chats.items():
        want = brute(rows)
        assert {k: getattr(got[c], k) for k in want if k != "repaired"} == {k: v for k, v in want.items() if k != "repaired"}
        assert digests.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(want["repaired"].encode()).hexdigest()


def test_nulls_ties_copies_gaps_and_clashing_columns(spark):
    rows = [(None, 3, "user", "Hi."), (None, None, "system", "Be kind."), (None, 5, "assistant", "Ho."), (None, 5, "assistant", "Ho."), (None, 9, None, None),
            (1, None, "user", "a.")] + [(2, 7, "user", "same.")] * 5000
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS conv", "'x' AS seq", "'x' AS n", "'x' AS rows", "'x' AS audit")
    fixed = cr.repair(df)
    got = {r.conv_id: r for r in fixed.summary.collect()}
    assert (got[None].audit, got[None].gaps, got[None].blank, got[None].duplicate, got[None].cost) == ("KKKDD", 4, 1, 1, 4)
    assert (got[1].audit, got[1].gaps, got[1].cost) == ("D", 0, 2)
    assert (got[2].audit, got[2].duplicate, got[2].illegal, got[2].gaps) == ("D" * 5000, 4999, 4999, 0)
    assert [(m.role, m.text) for m in fixed.messages.orderBy("place", "part").collect()] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Ho.")]


def test_empty_table_and_long_text(spark):
    fixed = cr.repair(spark.createDataFrame([], SCHEMA))
    assert fixed.summary.collect() == [] and fixed.messages.collect() == []
    text = "word " * 200_000 + "end."
    fixed = cr.repair(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + " ")], SCHEMA))
    assert cr.digests(fixed.messages).first().sha256 == hashlib.sha256(f"user:{text}\nassistant:{text} ".encode()).hexdigest()


def test_planted_faults(spark):
    df = spark.createDataFrame([(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)] + [(None, None, None, None)], SCHEMA)
    want = []
    for c in range(40):
        for t in range(5):
            fault = zlib.crc32(f"{c}:{t}".encode()) % 20
            role, text = "user" if fault == 4 else "assistant", {1: "", 2: "One Two"}.get(fault, "One. Two!")
            want += [(c, t, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(tuple(r) for r in cr.damaged(df).where("conv_id IS NOT NULL").collect()) == sorted(want)
    assert zlib.crc32(b" : ") % 20 > 4 and [tuple(r) for r in cr.damaged(df).where("conv_id IS NULL").collect()] == [(None, None, " ", " ")]
