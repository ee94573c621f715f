"""Physical-plan report for every registered key (writes PLANS.md).

For each key: number of shuffles (``Exchange``), broadcasts, scans and
whether filters reached them, window group limits, Python operators. The
plan is the initial adaptive plan (before runtime re-optimisation).
Usage: ``python -m ledgerloom.plans.report [sf_dir] [out.md]``. Stream keys
run their queries; they are listed without a plan.
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

STREAM_KEYS = {"stream_stock_levels", "stream_sales_daily", "stream_alerts", "rate_violations",
               "stream_low_stock_changes", "confirm_drafts", "apply_adjustments"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def _real_filters(pushed: str) -> bool:
    """A pushed filter list with more than null checks."""
    rest = re.sub(r"IsNotNull\([^)]*\)", "", pushed).replace(",", "").strip()
    return bool(rest)


def summarize(text: str) -> dict:
    head = text.split("\n\n")[0]
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    return {
        "exchanges": len(re.findall(r"\bExchange \(", head)),
        "scans": len(re.findall(r"Scan parquet", head)),
        "scans_with_pushed_filters": sum(1 for p in pushed if _real_filters(p)),
        "window_group_limit": "WindowGroupLimit" in head,
        "python": bool(re.search(r"ArrowEvalPython|FlatMapGroupsInPandas|BatchEvalPython", head)),
        "sort_merge_joins": head.count("SortMergeJoin"),
        "broadcast_joins": head.count("BroadcastHashJoin") + head.count("BroadcastNestedLoopJoin"),
    }


def main(argv) -> None:
    from ledgerloom.plans.registry import queries
    from ledgerloom.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    out = argv[2] if len(argv) > 2 else "PLANS.md"
    spark = build_session()
    rows = []
    for key, job in sorted(queries().items()):
        if key in STREAM_KEYS:
            continue
        s = summarize(plan_text(job(spark, sf_dir)))
        rows.append((key, s))
    with open(out, "w", encoding="utf-8") as f:
        f.write("# Physical plans at a glance\n\n")
        f.write(f"Generated by `python -m ledgerloom.plans.report {sf_dir}` (initial adaptive plans, "
                "local session, 32 MB broadcast threshold). At the fixture sizes the optimizer broadcasts "
                "the small sides; at scale the same plans fall back to sort-merge joins, and AQE "
                "re-decides from measured sizes.\n\n"
                "Reading notes:\n\n"
                "* Alert keys (`alerts_merge`, `inbox`, `unread_count`, `mark_all_read`) read the stored and "
                "reconciled snapshots from checkpoints (tables in production), so they show no Parquet scan.\n"
                "* Scans of fixture views rarely show pushed predicates: status and confirmation time are "
                "`CASE` expressions over `o_orderstatus`, which a Parquet reader cannot prune on. On stored "
                "domain tables the same filters are plain column predicates and reach the reader.\n"
                "* Each scalar subquery (`COUNT(*)` of suppliers, customers or parts in the fixture mapping, "
                "the maximum in share-of-max) adds one small scan.\n"
                "* Not listed: the iterative allocation (`confirm_drafts`, `apply_adjustments`: one plan per "
                "round over checkpointed state) and the five streaming keys.\n\n")
        f.write("| key | shuffles | broadcast joins | sort-merge joins | scans | scans with pushed predicates "
                "| WindowGroupLimit | Python |\n|---|---|---|---|---|---|---|---|\n")
        for key, s in rows:
            f.write(f"| {key} | {s['exchanges']} | {s['broadcast_joins']} | {s['sort_merge_joins']} | {s['scans']} "
                    f"| {s['scans_with_pushed_filters']} | {'yes' if s['window_group_limit'] else ''} "
                    f"| {'yes' if s['python'] else ''} |\n")
    print(f"wrote {out} ({len(rows)} keys)")


if __name__ == "__main__":
    main(sys.argv)
