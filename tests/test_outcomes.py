"""Every outcome that an operator can tell occurs in the test tables, so that equal rows mean something."""

import pytest

from millrace.queries import QUERIES

D = "/root/testdata/sf0.01"
OUTCOMES = {
    "admission": ("disposition", {"reject", "skip", "defer", "admit"}),
    "auth_failures": ("auth", {True, False}),
    "failed_retry": ("verdict", {"no run", "superseded", "owned", "retry"}),
    "gc_plan": ("verdict", {"pinned", "waiting", "running", "locked", "skipped", "retained", "delete"}),
    "inbox_cards": ("kind", {"answerable", "waiting_other"}),
    "learning_warnings": ("warning", {"no pipeline: no manifest", "no pipeline: manifest can't be read", "skipped: no trail"}),
    "ledger_audit": ("issue", {"pointer without item", "item without pointer", "claim without reservation", "identity in two live lanes"}),
    "lease_reap": ("action", {"stuck", "held", "flag", "waiting", "requeue"}),
    "promote_deferred": ("action", {"drop", "promote"}),
    "retire": ("lane", {"done", "waiting", "failed"}),
    "rev_orders": ("rev_order", {-1, 0, 1, None}),
    "run_status": ("status", {"gate", "halted", "done", "stale", "running"}),
    "stale_watch": ("status", {"gate", "halted", "done", "stale", "running"}),
    "stranded_deferred": ("action", {"keep", "promote"}),
    "sweep": ("action", {"done", "failed", "leave", "resume"}),
    "write_backs": ("status", {"closed", "changed", "current"}),
}


@pytest.mark.parametrize("name", sorted(OUTCOMES))
def test_every_outcome_occurs(spark, name):
    column, want = OUTCOMES[name]
    assert {r[0] for r in QUERIES[name](spark, D).select(column).distinct().collect()} == want


def test_gauges_of_leases_are_not_zero(spark):
    row = QUERIES["lease_status"](spark, D).first()
    assert min(row.lease_count, row.expired_live, row.missing_lease) > 0
