"""The queue from batch to batch, and what an operator releases from quarantine."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import queue_state

MOVES = "seq long, item_no long, name string, identity string, rev string, from_lane string, to_lane string"


def moves(spark, *rows):
    return spark.createDataFrame([(s, i, f"p1-x-{d}-r{r}.json", d, r, a, b) for s, i, d, r, a, b in rows], MOVES)


def test_state_grows_by_batches_and_a_repeated_one_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert queue_state.versions(spark, root) == []
    first = moves(spark, (0, 0, "a", "1", None, "claim"), (1, 1, "a", "2", None, "inbox"), (2, 2, "b", "x", None, "deferred"), (3, 3, "b", "7", None, "deferred"))
    assert queue_state.apply(spark, root, first, "one")
    assert not queue_state.apply(spark, root, first, "one")
    second = moves(spark, (4, 0, "a", "1", "claim", "done"), (5, 4, "a", "1", None, "inbox"), (6, 5, "a", "3", None, "inbox"), (7, 6, "b", "5", None, "deferred"), (8, 7, "b", "y", None, "deferred"))
    assert queue_state.apply(spark, root, second, "two")
    t = {name: sorted(map(tuple, df.collect())) for name, df in queue_state.tables(spark, root, 2).items()}
    assert t == {"live": [], "retired": [("a", "1")], "parked": [("b", 7, "y")]}
    got = {r.item_no: r.disposition for r in queue_state.dispositions(spark, root).collect()}
    assert got == {1: "defer", 4: "skip", 5: "admit"}
    assert {name: df.count() for name, df in queue_state.tables(spark, root, 1).items()} == {"live": 1, "retired": 0, "parked": 1}


def test_a_failed_batch_does_not_count(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    batch = moves(spark, (0, 0, "a", "1", None, "claim"))
    with monkeypatch.context() as m:
        m.setattr(queue_state, "judged", lambda *_: (_ for _ in ()).throw(OSError("full")))
        with pytest.raises(OSError, match="full"):
            queue_state.apply(spark, root, batch, "one")
    assert queue_state.versions(spark, root) == []
    assert queue_state.apply(spark, root, batch, "one") and queue_state.versions(spark, root) == [(1, "one")]
    assert [tuple(r) for r in queue_state.tables(spark, root, 1)["live"].collect()] == [("a", 1)]


def test_released_items_never_take_a_name_that_stands_in_the_inbox(spark):
    quarantine = spark.createDataFrame([(1, "a.json"), (2, "b.json"), (3, "b.json"), (4, "c"), (5, "a.json")], "item_no long, name string")
    inbox = spark.createDataFrame([("a.json",), ("a-v3.json",), ("c",)], "name string")
    got = {r.item_no: r.inbox_name for r in queue_state.released(quarantine, inbox).collect()}
    assert got == {1: "a-v2.json", 5: "a-v4.json", 2: "b.json", 3: "b-v2.json", 4: "c-v2"}
    assert queue_state.released(quarantine.filter(F.lit(False)), inbox).count() == 0


def test_released_names_do_not_meet_each_other(spark):
    names = ["a.json", "a-v2.json", "a.json", "a-v2.json", "a-v3.json", "x.tar.gz", "b.", "b.", ".c", ".c", "d-v02", "d", "d", None, ""]
    inbox = ["a.json", "a-v2.json", "a-v5.json", "x.tar.gz", "d", ""]
    quarantine = spark.createDataFrame(list(enumerate(names)), "item_no long, name string")
    got = {r.item_no: r.inbox_name for r in queue_state.released(quarantine, spark.createDataFrame([(n,) for n in inbox], "name string")).collect()}
    assert got == {0: "a-v4.json", 1: "a-v2-v2.json", 2: "a-v6.json", 3: "a-v2-v3.json", 4: "a-v3.json", 5: "x.tar-v2.gz", 6: "b.", 7: "b.-v2", 8: ".c", 9: ".c-v2", 10: "d-v02", 11: "d-v2", 12: "d-v3", 13: None, 14: "-v2"}
    told = [n for n in got.values() if n is not None]
    assert len(set(told)) == len(told) and not set(told) & set(inbox)
