import random

import pytest
from pyspark.sql import functions as F

from kvstrata.operators import mvcc
from kvstrata.sources.log import LOG


def log(spark, rows):
    """rows: key, txid, value (None: delete); seq is their order."""
    return spark.createDataFrame([(bytearray(k.encode()), i, t, v is None, None if v is None else bytearray(v.encode())) for i, (k, t, v) in enumerate(rows)], LOG)


def read(df):
    return {bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in df.collect()}


@pytest.mark.parametrize(
    "rows, as_of, active, expected",
    [
        ([("k", 1, "yes")], 2, [], {"k": "yes"}),
        ([("k", 1, "yes")], 2, [1], {}),
        ([("k", 2, "yes")], 1, [], {}),
        ([("a", 1, "A"), ("b", 2, "B"), ("c", 3, "C")], 4, [2], {"a": "A", "c": "C"}),
        ([("x", 1, "v0"), ("x", 2, "v1"), ("x", 3, "v2"), ("x", 4, "v3")], 5, [], {"x": "v3"}),
        ([("k", 1, "mine")], 1, [1], {"k": "mine"}),
        ([("k", 1, "v"), ("k", 2, None)], 3, [], {}),
        ([("k", 1, "v"), ("k", 2, None)], 3, [2], {"k": "v"}),
        ([("k", 2, "new"), ("k", 1, "old id, later write")], 3, [], {"k": "old id, later write"}),
        ([("k", 1, "")], 2, [], {"k": ""}),
        ([], 2, [], {}),
    ],
)
def test_visibility(spark, rows, as_of, active, expected):
    for wide in (False, True):
        assert read(mvcc.visible(log(spark, rows), as_of, active, wide)) == expected


def test_against_simulation(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(12)}", rng.randrange(1, 40), rng.choice([None, "a", "b", "", "c"])) for _ in range(400)]
    df = log(spark, rows)
    for as_of, active in ((40, []), (20, [3, 5, 19]), (7, list(range(1, 40, 2)))):
        state = {}
        for k, t, v in rows:
            if t <= as_of and (t == as_of or t not in active):
                state[k] = v
        expected = {k: v for k, v in state.items() if v is not None}
        assert read(mvcc.visible(df, as_of, active)) == expected
        assert read(mvcc.visible(df, as_of, spark.createDataFrame([(t,) for t in active], "txid bigint"), wide=True)) == expected


def test_history_counts_and_prune(spark):
    df = log(spark, [("k", 1, "v0"), ("k", 2, "v1"), ("k", 3, None), ("o", 4, "x")])
    assert [(r.n, r.txid, r.is_tombstone) for r in mvcc.versions(df).where("key = CAST('k' AS BINARY)").orderBy("n").collect()] == [(1, 3, True), (2, 2, False), (3, 1, False)]
    lists = {bytes(r.key): [bytes(v.value) if v.value is not None else None for v in r.versions] for r in mvcc.version_lists(df).collect()}
    assert lists == {b"k": [None, b"v1", b"v0"], b"o": [b"x"]}
    assert {bytes(r.key): (r.n_versions, r.n_deletes) for r in mvcc.version_counts(df).collect()} == {b"k": (3, 1), b"o": (1, 0)}
    assert mvcc.prune(df).count() == 2 and mvcc.prune(df, [2]).select("txid").orderBy("txid").collect() == [(1,), (3,), (4,)]
    assert mvcc.written_by(df, 2).count() == 1 and mvcc.written_by(df, 9).count() == 0


def test_conflicts(spark):
    df = log(spark, [("k", 1, "a"), ("k", 2, "b"), ("o", 3, "c")])
    asked = df.select("key").distinct()
    assert [(bytes(r.key), r.holder) for r in mvcc.conflicts(df, asked, 2, [1, 2]).collect()] == [(b"k", 1)]
    assert mvcc.conflicts(df, asked, 1, [1]).count() == 0


def test_replay(spark):
    def records(rows):
        return spark.createDataFrame([(kind, t, k and bytearray(k), v and bytearray(v), i) for i, (kind, t, k, v) in enumerate(rows)], "kind string, txid bigint, key binary, value binary, lsn bigint")

    again = [("UPDATE", 1, b"k", b"1"), ("DELETE", 1, b"k", None), ("UPDATE", 1, b"k", b"2"), ("COMMIT", 1, None, None)]
    lost = [("UPDATE", 2, b"k", b"3"), ("UPDATE", 3, b"z", b"3"), ("ABORT", 3, None, None)]
    assert read(mvcc.replay(records(again + lost))) == {"k": "2"}
    assert mvcc.next_txid(records(again + lost)).first()[0] == 2
    assert mvcc.next_txid(records(lost)).first()[0] == 1


def test_many_hidden_ids_become_a_join(spark):
    df = log(spark, [("k", t, "v") for t in range(3000)])
    hidden = range(0, 2998)
    assert mvcc.without_transactions(df, hidden).count() == 2
    assert mvcc.without_transactions(df, hidden, own=5).agg(F.min("txid")).first()[0] == 5


def test_lock_modes(spark):
    """Shared beside shared; exclusive blocks shared until it is released; held locks are granted again."""
    key = spark.createDataFrame([(bytearray(b"k"),)], "key binary")
    none = spark.createDataFrame([], "txid bigint, key binary, exclusive boolean")
    granted = lambda held, txid, exclusive: mvcc.lock(held, key, txid, exclusive).first()["granted"]
    shared = mvcc.locked(none, key, 1, exclusive=False)
    assert granted(none, 1, False) and granted(shared, 2, False) and not granted(shared, 2, True) and granted(shared, 1, True)
    alone = mvcc.locked(none, key, 1)
    assert not granted(alone, 2, False) and granted(alone, 1, False) and mvcc.locked(alone, key, 1).count() == 1 and mvcc.locked(alone, key, 2).count() == 1
    assert granted(mvcc.unlocked(alone, 1), 2, False)
