from __future__ import annotations

import random

from sitelake.operators import ledger as L
from sitelake.streaming import run


def plain(rows):
    """One row after the other: a key is used up by an accepted row, on whichever wallet."""
    balance, used, out = {}, set(), {}
    for wallet, row_id, at, amount, key in sorted(rows, key=lambda r: (r[2], r[1])):
        if key in used:
            continue
        have = balance.get(wallet, 0)
        taken = amount >= 0 or have + amount >= 0
        balance[wallet] = have + amount if taken else have
        if taken and key is not None:
            used.add(key)
        out[row_id] = (taken, balance[wallet])
    return out


def ledger(spark, rows):
    return spark.createDataFrame(rows, "wallet_id long, id long, created_at timestamp, amount long, idempotency_key string")


def rows_of(seed, n=300):
    from datetime import datetime, timedelta

    rng = random.Random(seed)
    return [
        (rng.randint(1, 6), i, datetime(2025, 1, 1) + timedelta(hours=rng.randint(0, 400)), rng.choice([3, 2, -1, -2, -5]), rng.choice([None, *(f"k{k}" for k in range(60))]))
        for i in range(n)
    ]


def test_rejected_rows_leave_their_key_free(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        found = {r.id: (r.accepted, r.balance) for r in L.decide(ledger(spark, rows)).collect()}
        assert found == plain(rows)


def test_retry_and_key_in_two_wallets(spark):
    from datetime import datetime

    at = [datetime(2025, 1, d) for d in range(1, 8)]
    rows = [(1, 1, at[0], -4, "a"), (1, 2, at[1], 5, None), (1, 3, at[2], -4, "a"), (1, 4, at[3], -1, "a"), (2, 5, at[4], 9, None), (2, 6, at[5], -2, "a")]
    found = {r.id: (r.accepted, r.balance) for r in L.decide(ledger(spark, rows)).collect()}
    assert found == {1: (False, 0), 2: (True, 5), 3: (True, 1), 5: (True, 9)}
    assert sorted(r.id for r in L.standing(ledger(spark, rows)).collect()) == [2, 3, 5]


def test_batches_continue_from_one_another(spark, tmp_path):
    rows = sorted(rows_of(3, 160), key=lambda r: (r[2], r[1]))
    schema = ledger(spark, rows).schema
    found, sizes = None, []
    for part in (rows[:50], rows[50:60], rows[60:120], rows[120:]):
        ledger(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if len(part) == 10:
            continue  # two batches in one call
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = run.admit_batches(stream, str(tmp_path / "base"))
    assert {r.id: (r.accepted, r.balance) for r in found.collect()} == plain(rows)
    # What is taken in with a batch are the changes of the last one only.
    assert len([f for f in (tmp_path / "base" / "changes").rglob("*.parquet") if f.stat().st_size]) <= 64
