from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.operators import ledger as L


def fold(amounts, balance=0):
    out = []
    for a in amounts:
        ok = a >= 0 or balance + a >= 0
        balance += a if ok else 0
        out.append((ok, balance))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_transfer_pieces_match_brute_force(seed):
    rng = random.Random(seed)
    amounts = [rng.choice([3, -1, -rng.randint(1, 40), rng.randint(0, 30)]) for _ in range(200)]
    starts, shifts = L.transfer_pieces(amounts)
    assert starts[0] == 0 and (np.diff(starts) > 0).all()
    for opening in range(0, 400):
        i = np.searchsorted(starts, opening, side="right") - 1
        assert opening + shifts[i] == fold(amounts, opening)[-1][1]


def busy_ledger(spark):
    rng = random.Random(5)
    rows = [(i, 1 if rng.random() < 0.6 else rng.randint(2, 9), rng.choice([3, -1, -rng.randint(1, 40), rng.randint(0, 30)]), 1_700_000_000 + i * 977)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, wallet_id long, amount long, at long")
    return rows, df.withColumn("created_at", F.timestamp_seconds("at"))


@pytest.mark.parametrize("seed", range(6))
def test_pieces_of_two_runs_one_after_the_other(seed):
    rng = random.Random(seed)
    first, second = ([rng.choice([3, -1, -rng.randint(1, 40), rng.randint(0, 30)]) for _ in range(n)] for n in (60, seed * 9))
    starts, shifts = L.then(L.transfer_pieces(first), L.transfer_pieces(second))
    whole = L.transfer_pieces(first + second)
    assert (starts == whole[0]).all() and (shifts == whole[1]).all()


@pytest.mark.parametrize(("slice_rows", "fan_in"), [(10_000, 64), (7, 2), (300, 3)])
def test_admission_is_exact_whatever_the_slices(spark, slice_rows, fan_in):
    rows, df = busy_ledger(spark)
    got = {r["id"]: (r["accepted"], r["balance"]) for r in L.admit(df.repartition(6), slice_rows=slice_rows, fan_in=fan_in).collect()}
    want = {}
    for wallet in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == wallet]
        want.update({r[0]: d for r, d in zip(own, fold([r[2] for r in own]))})
    assert got == want
    assert min(b for _, b in got.values()) >= 0


def test_ledger_sum_equals_last_balance(spark):
    _, df = busy_ledger(spark)
    run = L.running_balances(df, 7200).groupBy("wallet_id").agg(F.max_by("balance", F.struct("created_at", "id")).alias("last"))
    assert run.join(L.balances(df), "wallet_id").filter("last <> balance").count() == 0


def test_repeated_key_counts_once_and_null_keys_always(spark):
    df = spark.sql("""select * from values (1L, 1L, 5L, 'k', timestamp'2024-01-01 00:00:01'), (2L, 1L, 5L, 'k', timestamp'2024-01-01 00:00:02'),
        (3L, 1L, 2L, null, timestamp'2024-01-01 00:00:03'), (4L, 1L, 2L, null, timestamp'2024-01-01 00:00:03')
        t(id, wallet_id, amount, idempotency_key, created_at)""")
    assert sorted(r["id"] for r in L.idempotent(df).collect()) == [1, 3, 4]
