"""Credit ledger: idempotent rows, admission of debits, balances and adjustments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sitelake.functions.text import tier_of_download_key
from sitelake.operators.skew import running_sums, time_segment
from sitelake.session import cut_lineage

# Fixed values.
SIGNUP_GRANT = 3

LEDGER_ORDER = ["created_at", "id"]


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def idempotent(ledger: DataFrame) -> DataFrame:
    """Keep the first row of every non-null idempotency key and every row without a key, for ledgers of rows that all count.

    First rows are found by an aggregate, not a window: a key that repeats without end shuffles one
    partial row per task.
    """
    names = ledger.columns
    keyed = ledger.filter("idempotency_key is not null")
    rest = [c for c in names if c != "idempotency_key"]
    first = keyed.groupBy("idempotency_key").agg(F.min_by(F.struct(*rest), F.struct(*LEDGER_ORDER)).alias("r"))
    return first.select("r.*", "idempotency_key").select(*names).unionByName(ledger.filter("idempotency_key is null"))


_END = np.iinfo(np.int64).max


def transfer_pieces(amounts: Iterable[int], low: int = 0, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How a run of signed amounts moves the starting balances from `low` on, `width` of them or all above.

    Returns `(starts, shifts)`: a balance in `[starts[i], starts[i+1])` ends at `balance + shifts[i]`.
    Credits always apply; a debit applies only where the balance covers it.
    """
    starts, shifts = np.full(1, low, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for amount in amounts:
        if amount >= 0:
            shifts = shifts + amount
            continue
        need = -int(amount)
        now = starts + shifts
        high = np.append(starts[1:] + shifts[:-1], _END if width is None else low + width + shifts[-1])
        split = np.flatnonzero((now < need) & (high > need))
        if split.size:
            starts = np.insert(starts, split + 1, need - shifts[split])
            shifts = np.insert(shifts, split + 1, shifts[split])
        shifts = np.where(starts + shifts >= need, shifts - need, shifts)
        fresh = np.append(True, shifts[1:] != shifts[:-1])
        starts, shifts = starts[fresh], shifts[fresh]
    return starts, shifts


def then(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of one run of amounts followed by another, over `width` starting balances or all."""
    (starts, shifts), (later, moves) = first, second
    # Where the balances of a piece end up.
    ends = np.append(starts[1:] + shifts[:-1], _END if width is None else starts[0] + width + shifts[-1])
    low = np.searchsorted(later, starts + shifts, side="right") - 1
    counts = np.maximum(np.searchsorted(later, ends, side="left") - low, 1)
    piece = np.repeat(np.arange(len(starts)), counts)
    at = np.repeat(low, counts) + np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    out_starts = np.maximum(starts[piece], later[at] - shifts[piece])
    out_shifts = shifts[piece] + moves[at]
    fresh = np.append(True, out_shifts[1:] != out_shifts[:-1])
    return out_starts[fresh], out_shifts[fresh]


#: Rows of a wallet that are summarised at a time, and summaries that are chained at a time. They set sizes of work, not results.
SLICE_ROWS, FAN_IN = 10_000, 64
_SLICE = "wallet_id long, part long, k long, open boolean, ids array<long>, amounts array<long>, total long, rest long, debit long"


def _slices(rows: DataFrame, slice_rows: int) -> DataFrame:
    """Rows in ledger order, cut where the wallet changes and after `slice_rows` rows; part and k order the slices of a wallet.

    Rows are dealt out by ranges of wallet and time, so a wallet with a large share of them lies in many partitions. A slice is open
    if its wallet may have others: only those are summarised. A slice tells its sum, what it leaves of a balance that is cut off at 0,
    and its largest debit.
    """
    out = arrow_schema(_SLICE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []  # finished slices of this partition that wait to be sent
        wallet, k, ids, amounts, first = None, 0, [], [], True

        def close(more: bool) -> None:
            sums = np.cumsum(np.asarray(amounts, dtype=np.int64))
            held.append((wallet, part, k, more, list(ids), list(amounts), int(sums[-1]), int(sums[-1] - sums.min()), max(0, -min(amounts))))
            ids.clear()
            amounts.clear()

        def send() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), out)], schema=out)
            held.clear()
            return batch

        for batch in batches:
            for owner, row_id, amount in zip(*(batch.column(c).to_pylist() for c in ("wallet_id", "id", "amount"))):
                if ids and owner != wallet:
                    close(first or k > 0)
                    wallet, k, first = owner, 0, False
                elif len(ids) == slice_rows:
                    close(True)
                    k += 1
                wallet = owner
                ids.append(row_id)
                amounts.append(amount)
            if sum(len(h[4]) for h in held) > slice_rows:
                yield send()
        if ids:
            close(True)
        if held:
            yield send()

    order = ["wallet_id", *LEDGER_ORDER]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("wallet_id", "id", "amount").mapInArrow(cut, _SLICE)


def _placed(slices: DataFrame) -> DataFrame:
    """wallet_id, part, k of the open slices, `at`, their place in the wallet, and the `width` balances from `low` on they may begin with.

    Cut every debit to what the balance holds: the balance is then low, the running sum above its least value, which sums over slices
    give. The true one is never lower, as a refused debit takes nothing. It is above low by less than the largest debit: that holds at
    first, credits and covered debits keep the distance or shorten it, and a debit is refused only by a balance below it.
    """
    order = Window.partitionBy("wallet_id").orderBy("part", "k")
    before, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("wallet_id")
    rows = slices.where("open").select("wallet_id", "part", "k", "total", "rest", "debit").withColumns(
        {"at": F.row_number().over(order).cast("long") - 1, "upto": F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    lift = F.greatest(F.lit(0), F.coalesce(F.max(F.col("rest") - F.col("upto")).over(before), F.lit(0)))
    return rows.select("wallet_id", "part", "k", "at", (F.col("upto") - F.col("total") + lift).alias("low"), F.greatest(F.max("debit").over(all_of), F.lit(1)).alias("width"))


_PIECES = "wallet_id long, at long, width long, starts array<long>, shifts array<long>"


def _summarised(placed: DataFrame) -> DataFrame:
    """The pieces of every open slice, over the balances it may begin with: no more of them than its wallet's largest debit."""
    out = arrow_schema(_PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wallet, at, low, width, amounts in zip(*(batch.column(c).to_pylist() for c in ("wallet_id", "at", "low", "width", "amounts"))):
                starts, shifts = transfer_pieces(amounts, low, width)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((wallet, at, width, starts, shifts), out)], schema=out)

    return placed.select("wallet_id", "at", "low", "width", "amounts").mapInArrow(run, _PIECES)


def _composed(pieces: DataFrame) -> DataFrame:
    """One summary for each group (wallet_id, up) of summaries, in the order of `at`; a group has as many as a level holds."""

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        width = int(group["width"].iloc[0])
        parts = [(np.asarray(r.starts), np.asarray(r.shifts)) for r in group.sort_values("at").itertuples()]
        starts, shifts = reduce(lambda a, b: then(a, b, width), parts)
        return pd.DataFrame({"wallet_id": group["wallet_id"][:1], "at": group["up"][:1], "width": [width], "starts": [starts], "shifts": [shifts]})

    return pieces.groupBy("wallet_id", "up").applyInPandas(compose, _PIECES)


def _opened(pieces: DataFrame, opening: DataFrame | None) -> DataFrame:
    """Opening balance of every piece (wallet_id, at) from that of its group (wallet_id, up); 0 without groups above."""
    slices = F.array_sort(F.collect_list(F.struct("at", "starts", "shifts")))
    groups = pieces.groupBy("wallet_id", "up").agg(slices.alias("slices"))
    groups = groups.withColumn("opening", F.lit(0).cast("long")) if opening is None else groups.join(
        opening.select("wallet_id", F.col("at").alias("up"), "opening"), ["wallet_id", "up"])
    seed = F.struct(F.col("opening").alias("balance"), F.array().cast("array<struct<at:bigint,opening:bigint>>").alias("out"))

    def step(acc, part):
        balance = acc["balance"]
        # Starts are sorted, so the count of starts at or below the balance names the piece.
        piece = F.size(F.filter(part["starts"], lambda s: s <= balance))
        entry = F.struct(part["at"].alias("at"), balance.alias("opening"))
        return F.struct((balance + F.element_at(part["shifts"], piece)).alias("balance"), F.concat(acc["out"], F.array(entry)).alias("out"))

    return groups.select("wallet_id", F.inline(F.aggregate("slices", seed, step)["out"]))


def slice_openings(slices: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """wallet_id, part, k, opening of the open slices.

    Summaries are composed upwards, `fan_in` at a time, until a wallet has one group; opening balances then come down the same levels.
    The number of levels is the logarithm of the number of slices of a wallet.
    """
    placed = cut_lineage(_placed(slices))
    slots = (placed.agg(F.max("at")).first()[0] or 0) + 1

    def grouped(pieces: DataFrame) -> DataFrame:
        return pieces.withColumn("up", F.floor(F.col("at") / fan_in).cast("long"))

    levels = [grouped(cut_lineage(_summarised(slices.join(placed, ["wallet_id", "part", "k"]))))]
    while slots > fan_in:
        levels.append(grouped(cut_lineage(_composed(levels[-1]))))
        slots = -(-slots // fan_in)
    opening = None
    for level in reversed(levels):
        opening = _opened(level, opening)
    return placed.select("wallet_id", "part", "k", "at").join(opening, ["wallet_id", "at"]).select("wallet_id", "part", "k", "opening")


_DECIDED = "wallet_id long, id long, amount long, accepted boolean, balance long"


def admit(ledger: DataFrame, slice_rows: int = SLICE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Decide every ledger row in time order per wallet: a debit counts only if the balance covers it.

    A rejected debit changes what later debits see, so this is no running sum. The ledger is cut into slices of rows; each is
    summarised on its own as piecewise shifts of the starting balances that running sums leave open, the summaries are chained in a
    tree, and every slice is then decided from a known opening balance. No task or list holds the rows of a wallet.
    """
    rows = ledger.select("wallet_id", "id", "created_at", F.col("amount").cast("long").alias("amount"))
    slices = cut_lineage(_slices(rows, slice_rows))
    out = arrow_schema(_DECIDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wallet, ids, amounts, balance in zip(*(batch.column(c).to_pylist() for c in ("wallet_id", "ids", "amounts", "opening"))):
                accepted, after = [], []
                for amount in amounts:
                    taken = amount >= 0 or balance + amount >= 0
                    balance += amount if taken else 0
                    accepted.append(taken)
                    after.append(balance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(([wallet] * len(ids), ids, amounts, accepted, after), out)], schema=out)

    held = slices.select("wallet_id", "part", "k", "open", "ids", "amounts")
    waiting = held.where("open").join(slice_openings(slices, fan_in), ["wallet_id", "part", "k"])
    ready = held.where("not open").withColumn("opening", F.lit(0).cast("long")).unionByName(waiting)
    return ready.select("wallet_id", "ids", "amounts", "opening").mapInArrow(run, _DECIDED)


def decide(ledger: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Decide a ledger whose keys count once over all wallets, and only with an accepted row: a rejected debit leaves its key free.

    The row of a key that counts is its first accepted one; rows after it are repeats and drop out, rows before it stand as rejected.
    Which row that is depends on balances, which depend on other keys. So a first round admits the first row of every repeated key and
    all rows without one; each further round takes the first accepted rows that the last one found and decides again only the wallets
    that hold a row of a key whose row changed, until none does. A round settles at least the earliest open row of the table; with one
    retry for a key it takes two or three rounds. `opening` has wallet_id and balance.
    """
    columns = ["wallet_id", "id", "created_at", "amount", "idempotency_key"]
    rows = cut_lineage(ledger.select(*columns))
    place = F.struct(*LEDGER_ORDER)
    repeated = rows.filter("idempotency_key is not null").groupBy("idempotency_key").agg(F.min(place).alias("upto"), F.count("*").alias("n"))
    known = cut_lineage(repeated.filter("n > 1").drop("n"))
    contested = cut_lineage(rows.join(known.select("idempotency_key"), "idempotency_key", "left_semi"))

    def admitted(given: DataFrame, start: DataFrame | None, keys: DataFrame) -> DataFrame:
        # `upto` is null for a key that is not repeated, and for one of which no row is known to count: all its rows are tried.
        active = given.join(keys, "idempotency_key", "left").filter(F.col("upto").isNull() | (place <= F.col("upto"))).select(*columns)
        if start is not None:
            begin = F.lit(0).cast("timestamp").cast(rows.schema["created_at"].dataType)
            active = active.unionByName(start.select(
                "wallet_id", F.lit(None).cast("long").alias("id"), begin.alias("created_at"), F.col("balance").alias("amount"),
                F.lit(None).cast("string").alias("idempotency_key")))
        return cut_lineage(admit(active).filter("id is not null"))

    decided = admitted(rows, opening, known)
    while True:
        accepted = contested.join(decided.filter("accepted").select("id"), "id")
        found = accepted.groupBy("idempotency_key").agg(F.min(place).alias("upto"))
        step = cut_lineage(known.withColumnRenamed("upto", "before").join(found, "idempotency_key", "left"))
        changed = step.filter(~F.col("before").eqNullSafe(F.col("upto"))).select("idempotency_key")
        wallets = cut_lineage(contested.join(changed, "idempotency_key", "left_semi").select("wallet_id").distinct())
        if wallets.isEmpty():
            return decided
        known = step.drop("before")
        again = admitted(rows.join(wallets, "wallet_id", "left_semi"), opening and opening.join(wallets, "wallet_id", "left_semi"), known)
        decided = decided.join(wallets, "wallet_id", "left_anti").unionByName(again)


def standing(ledger: DataFrame) -> DataFrame:
    """The rows of a ledger that count."""
    return ledger.join(decide(ledger).filter("accepted").select("id"), "id", "left_semi")


def running_balances(ledger: DataFrame, segment_seconds: int = 86_400) -> DataFrame:
    """Balance after each row of a ledger whose rows all count."""
    return running_sums(ledger, ["wallet_id"], LEDGER_ORDER, {"balance": F.col("amount")}, time_segment("created_at", segment_seconds))


def balances(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("wallet_id").agg(F.sum("amount").alias("balance"))


def balance_drift(wallets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Wallets whose cached balance is not the sum of their ledger, either side possibly missing."""
    summed = balances(ledger).withColumnRenamed("balance", "ledger_balance")
    joined = wallets.select(F.col("id").alias("wallet_id"), F.col("balance").alias("cached_balance")).join(summed, "wallet_id", "full_outer")
    cached, actual = F.coalesce("cached_balance", F.lit(0)), F.coalesce("ledger_balance", F.lit(0))
    return joined.select("wallet_id", cached.alias("cached_balance"), actual.alias("ledger_balance")).filter(
        F.col("cached_balance") != F.col("ledger_balance")
    )


def adjustment_rows(admitted: DataFrame, requests: DataFrame) -> DataFrame:
    """Accepted adjustments as paired rows: a zero-dollar purchase carrying the note, and the ledger row.

    A request without a note is refused before it reaches the ledger (see `noted`).
    """
    accepted = admitted.filter("accepted").join(requests.select("id", "note"), "id")
    kinds = F.explode(F.array(F.lit("purchase"), F.lit("ledger")))
    paired = accepted.withColumn("row_kind", kinds)
    is_purchase = F.col("row_kind") == "purchase"
    return paired.select(
        "wallet_id", "row_kind", F.col("amount").alias("credits"),
        F.when(is_purchase, F.lit(0)).alias("amount_usd_cents"), F.when(is_purchase, F.col("note")).alias("note"),
        F.when(~is_purchase, F.concat(F.lit("admin_adjustment:"), F.col("id").cast("string"))).alias("idempotency_key"),
    )


def noted(requests: DataFrame) -> DataFrame:
    return requests.filter("trim(coalesce(note, '')) <> '' and amount <> 0")


def missing_signup_grants(users: DataFrame, ledger: DataFrame) -> DataFrame:
    granted = ledger.filter("reason = 'signup_grant'").select("idempotency_key").distinct()
    wanted = users.select("id", F.concat(F.lit("signup_grant:"), F.col("id").cast("string")).alias("idempotency_key"))
    return wanted.join(granted, "idempotency_key", "left_anti").select(
        F.col("id").alias("user_id"), F.lit(SIGNUP_GRANT).alias("amount"), "idempotency_key"
    )


def missing_purchase_grants(purchases: DataFrame, ledger: DataFrame) -> DataFrame:
    granted = ledger.filter("idempotency_key is not null").select("idempotency_key").distinct()
    wanted = purchases.filter("status = 'completed' and credits_granted > 0").select(
        "id", "user_id", F.col("credits_granted").alias("amount"), F.concat(F.lit("purchase:"), F.col("id").cast("string")).alias("idempotency_key")
    )
    return wanted.join(granted, "idempotency_key", "left_anti")


def paid_tiers(ledger: DataFrame, wallets: DataFrame) -> DataFrame:
    """Tiers a user has paid to download, per project; charges on other wallets never leak in."""
    charges = ledger.filter("reason = 'download_spend'").withColumn("tier", tier_of_download_key("idempotency_key", "related_project_id"))
    owned = charges.filter("tier is not null").join(wallets.select("wallet_id", "user_id"), "wallet_id")
    return owned.groupBy("user_id", F.col("related_project_id").alias("project_id")).agg(
        F.array_join(F.array_sort(F.collect_set("tier")), ",").alias("tiers")
    )


def download_charges(ledger: DataFrame) -> DataFrame:
    """Charges per project with positive credits, oldest first."""
    charges = ledger.filter("reason = 'download_spend'").withColumn("tier", tier_of_download_key("idempotency_key", "related_project_id"))
    return charges.filter("tier is not null").select(
        F.col("related_project_id").alias("project_id"), "tier", (-F.col("amount")).alias("credits"), "created_at", "id"
    ).orderBy("project_id", "created_at", "id")


def claw_backs(purchases: DataFrame, ledger: DataFrame, segment_seconds: int = 30 * 86_400) -> DataFrame:
    """Credits to take back for refunded purchases: what was granted, at most what is left, once per purchase.

    Several refunds of one wallet drain the same balance in turn: the part of the running request that
    exceeds the balance is cut off, so each refund takes `min(granted, what the earlier ones left)`.
    """
    done = ledger.filter("idempotency_key is not null").select("idempotency_key").distinct()
    wanted = purchases.filter("status = 'refunded' and credits_granted > 0").select(
        "id", F.col("user_id").alias("wallet_id"), "credits_granted", F.col("refunded_at").alias("created_at"),
        F.concat(F.lit("refund_clawback:"), F.col("id").cast("string")).alias("idempotency_key"),
    ).join(done, "idempotency_key", "left_anti")
    asked = running_sums(
        wanted, ["wallet_id"], LEDGER_ORDER, {"asked": F.col("credits_granted")}, time_segment("created_at", segment_seconds)
    ).join(balances(ledger), "wallet_id")
    held = F.greatest(F.col("balance"), F.lit(0))
    taken = F.least(F.col("asked"), held) - F.least(F.col("asked") - F.col("credits_granted"), held)
    return asked.select("id", "wallet_id", "credits_granted", taken.alias("taken_back")).filter("taken_back > 0")
