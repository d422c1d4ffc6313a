"""Money and rounding column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_cents(amount: Column | str) -> Column:
    """Integer cents of a decimal string; null when it is no number or has a fraction of a cent."""
    cents = _col(amount).try_cast("decimal(34,14)") * 100
    return F.when(cents == F.floor(cents), cents.cast("long"))


def format_amount(cents: Column | str) -> Column:
    cents = _col(cents).cast("long")
    return F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), F.pmod(cents, F.lit(100)))


def usage_cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Dollars for a model call at prices per million tokens; unpriced models cost nothing."""
    zero = F.lit(0.0)
    return (
        prompt * F.coalesce(prompt_price.cast("double"), zero) + completion * F.coalesce(completion_price.cast("double"), zero)
    ) / F.lit(1_000_000.0)


def required_credits(cost: Column, usd_per_credit: Column) -> Column:
    """Whole credits covering a cost; a rate of zero or less acts as one dollar per credit."""
    rate = F.when(usd_per_credit > 0, usd_per_credit).otherwise(F.lit(1.0))
    return F.ceil(cost / rate).cast("long")


def shortfall(required: Column, balance: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), required - balance)
