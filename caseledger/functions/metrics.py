"""Figures that carry their denominator, and how they are written."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from . import wording as T


def ratio(
    numerator: Column,
    denominator: Column,
    closed: Column,
    excluded: Column | None = None,
    reason: str = "excluded",
) -> dict[str, Column]:
    """A ratio with its gate, its note and its small-sample flag."""
    left_out = F.lit(0) if excluded is None else excluded
    met = closed >= C.RATIOS_MIN_CLOSED
    small = met & (closed <= C.SMALL_SAMPLE_MAX)
    note = F.concat_ws(
        " · ",
        F.concat(numerator.cast("string"), F.lit(" of "), denominator.cast("string")),
        F.when(left_out > 0, F.concat(left_out.cast("string"), F.lit(f" {reason}"))),
        F.when(small, F.lit("small sample")),
    )
    locked = F.concat(
        closed.cast("string"),
        F.lit(f" closed · unlocks at {C.RATIOS_MIN_CLOSED} closed applications"),
    )
    return {
        "value": F.when(met & (denominator != 0), numerator / denominator),
        "numerator": numerator.cast("bigint"),
        "denominator": denominator.cast("bigint"),
        "excluded": left_out.cast("bigint"),
        "gate_met": met,
        "note": F.when(met, note).otherwise(locked),
        "small_sample": small,
    }


def dwell_metric(p50: Column, n: Column) -> dict[str, Column]:
    met = n >= C.DWELL_MIN_TRANSITIONS
    return {
        "value": F.when(met, p50),
        "gate_met": met,
        "note": F.when(met, F.concat(n.cast("string"), F.lit(" transitions"))).otherwise(
            F.concat(n.cast("string"), F.lit(f" of {C.DWELL_MIN_TRANSITIONS} stage changes needed"))
        ),
    }


def channel_gate(sent: Column) -> dict[str, Column]:
    met = sent >= C.CHANNEL_MIN_APPLICATIONS
    needed = F.concat(sent.cast("string"), F.lit(f" of {C.CHANNEL_MIN_APPLICATIONS} needed"))
    return {"gate_met": met, "note": F.when(met, "").otherwise(needed)}


def seasonal_gate(quarters: Column) -> dict[str, Column]:
    met = quarters >= C.SEASONAL_MIN_QUARTERS
    missing = F.lit(C.SEASONAL_MIN_QUARTERS) - quarters
    note = F.concat(
        F.lit(T.SEASONAL_START),
        missing.cast("string"),
        F.lit(" more quarter"),
        F.when(missing == 1, "").otherwise("s"),
        F.lit(T.SEASONAL_END),
    )
    return {"gate_met": met, "note": F.when(met, "").otherwise(note)}


def _short(number: Column) -> Column:
    """One decimal, without a trailing .0"""
    return F.regexp_replace(F.format_string("%.1f", number), r"\.0$", "")


def format_percent(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(
        F.concat(_short(F.bround(value * 100, 1)), F.lit("%"))
    )


def format_days(value: Column) -> Column:
    tenths = F.bround(value * 10) / 10
    return F.when(value.isNull(), "—").otherwise(
        F.concat(_short(tenths), F.when(tenths == 1, " day").otherwise(" days"))
    )


def format_money(minor: Column, currency: Column) -> Column:
    """Whole units, grouped, half away from zero, with a symbol or the code."""
    code = F.upper(currency)
    major = minor.cast("double") / 100
    whole = F.signum(major) * F.floor(F.abs(major) + 0.5)
    amount = F.format_number(whole, 0)
    pairs = [F.lit(x) for pair in C.CURRENCY_SYMBOLS.items() for x in pair]
    symbol = F.create_map(*pairs)[code]
    return F.when(symbol.isNotNull(), F.concat(symbol, amount)).otherwise(
        F.concat(code, F.lit(" "), amount)
    )
