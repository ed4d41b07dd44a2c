"""Scalar column functions of the market domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session(hour: Column) -> Column:
    """Trading session of a UTC hour."""
    return F.when(hour < 7, "asian").when(hour < 12, "london").when(hour < 21, "new_york").otherwise("off_hours")


def killzone(hour: Column) -> Column:
    zones = (("asian_open", 0, 4), ("london_open", 7, 10), ("new_york_open", 12, 15), ("london_close", 15, 16))
    out = F.when(F.lit(False), F.lit(""))
    for name, begin, end in zones:
        out = out.when((hour >= begin) & (hour < end), name)
    return out.otherwise("none")


def position_in_range(price: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (price - low) / (high - low)).otherwise(0.5)


def level(low: Column, high: Column, share: float) -> Column:
    return low + (high - low) * share


def price_zone(price: Column, low: Column, high: Column) -> Column:
    middle = level(low, high, 0.5)
    return F.when(price > middle, "premium").when(price < middle, "discount").otherwise("equilibrium")


def in_entry_zone(price: Column, low: Column, high: Column) -> Column:
    """Between the 0.62 and 0.79 levels of the range, whichever way round it is given."""
    a, b = level(low, high, 0.62), level(low, high, 0.79)
    return price.between(F.least(a, b), F.greatest(a, b))


def confluence(weights: dict[str, float], present: dict[str, Column]) -> Column:
    """Sum of the weights of the factors present, at most 1."""
    total = F.lit(0.0)
    for name, there in present.items():
        total = total + F.when(there, weights[name]).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def floor_to(value: Column, step: Column | float) -> Column:
    return F.floor(value / step + 1e-9) * step


def risk_size(equity: Column, risk: Column, distance: Column, point_value: float, step: float, least: float) -> Column:
    """Size whose stop costs at most the risk budget, floored to a step; 0 if even the least size is over it."""
    size = floor_to(equity * risk / F.nullif(distance * point_value, F.lit(0.0)), step)
    return F.coalesce(F.when(size >= least, size), F.lit(0.0))


def gamma_size(proba: Column, threshold: float, gamma: float, full_at: float, available: Column, per_lot: Column, lot: float) -> Column:
    """Lots on a ramp between the entry threshold and the probability ``full_at``, from which on all available margin is used.

    The largest size is what the margin pays for, floored to lots; null below one lot or where there is no ramp.
    """
    largest = floor_to(F.when((available > 0) & (per_lot > 0), available / per_lot), lot)
    if full_at > threshold:
        ramp = floor_to(F.pow(F.greatest((proba - threshold) / (full_at - threshold), F.lit(0.0)), F.lit(gamma)) * largest, lot)
    else:
        ramp = F.lit(None).cast("double")
    size = F.when(largest >= lot, F.when(proba >= full_at, largest).otherwise(ramp))
    return F.when(size >= lot, size)


def least_risk_size(risk: Column, distance: Column, point_value: float, lot: float) -> Column:
    return F.ceil(risk / (distance * point_value) / lot - 1e-9) * lot


def adverse_fill(bid: Column, ask: Column, buy: Column, slippage: Column | float = 0.0) -> Column:
    return F.when(buy, ask + slippage).otherwise(bid - slippage)


def unit(key: Column, salt: str) -> Column:
    """A number from 0 to 1 that depends on ``key`` and ``salt`` alone: the same on any cluster and after any lost task."""
    return F.conv(F.left(F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt))), F.lit(13)), 16, 10).cast("long") / float(2**52)


def slipped_fill(target: Column, spread: Column, buy: Column, key: Column, most: Column | float, refused: float, seed: int) -> Column:
    """filled, price, spread_cost and slippage of an order at ``target``, a bid: buys pay the spread, slippage up to ``most`` is adverse.

    A share ``refused`` of the orders is not filled; these keep their target as price and cost nothing.
    """
    filled, slip = unit(key, f"reject{seed}") >= refused, unit(key, f"slip{seed}") * most
    paid = F.when(buy, spread).otherwise(0.0)
    price = F.when(filled, target + paid + F.when(buy, slip).otherwise(-slip)).otherwise(target)
    return F.struct(filled.alias("filled"), price.alias("price"), F.when(filled, paid).otherwise(0.0).alias("spread_cost"), F.when(filled, slip).otherwise(0.0).alias("slippage"))


def currency_value(text: Column) -> Column:
    """Number of a text such as ``EUR1,234.50``; null where there is none."""
    return F.replace(F.regexp_extract(text, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("double")


def banded(value: Column, high: float, medium: float) -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def portfolio_vector(position: Column, unrealized: Column, held: Column, capital: Column, margin: Column, initial: float, horizon: int) -> dict[str, Column]:
    """Seven features of a portfolio: position 0 flat, 1 long, 2 short as three flags, then profit, time, capital and margin as shares."""
    flags = {n: (position == k).cast("double") for k, n in enumerate(("is_flat", "is_long", "is_short"))}
    shares = {"pnl_norm": unrealized / initial, "time_norm": held / max(horizon, 1), "cap_norm": capital / initial, "margin_norm": margin / initial}
    return {**flags, **shares}


def improvement(old_sharpe: Column, new_sharpe: Column, old_fall: Column, new_fall: Column, least: float = 2.0, jump: float = 50.0, deeper: float = 5.0) -> tuple[Column, Column, Column]:
    """Change of the Sharpe ratio and of the drawdown in percent, and the verdict on a changed strategy.

    Too small a gain is insufficient, too large a one suspicious, and a drawdown deeper by more than ``deeper`` is refused.
    """
    change = F.round(F.when(old_sharpe != 0, (new_sharpe - old_sharpe) / F.abs(old_sharpe) * 100).otherwise(100.0), 4)
    fall = F.round(new_fall - old_fall, 6)
    verdict = F.when(change < least, "insufficient").when(change > jump, "suspicious").when(fall > deeper, "drawdown").otherwise("accepted")
    return change, fall, verdict
