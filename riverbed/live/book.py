"""The paper book: signals of a snapshot become signed legs, legs a target book within limits, and targets orders against the positions held. Nothing here can place a live order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Fixed values of the book; shares are of net asset value."""

    capital: float = 100_000.0
    funding_threshold: float = 1e-4
    least_basis: float = 0.05
    vol_margin: float = 3.0
    most_gross: float = 3.0
    most_each: float = 0.5
    borrow_share: float = 0.5
    calm_vol: float = 80.0
    cost_bps: float = 5.0
    least_order: float = 1.0


LIMITS = Limits()


def legs(snapshot: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """sleeve, instrument, weight, borrow: two legs for each coin and sleeve that qualifies. snapshot, one row a coin: coin, funding, other_funding, ann, code; null where unknown.

    carry: against funding beyond the threshold, perpetual against spot, of which a short needs borrowing. calendar: spot against a future that is dear enough. venue: the
    perpetual with the higher funding short, the other long.
    """
    leg = lambda place, weight, borrow: F.struct(place.alias("instrument"), weight.alias("weight"), borrow.alias("borrow"))
    at = lambda kind: F.concat(F.lit(f"{kind}:"), F.col("coin"))
    no = F.lit(False)
    way = F.when(F.col("funding") > 0, 1.0).otherwise(-1.0)
    carry = snapshot.where(F.abs("funding") >= limits.funding_threshold).select(
        F.lit("carry").alias("sleeve"), F.inline(F.array(leg(at("PERP"), -way, no), leg(at("SPOT"), way, way < 0)))
    )
    future = F.concat(F.lit("FUT:"), "coin", F.lit("_"), "code")
    calendar = snapshot.where(F.col("ann") > limits.least_basis).select(
        F.lit("calendar").alias("sleeve"), F.inline(F.array(leg(at("SPOT"), F.lit(1.0), no), leg(future, F.lit(-1.0), no)))
    )
    gap = F.col("funding") - F.col("other_funding")
    side = F.when(gap > 0, 1.0).otherwise(-1.0)
    venue = snapshot.where(F.abs(gap) >= limits.funding_threshold).select(
        F.lit("venue").alias("sleeve"), F.inline(F.array(leg(at("PERP"), -side, no), leg(at("OTHER"), side, no)))
    )
    return carry.unionByName(calendar).unionByName(venue)


def targets(found: DataFrame, volatility: DataFrame, limits: Limits = LIMITS, nav: float | None = None) -> DataFrame:
    """instrument, notional of the target book: the gross limit shared equally among sleeves with legs and pairs of legs, borrowed legs halved, all cut by the volatility beyond
    what is calm, each instrument within its limit, then the whole within the gross limit. volatility: one row, implied volatility in per cent or null."""
    nav = limits.capital if nav is None else nav
    sized = found.groupBy("sleeve").agg(F.count("*").alias("_legs"))
    share = sized.agg(F.count("*").alias("_sleeves"))
    cut = F.when(F.col("vol") > limits.calm_vol, limits.calm_vol / F.col("vol")).otherwise(1.0)
    each = found.join(F.broadcast(sized), "sleeve").join(F.broadcast(share), F.lit(True)).join(F.broadcast(volatility.select("vol")), F.lit(True))
    size = limits.most_gross / F.col("_sleeves") / (F.col("_legs") / 2) * nav * F.when(F.col("borrow"), limits.borrow_share).otherwise(1.0)
    book = each.groupBy("instrument").agg(F.sum(F.col("weight") * size * cut).alias("_n"))
    most = limits.most_each * nav
    book = book.withColumn("_n", F.greatest(F.lit(-most), F.least(F.lit(most), "_n")))
    gross = book.agg(F.sum(F.abs("_n")).alias("_gross"))
    scale = F.when(F.col("_gross") > limits.most_gross * nav, limits.most_gross * nav / F.col("_gross")).otherwise(1.0)
    return book.join(F.broadcast(gross), F.lit(True)).select("instrument", (F.col("_n") * scale).alias("notional"))


def marked(state: DataFrame, prices: DataFrame) -> DataFrame:
    """One row, pnl: what positions (instrument, qty, last_px) gained to the prices (instrument, px); instruments without either price gain nothing."""
    moved = state.join(prices, "instrument").where("px > 0 AND last_px > 0")
    return moved.agg(F.coalesce(F.sum(F.col("qty") * (F.col("px") - F.col("last_px"))), F.lit(0.0)).alias("pnl"))


def orders(state: DataFrame, target: DataFrame, prices: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """instrument, side, qty, px, cost, held: the trade in each instrument and the position after it. Trades under the least value are left out, targets without a price stay as they
    are, what is no longer a target is closed without cost."""
    j = state.select("instrument", "qty").join(target, "instrument", "full").join(prices, "instrument", "left")
    old = F.coalesce("qty", F.lit(0.0))
    change = F.col("notional") / F.col("px") - old
    traded = F.col("notional").isNotNull() & (F.col("px") > 0) & (F.abs(change * F.col("px")) >= limits.least_order)
    closed = F.col("notional").isNull() & (old != 0)
    side = F.when(closed, "CLOSE").when(traded & (change > 0), "BUY").when(traded, "SELL")
    qty = F.when(closed, -old).when(traded, change).otherwise(0.0)
    cost = F.when(traded, F.abs(change * F.col("px")) * limits.cost_bps / 1e4).otherwise(0.0)
    return j.select(
        "instrument", side.alias("side"), qty.alias("qty"), "px", cost.alias("cost"), F.when(closed, 0.0).otherwise(old + qty).alias("held")
    )


def checkpointed(done: DataFrame) -> DataFrame:
    """instrument, qty, last_px: the positions to keep, without those of nothing."""
    return done.where(F.abs("held") > 1e-9).select("instrument", F.col("held").alias("qty"), F.col("px").alias("last_px"))


def place_live_order(*_args, **_kwargs) -> None:
    """There is no way from here to a market."""
    raise NotImplementedError("live orders are not wired: this book is paper only")


def cycle(
    snapshot: DataFrame, prices: DataFrame, volatility: DataFrame, state: DataFrame, limits: Limits = LIMITS, live: bool = False
) -> dict[str, DataFrame]:
    """One round: pnl of what is held, the target book, orders, and the state to keep. live raises before anything is read."""
    if live:
        place_live_order()
    target = targets(legs(snapshot, limits), volatility, limits)
    done = orders(state, target, prices, limits)
    return {"pnl": marked(state, prices), "target": target, "orders": done.where("side IS NOT NULL"), "state": checkpointed(done)}
