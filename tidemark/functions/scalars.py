"""Column functions of binary event markets: prices, fees, sizing, payoffs, gates, signals.

Prices of quotes are in cents, all others in dollars of 0 to 1; missing inputs
give null. NaN must not reach these functions: Spark orders it above every
number, so sources turn it into null (``nan_to_null``).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fee rates, the period's length in seconds, volatility defaults and floors.
TAKER_RATE, MAKER_RATE = 0.07, 0.0175
PERIOD_SECONDS = 900
DEFAULT_VOLATILITY = {"btc": 0.15, "eth": 0.20, "sol": 0.35, "xrp": 0.30}
OTHER_VOLATILITY, LEAST_VOLATILITY = 0.20, 0.03


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


# --- quotes ---------------------------------------------------------------


def mid_price(bid: Column, ask: Column) -> Column:
    """Middle of both sides, else the one that is there."""
    return F.when((bid > 0) & (ask > 0), (bid + ask) / 200.0).when(bid > 0, bid / 100.0).when(ask > 0, ask / 100.0)


def spread(bid: Column, ask: Column) -> Column:
    return F.when((bid > 0) & (ask > 0), (ask - bid) / 100.0)


def seconds_to_close(close_us: Column, us: Column) -> Column:
    """Null where either is: greatest() alone passes nulls over."""
    left = (close_us - us) / 1e6
    return F.when(left.isNotNull(), F.greatest(left, F.lit(0.0)))


def parse_close_time(text: Column) -> Column:
    """ISO-8601 with Z or an offset to a timestamp; null if it can't be read."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")), F.lit(None).cast("timestamp"))


def depth(levels: Column) -> Column:
    """Total quantity of [price, quantity] levels."""
    return F.coalesce(F.aggregate(levels, F.lit(0.0), lambda a, x: a + F.coalesce(F.get(x, F.lit(1)), F.lit(0.0))), F.lit(0.0))


def book_imbalance(yes_depth: Column, no_depth: Column) -> Column:
    return F.round(F.try_divide(yes_depth - no_depth, yes_depth + no_depth), 4)


def best_asks(yes_levels: Column, no_levels: Column) -> tuple[Column, Column]:
    """Asks in cents from the other side's first level; 99 without one."""
    first = lambda levels: F.get(F.get(levels, F.lit(0)), F.lit(0))
    return F.coalesce(100 - first(no_levels), F.lit(99.0)), F.coalesce(100 - first(yes_levels), F.lit(99.0))


def price_vs_strike(price: Column, strike: Column) -> Column:
    return F.when(strike > 0, F.round((price - strike) / strike * 100, 4))


def invert_rate(rate: Column) -> Column:
    return F.round(F.try_divide(F.lit(1.0), rate.cast("double")), 4)


def limit_price_cents(side: Column, yes_ask: Column, no_ask: Column, mid: Column) -> Column:
    quoted = F.when(side == "YES", yes_ask).when(side == "NO", 100 - no_ask)
    return F.least(F.greatest(F.coalesce(quoted, F.floor(mid * 100)), F.lit(1)), F.lit(99)).cast("int")


# --- fees, sizes, payoffs -------------------------------------------------


def fee(contracts: Column, price: Column, rate: float) -> Column:
    """Rounded up to cents; the product's order decides ties, so it is fixed."""
    raw = F.lit(rate) * contracts * price * (1 - price) * 100
    return F.when((contracts > 0) & (price > 0) & (price < 1), F.ceil(raw) / 100.0).otherwise(0.0)


def taker_fee(contracts: Column, price: Column) -> Column:
    return fee(contracts, price, TAKER_RATE)


def maker_fee(contracts: Column, price: Column) -> Column:
    return fee(contracts, price, MAKER_RATE)


def contract_price(side: Column, mid: Column) -> Column:
    return F.when(side == "YES", mid).when(side == "NO", 1 - mid)


def odds(price: Column) -> Column:
    return F.try_divide(1 - price, price)


def kelly_ratio(edge: Column, price: Column) -> Column:
    return F.when(odds(price) > 0, F.abs(edge) / odds(price)).otherwise(0.0)


def kelly_size(edge: Column, price: Column, mid: Column, bankroll: Column, open_cost: Column, config: Mapping[str, float]) -> Column:
    """struct(contracts, cost): the ratio's share of the bankroll, within the trade and exposure limits, if the edge outlasts the fee."""
    usd = F.greatest(F.least(bankroll * config["kelly_fraction"] * kelly_ratio(edge, price), bankroll * config["max_per_trade"], bankroll * config["max_exposure"] - open_cost), F.lit(0.0))
    contracts = F.when(usd >= price, F.floor(F.try_divide(usd, price))).otherwise(0)
    charged = fee(contracts, mid, config["fee_rate"])
    worth = (contracts > 0) & (F.abs(edge) - F.try_divide(charged, contracts) >= config["net_edge_floor"])
    return F.struct(F.when(worth, contracts).otherwise(0).cast("long").alias("contracts"), F.when(worth, contracts * price + charged).otherwise(0.0).alias("cost"))


def tiered_size(edge: Column, price: Column, room: Column) -> Column:
    """Two contracts at 0.35 or less, else one; above 0.65 only with an edge of 0.03; as many as the room allows; net of the fee at least 0.01 each."""
    wanted = F.when(price <= 0.35, 2).when((price > 0.65) & (edge < 0.03), 0).otherwise(1)
    n = F.least(wanted, F.floor(F.try_divide(room, price)))
    return F.when((n > 0) & (edge - F.try_divide(taker_fee(n, price), n) >= 0.01), n).otherwise(0).cast("long")


def binary_payoff(side: Column, won_yes: Column, contracts: Column, price: Column, charged: Column) -> Column:
    """Profit of a settled position; price is that of YES. Null while unsettled."""
    gain = F.when(won_yes, contracts * (1 - price)).otherwise(-contracts * price)
    return F.when(won_yes.isNotNull(), F.round(F.when(side == "YES", gain).otherwise(-gain) - charged, 4) + 0.0)  # + 0.0: no negative zero


def unrealized_pnl(side: Column, mid: Column, entry: Column, contracts: Column) -> Column:
    return F.coalesce(contracts * (mid - entry) * F.when(side == "NO", -1).otherwise(1), F.lit(0.0)) + 0.0


# --- probabilities and signals --------------------------------------------

#: The polynomial of formula 7.1.26 of the Handbook of Mathematical Functions.
ERF_SCALE, ERF_TERMS = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def norm_cdf(z: Column) -> Column:
    """Normal distribution function, within 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_SCALE * x)
    series = reduce(lambda a, c: a * t + c, reversed(ERF_TERMS[:-1]), F.lit(ERF_TERMS[-1])) * t
    erf = 1 - series * F.exp(-x * x)
    return F.when(z.isNotNull(), 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf)))


def zscore(pvs: Column, tte: Column, volatility: Column) -> Column:
    deviation = F.greatest(volatility, F.lit(LEAST_VOLATILITY)) / F.sqrt(F.lit(float(PERIOD_SECONDS))) * F.sqrt(F.greatest(tte, F.lit(1.0)))
    return F.when(deviation > 0.001, pvs / deviation).otherwise(0.0)


def model_probability(z: Column, trend: Column, imbalance: Column) -> Column:
    trended = clamp(norm_cdf(z) + clamp(F.coalesce(trend, F.lit(0.0)) * 0.05, -0.02, 0.02), 0.02, 0.98)
    return clamp(trended + clamp(F.coalesce(imbalance, F.lit(0.0)) * 0.015, -0.01, 0.01), 0.02, 0.98)


def signal_valid(mid: Column, pvs: Column, tte: Column, stale_seconds: Column) -> Column:
    return F.coalesce((pvs.isNotNull()) & (tte >= 60) & mid.between(0.10, 0.90) & (stale_seconds <= 60), F.lit(False))


def conflict(p: Column, mid: Column) -> Column:
    return ((p > 0.5) & (mid < 0.45)) | (~(p > 0.5) & (mid > 0.55))


def tanh_probability(signal: Column) -> Column:
    return 0.5 + 0.5 * F.tanh(signal)


def rule_probability(trend15: Column, trend30: Column, pvs: Column, tte: Column, settle_rate: Column, imbalance: Column) -> Column:
    zero = F.lit(0.0)
    parts = F.coalesce(trend15, zero) * 5 + F.coalesce(trend30, zero) * 3 + pvs * (1 / F.greatest(tte / PERIOD_SECONDS, F.lit(0.1))) * 2
    return tanh_probability(parts + F.coalesce((settle_rate - 0.5) * 0.3, zero) + F.coalesce(imbalance, zero) * 0.01)


def sign_agreement(a: Column, b: Column) -> Column:
    return F.when(F.signum(F.coalesce(a, F.lit(0.0))) == F.signum(b), 1.0).otherwise(0.5)


def side_of(p: Column, market: Column) -> Column:
    return F.when(p > market, "YES").when(p < market, "NO")


def consensus(osc: Column, n_settled: Column, n_valid: Column, agreement: Column, side: Column, consensus_side: Column, p: Column, z: Column, mid: Column, in_conflict: Column) -> Column:
    """struct(side, edge, mode, confidence) from a tick's own signal and its moment's consensus. Its numbers are fixed values."""
    agrees = F.coalesce(side == consensus_side, F.lit(False))
    base = F.when(osc > 0.7, 0.15).when((osc < 0.3) & (n_settled >= 6), 0.35).otherwise(0.25)
    factor = (
        F.when(n_valid < 3, 0.5)
        .when(agreement >= 0.99, F.when(agrees, 1.5).otherwise(0.0))
        .when(agreement >= 0.74, F.when(agrees, 1.0).otherwise(0.15))
        .otherwise(0.3)
    )
    confidence = F.least(F.lit(0.45), base * factor)
    strong = (n_valid >= 3) & (agreement >= 0.74) & agrees
    extreme = ((consensus_side == "YES") & (mid > 0.80)) | ((consensus_side == "NO") & (mid < 0.20))
    strong_edge = F.when(agreement >= 0.99, 0.025 + F.least(F.lit(0.03), 0.015 * F.abs(z))).otherwise(0.015 + F.least(F.lit(0.02), 0.01 * F.abs(z)))
    blended = confidence * p + (1 - confidence) * mid
    blend_side = F.when(blended > mid + 0.003, "YES").when(blended < mid - 0.003, "NO")
    mode = F.when(confidence < 0.01, F.lit(None)).when(in_conflict, "conflict").when(strong & ~extreme, "consensus").when(~strong & blend_side.isNotNull(), "blend")
    chosen = F.when(mode == "consensus", consensus_side).when(mode == "blend", blend_side)
    edge = F.when(mode == "consensus", strong_edge).when(mode == "blend", F.abs(blended - mid)).otherwise(0.0)
    return F.struct(chosen.alias("side"), edge.alias("edge"), mode.alias("mode"), confidence.alias("confidence"))


#: The gates of the three risk configurations (ranges inclusive).
RISK_CONFIGS: dict[str, dict] = {
    "backtest": {"mid": (0.25, 0.75), "tte": (180, 700), "spread": 0.04, "min_edge": 0.04, "kelly_fraction": 0.15, "max_per_trade": 0.05, "max_exposure": 0.15, "max_same_direction": 2, "fee_rate": MAKER_RATE, "net_edge_floor": 0.02, "bankroll": 100.0, "stop_share": 0.85},
    "paper": {"mid": (0.20, 0.80), "tte": (120, 420), "spread": 0.05, "max_price": 0.60, "min_edge": 0.015, "kelly_fraction": 0.50, "max_per_trade": 0.06, "max_exposure": 0.25, "max_same_direction": 4, "fee_rate": MAKER_RATE, "net_edge_floor": 0.01, "bankroll": 100.0, "stop_share": 0.85},
    "live": {"mid": (0.20, 0.80), "tte": (480, 780), "blackout": (600, 660), "spread": 0.05, "min_edge": 0.015, "kelly_fraction": 0.50, "max_per_trade": 0.06, "max_exposure": 0.35, "max_same_direction": 4, "fee_rate": TAKER_RATE, "net_edge_floor": 0.01, "bankroll": 100.0, "trail": 5.0, "take": 5.0},
}


def gate_reason(config: Mapping, mid: Column, tte: Column, width: Column, side: Column | None = None, tte_scale: float = 1.0, held: Column | None = None, exposure: Column | None = None, same_direction: Column | None = None) -> Column:
    """The first reason against an entry, or ok; tte_scale stretches the windows for longer periods.

    held: whether the contract is in position; exposure: open cost as a share of
    the bankroll; same_direction: open positions of that side. Left out, they give
    no reason.
    """
    low, high = (x * tte_scale for x in config["tte"])
    reason = F.when(F.lit(False) if held is None else held, "in_position").when(mid.isNull() | tte.isNull(), "missing_data").when(~mid.between(*config["mid"]), "mid_outside_range").when(~tte.between(low, high), "tte_outside_window")
    if "blackout" in config:
        reason = reason.when(tte.between(*(x * tte_scale for x in config["blackout"])), "tte_blackout")
    reason = reason.when(width > config["spread"], "spread_too_wide")
    if "max_price" in config and side is not None:
        reason = reason.when(contract_price(side, mid) > config["max_price"], "price_too_high")
    if exposure is not None:
        reason = reason.when(exposure >= config["max_exposure"], "exposure_limit")
    if same_direction is not None:
        reason = reason.when(same_direction >= config["max_same_direction"], "max_same_direction")
    return reason.otherwise("ok")


def default_volatility(asset: Column) -> Column:
    """An asset's volatility where none was measured."""
    known = F.create_map(*[F.lit(x) for pair in DEFAULT_VOLATILITY.items() for x in pair])
    return F.coalesce(known[asset], F.lit(OTHER_VOLATILITY))


# --- labels ---------------------------------------------------------------


def ticker_part(ticker: Column, part: str) -> Column:
    """series, time_key (second part) or period_key (all after the first)."""
    parts = F.split(ticker, "-")
    return {"series": F.get(parts, F.lit(0)), "time_key": F.get(parts, F.lit(1)), "period_key": F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, 1000), "-"))}[part]


def result_label(result: Column) -> Column:
    low = F.lower(result)
    return F.when(low == "yes", 1).when(low == "no", 0)


def regime(osc: Column) -> Column:
    return F.when(osc > 0.6, "OSCILLATE").when(osc < 0.35, "TREND").otherwise("MIXED")


def grade(brier: Column) -> Column:
    return F.when(brier < 0.20, "GOOD").when(brier < 0.24, "MODERATE").when(brier < 0.25, "MARGINAL").otherwise("POOR")


def readiness(rows: Column) -> Column:
    return F.when(rows >= 5400, "READY").when(rows >= 2700, "USABLE").otherwise("NEED")


def final_status(rows: Column, gap_pct: Column) -> Column:
    """What a collection run is good for."""
    return F.when((rows >= 2700) & (gap_pct < 5), "OK").when(rows >= 1500, "PARTIAL").otherwise("INSUFFICIENT")


def minutes_seconds(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), F.floor(seconds % 60).cast("long"))


def bands(mid: Column, pvs: Column, imbalance: Column, tte: Column) -> dict[str, Column]:
    return {
        "mid_band": F.when(mid > 0.55, "up").when(mid < 0.45, "down").otherwise("flat"),
        "pvs_band": F.when(pvs > 0, "above").when(pvs < 0, "below").otherwise("at"),
        "book_band": F.when(imbalance > 0.1, "bid").when(imbalance < -0.1, "offer").otherwise("even"),
        "tte_band": F.when(tte < 120, "closing").when(tte < 300, "late").otherwise("early"),
    }


def binned(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of [edge, next edge), the last bin closed; null outside."""
    out = F.when(value == edges[-1], labels[-1])
    for low, high, name in zip(edges[:-1], edges[1:], labels, strict=True):
        out = out.when((value >= low) & (value < high), name)
    return out
