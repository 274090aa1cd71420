"""From predictions to orders, through the risk gate, to fills: the stateless parts, set-wise; and benchmark portfolios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import E


@dataclass(frozen=True)
class Allocation:
    max_weight: float = 0.10
    gross: float = 0.50
    vol_target: float = 1.0
    min_confidence: float = 0.05
    min_notional: float = 50.0
    vol_floor: float = 0.05


@dataclass(frozen=True)
class Limits:
    position: float = 0.10
    gross: float = 1.0
    net: float = 0.60
    sector: float = 0.35
    volatility: float = 0.30
    daily_loss: float = 0.05
    drawdown: float = 0.20
    stale_days: int = 3
    default_volatility: float = 0.20


@dataclass(frozen=True)
class Fills:
    per_share: float = 0.005
    least: float = 1.0
    spread_bps: float = 5.0
    slippage: float = 0.02
    participation: float = 0.10


def target_weights(predictions: DataFrame, c: Allocation = Allocation(), by: str = "ts") -> DataFrame:  # noqa: B008
    """symbol, by, weight: conviction over horizon volatility, clipped, and scaled down where a date's gross exceeds its target.
    predictions: symbol, by, predicted_excess_return_5d, probability_positive_5d, predicted_volatility, confidence."""
    agree = "CASE WHEN (predicted_excess_return_5d >= 0) = (2 * probability_positive_5d - 1 >= 0) THEN 1.0D ELSE 0.4D END"
    vol = f"(greatest(predicted_volatility, {c.vol_floor}) * sqrt(5 / 252.0D))"
    raw = f"greatest(-{c.max_weight}D, least({c.max_weight}D, predicted_excess_return_5d * confidence * {agree} / {vol} * {c.vol_target}))"
    rows = predictions.where(f"confidence >= {c.min_confidence}").select("symbol", by, E(raw).alias("raw"))
    total = f"sum(abs(raw)) OVER (PARTITION BY {by})"
    return rows.select("symbol", by, E(f"CASE WHEN {total} > {c.gross} THEN raw * {c.gross} / {total} ELSE raw END").alias("weight"))


def rebalance_orders(weights: DataFrame, positions: DataFrame, prices: DataFrame, equity: DataFrame, c: Allocation = Allocation(), by: str = "ts") -> DataFrame:  # noqa: B008
    """symbol, by, side, quantity, price: what moves positions (symbol, by, quantity) to weights (symbol, by, weight) at prices
    (symbol, by, price), given equity (by, equity). Small trades and symbols without a price give no order."""
    both = weights.join(positions, ["symbol", by], "full_outer").join(prices.where("price > 0"), ["symbol", by]).join(equity, by)
    d = both.withColumn("delta", E("coalesce(weight, 0) * equity / price - coalesce(quantity, 0)")).where(f"abs(delta) * price >= {c.min_notional}")
    return d.select("symbol", by, E("CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END").alias("side"), E("abs(delta)").alias("quantity"), "price")


def risk_gate(orders: DataFrame, positions: DataFrame, account: DataFrame, li: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Each order with its first failing check, or OK, against the snapshot before the batch.

    orders: order_id, account, symbol, side, quantity, ts. positions: account, symbol, quantity, price, sector, volatility (a row for
    each symbol that the account may trade, held or not). account: account, equity, peak_equity, start_equity, market_ts, engaged.
    An order's exposures come from the account's totals, with the one position replaced: no order meets another's rows."""
    p = positions.withColumn("value", E("quantity * coalesce(price, 0)")).withColumn("vol", F.coalesce("volatility", F.lit(li.default_volatility))).withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN")))
    totals = p.groupBy("account").agg(F.sum(E("abs(value)")).alias("t_gross"), F.sum("value").alias("t_net"), F.sum(E("abs(value) * vol")).alias("t_vol"))
    sectors = p.groupBy("account", "sector").agg(F.sum(E("abs(value)")).alias("t_sector"))
    p = p.join(totals, "account").join(sectors, ["account", "sector"]).select("account", "symbol", "price", "value", "vol", E("t_gross - abs(value)").alias("o_gross"), E("t_net - value").alias("o_net"), E("t_vol - abs(value) * vol").alias("o_vol"), E("t_sector - abs(value)").alias("o_sector"))
    d = orders.join(p, ["account", "symbol"], "left").join(account, "account").withColumn("eq", E("CASE WHEN equity > 0 THEN equity ELSE 1e-9 END"))
    d = d.withColumn("after", E("value + CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END * price"))
    d = d.withColumn("repeat", E("row_number() OVER (PARTITION BY account, symbol, side, ts ORDER BY order_id)"))
    tests = [
        ("engaged", "KILL_SWITCH"), (f"market_ts IS NOT NULL AND ts > market_ts + INTERVAL {li.stale_days} DAYS", "STALE_DATA"), ("price IS NULL OR isnan(price) OR price <= 0", "INVALID_PRICE"), ("repeat > 1", "DUPLICATE_ORDER"),
        (f"abs(after) / eq > {li.position}", "RISK_POSITION_LIMIT"), (f"(o_gross + abs(after)) / eq > {li.gross}", "RISK_GROSS_EXPOSURE"), (f"abs(o_net + after) / eq > {li.net}", "RISK_NET_EXPOSURE"),
        (f"(o_sector + abs(after)) / eq > {li.sector}", "RISK_SECTOR_CONCENTRATION"), (f"(o_vol + abs(after) * vol) / eq > {li.volatility}", "RISK_PORTFOLIO_VOLATILITY"),
        (f"start_equity > 0 AND (equity - start_equity) / start_equity <= -{li.daily_loss}", "RISK_DAILY_LOSS_LIMIT"), (f"peak_equity > 0 AND (peak_equity - equity) / peak_equity >= {li.drawdown}", "RISK_DRAWDOWN"),
    ]
    reason = "CASE " + " ".join(f"WHEN {t} THEN '{r}'" for t, r in tests) + " ELSE 'OK' END"
    return d.select(*orders.columns, E(reason).alias("reason")).withColumn("status", E("CASE WHEN reason = 'OK' THEN 'APPROVED' ELSE 'REJECTED' END"))


def simulate_fills(orders: DataFrame, c: Fills = Fills()) -> DataFrame:  # noqa: B008
    """Each order (side, quantity, order_type, limit_price, price, volume, buying_power) with fill_quantity, fill_price, slippage,
    commission, or the reason that there is none. price: of execution."""
    sign = "CASE WHEN side = 'BUY' THEN 1 ELSE -1 END"
    d = orders.withColumn("want", E(f"CASE WHEN volume > 0 THEN least(quantity, volume * {c.participation}) END"))
    d = d.withColumn("fill_price", E(f"price * (1 + ({sign}) * ({c.spread_bps} / 10000.0D + {c.slippage}D * least(quantity / nullif(volume, 0), {c.participation}D)))"))
    fee = lambda q: f"greatest({c.least}D, {c.per_share}D * {q})"
    d = d.withColumn("afford", E(f"CASE WHEN side = 'BUY' AND buying_power IS NOT NULL AND fill_price * want + {fee('want')} > buying_power THEN greatest(0.0D, (buying_power - {fee('want')}) / fill_price) END"))
    reason = "CASE WHEN order_type = 'LIMIT' AND limit_price IS NOT NULL AND (CASE WHEN side = 'BUY' THEN price > limit_price ELSE price < limit_price END) THEN 'NOT_MARKETABLE_LIMIT_PRICE' WHEN volume IS NULL OR volume <= 0 THEN 'NO_VOLUME_AVAILABLE' WHEN afford <= 0 THEN 'INSUFFICIENT_BUYING_POWER' END"
    d = d.withColumn("rejection", E(reason)).withColumn("fill_quantity", E("CASE WHEN rejection IS NULL THEN least(want, coalesce(afford, want)) END"))
    filled = "fill_quantity IS NOT NULL"
    return d.select(*orders.columns, "rejection", "fill_quantity", E(f"CASE WHEN {filled} THEN fill_price END").alias("fill_price"), E(f"CASE WHEN {filled} THEN fill_price - price END").alias("slippage"), E(f"CASE WHEN {filled} THEN {fee('fill_quantity')} END").alias("commission"))


def positions_from_fills(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """symbol, quantity: signed sums of fills by their orders' side, without flat ones."""
    got = fills.join(orders.select("order_id", "symbol", "side"), "order_id").groupBy("symbol").agg(F.sum(E("CASE WHEN side = 'BUY' THEN fill_quantity ELSE -fill_quantity END")).alias("quantity"))
    return got.where("abs(quantity) > 1e-9")


def _symbols(bars: DataFrame) -> int:
    return bars.select("symbol").distinct().count()


def buy_and_hold(bars: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """ts, equity: equal money in each symbol that has a price on the first date (what the others would get is lost, as published), never traded."""
    first = bars.agg(F.min("ts").alias("first"))
    shares = bars.join(F.broadcast(first), bars.ts == F.col("first")).select("symbol", (F.lit(cash) / _symbols(bars) / F.col("close")).alias("shares"))
    return bars.join(shares, "symbol").groupBy("ts").agg(F.sum(E("shares * close")).alias("equity"))


def returns_by_date(bars: DataFrame) -> DataFrame:
    """symbol, ts, r: a symbol's return since its previous date."""
    return bars.selectExpr("symbol", "ts", "close / nullif(lag(close, 1) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r")


def compounded(daily: DataFrame, cash: float) -> DataFrame:
    """ts, equity, log_growth from (ts, r): one row a date, in order. Equity is the product of 1 + r: a return of -100 % makes it 0 for good,
    one below that changes its sign. log_growth is the logarithm of its size over the money at the start, which doesn't overflow; a factor of 0
    is left out of it."""
    w = "OVER (ORDER BY ts)"
    signed = f"CASE WHEN max(CASE WHEN 1 + r = 0 THEN 1 ELSE 0 END) {w} = 1 THEN 0.0D WHEN sum(CASE WHEN 1 + r < 0 THEN 1 ELSE 0 END) {w} % 2 = 1 THEN -1.0D ELSE 1.0D END"
    got = daily.selectExpr("ts", f"coalesce(sum(ln(nullif(abs(1 + r), 0))) {w}, 0.0D) AS log_growth", f"{signed} AS s")
    return got.selectExpr("ts", f"CASE WHEN s = 0 THEN 0.0D ELSE {cash}D * s * exp(log_growth) END AS equity", "log_growth")


def equal_weight(bars: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """ts, equity: equal weights in all symbols every date; a symbol without a return adds none."""
    n = _symbols(bars)
    return compounded(returns_by_date(bars).groupBy("ts").agg((F.coalesce(F.sum("r"), F.lit(0.0)) / n).alias("r")), cash)


def momentum_top(bars: DataFrame, top: int = 3, lookback: int = 20, cash: float = 1_000_000.0, cost_bps: float = 10.0) -> DataFrame:
    """ts, equity: from each Friday that trades on, equal weights in the symbols of the greatest trailing returns; the return of the
    Friday itself is still the old book's, and the change of book costs `cost_bps` of what turns over."""
    r = bars.selectExpr("symbol", "ts", f"close / nullif(lag(close, {lookback}) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS trail", "close / nullif(lag(close, 1) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r")
    picks = r.where("dayofweek(ts) = 6 AND trail IS NOT NULL").selectExpr("ts", "symbol", "row_number() OVER (PARTITION BY ts ORDER BY trail DESC, symbol) AS k", "count(*) OVER (PARTITION BY ts) AS n").where(f"k <= {top} AND n >= {top}")
    books = picks.groupBy("ts").agg(F.collect_set("symbol").alias("book")).withColumn("old", E("lag(book, 1) OVER (ORDER BY ts)"))
    books = books.selectExpr("ts", "book", f"CASE WHEN old IS NULL THEN 1.0D ELSE (size(array_except(book, old)) + size(array_except(old, book))) / {top}.0D END AS turned")
    dates = bars.select("ts").distinct().join(books, "ts", "left")
    dates = dates.selectExpr("ts", "last(book, true) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS book", "coalesce(turned, 0) AS turned")
    held = dates.select("ts", F.explode("book").alias("symbol")).join(r, ["ts", "symbol"]).groupBy("ts").agg((F.coalesce(F.sum("r"), F.lit(0.0)) / top).alias("g"))
    return compounded(dates.join(held, "ts", "left").select("ts", E(f"coalesce(g, 0) - turned * {cost_bps} / 10000").alias("r")), cash)
