"""Queries: allocation, orders, the risk gate, fills, benchmark portfolios, the backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import broker, portfolio as P  # noqa: I001
from tidemark.operators import technical as T
from tidemark.plans.base import Registry, r, rounded, with_
from tidemark.plans.evaluation import PRED, predictions
from tidemark.sources import tables

R = Registry()


def _signals(spark, sf):
    p = predictions(spark, sf)
    return p.selectExpr("symbol", "ts", "predicted / 100 AS predicted_excess_return_5d", "probability AS probability_positive_5d", "least(vol / 100, 1.0D) AS predicted_volatility", "abs(probability - 0.5D) * 2 AS confidence").where("predicted_excess_return_5d IS NOT NULL AND predicted_volatility IS NOT NULL")


SIG = {
    "sg": "SELECT symbol, ts, predicted / 100 AS e, probability AS p, least(vol / 100, 1.0) AS v, abs(probability - 0.5) * 2 AS c FROM pred WHERE predicted IS NOT NULL AND vol IS NOT NULL",
    "rw": "SELECT symbol, ts, greatest(-0.10, least(0.10, e * c * CASE WHEN (e >= 0) = (2 * p - 1 >= 0) THEN 1.0 ELSE 0.4 END / (greatest(v, 0.05) * sqrt(5 / 252.0)) * 1.0)) AS raw FROM sg WHERE c >= 0.05",
    "tw": "SELECT symbol, ts, CASE WHEN sum(abs(raw)) OVER (PARTITION BY ts) > 0.5 THEN raw * 0.5 / sum(abs(raw)) OVER (PARTITION BY ts) ELSE raw END AS weight FROM rw",
}


@R.query(with_(f"SELECT symbol, ts, {r('weight')} FROM tw", "bars", "bench", **PRED, **SIG))
def target_weights(spark, sf):
    return rounded(P.target_weights(_signals(spark, sf)))


def _positions(spark, sf):
    """What each symbol's bar of the date before would hold: its volume over a hundred."""
    return tables.bars(spark, sf).selectExpr("symbol", "ts", "lag(volume, 1) OVER (PARTITION BY symbol ORDER BY ts) / 100 AS quantity").where("quantity IS NOT NULL")


def _orders(spark, sf):
    w = P.target_weights(_signals(spark, sf))
    prices = tables.bars(spark, sf).select("symbol", "ts", F.col("close").alias("price"))
    equity = prices.select("ts").distinct().withColumn("equity", F.lit(1_000_000.0))
    return P.rebalance_orders(w, _positions(spark, sf), prices, equity)


ORD = {
    "ps": "SELECT * FROM (SELECT symbol, ts, lag(volume, 1) OVER (PARTITION BY symbol ORDER BY ts) / 100 AS quantity FROM bars) WHERE quantity IS NOT NULL",
    "dl": "SELECT symbol, ts, b.close AS price, coalesce(weight, 0) * 1000000.0 / b.close - coalesce(quantity, 0) AS delta FROM tw FULL JOIN ps USING (symbol, ts) JOIN bars b USING (symbol, ts) WHERE b.close > 0",
    "od": "SELECT symbol, ts, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS quantity, price FROM dl WHERE abs(delta) * price >= 50",
}


@R.query(with_(f"SELECT symbol, ts, side, {r('quantity', digits=5)}, price FROM od", "bars", "bench", **PRED, **SIG, **ORD))
def rebalance_orders(spark, sf):
    return _orders(spark, sf).select("symbol", "ts", "side", F.round("quantity", 5).alias("quantity"), "price")


def _gate(spark, sf):
    """Customers as accounts: their orders of one date as a batch, what they hold from open orders before."""
    o = tables.table(spark, sf, "orders")
    li = tables.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.round(F.avg("l_extendedprice"), 4).alias("p"), F.sum("l_quantity").alias("q"))
    x = o.join(li, o.o_orderkey == li.l_orderkey).selectExpr("o_orderkey AS order_id", "o_custkey AS account", "CAST(s AS STRING) AS symbol", "CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side", "q AS quantity", "o_orderdate AS ts", "p AS price")
    held = x.groupBy("account", "symbol").agg((F.sum(F.expr("CASE WHEN ts >= TIMESTAMP '1998-01-01' THEN 0 WHEN side = 'BUY' THEN quantity ELSE -quantity END")) / 10).alias("quantity"), F.expr("CASE WHEN symbol = '3' THEN NULL ELSE max(price) END").alias("price"))
    return x.where("ts >= TIMESTAMP '1998-01-01'").drop("price"), held


@R.query(with_(
    """SELECT order_id, reason, CASE WHEN reason = 'OK' THEN 'APPROVED' ELSE 'REJECTED' END AS status FROM (
    SELECT order_id, CASE WHEN account % 40 = 0 THEN 'KILL_SWITCH' WHEN ts > TIMESTAMP '2000-01-01' + INTERVAL 3 DAY THEN 'STALE_DATA' WHEN price IS NULL OR price <= 0 THEN 'INVALID_PRICE'
      WHEN row_number() OVER (PARTITION BY account, symbol, side, ts ORDER BY order_id) > 1 THEN 'DUPLICATE_ORDER' WHEN abs(after) / eq > 0.1 THEN 'RISK_POSITION_LIMIT' WHEN (tg - abs(value) + abs(after)) / eq > 1.0 THEN 'RISK_GROSS_EXPOSURE'
      WHEN abs(tn - value + after) / eq > 0.6 THEN 'RISK_NET_EXPOSURE' WHEN (tsec - abs(value) + abs(after)) / eq > 0.35 THEN 'RISK_SECTOR_CONCENTRATION' WHEN (tv - abs(value) * vol + abs(after) * vol) / eq > 0.3 THEN 'RISK_PORTFOLIO_VOLATILITY'
      WHEN account % 7 = 0 THEN 'RISK_DAILY_LOSS_LIMIT' WHEN account % 11 = 0 THEN 'RISK_DRAWDOWN' ELSE 'OK' END AS reason
    FROM (SELECT o.order_id, o.account, o.symbol, o.side, o.ts, p.price, p.value, p.vol, p.tg, p.tn, p.tv, p.tsec, 4000000.0 AS eq, p.value + CASE WHEN side = 'BUY' THEN o.quantity ELSE -o.quantity END * p.price AS after FROM (SELECT * FROM x WHERE ts >= TIMESTAMP '1998-01-01') o LEFT JOIN pos p USING (account, symbol)))""", "sectors",
    x="SELECT o_orderkey AS order_id, o_custkey AS account, CAST(s AS VARCHAR) AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, q AS quantity, o_orderdate AS ts, p AS price FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS s, round(avg(l_extendedprice), 4) AS p, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    hd="SELECT account, symbol, sum(CASE WHEN ts >= TIMESTAMP '1998-01-01' THEN 0 WHEN side = 'BUY' THEN quantity ELSE -quantity END) / 10 AS quantity, CASE WHEN symbol = '3' THEN NULL ELSE max(price) END AS price FROM x GROUP BY 1, 2",
    hs="SELECT hd.*, coalesce(sector, 'UNKNOWN') AS sector, quantity * coalesce(price, 0) AS value, CASE WHEN CAST(symbol AS INT) % 4 = 0 THEN 0.9 ELSE 0.2 END AS vol FROM hd LEFT JOIN sectors USING (symbol)",
    pos="SELECT *, sum(abs(value)) OVER (PARTITION BY account) AS tg, sum(value) OVER (PARTITION BY account) AS tn, sum(abs(value) * vol) OVER (PARTITION BY account) AS tv, sum(abs(value)) OVER (PARTITION BY account, sector) AS tsec FROM hs"))
def risk_gate(spark, sf):
    """Every reason occurs but that of a repeated order: every fourth symbol is volatile, every seventh account has lost a fifth today, every eleventh a third since its peak."""
    orders, held = _gate(spark, sf)
    positions = held.join(tables.sectors(spark, sf), "symbol", "left").withColumn("volatility", F.expr("CASE WHEN CAST(symbol AS INT) % 4 = 0 THEN 0.9D END"))
    account = tables.table(spark, sf, "customer").selectExpr("c_custkey AS account", "4000000.0D AS equity", "CASE WHEN c_custkey % 11 = 0 THEN 6000000.0D ELSE 4000000.0D END AS peak_equity", "CASE WHEN c_custkey % 7 = 0 THEN 5000000.0D ELSE 4000000.0D END AS start_equity", "TIMESTAMP_NTZ '2000-01-01' AS market_ts", "c_custkey % 40 = 0 AS engaged")
    return P.risk_gate(orders, positions, account).select("order_id", "reason", "status")


def _fillable(spark, sf):
    li = tables.table(spark, sf, "lineitem")
    return li.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side", "l_quantity AS quantity", "CASE WHEN l_returnflag = 'R' THEN 'LIMIT' ELSE 'MARKET' END AS order_type", "l_extendedprice / 37 * (1 + l_discount - l_tax) AS limit_price", "l_extendedprice / 37 AS price", "CASE WHEN l_partkey % 20 = 0 THEN 0.0D ELSE l_partkey % 1000 * 1.0D END AS volume", "CASE WHEN l_suppkey % 2 = 0 THEN 20000.0D END AS buying_power")


_FB = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN 'LIMIT' ELSE 'MARKET' END AS order_type, l_extendedprice / 37 * (1 + l_discount - l_tax) AS limit_price, l_extendedprice / 37 AS price, CASE WHEN l_partkey % 20 = 0 THEN 0.0 ELSE l_partkey % 1000 * 1.0 END AS volume, CASE WHEN l_suppkey % 2 = 0 THEN 20000.0 END AS buying_power FROM lineitem"
FIL = {
    "fb": _FB,
    "fw": "SELECT *, CASE WHEN volume > 0 THEN least(quantity, volume * 0.1) END AS want, price * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * (5.0 / 10000 + 0.02 * least(quantity / nullif(volume, 0), 0.1))) AS fp FROM fb",
    "fa": "SELECT *, CASE WHEN side = 'BUY' AND buying_power IS NOT NULL AND fp * want + greatest(1, 0.005 * want) > buying_power THEN greatest(0.0, (buying_power - greatest(1, 0.005 * want)) / fp) END AS afford FROM fw",
    "fr": "SELECT *, CASE WHEN order_type = 'LIMIT' AND CASE WHEN side = 'BUY' THEN price > limit_price ELSE price < limit_price END THEN 'NOT_MARKETABLE_LIMIT_PRICE' WHEN volume <= 0 THEN 'NO_VOLUME_AVAILABLE' WHEN afford <= 0 THEN 'INSUFFICIENT_BUYING_POWER' END AS rejection FROM fa",
    "ff": "SELECT *, CASE WHEN rejection IS NULL THEN least(want, coalesce(afford, want)) END AS fill_quantity FROM fr",
}


@R.query(with_(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rejection, {r('fill_quantity', fill_price='CASE WHEN fill_quantity IS NOT NULL THEN fp END', slippage='CASE WHEN fill_quantity IS NOT NULL THEN fp - price END', commission='CASE WHEN fill_quantity IS NOT NULL THEN greatest(1, 0.005 * fill_quantity) END', digits=6)} FROM ff", **FIL))
def simulate_fills(spark, sf):
    got = P.simulate_fills(_fillable(spark, sf)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rejection", "fill_quantity", "fill_price", "slippage", "commission")
    return rounded(got, 6)


@R.query(with_("SELECT symbol, round(sum(CASE WHEN side = 'BUY' THEN fill_quantity ELSE -fill_quantity END), 4) AS quantity FROM (SELECT CAST(l_partkey AS VARCHAR) AS symbol, side, fill_quantity FROM ff WHERE fill_quantity IS NOT NULL) GROUP BY symbol HAVING abs(sum(CASE WHEN side = 'BUY' THEN fill_quantity ELSE -fill_quantity END)) > 1e-9", **FIL))
def positions_from_fills(spark, sf):
    f = P.simulate_fills(_fillable(spark, sf)).withColumn("order_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "price", "side")).where("fill_quantity IS NOT NULL")
    orders = f.select("order_id", F.col("l_partkey").cast("string").alias("symbol"), "side").distinct()
    return P.positions_from_fills(f.select("order_id", "fill_quantity"), orders).select("symbol", F.round("quantity", 4).alias("quantity"))


_n = "(SELECT count(DISTINCT symbol) FROM bars)"
_ret = "SELECT symbol, ts, close / nullif(lag(close, 1) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS r, close / nullif(lag(close, 20) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS trail FROM bars"


@R.query(with_(f"SELECT b.ts, round(sum(b.close * 1000000.0 / {_n} / f.close), 3) AS equity FROM bars b JOIN bars f ON f.symbol = b.symbol AND f.ts = (SELECT min(ts) FROM bars) GROUP BY b.ts", "bars"))
def buy_and_hold(spark, sf):
    return rounded(P.buy_and_hold(tables.bars(spark, sf)), 3)


@R.query(with_(f"SELECT ts, round(sum(ln(1 + r)) OVER (ORDER BY ts), 6) AS log_growth FROM (SELECT ts, coalesce(sum(r), 0) / {_n} AS r FROM rt GROUP BY ts)", "bars", rt=_ret))
def equal_weight(spark, sf):
    return rounded(P.equal_weight(tables.bars(spark, sf)).select("ts", "log_growth"))


_MOM = {
    "pk": "SELECT ts, list(symbol) AS book FROM (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY round(trail, 12) DESC, symbol) AS k, count(*) OVER (PARTITION BY ts) AS n FROM rt WHERE dayofweek(ts) = 5 AND trail IS NOT NULL) WHERE k <= 3 AND n >= 3 GROUP BY ts",
    "bk": "SELECT ts, book, CASE WHEN lag(book, 1) OVER (ORDER BY ts) IS NULL THEN 1.0 ELSE 2 * (3 - len(list_intersect(book, lag(book, 1) OVER (ORDER BY ts)))) / 3.0 END AS turned FROM pk",
    "dt": "SELECT d.ts, turned, last_value(book IGNORE NULLS) OVER (ORDER BY d.ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS book FROM (SELECT DISTINCT ts FROM bars) d LEFT JOIN bk USING (ts)",
    "hd": "SELECT x.ts, coalesce(sum(r), 0) / 3 AS g FROM (SELECT ts, unnest(book) AS symbol FROM dt) x JOIN rt USING (ts, symbol) GROUP BY x.ts",
}


@R.query(with_("SELECT ts, round(sum(ln(1 + coalesce(g, 0) - coalesce(turned, 0) * 10 / 10000)) OVER (ORDER BY ts), 6) AS log_growth FROM dt LEFT JOIN hd USING (ts)", "bars", rt=_ret, **_MOM))
def momentum_top3(spark, sf):
    return rounded(P.momentum_top(tables.bars(spark, sf)).select("ts", "log_growth"))


def _walked(spark, sf):
    """A scenario a region: the bars of its suppliers on dates that most of them trade, with their target weights."""
    b = tables.bars(spark, sf).select("symbol", "ts", "close", "volume")
    p = T.add(b, {k: T.RETURN_SET[k] for k in ("return_1d", "return_20d")}, {"realised_vol_20d": T.VOL_SET["realised_vol_20d"]})
    s = p.selectExpr("symbol", "ts", "return_20d / 100 AS predicted_excess_return_5d", "1 / (1 + exp(-return_20d * 10)) AS probability_positive_5d", "realised_vol_20d AS predicted_volatility", "0.5D AS confidence").where("predicted_excess_return_5d IS NOT NULL AND predicted_volatility IS NOT NULL")
    sector = tables.sectors(spark, sf).withColumnRenamed("sector", "run_id").join(tables.table(spark, sf, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS symbol", "CAST(s_nationkey AS STRING) AS sector"), "symbol")
    w = P.target_weights(s.join(sector, "symbol").withColumn("at", F.struct("run_id", "ts")), by="at").selectExpr("symbol", "at.ts AS ts", "weight")
    return p.join(sector, "symbol").join(w, ["symbol", "ts"], "left").selectExpr("run_id", "ts", "symbol", "close AS open", "close", "volume * 100 AS volume", "weight", "realised_vol_20d AS volatility", "sector")


@R.query()
def backtest(spark, sf):
    """Snapshots of the account of each region's scenario."""
    return broker.backtest(_walked(spark, sf))
