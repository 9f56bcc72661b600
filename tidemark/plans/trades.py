"""Queries over the trade ledger: fees, payoffs, equity, streaks, breakdowns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ordered import running
from ..operators.summaries import before_buckets, bucket_summaries, summarised
from ..sources.staging import staged
from .bindings import fee_sql, ledger, ledger_sql
from .registry import ORACLES, query

START = 100_000.0
#: A total order of trades: an order may repeat a line number, for other parts.
ORDER = ["us", "id", "line", "part", "supp", "contracts", "price"]
_L = ledger_sql()


def month(c: str = "us") -> Column:
    """A bucket of about a month."""
    return F.call_function("div", F.col(c), F.lit(30 * 86_400_000_000))


@query(_L + f"SELECT id, line, fee AS taker_fee, {fee_sql('contracts', 'price', 0.0175)} AS maker_fee, contracts * price AS entry_cost FROM ledger")
def trade_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, P12, P19."""
    c, p = F.col("contracts"), F.col("price")
    return ledger(spark, sf_dir).select("id", "line", F.col("fee").alias("taker_fee"), S.maker_fee(c, p).alias("maker_fee"), (c * p).alias("entry_cost"))


@query(_L + "SELECT id, line, side, pnl, CASE WHEN pnl IS NULL THEN NULL WHEN pnl > 0 THEN 'WIN' ELSE 'LOSS' END AS outcome, round(contracts * (0.5 - price) * CASE WHEN side = 'NO' THEN -1 ELSE 1 END, 6) + 0.0 AS marked FROM ledger")
def trade_payoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payoff of settled trades; open value at a mid of one half."""
    marked = S.unrealized_pnl(F.col("side"), F.lit(0.5), F.col("price"), F.col("contracts"))
    return ledger(spark, sf_dir).select("id", "line", "side", "pnl", F.when(F.col("pnl") > 0, "WIN").when(F.col("pnl").isNotNull(), "LOSS").alias("outcome"), (F.round(marked, 6) + 0.0).alias("marked"))


EDGE, ROOM = 0.08, 1.5
_CP = "(CASE WHEN side = 'YES' THEN price ELSE 1 - price END)"
_ODDS = f"((1 - {_CP}) / nullif({_CP}, 0))"


@query(_L + f"""SELECT id, line, {_CP} AS contract_price, {_ODDS} AS odds, CASE WHEN {_ODDS} > 0 THEN {EDGE}::DOUBLE / {_ODDS} ELSE 0.0 END AS kelly,
CASE WHEN tier_n > 0 AND {EDGE}::DOUBLE - {fee_sql('tier_n', 'price', 0.07)} / nullif(tier_n, 0) >= 0.01 THEN CAST(tier_n AS BIGINT) ELSE 0 END AS tier
FROM (SELECT *, least(CASE WHEN price <= 0.35 THEN 2 WHEN price > 0.65 AND {EDGE} < 0.03 THEN 0 ELSE 1 END, floor({ROOM}::DOUBLE / nullif(price, 0))) AS tier_n FROM ledger)""")
def trade_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's price, its odds and the edge over them, and the tiered size within the exposure that is left."""
    price = S.contract_price(F.col("side"), F.col("price"))
    tier = S.tiered_size(F.lit(EDGE), F.col("price"), F.lit(ROOM))
    return ledger(spark, sf_dir).select("id", "line", price.alias("contract_price"), S.odds(price).alias("odds"), S.kelly_ratio(F.lit(EDGE), price).alias("kelly"), tier.alias("tier"))


@query(_L + f""", sized AS (SELECT *, {_CP} AS cp, greatest(least(least(100.0::DOUBLE * 0.15 * (CASE WHEN {_ODDS} > 0 THEN {EDGE}::DOUBLE / {_ODDS} ELSE 0.0 END), 100.0::DOUBLE * 0.05), 100.0::DOUBLE * 0.15 - 2.0), 0.0) AS usd FROM ledger),
n AS (SELECT *, CASE WHEN usd >= cp THEN coalesce(floor(usd / nullif(cp, 0)), 0) ELSE 0 END AS n FROM sized), f AS (SELECT *, {fee_sql('n', 'price', 0.0175)} AS f FROM n)
SELECT id, line, CASE WHEN n > 0 AND {EDGE}::DOUBLE - f / nullif(n, 0) >= 0.02 THEN CAST(n AS BIGINT) ELSE 0 END AS size, CASE WHEN n > 0 AND {EDGE}::DOUBLE - f / nullif(n, 0) >= 0.02 THEN round(n * cp + f, 6) ELSE 0 END AS cost FROM f""")
def kelly_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size by the edge's ratio within the limits, net of fees."""
    t = ledger(spark, sf_dir)
    price = S.contract_price(F.col("side"), F.col("price"))
    size = S.kelly_size(F.lit(EDGE), price, F.col("price"), F.lit(100.0), F.lit(2.0), S.RISK_CONFIGS["backtest"])
    return t.select("id", "line", size.alias("s")).select("id", "line", F.col("s.contracts").alias("size"), F.round("s.cost", 6).alias("cost"))


def trade_stats(win: Column | None = None) -> list[Column]:
    """What a group of trades made; pending trades have a null pnl."""
    pnl, fees = F.col("pnl"), F.when(F.col("pnl").isNotNull(), F.col("fee"))
    cost = F.when(pnl.isNotNull(), F.col("contracts") * F.col("price"))
    wins, losses = F.sum(F.when(pnl > 0, pnl)), -F.sum(F.when(pnl <= 0, pnl))
    return [
        F.count("*").alias("n"), F.count_if(pnl > 0).alias("wins"), F.count_if(pnl <= 0).alias("losses"), F.count_if(pnl.isNull()).alias("pending"),
        F.round(F.try_divide(F.count_if(pnl > 0), F.count(pnl)), 6).alias("win_rate"), F.round(F.sum(pnl), 4).alias("pnl"), F.round(F.sum(fees), 4).alias("fees"),
        F.round(F.sum(pnl + F.col("fee")), 4).alias("pnl_before_fees"), F.round(F.avg(F.when(pnl > 0, pnl)), 6).alias("avg_win"), F.round(F.avg(F.when(pnl <= 0, pnl)), 6).alias("avg_loss"),
        F.round(F.sum("contracts"), 4).alias("contracts"), F.round(F.avg(pnl), 6).alias("mean_pnl"), F.round(F.coalesce(wins, F.lit(0.0)), 4).alias("gross_win"), F.round(F.coalesce(losses, F.lit(0.0)), 4).alias("gross_loss"),
        F.round(F.when(losses > 0, wins / losses).otherwise(99.0), 6).alias("profit_factor"), F.round(F.try_divide(F.sum(pnl), F.sum(cost)), 6).alias("roi"),
    ]


_STATS = """count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl <= 0) AS losses, count(*) FILTER (WHERE pnl IS NULL) AS pending, round(count(*) FILTER (WHERE pnl > 0) / nullif(count(pnl), 0), 6) AS win_rate,
round(sum(pnl), 4) AS pnl, round(sum(fee) FILTER (WHERE pnl IS NOT NULL), 4) AS fees, round(sum(pnl + fee), 4) AS pnl_before_fees, round(avg(pnl) FILTER (WHERE pnl > 0), 6) AS avg_win, round(avg(pnl) FILTER (WHERE pnl <= 0), 6) AS avg_loss,
round(sum(contracts), 4) AS contracts, round(avg(pnl), 6) AS mean_pnl, round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0), 4) AS gross_win, round(coalesce(-sum(pnl) FILTER (WHERE pnl <= 0), 0), 4) AS gross_loss,
round(CASE WHEN -sum(pnl) FILTER (WHERE pnl <= 0) > 0 THEN sum(pnl) FILTER (WHERE pnl > 0) / -sum(pnl) FILTER (WHERE pnl <= 0) ELSE 99.0 END, 6) AS profit_factor, round(sum(pnl) / nullif(sum(contracts * price) FILTER (WHERE pnl IS NOT NULL), 0), 6) AS roi"""


@query(_L + f"SELECT {_STATS} FROM ledger")
def trade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return ledger(spark, sf_dir).agg(*trade_stats())


@query(_L + f"SELECT coalesce(asset, 'all') AS asset, coalesce(side, 'all') AS side, {_STATS} FROM ledger GROUP BY GROUPING SETS ((asset), (side), (asset, side), ())")
def trade_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By asset, by side, by both and in all, in one pass."""
    out = ledger(spark, sf_dir).groupingSets([[F.col("asset")], [F.col("side")], [F.col("asset"), F.col("side")], []], F.col("asset"), F.col("side")).agg(*trade_stats())
    return out.withColumns({"asset": F.coalesce("asset", F.lit("all")), "side": F.coalesce("side", F.lit("all"))})


@query(_L + "SELECT period, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl <= 0) AS losses, count(*) FILTER (WHERE pnl IS NULL) AS pending, round(sum(pnl), 4) AS pnl, CASE WHEN min(side) = max(side) THEN min(side) ELSE 'MX' END AS direction FROM ledger GROUP BY period ORDER BY min(us) DESC LIMIT 10")
def recent_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest periods by time."""
    pnl = F.col("pnl")
    by = ledger(spark, sf_dir).groupBy("period").agg(F.count("*").alias("n"), F.count_if(pnl > 0).alias("wins"), F.count_if(pnl <= 0).alias("losses"), F.count_if(pnl.isNull()).alias("pending"), F.round(F.sum(pnl), 4).alias("pnl"), F.when(F.min("side") == F.max("side"), F.min("side")).otherwise("MX").alias("direction"), F.min("us").alias("first_us"))
    return by.orderBy(F.desc("first_us")).limit(10).drop("first_us")


@query(_L + "SELECT asset, round(avg(pnl), 6) AS mean, round(stddev_samp(pnl), 6) AS std, round(coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0), 0), 6) AS sharpe FROM (SELECT asset, period, sum(pnl) AS pnl FROM ledger WHERE pnl IS NOT NULL GROUP BY asset, period) GROUP BY asset")
def sharpe_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over deviation of a period's profit."""
    return sharpes(ledger(spark, sf_dir))


def sharpes(rows: DataFrame) -> DataFrame:
    by = rows.filter("pnl is not null").groupBy("asset", "period").agg(F.sum("pnl").alias("p"))
    return by.groupBy("asset").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_samp("p"), 6).alias("std"), F.round(F.coalesce(F.try_divide(F.avg("p"), F.stddev_samp("p")), F.lit(0.0)), 6).alias("sharpe"))


_EQ = _L + f", equity AS (SELECT *, {START} + sum(pnl) OVER (PARTITION BY asset ORDER BY us, id, line, part, supp, contracts, price ROWS UNBOUNDED PRECEDING) AS bank FROM ledger WHERE pnl IS NOT NULL), peaks AS (SELECT *, greatest({START}, max(bank) OVER (PARTITION BY asset ORDER BY us, id, line, part, supp, contracts, price ROWS UNBOUNDED PRECEDING)) AS peak FROM equity)\n"


def settled_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled trades, written once: what follows reads them more than once."""
    return staged(ledger(spark, sf_dir).filter("pnl is not null").select("asset", *ORDER, "side", "pnl"), "settled-trades")


def with_bank(rows: DataFrame) -> DataFrame:
    """Settled trades with the bankroll after each and its peak so far."""
    rows = running(rows, ["asset"], ORDER, F.col("pnl"), "made", "top", month())
    return rows.withColumn("bank", START + F.col("made")).withColumn("peak", START + F.col("top"))


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return with_bank(settled_trades(spark, sf_dir))


#: Sums that are taken in another order may differ by this.
SLACK = 1e-6


def until_breach(rows: DataFrame, summaries: DataFrame, meets: Callable[[float], Column], breach: Column) -> DataFrame:
    """Settled trades up to each asset's first breach, that one included.

    meets(slack), over a bucket's summary s and the sums before it, tells whether
    a breach lies in the bucket, with some slack. Only trades of buckets that may
    hold the first one are ordered and tested by breach (over bank and peak).
    """
    state = before_buckets(summaries, ["asset"]).select("asset", "_b", "before", meets(SLACK).alias("_may"), meets(-SLACK).alias("_sure"))
    surely = state.groupBy("asset").agg(F.min(F.when(F.col("_sure"), F.col("_b"))).alias("_until"))
    tested = state.filter("_may").join(surely, "asset").filter("_until is null or _b <= _until").select("asset", "_b", "before")
    upto = Window.partitionBy("asset", "_b").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_b", month()).join(tested, ["asset", "_b"]).withColumn("made", F.col("before.total") + F.sum("pnl").over(upto))
    inside = inside.withColumn("peak", START + F.greatest(F.col("before.top"), F.max("made").over(upto))).withColumn("bank", START + F.col("made"))
    first = inside.filter(breach).groupBy("asset").agg(F.min(F.struct(*ORDER)).alias("_at"))
    return rows.join(first, "asset", "left").filter(F.col("_at").isNull() | (F.struct(*ORDER) <= F.col("_at"))).select(*rows.columns)


@query(_EQ + "SELECT id, line, asset, round(bank, 4) AS bank, round(peak, 4) AS peak FROM peaks")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return equity(spark, sf_dir).select("id", "line", "asset", F.round("bank", 4).alias("bank"), F.round("peak", 4).alias("peak"))


@query(_EQ + "SELECT asset, CAST(row_number() OVER (PARTITION BY asset ORDER BY us, id, line, part, supp, contracts, price) AS BIGINT) AS number, id, line, side, pnl, round(bank, 4) AS bank FROM peaks")
def trade_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset's settled trades, numbered in order, with the bankroll after each."""
    rows = running(equity(spark, sf_dir).select("asset", *ORDER, "side", "pnl", "bank"), ["asset"], ORDER, F.lit(1), "number", bucket=month())
    return rows.select("asset", F.col("number").cast("long").alias("number"), "id", "line", "side", "pnl", F.round("bank", 4).alias("bank"))


@query(_EQ + "SELECT asset, round(max((peak - bank) / peak), 6) AS max_drawdown, round(min(bank), 4) AS low, round(max(peak), 4) AS high FROM peaks GROUP BY asset")
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11, per trade."""
    return drawdowns(settled_trades(spark, sf_dir))


def drawdowns(rows: DataFrame) -> DataFrame:
    """Of settled trades, written before: they are read twice."""
    return with_bank(rows).groupBy("asset").agg(F.round(F.max((F.col("peak") - F.col("bank")) / F.col("peak")), 6).alias("max_drawdown"), F.round(F.min("bank"), 4).alias("low"), F.round(F.max("peak"), 4).alias("high"))


@query(_L + f", p AS (SELECT asset, period, min(us) AS us, sum(pnl) AS pnl FROM ledger WHERE pnl IS NOT NULL GROUP BY asset, period), e AS (SELECT *, {START} + sum(pnl) OVER (PARTITION BY asset ORDER BY us) AS bank FROM p), q AS (SELECT *, greatest({START}, max(bank) OVER (PARTITION BY asset ORDER BY us)) AS peak FROM e) SELECT asset, round(max((peak - bank) / peak), 6) AS max_drawdown FROM q GROUP BY asset")
def period_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 by period, periods in order of time."""
    by = ledger(spark, sf_dir).filter("pnl is not null").groupBy("asset", "period").agg(F.min("us").alias("us"), F.sum("pnl").alias("pnl"))
    rows = running(by, ["asset"], ["us"], F.col("pnl"), "made", "top", month())
    return rows.groupBy("asset").agg(F.round(F.max((F.col("top") - F.col("made")) / (START + F.col("top"))), 6).alias("max_drawdown"))


def ledger_summaries(rows: DataFrame) -> DataFrame:
    """A summary of each asset and month: runs of wins and losses, and the running profit."""
    return bucket_summaries(rows, ["asset"], ORDER, month(), F.col("pnl") > 0, F.col("pnl"))


@query(_L + """, w AS (SELECT *, pnl > 0 AS win, row_number() OVER (PARTITION BY asset ORDER BY us, id, line, part, supp, contracts, price) - row_number() OVER (PARTITION BY asset, pnl > 0 ORDER BY us, id, line, part, supp, contracts, price) AS island FROM ledger WHERE pnl IS NOT NULL), r AS (SELECT asset, win, island, count(*) AS run FROM w GROUP BY ALL)
SELECT asset, coalesce(max(run) FILTER (WHERE win), 0) AS win_streak, coalesce(max(run) FILTER (WHERE NOT win), 0) AS loss_streak FROM r GROUP BY asset""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest runs of wins and of losses, pending trades passed over."""
    return longest_runs(ledger(spark, sf_dir))


def longest_runs(rows: DataFrame) -> DataFrame:
    runs = summarised(ledger_summaries(rows), ["asset"])
    return runs.select("asset", F.col("s.longest_true").alias("win_streak"), F.col("s.longest_false").alias("loss_streak"))


@query(_L + """, e AS (SELECT *, sum(pnl) OVER w AS made, row_number() OVER w AS r, row_number() OVER (PARTITION BY asset, pnl > 0 ORDER BY us, id, line, part, supp, contracts, price) AS k FROM ledger WHERE pnl IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY us, id, line, part, supp, contracts, price ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, greatest(0, max(made) OVER (PARTITION BY asset ORDER BY r)) AS top FROM e), runs AS (SELECT asset, pnl > 0 AS win, count(*) AS run, max(r) AS last FROM e GROUP BY asset, pnl > 0, r - k)
SELECT q.asset, count(*) AS n, round(arg_max(made, r), 4) AS pnl, round(max(top), 4) AS high, round(least(0, min(made)), 4) AS low, round(max(top - made), 4) AS worst_drop, any_value(c.win) AS current_win, any_value(c.run) AS current_run FROM q JOIN (SELECT asset, arg_max(win, last) AS win, arg_max(run, last) AS run FROM runs GROUP BY asset) c USING (asset) GROUP BY q.asset""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, high, low and worst drop of the running profit in money, and the run that goes on, all from one pass."""
    s = summarised(ledger_summaries(ledger(spark, sf_dir)), ["asset"])
    rounded = {"pnl": "total", "high": "top", "low": "low", "worst_drop": "drop"}
    return s.select("asset", F.col("s.n").alias("n"), *[F.round(f"s.{c}", 4).alias(n) for n, c in rounded.items()], F.col("s.last_flag").alias("current_win"), F.col("s.last_run").alias("current_run"))


STOP_SHARE = 0.999


@query(_EQ + f", breach AS (SELECT asset, min((us, id, line, part, supp, contracts, price)) AS at FROM peaks WHERE bank < {START} * {STOP_SHARE} GROUP BY asset) SELECT p.id, p.line, p.asset FROM peaks p LEFT JOIN breach b USING (asset) WHERE b.at IS NULL OR (p.us, p.id, p.line, p.part, p.supp, p.contracts, p.price) <= b.at")
def stop_loss_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades up to the first that takes the bankroll below a share of the start."""
    rows, floor = settled_trades(spark, sf_dir), START * STOP_SHARE
    return until_breach(rows, ledger_summaries(rows), lambda slack: START + F.col("before.total") + F.col("s.low") < floor + slack, F.col("bank") < floor).select("id", "line", "asset")


TRAIL, TAKE = 50.0, 500.0


@query(_EQ + f", floors AS (SELECT *, greatest({START} - {TRAIL}, peak - {TRAIL}) AS floor FROM peaks), breach AS (SELECT asset, min((us, id, line, part, supp, contracts, price)) AS at FROM floors WHERE bank <= floor OR bank - {START} >= {TAKE} GROUP BY asset) SELECT p.id, p.line, p.asset FROM peaks p LEFT JOIN breach b USING (asset) WHERE b.at IS NULL OR (p.us, p.id, p.line, p.part, p.supp, p.contracts, p.price) <= b.at")
def trailing_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades up to the first that meets the trailing floor or the profit to take."""
    rows, before = settled_trades(spark, sf_dir), F.col("before")
    drop = F.greatest(F.col("s.drop"), before["top"] - (before["total"] + F.col("s.low")))
    meets = lambda slack: (drop >= TRAIL - slack) | (before["total"] + F.col("s.top") >= TAKE - slack)
    hit = (F.col("bank") <= F.col("peak") - TRAIL) | (F.col("bank") - START >= TAKE)
    return until_breach(rows, ledger_summaries(rows), meets, hit).select("id", "line", "asset")


@query(_L + "SELECT id, line, asset, side, pnl FROM ledger ORDER BY us DESC, id DESC, line DESC, part DESC, supp DESC, contracts DESC, price DESC LIMIT 25")
def recent_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: the last 25."""
    return ledger(spark, sf_dir).orderBy(*[F.desc(c) for c in ORDER]).limit(25).select("id", "line", "asset", "side", "pnl")


@query(_L + "SELECT period, side, count(*) AS n, round(sum(contracts * price), 4) AS cost FROM ledger WHERE pnl IS NULL GROUP BY period, side")
def exposure_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open cost and count by direction."""
    return ledger(spark, sf_dir).filter("pnl is null").groupBy("period", "side").agg(F.count("*").alias("n"), F.round(F.sum(F.col("contracts") * F.col("price")), 4).alias("cost"))


@query(_L + "SELECT id, line FROM ledger l WHERE pnl IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ledger o WHERE o.id = l.id AND o.line < l.line)")
def already_held_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries on orders that no earlier line holds."""
    rows = ledger(spark, sf_dir)
    held = rows.groupBy("id").agg(F.min("line").alias("first"))
    return rows.filter("pnl is not null").join(held.withColumnRenamed("first", "line"), ["id", "line"], "left_semi").select("id", "line")


@query(_L + "SELECT l.id, l.line, round(l.contracts * (m.mid - l.price) * CASE WHEN l.side = 'NO' THEN -1 ELSE 1 END, 4) + 0.0 AS marked FROM ledger l LEFT JOIN (SELECT asset, avg(price) AS mid FROM ledger GROUP BY asset) m USING (asset) WHERE l.pnl IS NULL")
def position_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open positions at their asset's average price."""
    rows = ledger(spark, sf_dir)
    market = rows.groupBy("asset").agg(F.avg("price").alias("mid"))
    return rows.filter("pnl is null").join(market, "asset", "left").select("id", "line", (F.round(S.unrealized_pnl(F.col("side"), F.col("mid"), F.col("price"), F.col("contracts")), 4) + 0.0).alias("marked"))


@query(_L + ", s AS (SELECT id, arg_max(won_yes, line) AS result FROM ledger WHERE won_yes IS NOT NULL AND line % 2 = 0 GROUP BY id), p AS (SELECT period, asset, min(pnl) AS period_pnl FROM ledger GROUP BY 1, 2) SELECT l.id, l.line, coalesce(s.result, p.period_pnl > 0) AS settled FROM ledger l LEFT JOIN s USING (id) LEFT JOIN p USING (period, asset)")
def enrich_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade's settlement by contract, else by period and asset; the last written row counts."""
    rows = ledger(spark, sf_dir)
    by_id = rows.filter("won_yes is not null and line % 2 = 0").groupBy("id").agg(F.max_by("won_yes", "line").alias("result"))
    by_period = rows.groupBy("period", "asset").agg(F.min("pnl").alias("period_pnl"))
    return rows.join(by_id, "id", "left").join(by_period, ["period", "asset"], "left").select("id", "line", F.coalesce("result", F.col("period_pnl") > 0).alias("settled"))


@query(_L + "SELECT period, to_json(map_from_entries(list(ROW(asset, n) ORDER BY asset))) AS counts FROM (SELECT period, asset, count(*) AS n FROM ledger GROUP BY ALL) GROUP BY period")
def record_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON map of each period's trades by asset."""
    from ..sources.tables import record_ticks as record

    by = ledger(spark, sf_dir).groupBy("period", "asset").agg(F.count("*").alias("n"))
    return record(by, ["period"], "asset", "n", "counts")


@query(_L + "SELECT id, line, r AS n_in_period FROM (SELECT id, line, row_number() OVER (PARTITION BY asset, period, side ORDER BY us, id, line, part, supp, contracts, price) AS r FROM ledger) WHERE r <= 2")
def direction_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two entries of a direction in a period."""
    rank = F.row_number().over(Window.partitionBy("asset", "period", "side").orderBy(*ORDER))
    return ledger(spark, sf_dir).withColumn("n_in_period", rank).filter("n_in_period <= 2").select("id", "line", "n_in_period")


_PARTS = {name: ORACLES[name] for name in ("max_drawdown", "streaks", "sharpe_period")}


@query(f"SELECT * FROM ({_L} SELECT asset, {_STATS} FROM ledger GROUP BY asset) " + " ".join(f"LEFT JOIN ({sql}) USING (asset)" for sql in _PARTS.values()))
def performance_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset's trades, drawdown, streaks and period returns in one row, all from a ledger that is joined and written once."""
    rows = staged(ledger(spark, sf_dir).select("asset", *ORDER, "side", "period", "fee", "pnl"), "ledger")
    out = rows.groupBy("asset").agg(*trade_stats())
    for part in (drawdowns(rows.filter("pnl is not null").select("asset", *ORDER, "pnl")), longest_runs(rows), sharpes(rows)):
        out = out.join(part, "asset", "left")
    return out
