"""Queries over signals: calibrated probabilities, consensus, gates, the non-compounding backtest, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof
from ..operators.folds import anchored_stale_seconds
from ..operators.ordered import DAY_US, bucket_parts, row_parts, running
from ..sources.staging import staged
from .bindings import LONG, SHORT, STANDS_FOR, fee_sql, settled, settled_sql, table, ticks
from .registry import query
from .ticks import HORIZONS, LEADER, _HISTORY, _MICRO, _NOW, _VOL, VOL_HISTORY, VOL_SQL, anchored_sql, latest_states, nearest_sql, tick_volatility, with_leader

SLOT_US = 3600 * _MICRO
SCALE = LONG / SHORT  # the gates' windows are for short periods


def clamp_sql(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({low}::DOUBLE, least({high}::DOUBLE, {x})) END)"


def norm_cdf_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + {S.ERF_SCALE}::DOUBLE * {x}))"
    series = f"{S.ERF_TERMS[-1]}::DOUBLE"
    for c in reversed(S.ERF_TERMS[:-1]):
        series = f"({series} * {t} + {c}::DOUBLE)"
    erf = f"(1 - {series} * {t} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} IS NOT NULL THEN 0.5 * (1 + CASE WHEN {z} < 0 THEN -{erf} ELSE {erf} END) END)"


#: The move of a price that restarts its clock; the given prices lie far apart, live ones move by thousandths.
SIGNAL_MOVE = 1.0
_FEATURES = settled_sql().replace("WITH ", "WITH RECURSIVE ", 1) + _HISTORY + f""", prices AS (SELECT seq, asset, us, real_price AS price FROM ticks), {anchored_sql('prices', 'asset', SIGNAL_MOVE)}, now AS (SELECT *, {_NOW.format(c='real_price')} AS cur FROM ticks),
trends AS (SELECT now.*, CASE WHEN a.v > 0 THEN (cur - a.v) / a.v * 100 END AS trend15, CASE WHEN b.v > 0 THEN (cur - b.v) / b.v * 100 END AS trend30 FROM now LEFT JOIN {nearest_sql('real_price', 900, False)} a USING (asset, us) LEFT JOIN {nearest_sql('real_price', 1800, False)} b USING (asset, us)),
{_VOL},
st AS (SELECT t.seq, arg_max(s.rate4, s.r) AS rate4, arg_max(s.osc, s.r) AS osc, max(s.r) AS n_settled FROM ticks t LEFT JOIN states s ON s.settle_us <= t.us GROUP BY t.seq),
feats AS (SELECT t.*, {VOL_SQL} AS vol, rate4, osc, coalesce(n_settled, 0) AS n_settled, coalesce((t.us - f.since) / 1e6, 999.0) AS stale FROM trends t JOIN v USING (seq) JOIN st USING (seq) JOIN folded f USING (seq))
"""


def clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with stale, the exact seconds since their price last moved (W9), written once."""
    return staged(anchored_stale_seconds(ticks(spark, sf_dir), ["asset"], "real_price", SIGNAL_MOVE, name="stale"), "clocked-ticks")


def features(spark: SparkSession, sf_dir: str, results: DataFrame | None = None, clock: bool = False) -> DataFrame:
    """Ticks with trend15, trend30, vol, and the settlement state known at the time (rate4, osc, n_settled).

    The ticks are read twice: once for all that looks back, once for the last
    prices that cross buckets. results: staged settlements. clock adds stale,
    which asset_signals asks for.
    """
    then = asof.nearest("real_price", {f"_then{m}": h * _MICRO for m, h in ((15, 900), (30, 1800))}, inclusive=False)
    t = clocked(spark, sf_dir) if clock else ticks(spark, sf_dir)
    width, parts = bucket_parts(t, ["asset"], VOL_HISTORY * _MICRO)
    t = asof.over_time(t, ["asset"], VOL_HISTORY * _MICRO, [then, tick_volatility()], {"_now": "real_price"}, width, parts)
    t = t.withColumns({f"trend{m}": asof.percent_change("_now", f"_then{m}") for m in (15, 30)}).drop("_now", "_then15", "_then30")
    states = latest_states(settled(spark, sf_dir) if results is None else results)
    t = asof.asof_join(t, states, "settle_us", [], ["rate4", "osc", "n_settled"], LONG * _MICRO, parts=parts)
    return t.withColumn("n_settled", F.coalesce(F.col("n_settled").cast("long"), F.lit(0).cast("long")))


_DEFAULT = "CASE asset " + " ".join(f"WHEN '{a}' THEN {S.DEFAULT_VOLATILITY[x]}::DOUBLE" for a, x in STANDS_FOR.items()) + f" ELSE {S.OTHER_VOLATILITY}::DOUBLE END"
_Z = f"(pvs / (greatest(coalesce(vol, {_DEFAULT}), 0.03::DOUBLE) / sqrt(900.0::DOUBLE) * sqrt(greatest(tte, 1.0::DOUBLE))))"
_P1 = clamp_sql(f"({norm_cdf_sql('z')} + {clamp_sql('(coalesce(trend15, 0.0) * 0.05::DOUBLE)', -0.02, 0.02)})", 0.02, 0.98)
_P = clamp_sql(f"({_P1} + {clamp_sql('(coalesce(ob_imbalance, 0.0) * 0.015::DOUBLE)', -0.01, 0.01)})", 0.02, 0.98)
_SIGNALS = _FEATURES + f""", zs AS (SELECT *, {_Z} AS z FROM feats), ps AS (SELECT *, {_P} AS p FROM zs),
signals AS (SELECT *, coalesce(pvs IS NOT NULL AND tte >= 60 AND mid BETWEEN 0.10::DOUBLE AND 0.90::DOUBLE AND stale <= 60, false) AS valid, (p > 0.5 AND mid < 0.45::DOUBLE) OR (NOT p > 0.5 AND mid > 0.55::DOUBLE) AS conflict, CASE WHEN p > 0.5 THEN 'YES' WHEN p < 0.5 THEN 'NO' END AS side FROM ps)
"""


def asset_signals(t: DataFrame) -> DataFrame:
    """Features, stale among them, with z, p, valid, conflict and side."""
    traded = F.create_map(*[F.lit(x) for pair in STANDS_FOR.items() for x in pair])[F.col("asset")]
    vol = F.coalesce(F.col("vol"), S.default_volatility(traded))
    t = t.withColumn("z", S.zscore(F.col("pvs"), F.col("tte"), vol))
    t = t.withColumn("p", S.model_probability(F.col("z"), F.col("trend15"), F.col("ob_imbalance")))
    return t.withColumns({"valid": S.signal_valid(F.col("mid"), F.col("pvs"), F.col("tte"), F.col("stale")), "conflict": S.conflict(F.col("p"), F.col("mid")), "side": S.side_of(F.col("p"), F.lit(0.5))})


@query(_SIGNALS + "SELECT seq, round(z, 6) AS z, round(p, 6) AS p, stale, valid, conflict, side FROM signals")
def model_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probability of every tick."""
    return asset_signals(features(spark, sf_dir, clock=True)).select("seq", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"), "stale", "valid", "conflict", "side")


_MOMENTS = _SIGNALS + f""", slots AS (SELECT *, us // {SLOT_US} AS slot FROM signals), moments AS (SELECT * FROM slots QUALIFY row_number() OVER (PARTITION BY asset, slot ORDER BY us DESC, seq DESC) = 1),
stats AS (SELECT slot, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE valid AND p > 0.5) AS n_yes, count(*) FILTER (WHERE valid AND p < 0.5) AS n_no, avg(z) FILTER (WHERE valid) AS avg_z FROM moments GROUP BY slot),
cons AS (SELECT *, CASE WHEN n_valid >= 3 THEN greatest(n_yes, n_no) / n_valid::DOUBLE ELSE 0.5::DOUBLE END AS agreement, CASE WHEN n_yes > n_no THEN 'YES' WHEN n_no > n_yes THEN 'NO' END AS cside FROM stats)
"""


def consensus_stats_of(agg) -> dict[str, Column]:
    """What the valid signals of one moment say together; agg turns an aggregate into a column."""
    valid = F.col("valid")
    yes, no, n = (agg(F.count_if(c)) for c in (valid & (F.col("p") > 0.5), valid & (F.col("p") < 0.5), valid))
    return {"n_valid": n, "n_yes": yes, "n_no": no, "avg_z": agg(F.avg(F.when(valid, F.col("z")))), "agreement": F.when(n >= 3, F.greatest(yes, no) / n).otherwise(0.5), "cside": F.when(yes > no, "YES").when(no > yes, "NO")}


def with_consensus(moments: DataFrame) -> DataFrame:
    """Each asset's signal beside its moment's consensus; a moment has one row for each asset."""
    by = Window.partitionBy("slot")
    return moments.withColumns(consensus_stats_of(lambda c: c.over(by)))


def moments_of(signals: DataFrame) -> DataFrame:
    """The last signal of each asset in a slot."""
    slotted = signals.withColumn("slot", F.call_function("div", F.col("us"), F.lit(SLOT_US)))
    rank = F.row_number().over(Window.partitionBy("asset", "slot").orderBy(F.desc("us"), F.desc("seq")))
    return slotted.withColumn("_r", rank).filter("_r = 1").drop("_r")


@query(_MOMENTS + "SELECT slot, n_valid, n_yes, n_no, round(avg_z, 6) AS avg_z, round(agreement, 6) AS agreement, cside, n_yes || 'Y' || n_no || 'N' AS label FROM cons")
def consensus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    made = consensus_stats_of(lambda c: c)
    c = moments_of(asset_signals(features(spark, sf_dir, clock=True))).groupBy("slot").agg(*[c.alias(n) for n, c in made.items()])
    return c.select("slot", "n_valid", "n_yes", "n_no", F.round("avg_z", 6).alias("avg_z"), F.round("agreement", 6).alias("agreement"), "cside", F.concat(F.col("n_yes").cast("string"), F.lit("Y"), F.col("n_no").cast("string"), F.lit("N")).alias("label"))


_AGREES = "coalesce(side = cside, false)"
_CONF = f"least(0.45::DOUBLE, (CASE WHEN osc > 0.7 THEN 0.15::DOUBLE WHEN osc < 0.3 AND n_settled >= 6 THEN 0.35::DOUBLE ELSE 0.25::DOUBLE END) * (CASE WHEN n_valid < 3 THEN 0.5::DOUBLE WHEN agreement >= 0.99 THEN CASE WHEN {_AGREES} THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END WHEN agreement >= 0.74 THEN CASE WHEN {_AGREES} THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END ELSE 0.3::DOUBLE END))"


_MODES = _MOMENTS + f""", j AS (SELECT m.*, c.n_valid, c.agreement, c.cside FROM moments m JOIN cons c USING (slot) WHERE valid), k AS (SELECT *, {_CONF} AS conf, n_valid >= 3 AND agreement >= 0.74 AND {_AGREES} AS strong FROM j),
b AS (SELECT *, conf * p + (1 - conf) * mid AS blended FROM k),
modes AS (SELECT *, CASE WHEN conf < 0.01 THEN NULL WHEN conflict THEN 'conflict' WHEN strong AND NOT coalesce((cside = 'YES' AND mid > 0.80) OR (cside = 'NO' AND mid < 0.20), false) THEN 'consensus' WHEN NOT strong AND (blended > mid + 0.003 OR blended < mid - 0.003) THEN 'blend' END AS mode FROM b),
rules AS (SELECT *, CASE WHEN mode = 'consensus' THEN cside WHEN mode = 'blend' THEN CASE WHEN blended > mid THEN 'YES' ELSE 'NO' END END AS rside,
CASE WHEN mode = 'consensus' THEN CASE WHEN agreement >= 0.99 THEN 0.025 + least(0.03, 0.015 * abs(z)) ELSE 0.015 + least(0.02, 0.01 * abs(z)) END WHEN mode = 'blend' THEN abs(blended - mid) ELSE 0 END AS redge FROM modes)
"""


@query(_MODES + "SELECT seq, mode, round(conf, 6) AS confidence, rside AS side, round(redge, 6) AS edge FROM rules")
def consensus_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid signals of each moment under its consensus."""
    j = apply_strategy(features(spark, sf_dir, clock=True), "consensus")
    return j.select("seq", "mode", F.round("confidence", 6).alias("confidence"), "side", F.round("edge", 6).alias("edge"))


_RULE = "(0.5::DOUBLE + 0.5::DOUBLE * tanh(coalesce(trend15, 0.0) * 5 + coalesce(trend30, 0.0) * 3 + pvs * (1 / greatest(tte / 900, 0.1::DOUBLE)) * 2 + coalesce((rate4 - 0.5) * 0.3, 0.0) + coalesce(ob_imbalance, 0.0) * 0.01))"
_RULES = _FEATURES + f""", rule0 AS (SELECT *, {_RULE} AS rp FROM feats WHERE mid IS NOT NULL AND pvs IS NOT NULL), rules AS (SELECT *, CASE WHEN rp > mid THEN 'YES' WHEN rp < mid THEN 'NO' END AS rside, abs(rp - mid) * (CASE WHEN sign(coalesce(trend15, 0.0)) = sign(pvs) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS redge FROM rule0)
"""


#: What a strategy adds to its rows, info being whatever it wants to log.
CONTRACT = {"side": "string", "edge": "double", "prob": "double", "info": "map<string,double>"}


def info(**values: Column) -> Column:
    """A strategy's diagnostics by name; unknown ones are left out."""
    made = F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v.cast("double"))])
    return F.map_filter(made, lambda _, v: v.isNotNull())


@dataclass(frozen=True)
class Strategy:
    """apply: rows with features to rows that have CONTRACT's columns as well; rows: the features that it asks for."""

    apply: Callable[[DataFrame], DataFrame]
    rows: Callable[[SparkSession, str, DataFrame | None], DataFrame] = features


def pandas_strategy(decide: Callable[[pd.DataFrame], pd.DataFrame], rows: Callable[[SparkSession, str, DataFrame | None], DataFrame] = features) -> Strategy:
    """A strategy from a function of a frame of feature rows to a frame of side, edge, prob and info (dicts), row by row; it sees Arrow batches, in no order."""

    def apply(t: DataFrame) -> DataFrame:
        columns = [c for c in t.columns if c not in CONTRACT]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                made = decide(frame)
                yield pd.concat([frame.reset_index(drop=True), made[list(CONTRACT)].reset_index(drop=True)], axis=1)

        kept = t.select(*columns)
        return kept.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"{n} {kind}" for n, kind in CONTRACT.items())]))

    return Strategy(apply, rows)


def rule_strategy(t: DataFrame) -> DataFrame:
    """Ticks with a mid and a distance to the strike."""
    held = t.filter("mid is not null and pvs is not null")
    p = S.rule_probability(*[F.col(c) for c in ("trend15", "trend30", "pvs", "tte", "rate4", "ob_imbalance")])
    held = held.withColumn("prob", p).withColumn("side", S.side_of(F.col("prob"), F.col("mid")))
    held = held.withColumn("edge", F.abs(F.col("prob") - F.col("mid")) * S.sign_agreement(F.col("trend15"), F.col("pvs")))
    return held.withColumn("info", info(trend15=F.col("trend15"), trend30=F.col("trend30"), settle_rate=F.col("rate4")))


def consensus_strategy(t: DataFrame) -> DataFrame:
    """The last valid signal of each asset and moment, under the moment's consensus."""
    j = with_consensus(moments_of(asset_signals(t))).filter("valid")
    made = S.consensus(*[F.col(c) for c in ("osc", "n_settled", "n_valid", "agreement", "side", "cside", "p", "z", "mid", "conflict")])
    out = j.withColumn("_s", made).withColumns({"side": F.col("_s.side"), "edge": F.col("_s.edge").cast("double"), "mode": F.col("_s.mode"), "confidence": F.col("_s.confidence"), "prob": F.col("p")}).drop("_s")
    return out.withColumn("info", info(z_score=F.col("z"), confidence=F.col("confidence"), agreement=F.col("agreement"), stale=F.col("stale")))


#: F2: strategies by name. learning adds "model".
STRATEGIES = {"rule": Strategy(rule_strategy), "consensus": Strategy(consensus_strategy, lambda spark, sf_dir, results=None: features(spark, sf_dir, results, clock=True))}


def apply_strategy(t: DataFrame, name: str) -> DataFrame:
    """a registered strategy, held to its contract."""
    out = t.transform(STRATEGIES[name].apply)
    found = {f.name: f.dataType.simpleString() for f in out.schema}
    wrong = sorted(n for n, kind in CONTRACT.items() if found.get(n) != kind)
    if wrong:
        raise ValueError(f"strategy {name} lacks {wrong} of the right types")
    return out


@query(_RULES + " UNION ALL ".join(f"SELECT seq, '{n}' AS name, round({c}, 6) AS value FROM rules WHERE {c} IS NOT NULL" for n, c in (("trend15", "trend15"), ("trend30", "trend30"), ("settle_rate", "rate4"))))
def strategy_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what the rule strategy logs beside its signals."""
    t = apply_strategy(features(spark, sf_dir), "rule")
    return t.select("seq", F.explode("info").alias("name", "value")).select("seq", "name", F.round("value", 6).alias("value"))


@query(_RULES + "SELECT seq, round(rp, 6) AS prob, rside AS side, round(redge, 6) AS edge FROM rules")
def rule_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P29."""
    return apply_strategy(features(spark, sf_dir), "rule").select("seq", F.round("prob", 6).alias("prob"), "side", F.round("edge", 6).alias("edge"))


def _gate_sql(name: str, side: str | None) -> str:
    c = S.RISK_CONFIGS[name]
    out = f"CASE WHEN mid IS NULL OR tte IS NULL THEN 'missing_data' WHEN NOT mid BETWEEN {c['mid'][0]}::DOUBLE AND {c['mid'][1]}::DOUBLE THEN 'mid_outside_range' WHEN NOT tte BETWEEN {c['tte'][0] * SCALE} AND {c['tte'][1] * SCALE} THEN 'tte_outside_window'"
    if "blackout" in c:
        out += f" WHEN tte BETWEEN {c['blackout'][0] * SCALE} AND {c['blackout'][1] * SCALE} THEN 'tte_blackout'"
    out += f" WHEN spread > {c['spread']}::DOUBLE THEN 'spread_too_wide'"
    if "max_price" in c and side:
        out += f" WHEN CASE WHEN {side} = 'YES' THEN mid WHEN {side} = 'NO' THEN 1 - mid END > {c['max_price']}::DOUBLE THEN 'price_too_high'"
    return out + " ELSE 'ok' END"


PARAMETERS = ("min_edge", "kelly_fraction", "max_per_trade", "max_exposure", "max_same_direction", "fee_rate", "net_edge_floor", "bankroll")


def with_configs(t: DataFrame) -> DataFrame:
    """Every row once for each risk configuration, with its parameters and its gate's reason."""
    cells = [F.struct(F.lit(n).alias("config"), S.gate_reason(c, F.col("mid"), F.col("tte"), F.col("spread"), F.col("side"), SCALE).alias("reason"), *[F.lit(float(c[k])).alias(k) for k in PARAMETERS]) for n, c in S.RISK_CONFIGS.items()]
    return t.withColumn("_x", F.explode(F.array(*cells))).select("*", "_x.*").drop("_x")


def gated_sql(rules: str) -> str:
    return rules + ", gated AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS config, {_gate_sql(n, 'rside')} AS reason FROM rules" for n in S.RISK_CONFIGS) + ")\n"


_GATED = gated_sql(_RULES)


@query(_GATED + "SELECT seq, config, reason FROM gated")
def gate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P32, P33, P34, J13."""
    return with_configs(apply_strategy(features(spark, sf_dir), "rule")).select("seq", "config", "reason")


def _entry_sql(name: str) -> str:
    c = S.RISK_CONFIGS[name]
    return f"CASE WHEN held > 0 THEN 'in_position' WHEN reason <> 'ok' THEN reason WHEN n_open * {c['max_per_trade']}::DOUBLE >= {c['max_exposure']}::DOUBLE THEN 'exposure_limit' WHEN n_side >= {c['max_same_direction']} THEN 'max_same_direction' ELSE 'ok' END"


@query(_GATED + """, h AS (SELECT *, count(*) FILTER (WHERE reason = 'ok' AND rside IS NOT NULL) OVER (PARTITION BY config, ticker ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM gated), e AS (SELECT *, CASE WHEN held = 0 AND reason = 'ok' AND rside IS NOT NULL THEN 1 ELSE 0 END AS entry FROM h),
o AS (SELECT *, coalesce(sum(entry) OVER w, 0) AS n_open, coalesce(sum(CASE WHEN rside = 'YES' THEN entry ELSE 0 END) OVER w, 0) AS n_yes, coalesce(sum(CASE WHEN rside = 'NO' THEN entry ELSE 0 END) OVER w, 0) AS n_no FROM e WINDOW w AS (PARTITION BY config, period_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN rside = 'YES' THEN n_yes WHEN rside = 'NO' THEN n_no ELSE 0 END AS n_side FROM o) """ + f"SELECT config, seq, CASE config {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {_entry_sql(n)}' for n in S.RISK_CONFIGS)} END AS reason FROM s")
def entry_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons that depend on what a configuration holds: each contract's first tick that passes opens a position of the largest size.

    A contract's rows meet in one task, then a period's; both are dealt to as many partitions as the rows ask for.
    """
    t = with_configs(apply_strategy(features(spark, sf_dir), "rule"))
    parts = row_parts(table(spark, sf_dir, "events").count() * len(S.RISK_CONFIGS))
    t = t.repartition(parts, "config", "ticker")
    passes, before = (F.col("reason") == "ok") & F.col("side").isNotNull(), (Window.unboundedPreceding, -1)
    t = t.withColumn("_held", F.count_if(passes).over(Window.partitionBy("config", "ticker").orderBy("us", "seq").rowsBetween(*before)))
    t = t.repartition(parts, "config", "period_id")
    entry = F.when((F.col("_held") == 0) & passes, 1).otherwise(0)
    by = Window.partitionBy("config", "period_id").orderBy("us", "seq").rowsBetween(*before)
    opened = lambda side=None: F.coalesce(F.sum(entry if side is None else F.when(F.col("side") == side, entry).otherwise(0)).over(by), F.lit(0))
    t = t.withColumns({"_open": opened(), "_yes": opened("YES"), "_no": opened("NO")})
    same = F.when(F.col("side") == "YES", F.col("_yes")).when(F.col("side") == "NO", F.col("_no")).otherwise(0)
    reason = F.lit(None).cast("string")
    for name, c in S.RISK_CONFIGS.items():
        own = S.gate_reason(c, F.col("mid"), F.col("tte"), F.col("spread"), F.col("side"), SCALE, F.col("_held") > 0, F.col("_open") * c["max_per_trade"], same)
        reason = F.when(F.col("config") == name, own).otherwise(reason)
    return t.select("config", "seq", reason.alias("reason"))


@query(_GATED + "SELECT config, reason, n FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY n DESC, reason) AS r FROM (SELECT config, reason, count(*) AS n FROM gated GROUP BY config, reason)) WHERE r <= 10")
def skip_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent reasons of each configuration."""
    counts = with_configs(apply_strategy(features(spark, sf_dir), "rule")).groupBy("config", "reason").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("config").orderBy(F.desc("n"), "reason"))
    return counts.withColumn("r", rank).filter("r <= 10").drop("r")


def backtest(spark: SparkSession, sf_dir: str, strategy: str = "rule") -> DataFrame:
    """Entries of each configuration with profit, non-compounding.

    The first tick of a contract that passes the gates with enough edge enters
    (W15); of a period's entries in one direction the first few stay (W16); each
    is sized on the constant bankroll (P15) and settled (J2, P17).
    """
    results = settled(spark, sf_dir)
    t = with_configs(apply_strategy(STRATEGIES[strategy].rows(spark, sf_dir, results), strategy)).filter("reason = 'ok' and side is not null and edge >= min_edge")
    first = F.row_number().over(Window.partitionBy("config", "ticker").orderBy("us", "seq"))
    t = t.withColumn("_r", first).filter("_r = 1")
    capped = F.row_number().over(Window.partitionBy("config", "period_id", "side").orderBy("us", "seq"))
    t = t.withColumn("_r", capped).filter("_r <= max_same_direction").drop("_r")
    size = S.kelly_size(F.col("edge"), F.col("_price"), F.col("mid"), F.col("bankroll"), F.lit(0.0), {k: F.col(k) for k in PARAMETERS})
    t = t.withColumn("_price", S.contract_price(F.col("side"), F.col("mid"))).withColumn("_s", size)
    t = t.filter("_s.contracts > 0").withColumn("contracts", F.col("_s.contracts"))
    t = t.join(results.select("ticker", "result", "settle_us"), "ticker")
    t = t.withColumn("fee", S.fee(F.col("contracts"), F.col("mid"), F.col("fee_rate")))
    t = t.withColumn("pnl", S.binary_payoff(F.col("side"), F.col("result") == "YES", F.col("contracts"), F.col("mid"), F.col("fee")))
    return until_stopped(staged(t.select("config", "seq", "us", "ticker", "side", "mid", "edge", "contracts", "fee", "settle_us", "pnl"), "trades"))


def until_stopped(trades: DataFrame) -> DataFrame:
    """Trades entered before their configuration's stop, with the bankroll after each (made) and its best so far (top).

    A share of the start stops a configuration, or a trailing floor or a profit;
    either is known once the breaching trade settles.
    """
    bank = running(trades, ["config"], ["settle_us", "us", "seq"], F.col("pnl"), "made", "top", F.call_function("div", F.col("settle_us"), F.lit(30 * DAY_US)))
    stop = F.lit(False)
    for name, c in S.RISK_CONFIGS.items():
        made, top = F.col("made"), F.col("top")
        hit = made < c["bankroll"] * (c["stop_share"] - 1) if "stop_share" in c else (made <= top - c["trail"]) | (made >= c["take"])
        stop = F.when(F.col("config") == name, hit).otherwise(stop)
    stops = bank.filter(stop).groupBy("config").agg(F.min("settle_us").alias("_stop"))
    return bank.join(F.broadcast(stops), "config", "left").filter(F.col("_stop").isNull() | (F.col("us") < F.col("_stop"))).drop("_stop")  # a row for each configuration


def _stop_sql() -> str:
    cases = [f"WHEN '{n}' THEN " + (f"made < {c['bankroll'] * (c['stop_share'] - 1)}::DOUBLE" if "stop_share" in c else f"made <= top - {c['trail']}::DOUBLE OR made >= {c['take']}::DOUBLE") for n, c in S.RISK_CONFIGS.items()]
    return "CASE config " + " ".join(cases) + " END"


def _config_sql(value: str) -> str:
    return "CASE config " + " ".join(f"WHEN '{n}' THEN {float(c[value])}::DOUBLE" for n, c in S.RISK_CONFIGS.items()) + " END"


def backtest_sql(rules: str) -> str:
    return gated_sql(rules) + f""", entered AS (SELECT * FROM gated WHERE reason = 'ok' AND rside IS NOT NULL AND redge >= {_config_sql('min_edge')} QUALIFY row_number() OVER (PARTITION BY config, ticker ORDER BY us, seq) = 1),
capped AS (SELECT *, CASE WHEN rside = 'YES' THEN mid ELSE 1 - mid END AS cp, {_config_sql('fee_rate')} AS rate FROM entered QUALIFY row_number() OVER (PARTITION BY config, period_id, rside ORDER BY us, seq) <= {_config_sql('max_same_direction')}),
usd AS (SELECT *, greatest(least(least({_config_sql('bankroll')} * {_config_sql('kelly_fraction')} * (CASE WHEN (1 - cp) / nullif(cp, 0) > 0 THEN redge / ((1 - cp) / cp) ELSE 0.0 END), {_config_sql('bankroll')} * {_config_sql('max_per_trade')}), {_config_sql('bankroll')} * {_config_sql('max_exposure')} - 0.0), 0.0) AS usd FROM capped),
n AS (SELECT *, CASE WHEN usd >= cp THEN floor(usd / cp) ELSE 0 END AS n FROM usd), f AS (SELECT *, CASE WHEN n > 0 AND mid > 0 AND mid < 1 THEN ceil(rate * n * mid * (1 - mid) * 100) / 100.0::DOUBLE ELSE 0.0 END AS fee FROM n),
settling AS (SELECT f.*, s.settle_us, round((CASE WHEN rside = 'YES' THEN 1 ELSE -1 END) * (CASE WHEN s.result = 'YES' THEN n * (1 - mid) ELSE -n * mid END) - fee, 4) + 0.0 AS pnl FROM f JOIN settlements s USING (ticker) WHERE n > 0 AND redge - fee / n >= {_config_sql('net_edge_floor')}),
made AS (SELECT *, sum(pnl) OVER w AS made FROM settling WINDOW w AS (PARTITION BY config ORDER BY settle_us, us, seq ROWS UNBOUNDED PRECEDING)), tops AS (SELECT *, greatest(0.0, max(made) OVER (PARTITION BY config ORDER BY settle_us, us, seq ROWS UNBOUNDED PRECEDING)) AS top FROM made),
stops AS (SELECT config, min(settle_us) AS stop FROM tops WHERE {_stop_sql()} GROUP BY config), trades AS (SELECT t.* FROM tops t LEFT JOIN stops s USING (config) WHERE s.stop IS NULL OR t.us < s.stop)
"""


_BACKTEST = backtest_sql(_RULES)


@query(_BACKTEST + "SELECT config, seq, ticker, rside AS side, CAST(n AS BIGINT) AS contracts, fee, pnl FROM trades")
def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of three configurations."""
    return backtest(spark, sf_dir).select("config", "seq", "ticker", "side", "contracts", "fee", "pnl")


@query(_BACKTEST + "SELECT config, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, round(sum(pnl), 4) AS pnl, round(sum(fee), 4) AS fees, round(max((top - made) / (100.0 + top)), 6) AS max_drawdown FROM trades GROUP BY config")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 with W10, W11 and the stops for each configuration."""
    drop = (F.col("top") - F.col("made")) / (100.0 + F.col("top"))
    return backtest(spark, sf_dir).groupBy("config").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.round(F.sum("pnl"), 4).alias("pnl"), F.round(F.sum("fee"), 4).alias("fees"), F.round(F.max(drop), 6).alias("max_drawdown"))


@query(backtest_sql(_MODES) + "SELECT config, seq, ticker, rside AS side, CAST(n AS BIGINT) AS contracts, fee, pnl FROM trades")
def backtest_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the consensus strategy."""
    return backtest(spark, sf_dir, "consensus").select("config", "seq", "ticker", "side", "contracts", "fee", "pnl")


# --- evaluation: the rule's probability against outcomes -------------------

_SCORED = _RULES + ", scored AS (SELECT r.*, CASE WHEN s.result = 'YES' THEN 1 ELSE 0 END AS y FROM rules r JOIN settlements s USING (ticker))\n"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = settled(spark, sf_dir)
    t = apply_strategy(features(spark, sf_dir, results), "rule")
    outcome = results.select("ticker", (F.col("result") == "YES").cast("int").alias("y"))
    return t.join(outcome, "ticker")


def score_stats() -> list[Column]:
    """A19, P43."""
    brier = F.avg(F.pow(F.col("prob") - F.col("y"), 2))
    return [F.count("*").alias("n"), F.round(F.avg(((F.col("prob") >= 0.5) == (F.col("y") == 1)).cast("int")), 6).alias("accuracy"), F.round(brier, 6).alias("brier"), S.grade(brier).alias("grade")]


_ACC = "count(*) AS n, round(avg(CASE WHEN (rp >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((rp - y) * (rp - y)), 6) AS brier, CASE WHEN avg((rp - y) * (rp - y)) < 0.20 THEN 'GOOD' WHEN avg((rp - y) * (rp - y)) < 0.24 THEN 'MODERATE' WHEN avg((rp - y) * (rp - y)) < 0.25 THEN 'MARGINAL' ELSE 'POOR' END AS grade"


@query(_SCORED + f"SELECT coalesce(asset, 'all') AS asset, {_ACC} FROM scored GROUP BY ROLLUP (asset)")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By asset and in all."""
    return scored(spark, sf_dir).rollup("asset").agg(*score_stats()).withColumn("asset", F.coalesce("asset", F.lit("all")))


@query(_SCORED + "SELECT CASE WHEN rp < 0.2 THEN 0 WHEN rp < 0.4 THEN 1 WHEN rp < 0.6 THEN 2 WHEN rp < 0.8 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(rp), 6) AS mean_p, round(avg(y), 6) AS mean_y, round(avg(y) - avg(rp), 6) AS gap FROM scored GROUP BY 1")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    p = F.col("prob")
    bins = F.when(p < 0.2, 0).when(p < 0.4, 1).when(p < 0.6, 2).when(p < 0.8, 3).otherwise(4)
    return scored(spark, sf_dir).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.avg("y") - F.avg("prob"), 6).alias("gap"))


@query(_SCORED + "SELECT CASE WHEN rp - mid > 0.05::DOUBLE THEN 'yes' WHEN rp - mid < -0.05::DOUBLE THEN 'no' ELSE 'neutral' END AS bucket, count(*) AS n, round(avg(y), 6) AS yes_rate, round(avg(rp - mid), 6) AS avg_edge FROM scored GROUP BY 1")
def edge_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    edge = F.col("prob") - F.col("mid")
    bucket = F.when(edge > 0.05, "yes").when(edge < -0.05, "no").otherwise("neutral")
    return scored(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("yes_rate"), F.round(F.avg(edge), 6).alias("avg_edge"))


@query(_SCORED + "SELECT count(*) AS n, round(sum(CASE WHEN rp > mid THEN y - mid ELSE mid - y END), 4) AS pnl, round(avg(CASE WHEN rp > mid THEN y - mid ELSE mid - y END), 6) AS per_trade FROM scored WHERE abs(rp - mid) >= 0.05::DOUBLE")
def simulated_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract where the edge is 0.05 or more, no fee."""
    made = F.when(F.col("prob") > F.col("mid"), F.col("y") - F.col("mid")).otherwise(F.col("mid") - F.col("y"))
    return scored(spark, sf_dir).filter(F.abs(F.col("prob") - F.col("mid")) >= 0.05).agg(F.count("*").alias("n"), F.round(F.sum(made), 4).alias("pnl"), F.round(F.avg(made), 6).alias("per_trade"))


@query(_SCORED + ", folds AS (SELECT *, dense_rank() OVER (ORDER BY period_id) - 1 AS fold FROM scored), sizes AS (SELECT fold, sum(count(*)) OVER (ORDER BY fold) - count(*) AS n_train FROM folds GROUP BY fold) " + f"SELECT fold, CASE WHEN fold IS NOT NULL THEN any_value(n_train) END AS n_train, count(*) FILTER (WHERE y = 1) AS n_yes, {_ACC} FROM folds JOIN sizes USING (fold) WHERE fold >= 2 GROUP BY ROLLUP (fold)")
def fold_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding folds, each tested on one period after all before it, and all folds pooled (fold null)."""
    rows = staged(scored(spark, sf_dir).select("period_id", "prob", "y"), "scored")
    folds = numbered_periods(rows).filter("fold >= 2")
    stats = [F.first("n_train").alias("n_train"), F.count_if(F.col("y") == 1).alias("n_yes"), *score_stats()]
    out = rows.join(folds, "period_id").groupingSets([[F.col("fold")], []], F.col("fold")).agg(*stats)
    return out.withColumn("n_train", F.when(F.col("fold").isNotNull(), F.col("n_train")))


def numbered_periods(rows: DataFrame) -> DataFrame:
    """(period_id, fold, n_train): periods numbered from 0 in order, with the rows of all before."""
    periods = staged(rows.groupBy("period_id").agg(F.count("*").alias("rows")), "periods").withColumn("_one", F.lit(0))
    bucket = F.call_function("div", F.col("period_id"), F.lit(1000))
    periods = running(periods, ["_one"], ["period_id"], F.lit(1), "k", bucket=bucket)
    periods = running(periods, ["_one"], ["period_id"], F.col("rows"), "upto", bucket=bucket)
    return periods.select("period_id", (F.col("k") - 1).cast("int").alias("fold"), (F.col("upto") - F.col("rows")).cast("long").alias("n_train"))


#: The columns of a feature vector, in order.
FEATURES = ["mid", "spread", "tte", "tte_pct", "ob_imbalance", "pvs", "volume", "oi", "mom_900", "mom_1800", "mom_3600", "lead_mid", "lead", "mid_decisiveness"]
_SAMPLES = (
    settled_sql() + ", now AS (SELECT seq, asset, us, period_id, ticker, spread, tte, ob_imbalance, pvs, mid, user_id::DOUBLE AS volume, k::DOUBLE AS oi, " + _NOW.format(c="mid") + " AS cur FROM ticks), moved AS (SELECT now.*"
    + "".join(f", round(cur - m{h}.v, 6) AS mom_{h}" for h in HORIZONS) + " FROM now" + "".join(f" LEFT JOIN {nearest_sql('mid', h)} m{h} USING (asset, us)" for h in HORIZONS) + f"""),
leads AS (SELECT *, last_value(CASE WHEN asset = '{LEADER}' AND mid IS NOT NULL THEN {{'mid': mid, 'mom': mom_900}} END IGNORE NULLS) OVER (ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leader FROM moved),
samples AS (SELECT l.*, CASE WHEN asset <> '{LEADER}' THEN leader.mid END AS lead_mid, CASE WHEN asset <> '{LEADER}' THEN leader.mom - mom_900 END AS lead, abs(mid - 0.5) AS mid_decisiveness, tte / {LONG} AS tte_pct, CASE WHEN s.result = 'YES' THEN 1 ELSE 0 END AS y FROM leads l JOIN (SELECT ticker, result FROM settlements) s USING (ticker) WHERE mid IS NOT NULL AND tte IS NOT NULL)
"""
)


def feature_vectors(t: DataFrame) -> DataFrame:
    """Ticks that have a mid, with the fourteen features (null where unknown)."""
    t = with_leader(t.withColumns({"volume": F.col("user_id").cast("double"), "oi": F.col("k").cast("double")}))
    made = {"tte_pct": F.col("tte") / LONG, "mid_decisiveness": F.abs(F.col("mid") - 0.5)}
    return t.na.drop(subset=["mid", "tte"]).withColumns(made)


def feature_samples(spark: SparkSession, sf_dir: str, results: DataFrame | None = None) -> DataFrame:
    """Feature vectors with their outcome y."""
    outcome = (settled(spark, sf_dir) if results is None else results).select("ticker", S.result_label(F.col("result")).alias("y"))
    return feature_vectors(ticks(spark, sf_dir)).join(outcome, "ticker").select("seq", "asset", "ticker", "period_id", "us", "y", *FEATURES)


def timed_parts(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Staged rows with part: train for the first share of them by time, test for the rest."""
    hour = F.call_function("div", F.col("us"), F.lit(SLOT_US))  # all assets' rows of a bucket meet in one task
    numbered = running(rows.withColumn("_one", F.lit(0)), ["_one"], ["us", "seq"], F.lit(1), "_r", bucket=hour).drop("_one")
    total = rows.agg(F.count("*").alias("_total"))
    part = F.when(F.col("_r") <= F.floor(share * F.col("_total")), "train").otherwise("test")
    return numbered.join(F.broadcast(total)).withColumn("part", part).drop("_r", "_total")  # one row is sent


@query(_SAMPLES + ", n AS (SELECT *, row_number() OVER (ORDER BY us, seq) AS r, count(*) OVER () AS total FROM samples) SELECT seq, y, CASE WHEN r <= floor(0.8::DOUBLE * total) THEN 'train' ELSE 'test' END AS part, " + ", ".join(FEATURES) + " FROM n")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with all features, the first four fifths by time for training."""
    return timed_parts(staged(feature_samples(spark, sf_dir), "samples")).select("seq", "y", "part", *FEATURES)
